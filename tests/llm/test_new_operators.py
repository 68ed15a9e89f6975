"""Manifests, benchmark decontamination and vector codes against brute force, on small fixtures with awkward rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodesift.llm import decontaminate, merkle, queries, yinyang

FOLDER = "/root/testdata/sf0.001"
NEW = ("op11_merkle_manifest", "op12_benchmark_decontamination", "op13_vector_codes")


@pytest.mark.parametrize("name", NEW)
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    theirs = con.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(theirs) and theirs


# Manifests


def _h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def _plain_tree(nodes):
    """Levels of a tree from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def _plain_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 27, 28, 80, 243])
@pytest.mark.parametrize("more", [0, 2])
def test_traversal_gives_every_path_with_few_nodes(n, more):
    leaves, held = [_h(str(i)) for i in range(n)], []
    levels = _plain_tree(leaves)
    levels += [[_h(*levels[-1])]] if more else []
    levels += [[_h(*levels[-1])]] if more else []
    paths = list(merkle.traverse(leaves, len(levels) - 1, held.append))
    assert paths == [_plain_path(levels, i) for i in range(n)]
    assert all(merkle.folded(x, p) == levels[-1][0] for x, p in zip(leaves, paths))
    assert max(held) <= 8 * max(1, len(levels) - 1)


def _manifest(rows):
    """Brute force over (id, group, text): leaves are hashes of the text, changed texts have no line ends."""
    groups = collections.defaultdict(list)
    for i, g, text in rows:
        leaf = _h(f"{len(text.encode())}:{text}" if text is not None else "-")
        other = _h(f"{len(x.encode())}:{x}") if text is not None and (x := text.replace("\n", "")) is not None else None
        groups[g].append((i, leaf, other))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = [], collections.Counter()
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(_plain_tree([x[1] for x in groups[g]]))
    top = _plain_tree([t[-1][0] for t in trees])
    for k, (g, tree) in enumerate(zip(order, trees)):
        for j, (i, leaf, other) in enumerate(groups[g]):
            path = _plain_path(tree, j) + _plain_path(top, k)
            root = merkle.folded(other or leaf, path)
            out[i, leaf, tree[-1][0], top[-1][0], _h(*(a + b for a, b in path)), root, root == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("high", [5, 2, 1])
def test_manifest_equals_brute_force(spark, high):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else rng.choice(["b", "Z", "é", "", None]), rng.choice(["x\ny", "", "z", None, "long " * 9000]) if i % 4 else f"t{i}\n") for i in range(400)]
    rows += [rows[7], rows[7], (None, "hot", "no id"), (None, None, None), (5, "alone", "only\none")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in ("h", "n", "g", "pos", "t", "items", "index")})
    cells = merkle.manifest(df, merkle.leaf(F.col("text")), merkle.leaf(F.replace("text", F.lit("\n"), F.lit(""))), high=high)
    assert cells.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = collections.Counter(map(tuple, cells.collect()))
    assert found == _manifest(rows) and len({k[-1] for k in found}) == 2
    none = merkle.manifest(df.limit(0), merkle.leaf(F.col("text")), F.lit(None).cast("string"))
    assert none.count() == 0
    one = merkle.manifest(df.where("source = 'alone'"), merkle.leaf(F.col("text")), F.lit(None).cast("string")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == _h() and one.verified


# Benchmark decontamination


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))


def _leaks(docs, items):
    grams = collections.defaultdict(set)
    for item, text in items:
        w = _words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            grams[tuple(w[i : i + n])].add(str(item))
    out = collections.Counter()
    for doc, text in docs:
        w, hit, met = _words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    met |= g
        out[doc, len(w), len(hit), len(met), _h(",".join(sorted(met))), bool(hit)] += 1
    return out


def _texts():
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choices([a + b for a in "bdfgk" for b in "aeiou"], k=n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 40]))) for i in range(30)]
    items += [(100 + i, items[4][1]) for i in range(50)] + [(None, say(20)), (200, None), (201, " .,\n"), (202, ""), (203, "Żółw 文字 naïve"), (10, items[1][1]), (31, items[0][1].upper() + "!")]
    docs = [(i, say(30) + " " + " -- ".join((rng.choice(items)[1] or "").split()) + ". " + say(5)) for i in range(60)]
    docs += [(60 + i, say(50)) for i in range(20)] + [(90, None), (91, ""), (92, " \n"), (None, items[5][1]), (93, "ŻÓŁW żółw 文字 naïve"), (94, "Żółw, 文字 NAïVE"), (95, (items[4][1] + " ") * 3000), (96, items[6][1]), docs[3], docs[3]]
    return docs, items


def test_scan_equals_brute_force(spark):
    docs, items = _texts()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("w", "row", "spans", "gram", "set_no", "item_id")})
    b = spark.createDataFrame(items, "item_id long, text string")
    columns = ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = decontaminate.scan(d, b)
    assert collections.Counter(map(tuple, found.select(columns).collect())) == _leaks(docs, items)
    assert collections.Counter(map(tuple, decontaminate.scan(d, b.limit(0)).select(columns).collect())) == _leaks(docs, [])
    assert decontaminate.scan(d.limit(0), b).count() == 0


def test_small_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 6)
    docs, items = _texts()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(d, b).select("id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert collections.Counter(map(tuple, found.collect())) == _leaks(docs, items)


def test_clean_takes_hit_words_and_nothing_else(spark):
    docs, items = _texts()
    rows = [(i, t, {"k": 1}) for i, t in docs]
    d = spark.createDataFrame(rows, "doc_id long, text string, row map<string,int>")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(d, b)
    whole = {i: t for i, t in docs}
    hit = {r.id for r in found.where("contaminated").collect()}
    left = decontaminate.clean(d, found, "documents").collect()
    assert collections.Counter(r.doc_id for r in left) == collections.Counter(i for i, _ in docs if i not in hit) and all(r.row == {"k": 1} for r in left)
    cut = decontaminate.clean(d, found)
    assert cut.columns == d.columns and cut.count() == len(docs)
    spans = {r.id: r.spans for r in found.collect()}
    for r in cut.collect():
        gone = {k for s in spans[r.doc_id] for k in range(s["at"] - 1, s["end"] - 1)}
        assert _words(r.text) == [w for k, w in enumerate(_words(whole[r.doc_id])) if k not in gone]
        assert r.doc_id in hit or r.text == whole[r.doc_id]


# Vector codes


def _plain_codes(rows, parts=16, entries=64, rounds=2):
    """(id, label, ints) by plain rounds; rows are in the order of ids."""
    x = np.array([r[2] for r in rows], np.int64)
    width = x.shape[1] // parts
    books = [x[:entries, p * width : (p + 1) * width].copy() for p in range(parts)]

    def near(p):
        own = x[:, p * width : (p + 1) * width]
        d = ((own[:, None] - books[p][None]) ** 2).sum(2)
        return own, d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(parts):
            own, at, _ = near(p)
            for e in np.unique(at):
                books[p][e] = own[at == e].sum(0) // (at == e).sum()
    found = [near(p)[1:] for p in range(parts)]
    code = ["".join(f"{found[p][0][i]:02x}" for p in range(parts)) for i in range(len(x))]
    error = np.sum([f[1] for f in found], 0)
    sums = collections.Counter()
    for r, e in zip(rows, error.tolist()):
        sums[r[1]] += e
    told = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return collections.Counter((r[0], c, e, sums[r[1]], told) for r, c, e in zip(rows, code, error.tolist()))


@pytest.mark.parametrize("n, d, scale", [(900, 32, 1.0), (900, 16, 0.02), (40, 64, 1.0), (1, 16, 5.0)])
def test_codes_equal_brute_force(spark, n, d, scale):
    rng = np.random.default_rng(3)
    mean = rng.standard_normal(d)
    rows = [(int(i), [None, "a", "hot", "hot"][i % 4], [float(v) for v in scale * (mean + rng.standard_normal(d))]) for i in rng.permutation(n)]
    for k in range(0, n - 1, 5):
        rows[k] = (*rows[k][:2], rows[k + 1][2])  # equal vectors: ties everywhere
    bad = [(n + 1, "a", None), (n + 2, "a", [None] * d), (n + 3, "a", [math.nan] * d), (n + 4, "a", [math.inf] + [0.0] * (d - 1)), (n + 5, "a", []), (n + 6, "a", [0.0] * (d + 1))]
    df = spark.createDataFrame(rows + bad, "vec_id long, label string, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "d", "x", "own", "v", "error")})
    found = yinyang.compress(df).select("id", "code", "error", "label_error", "codebooks_sha256")
    want = _plain_codes([(i, g, [math.floor(256 * x) for x in v]) for i, g, v in sorted(rows, key=lambda r: r[0])])
    assert collections.Counter(map(tuple, found.collect())) == want
    assert yinyang.compress(df.limit(0)).count() == 0


def test_lengths_have_codebooks_of_their_own(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "a", [float(v) for v in rng.standard_normal(16 if i % 2 else 32)]) for i in range(300)]
    found = yinyang.compress(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert len(found) == 300
    for odd in (0, 1):
        own = [(i, None, [math.floor(256 * x) for x in v]) for i, _, v in rows if i % 2 == odd]
        want = {(k[0], k[1], k[2], k[4]) for k in _plain_codes(own)}
        assert {(r.id, r.code, r.error, r.codebooks_sha256) for r in found if r.id % 2 == odd} == want


def test_bounds_pass_groups_over():
    """In later rounds most groups are never scanned, and what is skipped changes no assignment."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-2000, 2000, (64, 4))
    x = centres[rng.integers(0, 64, 4000)] + rng.integers(-30, 30, (4000, 4))
    group = yinyang.grouped(centres, 8)
    own, _, bounds = yinyang.assign(x, centres, group)
    moved = centres + rng.integers(-8, 9, centres.shape)
    drift, scanned = np.sqrt(((moved - centres) ** 2).sum(1)) * (1 + 1e-12), []
    again, squared, _ = yinyang.assign(x, moved, group, own, bounds, drift, lambda g, rows, members: scanned.append(rows * members))
    plain = ((x[:, None] - moved[None]) ** 2).sum(2)
    assert (again == plain.argmin(1)).all() and (squared == plain.min(1)).all()
    assert sum(scanned) < 0.2 * len(x) * 64
