"""Corpus operators against brute force, round trips and held-out rows, on small fixtures with awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodesift.llm import bpe, itq, kdtree, language, mixing, quality, quotes, simhash, simhash_wide, toxicity, training_order

WORDS = [a + b for a in "ba de fi go lu".split() for b in "na ro st ti ve".split()]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, fp long"


def _text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def _docs():
    """Texts with copies, near copies, nulls, empty and long ones, repeated rows, and columns with clashing names."""
    rng = random.Random(3)
    texts = [_text(rng, rng.randrange(1, 120)) for _ in range(60)]
    texts += texts[:15] + [t + " extra" for t in texts[:20]] + [None, "", "   \n\t", "one", _text(rng, 3000), "Ünïcödé 文字 🙂 #*$"]
    rows = [(i, t, ("en", "fr", None)[i % 3], "hot" if i % 3 else (None, "b", "c")[i % 9 // 3], 0, 1, "x", 2) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "lost row", "en", "b", 0, 1, "x", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def _components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def _print64(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("limit", [32_768, 3])
def test_simhash_groups(docs, none, limit):
    rows = _docs()
    prints = [_print64(r[1]) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    top = _components(range(len(rows)), linked)
    ids = collections.defaultdict(list)
    for i, t in top.items():
        ids[t].append(rows[i][0])
    want = collections.Counter((rows[i][0], prints[i], min((x for x in ids[t] if x is not None), default=None)) for i, t in top.items())
    found = simhash.groups(simhash.fingerprints(docs), limit=limit).collect()
    assert collections.Counter((r.id, r.fp & (1 << 64) - 1, r.component) for r in found) == want
    assert simhash.groups(simhash.fingerprints(none)).count() == 0


@pytest.mark.parametrize("limit", [32_768, 4])
def test_wide_simhash_keeps_one_of_each_group(spark, none, limit, monkeypatch):
    monkeypatch.setattr(simhash_wide, "_BLOCK", limit)
    rng = random.Random(5)
    base = [_text(rng, 200) for _ in range(30)]
    near = [" ".join(w if i != 50 else "changed" for i, w in enumerate(t.split())) for t in base]
    rows = [(i, t) for i, t in enumerate(base + near + base + [None, "", base[0]])]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_wide.keep_one(df).collect()) == [*range(30), 90]
    assert simhash_wide.keep_one(none).count() == 0


def test_mixing(docs, none):
    rows = {(r.id, r.source): r for r in mixing.mix(docs).collect()}
    by = collections.defaultdict(list)
    for r in mixing.mix(docs).collect():
        assert rows[r.id, r.source].taken == r.taken and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        by[r.source].append(r)
    sizes = {s: sum(x.size for x in g) for s, g in by.items()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, rest, target = float(sum(sizes.values())), set(names), {}
    while over := {s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 3 * sizes[s]}:
        for s in over:
            target[s] = 3.0 * sizes[s]
        left, rest = left - sum(target[s] for s in over), rest - over
    target |= {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
    for s, g in by.items():
        assert math.isclose(g[0].target, target[s], rel_tol=1e-9) and g[0].source_size == sizes[s]
        assert abs(sum(x.taken for x in g) - target[s]) <= max(x.size for x in g)
    total = sum(r.repeats for r in mixing.mix(docs).collect())
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and again.count() == total
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1000])
def test_permutation_is_a_bijection(spark, n):
    slots = [r[0] for r in spark.range(n).select(training_order.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(slots) == list(range(n)) and (n < 100 or slots != sorted(slots))


def test_shards_hold_every_token_in_order(spark, docs, none, tmp_path):
    found = training_order.materialise(docs, str(tmp_path / "a"), length=64, slots=8).orderBy("slot").collect()
    assert [r.slot for r in found] == list(range(len(found))) and all(r.byte_offset == r.slot % 8 * 130 for r in found)
    tokens = {}
    for f in tmp_path.glob("a/shards/shard=*/*.txt"):
        shard = int(f.parent.name.split("=")[1])
        for i, row in enumerate(training_order.read(f.read_bytes(), 64)):
            tokens[shard * 8 + i] = row
    assert all(zlib.crc32(tokens[r.slot].tobytes()) == r.crc for r in found)
    assert np.array_equal(training_order.read((tmp_path / "a").joinpath("shards", "shard=0").glob("*.txt").__next__().read_bytes(), 64, 2)[0], tokens[2])
    packed = spark.read.parquet(str(tmp_path / "a/packed")).collect()
    texts = "".join(bpe.codec(bpe.default_path()).decode(np.concatenate([np.frombuffer(r.tokens, "<u2")[: r.n_tokens] for r in sorted(packed, key=lambda r: (r.part, r.no)) if r.part == p]).tolist()) for p in sorted({r.part for r in packed}))
    assert collections.Counter(texts.split("<|endoftext|>")[:-1]) == collections.Counter((r[1] or "") for r in _docs())
    assert training_order.materialise(none, str(tmp_path / "b")).count() == 0


def test_toxicity_on_held_out_rows(spark, none):
    rng, rows, labels = random.Random(1), [], []
    for i in range(600):
        rude, mean = rng.random() < 0.3, rng.random() < 0.2
        rows.append((i, _text(rng, 40) + (" Grumph!" if rude else "") + (" zorkish" if mean else "")))
        labels.append((i, int(rude), int(rude or mean)))
    docs = spark.createDataFrame([*rows, (None, "x"), (700, None), rows[0]], "doc_id long, text string")
    truth = spark.createDataFrame([*labels[:400], (None, 1, 1), (900, None, None)], "doc_id long, rude int, toxic int")
    categories = {"rude": "rude = 1", "toxic": "toxic = 1"}
    model = toxicity.fit(docs, truth, categories)
    found = {r.id: r for r in toxicity.predict(docs, model).collect()}
    assert len(found) == 602
    assert np.mean([(found[i].is_rude, found[i].is_toxic) == (bool(a), bool(b)) for i, a, b in labels[400:]]) > 0.99
    empty = toxicity.fit(none.select("doc_id", "text"), truth.limit(0), categories)
    assert toxicity.predict(none, empty).count() == 0 and not any(r.is_toxic for r in toxicity.predict(docs.where("text is null"), empty).collect())


def test_out_of_fold_probabilities_know_nothing_of_their_fold():
    rng = np.random.default_rng(5)
    places = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(90)]
    x = toxicity.Sparse(np.concatenate([[0], np.cumsum([len(p) for p in places])]), np.concatenate(places), 12)
    dense = np.zeros((90, 12))
    for i, p in enumerate(places):
        dense[i, p] = 1
    assert np.allclose(x.times(np.arange(12.0)), dense @ np.arange(12.0)) and np.allclose(x.back(np.arange(90.0)), dense.T @ np.arange(90.0))
    assert np.allclose(x.rows(np.arange(90) % 3 == 0).times(np.ones(12)), dense[::3].sum(1))
    first = (dense[:, 0] + 0.3 * rng.standard_normal(90) > 0.5).astype(float)
    labels, fold = np.stack([first, np.maximum(first, dense[:, 3])], 1), np.arange(90) % 5
    weights, held = toxicity.chain(x, labels, fold)
    for f in range(5):  # other labels in a fold change nothing that is said of it; a dense model without the fold says the same
        other = labels.copy()
        other[fold == f] = 1 - other[fold == f]
        assert np.allclose(toxicity.chain(x, other, fold)[1][fold == f, 0], held[fold == f, 0])
        w, z = np.zeros(13), np.hstack([np.ones((90, 1)), dense])
        for _ in range(4000):
            r = 1 / (1 + np.exp(-z[fold != f] @ w)) - labels[fold != f, 0]
            w -= 0.01 * (z[fold != f].T @ r + np.concatenate([[0], w[1:]]))
        assert np.allclose(1 / (1 + np.exp(-z[fold == f] @ w)), held[fold == f, 0], atol=0.01)
    assert len(weights[0]) == 13 and len(weights[1]) == 14


def test_toxicity_sees_rare_words(spark):
    """Two hundred toxic words, each in four rows only: no bound on words hides any of them."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(4000):
        bad = i % 5 == 0
        rows.append((i, _text(rng, 30) + (f" vile{'abcdefghij'[i // 5 % 10]}{'abcdefghij'[i // 50 % 10]}{'ab'[i // 500 % 2]}" if bad else "")))
        labels.append((i, int(bad)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, truth, {"toxic": "toxic = 1"})
    assert sum(w.startswith("vile") for w in model.words) == 200
    found = {r.id: r.is_toxic for r in toxicity.predict(docs, model).collect()}
    assert np.mean([found[i] == bool(t) for i, t in labels]) > 0.99


def test_bpe_equals_the_library(docs, none):
    codec, rng = bpe.codec(bpe.default_path()), random.Random(2)
    pools = ["ab'stlrevmd ,.\n\t\r\v\f -_1239%$#", "' s t\n \t", "aé日本 　\xa0\x85'sre\n1²à ", "\x1c\x1d\x1f\x00\x7f \nab'"]
    for _ in range(4000):
        p = rng.choice(pools)
        x = "".join(rng.choice(p) if rng.random() < 0.97 else rng.choice(["<|endoftext|>", chr(rng.randrange(32, 0x2FFF))]) for _ in range(rng.randrange(24)))
        want = codec.model.encode(x, add_special_tokens=False).ids
        assert codec.encode(x).tolist() == want and codec.decode(want) == codec.model.decode(want, skip_special_tokens=False)
    long = "x" * 30_000 + "é" * 9000 + " word" * 5000
    assert codec.encode(long).tolist() == codec.model.encode(long, add_special_tokens=False).ids
    coded = bpe.decode(bpe.encode(docs))
    assert coded.columns[: len(docs.columns)] == docs.columns
    assert all((r.text or "") == r.decoded for r in coded.collect())
    assert bpe.digests(docs).where("n_tokens = 0").count() == 2 and bpe.digests(none).count() == 0


@pytest.mark.parametrize("block", [2048, 5])
def test_itq_links(spark, block):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(np.vstack([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), np.repeat(base[:1], 9, 0), base[3] + 0.03 * rng.standard_normal((15, 16))]))]
    rows = [(i, v, 0 if i >= 60 else lab) for i, v, lab in rows]
    odd = [(200, None, 1), (201, [0.0] * 16, 1), (202, [None] + [1.0] * 15, 1), (203, [float("nan")] * 16, 1), (204, rows[0][1], None), (205, [1.0, 2.0], 1), (206, [], 1)]
    found = {r.id: r for r in itq.near(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), block=block).collect()}
    assert len(found) == len(rows) + len(odd)
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] == rows[j][2] and x[i] @ x[j] >= 0.98]
    count = collections.Counter(k for pair in near for k in pair)
    top = _components(range(len(rows)), near)
    assert {i: (found[i].n_links, found[i].component, found[i].kept) for i in top} == {i: (count[i], t, i == t) for i, t in top.items()}
    assert all((found[r[0]].n_links, found[r[0]].component, found[r[0]].kept) == (0, r[0], True) for r in odd)
    assert itq.near(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_language_fuses_evidence(spark, none):
    rng = random.Random(6)
    parts = {"aa": "kra mok tul", "bb": "sil fen wey"}
    say = lambda lang, n: " ".join("".join(rng.choices(parts[lang].split(), k=2)) for _ in range(n))
    rows = [(i, say(("aa", "bb")[i % 2], 30), ("aa", "bb")[i % 2], f"https://h{i % 2}.example.{('aa', 'bb')[i % 2]}/p") for i in range(200)]
    odd = [(900, None, "aa", None), (901, "", None, "https://h0.example.aa/"), (902, "%%%% #### &&&& **** $$$$ ||||", "aa", "h0"), (903, say("aa", 30), "bb", rows[1][3]), (904, say("bb", 30), None, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, url string")
    model = language.fit(df.where("doc_id < 900"))  # the odd rows are new to the model
    found = {r.doc_id: r for r in language.identify(df, model, "text", "lang", "url").collect()}
    assert all(found[i].language == lang and found[i].kept for i, _, lang, _ in rows)
    assert [found[i].language for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "bb"] and not found[900].kept
    assert language.identify(none, language.fit(none)).count() == 0
    assert language.identify(df, language.fit(none), "text", "lang", "url").where("kept").count() == 0


def _measure(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if at[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, docs, none):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("ab", k=rng.randrange(40))) for _ in range(60)] + ["a b c d e f g h\n" * 3, "x\x0b y\x1c z w", "a b c d e f g h i a b c d e f g h"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df, given in ((rows, list(enumerate(texts))), (docs, [(r[0], r[1]) for r in _docs()])):
        found = quality.ledger(df).collect()
        got = collections.Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
        assert got == collections.Counter((i, *_measure(t)) for i, t in given)
        assert all((r.failed & 1 == 1) == (r.n_words < 20) and (r.failed & 2 == 2) == (100 * r.n_repeat_words > 30 * r.n_words) for r in found)
        kept = quality.kept(df, quality.POLICIES[1])
        assert kept.columns == df.columns and kept.count() == sum(r.failed == 0 for r in found)
        for a in quality.ablation(quality.ledger(df)).where("version = 'v2'").collect():
            bit = 1 << [n for n, _ in quality.RULES].index(a.rule)
            assert (a.n_failed, a.n_only) == (sum(r.failed & bit > 0 for r in found), sum(r.failed == bit for r in found))
    assert quality.ledger(none).count() == 0 and quality.ablation(quality.ledger(none)).count() == 0


def test_kd_tree_shards(docs, none):
    rows = kdtree.shard(docs, shards=4).collect()
    assert len(rows) == len(_docs())
    total, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    largest = max(r.size for r in rows)
    assert max(total.values()) - min(total.values()) <= 2 * largest and set(total) <= set(range(4))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kdtree.shard(none).count() == 0
    assert max(r.shard for r in kdtree.shard(docs, None, target_bytes=sum(total.values()) // 3).collect()) >= 2


def test_quotation_linking(spark):
    messages = [
        (1, 0, "user", "Shall we meet on Monday?\n\nBring the plans."), (1, 1, "assistant", "Unrelated note."), (1, 2, "user", "On Monday Ann wrote:\n> shall we  MEET on Monday?\nYes."),
        (1, 3, "assistant", "> > Shall we meet on Monday?\n> Yes.\nGood."), (1, 4, "user", "> never said\nHm"), (2, 0, "user", "> Yes.\nother conversation"), (2, 1, None, None), (None, 0, "user", "> Yes."), (1, None, "user", "> Yes."), (1, 1, "assistant", "Unrelated note."),
    ]
    rows = quotes.linked(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()
    assert len(rows) == len(messages)
    one = sorted((r for r in rows if r.conv == 1), key=lambda r: r.position)
    assert [r.turn for r in one] == [0, 2, 3, 1, 1, 4, None] and [r.position for r in one] == list(range(7))
    by = {(r.conv, r.turn): r for r in rows}
    assert [by[1, t].reply_turn for t in range(5)] == [None, None, 0, 2, None] and by[1, 3].root_turn == 0
    assert by[1, 2].body == "Yes." and by[1, 3].body == "Good." and by[2, 0].reply_turn is None and by[2, 1].body == ""
    assert quotes.chat(quotes.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_itq_sample_is_bounded(spark):
    rows = spark.range(3000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("key"), F.array(F.col("id").cast("double")).alias("v"))
    assert 800 <= len(itq._sampled(rows, 1000)) <= 1000 and len(itq._sampled(rows, 3000)) == 3000
    assert itq._sampled(rows, 1000).tolist() == itq._sampled(rows.repartition(7), 1000).tolist()


def _varied(rng, words, drop):
    """`words` with that many of them replaced by new ones, evenly spread."""
    at = {int((i + 0.5) * len(words) / drop) for i in range(drop)} if drop else set()
    return [f"n{rng.randrange(10**9)}" if i in at else w for i, w in enumerate(words)]


def _shingles(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_equal_brute_force(spark):
    """Pairs on both sides of 0.8, templates at 0.5 to 0.79 and a chain: what stays is what exact components leave."""
    rng, texts = random.Random(11), []
    for k in range(60):  # one base and its copies from 0.6 to 0.95
        base = [f"w{k}x{i}" for i in range(rng.randrange(60, 400))]
        texts += [" ".join(base), *(" ".join(_varied(rng, base, rng.randrange(0, max(2, len(base) // 25)))) for _ in range(3))]
    for share in (0.667, 0.75, 0.824, 0.87):  # passages that forty texts share
        passage = [f"p{share}x{i}" for i in range(int(300 * share))]
        texts += [" ".join(passage + [f"o{rng.randrange(10**9)}" for _ in range(300 - len(passage))]) for _ in range(40)]
    base = [f"c{i}" for i in range(300)]
    texts += [" ".join(base[8 * i : 8 * i + 160]) for i in range(12)] + [" ".join(_varied(rng, base, 7)) for _ in range(40)]
    sets = [_shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = sorted(set(_components(range(len(sets)), near).values()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash_wide.keep_one(df).collect()) == want and 200 < len(want) < len(texts)


def test_rare_languages_have_models(spark):
    """Three rows among two thousand: the list of languages isn't that of a sample, and no language takes another's share."""
    rng = random.Random(9)
    say = lambda parts, n: " ".join("".join(rng.choices(parts.split(), k=2)) for _ in range(n))
    rows = [(i, say("kra mok tul", 20), "aa") for i in range(2000)] + [(2000 + i, say("sil fen wey", 20), "zz") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, table = language.fit(df, sample_rows=50)
    assert names == ("aa", "zz") and table.shape == (language.GRAMS, 2)
    found = {r.doc_id: r.language for r in language.identify(df, (names, table), address_col=None).collect()}
    assert all(found[i] == lang for i, _, lang in rows)


def _quoted_replies(messages):
    """reply_turn of each (turn, text) of one conversation, by comparing every passage with every earlier body."""
    flat = lambda x: " ".join(x.lower().split())

    def parts(text):
        paragraphs, lines = re.split(r"\n[ \t]*\n", text), text.split("\n")
        sentences = [s for x in paragraphs + lines for s in re.split(r"(?<=[.!?])\s+", flat(x))]
        return [{flat(x) for x in p} - {""} for p in ([text], paragraphs, lines, sentences)]

    bodies, out = {}, {}
    for turn, text in messages:
        runs, own = [], []
        for line in text.split("\n"):
            marks = re.match(r"(?:[ \t]*>)*", line).group()
            level, rest = marks.count(">"), re.sub(r"^ ", "", line[len(marks) :]) if ">" in marks else line
            if not level:
                own.append(rest)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(rest)
            else:
                runs.append((level, [rest]))
        hits = []
        for level, lines in runs:
            if level:
                for want in parts("\n".join(lines)):
                    at = [t for t, said in bodies.items() if any(want & p for p in said)]
                    if at:
                        hits.append((-level, max(at)))
                        break
        out[turn] = max(hits)[1] if hits else None
        bodies[turn] = parts("\n".join(own).strip())
    return out


def test_partial_and_rewrapped_quotes_equal_brute_force(spark):
    rng, rows, want = random.Random(12), [], {}
    wrap = lambda text, n: [" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n)]
    for conv in range(25):
        said, messages = [], []
        for turn in range(12):
            own = [" ".join(_text(rng, rng.randrange(4, 9)).capitalize() + "." for _ in range(3)) for _ in range(3)]
            lines = []
            if said and rng.random() < 0.8:
                old = rng.choice(said)
                kind = rng.randrange(4)
                if kind == 0:  # two of three paragraphs, rewrapped
                    lines = [*wrap(old[0], 7), "", *wrap(old[1], 7)]
                elif kind == 1:  # a sentence out of a longer line
                    lines = [re.split(r"(?<=[.])\s+", old[2])[1]]
                elif kind == 2:  # whole, with a nested quote of another
                    lines = ["> " + x for x in wrap(rng.choice(said)[1], 5)] + ["\n\n".join(old)]
                else:
                    lines = ["never said at all"]
                lines = [f"> {x}" for x in "\n".join(lines).split("\n")]
            said.append(own)
            messages.append((turn, "\n".join([*lines, "\n\n".join(own)])))
        rows += [(conv, turn, "user", text) for turn, text in messages]
        want |= {(conv, turn): r for turn, r in _quoted_replies(messages).items()}
    found = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv, r.turn): r.reply_turn for r in found} == want and sum(r is not None for r in want.values()) > 100


ODD = "doc_id long, text string, lang string, source string, _host string, _nh int, _text string, _lik double, _vote string, language string, Kept string, ids_ map<string,int>, _a string, _b int, row string, x map<int,array<int>>, y double, `a b` int, repeats int, s string, size int, h string, _m int, _source int"


def _odd():
    rng = random.Random(13)
    parts = {"aa": "kra mok tul", "bb": "sil fen wey"}
    say = lambda lang: " ".join("".join(rng.choices(parts[lang].split(), k=3)) for _ in range(40))
    texts = [say(("aa", "bb")[i % 2]) for i in range(40)]
    rest = ("zz", 7, "other", 0.5, "zz", "zz", "no", {"k": 1}, "z", 1, "r", {1: [2]}, float("nan"), 3, 9, "s", 8, "h", 4, 5)
    rows = [(i, t, ("aa", "bb")[i % 2], f"s{i % 3}", *rest) for i, t in enumerate([*texts, texts[0], texts[1] + " more"])]
    return [*rows, rows[5], rows[5], (None, None, None, None, *rest), (98, "", "aa", None, *rest), (99, " \n ", None, "s1", *rest), (100, ("kramok tulkra " * 700_000).strip(), "aa", "s1", *rest)]


def test_stages_carry_columns_of_any_name_and_type(spark):
    """No value of a user's column changes, whatever its name, and nothing crashes on nulls, repeated rows, maps and a text of 9 MB."""
    import corpus_pipeline

    rows = _odd()
    df = spark.createDataFrame(rows, ODD)
    same = lambda r: repr((r.doc_id, hash(r.text), *tuple(r)[2:]))
    before = collections.Counter(map(same, df.collect()))
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name, stage in list(stages.items())[:4]:
        out = stage(spark, df, "")
        assert out.columns == df.columns and [f.dataType for f in out.schema.fields] == [f.dataType for f in df.schema.fields]
        found = collections.Counter(map(same, out.collect()))
        assert set(found) <= set(before) and (name.startswith("mixing") or not found - before)
        kept[name] = found
        assert stage(spark, df.limit(0), "").count() == 0
    # Languages are told, texts without one go, the long text stays; repeated rows stay as many as they are.
    assert sum(kept["language ID"].values()) == 45
    ids = [eval(k.replace("nan", "0"))[0] for k in kept["SimHash near-dedup"].elements()]
    assert sorted(i for i in ids if i is not None) == [i for i in range(40)] + [100] and ids.count(None) == 1
    coded = bpe.recode(df.withColumn("IDS", F.lit(1)).where("doc_id < 100"))
    assert [c for c in coded.columns if c.lower() == "ids"] == ["ids"] and "Kept" in coded.columns
    assert all((r.text or "") == r.decoded for r in coded.collect())


def test_ledger_equals_its_sql(spark):
    import duckdb

    from lodesift.llm import queries

    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name in ("op8_quality_ledger", "quality_ablation"):
        sql = queries.SQL[name]
        df = queries.QUERIES[name](spark, folder)
        theirs = duckdb.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(theirs) and theirs
