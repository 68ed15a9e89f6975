"""Listings, batches, ranges, reservations, versions, bodies and addresses against plain versions."""

import collections
import ipaddress
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodesift.functions import bodies
from lodesift.functions.fitting import fitted
from lodesift.operators import packing, ranking, search
from lodesift.operators.reservations import reservations
from lodesift.operators.rollups import streaks
from lodesift.plans import retrieval
from lodesift.sources import listing, states


# Best documents


@pytest.mark.parametrize("most, probe", [(1, 1), (3, 2), (10, 4), (500, 4)])
def test_best_documents_equal_all_pairs(spark, most, probe):
    rng = random.Random(most)
    words = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, say(rng.randrange(30))) for i in range(200)] + [(900, None), (901, "")]
    docs += [(1000 + i, docs[5][1]) for i in range(20)]  # ties
    questions = [(i, say(rng.randrange(1, 14))) for i in range(25)] + [(50, "unheard of"), (51, ""), (52, None), (53, docs[7][1])]
    found = search.best_documents(spark.createDataFrame(questions, "question_id long, question string"), spark.createDataFrame(docs, "id long, text string"), most, probe).collect()
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r.place):
        got[r.question_id].append((r.id, round(r.usable_evidence, 9)))
    for q, text in questions:
        w = set((text or "").split())
        every = [(i, len(w & set((t or "").split())) / len(w)) for i, t in docs if w]
        want = sorted(((i, round(s, 9)) for i, s in every if s), key=lambda x: (-x[1], x[0]))[:most]
        assert got[q] == want


def test_common_words_make_no_pairs(spark):
    """Every document holds `the`; each question has a document that holds all of it, so only rare words are looked up."""
    docs = [(i, f"the of and in r{i} s{i} t{i % 50}") for i in range(400)]
    questions = [(i, f"the of and in r{i} s{i}") for i in range(20)]
    q, d = spark.createDataFrame(questions, "question_id long, question string"), spark.createDataFrame(docs, "id long, text string")
    assert [r.id for r in search.best_documents(q, d, 1, 1).orderBy("question_id").collect()] == list(range(20))


# Ranks and streaks


def test_ranks_of_several_criteria_at_once(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i % 50, rng.choice([None, 1.0, 2.0, 2.0, 5.5, -3.0, float("inf")]), rng.choice([None, None, 4, 7])) for i in range(600)]
    found = ranking.positions(spark.createDataFrame(rows, "question_id string, id long, x double, y int"), ("x", "y")).collect()

    def rank(values, v):
        known = [k for k in values if k is not None]
        return len(known) // 2 + 1 if v is None else 1 + sum(k > v for k in known)

    want = collections.Counter()
    for q, i, x, y in rows:
        own = [r for r in rows if r[0] == q]
        want[q, i, x, y, rank([r[2] for r in own], x), rank([r[3] for r in own], y)] += 1
    assert collections.Counter(map(tuple, found)) == want


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_streaks_over_pieces(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), i, rng.random() < 0.7) for i in range(400)] + [("c", i, True) for i in range(30)]
    found = {(r.k, r.i): r.streak for r in streaks(spark.createDataFrame(rows, "k string, i long, f boolean"), "k", ("i",), F.col("f"), F.floor(F.col("i") / width)).collect()}
    now = collections.Counter()
    for k, i, f in rows:
        now[k] = now[k] + 1 if f else 0
        assert found[k, i] == now[k]


# Batches


@pytest.mark.parametrize("piece, group", [(8, 2), (20, 3), (256, 256)])
def test_packing_of_one_key(spark, monkeypatch, piece, group):
    monkeypatch.setattr(packing, "GROUP", group)
    rng = random.Random(piece)
    rows = [("hot" if i % 3 else rng.choice(["b", None]), i, rng.choice([10, 500, 3_000, 20_000, 50_000, 43_300, None])) for i in range(1_500)]
    df = spark.createDataFrame([r for r in rows if r[2] is not None], "k string, o long, z int")
    found = {(r.k, r.o): r.batch for r in packing.packed(df, "k", "o", "z", 700, piece=piece).collect()}
    open_: dict = {}
    for k, o, z in rows:
        if z is None:
            continue
        batch, n, total = open_.get(k, (-1, 0, 700))
        if batch < 0 or n >= 8 or total + z > 44_000:
            batch, n, total = batch + 1, 0, 700
        open_[k] = batch, n + 1, total + z
        assert found[k, o] == batch
    assert len(found) == df.count() and packing.packed(df.limit(0), "k", "o", "z", 700).count() == 0


# Ranges


def _fitted(title, text, limit, smallest):
    raw = text.encode()
    size = lambda s, e: len(json.dumps({"title": title, "text": raw[s:e].decode()}, ensure_ascii=False, separators=(",", ":")).encode())
    pending, out = [(0, len(raw))], []
    while pending:
        s, e = pending.pop()
        m = s + (e - s) // 2
        while m < e and raw[m] & 0xC0 == 0x80:
            m += 1
        if size(s, e) <= limit or e - s < 2 * smallest or m >= e:
            out.append((s, e))
        else:
            pending += [(m, e), (s, m)]
    return out


@pytest.mark.parametrize("limit, smallest", [(200, 16), (3_000, 64), (60, 1)])
def test_ranges_fit_as_json(spark, limit, smallest):
    rng = random.Random(limit)
    pools = ["abc ", '"\\\n\t', "\x01\x02\x7f é", "文字🙂", 'a"é🙂\x1f\r\x08\x0c\x0b']
    rows = [(i, rng.choice(["", "A title", 'T"\\\x01', "文"]), "".join(rng.choices(rng.choice(pools), k=rng.choice([0, 1, 30, 700, 3_000])))) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, None, None)], "i long, title string, text string")
    found = {r.i: r.r for r in df.select("i", fitted(F.col("title"), F.col("text"), limit, smallest).alias("r")).collect()}
    assert found[99] is None
    for i, title, text in rows:
        assert [tuple(x) for x in found[i]] == _fitted(title, text, limit, smallest)


# Reservations


def _ledger(rows, budget, stop_after):
    """Plain fold of one key's rows (kind, reserved, cost)."""
    held = dict(open=0, settled=0, retained=0, in_flight=0)
    out, row, state = [], 0, "open"
    for kind, reserved, cost in rows:
        held["open"] += reserved if kind == "reserve" else -reserved
        held["in_flight"] += 1 if kind == "reserve" else -1
        held["settled"] += cost if kind == "settle" else 0
        held["retained"] += reserved if kind == "retain" else 0
        row = row + 1 if kind == "retain" else 0 if kind == "settle" else row
        total = held["open"] + held["settled"] + held["retained"]
        if state == "open":
            over = total > budget
            why = "refused" if over and kind == "reserve" else "overspent" if over and kind == "settle" else "unresolved" if kind == "retain" and row >= stop_after else None
            out.append((*held.values(), total, why or "open"))
            state = "stopped" if why else "open"
        else:
            out.append((*held.values(), total, "stopped"))
    return out


@pytest.mark.parametrize("budget, stop_after", [(50, 3), (400, 3), (100_000, 2), (100_000, 99)])
def test_reservations_equal_a_fold(spark, budget, stop_after):
    rng, rows, place = random.Random(budget), [], 0
    for key in ("a", "b", None):
        waiting = []
        for _ in range(120):
            if waiting and rng.random() < 0.5:
                amount = waiting.pop(rng.randrange(len(waiting)))
                rows.append((key, place, rng.choice(["settle", "settle", "release", "retain"]), amount, rng.choice([0, amount, amount // 2, 3 * amount])))
            else:
                waiting.append(rng.randrange(1, 30))
                rows.append((key, place, "reserve", waiting[-1], None))
            place += 1
    df = spark.createDataFrame(rows, "k string, i long, kind string, reserved long, cost long")
    found = reservations(df, "k", ("i",), "kind", "reserved", "cost", budget, stop_after, F.floor(F.col("i") / 16)).orderBy("i").collect()
    for key in ("a", "b", None):
        got = [(r.open, r.settled, r.retained, r.in_flight, r.accounted, r.state) for r in found if r.k == key]
        assert got == _ledger([r[2:] for r in rows if r[0] == key], budget, stop_after)


# Listings


def test_listing_source_prunes_pages_and_follows_the_rules(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = [(name, i, f"id{i % 30}" if name == "loops" else None if name == "no ids" else f"{name}/{i}", {"n": i}) for name in ("counted", "loops", "no ids", "ü b/c=d%") for i in range(95)]
    df = spark.createDataFrame(rows, "listing string, i long, id string, more map<string,int>")
    listing.record(df, path, "listing", F.col("i"), "id", 20, F.when(F.col("listing") == "counted", 41))
    every = listing.listings(spark, path)
    assert every.count() == len(rows) and {r.listing for r in every.select("listing").distinct().collect()} == {r[0] for r in rows}
    first = every.where("listing = 'counted'").orderBy("offset", "place").first()
    assert (first.matched, first.n_rows, first.id) == (41, 20, "counted/0") and json.loads(first.row)["more"] == {"n": 0}
    found = collections.Counter((r.listing, r.page) for r in listing.followed(every, 4).collect())
    assert found == {("counted", 0): 20, ("counted", 1): 20, ("counted", 2): 20, ("loops", 0): 20, ("loops", 1): 10, **{(n, p): 20 for n in ("no ids", "ü b/c=d%") for p in range(4)}}
    # A broken page of another listing or offset is not opened where filters leave it out.
    broken = tmp_path / "pages" / "listing=loops" / "offset=40"
    (broken / "part-0.json").write_text("{no json")
    assert every.where("listing IN ('counted', 'no ids') AND offset < 40").count() == 80
    assert every.where("listing = 'loops' AND offset <= 20").count() == 40
    with pytest.raises(Exception, match="JSON|json|Expecting"):
        every.where("listing = 'loops'").count()
    assert listing.listings(spark, path).where("listing = 'none such'").count() == 0


def test_folders_of_several_pages_read_as_single_ones(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(name, i, f"id{i % 50}") for name in ("a", "ü b/c=d%") for i in range(95)], "listing string, i long, id string")
    for each in (1, 3):
        listing.record(df, str(tmp_path / str(each)), "listing", F.col("i"), "id", 20, F.when(F.col("listing") == "a", 41), each)
    folders = lambda top: collections.Counter(p.parent.name for p in top.glob("listing=*/offset=*"))
    assert {*folders(tmp_path / "1").values()} == {5} and {*folders(tmp_path / "3").values()} == {2}
    told = lambda each, only: sorted(map(tuple, listing.listings(spark, str(tmp_path / str(each))).where(only).collect()))
    for only, n in {"true": 190, "offset < 60": 120, "offset <= 60": 160, "offset > 40 and offset < 80": 40, "offset >= 20": 150, "offset = 80": 30, "offset = 70": 0, "offset in (0, 40, 7)": 80, "listing = 'a' and offset < 20": 20}.items():
        assert told(1, only) == told(3, only) and len(told(3, only)) == n, only
    follow = lambda each: sorted(map(tuple, listing.followed(listing.listings(spark, str(tmp_path / str(each))), 4).collect()))
    assert follow(1) == follow(3) and follow(3)
    # A folder that no filter wants is not opened; a reply that is not of its folder is an error and is not left out.
    (tmp_path / "3" / "listing=a" / "offset=60-119" / "part-0.json").write_text('{"meta": {"offset": 40}, "rows": []}')
    assert len(told(3, "listing = 'a' and offset < 60")) == 60
    with pytest.raises(Exception, match="not of its folder"):
        told(3, "listing = 'a'")
    # The query's folders don't grow with its pages.
    monkeypatch.setattr(retrieval, "scratch", lambda spark, name: str(tmp_path / name))
    assert retrieval.recorded_listings(spark, "/root/testdata/sf0.001").count() > 0
    assert {*folders(tmp_path / "listings").values()} == {1}


# Versions


def test_versions_of_sessions(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda xs: spark.createDataFrame(xs, "s string, id long, v int")
    states.save(rows([("a", 1, 10), ("a", 2, 20), ("b", 1, 10), ("c d/é", 3, 1)]), path, "s", 1)
    files = lambda s: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet") if f"s={s}" in str(p)}
    before = files("b")
    more = rows([("a", 2, 99), ("a", 5, 50)])
    for _ in range(2):  # tried again: one version
        states.save(states.continued(states.load(spark, path, "s", upto=1).drop("call"), more, "s", "id"), path, "s", 2)
    told = lambda **k: sorted((r.s, r.id, r.v) for r in states.load(spark, path, "s", **k).collect())
    assert told() == [("a", 1, 10), ("a", 2, 99), ("a", 5, 50), ("b", 1, 10), ("c d/é", 3, 1)] == told(upto=7)
    assert told(upto=1) == [("a", 1, 10), ("a", 2, 20), ("b", 1, 10), ("c d/é", 3, 1)] and told(upto=0) == []
    assert files("b") == before and before


def test_inventory_reads_names_and_sizes(spark):
    folder = "/root/testdata/sf0.001"
    found = {os.path.basename(r.path): r.bytes for r in states.inventory(spark, folder).collect()}
    assert found == {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder)}


# Bodies, addresses, redaction


def test_bodies_by_content_type(spark):
    page = "<!DOCTYPE html><html><body><article><p>Hello there</p></article></body></html>"
    rows = [
        (1, "text/html; charset=utf-8", page.encode(), False, "html", None, "Hello there"), (2, "TEXT/HTML", b"<html><body></body></html>", False, "html", "empty", None),
        (3, "text/markdown", b"# A\n\ntext\n", False, "markdown", None, "# A\n\ntext"), (4, "text/plain", b" \n a b \n", False, "text", None, "a b"),
        (5, "text/plain", b"a\x00b", False, "text", "binary data", None), (6, "text/plain", b"a\xc3(", False, "text", "not UTF-8 text", None), (7, None, b"x", False, "text", None, "x"),
        (8, "text/html", page.encode(), True, "markdown", "a page and no Markdown", None), (9, "text/html", b"# Plain", True, "markdown", None, "# Plain"), (10, "text/plain", None, False, "text", "no body", None),
        (11, "text/markdown", b"<Widget />\n", False, "markdown", "empty", None), (12, "text/plain", b"", False, "text", "empty", None), (13, "text/html", b"\xff\xfe\x00", False, "html", "not UTF-8 text", None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "i int, t string, raw binary, md boolean")
    found = {r.i: r.b for r in df.select("i", bodies.body(F.col("t"), F.col("raw"), F.col("md")).alias("b")).collect()}
    assert {i: (b.kind, b.refused, b.text) for i, b in found.items()} == {r[0]: r[4:] for r in rows}
    assert found[5].bytes == 3 and found[13].sha256 == __import__("hashlib").sha256(b"\xff\xfe\x00").hexdigest() and found[1].scope == "article_visible_text"
    both = spark.createDataFrame([(1, page.encode(), page.encode()), (2, b"# M", page.encode()), (3, b"\x00", b"")], "i int, md raw binary, html binary".replace("md raw", "md"))
    tries = F.array(bodies.body(F.lit("text/markdown"), F.col("md"), F.lit(True)), bodies.body(F.lit("text/html"), F.col("html")))
    assert [r.k for r in both.select("i", bodies.first_body(tries)["kind"].alias("k")).orderBy("i").collect()] == ["html", "markdown", None]


def test_strict_json(spark):
    rows = ['{"a":1}', '{"a":1,"a":2}', '{"a":{"b":[{"c":1,"c":1}]}}', '{"a":{"x":1},"b":{"x":1}}', '{"a":1,"\\u0061":2}', "[1,2]", "{", "", None, '{"a":1} x', '"a"', '{"a":1,"A":2}']
    found = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").select("i", bodies.strict_json(F.col("x")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in found] == [True, False, False, True, False, True, False, False, False, False, True, True]


def test_addresses_at_every_edge(spark):
    rng, rows = random.Random(1), []
    for networks, kind in ((bodies.NOT_PUBLIC_4, ipaddress.IPv4Address), (bodies.NOT_PUBLIC_6, ipaddress.IPv6Address)):
        nets = [ipaddress.ip_network(f"{a}/{b}") for a, b in networks]
        top = (1 << kind(0).max_prefixlen) - 1
        at = {x + k for n in nets for x in (int(n.network_address), int(n.broadcast_address)) for k in (-1, 0, 1)} | {rng.randrange(top) for _ in range(200)}
        rows += [(str(kind(x)), not any(kind(x) in n for n in nets)) for x in at if 0 <= x <= top and not (kind(0).version == 6 and x < 1 << 34)]
    rows += [("::ffff:10.0.0.1", False), ("::ffff:8.8.8.8", True), ("::FFFF:808:808", True), ("64:ff9b::8.8.8.8", True), ("64:ff9b::192.168.0.1", False), ("64:ff9b:1::1", False), ("::1", False), ("::", False), ("::8.8.8.8", False)]
    rows += [(x, None) for x in ("", "x", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "::g", "1:2:3:4:5:6:7:", "::1.2.3.256", "fe80::1%eth0")] + [(None, None)]
    for a, b in ((1 << 24, True),):
        rows.append((str(ipaddress.IPv4Address(a)), b))
    found = spark.createDataFrame(rows, "a string, want boolean").select("a", "want", bodies.public_address(F.col("a")).alias("got")).collect()
    assert [(r.a, r.got) for r in found if r.got != r.want] == []


def test_no_secret_survives(spark):
    rng = random.Random(4)
    keys = ["a", "Authorization", "x-api-key", "API_KEY", "apiKey", "my_secret", "SetCookie", "note", "tokens", "pass word", "Credentials", "list"]

    def value(depth):
        kind = rng.randrange(4 if depth else 1)
        return rng.choice(["plain", 1, None, True, 'q"é']) if kind == 0 else [value(depth - 1) for _ in range(3)] if kind == 1 else node(depth - 1)

    def node(depth):
        hot = lambda k: any(s in k.lower() for s in bodies.SECRET_KEYS)
        return {k: {"x": ["s3cr3t"]} if hot(k) and rng.random() < 0.5 else "s3cr3t" if hot(k) else value(depth) for k in rng.sample(keys, 5)}

    def plain(v):
        if isinstance(v, dict):
            return {k: "[REDACTED]" if any(s in k.lower() for s in bodies.SECRET_KEYS) else plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    made = [node(5) for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(made)] + [(90, "{no"), (91, None)], "i int, x string")
    found = {r.i: r.y for r in df.select("i", bodies.safe_json(F.col("x")).alias("y")).collect()}
    assert all(json.loads(found[i]) == plain(v) and "s3cr3t" not in found[i] for i, v in enumerate(made)) and found[90] is None and found[91] is None
    urls = ["https://h/p?token=s3cr3t&a=1#x", "https://h/p", "https://h/p?a=b&X-API-KEY=s3cr3t", "https://h/p?%74oken=s3cr3t&b", "https://h/?a=1&&pass%77ord=s3cr3t=2", "https://h/p#password=s3cr3t"]
    got = [r.u for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", bodies.safe_url(F.col("u")).alias("u")).orderBy("i").collect()]
    bad = "%5BREDACTED%5D"
    assert got == [f"https://h/p?token={bad}&a=1", "https://h/p", f"https://h/p?a=b&X-API-KEY={bad}", f"https://h/p?%74oken={bad}&b", f"https://h/?a=1&pass%77ord={bad}", "https://h/p"]
