"""The compact list, the ledger, batches and running sums against plain versions."""

import random

from pyspark.sql import functions as F

from lodesift.functions import questions as Q
from lodesift.operators.packing import packed
from lodesift.operators import calls, compact, scoring
from lodesift.operators.running import blocks, running

_ROW = "question_id string, place long, id long, url string, title_key string, tier int"


def _list(spark, rows, limit):
    found = compact.compact(spark.createDataFrame([("q", *r) for r in rows], _ROW), limit).orderBy("place").collect()
    return [r.id for r in found]


def test_running_over_pieces_with_null_keys(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "b", None]), i, rnd.choice([None, 1, 5, 7])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for own in (True, False):
        got = running(running(df, "s", F.col("v"), ("k",), ("i",), blocks("i", 16), own=own), "m", F.col("v"), ("k",), ("i",), blocks("i", 16), "max", own)
        found = {r.i: (r.s, r.m) for r in got.collect()}
        for k, i, _ in rows:
            before = [v for a, j, v in rows if a == k and v is not None and (j <= i if own else j < i)]
            assert found[i] == (sum(before), max(before, default=None))
    assert running(df.limit(0), "s", F.col("v"), ("k",), ("i",), blocks("i")).count() == 0


def test_best_tier_stands_for_a_url_at_its_first_place(spark):
    rows = [(1, 10, "u", None, 3), (2, 20, "w", None, 2), (3, 30, "u", None, 1), (4, 40, "u", None, 1)]
    assert _list(spark, rows, 0) == [30, 20]


def test_copy_without_url_gives_its_place_to_the_page(spark):
    rows = [(1, 10, "", "same long title", 3), (2, 20, "w", None, 2), (3, 30, "u", "same long title", 2), (4, 40, "", "same long title", 3), (5, 50, "", "another title", 3), (6, 60, "", None, 3)]
    assert _list(spark, rows, 0) == [30, 20, 50, 60]
    found = compact.summary(spark.createDataFrame([("q", *r) for r in rows], _ROW), 3).first()
    assert (found.n_selected, found.unique_selected, found.n_duplicates, found.shown, found.beyond_limit) == (6, 4, 2, 3, 1)


def test_an_official_page_takes_the_last_place(spark):
    rows = [(i, i * 10, f"u{i}", None, 1 if i in (5, 6) else 2) for i in range(1, 7)]
    assert _list(spark, rows, 3) == [10, 20, 50]
    assert _list(spark, rows, 5) == [10, 20, 30, 40, 50]
    assert _list(spark, [r for r in rows if r[0] < 3], 3) == [10, 20]
    assert _list(spark, [], 3) == []


def test_batches_pack_in_order(spark):
    rnd = random.Random(5)
    rows = [(f"k{rnd.randrange(4)}", i, rnd.choice([10, 40, 90, 500])) for i in range(200)]
    found = {r.i: r.batch for r in packed(spark.createDataFrame(rows, "k string, i long, b long"), "k", "i", "b", base=5, most=3, limit=120).collect()}
    for key in {r[0] for r in rows}:
        packs = []
        for _, i, b in (r for r in rows if r[0] == key):
            if not packs or len(packs[-1]) == 3 or 5 + sum(x for _, x in packs[-1]) + b > 120:
                packs.append([])
            packs[-1].append((i, b))
        assert all(found[i] == n for n, pack in enumerate(packs) for i, _ in pack)


def test_ledger_counts_what_calls_cost(spark):
    rows = [("p", 1, "settled", 100), ("p", 2, "released", None), ("p", 3, "retained", None), ("p", 4, "settled", 70_000)]
    found = calls.ledger(spark.createDataFrame(rows, "k string, i long, o string, t long"), "k", ("i",), "o", "t", 420, 10_000_000).orderBy("i").collect()
    assert [(r.delta, r.stopped) for r in found] == [(4200, False), (0, False), (2_752_512, False), (2_940_000, True)]
    assert found[-1].accounted == 5_696_712


def test_passes_reuse_and_reads(spark):
    rows = spark.createDataFrame([("a", "x", 0.1), ("a", "y", 1.0), ("b", "x", 0.1), ("b", "x", 0.2), ("c", "x", float("nan")), ("c", "y", 0.5)], "k string, s string, p double")
    assert {r.k: r.valid for r in calls.pass_validity(rows, "k", "s", "p", spark.createDataFrame([("x",), ("y",)], "s string")).collect()} == {"a": True, "b": False, "c": False}
    docs = spark.createDataFrame([(1, 1, "t", None), (2, 1, "t", None), (3, 2, "t", None), (4, 2, "t", "d")], "id long, call long, title string, digest string")
    assert [r.decision for r in calls.reused(docs, "call", ("title", "digest")).orderBy("id").collect()] == ["score", "copy", "reuse", "score"]
    pages = spark.createDataFrame([(1, "c", "u#a", 0.1), (2, "c", "u", 0.9), (3, "c", "v", 0.5), (4, "c", "", 1.0), (5, "c", "w", 0.2)], "id long, call string, url string, route double")
    assert [r.id for r in calls.original_reads(pages, "call", charged=F.lit(10)).orderBy("place").collect()] == [2, 3]


def test_words_of_a_question(spark):
    text = "How does Foo-Bar v2.1 use the x, on 2,024 chainX?"
    row = spark.createDataFrame([(text,)], "t string").select(Q.retrieval_terms(F.col("t")).alias("r"), F.filter(Q.words(F.col("t")), Q.technical).alias("x"), F.filter(Q.words(F.col("t")), Q.pure_number).alias("n")).first()
    assert row.r == ["foo-bar", "v2.1", "024", "chainx"] and row.x == ["Foo-Bar", "v2.1", "chainX"] and row.n == ["2,024"]
    found = spark.createDataFrame([("¿x?",), ("para los dos",), ("para dos",), (None,)], "t string").select(Q.non_english(F.col("t")).alias("n")).collect()
    assert [r.n for r in found] == [True, True, False, False]


def test_compact_reads_its_rows_once(spark):
    """The list and its official row come from one pass over the pairs."""
    rows = [("q", i, i, f"u{i}", None, 1 if i == 9 else 3) for i in range(12)]
    df = spark.createDataFrame(rows, "question_id string, place int, id int, url string, title_key string, tier int").where("rand() >= 0")
    found = compact.compact(df, 4)
    # Twice in `ordered` (rows and the copies of titles), and not again for the official row.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
    assert [(r.place, r.id) for r in found.orderBy("place").collect()] == [(1, 0), (2, 1), (3, 2), (4, 9)]


def test_currentness_targets_score_a_text_once(spark):
    """Copies take the place of their text's first document; only the first `most` texts of a question count."""
    scored = spark.createDataFrame([("q", 1, "a", 0.9), ("q", 2, "b", 0.9), ("q", 5, "c", 0.5), ("r", 5, "c", 0.1)], "question_id string, id int, digest string, top2 double")
    copies = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (5, "c"), (6, "c"), (7, "d")], "id int, digest string")
    found = compact.currentness_targets(scored, copies, "digest", 2)
    assert sorted(map(tuple, found.collect())) == [("q", 1, 1), ("q", 2, 2), ("q", 3, 1), ("r", 5, 1), ("r", 6, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0  # pairs are not grouped by text


def test_reply_validity_counts_side_by_side(spark):
    """Missing, foreign, repeated and null keys and values that are no probabilities make a reply invalid; nothing is joined."""
    expected = spark.createDataFrame([(r, k) for r in "abcdefg" for k in "xyx"] + [(None, "x")], "r string, k string")
    fine = [("a", "x", 0.0), ("a", "y", 1.0)]
    bad = [("b", "x", 0.5), ("c", "x", 0.5), ("c", "y", 0.5), ("c", "z", 0.5), ("d", "x", 0.5), ("d", "y", 0.5), ("d", "y", 0.5), ("e", "x", 0.5), ("e", "y", float("nan")), ("f", "x", 0.5), ("f", None, 0.5)]
    answers = spark.createDataFrame(fine + bad + [("nobody", "x", 0.5), (None, "x", 0.5)], "r string, k string, v double")
    found = scoring.response_validity(answers, expected, "r", "k", "v")
    told = {r.r: (r.n, r.valid) for r in found.collect()}
    assert told == {"a": (2, True), "b": (1, False), "c": (3, False), "d": (3, False), "e": (2, False), "f": (2, False), "g": (0, False), None: (0, False)}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
