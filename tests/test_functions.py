"""Scalar functions and small operators against values worked out by hand."""

import datetime

from pyspark.sql import functions as F

from lodesift.functions import columns as C
from lodesift.functions.html import visible
from lodesift.operators import documents, limits, ranking, rollups
from lodesift.streaming.requests import window_counts


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def _days(y, m, d):
    return (datetime.date(y, m, d) - datetime.date(1970, 1, 1)).days


def test_first_date(spark):
    cases = {
        "Revised Feb 9, 2021, second print": _days(2021, 2, 9), "out on October 3rd 2019": _days(2019, 10, 3), "due 17/12/2030.": _days(2030, 12, 17), "5/25/2001": None,
        "1/2/2003": None, "2023-02-29": None, "from 1999-12-31 to 2000-01-01": _days(1999, 12, 31), "1875-01-01 and 1/2/2003, then Mar 4 2005": _days(2005, 3, 4), "": None, None: None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", C.first_date(F.col("t")).alias("d")).collect()
    assert [r.d for r in sorted(rows)] == list(cases.values())


def test_chunks_cut_no_character(spark):
    text = "é🙂文" * 4000 + "tail"
    found = spark.createDataFrame([(text,)], "t string").select(C.byte_chunks(F.col("t"), 1000).alias("c")).first().c
    raw = text.encode()
    assert b"".join(raw[r.s : r.e] for r in found) == raw and all(raw[r.s : r.e].decode() and r.e - r.s <= 1000 for r in found)
    tiny = spark.createDataFrame([("aé🙂",)], "t string").select(C.byte_chunks(F.col("t"), 2, True).alias("c")).first().c
    assert [r.piece for r in tiny] == ["a", "é", "🙂"]
    assert spark.createDataFrame([("",), (None,)], "t string").select(C.byte_chunks(F.col("t"), 1000).alias("c")).collect() == [([],), ([],)]


def test_status_tier_and_host(spark):
    assert [_one(spark, C.status(F.lit(p).cast("double"))) for p in (0.4, 0.15, 0.1, None)] == ["selected", "uncertain", "rejected", "uncertain"]
    rules = (("docs.example.com", "/", 1), ("code.example.com", "/team/", 1), ("code.example.com", "", 2))
    tier = lambda url, scope="": _one(spark, C.authority_tier(F.lit(url), F.lit(scope), rules))
    assert [tier("https://docs.example.com/a"), tier("https://WWW.code.example.com/team/x"), tier("https://code.example.com/y"), tier("nothing"), tier("https://docs.example.com/a", "ai_summary")] == [1, 1, 2, 3, 4]


def test_ranking_order(spark):
    rows = spark.createDataFrame(
        [(1, "p", 3.0, 0.1, 10.0, 2.0), (1, "q", 3.0, None, 40.0, 2.0), (1, "r", 1.0, 0.7, None, 9.0), (1, "s", None, 0.7, 20.0, 9.0), (None, "t", 1.0, 1.0, 1.0, 1.0)],
        "question_id int, id string, relevance double, currentness double, recency double, authority double",
    )
    rows = ranking.fused(rows, ("relevance", "currentness", "recency", "authority"), ranking.WEIGHTS["current"])
    places = {r.id: (r.relevance_rank, r.currentness_rank, r.recency_rank, r.authority_rank) for r in rows.collect()}
    assert places == {"p": (1, 3, 3, 3), "q": (1, 2, 1, 3), "r": (3, 1, 2, 1), "s": (2, 1, 2, 1), "t": (1, 1, 1, 1)}
    for confidence, buckets in ((0.6, [1, 1, 2, 2]), (0.5, [2, 2, 2, 2])):
        found = ranking.final_order(rows.withColumn("bucket", ranking.bucket(F.lit("current"), F.lit(confidence), F.col("currentness")))).where("id <> 't'").orderBy("place").collect()
        assert [r.bucket for r in found] == buckets and [r.place for r in found] == [1, 2, 3, 4]
        assert [r.id for r in found] == sorted("pqrs", key=lambda i: next((r.bucket, -r.fused, r.id) for r in found if r.id == i))


def test_streaks_and_windows_in_pieces(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(20_000)), rng.random() < 0.6) for i in range(400)]
    found = {r.i: r for r in limits.window_limit(rollups.streaks(spark.createDataFrame(rows, "i int, k string, at timestamp_ntz, bad boolean"), "k", ("at", "i"), F.col("bad")), "k", "at", "i", "1 hour", 5).collect()}
    run, used = {"a": 0, "b": 0}, {}
    for i, k, at, bad in sorted(rows, key=lambda r: (r[2], r[0])):
        run[k] = run[k] + 1 if bad else 0
        used[k, at.hour] = used.get((k, at.hour), 0) + 1
        assert (found[i].streak, found[i].used, found[i].allowed) == (run[k], used[k, at.hour], used[k, at.hour] <= 5)


def test_scores_from_rare_words_miss_no_pair(spark):
    import random

    rng = random.Random(3)
    pool = [f"w{i}" for i in range(30)]
    say = lambda n: " ".join(rng.choices(pool, [1 / (i + 1) for i in range(30)], k=n))
    questions = spark.createDataFrame([(i, say(rng.randrange(1, 9))) for i in range(25)] + [(90, ""), (91, None)], "question_id int, question string")
    docs = spark.createDataFrame([(i, say(rng.randrange(0, 25))) for i in range(120)] + [(900, None)], "id int, text string")
    whole = {(r.question_id, r.id): r.usable_evidence for r in documents.lexical_scores(questions, docs).collect()}
    for least in (0.2, 0.5, 2 / 3, 1.0):
        found = {(r.question_id, r.id): r.usable_evidence for r in documents.lexical_scores(questions, docs, least).collect()}
        assert found == {k: v for k, v in whole.items() if v >= least} and found


def test_percentile_is_a_value_at_an_index(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(10, 101, 10)] + [("b", 1.0), ("b", 2.0)], "k string, v double")
    found = {r.k: (r.p50, r.p95) for r in rollups.percentiles(rows, "v", "k", (0.5, 0.95)).collect()}
    assert found == {"a": (60.0, 100.0), "b": (2.0, 2.0)}


def test_token_bucket_starts_full_and_refills(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 0, 0, 10_000)], "k string, t long")
    assert [r.granted for r in limits.token_bucket(rows, "k", "t", 12).orderBy("t", F.desc("tokens")).collect()] == [True, True, False, True]


def test_visible_text():
    page = '<html><head><title>t</title></head><body><nav>menu</nav><article><h1>A &amp; B</h1><p>one<br>two<span hidden>x</span><script>y</script></p></article>out</body></html>'
    assert visible(page) == ("A & B\none\ntwo", "article_visible_text")
    assert visible("<body><p>only</p></body>") == ("only", "body_visible_text")
    assert visible('<main><p>on <time datetime="2020-01-02"></time> or <time datetime="2020-01-03">then</time></p><p aria-hidden="TRUE">no</p></main>') == ("on  2020-01-02  or then", "main_visible_text")
    assert visible("<p>" * 5000) == (None, None) == visible(None)


def test_window_counts_run_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2024-01-01 00:{m:02d}:00") for m in (1, 2, 59)] + [("b", "2024-01-01 01:00:00")], "event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = window_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), limit=2)
    stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_type, r.used, r.over) for r in spark.table("counts").collect()) == [("a", 3, 1), ("b", 1, 0)]


def test_scores_of_dealt_documents_shuffle_no_pairs(spark, tmp_path):
    """Counting words in common needs no shuffle beyond that of the documents, and a task's documents don't grow with the table."""
    questions = spark.createDataFrame([(q, " ".join(f"w{q + i}" for i in range(8))) for q in range(20)], "question_id int, question string")
    questions.write.parquet(str(tmp_path / "questions"))  # from a file, so that Spark knows its size
    questions = spark.read.parquet(str(tmp_path / "questions"))
    docs = spark.createDataFrame([(d, " ".join(f"w{d % 9 + i}" for i in range(12))) for d in range(300)], "id int, text string")
    whole = {(r.question_id, r.id): r.usable_evidence for r in documents.lexical_scores(questions, docs).collect()}
    for least in (0.0, 0.5):
        found = documents.lexical_scores(questions, documents.dealt(docs, each=40), least)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
        assert {(r.question_id, r.id): r.usable_evidence for r in found.collect()} == {k: v for k, v in whole.items() if v >= least}
    assert documents.dealt(docs, each=40).rdd.getNumPartitions() == 8
