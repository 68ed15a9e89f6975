"""Texts of pages, dates, pages and windows on forms that the driver's tables don't have."""

from pyspark.sql import functions as F

from lodesift.functions import dates, texts
from lodesift.operators import limits, pages, scoring, sessions


def test_markdown_for_scoring(spark):
    given = ["# T\n<nav>\nx\n</nav>\ntext", "```\n<nav>\nimport x\n```\nend", "import A from 'b'\ntext", "<Card/>\ntext", "<script>x</script>\n", "~~~~\n~~~\n<aside>\n~~~~\nz", None]
    want = ["# T\ntext", "```\n<nav>\nimport x\n```\nend", None, None, None, "~~~~\n~~~\n<aside>\n~~~~\nz", None]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", texts.scoring_text(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == want and [texts.markdown_for_scoring(g) for g in given] == want


def test_document_date_rules(spark):
    cases = [
        ([("published", 100), ("modified", 200), ("event", 999)], ("modified", 200)), ([("published", 100), ("observed", 100)], ("observed", 100)),
        ([("published", 5001), ("published", 50)], ("published", 5001)), ([("published", 5002)], None), ([("event", 10), ("ingested", 20)], ("event", 10)), ([("modified", None)], None), ([], None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c array<struct<kind:string,days:int>>")
    found = {r.i: r.d for r in df.select("i", dates.document_date(F.col("c"), F.lit(5000)).alias("d")).collect()}
    assert [None if found[i] is None else tuple(found[i]) for i in range(len(cases))] == [w for _, w in cases]


def test_moves_end_in_time(spark):
    moves = spark.createDataFrame([("https://a.example/0", "/1"), ("https://a.example/1", "/2"), ("https://a.example/2", "/3"), ("https://a.example/3", "/4"), ("https://a.example/x", "https://b.example/"), ("https://a.example/loop", "/loop")], "url string, location string")
    start = spark.createDataFrame([(u,) for u in ("https://a.example/0", "https://a.example/1", "https://a.example/x", "https://a.example/loop", "https://a.example/none")], "url string")
    found = {r.url[18:]: (r.at, r.moves) for r in pages.moved(start, moves).collect()}
    assert found == {"0": (None, 4), "1": ("https://a.example/4", 3), "x": (None, 1), "loop": (None, 4), "none": ("https://a.example/none", 0)}


def _carried(plan, kind):
    """The names of the columns that go through each node of a kind."""
    own = [[a.name() for a in map(plan.output().apply, range(plan.output().size()))]] if plan.nodeName() == kind else []
    return own + [x for i in range(plan.children().size()) for x in _carried(plan.children().apply(i), kind)]


def test_pages_are_placed_without_their_texts(spark):
    rows = [("en", f"p{i % 4}", i, f"t{i}", None if i % 5 == 0 else f"x{i}", i == 7) for i in range(40)] + [(None, "p0", 90, "t", "y", False), (None, "p1", 80, "u", "z", False), ("en", None, 99, "lost", "lost", True)]
    df = spark.createDataFrame(rows, "lang string, page string, i long, title string, text string, holds boolean")
    every = {}
    for lang, page, i, title, text, holds in sorted((r for r in rows if r[1]), key=lambda r: r[2]):
        every.setdefault((lang, page), []).append((i, title, text, holds))
    for most in (0, 1, 3):
        found = pages.grouped_pages(df, "lang", "page", "i", "title", "text", "holds", most)
        want = {}
        for lang in ("en", None):
            turn = sorted((k for k in every if k[0] == lang), key=lambda k: (not any(r[3] for r in every[k]), every[k][0][0]))
            for place, k in enumerate(turn[: most or None], 1):
                own = every[k]
                want[k] = (own[0][1], "\n\n".join(r[2] for r in own if r[2] is not None), len(own), any(r[3] for r in own), place)
        assert {(r.lang, r.page): (r.title, r.text, r.n, r.holds, r.place) for r in found.collect()} == want
        # A search's pages meet in one task to be placed; were their texts there, it would read the whole search.
        carried = _carried(found._jdf.queryExecution().optimizedPlan(), "Window")
        assert carried and not any("text" in names for names in carried)


def test_ties_go_to_the_last_intent(spark):
    rows = spark.createDataFrame([(1, 0.2, 0.2, 0.1, 0.0), (2, 0.0, 0.0, 0.0, 0.0), (3, None, None, 0.3, None)], "q int, current double, comparative double, versioned double, timeless double")
    assert {r.q: r.kind for r in scoring.intent(rows, "q").collect()} == {1: "comparative", 2: "timeless", 3: "versioned"}


def test_windows_of_one_scope(spark):
    rows = [("a", 1000, 10, 4, 61_000, False), ("a", 2000, 12, 1, 61_500, False), ("a", 70_000, 12, 11, 121_000, False), ("a", 90_000, 12, None, 80_000, False), ("b", 1, 5, 5, 10, True), (None, 1, 5, 2, 10, None)]
    df = spark.createDataFrame(rows, "scope string, at long, lim long, left long, reset long, one boolean")
    found = sorted((tuple(r) for r in limits.learned_windows(df, "scope", "at", "lim", "left", "reset", "one").collect()), key=str)
    assert found == [("a", 121_000, 12, 1, 51_000, 1), ("a", 61_500, 12, 11, 60_000, 2), (None, 10, 5, 3, 9, 1)]


def test_check_scopes(spark):
    docs = spark.createDataFrame([(1, i) for i in range(4)], "session int, id int")
    verdicts = spark.createDataFrame([(1, 0, "selected"), (1, 1, "rejected")], "session int, id int, status string")
    count = lambda scope: sessions.check_scope(docs, docs.where("id < 3"), verdicts, scope, "session").count()
    assert (count("selected"), count("scored"), count("all")) == (1, 3, 4)
