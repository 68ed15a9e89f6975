"""Plans of questions: parts of the question in its own order, within the caps, and what is left out is told."""

import random

import pytest

from lodesift.functions.planner import FACETS, KEYWORDS, VARIANTS, plan


def _kinds(found, kind):
    return [v[1] for v in found["variants"] if v[0] == kind]


@pytest.mark.parametrize(
    ("question", "keywords", "entities", "facets"),
    [
        ("Show records on draining idle pools and closing stale channels.", ["draining idle pools", "closing stale channels"], [], 2),
        ("Explain RFC-12 pairing and how RFC-13 uses the stored token.", ["RFC-12 pairing", "RFC-13 stored token"], ["RFC-12", "RFC-13"], 2),
        ("Can openDoor in door-kit v3.0.1 handle Edition 4?", None, ["openDoor", "v3.0.1", "Edition 4"], 1),
        ("Get Borealis river notes and yearly readings of its present flow.", ["Borealis river notes", "Borealis yearly readings present flow"], ["Borealis"], 2),
        ("How can I renew lapsed Gatekit access badges?", ["renew lapsed Gatekit access badges", "renew lapsed Gatekit", "access badges"], ["Gatekit"], 1),
        ("¿Dónde encuentro guías sobre permisos y claves de acceso de Gatekit?", ["guías", "permisos"], ["Gatekit"], None),
    ],
)
def test_variants(question, keywords, entities, facets):
    found = plan(question)
    if keywords and facets:
        assert _kinds(found, "keywords") == keywords
    assert found["entities"] == entities
    assert facets is None or len(found["facets"]) == facets


def test_dates_quotes_and_instructions():
    found = plan("Compare Kestrel releases as of 2025-08-09. Never show drafts as final.")
    assert found["dates"] == ["2025-08-09"] and found["entities"] == ["Kestrel"]
    assert ("instruction_clause", "Never show drafts as final") in found["omissions"]
    found = plan('Translate this text: "one two three four five six" into notes')
    assert [o[0] for o in found["omissions"]] == ["quoted_data", "quoted_data"] and "one" not in " ".join(_kinds(found, "keywords"))
    assert plan('an "open quote never ends')["omissions"] == []
    assert _kinds(plan("Why is it so?"), "keywords") == [] and _kinds(plan("Why is it so?"), "natural") == ["Why is it so?"]
    assert plan(None)["tokens"] == [] and plan("word " * 500)["omissions"][0][0] == "question_length"
    assert plan("tell me of corpus")["facets"] and plan("tell me of corpus", "corpus")["facets"] == ["tell me of corpus"]


def test_plans_of_any_words():
    rng, pool = random.Random(4), ["the", "and", "Foo", "barBaz", "9", "v1.2", "its", "list,", '"quoted', 'end"', "note:", "2024-05-06", "don't", "—", "quiet", "river.", "¿qué", "los"]
    for _ in range(500):
        question = " ".join(rng.choices(pool, k=rng.randrange(1, 25)))
        found = plan(question)
        assert found == plan(question) and len(found["facets"]) <= FACETS
        for kind in ("facet", "entity"):
            assert len(_kinds(found, kind)) <= VARIANTS
        for kind, text, places in found["variants"]:
            assert places == sorted(set(places)) and (kind != "keywords" or len(places) <= KEYWORDS)
            assert kind == "natural" or text == " ".join(found["tokens"][i] for i in places)


def test_dates_of_whole_texts(spark, tmp_path):
    """Dates stand anywhere in a question's text, and its SQL finds the same."""
    import duckdb

    from lodesift import plans

    rows = [(0, "Notes of (2031-05-06), and 2031-05-07."), (1, None), (2, "none here 12031-05-06 or 2031-5-6"), (3, "late\n2030-01-02")]
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    found = sorted(map(tuple, plans.QUERIES["plan_dates"](spark, str(tmp_path)).collect()))
    assert found == [(0, "2031-05-06"), (0, "2031-05-07"), (2, "2025-03-04"), (3, "2030-01-02")]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert sorted(con.sql(plans.SQL["plan_dates"]).fetchall()) == found


def test_dates_of_texts_of_any_length(spark, tmp_path):
    """Texts longer than a question may be, quotes and rows without a sentence are read whole, by the query and by its SQL."""
    import duckdb

    from lodesift import plans

    rows = [
        (0, "word " * 388 + "2031-01-01"), (1, "word " * 50_000 + "[2031-01-02], end"), (2, "long " * 1_000), (3, '"one two 2031-01-03 four five" six'),
        (4, 'an "open ' + "word " * 900 + '2031-01-04 quote" ends'), (None, "of 2031-01-05"), (-2, "of 2031-01-06"), (5, '"' * 100_000 + "2031-01-07" + "." * 100_000), (7, "2031-01-08 2031-01-08"),
    ]
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    found = sorted(map(tuple, plans.QUERIES["plan_dates"](spark, str(tmp_path)).collect()), key=repr)
    expected = [(i, f"2031-01-0{d}") for i, d in ((0, 1), (1, 2), (3, 3), (4, 4), (None, 5), (-2, 6), (5, 7), (7, 8), (7, 8))]
    assert found == sorted([*expected, (2, "2025-03-04")], key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert sorted(con.sql(plans.SQL["plan_dates"]).fetchall(), key=repr) == found


def test_dates_equal_the_words_of_a_plan(spark):
    """An expression finds the dates that the planner's words are, quoted data included."""
    from pyspark.sql import functions as F

    from lodesift.functions.planner import named_dates, split

    rng, pool = random.Random(6), [*"\"“”‘’'([{<¿¡`)]}>.,;:!? \t\n\x0b\x85\xa0　-–1xé😀", *["2024-05-06"] * 12, "2024-5-06", "٢٠٢٤-٠٥-٠٦"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(2_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", named_dates(F.col("text")).alias("dates")).collect()
    assert [list(r.dates) for r in rows] == [[w.text for w in split(r.text)[0] if w.date] for r in rows] and sum(len(r.dates) for r in rows) > 500
