"""Records and sections of listings as pages: grouped by address, merged, capped, joined with what is held of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.functions import dates, records


def in_order(value: Column, order: Column) -> Column:
    """The values of a group as an array in their order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def merged(rows: DataFrame, by: tuple[str, ...], ident: str, order: str, artifact: str) -> DataFrame:
    """(by, id, first, artifacts, n_observed): rows of one id as one, the first in order; their artifacts united.

    A group is what one listing says of one row, so it is small however many rows there are.
    """
    own = [c for c in rows.columns if c not in (*by, ident)]
    return rows.groupBy(*by, ident).agg(
        F.min_by(F.struct(*own), order).alias("first"), F.array_sort(F.collect_set(artifact)).alias("artifacts"), F.count("*").alias("n_observed")
    )


def admitted_ids(rows: DataFrame, by: tuple[str, ...], ident: str, order: str) -> DataFrame:
    """`rows` with `disposition`: `admitted` for the first row of an id, `omitted` for the others, which are reported as `deduplication`."""
    low = rows.groupBy(*by, ident).agg(F.min(order).alias("_first"))
    found = rows.join(low, [*by, ident])
    return found.withColumn("disposition", F.when(F.col(order) == F.col("_first"), "admitted").otherwise("omitted")).drop("_first")


def roster(rows: DataFrame, by: str, order: str, columns: tuple[str, ...], title: str = "Complete {} registry") -> DataFrame:
    """(by, title, text, n_rows): each registry as one text, a line for each row. Registries are complete and small by their nature."""
    line = F.concat_ws(" | ", *[records.cell(F.col(c).cast("string")) for c in columns])
    head = F.lit(" | ".join(columns))
    found = rows.groupBy(by).agg(F.count("*").alias("n_rows"), F.array_join(in_order(line, F.col(order)), "\n").alias("lines"))
    name = F.concat(F.lit(title.split("{}")[0]), F.col(by).cast("string"), F.lit(title.split("{}")[1]), F.lit(": "), F.col("n_rows").cast("string"), F.lit(" rows"))
    return found.select(by, name.alias("title"), F.concat_ws("\n", head, "lines").alias("text"), "n_rows")


def grouped_pages(rows: DataFrame, by: str, page: str, order: str, title: str, text: str, holds: str | None = None, most: int = 0) -> DataFrame:
    """(by, page, title, text, n, holds, place): records of a page as one document.

    The first record names it and texts follow in order. Pages with a record that `holds` a term come first, then the order of
    the search; at most `most` pages of a search are kept (0: all). Only titles and places are sorted over a search; texts are read
    again for the pages that are kept, and a page's text meets in one task only with those of its page.
    """
    held = F.col(holds) if holds else F.lit(True)
    rows = rows.where(F.col(page).isNotNull())
    heads = rows.groupBy(by, page).agg(F.min(order).alias("first"), F.min_by(title, order).alias("title"), F.count("*").alias("n"), F.max(held).alias("holds"))
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("holds"), "first"))).drop("first")
    own = ("title", "n", "holds", "place")
    heads = heads.select(F.col(by).alias("_by"), F.col(page).alias("_page"), *own)
    # Where a bound is given, heads are few and go to the rows, so that only texts of pages that are kept are dealt out.
    heads = F.broadcast(heads.where(F.col("place") <= most)) if most else heads
    found = rows.select(by, page, order, text).join(heads, F.col(by).eqNullSafe(F.col("_by")) & (F.col(page) == F.col("_page")))
    joined = F.array_join(in_order(F.col(text), F.col(order)), "\n\n").alias("_text")
    found = found.groupBy(by, page).agg(joined, *[F.first(c).alias(c) for c in own])
    return found.select(by, page, "title", F.col("_text").alias("text"), "n", "holds", "place")


def paged(rows: DataFrame, by: str, order: str, page_rows: int, max_pages: int, matched: str | None = None) -> DataFrame:
    """The rows that a listing gives in at most `max_pages` pages, with `page`; nothing past the count that it says it has matched."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    found = rows.withColumn("_at", place).where(F.col("_at") < page_rows * max_pages)
    if matched:
        found = found.where(F.col("_at") < F.coalesce(F.col(matched), F.lit(1 << 31)))
    return found.withColumn("page", F.floor(F.col("_at") / page_rows)).drop("_at")


def shared_pages(queries: DataFrame, by: str, order: str, pages: str, budget: int) -> DataFrame:
    """`queries` with `sent` pages, of one budget that the queries of a search use up in order; a query with none is not sent."""
    before = F.sum(pages).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    room = F.greatest(F.lit(budget) - F.coalesce(before, F.lit(0)), F.lit(0))
    return queries.withColumn("sent", F.least(F.col(pages), room))


def first_answer(rows: DataFrame, by: str, turn: str) -> DataFrame:
    """The rows of the first query of each search that has any; later ones are asked only where earlier ones find nothing."""
    first = rows.groupBy(by).agg(F.min(turn).alias("_turn"))
    return rows.join(first, by).where(F.col(turn) == F.col("_turn")).drop("_turn")


def best_entries(rows: DataFrame, by: str, score: str, slug: str, most: int = 8) -> DataFrame:
    """The entries of a catalog whose details are read: those with a score, best first, ties by slug."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), slug))
    return rows.where(F.col(score) > 0).withColumn("place", place).where(F.col("place") <= most)


def freshness(names: DataFrame, inventory: DataFrame, name: str, built: str, now: Column, hours: int = 48) -> DataFrame:
    """`names` with age_hours and report: `missing` from the inventory, `stale` past its hours, or null."""
    found = names.join(inventory.select(name, built), name, "left").withColumn("age_hours", F.floor((now - F.col(built)) / 3600).cast("bigint"))
    return found.withColumn("report", F.when(F.col(built).isNull(), "missing").when((now - F.col(built)) > hours * 3600, "stale"))


def project_details(rows: DataFrame, details: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` with the detail of their project, looked up once for each project: by its key, else by its name."""
    wanted = rows.select(key, name).distinct()
    keyed = details.select(F.col(key), F.col("detail").alias("_k")).dropDuplicates([key])
    named = details.groupBy(name).agg(F.min("detail").alias("_n"))
    found = wanted.join(keyed, key, "left").join(named, name, "left").select(key, name, F.coalesce("_k", "_n").alias("detail"), F.when(F.col("_k").isNotNull(), "key").when(F.col("_n").isNotNull(), "name").otherwise("none").alias("found_by"))
    return rows.join(found, [key, name])


def moved(pages: DataFrame, moves: DataFrame, url: str = "url", most: int = 3) -> DataFrame:
    """`pages` with `at`, where redirects lead, and `moves`, how many; null where they leave the host or don't end in time.

    `moves` are (url, location), one for each URL; each step is one join.
    """
    steps = moves.select(F.col("url").alias("_from"), records.same_host_move(F.col("url"), F.col("location")).alias("_to"))
    found = pages.withColumn("at", F.col(url)).withColumn("moves", F.lit(0))
    for k in range(most + 1):
        found = found.join(steps, F.col("at") == F.col("_from"), "left")
        went = F.col("_from").isNotNull()
        to = F.col("_to") if k < most else F.lit(None).cast("string")
        found = found.withColumn("at", F.when(went, to).otherwise(F.col("at"))).withColumn("moves", F.col("moves") + went.cast("int")).drop("_from", "_to")
    return found


def held_bodies(rows: DataFrame, held: DataFrame) -> DataFrame:
    """`rows` (with url) and `held_id`: the document that already holds the whole body of the same page, the lowest if several do."""
    have = held.withColumn("_page", records.normalized_url(F.col("url"))).where("_page is not null").groupBy("_page").agg(F.min("id").alias("held_id"))
    return rows.withColumn("_page", records.normalized_url(F.col("url"))).join(have, "_page", "left").drop("_page")


def read_counters(rows: DataFrame, by: str) -> DataFrame:
    """How many reads of originals were eligible, reused, capped, skipped, attempted, used, refused and failed, from their outcomes."""
    names = ("reused", "capped", "skipped", "used", "refused", "failed")
    counts = [F.count_if(F.col("outcome") == n).alias(n) for n in names]
    found = rows.groupBy(by).agg(F.count("*").alias("eligible"), *counts)
    return found.withColumn("attempted", reduce(lambda a, b: a + b, [F.col(n) for n in ("used", "refused", "failed")]))


def newest_by_url(rows: DataFrame, by: str, order: str) -> DataFrame:
    """(by, url, kind, days): the newest date among the documents of a URL, the first in order on ties."""
    dated = rows.where("url <> '' and days is not null")
    best = F.max_by(F.struct("kind", "days"), F.struct(F.col("days"), (-F.col(order)).alias("o")))
    return dated.groupBy(by, "url").agg(best.alias("b")).select(by, "url", "b.kind", "b.days")


def lent_dates(rows: DataFrame, by: str, order: str) -> DataFrame:
    """`rows` with dates: an undated row with a URL has the newest date of that URL, under the kind that a lent date has."""
    lent = newest_by_url(rows, by, order).select(by, "url", F.col("kind").alias("_k"), F.col("days").alias("_d"))
    found = rows.join(lent, [by, "url"], "left")
    own = F.col("days").isNotNull()
    kind = F.when(own, F.col("kind")).when(F.col("_d").isNotNull(), dates.url_date_kind(F.col("_k")))
    return found.withColumn("kind", kind).withColumn("days", F.coalesce("days", "_d")).drop("_k", "_d")


def date_targets(rows: DataFrame, by: str, place: str, hosts: tuple[str, ...], most: int = 24) -> DataFrame:
    """The first undated rows of each search that are pages of these hosts: those whose pages are read for a date."""
    some = rows.where(F.col("days").isNull() & records.canonical_page(F.col("url"), hosts))
    turn = F.row_number().over(Window.partitionBy(by).orderBy(place))
    return some.withColumn("turn", turn).where(F.col("turn") <= most)
