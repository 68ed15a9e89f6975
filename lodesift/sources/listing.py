"""Recorded listings as a Spark data source: folders of reply pages, one partition a folder.

A listing is read in pages by offset. Replies are recorded as `listing=<name>/offset=<n>/` with one JSON object a line:
{"meta": {"matched": count or null}, "rows": [...]}. A folder `offset=<n>-<m>` holds all pages from n to m, each with its own
"offset" in "meta". The reader plans partitions from folder names alone; filters on the listing and the offset leave whole folders
unread, and of a folder of several pages those that they don't want. The rules that end a listing (its count, its page limit, a page without anything new) are joins over
what the pages say, in `followed`.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "listing string, offset bigint, matched bigint, n_rows int, place int, id string, row string"
#: Rows of an Arrow batch.
_BATCH = 2_048
_COMPARE = {LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b}


def _opened(path: str):
    """The file system of a path and the path in it; what Arrow knows by its address, else a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


class Folder(InputPartition):
    """The files of a folder with the pages from `first` to `last`; both are the page's offset where it holds one."""

    def __init__(self, listing: str, first: int, last: int, files: tuple[str, ...]):
        self.listing, self.first, self.last, self.files = listing, first, last, files


class Reader(DataSourceReader):
    def __init__(self, path: str, ident: str):
        self.path, self.ident, self.tests = path, ident, []

    def pushFilters(self, filters):
        """Takes comparisons of the listing and the offset; all others stay with Spark."""
        for f in filters:
            name = f.attribute if hasattr(f, "attribute") else ()
            if isinstance(f, (EqualTo, EqualNullSafe)) and name in (("listing",), ("offset",)) and f.value is not None:
                self.tests.append((name[0], lambda x, v=f.value: x == v, lambda a, b, v=f.value: a <= v <= b))
            elif isinstance(f, In) and name in (("listing",), ("offset",)):
                self.tests.append((name[0], lambda x, v=frozenset(f.value): x in v, lambda a, b, v=f.value: any(x is not None and a <= x <= b for x in v)))
            elif type(f) in _COMPARE and name == ("offset",) and f.value is not None:
                # A comparison that holds anywhere in a span holds at one of its ends.
                self.tests.append(("offset", lambda x, v=f.value, c=_COMPARE[type(f)]: c(x, v), lambda a, b, v=f.value, c=_COMPARE[type(f)]: c(a, v) or c(b, v)))
            else:
                yield f

    def wanted(self, name: str, value) -> bool:
        return all(test(value) for n, test, _ in self.tests if n == name)

    def wanted_in(self, first: int, last: int) -> bool:
        """Whether pages from `first` to `last` may be wanted."""
        return all(test(first, last) for n, _, test in self.tests if n == "offset")

    def partitions(self):
        from pyarrow import fs

        store, top = _opened(self.path)
        found = []
        # Folder names and not contents; of listings that no filter wants, not even the names inside.
        for a in store.get_file_info(fs.FileSelector(top)):
            listing = unquote(a.base_name.removeprefix("listing="))
            if not a.base_name.startswith("listing=") or not self.wanted("listing", listing):
                continue
            for b in store.get_file_info(fs.FileSelector(a.path)):
                if not b.base_name.startswith("offset="):
                    continue
                span = re.fullmatch(r"offset=(-?\d+)(?:-(\d+))?", b.base_name)
                if not span:
                    raise ValueError(f"{b.path}: the folder's name has no offset")
                first, last = int(span[1]), int(span[2] or span[1])
                if not self.wanted_in(first, last):
                    continue
                files = tuple(sorted(f.path for f in store.get_file_info(fs.FileSelector(b.path)) if f.is_file and not f.base_name.startswith((".", "_"))))
                found.append(Folder(listing, first, last, files))
        return found or [Folder("", 0, 0, ())]

    def read(self, partition):
        """Rows of a folder's pages: the whole row as JSON, and its id where it has one.

        A reply that doesn't parse or has no rows is an error, and one that doesn't say which of its folder's pages it is.
        """
        store = _opened(self.path)[0]
        names = ["listing", "offset", "matched", "n_rows", "place", "id", "row"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for file in partition.files:
            with store.open_input_stream(file) as f:
                lines = [x for x in f.read().split(b"\n") if x.strip()]
            for line in lines:
                reply = json.loads(line)
                meta = reply.get("meta") or {}
                rows, matched, offset = reply.get("rows"), meta.get("matched"), partition.first
                if partition.last != partition.first:
                    offset = meta.get("offset")
                    if type(offset) is not int or not partition.first <= offset <= partition.last:
                        raise ValueError(f"{file}: the reply's offset {offset!r} is not of its folder")
                    if not self.wanted("offset", offset):
                        continue
                if not isinstance(rows, list):
                    raise ValueError(f"{file}: the reply has no rows")
                told = [(partition.listing, offset, matched, len(rows), k, None if r.get(self.ident) is None else str(r[self.ident]), json.dumps(r, ensure_ascii=False)) for k, r in enumerate(rows)]
                # A page without rows still says how many there are.
                told = told or [(partition.listing, offset, matched, 0, None, None, None)]
                for i in range(0, len(told), _BATCH):
                    part = list(zip(*told[i : i + _BATCH]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types)], names=names)


class Listings(DataSource):
    """`recorded_listings`: options `path`, and `id`, the field that names a row."""

    @classmethod
    def name(cls):
        return "recorded_listings"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], self.options.get("id", "id"))


def listings(spark: SparkSession, path: str, ident: str = "id") -> DataFrame:
    """The rows of every recorded page below `path`; filters on `listing` and `offset` reach the reader.

    Spark keeps what a Python reader has planned with the loaded table and plans anew when filters are pushed, so there is always one:
    offsets are never negative. In one query, the table should be filtered in one way; for another, load it again.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listings)
    return spark.read.format("recorded_listings").option("path", path).option("id", ident).load().where("offset >= 0")


def record(rows: DataFrame, path: str, listing: str, order: Column, ident: str, page_rows: int, matched: Column, folder_pages: int = 1) -> None:
    """Writes `rows` as the replies that a paged listing gives: `page_rows` rows a page, in order, with the count it says it has.

    A page is a group, which is small, and one line of JSON. A folder holds `folder_pages` pages: where there are very many pages,
    folders and files of one page each take far longer than their rows.
    """
    place = F.row_number().over(Window.partitionBy(listing).orderBy(order)) - 1
    row = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"})
    placed = rows.select(F.col(listing).alias("listing"), place.cast("bigint").alias("at"), row.alias("r"), matched.cast("bigint").alias("matched"))
    start = lambda n: F.col("at") - F.col("at") % n
    width = page_rows * folder_pages
    span = (start(width), F.lit("-"), start(width) + (width - 1))[: 3 if folder_pages > 1 else 1]
    placed = placed.withColumn("folder", F.concat(*[c.cast("string") for c in span])).withColumn("offset", start(page_rows))
    # Dealt by folder once: its pages are groups inside, and it becomes one file.
    pages = placed.repartition("listing", "folder").groupBy("listing", "folder", "offset").agg(F.array_sort(F.collect_list(F.struct("at", "r"))).alias("x"), F.first("matched").alias("m"))
    meta = F.to_json(F.struct("offset", F.col("m").alias("matched")), {"ignoreNullFields": "false"})
    reply = F.concat(F.lit('{"meta":'), meta, F.lit(',"rows":['), F.array_join(F.col("x.r"), ","), F.lit("]}"))
    pages.select("listing", F.col("folder").alias("offset"), reply.alias("value")).write.partitionBy("listing", "offset").text(path)


def followed(pages: DataFrame, max_pages: int) -> DataFrame:
    """`pages` with `page`, and of them what a reader gets that asks page after page; each id once, where it came first.

    A reader asks for the first page at offset 0 and goes on behind the rows it was given. It stops at `max_pages`, once it has as many
    rows as the listing says there are, after an empty page, and after a page without an id that is new. A row without an id counts as new.
    A page is known by few numbers, so the rules are windows over pages and not rows; what is new is settled in groups of one id.
    """
    # A row without an id is a group of its own, so that such rows are no task's sort.
    name = F.coalesce(F.concat(F.lit("i"), "id"), F.concat_ws(" ", F.lit("n"), "offset", "place"))
    met = F.row_number().over(Window.partitionBy("listing", name).orderBy("offset", "place"))
    rows = pages.withColumn("new", F.col("place").isNotNull() & (met == 1))
    each = rows.groupBy("listing", "offset").agg(F.max("matched").alias("m"), F.max("n_rows").alias("k"), F.max("new").alias("new"))
    turn = Window.partitionBy("listing").orderBy("offset")
    each = each.withColumn("page", F.row_number().over(turn) - 1)
    # What the page before says of this one: that it begins where that one ended, and that there is more.
    before = lambda c: F.lag(c).over(turn)
    goes_on = (before(F.col("offset") + F.col("k")) == F.col("offset")) & (before("k") > 0) & before("new") & F.coalesce(before("m") > F.col("offset"), F.lit(True))
    ok = F.when(F.col("page") == 0, F.col("offset") == 0).otherwise(goes_on) & (F.col("page") < max_pages)
    each = each.withColumn("ok", F.min(ok).over(turn)).where("ok").select(F.col("listing").alias("_l"), F.col("offset").alias("_o"), "page")
    found = rows.where("new").join(each, F.col("listing").eqNullSafe(F.col("_l")) & (F.col("offset") == F.col("_o")))
    return found.select("listing", "page", "offset", "place", "id", "row")
