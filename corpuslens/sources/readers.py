"""Readers of record files.  All are lazy and take explicit schemas; bad files and rows have defined outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuslens import schema
from corpuslens.functions import text as X
from corpuslens.operators.relational import first_per_key


def article_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Article records of JSON-array files; the first file in path order, then the first row, wins a URL.  A file that is no
    list of records has no URL and gives nothing."""
    rows = spark.read.schema(schema.ARTICLE_RECORD).option("multiLine", True).json(paths)
    tagged = rows.select("*", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_pos"))
    return first_per_key(tagged.where("url is not null"), ["url"], ["_path", "_pos"]).drop("_path", "_pos")


def annotations(spark: SparkSession, path: str, set_columns: Sequence[str] = ("position_types", "embedded_assumptions")) -> DataFrame:
    """Annotator CSV with a header; ;-separated columns become sorted sets of trimmed values; the last row of an id wins."""
    rows = spark.read.schema(schema.ANNOTATION).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = first_per_key(rows.withColumn("_pos", F.monotonically_increasing_id()), ["article_id"], [F.desc("_pos")]).drop("_pos")
    for c in set_columns:
        parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), F.trim)
        rows = rows.withColumn(c, F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))))
    return rows


def sniffed_csv(spark: SparkSession, path: str, columns: str, whole: Sequence[str] = ()) -> DataFrame:
    """CSV whose delimiter is a tab if one is in its first 500 characters, else a comma; whole columns read bad numbers as 1
    and missing ones as 0."""
    head = spark.read.text(path).limit(20).collect()
    sep = "\t" if "\t" in "\n".join(r[0] for r in head)[:500] else ","
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    for c in whole:
        rows = rows.withColumn(c, F.when(F.coalesce(F.trim(c), F.lit("")) == "", 0).otherwise(F.coalesce(F.col(c).try_cast("long"), F.lit(1))))
    return rows.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in columns.split(", ")))


@dataclass
class Topic:
    """A topic's configuration; windows: name → (label, start, end)."""

    name: str
    slug: str
    windows: dict[str, dict[str, str]]
    queries: dict[str, object]
    event_type: str = ""
    description: str = ""
    more: dict[str, object] = field(default_factory=dict)


def topic(text: str) -> Topic:
    import yaml

    raw = yaml.safe_load(text) or {}
    missing = [k for k in ("name", "slug", "windows", "queries") if not raw.get(k)]
    if missing:
        raise ValueError(f"topic lacks {', '.join(missing)}")
    known = {k: raw.pop(k) for k in ("name", "slug", "windows", "queries", "event_type", "description") if k in raw}
    return Topic(**known, more=raw)


_RSS = "struct<channel:struct<item:array<{0}>>,item:array<{0}>>".format("struct<title:array<string>,link:array<string>,pubDate:array<string>,description:array<string>,enclosure:array<struct<_url:string,_type:string>>,duration:array<string>>")
_ATOM = "struct<entry:array<struct<title:array<string>,link:array<struct<_href:string>>,published:array<string>,updated:array<string>,summary:array<string>>>>"


def _first(values: str) -> Column:
    return F.trim(F.coalesce(F.get(values, F.lit(0)), F.lit("")))


def _items(df: DataFrame, xml: str, kind: str, path: Column) -> DataFrame:
    read = F.from_xml(xml, kind, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return df.select("doc", read.alias("x")).select("doc", F.posexplode(path).alias("pos", "i")).select("doc", "pos", "i.*")


def _rss(df: DataFrame, xml: str) -> DataFrame:
    i = _items(df, xml, _RSS, F.coalesce("x.channel.item", "x.item"))
    enclosure = F.get("enclosure", F.lit(0))
    audio = F.when(F.coalesce(enclosure["_type"], F.lit("")).contains("audio") | (F.coalesce(enclosure["_type"], F.lit("")) == ""), enclosure["_url"])
    duration = F.trim(F.coalesce(F.element_at("duration", -1), F.lit("")))
    return i.select("doc", "pos", _first("title").alias("title"), _first("link").alias("link"), F.coalesce(audio, F.lit("")).alias("enclosure"), _first("pubDate").alias("published"), _first("description").alias("description"), duration.alias("duration_text"))


def feed_items(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Items with a title and a link of RSS documents (columns doc and xml), or of Atom documents that have no such RSS item.
    Fields are read item by item, so one that lacks a field has ''; a document that is no XML has no items."""
    rss = _rss(df, xml).where("title <> '' and link <> ''").select("doc", "pos", "title", "link", "published", "description")
    i = _items(df, xml, _ATOM, F.col("x.entry"))
    published = F.coalesce(F.nullif(_first("published"), F.lit("")), _first("updated"))
    atom = i.select("doc", "pos", _first("title").alias("title"), F.trim(F.coalesce(F.get("link", F.lit(0))["_href"], F.lit(""))).alias("link"), published.alias("published"), _first("summary").alias("description"))
    return rss.unionByName(atom.where("title <> '' and link <> ''").join(rss.select("doc").distinct(), "doc", "left_anti"))


def podcast_items(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Episodes with a title and an audio enclosure; the address is the link or else the audio's; descriptions of 300 characters,
    durations as text and in seconds (null if they cannot be read)."""
    i = _rss(df, xml).where("title <> '' and enclosure <> ''")
    url = F.coalesce(F.nullif("link", F.lit("")), "enclosure")
    return i.select("doc", "pos", "title", url.alias("url"), F.col("enclosure").alias("audio_url"), "published", F.left("description", F.lit(300)).alias("description"), "duration_text", X.duration_seconds("duration_text").alias("duration_seconds"))


def institutional_articles(df: DataFrame) -> DataFrame:
    """One article for each country of a record and one for its chair."""
    each = df.select("doc_id", "date", F.explode("country_positions").alias("p")).select("doc_id", "date", "p.country", "p.position_summary", "p.speaker")
    chair = df.where("chair is not null").select("doc_id", "date", F.lit("chair").alias("country"), "chair.position_summary", F.lit(None).cast("string").alias("speaker"))
    return each.unionByName(chair)


def entities(df: DataFrame, column: str = "body") -> DataFrame:
    """Entities of REST answers, a bare list or wrapped in data, results or items; keys fall back, counts default to 0."""
    shape = "array<map<string,string>>"
    tries = [F.from_json(column, shape), *(F.from_json(F.get_json_object(column, f"$.{k}"), shape) for k in ("data", "results", "items"))]
    bare = F.when(F.trim(column).startswith("["), tries[0])
    e = df.select(F.explode(F.coalesce(bare, *tries[1:])).alias("e"))
    get = lambda *keys: F.coalesce(*(F.try_element_at("e", F.lit(k)) for k in keys))
    return e.select(get("name", "title").alias("name"), get("entity_type", "type").alias("entity_type"), F.coalesce(get("document_count", "doc_count", "documents").try_cast("long"), F.lit(0)).alias("doc_mentions")).where("name is not null")


def failed_urls(lines: DataFrame) -> DataFrame:
    """URLs whose fetch failed by a log (pos, value): the last URL named before each failure line."""
    from pyspark.sql import Window

    url = F.regexp_extract("value", r"(https?://\S+)", 1)
    seen = lines.withColumn("_u", F.when(url != "", url)).withColumn("_last", F.last("_u", True).over(Window.partitionBy("log").orderBy("pos")))
    return seen.where(F.lower("value").contains("failed")).select(F.col("_last").alias("url")).where("url is not null").distinct()


class Page(NamedTuple):
    """One answer of a paged API: rows (url, title, published), how many the query has in all, the quota left, the HTTP status."""

    rows: Sequence[tuple]
    found: int | None = None
    quota_left: float | None = None
    status: int = 200


class PagedApi(DataSource):
    """A paged record API as a batch source.

    client: one or more Python callables by name (module:function, parted by |), called with query, window and page; each gives a
    Page or a list of rows, or raises.  A client is asked attempts times (2), wait seconds (3) apart; 429 is waited for once more, 402
    and a quota below quota_floor (5) make the next client take over for good, any other failure for that page only.  A slice (query
    and window) ends without rows, after pages (10), or at page >= found / page_size.  An address is given once a slice.

    Slices are partitions of their own unless budget caps the calls of all of them: then one partition holds them in order, as only
    one reader can count."""

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "query string, `window` string, url string, title string, published string"

    def reader(self, _schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _Slices(InputPartition):
    def __init__(self, slices: list[tuple[str, str]]):
        super().__init__(str(slices))
        self.slices = slices


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.clients = options["client"].split("|")
        self.pages, self.page_size = int(options.get("pages", "10")), float(options.get("page_size", "3"))
        self.attempts, self.wait, self.floor = int(options.get("attempts", "2")), float(options.get("wait", "3")), float(options.get("quota_floor", "5"))
        self.budget = int(options["budget"]) if "budget" in options else None
        self.slices = [(q, w) for q in options.get("queries", "").split("|") if q for w in options.get("windows", "all").split("|")]

    def partitions(self) -> list[InputPartition]:
        return [_Slices(self.slices)] if self.budget is not None else [_Slices([s]) for s in self.slices]

    def read(self, partition: _Slices) -> Iterator[tuple]:
        calls = _Calls(self)
        for query, window in partition.slices:
            seen: set[str] = set()
            for page in range(1, self.pages + 1):
                got = calls.page(query, window, page)
                if got is None or not got.rows:
                    break
                for url, title, published in got.rows:
                    if url and url not in seen:
                        seen.add(url)
                        yield query, window, url, title, published
                if got.found is not None and page >= got.found / self.page_size:
                    break


class _Calls:
    """The calls of one reader: who answers, how many were made."""

    def __init__(self, options: _PagedReader):
        import importlib

        self.o, self.made, self.current = options, 0, 0
        self.clients: list[Callable] = [getattr(importlib.import_module(m), f) for m, f in (c.split(":") for c in options.clients)]

    def page(self, query: str, window: str, page: int) -> Page | None:
        at = self.current
        while at < len(self.clients):
            got = self._ask(self.clients[at], query, window, page)
            if got is not None and got.status == 402 or got is not None and got.quota_left is not None and got.quota_left < self.o.floor:
                self.current = max(self.current, at + 1)
            if got is not None and got.status == 200:
                return got
            at += 1
        return None

    def _ask(self, client: Callable, query: str, window: str, page: int) -> Page | None:
        import time

        got = None
        for attempt in range(self.o.attempts):
            if self.o.budget is not None and self.made >= self.o.budget:
                return None
            self.made += 1
            try:
                got = client(query, window, page)
                got = got if isinstance(got, Page) else Page(got)
                if got.status != 429:
                    return got
            except Exception:  # noqa: BLE001  a client may raise anything; the last failure hands over
                got = None
            if attempt + 1 < self.o.attempts:
                time.sleep(self.o.wait)
        return got
