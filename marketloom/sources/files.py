"""Readers and writers of the formats that the run works with."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

PRICE_CSV = "Date string, Open double, High double, Low double, Close double, Volume long"
RSS_ITEM = "title string, link string, description string, pubDate string, source string"
AUDIT = "timestamp string, feature string, operation string, status string, symbol string, duration_ms double"
# Tags whose text is no part of an article, and blocks that end a line.
HIDDEN_TAGS = ["script", "style", "noscript", "template", "svg", "nav", "footer", "header", "aside", "form"]
BLOCK_TAGS = ["p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "article", "section", "blockquote"]


def read_prices_csv(spark: SparkSession, path: str, schema: str = PRICE_CSV, renames: dict[str, str] | None = None) -> DataFrame:
    """Price history with dates parsed; rows without a date go; columns are lower-case."""
    rows = spark.read.csv(path, header=True, schema=schema)
    for old, new in (renames or {}).items():
        rows = rows.withColumnRenamed(old, new)
    rows = rows.withColumn("Date", F.to_date(F.try_to_timestamp(F.col("Date"))))
    return rows.where("Date is not null").select(*(F.col(c).alias(c.lower()) for c in rows.columns))


def write_report_csv(df: DataFrame, path: str) -> None:
    """One report table with a header; reports are small, so one file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_keep_last(current: DataFrame, more: DataFrame, order: str, n: int = 1000) -> DataFrame:
    """Both, of which the newest ``n`` rows stay."""
    return current.unionByName(more).orderBy(F.desc(order)).limit(n)


def write_run_table(df: DataFrame, path: str, by: str = "run_id") -> None:
    """Replace the partitions that ``df`` has, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_hypertable(df: DataFrame, path: str, time: str = "date_recorded", chunk: str = "month") -> None:
    """Time-series rows in chunks by month or week; each chunk is written by its own tasks."""
    rows = df.withColumn("chunk", F.date_trunc(chunk, F.col(time)).cast("date"))
    rows.repartition("chunk").sortWithinPartitions(time).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def read_audit_log(spark: SparkSession, path: str, since: str) -> DataFrame:
    """JSON lines from ``since`` on; lines that are no JSON are left out."""
    rows = spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("timestamp", F.try_to_timestamp(F.col("timestamp"))).where(F.col("timestamp") >= F.lit(since).cast("timestamp"))


def write_artifact_json(df: DataFrame, path: str) -> None:
    """JSON lines with fields in sorted order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of feeds: title, link, description, source and the time published."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    when = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    gmt = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3},\s*|\s*GMT$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    return rows.select(F.trim("title").alias("title"), F.trim("link").alias("canonical_url"), F.trim("description").alias("snippet"), "source", F.coalesce(when, gmt).alias("published_at")).where("title is not null and canonical_url is not null")


def flatten_payload(raw: DataFrame, column: str, schema: str, items: str, fields: dict[str, str]) -> DataFrame:
    """One row per item of a JSON API payload; ``fields`` maps our names to paths in an item."""
    body = F.from_json(F.col(column), schema)
    rows = raw.select(F.explode(body[items]).alias("item"))
    return rows.select(*(F.col(f"item.{path}").alias(name) for name, path in fields.items()))


def zip_filings(rows: DataFrame, key: str, arrays: list[str], keep: Column, most: int) -> DataFrame:
    """Parallel arrays as rows, filtered, at most so many for each key in order."""
    flat = rows.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "f")).select(key, "pos", "f.*").where(keep)
    return flat.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_r") <= most).drop("_r")


def page_title(html) -> Column:
    """The text of a page's ``<title>``: empty without one, null for a null page; only whole entities are read, so a title cut inside one keeps its rest."""
    title = F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(title, r"[\t\n\f\r ]+", " "))


class _Article(HTMLParser):
    """Collects title, meta tags and visible text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.text, self.inside, self.hidden = "", {}, [], "", 0

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag == "title":
            self.inside = "title"
        elif tag == "meta" and (name := given.get("property") or given.get("name")):
            self.meta.setdefault(name.lower(), given.get("content") or "")
        if tag in BLOCK_TAGS:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN_TAGS and self.hidden:
            self.hidden -= 1
        elif tag == "title":
            self.inside = ""
        if tag in BLOCK_TAGS:
            self.text.append("\n")

    def handle_data(self, data):
        if self.inside == "title":
            self.title += data
        elif not self.hidden:
            self.text.append(data)


def parse_html(html: str | None) -> tuple[str, str, str, str]:
    """(title, author, site, text) of a page; lines are trimmed and empty ones left out."""
    page = _Article()
    page.feed(html or "")
    page.close()
    lines = (" ".join(x.split()) for x in "".join(page.text).split("\n"))
    title = page.meta.get("og:title") or page.title
    return " ".join(title.split()), page.meta.get("author", ""), page.meta.get("og:site_name", ""), "\n".join(x for x in lines if x)


#: Pages whose strings are in a worker at once; the rest of a batch stays as Arrow has it.
PARSED_AT_ONCE = 64
PARSED = pa.struct([(x, pa.string()) for x in ("title", "author", "site", "body")])


def parsed_parts(column: pa.Array) -> Iterator[pa.Array]:
    """``parse_html`` of a batch, a few pages at a time."""
    for low in range(0, len(column), PARSED_AT_ONCE):
        rows = [parse_html(x) for x in column.slice(low, PARSED_AT_ONCE).to_pylist()]
        yield pa.array([dict(zip(PARSED.names, r)) for r in rows], PARSED)


def extract_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``title, author, site, body`` read from the HTML."""

    @F.arrow_udf("title string, author string, site string, body string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.chunked_array(parsed_parts(column), PARSED).combine_chunks()

    return pages.withColumn("_x", extract(html)).select(*pages.columns, "_x.*")
