"""Views of the driver's tables in the shape of posts, feeds, vectors and requests.

Every view is derived by Spark from the tables of one folder and grows with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwood.cluster import scratch_path, spread_small, use_utc
from siftwood.functions.text import tokenize
from siftwood.mapping import Mapping, POST_FIELDS
from siftwood.operators.numbering import page_rows
from siftwood.operators.projections import map_columns
from siftwood.sinks.files import write_jsonl

POST_MAPPER = {"number": "docid", "full_name": "title", "body_md": "body"}
MAPPING = Mapping(POST_FIELDS, dims=64)

# Letters of the documents as kana and kanji, to get unspaced text of any size.
LATIN = "abcdefghijklmnopqrstuvwxyz"
JAPANESE = "あいうえおかきくけこさしすせアイウエオ日本語文書検索"

_written: dict[tuple, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    """A table of long texts, dealt to all cores where its file is one split."""
    return spread_small(table(spark, sf, name))


def once(spark: SparkSession, sf: str, label: str, write) -> str:
    """A scratch folder filled by ``write(path)`` once per session and input."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _written:
        path = scratch_path(spark, label)
        write(path)
        _written[key] = path
    return _written[key]


def _post_columns(of: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """The columns of a post by name; ``of`` gives a column of its document and event."""
    number = of("doc_id").cast("string")
    columns = {
        "number": number,
        "name": F.lit(None).cast("string"),
        "full_name": F.substring_index(of("text"), ".", 1),
        "wip": of("event_type") == "error",
        "body_md": of("text"),
        "body_html": F.lit(None).cast("string"),
        "created_at": of("ts").cast("timestamp"),
        "updated_at": of("ts").cast("timestamp"),
        "url": F.concat(F.lit("https://posts.example/"), number),
        "created_by": F.concat(F.lit("user_"), of("user_id").cast("string")),
    }
    return {name: column.alias(name) for name, column in columns.items()}


def posts(spark: SparkSession, sf: str) -> DataFrame:
    # Titles are cut before the join: where bodies are not read, no text is shuffled.
    docs = texts(spark, sf).withColumn("title", F.substring_index("text", ".", 1))
    events = table(spark, sf, "events")
    columns = _post_columns() | {"full_name": F.col("title").alias("full_name")}
    return docs.join(events, docs.doc_id == events.event_id).select(*columns.values())


def revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event revises one post; ``arrival`` is the event's number."""
    docs, events = texts(spark, sf), table(spark, sf, "events")
    owner = events.withColumn("owner", F.col("event_id") % docs.count())
    return owner.join(docs, owner.owner == docs.doc_id).select(
        *_post_columns().values(), F.col("event_id").alias("arrival")
    )


def nested_author(df: DataFrame) -> DataFrame:
    return df.withColumn("created_by", F.struct(F.col("created_by").alias("screen_name")))


def feed_pages(spark: SparkSession, sf: str) -> str:
    """Folder of page envelopes as JSON lines, 100 posts to a page."""

    def write(path: str) -> None:
        write_jsonl(envelopes(revision_keys(spark, sf), table(spark, sf, "documents")), path, compression="gzip")

    return once(spark, sf, "feed", write)


def crawled_pages(spark: SparkSession, sf: str) -> str:
    """The same posts as two crawls, a folder each, that both start at page 1."""

    def write(path: str) -> None:
        keys, docs = revision_keys(spark, sf), table(spark, sf, "documents")
        early = F.col("ts").cast("timestamp") < F.lit("2024-01-15 12:00:00").cast("timestamp")
        for crawl, part in (("1", keys.where(early)), ("2", keys.where(~early))):
            write_jsonl(envelopes(part, docs), f"{path}/crawl={crawl}", compression="gzip")

    return once(spark, sf, "crawls", write)


def revision_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``revisions`` without their texts: of a document that comes
    several times a row for each ``copy``."""
    docs = table(spark, sf, "documents").select("doc_id")
    owner = table(spark, sf, "events").select(
        "ts", "user_id", "event_type", (F.col("event_id") % docs.count()).alias("doc_id"), F.col("event_id").alias("arrival")
    )
    copies = docs.groupBy("doc_id").agg(F.count("*").cast("int").alias("copies"))
    return owner.join(copies, "doc_id").select(*owner.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def _pressed(text: Column) -> Column:
    @F.pandas_udf("binary")
    def press(values: pd.Series) -> pd.Series:
        return values.map(lambda t: zlib.compress(t.encode()), na_action="ignore").astype(object)

    return press(text)


def _unpressed(pressed: Column) -> Column:
    @F.pandas_udf("array<string>")
    def unpress(values: pd.Series) -> pd.Series:
        return values.map(lambda page: [None if b is None else zlib.decompress(b).decode() for b in page])

    return unpress(pressed)


def envelopes(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages of 100 posts in the order of their revisions. Pages are numbered before
    the texts come in, and a text is pressed once for all of its revisions: the
    shuffle to pages is the only one that holds a text per revision."""
    pages = -(-keys.count() // 100)
    updated = F.col("ts").cast("timestamp")
    paged = page_rows(keys.withColumn("updated_at", updated), ["updated_at", "arrival"], 100)
    texts = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id",
        _pressed(F.col("text")).alias("pressed"),
        F.row_number().over(W.partitionBy("doc_id").orderBy("doc_id")).alias("which"),
    )
    placed = paged.join(texts, "doc_id").where("copy = which")
    row = F.struct("n", "doc_id", "ts", "user_id", "event_type", "pressed")

    def post(r: Column, text: Column) -> Column:
        columns = [c for name, c in _post_columns(lambda c: text if c == "text" else r[c]).items() if name != "name"]
        author = F.struct(columns.pop().alias("screen_name")).alias("created_by")
        return F.struct(*columns, author)

    return (
        placed.groupBy("page")
        .agg(F.array_sort(F.collect_list(row)).alias("rows"))
        .withColumn("texts", _unpressed(F.transform("rows", lambda r: r["pressed"])))
        .select(
            F.col("page").cast("int").alias("page"),
            F.zip_with("rows", "texts", post).alias("posts"),
            F.when(F.col("page") < pages, (F.col("page") + 1).cast("int")).alias("next_page"),
        )
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def index_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = map_columns(posts(spark, sf), POST_MAPPER)
    vecs = vectors(spark, sf).withColumn("docid", F.col("doc_id").cast("string")).drop("doc_id")
    return docs.join(vecs, "docid", "left").select(*MAPPING.fields)


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    pos = (F.col("vec_id") % 8).cast("int")
    return e.select(
        F.floor(F.col("vec_id") / 8).alias("doc_id"),
        pos.alias("pos"),
        F.when((F.col("label") == 0) & (pos > 0), 0).otherwise(1).alias("mask"),
        F.col("embedding").alias("vec"),
    )


def record_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Index records, some of them damaged by a rule on the vector's label."""
    e = table(spark, sf, "embeddings")
    docs = map_columns(posts(spark, sf), POST_MAPPER).drop("vec")
    vec = (
        F.when(F.col("label") == 3, F.slice("embedding", 1, 32))
        .when(F.col("label") == 7, F.transform("embedding", lambda x: F.lit(0).cast("float")))
        .otherwise(F.col("embedding"))
    )
    damaged = e.select(F.col("vec_id").cast("string").alias("docid"), vec.alias("vec"), "label")
    return docs.join(damaged, "docid", "left").select(
        F.when(F.coalesce(F.col("label") != 5, F.lit(True)), F.col("docid")).alias("docid"), "url", "vec"
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every clause of every benchmark text is one request; its settings vary
    with its number, its vector is the one numbered like the text."""
    bench, vecs = table(spark, sf, "benchmark"), vectors(spark, sf)
    clauses = bench.select("item_id", F.posexplode(F.split("text", "[.,\n]")).alias("pos", "query"))
    qid = F.col("item_id") * 1000 + F.col("pos")
    fields = (
        F.when(qid % 3 == 1, F.array(F.lit("body")))
        .when(qid % 3 == 2, F.array(F.lit("title"), F.lit("url")))
        .otherwise(F.lit(None))
    )
    return clauses.join(vecs.withColumnRenamed("doc_id", "item_id"), "item_id").select(
        qid.alias("qid"),
        F.trim("query").alias("query"),
        (5 + qid % 20).cast("int").alias("topk"),
        (qid % 4).cast("int").alias("from_"),
        (3 + qid % 7).cast("int").alias("size"),
        (qid % 2 == 0).alias("hybrid"),
        fields.cast("array<string>").alias("search_fields"),
        "vec",
    )


def keyword_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per document: its number, or every other time its address."""
    doc_id = F.col("doc_id")
    address = F.concat(F.lit("https://posts.example/"), doc_id.cast("string"))
    return table(spark, sf, "documents").select(
        doc_id.alias("qid"), F.when(doc_id % 2 == 0, doc_id.cast("string")).otherwise(address).alias("query")
    )


def request_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Search page addresses of the requests; each fifth leaves settings out."""
    r = requests(spark, sf)
    given = F.col("qid") % 5 != 0
    arg = lambda name, value: F.concat(F.lit(f"&{name}="), value.cast("string"))
    url = F.concat(
        F.lit("/search?query="),
        F.url_encode("query"),
        arg("hybrid", F.col("hybrid").cast("int")),
        F.when(given, F.concat(arg("topk", F.col("topk")), arg("from", F.col("from_")), arg("size", F.col("size")))).otherwise(""),
        F.when(F.col("search_fields").isNotNull(), arg("search_fields", F.array_join("search_fields", ","))).otherwise(""),
    )
    return r.select("qid", url.alias("url"))


def markdown_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written up as Markdown: heading, emphasis, code, quote, lists,
    link, image, table, fence and entities around and inside the whole text."""
    text = F.regexp_replace("text", r", (\p{L}+)", ", **$1**")
    text = F.regexp_replace(text, r" (\p{L}+)\.", " _$1_.")
    text = F.regexp_replace(text, r"\n(\p{L}+)", "\n`**$1`")
    body = F.concat(
        F.lit("# About "), F.col("source"), F.lit(" #\n\n"), text,
        F.lit("\n\nLanguage\n--------\n> quoted "), F.col("lang"),
        F.lit("\n\n- first [**"), F.col("source"), F.lit("**](https://docs.example/a_b)\n2. "),
        F.lit("![logo](x.png) <b>bold</b> a &lt; b &amp;amp; c\n\n| name | size |\n|:-----|-----:|\n| "),
        F.col("source"), F.lit(" | "), F.col("n_chars").cast("string"),
        F.lit(" |\n\n***\n```sql\n# not a heading\nselect **\n```\nend *"), F.col("lang"), F.lit("*\n"),
    )
    return texts(spark, sf).select("doc_id", body.alias("text"))


def japanese_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with Latin letters turned to kana and kanji; accented letters,
    digits and punctuation stay and mix in."""
    return texts(spark, sf).select(
        "doc_id", F.translate(F.lower("text"), LATIN, JAPANESE).alias("text"), "lang"
    )


def wide_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a part of the alphabet in full width."""
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "aeinstAEINST0123456789")
    return texts(spark, sf).select(
        "doc_id", F.translate("text", "aeinstAEINST0123456789", wide).alias("text"), "lang"
    )


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """One collection run per day of events; it failed if the day has more
    than twice as many errors as purchases."""
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    days = e.groupBy("day").agg(
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.max("event_id").alias("run_no"),
    )
    return days.select(
        "run_no",
        F.col("day").alias("executed_at"),
        F.col("day").alias("last_updated_at"),
        F.when(F.col("errors") > 2 * F.col("purchases"), "error").otherwise("success").alias("exit_status"),
    )
