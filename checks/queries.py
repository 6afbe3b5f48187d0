"""One query per operator, each over the whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood import fixtures as fx
from siftwood.cluster import materialise, scratch_path
from siftwood.functions import encoders, text
from siftwood.functions.vectors import unit_vector
from siftwood.index import Index
from siftwood.operators import index as ix
from siftwood.operators import cells, ingest, neighbours, numbering, projections, ranking, terms
from siftwood.plans import build, collect, search, segments
from siftwood.sinks import bucket_store, files, index_store
from siftwood.sources import readers
from siftwood.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TEXT = ["title", "body"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- helpers ----------------------------------------------------------------


def day(col: str = "updated_at") -> Column:
    return F.date_format(col, "yyyy-MM-dd").alias("day")


def stamp(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(col)


def components(df: DataFrame, key: str) -> DataFrame:
    """Vector rows as (key, pos, value)."""
    return df.select(key, F.posexplode("vec").alias("pos", "value")).select(
        key, "pos", F.round(F.col("value").cast("double"), 6).alias("value")
    )


def term_list(df: DataFrame, tokens: Column) -> DataFrame:
    """Per document: the number of terms, and all of them in order."""
    return df.select("doc_id", tokens.alias("tokens")).select(
        "doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("terms")
    )


_indexes: dict[tuple, Index] = {}


def _buckets(spark, sf) -> int:
    return build.buckets_for(spark, fx.table(spark, sf, "documents").count())


def _build(spark, sf, docs: DataFrame, root: str, alias: str, analyzer: str = "terms", **more) -> dict[str, int]:
    buckets = _buckets(spark, sf)
    return build.build_index(spark, docs, fx.MAPPING, root, alias, analyzer, term_buckets=4, doc_buckets=buckets, **more)


def _index(spark: SparkSession, sf: str, alias: str, make: Callable[[str], object]) -> Index:
    """Searches read a published index; it is built and opened once per session
    and input."""
    key = (spark.sparkContext.applicationId, sf, alias)
    if key not in _indexes:
        root = scratch_path(spark, f"index-{alias}")
        make(root)
        _indexes[key] = build.load_index(spark, root, alias)
    return _indexes[key]


def posts_index(spark: SparkSession, sf: str) -> Index:
    """Posts as they are, with the vectors of the embeddings table."""
    fx.use_utc(spark)
    return _index(spark, sf, "posts", lambda root: _build(spark, sf, fx.index_docs(spark, sf), root, "posts"))


def blocked_index(spark: SparkSession, sf: str) -> Index:
    """Posts with their postings in blocks and their vectors in cells."""
    fx.use_utc(spark)
    make = lambda root: _build(spark, sf, fx.index_docs(spark, sf), root, "blocked", block_docs=32, cells=CELLS)
    return _index(spark, sf, "blocked", make)


def cleaned_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Load, rename, clean, encode, attach: the records of a full index build."""
    marked = fx.posts(spark, sf).drop("body_md").join(
        fx.markdown_docs(spark, sf).select(F.col("doc_id").cast("string").alias("number"), F.col("text").alias("body_md")),
        "number",
    )
    docs = projections.preprocess(
        projections.map_columns(marked, fx.POST_MAPPER), [lambda d: projections.strip_markdown(d, ["body"], keep_raw=False)]
    )
    # Read by the encoder and by the build: cleaned and shuffled once.
    docs = build.place_docs(docs, _buckets(spark, sf))
    vecs = encoders.encode(docs, "docid", text.doc_text(F.col("title"), F.col("body")))
    return build.attach_vectors(docs, vecs.withColumnRenamed("docid", "doc_id"))


def encoded_index(spark: SparkSession, sf: str) -> Index:
    """Cleaned posts under the full analyzer, with vectors of the hash encoder."""
    fx.use_utc(spark)
    make = lambda root: _build(spark, sf, cleaned_posts(spark, sf), root, "encoded", "full", placed=True)
    return _index(spark, sf, "encoded", make)


def encoded_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with their vector from the encoder; texts without terms drop out."""
    asked = fx.requests(spark, sf).select("qid", "query")
    return asked.join(encoders.encode(asked, "qid", F.col("query")), "qid")


def with_totals(results: search.Results) -> DataFrame:
    return results.totals.join(results.hits, "qid", "left").select("qid", "rank", "doc_id", "score", "total")


# --- scans and sources ------------------------------------------------------


@query
def read_jsonl(spark, sf):
    docs = fx.table(spark, sf, "documents")
    path = fx.once(spark, sf, "jsonl", lambda p: files.write_jsonl(docs, p))
    return readers.read_jsonl(spark, path, docs.schema)


@query
def conform_docs(spark, sf):
    title = F.when(F.col("lang") != "fr", F.col("source"))
    return projections.conform_docs(fx.table(spark, sf, "documents").withColumn("title", title))


@query
def read_table(spark, sf):
    fx.table(spark, sf, "documents").createOrReplaceTempView("siftwood_documents")
    return readers.read_table(spark, "siftwood_documents")


@query
def read_feed_pages(spark, sf):
    posts = readers.read_feed_pages(spark, fx.feed_pages(spark, sf))
    return posts.select(
        "page", "pos", "number", "full_name", "wip", F.col("body_md").alias("body"), stamp("updated_at"), "url",
        F.col("created_by.screen_name").alias("author"),
    )


@query
def incremental_scan(spark, sf):
    return ingest.incremental_scan(fx.revisions(spark, sf), fx.run_log(spark, sf)).select("number", "arrival", day())


@query
def page_rows(spark, sf):
    revisions = fx.revisions(spark, sf).select("number", "arrival", "updated_at")
    return numbering.page_rows(revisions, ["updated_at", "arrival"], 100).select("number", "arrival", "n", "page")


@query
def chunk_rows(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    return numbering.chunk_rows(docs, ["n_chars", "doc_id"], 64)


# --- sinks and state --------------------------------------------------------


@query
def write_jsonl(spark, sf):
    posts = fx.posts(spark, sf)
    path = fx.once(spark, sf, "posts-jsonl", lambda p: files.write_jsonl(posts, p))
    return _flat_posts(readers.read_jsonl(spark, path, posts.schema))


def _flat_posts(df: DataFrame) -> DataFrame:
    return df.select(
        "number", "name", "full_name", "wip", "body_md", "body_html",
        stamp("created_at"), stamp("updated_at"), "url", "created_by",
    )


@query
def upsert_posts(spark, sf):
    """All revisions of the long posts; the short ones stay."""
    changes = fx.revisions(spark, sf).where("length(body_md) >= 1500")
    return _flat_posts(ingest.upsert_posts(fx.posts(spark, sf), changes))


@query
def merge_buckets(spark, sf):
    """A store of all posts, merged twice: the revisions of one half of the keys, then all of the long ones."""
    def run(path: str) -> None:
        bucket_store.create_store(fx.posts(spark, sf), path, "number", 16)
        revisions = fx.revisions(spark, sf).where("length(body_md) >= 1500")
        bucket_store.merge_store(spark, path, revisions.where("crc32(number) % 2 = 0"), ["arrival"])
        bucket_store.merge_store(spark, path, revisions, ["arrival"])

    store = bucket_store.open_store(spark, fx.once(spark, sf, "store", run))
    return _flat_posts(store.read(spark))


@query
def collect_into(spark, sf):
    """The run of collect_run into a bucket store."""
    def run(path: str) -> None:
        fx.run_log(spark, sf).select(*[f.split()[0] for f in ingest.RUN_LOG.split(", ")]).write.parquet(f"{path}/runs")
        bucket_store.create_store(fx.posts(spark, sf), f"{path}/posts", "number", 16)
        collect.collect_into(spark, fx.feed_pages(spark, sf), f"{path}/posts", f"{path}/runs", "2024-02-01")

    return _flat_posts(bucket_store.open_store(spark, fx.once(spark, sf, "collected-into", run) + "/posts").read(spark))


@query
def collect_run(spark, sf):
    def run(path: str) -> None:
        fx.run_log(spark, sf).select(*[f.split()[0] for f in ingest.RUN_LOG.split(", ")]).write.parquet(f"{path}/runs")
        feed = fx.feed_pages(spark, sf)
        merged = collect.collect(spark, feed, fx.posts(spark, sf), f"{path}/runs", "2024-02-01")
        merged.write.parquet(f"{path}/posts")

    posts = fx.posts(spark, sf)
    return _flat_posts(spark.read.schema(posts.schema).parquet(fx.once(spark, sf, "collected", run) + "/posts"))


@query
def posts_schema(spark, sf):
    return _flat_posts(projections.conform_posts(fx.posts(spark, sf)))


@query
def publish_index(spark, sf):
    def write(root: str) -> None:
        docs = fx.index_docs(spark, sf).drop("vec")
        layout = {"docs": index_store.Layout(bucket_by="docid", sort_by=["docid"], buckets=8)}
        # An older version and another alias must not show through.
        index_store.publish_index(spark, root, "wiki", {"docs": docs.where("title < 'M'")}, 1, layout)
        index_store.publish_index(spark, root, "wiki", {"docs": docs}, 2, layout)
        index_store.publish_index(spark, root, "other", {"docs": docs.where("title >= 'M'")}, 3, layout)

    root = fx.once(spark, sf, "published", write)
    docs = index_store.open_index(spark, root, "wiki")["docs"]
    return docs.select("docid", "title", "body", "url", stamp("updated_at"))


@query
def crawl_state(spark, sf):
    return ingest.record_run(fx.revisions(spark, sf), "2024-02-01", "success")


@query
def validate_records(spark, sf):
    checked = projections.validate_records(fx.record_rows(spark, sf), fx.MAPPING)
    return checked.select("url", "docid", F.array_join("reasons", ", ").alias("reasons"))


# --- projections ------------------------------------------------------------


@query
def map_columns(spark, sf):
    mapper = {"doc_id": "docid", "lang": "source", "absent": "x", "text": "body"}
    return projections.map_columns(fx.table(spark, sf, "documents"), mapper)


@query
def flatten_author(spark, sf):
    nested = fx.nested_author(fx.posts(spark, sf))
    return projections.flatten_posts(nested).select("number", "full_name", "url", "created_by")


@query
def index_fields(spark, sf):
    docs = projections.map_columns(fx.posts(spark, sf), fx.POST_MAPPER).withColumn("body_raw", F.col("body"))
    kept = projections.index_fields(docs, fx.MAPPING)
    return kept.select(
        "docid", "title", "body", "url", stamp("created_at"), stamp("updated_at"), F.size("vec").alias("vec"),
        F.lit(len(kept.columns)).alias("fields"),
    )


@query
def doc_text(spark, sf):
    return fx.posts(spark, sf).select("number", text.doc_text(F.col("name"), F.col("full_name"), F.col("body_md")).alias("text"))


@query
def select_source(spark, sf):
    index = posts_index(spark, sf)
    hits = search.bm25_search(index, fx.requests(spark, sf).select("qid", "query"), TEXT).hits
    return ranking.select_source(hits, index.docs, ["title", "url"])


@query
def search_requests(spark, sf):
    parsed = projections.search_requests(fx.request_urls(spark, sf), "url")
    return parsed.withColumn("search_fields", F.array_join("search_fields", ","))


# --- cleaning and analysis --------------------------------------------------


@query
def strip_markdown(spark, sf):
    return projections.strip_markdown(fx.markdown_docs(spark, sf))


@query
def html_text(spark, sf):
    return projections.strip_html(fx.texts(spark, sf, "pages"), ["html"]).select("page_id", F.col("html").alias("text"))


@query
def preprocess_chain(spark, sf):
    steps = [
        lambda d: projections.strip_html(d, ["html"]),
        lambda d: projections.map_columns(d, {"html": "text"}),
        lambda d: projections.strip_markdown(d, ["text"], keep_raw=False),
    ]
    return projections.preprocess(fx.texts(spark, sf, "pages").drop("url"), steps)


@query
def tokenize(spark, sf):
    return term_list(fx.texts(spark, sf), text.tokenize(F.col("text")))


@query
def stop_filter(spark, sf):
    docs = fx.texts(spark, sf)
    return term_list(docs, text.stop_filter(text.tokenize(F.col("text")), F.col("lang")))


@query
def normalize_terms(spark, sf):
    return term_list(fx.wide_docs(spark, sf), text.normalize_terms(text.tokenize(F.col("text"))))


@query
def cjk_bigrams(spark, sf):
    return term_list(fx.japanese_docs(spark, sf), text.cjk_bigrams(F.col("text")))


@query
def analyze(spark, sf):
    docs = fx.japanese_docs(spark, sf).unionByName(
        fx.wide_docs(spark, sf).withColumn("doc_id", -1 - F.col("doc_id"))
    )
    return term_list(docs, text.analyze(F.col("text"), F.col("lang")))


# --- index build ------------------------------------------------------------


def _post_docs(spark, sf) -> DataFrame:
    return projections.map_columns(fx.posts(spark, sf), fx.POST_MAPPER)


@query
def postings(spark, sf):
    return ix.postings(_post_docs(spark, sf), TEXT)


@query
def doc_lengths(spark, sf):
    return ix.doc_lengths(posts_index(spark, sf).postings)


@query
def doc_freqs(spark, sf):
    return ix.doc_freqs(posts_index(spark, sf).postings)


@query
def field_stats(spark, sf):
    return ix.field_stats(posts_index(spark, sf).lengths).select("field", "n", F.col("avg_len"))


@query
def keyword_terms(spark, sf):
    return ix.keyword_terms(_post_docs(spark, sf), ["docid", "url"])


@query
def build_index(spark, sf):
    """A full pass on every call; its result is the rows of each index table."""
    counts = _build(spark, sf, cleaned_posts(spark, sf), scratch_path(spark, "built"), "built", "full", placed=True)
    return spark.createDataFrame(list(counts.items()), "index_table string, rows bigint")


# --- vectors ----------------------------------------------------------------


@query
def unit_vector_(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    # Label 0 makes zero vectors, which have no unit form.
    scaled = e.select("vec_id", unit_vector(F.transform("embedding", lambda x: x * F.col("label").cast("float"))).alias("vec"))
    return components(scaled, "vec_id")


QUERIES["unit_vector"] = QUERIES.pop("unit_vector_")


@query
def mean_pool(spark, sf):
    return components(neighbours.mean_pool(fx.token_vectors(spark, sf)), "doc_id")


@query
def cls_pool(spark, sf):
    return components(neighbours.cls_pool(fx.token_vectors(spark, sf)), "doc_id")


@query
def encode_text(spark, sf):
    return components(encoders.encode(fx.texts(spark, sf), "doc_id", F.col("text")), "doc_id")


def _length_model():
    """A model whose tokens are words, each with the unit vector of its length modulo 8."""
    import numpy as np

    def predict(texts):
        tokens = [[len(t) % 8 for t in text.split(" ") if t] for text in texts]
        vectors = np.zeros((len(tokens), max(map(len, tokens)), 8), np.float32)
        mask = np.zeros(vectors.shape[:2], np.int8)
        for i, lengths in enumerate(tokens):
            vectors[i, np.arange(len(lengths)), lengths] = 1
            mask[i, : len(lengths)] = 1
        return vectors, mask

    return predict


@query
def encode_tokens(spark, sf):
    words = F.array_join(text.tokenize(F.col("text")), " ")
    encoder = encoders.token_model_encoder(_length_model, "mean")
    return components(encoders.encode(fx.texts(spark, sf), "doc_id", words, encoder), "doc_id")


@query
def attach_vectors(spark, sf):
    paired = build.attach_vectors(_post_docs(spark, sf), fx.vectors(spark, sf))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return paired.select("docid", "title", F.size("vec").alias("width"), F.round(total, 6).alias("total"))


def _unit_vectors(spark, sf) -> DataFrame:
    vecs = fx.vectors(spark, sf)
    return vecs.select(
        F.col("doc_id").cast("string").alias("doc_id"), unit_vector(F.col("vec")).cast("array<float>").alias("vec")
    )


def _vector_queries(spark, sf) -> DataFrame:
    """Every vector asks for its neighbours."""
    return _unit_vectors(spark, sf).select(F.col("doc_id").cast("bigint").alias("qid"), "vec")


@query
def knn_exact(spark, sf):
    hits = neighbours.knn(_unit_vectors(spark, sf), _vector_queries(spark, sf), 10)
    return hits.select("qid", "rank", "doc_id", "score")


CELLS = 16


def _approx(spark, sf, nprobe: int) -> DataFrame:
    vecs = _unit_vectors(spark, sf)
    centres = cells.train_cells(vecs, CELLS)
    packed = materialise(cells.pack_cells(vecs, centres), "cells")
    hits = cells.knn_approx(packed, centres, vecs, _vector_queries(spark, sf), 10, nprobe)
    return hits.select("qid", "rank", "doc_id", "score")


@query
def knn_approx(spark, sf):
    return _approx(spark, sf, cells.NPROBE)


@query
def knn_all_cells(spark, sf):
    """Every cell probed: what is left of the approximation is the cut by 8-bit codes."""
    return _approx(spark, sf, CELLS)


@query
def knn_filtered(spark, sf):
    index, asked = posts_index(spark, sf), fx.requests(spark, sf)
    matches = terms.most_fields(index, asked.select("qid", "query"), TEXT).select("qid", "doc_id")
    hits = neighbours.knn(index.vectors, asked.select("qid", "vec"), 10, filter=matches)
    return hits.select("qid", "rank", "doc_id", "score")


# --- term search ------------------------------------------------------------


def _asked(spark, sf) -> DataFrame:
    return fx.requests(spark, sf).select("qid", "query")


@query
def match_all(spark, sf):
    return terms.match(posts_index(spark, sf), _asked(spark, sf), terms.MATCH_ALL, TEXT)


@query
def match_any(spark, sf):
    return terms.match(posts_index(spark, sf), _asked(spark, sf), terms.MATCH_ANY, TEXT)


@query
def match_keyword(spark, sf):
    return terms.match_keyword(posts_index(spark, sf), fx.keyword_requests(spark, sf))


@query
def bm25_field(spark, sf):
    return terms.bm25_field(posts_index(spark, sf), _asked(spark, sf), "body")


@query
def most_fields(spark, sf):
    return terms.most_fields(posts_index(spark, sf), _asked(spark, sf), None, terms.MATCH_ANY)


@query
def bm25_search(spark, sf):
    return with_totals(search.bm25_search(posts_index(spark, sf), _asked(spark, sf), from_=2, size=8))


# --- ranking ----------------------------------------------------------------


@query
def top_k(spark, sf):
    return ranking.top_k(bm25_field(spark, sf), 10)


@query
def bm25_block_max(spark, sf):
    asked = fx.requests(spark, sf).select("qid", "query")
    hits = search.bm25_search(blocked_index(spark, sf), asked, TEXT, "or", from_=0, size=10, totals=False).hits
    return hits.select("qid", "rank", "doc_id", "score")


@query
def search_segments(spark, sf):
    """An index of stale posts, the posts of one half of the keys added, then those of the other."""
    fx.use_utc(spark)
    docs = fx.index_docs(spark, sf)
    half = F.crc32(F.col("docid")) % 2

    def make(root: str) -> None:
        stale = docs.where(F.crc32(F.col("docid")) % 3 > 0).withColumn("body", F.col("title"))
        _build(spark, sf, stale, root, "segments")
        for part in (0, 1):
            segments.add_segment(spark, docs.where(half == part), root, "segments")

    return with_totals(search.bm25_search(_index(spark, sf, "segments", make), _asked(spark, sf), from_=2, size=8))


@query
def page_hits(spark, sf):
    return ranking.page_hits(ranking.top_k(bm25_field(spark, sf), 7), 3, 4)


@query
def total_hits(spark, sf):
    return ranking.total_hits(most_fields(spark, sf), _asked(spark, sf))


@query
def page_progress(spark, sf):
    """An incremental run over the total of all revisions."""
    revisions = fx.revisions(spark, sf)
    run = ingest.incremental_scan(revisions, fx.run_log(spark, sf))
    return numbering.page_progress(run, revisions.count(), 100)


# --- retrievers -------------------------------------------------------------


@query
def dense_search(spark, sf):
    return with_totals(search.search(encoded_index(spark, sf), encoded_requests(spark, sf), topk=20, from_=3, size=9))


@query
def hybrid_search(spark, sf):
    asked = fx.requests(spark, sf).select("qid", "query", "vec")
    return with_totals(search.search(posts_index(spark, sf), asked, topk=5, size=12, hybrid=True, search_fields=TEXT))


@query
def batch_search(spark, sf):
    return with_totals(search.batch_search(posts_index(spark, sf), fx.requests(spark, sf)))


@query
def check_requests(spark, sf):
    """Requests damaged by rules on their settings."""
    r = fx.requests(spark, sf)
    vec = F.when(F.col("topk") == 7, F.slice("vec", 1, 10)).when(F.col("size") != 5, F.col("vec"))
    fields = F.when(F.col("topk") == 9, F.array(F.lit("summary"))).otherwise(F.col("search_fields"))
    damaged = r.withColumns({"vec": vec, "search_fields": fields, "size": F.when(F.col("topk") == 11, -1).otherwise(F.col("size"))})
    return search.check_requests(damaged, fx.MAPPING)


@query
def assemble_results(spark, sf):
    asked = fx.requests(spark, sf)
    found = search.batch_search(posts_index(spark, sf), asked)
    nested = ranking.assemble_results(found.hits, found.totals, asked)
    # One text per request: an array of structs has no common form to compare.
    hit = lambda h: F.concat_ws(":", h["rank"], h["doc_id"])
    return nested.withColumn("hits", F.array_join(F.transform("hits", hit), " "))


# --- streaming --------------------------------------------------------------


@query
def stream_upsert(spark, sf):
    def run(path: str) -> None:
        feed = fx.crawled_pages(spark, sf)
        feeds.stream_upsert(spark, feed, f"{path}/changes", f"{path}/checkpoint", 3).awaitTermination()

    changes = fx.once(spark, sf, "upserted", run) + "/changes"
    return _flat_posts(feeds.merged_posts(fx.posts(spark, sf), changes))


@query
def stream_dedupe(spark, sf):
    """Two crawls whose day-wide overlap is read twice."""

    def run(path: str) -> None:
        revisions = fx.revisions(spark, sf).select("number", "updated_at")
        first = revisions.where("updated_at < timestamp '2024-01-15 12:00:00'")
        second = revisions.where("updated_at >= timestamp '2024-01-15 00:00:00'")
        for crawl in (first, second):
            crawl.write.mode("append").parquet(f"{path}/crawls")
        stream = spark.readStream.schema(revisions.schema).parquet(f"{path}/crawls")
        (
            feeds.stream_dedupe(stream, ["number", "updated_at"], "31 days")
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{path}/out")
            .awaitTermination()
        )

    out = fx.once(spark, sf, "deduped", run) + "/out"
    return spark.read.parquet(out).select("number", stamp("updated_at"))


@query
def stream_dedupe_once(spark, sf):
    """Three crawls, each by a query restarted from the checkpoint. The last one
    repeats all of the first, far later than any watermark."""

    def run(path: str) -> None:
        revisions = fx.revisions(spark, sf).select("number", "updated_at")
        first = revisions.where("updated_at < timestamp '2024-01-15 12:00:00'")
        second = revisions.where("updated_at >= timestamp '2024-01-15 00:00:00'")
        for crawl in (first, second, first):
            crawl.write.mode("append").parquet(f"{path}/crawls")
            stream = spark.readStream.schema(revisions.schema).parquet(f"{path}/crawls")
            (
                feeds.stream_dedupe_once(stream, ["number", "updated_at"], 7 * 86400)
                .writeStream.format("parquet")
                .option("checkpointLocation", f"{path}/checkpoint")
                .trigger(availableNow=True)
                .start(f"{path}/out")
                .awaitTermination()
            )

    out = fx.once(spark, sf, "deduped_once", run) + "/out"
    return spark.read.parquet(out).select("number", stamp("updated_at"))
