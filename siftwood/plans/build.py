"""Build, publish and open a search index."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.cluster import scratch_path
from siftwood.functions.vectors import unit_vector
from siftwood.index import ANALYZERS, Index
from siftwood.mapping import Mapping
from siftwood.operators import blocks
from siftwood.operators import cells as cell_ops
from siftwood.operators import index as ops
from siftwood.operators.projections import index_fields, required
from siftwood.sinks.index_store import (
    Layout,
    build_folder,
    count_tables,
    current_builds,
    new_version,
    open_index,
    seal_build,
    switch_alias,
    write_tables,
)

# Documents per bucket. One task counts and sorts all postings of a bucket: of 6,400 texts
# of 3.3 KB that took 0.9 GB, so a bucket this large is still held without spilling.
DOCS_PER_BUCKET = 10_000

TABLES = ("docs", "postings", "dfs", "lengths", "stats", "vectors")


def buckets_for(spark: SparkSession, expected_docs: int) -> int:
    """Document buckets for a corpus of this size: the search parallelism."""
    return max(spark.sparkContext.defaultParallelism, -(-expected_docs // DOCS_PER_BUCKET))


def place_docs(docs: DataFrame, buckets: int, key: str = "docid") -> DataFrame:
    """Write documents once, dealt as an index of so many ``doc_buckets`` lies. What reads
    them by key, as an encoder, ``attach_vectors`` and the build, then shuffles no text."""
    layouts = {"docs": Layout(None, key, [key], buckets)}
    folder = scratch_path(docs.sparkSession, "placed")
    return write_tables(folder, {"docs": docs.repartition(buckets, key)}, layouts)["docs"]


def attach_vectors(docs: DataFrame, vecs: DataFrame, key: str = "docid", vec_key: str = "doc_id") -> DataFrame:
    """Pair documents with their vectors; ``vec`` is null where there is none."""
    return docs.drop("vec").join(vecs.select(F.col(vec_key).cast("string").alias(key), "vec"), key, "left")


def check_records(docs: DataFrame, mapping: Mapping) -> None:
    """Raise ValueError unless keys are unique and vectors have the mapping's width.

    Reads the written records, which are bucketed by key, so no text moves."""
    key = mapping.key
    repeated = docs.groupBy(key).count().where("count > 1")
    found = [f"{n} keys are not unique, as {example!r}" for n, example in _counted(repeated, key)]
    if mapping.vector_field:
        vec = F.col(mapping.vector_field)
        odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x))
        wrong = docs.select(key, mapping.vector_field).where(vec.isNotNull() & ((F.size(vec) != mapping.dims) | odd))
        found += [f"{n} vectors are not {mapping.dims} numbers, as that of {example!r}" for n, example in _counted(wrong, key)]
    if found:
        raise ValueError("; ".join(found))


def _counted(rows: DataFrame, key: str) -> list[tuple[int, str]]:
    row = rows.agg(F.count("*").alias("n"), F.min(key).alias("example")).first()
    return [(row["n"], row["example"])] if row["n"] else []


def build_index(
    spark: SparkSession,
    df: DataFrame,
    mapping: Mapping,
    root: str,
    alias: str,
    analyzer: str = "terms",
    term_buckets: int = 8,
    doc_buckets: int | None = None,
    version: int | None = None,
    cells: int | None = None,
    cell_fraction: float = 1.0,
    block_docs: int | None = None,
    extra: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None,
    publish: bool = True,
    placed: bool = False,
) -> dict[str, int]:
    """Write every table of an index, then publish it once. Returns row counts.

    With ``cells``, the vectors are also dealt to that many cells (learnt from a
    ``cell_fraction`` of them) for approximate search; about the square root of
    their number is usual. With ``block_docs``, postings lie in blocks of so many
    documents, and the best hits are found without reading all of them. ``extra``
    makes further tables of the build from those written; unless ``publish``, the
    alias is left as it is (see ``plans/segments.py``).

    ``doc_buckets`` is the search parallelism (see ``buckets_for``; default: the
    shuffle width). With ``term_buckets`` it sets the number of postings files,
    so choose both so that files stay near 128 MB or more. Documents that ``place_docs``
    dealt to as many buckets, and that were only joined by key since, are ``placed``:
    their texts are not shuffled again.
    """
    buckets = doc_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    version = new_version() if version is None else version
    key, vector = mapping.key, mapping.vector_field
    folder = build_folder(root, alias, version)
    by_doc = lambda column: Layout(None, column, [column], buckets)
    layouts = {
        "docs": by_doc(key),
        "vectors": by_doc("doc_id"),
        "postings": Layout("tbucket", "doc_id", ["field", "term"], buckets),
        "dfs": Layout("tbucket"),
    }
    tables: dict[str, DataFrame] = {}

    def write(**new: DataFrame) -> None:
        tables.update(write_tables(folder, new, layouts))

    # 1. The records, written once in their final partitioning: the only
    #    shuffle of texts, and the only run of cleaning and encoding.
    records = required(index_fields(df, mapping), key)
    write(docs=records if placed else records.repartition(buckets, key))
    docs = tables["docs"]
    check_records(docs, mapping)

    # 2. Vectors and postings stay in that partitioning, without a shuffle.
    vec = unit_vector(F.col(vector) if vector else F.lit(None).cast("array<float>"))
    vectors = docs.select(F.col(key).alias("doc_id"), vec.cast("array<float>").alias("vec"))
    postings = ops.postings(
        docs, mapping.text_fields, key, ANALYZERS[analyzer], mapping.keyword_fields, spread=False, with_length=True
    ).withColumn("tbucket", ops.term_bucket(F.col("term"), term_buckets))
    if block_docs:
        layouts["postings"] = Layout("tbucket", "doc_id", ["field", "term", "dblock"], buckets)
        layouts["doc_blocks"] = by_doc("doc_id")
        write(doc_blocks=blocks.doc_blocks(docs, mapping.text_fields, key, buckets, block_docs))
        postings = postings.join(tables["doc_blocks"], "doc_id")
    write(vectors=vectors.where(F.col("vec").isNotNull()), postings=postings)
    if cells and not tables["vectors"].isEmpty():
        centres = cell_ops.train_cells(tables["vectors"], cells, fraction=cell_fraction)
        write(cells=cell_ops.pack_cells(tables["vectors"], centres), centres=cell_ops.centres_table(spark, centres))

    # 3. Statistics read the written postings, so texts are analysed once. A
    #    term bucket too large for one writer is split by adaptive execution.
    postings = tables["postings"]
    dfs = ops.doc_freqs(postings).withColumn("tbucket", ops.term_bucket(F.col("term"), term_buckets))
    placed = dfs.hint("rebalance", F.col("tbucket")).sortWithinPartitions("tbucket", "field", "term")
    write(dfs=placed, lengths=ops.doc_lengths(postings))
    write(stats=ops.field_stats(tables["lengths"]))
    if block_docs:
        tops = blocks.block_weights(postings, tables["stats"]).hint("rebalance", F.col("tbucket"))
        layouts["tops"] = Layout("tbucket")
        write(tops=tops.sortWithinPartitions("tbucket", "field", "term", "dblock"))
    settings = {
        "fields": mapping.fields,
        "dims": mapping.dims,
        "key": key,
        "term_buckets": term_buckets,
        "doc_buckets": buckets,
        "analyzer": analyzer,
        "block_docs": block_docs or 0,
    }
    write(meta=spark.range(1, numPartitions=1).select(F.lit(json.dumps(settings)).alias("settings")))
    if extra:
        write(**extra(tables))
    seal_build(spark, folder, tables, layouts)
    if publish:
        switch_alias(spark, root, alias, version)
    return count_tables({name: tables[name] for name in TABLES})


def load_index(spark: SparkSession, root: str, alias: str) -> Index | None:
    """The index an alias names now, with all of its segments."""
    if len(current_builds(spark, root, alias)) > 1:
        from siftwood.plans.segments import Segments

        return Segments(spark, root, alias).index()
    tables = open_index(spark, root, alias)
    if tables is None:
        return None
    settings = json.loads(tables["meta"].first()["settings"])
    return Index(
        **{name: tables[name] for name in TABLES},
        mapping=Mapping(settings["fields"], settings["dims"], settings["key"]),
        term_buckets=settings["term_buckets"],
        doc_buckets=settings["doc_buckets"],
        analyzer_name=settings["analyzer"],
        cells=tables.get("cells"),
        centres=tables.get("centres"),
        tops=tables.get("tops"),
        block_docs=settings.get("block_docs", 0),
    )
