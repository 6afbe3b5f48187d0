"""The registered queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwood.cluster import materialise
from siftwood.llm import bpe, hmm, jaccard, licenses, mixing, multi_index, negatives, pii, rules, secrets, toxicity, trie, warc
from siftwood.llm.frames import crc_share, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    measured = materialise(rules.features(table(spark, sf, "documents")), "features")
    learned = rules.learn(measured, table(spark, sf, "labels"))
    return rules.judge(measured, learned).select("doc_id", *rules.COUNTS, "base_failed", "kept", "rule")


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    linked = jaccard.linked_documents(table(spark, sf, "documents"))
    return linked.select("doc_id", "n_shingles", "component_id")


@query
def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


ORACLE_SQL["op3_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    source IS NULL AS no_name, coalesce(source, '') AS name,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS hash
  FROM documents
), by_source AS (
  SELECT no_name, name, sum(size)::BIGINT AS source_size,
    ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY no_name, name) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY no_name, name
), level AS (
  -- the level at which all targets sum to the budget, by the order in which sources fill up
  SELECT (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER filled, 0))::DOUBLE
    / sum(weight) OVER others AS level, (2.0 * source_size / weight)::DOUBLE AS full_at
  FROM by_source
  WINDOW filled AS (ORDER BY 2.0 * source_size / weight, no_name, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    others AS (ORDER BY 2.0 * source_size / weight, no_name, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), goals AS (
  SELECT no_name, name, source_size,
    least(2.0 * source_size, weight * (SELECT arg_min(level, full_at) FROM level WHERE level <= full_at)) AS target
  FROM by_source
), parts AS (
  SELECT *, least(floor(target / greatest(source_size, 1)), 2)::BIGINT AS whole FROM goals
), units AS (
  SELECT no_name, name, hash, sum(size) AS words FROM sized WHERE size > 0 GROUP BY ALL
), runs AS (
  SELECT u.*, sum(words) OVER (PARTITION BY no_name, name ORDER BY hash) AS upto,
    p.target - p.whole * p.source_size AS budget
  FROM units u JOIN parts p USING (no_name, name)
), picked AS (
  SELECT no_name, name, hash FROM runs WHERE budget > 0 AND (upto <= budget OR budget - (upto - words) > upto - budget)
)
SELECT s.doc_id, s.size, p.source_size, p.target,
  (s.size * (p.whole + CASE WHEN k.hash IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM sized s JOIN parts p USING (no_name, name) LEFT JOIN picked k ON s.no_name = k.no_name AND s.name = k.name AND s.hash = k.hash
"""


@query
def op9_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(table(spark, sf, "documents"))


def tokenizer_file() -> str:
    """The text of the tokenizer that the queries use."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@query
def op1_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digest(table(spark, sf, "documents"), tokenizer_file())


@query
def op2_multi_index_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return multi_index.search(table(spark, sf, "embeddings"))


@query
def op4_warc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    folder, listed = warc.write_archives(table(spark, sf, "pages"))
    read = warc.read_archives(folder, listed, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


@query
def op8_hmm_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf, "documents"), crc_share("doc_id", 5) == 1)


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = crc_share("doc_id", 4) == 2
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels"), held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


@query
def op12_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(table(spark, sf, "documents"))


@query
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.trie(table(spark, sf, "conversations"))


ORACLE_SQL["op13_prefix_trie"] = r"""
WITH ids AS (
  SELECT conv_id, turn, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS pos FROM ids
), sizes AS (
  -- crc32 of the decimal id, bit by bit: a byte is put in, then eight shifts (marked -1)
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END
  ), 4294967295::BIGINT) % 4 AS h
  FROM own GROUP BY conv_id
), plans AS (
  SELECT s.conv_id, s.base, s.h, least(s.h, coalesce(b.n, 0)) AS lent,
    least(s.h, coalesce(b.n, 0)) + greatest(s.n - s.h, 0) AS turns
  FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base
), rebuilt AS (
  SELECT o.conv_id, pos - h + lent + 1 AS depth, id, tokens FROM own o JOIN plans USING (conv_id) WHERE pos >= h
  UNION ALL
  SELECT p.conv_id, pos + 1, id, tokens FROM own o JOIN plans p ON o.conv_id = p.base WHERE pos < p.h
), steps AS (
  SELECT conv_id, depth, tokens, sha256(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM plans
), owned AS (
  SELECT s.*, turns = depth AS ends, min(conv_id) OVER (PARTITION BY node) AS owner,
    lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent
  FROM steps s JOIN plans USING (conv_id)
), kids AS (
  SELECT parent AS node, count(DISTINCT node) AS n_children, any_value(1) FROM owned WHERE depth > 0 GROUP BY parent
), told AS (
  -- a leaf counts for its least member, a node's tokens are saved by all members but the least
  SELECT o.*, coalesce(n_children, 0) AS n_children,
    bool_or(ends AND n_children IS NULL AND conv_id = owner) OVER (PARTITION BY conv_id) AS leaf,
    sum(CASE WHEN conv_id = owner THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY depth DESC) AS saved
  FROM owned o LEFT JOIN kids USING (node)
), nodes AS (
  SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
    any_value(n_children) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM told GROUP BY node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n.n_leaves,
  n.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.parent = p.node
"""


@query
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.mine(table(spark, sf, "embeddings"))


ORACLE_SQL["op11_hard_negatives"] = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.vec, r.vec)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER best AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER best <= 5
"""
