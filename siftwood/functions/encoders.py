"""Text to vector. An encoder maps (key, tokens or text) rows to (key, vec) rows,
and the same one serves documents and queries.

``hash_encoder`` is feature hashing (Weinberger et al., 2009): terms are hashed
to signed components and summed. ``model_encoder`` runs a batch model,
``token_model_encoder`` one that returns a vector per token, and pools them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.functions.text import tokenize
from siftwood.functions.vectors import unit_vector

DIMS = 64
POOLINGS = ("mean", "cls")
PADDED = 1 << 16  # characters of a batch, each text counted at the longest one's length

Encoder = Callable[[DataFrame, str, Column], DataFrame]


def hash_sums(df: DataFrame, key: str, text: Column, dims: int = DIMS, analyzer=tokenize) -> DataFrame:
    """(key, dim, x): non-zero component sums before scaling to unit length.

    A component's sum combines before the shuffle, so the shuffle holds at most
    ``dims`` small rows per text however long the text is.
    """
    # md5 can be followed by any engine; 8 hex digits give component and sign.
    code = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint")
    sign = F.when(F.floor(code / dims) % 2 == 0, 1).otherwise(-1)
    return (
        df.select(key, F.explode_outer(analyzer(text)).alias("term"))
        .where(F.col("term").isNotNull())
        .select(key, (code % dims).cast("int").alias("dim"), sign.alias("sign"))
        .groupBy(key, "dim")
        .agg(F.sum("sign").alias("x"))
        .where(F.col("x") != 0)
    )


def hash_encoder(dims: int = DIMS, analyzer=tokenize) -> Encoder:
    """Encoder to unit vectors of ``dims`` components; texts without terms have none."""

    def encode_rows(df: DataFrame, key: str, text: Column) -> DataFrame:
        sums = hash_sums(df, key, text, dims, analyzer)
        # At most ``dims`` entries per key.
        parts = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("parts"))
        dense = F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.coalesce(F.element_at("parts", i), F.lit(0)).cast("double"),
        )
        return parts.select(key, dense.alias("dense")).select(
            key, unit_vector(F.col("dense")).cast("array<float>").alias("vec")
        )

    return encode_rows


def model_encoder(make_predict: Callable, batch_size: int = 16) -> Encoder:
    """Encoder around a model: ``make_predict`` loads it once per worker and
    returns a function from an array of texts to a matrix."""
    from pyspark.ml.functions import predict_batch_udf

    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)

    def encode_rows(df: DataFrame, key: str, text: Column) -> DataFrame:
        return df.select(key, predict(text).alias("vec"))

    return encode_rows


def pool_tokens(vectors: np.ndarray, mask: np.ndarray, pooling: str) -> list[np.ndarray | None]:
    """One vector per text from its token vectors (texts, tokens, width): the mean
    of those the mask holds, or the first. A text without any has none."""
    vectors, held = np.asarray(vectors), np.asarray(mask).astype(bool)
    if pooling == "cls":
        return list(vectors[:, 0]) if vectors.shape[1] else [None] * len(vectors)
    counts = held.sum(axis=1)
    sums = np.where(held[..., None], vectors, 0).sum(axis=1, dtype=np.float64)
    return [s / n if n else None for s, n in zip(sums, counts, strict=True)]


def packed_batches(sizes: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Positions of texts by length, in batches whose padded size is within the
    budget. A text above it is a batch of its own."""
    order, start = np.argsort(sizes, kind="stable"), 0
    for end in range(1, len(order) + 1):
        if end == len(order) or (end + 1 - start) * max(int(sizes[order[end]]), 1) > budget:
            yield order[start:end]
            start = end


_loaded: dict[str, Callable] = {}


def token_model_encoder(make_model: Callable, pooling: str = "mean", budget: int = PADDED, size: Callable[[str], int] = len) -> Encoder:
    """Encoder around a model of tokens: ``make_model`` loads it once per worker and
    returns a function from a list of texts to token vectors (texts, tokens, width)
    and a mask (texts, tokens).

    Texts of like ``size`` meet in a batch, so little of it is padding, and are pooled
    there: no token vector leaves the task. Null texts, and with "mean" texts without
    tokens, have no vector.
    """
    if pooling not in POOLINGS:
        raise ValueError(f"pooling {pooling!r} is none of {POOLINGS}")
    if budget < 1:
        raise ValueError("the budget must be positive")
    label = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if label not in _loaded:
            _loaded[label] = make_model()
        model = _loaded[label]
        for batch in batches:
            texts, vecs = batch.pop("_text"), [None] * len(batch)
            known = np.flatnonzero(texts.notna().to_numpy())
            sizes = np.array([size(texts.iloc[i]) for i in known], np.int64)
            for part in packed_batches(sizes, budget):
                rows = known[part]
                vectors, mask = model([texts.iloc[i] for i in rows])
                for i, vec in zip(rows, pool_tokens(vectors, mask, pooling), strict=True):
                    vecs[i] = None if vec is None else vec.astype(np.float32)
            yield batch.assign(vec=pd.Series(vecs, index=batch.index, dtype=object))

    def encode_rows(df: DataFrame, key: str, text: Column) -> DataFrame:
        rows = df.select(key, text.cast("string").alias("_text"))
        schema = T.StructType([rows.schema[key], T.StructField("vec", T.ArrayType(T.FloatType()))])
        return rows.mapInPandas(run, schema)

    return encode_rows


def encode(df: DataFrame, key: str, text: Column, encoder: Encoder | None = None) -> DataFrame:
    """(key, vec) of every row's text."""
    return (encoder or hash_encoder())(df, key, text)
