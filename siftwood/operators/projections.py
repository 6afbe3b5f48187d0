"""Column renames, document model and record checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwood.functions.text import html_text, markdown_text
from siftwood.mapping import Mapping

# The post table, its column widths, and its key.
POST_COLUMNS = {
    "number": "string",
    "name": "string",
    "full_name": "string",
    "wip": "boolean",
    "body_md": "string",
    "body_html": "string",
    "created_at": "timestamp",
    "updated_at": "timestamp",
    "url": "string",
    "created_by": "string",
}
POST_WIDTHS = {"number": 10, "created_by": 20}


def _checked(value: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message))).otherwise(value)


def _column(df: DataFrame, name: str, kind: str | T.DataType) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def map_columns(df: DataFrame, mapper: dict[str, str]) -> DataFrame:
    """Rename by map, in map order. Absent sources are ignored; a column that
    already has a target's name is replaced."""
    names = {c: c for c in df.columns}  # output name -> source column
    for source, target in mapper.items():
        if source in names:
            names[target] = names.pop(source)
    return df.select([F.col(source).alias(out) for out, source in names.items()])


def flatten_posts(df: DataFrame) -> DataFrame:
    """Replace the nested author by the author's screen name."""
    return df.withColumn("created_by", F.col("created_by.screen_name"))


def conform_docs(df: DataFrame) -> DataFrame:
    """The document model: ``doc_id`` and ``text`` are required, ``title`` is ''
    when missing. A row without key or text fails the job."""
    doc_id, text, title = (_column(df, c, "string") for c in ("doc_id", "text", "title"))
    return df.select(
        _checked(doc_id, doc_id.isNull(), "doc_id is required").alias("doc_id"),
        _checked(text, text.isNull(), "text is required").alias("text"),
        F.coalesce(title, F.lit("")).alias("title"),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys held by more than one row; only the key column is shuffled."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def conform_posts(df: DataFrame, unique: bool = True) -> DataFrame:
    """Cast to the post table. Null keys and over-long values fail the job;
    repeated keys fail at once unless ``unique`` is off."""
    if unique and duplicate_keys(df, "number").limit(1).count():
        raise ValueError("number is not unique")
    columns = []
    for name, kind in POST_COLUMNS.items():
        value = _column(df, name, kind)
        if name in POST_WIDTHS:
            width = POST_WIDTHS[name]
            value = _checked(value, F.length(value) > width, f"{name} is longer than {width}")
        if name == "number":
            value = _checked(value, value.isNull(), "number is required")
        columns.append(value.alias(name))
    return df.select(columns)


def index_fields(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Exactly the mapping's fields in its order; missing ones are null."""
    return df.select([_column(df, f, mapping.spark_type(f)).alias(f) for f in mapping.fields])


def required(df: DataFrame, column: str) -> DataFrame:
    """``df``, failing the job at the first row without ``column``."""
    value = F.col(column)
    return df.withColumn(column, _checked(value, value.isNull(), f"{column} is required"))


def strip_markdown(df: DataFrame, fields: list[str] = ["text"], keep_raw: bool = True) -> DataFrame:
    """Markdown to plain text per field; ``field_raw`` keeps the source."""
    raw = {f"{f}_raw": F.col(f) for f in fields} if keep_raw else {}
    return df.withColumns({**raw, **{f: markdown_text(F.col(f)) for f in fields}})


def strip_html(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumns({f: html_text(F.col(f)) for f in fields})


def preprocess(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply cleaning steps, each a function from DataFrame to DataFrame, in order."""
    for step in steps:
        df = df.transform(step)
    return df


def validate_records(df: DataFrame, mapping: Mapping) -> DataFrame:
    """Append ``reasons``: why an index would reject the row, empty if it would not."""
    key = F.col(mapping.key)
    rules = [F.when(key.isNull() | (key == ""), "missing key")]
    if mapping.vector_field:
        vec = F.col(mapping.vector_field)
        rules += [
            F.when(vec.isNotNull() & (F.size(vec) != mapping.dims), "vector width"),
            F.when(vec.isNotNull() & ~F.exists(vec, lambda x: x != 0), "zero vector"),
            F.when(F.exists(vec, lambda x: x.isNull() | F.isnan(x)), "vector value"),
        ]
    return df.withColumn("reasons", F.array_compact(F.array(*rules)))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("reasons")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0)


def count_records(checked: DataFrame) -> DataFrame:
    """One row: accepted and rejected counts."""
    return checked.agg(
        F.count_if(F.size("reasons") == 0).alias("accepted"),
        F.count_if(F.size("reasons") > 0).alias("rejected"),
    )


def search_requests(df: DataFrame, url_col: str) -> DataFrame:
    """Typed requests from search URLs, with the service's defaults for
    parameters left out. ``search_fields`` is null where none are named."""
    param = lambda name: F.try_url_decode(F.try_parse_url(F.col(url_col), F.lit("QUERY"), F.lit(name)))
    number = lambda name, default: F.coalesce(param(name).try_cast("int"), F.lit(default))
    fields = F.filter(F.split(param("search_fields"), ","), lambda f: f != "")
    return df.select(
        "qid",
        F.coalesce(param("query"), F.lit("")).alias("query"),
        number("topk", 200).alias("topk"),
        number("from", 0).alias("from_"),
        number("size", 10).alias("size"),
        (number("hybrid", 1) != 0).alias("hybrid"),
        F.when(F.size(fields) > 0, fields).alias("search_fields"),
    )
