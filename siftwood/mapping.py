"""The index schema: field name to type, plus the vector width."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The fields and types an index of posts has, in order.
POST_FIELDS = {
    "vec": "vector",
    "docid": "keyword",
    "title": "text",
    "body": "text",
    "url": "keyword",
    "created_at": "date",
    "updated_at": "date",
}

_SPARK_TYPES = {
    "vector": T.ArrayType(T.FloatType()),
    "keyword": T.StringType(),
    "text": T.StringType(),
    "date": T.TimestampType(),
}


@dataclass(frozen=True)
class Mapping:
    """Typed fields of an index; ``dims`` is the width of its vector field."""

    fields: dict[str, str]
    dims: int = 768
    key: str = "docid"

    def __post_init__(self):
        unknown = set(self.fields.values()) - set(_SPARK_TYPES)
        if unknown:
            raise ValueError(f"unknown field types: {sorted(unknown)}")
        if self.key not in self.fields:
            raise ValueError(f"key field {self.key!r} is not in the mapping")

    def spark_type(self, field: str) -> T.DataType:
        return _SPARK_TYPES[self.fields[field]]

    def of_type(self, *kinds: str) -> list[str]:
        return [f for f, kind in self.fields.items() if kind in kinds]

    @property
    def text_fields(self) -> list[str]:
        return self.of_type("text")

    @property
    def keyword_fields(self) -> list[str]:
        return self.of_type("keyword")

    @property
    def search_fields(self) -> list[str]:
        """Fields searched when a request names none."""
        return self.of_type("text", "keyword")

    @property
    def vector_field(self) -> str | None:
        return next(iter(self.of_type("vector")), None)


POSTS = Mapping(POST_FIELDS)
