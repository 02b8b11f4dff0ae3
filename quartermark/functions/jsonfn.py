"""JSON as models return it: repaired first, then parsed under a schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_fence


def encode(value: Column) -> Column:
    return F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("[]"))


def decode(text: Column, schema: str, default: Column | None = None) -> Column:
    parsed = F.from_json(text, schema)
    return parsed if default is None else F.coalesce(parsed, default)


def repair(text: Column) -> Column:
    """The outermost object, with plain quotes, without control characters or trailing commas."""
    s = F.regexp_extract(strip_fence(text), r"(?s)\{.*\}", 0)
    s = F.translate(s, "“”‘’", "\"\"''")
    s = F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return F.regexp_replace(s, r",\s*([}\]])", "$1")


def payload(text: Column, schema: str) -> Column:
    return F.from_json(repair(text), schema)


def token_usage(response: Column) -> Column:
    """struct(input, output) of either of two response shapes, zero if absent."""

    def first(*paths):
        return F.coalesce(*[F.get_json_object(response, p).try_cast("long") for p in paths], F.lit(0).cast("long"))

    return F.struct(first("$.usage.prompt_tokens", "$.usage.input_tokens").alias("input"), first("$.usage.completion_tokens", "$.usage.output_tokens").alias("output"))
