"""Metadata as JSON text: checked, read and merged without a schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string,string>"


def is_object(c: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def metadata_error(c: Column) -> Column:
    """What is wrong with given metadata: null for an object, for JSON null, for text that is empty or no JSON (these count as ``{}``)."""
    parsed = F.try_parse_json(c)
    bad = parsed.isNotNull() & ~is_object(c) & (F.schema_of_variant(parsed) != "VOID")
    return F.when(bad, F.lit("metadata is not an object"))


def parsed(c: Column) -> Column:
    """Metadata as text that is always a JSON object; what isn't one is ``{}``."""
    return F.when(is_object(c), c).otherwise(F.lit("{}"))


def field(c: Column, name: str, kind: str = "string") -> Column:
    """A field of JSON text; null if missing."""
    return F.get_json_object(c, f"$.{name}").cast(kind)


def _fields(c: Column) -> Column:
    """The fields of a JSON object, parsed once; none for what isn't one."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def merged(left: Column, right: Column, pretty: bool = False) -> Column:
    """Two JSON objects as one; the right one's values win. Values keep their types."""
    one = F.array(F.struct(_fields(left).alias("a"), _fields(right).alias("b")))  # a lambda's argument is made once
    both = F.transform(one, lambda s: F.map_concat(F.map_filter(s["a"], lambda k, _: ~F.map_contains_key(s["b"], k)), s["b"]))
    return F.to_json(F.get(both, 0), {"pretty": str(pretty).lower()})


def variant(c: Column) -> Column:
    """Metadata as a VARIANT that is always an object; what isn't one is ``{}``."""
    parsed_ = F.try_parse_json(c)
    return F.when(F.schema_of_variant(parsed_).startswith("OBJECT"), parsed_).otherwise(F.parse_json(F.lit("{}")))


def merged_variants(left: Column, right: Column) -> Column:
    """Two VARIANT objects as one; the right one's values win, and all keep their types. Nothing is written as text or parsed."""
    fields = lambda c: F.coalesce(F.try_variant_get(c, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    one = F.array(F.struct(fields(left).alias("a"), fields(right).alias("b")))
    both = F.transform(one, lambda s: F.map_concat(F.map_filter(s["a"], lambda k, _: ~F.map_contains_key(s["b"], k)), s["b"]))
    return F.to_variant_object(F.get(both, 0))


def with_values(c: Column, **values: Column) -> Column:
    """A JSON object with further text values, which win."""
    return merged(c, F.to_json(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string"))))))
