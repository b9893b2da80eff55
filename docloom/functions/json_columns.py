"""JSON held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.mime import is_valid_json
from docloom.schemas import ENTITY
from pyspark.sql import types as T

_ENTITIES_DOCUMENT = T.StructType([T.StructField("entities", T.ArrayType(ENTITY))])
_MAP = T.MapType(T.StringType(), T.StringType())


def entities_from_json(text: Column) -> Column:
    """The ``entities`` array of a JSON document, empty when it is missing."""
    return F.coalesce(
        F.from_json(text, _ENTITIES_DOCUMENT)["entities"],
        F.array().cast(T.ArrayType(ENTITY)),
    )


def salvage_json(text: Column) -> Column:
    """Valid JSON as it is, else the first braced part of a line, else an error record."""
    part = F.regexp_extract(text, r"\{.*\}", 0)
    failure = F.to_json(
        F.struct(
            F.lit("Failed to get valid JSON response").alias("error"),
            text.alias("raw_response"),
        )
    )
    return (
        F.when(is_valid_json(text), text)
        .when((part != "") & is_valid_json(part), part)
        .otherwise(failure)
    )


def parse_or_text(text: Column) -> Column:
    """Normalised JSON where the text parses, the text itself where it does not."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def json_map(text: Column) -> Column:
    return F.coalesce(F.from_json(text, _MAP), F.create_map().cast(_MAP))


def merge_maps(old: Column, new: Column) -> Column:
    """Shallow merge of two maps; the right side wins."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def merge_json(old: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects with string values, keys sorted."""
    merged = merge_maps(json_map(old), json_map(patch))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(merged))))


def top_level_keys(text: Column) -> Column:
    """Sorted top-level keys of a JSON object, null for anything else."""
    return F.sort_array(F.json_object_keys(F.when(is_valid_json(text), text)))
