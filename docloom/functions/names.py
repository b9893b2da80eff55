"""Entity names, entity types and entity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import SPACE_CLASS, strip
from docloom.schemas import ENTITY_TYPES


def normalize_name(name: Column, entity_type: Column) -> Column:
    """Canonical name: no double quotes, single blanks, title case or ISO-like order by type.

    A numeric date m/d/y becomes y-m-d as it stands: no padding and no century.
    """
    clean = strip(F.regexp_replace(F.replace(name, F.lit('"'), F.lit("")), SPACE_CLASS + "+", " "))
    swapped = F.regexp_replace(clean, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2,4})$", "$3-$1-$2")
    return (
        F.when(entity_type.isin("person", "location"), F.initcap(clean))
        .when(entity_type == "date", swapped)
        .otherwise(clean)
    )


def validate_type(entity_type: Column) -> Column:
    """A known type in lower case, ``other`` for anything else."""
    folded = F.lower(entity_type)
    return F.when(folded.isin(*ENTITY_TYPES), folded).otherwise(F.lit("other"))


def entity_key(entity_type: Column, name: Column) -> Column:
    """Deterministic id of an entity."""
    return F.sha2(F.concat_ws(":", entity_type, name), 256)
