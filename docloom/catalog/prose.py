"""Prose rules over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import oracle
from docloom.catalog.registered import query
from docloom.catalog.views import NOTES_SQL, code_files, notes, CODE_SQL
from docloom.operators import rules as R
from docloom.operators.extraction import (
    extract, extract_json_keys, extract_offsets, extract_properties, extract_tag_names,
    union_mentions,
)
from docloom.sources.tables import load, spread

SHOWN = ["rule_id", "match", "name", "entity_type", "position", "context", "relevance"]


def _one(rule: R.Rule, *numbers: int, rule_id: str | None = None) -> R.Rule:
    """A rule cut down to some of its patterns."""
    patterns = tuple(rule.patterns[i] for i in numbers)
    starts = tuple(rule.starts[i] for i in numbers)
    needs = tuple(rule.needs[i] for i in numbers) if rule.needs else ()
    return R.Rule(
        rule_id or rule.rule_id, rule.entity_type, rule.relevance, rule.width, patterns, union=True,
        strip_prefix=rule.strip_prefix, min_length=rule.min_length, normalize=rule.normalize, starts=starts, needs=needs,
    )


PERSON, ORGANIZATION, LOCATION, DATE = R.TEXT_RULES
DOC_PERSON, DOC_ORGANIZATION, DOC_DATE, DOC_LOCATION, DOC_PRODUCT = R.DOCUMENT_RULES
SETS = {
    "x01_person_names": (_one(PERSON, 0),),
    "x02_titled_persons": (_one(PERSON, 1),),
    "x03_organizations": (ORGANIZATION,),
    "x04_locations_after_prepositions": (_one(LOCATION, 0),),
    "x05_known_locations": (_one(LOCATION, 1),),
    "x06_dates": (DATE,),
    "x07_products": (R.PRODUCT_RULE,),
    "x08_document_text": R.DOCUMENT_RULES,
    "x09_acronyms": (_one(DOC_ORGANIZATION, 2),),
    "x10_street_addresses": (_one(DOC_LOCATION, 1),),
    "x11_capitalized_products": (DOC_PRODUCT,),
    "x16_all_prose_rules": R.PROSE_RULES,
}


def _register(name: str, rules: tuple[R.Rule, ...]) -> None:
    @query(name, oracle.prose_sql(NOTES_SQL, rules))
    def run(spark, folder):
        return extract(notes(spark, folder), ["doc_id"], "text", rules, one_pass=True).select("doc_id", *SHOWN)


for _name, _rules in SETS.items():
    _register(_name, _rules)


def _offset_sql(source: str) -> str:
    parts = []
    shown = (
        ("person", 0.8, r"\b[A-Z][a-z]+ (?:[A-Z][a-z]+)\b"),
        ("organization", 0.7, r"\b[A-Za-z]+ (?:Inc|Corp|LLC|Ltd|Company|Association)\b"),
        ("date", 0.9, r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b|\b[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\b"),
    )
    for kind, relevance, pattern in shown:
        # Splitting at the matches gives the gaps between them.
        parts.append(
            f"SELECT doc_id, text, '{kind}' AS entity_type, CAST({relevance} AS DOUBLE) AS relevance, "
            f"regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_split_to_array(text, '{pattern}') AS gaps FROM src"
        )
    return f"""
WITH src AS ({source}),
steps AS ({" UNION ALL ".join(parts)}),
rows AS (
  SELECT doc_id, text, entity_type, relevance, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM steps),
placed AS (
  SELECT doc_id, text, entity_type, relevance, ms[i] AS name,
         length(array_to_string(gaps[1:i], '')) + length(array_to_string(ms[1:i-1], '')) AS pos FROM rows)
SELECT doc_id, name, entity_type, CAST(pos AS INTEGER) AS position, relevance,
       text[greatest(pos - 20, 0) + 1 : pos + length(name) + 20] AS context
FROM placed"""


@query("x12_offset_mentions", _offset_sql(NOTES_SQL))
def x12_offset_mentions(spark, folder):
    return extract_offsets(notes(spark, folder), ["doc_id"]).drop("ordinal")


@query(
    "x13_json_keys",
    """SELECT event_id, unnest(list_sort(json_keys(doc))) AS name, 'other' AS entity_type, '' AS context,
              CAST(0 AS INTEGER) AS position, CAST(0.5 AS DOUBLE) AS relevance
       FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{"id": ' || event_id || ', "props": ' || props || '}'
                                   ELSE props END AS doc FROM events)""",
)
def x13_json_keys(spark, folder):
    doc = F.when(
        F.col("event_id") % 4 == 0,
        F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "props": '), "props", F.lit("}")),
    ).otherwise(F.col("props"))
    events = load(spark, folder, "events").select("event_id", doc.alias("text"))
    return extract_json_keys(events, ["event_id"]).drop("ordinal")


@query(
    "x14_tag_names",
    r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<([^/!>\n ][^ >\n]*)[^>\n]*>', 1)) AS name,
               'other' AS entity_type, '' AS context, CAST(0 AS INTEGER) AS position,
               CAST(0.5 AS DOUBLE) AS relevance FROM pages""",
)
def x14_tag_names(spark, folder):
    pages = spread(load(spark, folder, "pages").select("page_id", "html"))
    return extract_tag_names(pages, ["page_id"], "html").drop("ordinal")


_PROPERTIES = """SELECT p_partkey, name, kind AS entity_type, context, CAST(0 AS INTEGER) AS position,
       CAST(relevance AS DOUBLE) AS relevance
FROM (SELECT p_partkey, p_name AS name, 'other' AS kind, 'PDF Title' AS context, 0.9 AS relevance FROM part
      UNION ALL SELECT p_partkey, p_brand, 'person', 'PDF Author', 0.9 FROM part WHERE p_size % 3 <> 0
      UNION ALL SELECT p_partkey, p_type, 'technology', 'PDF Producer', 0.8 FROM part)"""


def _properties(spark, folder):
    return load(spark, folder, "part").select(
        "p_partkey", F.col("p_name").alias("title"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("author"),
        F.lit("").alias("creation_date"), F.col("p_type").alias("producer"),
    )


@query("x15_document_properties", _PROPERTIES)
def x15_document_properties(spark, folder):
    return extract_properties(_properties(spark, folder), ["p_partkey"]).drop("ordinal")


@query(
    "u03_property_and_text_mentions",
    f"""WITH props AS ({_PROPERTIES}), texts AS ({oracle.prose_sql(CODE_SQL, (DOC_PRODUCT,), "p_partkey")})
SELECT p_partkey, name, entity_type, context, position, relevance, CAST(0 AS INTEGER) AS part FROM props
UNION ALL SELECT p_partkey, name, entity_type, context, position, relevance, CAST(1 AS INTEGER) FROM texts""",
)
def u03_property_and_text_mentions(spark, folder):
    properties = extract_properties(_properties(spark, folder), ["p_partkey"])
    texts = extract(code_files(spark, folder), ["p_partkey"], "text", (DOC_PRODUCT,))
    return union_mentions(properties, texts, ["p_partkey"]).drop("ordinal")
