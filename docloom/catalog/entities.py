"""Consolidation of entities, and the content, entity and link tables of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import oracle
from docloom.catalog.code import SOURCE, files
from docloom.catalog.registered import query
from docloom.catalog.views import NOTES_SQL, notes
from docloom.functions.names import normalize_name
from docloom.operators import consolidate as C
from docloom.operators.extraction import extract, extract_code
from docloom.operators.rules import CODE_RULES, PROSE_RULES
from docloom.operators.snapshots import BucketedTable
from docloom.operators.stats import entity_type_counts, links_per_content, with_content_count
from docloom.options import ExtractOptions
from docloom.session import cut_lineage, scratch
from docloom.sources.tables import load

# ------------------------------------------------------------------ shared tables, in both forms
MENTIONS_SQL = oracle.prose_sql(NOTES_SQL, PROSE_RULES)
_NAME = oracle.normalized("name", "entity_type")
STORED_SQL = f"""
SELECT doc_id AS content_id, entity_type, name, sha256(entity_type || ':' || name) AS entity_id, relevance, context, rank
FROM (SELECT doc_id, entity_type, {_NAME} AS name, relevance, context, "match" AS rank FROM ({MENTIONS_SQL}))"""
ENTITIES_SQL = f"SELECT DISTINCT entity_id, entity_type, name FROM ({STORED_SQL})"
LINKS_SQL = f"SELECT DISTINCT content_id, entity_id, relevance FROM ({STORED_SQL})"
CONTENT_TYPE = "CASE WHEN lang = 'en' THEN 'text/plain' ELSE 'text/markdown' END"
CONTENT_SQL = f"SELECT doc_id AS content_id, {CONTENT_TYPE} AS content_type, substr(text, 1, 40) AS title, source FROM documents"


def mentions(spark, folder):
    return extract(notes(spark, folder), ["doc_id"], "text", PROSE_RULES, one_pass=True)


def stored(spark, folder, twice=False, rules=PROSE_RULES):
    """Entity and link tables of the annotated documents.

    ``twice`` is for queries that read both: the mentions are checkpointed and extracted once.  ``rules`` may be those of
    the types of entity that a query asks for.
    """
    docs = notes(spark, folder).withColumn("content_type", F.expr(CONTENT_TYPE))
    rows = extract(docs, ["doc_id", "content_type"], "text", rules)
    if twice:
        rows = cut_lineage(rows)
    return C.store_entities(rows.withColumnRenamed("doc_id", "content_id"))


def rules_of(entity_type):
    return tuple(rule for rule in PROSE_RULES if rule.entity_type == entity_type)


def content(spark, folder):
    docs = load(spark, folder, "documents")
    return docs.select(
        F.col("doc_id").alias("content_id"), F.expr(CONTENT_TYPE).alias("content_type"),
        F.substring("text", 1, 40).alias("title"), "source",
    )


# ------------------------------------------------------------------ merge, normalise, filter
@query(
    "m01_merge_longest_description",
    f"""SELECT p_partkey, entity_type, name, arg_max(description, length(description)) AS longest, max(relevance) AS relevance, count(*) AS mention_count
        FROM ({oracle.code_sql(SOURCE, CODE_RULES)}) GROUP BY ALL""".replace(
        "arg_max(description, length(description)) AS longest", "max(length(description)) AS longest"),
)
def m01(spark, folder):
    rows = C.merge_entities(extract_code(files(spark, folder), ["p_partkey"]), ["p_partkey"])
    return rows.select("p_partkey", "entity_type", "name", F.length("description").cast("long").alias("longest"),
                       "relevance", "mention_count")


_RULE_ORDER = " ".join(f"WHEN '{r.rule_id}' THEN {i}" for i, r in enumerate(CODE_RULES))


@query(
    "m02_merge_first_description",
    f"""SELECT p_partkey, entity_type, name, arg_min(description, CASE rule_id {_RULE_ORDER} END) AS description
        FROM ({oracle.code_sql(SOURCE, CODE_RULES)}) GROUP BY 1, 2, 3""",
)
def m02(spark, folder):
    rows = C.merge_entities(extract_code(files(spark, folder), ["p_partkey"]), ["p_partkey"], "first")
    return rows.select("p_partkey", "entity_type", "name", "description")


@query("m03_normalize_names", f'SELECT doc_id, "match", entity_type, {_NAME} AS name FROM ({MENTIONS_SQL})')
def m03(spark, folder):
    rows = mentions(spark, folder)
    return rows.select("doc_id", "match", "entity_type", normalize_name(F.col("name"), F.col("entity_type")).alias("name"))


_RANKED = f"""SELECT doc_id, entity_type, name, relevance, row_number() OVER (
    PARTITION BY doc_id ORDER BY CASE rule_id WHEN 'person' THEN 0 WHEN 'organization' THEN 1 WHEN 'location' THEN 2 WHEN 'date' THEN 3 ELSE 4 END, pattern, sortkey) AS rank"""


@query("p11_filter_confidence", f"SELECT DISTINCT doc_id, entity_type, name, relevance FROM ({MENTIONS_SQL}) WHERE relevance >= 0.7")
def p11(spark, folder):
    rows = C.filter_confidence(C.merge_entities(mentions(spark, folder), ["doc_id"]), 0.7)
    return rows.select("doc_id", "entity_type", "name", "relevance")


@query("p12_filter_types",
       f"SELECT DISTINCT doc_id, entity_type, name, relevance FROM ({MENTIONS_SQL}) WHERE entity_type IN ('date', 'organization')")
def p12(spark, folder):
    rows = C.filter_types(C.merge_entities(mentions(spark, folder), ["doc_id"]), ["date", "organization"])
    return rows.select("doc_id", "entity_type", "name", "relevance")


_TOP = f"""SELECT doc_id, entity_type, name, CAST(rank AS INTEGER) AS rank FROM (
 SELECT doc_id, entity_type, name, row_number() OVER (PARTITION BY doc_id ORDER BY part, encode(name)) AS rank
 FROM (SELECT DISTINCT doc_id, entity_type, name, CASE entity_type WHEN 'date' THEN 1 ELSE 2 END AS part
       FROM ({MENTIONS_SQL}) WHERE relevance >= 0.6 AND entity_type IN ('date', 'product'))) WHERE rank <= 4"""


@query("m04_filter_entities", _TOP)
def m04(spark, folder):
    rows = C.filter_entities(mentions(spark, folder), ["doc_id"], 0.6, ["date", "product"], 4)
    return rows.select("doc_id", "entity_type", "name", "rank")


@query("m11_extract_with_options", _TOP.replace(", CAST(rank AS INTEGER) AS rank", ""))
def m11(spark, folder):
    """The same filter chain inside the row, without a shuffle of mentions."""
    options = ExtractOptions(0.6, ("date", "product"), 4, extract_mentions=True)
    rows = extract(notes(spark, folder), ["doc_id"], "text", PROSE_RULES, None, options)
    return rows.select("doc_id", "entity_type", "name")


@query("w02_first_entities_per_document", _TOP)
def w02(spark, folder):
    return m04(spark, folder)


@query(
    "m05_upsert_entities",
    f"""WITH old AS (SELECT entity_id, entity_type, name, 'known' AS description FROM ({ENTITIES_SQL}) WHERE entity_type = 'person'),
 new AS (SELECT DISTINCT entity_id, entity_type, name, CAST(NULL AS VARCHAR) AS description FROM ({ENTITIES_SQL}))
SELECT * FROM old UNION ALL SELECT * FROM new WHERE entity_id NOT IN (SELECT entity_id FROM old)""",
)
def m05(spark, folder):
    rows = C.normalize_entities(mentions(spark, folder))
    old = rows.filter(F.col("entity_type") == "person").select("entity_type", "name").distinct()
    old = C.with_entity_id(old.withColumn("description", F.lit("known")))
    return C.upsert_entities(old, rows, ["doc_id", "ordinal"])


LINE_LINKS_SQL = """SELECT l_orderkey AS content_id, 'order' AS content_type, l_suppkey AS entity_id,
        arg_max(l_quantity, (l_shipdate, l_linenumber, l_partkey)) AS relevance,
        arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey)) AS context FROM lineitem GROUP BY 1, 2, 3"""
LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey"]


def _line_links(spark, folder):
    """Links of order lines, split by date: the newer ones overwrite the older."""
    rows = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("content_id"), F.lit("order").alias("content_type"),
        F.col("l_suppkey").alias("entity_id"), F.col("l_quantity").alias("relevance"),
        F.col("l_returnflag").alias("context"), *LINE_ORDER,
    )
    newer = F.col("l_shipdate") >= F.lit("1999-01-01").cast(rows.schema["l_shipdate"].dataType)
    return rows.filter(~newer), rows.filter(newer)


@query("m06_upsert_links", LINE_LINKS_SQL)
def m06(spark, folder):
    old, new = _line_links(spark, folder)
    return C.upsert_links(C.upsert_links(None, old, LINE_ORDER), new, LINE_ORDER)


@query("m06_bucketed_upsert", LINE_LINKS_SQL)
def m06_bucketed(spark, folder):
    old, new = (C.upsert_links(None, rows, LINE_ORDER) for rows in _line_links(spark, folder))
    table = BucketedTable(scratch(spark, "links"), tuple(C.LINK)).write(old)
    return table.upsert(new)


@query("m07_stored_entities", f"{ENTITIES_SQL}")
def m07_entities(spark, folder):
    return stored(spark, folder)[0].select("entity_id", "entity_type", "name")


@query("m07_stored_links",
       f"SELECT l.content_id, c.content_type, l.entity_id, l.relevance FROM ({LINKS_SQL}) l JOIN ({CONTENT_SQL}) c USING (content_id)")
def m07_links(spark, folder):
    return stored(spark, folder)[1].select("content_id", "content_type", "entity_id", "relevance")


@query("m08_mentions_with_source",
       f"SELECT doc_id, name, 'video_frame' AS source, 'Frame ' || (doc_id % 7 + 1) AS timestamp FROM ({MENTIONS_SQL}) WHERE entity_type = 'person' UNION ALL "
       f"SELECT doc_id, name, 'audio' AS source, NULL AS timestamp FROM ({MENTIONS_SQL}) WHERE entity_type = 'date'")
def m08(spark, folder):
    rows = extract(notes(spark, folder), ["doc_id"], "text", rules_of("person") + rules_of("date")).select("doc_id", "entity_type", "name")
    frame = C.with_frame(rows.filter(F.col("entity_type") == "person"), F.col("doc_id") % 7)
    audio = C.with_source(rows.filter(F.col("entity_type") == "date"), "audio")
    return frame.unionByName(audio.withColumn("timestamp", F.lit(None).cast("string"))).drop("entity_type")


@query(
    "m10_resolve_alias",
    """WITH alias AS (SELECT alias, arg_max(entity_id, (confidence, entity_id)) AS entity_id FROM (
   SELECT 'S' || s_nationkey AS alias, s_name AS entity_id, s_acctbal AS confidence FROM supplier) GROUP BY alias)
SELECT c_custkey, name, coalesce(a.entity_id, sha256('person:' || name)) AS entity_id
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'S' ELSE 'X' END || c_nationkey AS name FROM customer) c LEFT JOIN alias a ON c.name = a.alias""",
)
def m10(spark, folder):
    names = load(spark, folder, "customer").select(
        "c_custkey", F.lit("person").alias("entity_type"),
        F.concat(F.when(F.col("c_custkey") % 2 == 0, "S").otherwise("X"), F.col("c_nationkey").cast("string")).alias("name"),
    )
    aliases = load(spark, folder, "supplier").select(
        F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("alias"),
        F.col("s_name").alias("entity_id"), F.col("s_acctbal").alias("confidence"),
    )
    return C.resolve_alias(names, aliases).select("c_custkey", "name", "entity_id")


@query(
    "d13_merge_extracted_entities",
    f"""SELECT doc_id, name, entity_type FROM ({MENTIONS_SQL}) WHERE doc_id % 3 <> 0
        UNION ALL SELECT doc_id, source, 'other' FROM documents WHERE doc_id % 3 = 0""",
)
def d13(spark, folder):
    from docloom.operators.metadata import merge_extracted

    own = load(spark, folder, "documents").filter(F.col("doc_id") % 3 == 0).select(
        "doc_id", F.col("source").alias("name"), F.lit("other").alias("entity_type"))
    return merge_extracted(own, mentions(spark, folder).select("doc_id", "name", "entity_type"), ["doc_id"])


@query(
    "w01_first_occurrence",
    f'SELECT doc_id, "match", min(position) AS position FROM ({MENTIONS_SQL}) GROUP BY 1, 2',
)
def w01(spark, folder):
    return mentions(spark, folder).groupBy("doc_id", "match").agg(F.min("position").alias("position"))


# ------------------------------------------------------------------ counts
@query("a02_entity_type_counts", f'SELECT entity_type, count(*) AS "count" FROM ({ENTITIES_SQL}) GROUP BY 1')
def a02(spark, folder):
    return entity_type_counts(stored(spark, folder)[0])


@query(
    "a03_content_count_per_entity",
    f"""SELECT entity_id, entity_type, name, count(DISTINCT content_id) AS content_count FROM ({STORED_SQL}) GROUP BY 1, 2, 3""",
)
def a03(spark, folder):
    entities, links = stored(spark, folder, twice=True)
    return with_content_count(entities.select("entity_id", "entity_type", "name"), links)


@query("a16_links_per_content", f"SELECT content_id, count(*) AS entities FROM ({LINKS_SQL}) GROUP BY 1")
def a16(spark, folder):
    return links_per_content(stored(spark, folder)[1])
