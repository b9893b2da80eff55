"""Full-text search over documents, pages and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog.entities import ENTITIES_SQL, stored
from docloom.catalog.registered import query
from docloom.operators import search as R
from docloom.operators.joins import in_search_result
from docloom.operators.stored_search import SubstringIndex, TokenIndex
from docloom.session import scratch
from docloom.sources.tables import load, spread

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
POSTINGS_SQL = f"SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY 1, 2"


def documents(spark, folder):
    return spread(load(spark, folder, "documents").select("doc_id", "text", "source"))


def postings(spark, folder):
    return R.build_index(documents(spark, folder), "doc_id", ["text"])


def stored_postings(spark, folder):
    index = TokenIndex(scratch(spark, "postings"), "doc_id")
    index.write(postings(spark, folder))
    return index


@query("r01_build_index", POSTINGS_SQL)
def r01(spark, folder):
    return postings(spark, folder)


@query("r01_stored_index", POSTINGS_SQL)
def r01_stored(spark, folder):
    return stored_postings(spark, folder).read(spark)


@query(
    "r02_build_entity_index",
    f"""SELECT token, entity_id, count(*) AS tf FROM (
      SELECT entity_id, unnest(list_filter(regexp_split_to_array(lower(name || ' ' || entity_type), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS token
      FROM ({ENTITIES_SQL})) GROUP BY 1, 2""",
)
def r02(spark, folder):
    return R.build_entity_index(stored(spark, folder)[0])


@query(
    "r03_refresh_index",
    f"""SELECT token, doc_id, count(*) AS tf FROM (
      SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(CASE WHEN doc_id % 5 = 1 THEN source || ' changed' ELSE text END), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS token
      FROM documents WHERE doc_id % 5 <> 2) GROUP BY 1, 2""",
)
def r03(spark, folder):
    docs = documents(spark, folder)
    changed = docs.filter("doc_id % 5 = 1").withColumn("text", F.concat("source", F.lit(" changed")))
    return R.refresh_index(postings(spark, folder), changed, "doc_id", ["text"], docs.filter("doc_id % 5 = 2"))


@query(
    "r04_prefix_search",
    f"""SELECT doc_id, sum(tf)::BIGINT AS hits FROM ({POSTINGS_SQL}) WHERE token = 'the' OR token = 'and' OR starts_with(token, 'thr')
        GROUP BY doc_id HAVING count(*) FILTER (token = 'the') > 0 AND count(*) FILTER (token = 'and') > 0 AND count(*) FILTER (starts_with(token, 'thr')) > 0""",
)
def r04(spark, folder):
    return stored_postings(spark, folder).search(spark, "The AND thr")


@query(
    "r05_substring_search",
    "SELECT page_id, url FROM pages WHERE contains(lower(html), 'tion the') OR contains(lower(url), 'tion the')",
)
def r05(spark, folder):
    return R.search_like(spread(load(spark, folder, "pages")), "TION the", ["html", "url"]).select("page_id", "url")


@query(
    "r05_stored_substring_search",
    "SELECT page_id, url FROM pages WHERE contains(lower(html), 'tion the') OR contains(lower(url), 'tion the')",
)
def r05_stored(spark, folder):
    index = SubstringIndex(scratch(spark, "grams"), "page_id", ("html", "url"))
    index.build(load(spark, folder, "pages"))
    return index.search(spark, "TION the").select("page_id", "url")


def _snippet_sql(column: str, query_text: str, table: str) -> str:
    at = f"(strpos(lower({column}), '{query_text.lower()}') - 1)"
    start = f"greatest({at} - 30, 0)"
    end = f"least(length({column}), {start} + {len(query_text)} + 60)"
    return (
        f"CASE WHEN {at} >= 0 THEN regexp_replace((CASE WHEN {start} > 0 THEN '...' ELSE '' END) || {column}[{start} + 1 : {end}] || "
        f"(CASE WHEN {end} < length({column}) THEN '...' ELSE '' END), '({query_text})', '<mark>\\1</mark>', 'gi') ELSE 'Match found in {table}' END"
    )


@query(
    "r06_snippets",
    f"SELECT doc_id, {_snippet_sql('text', 'License', 'documents')} AS snippet FROM documents",
)
def r06(spark, folder):
    return documents(spark, folder).select("doc_id", R.snippet(["text"], "License", "documents").alias("snippet"))


_HITS = f"""SELECT 'text' AS content_type, CAST(doc_id AS VARCHAR) AS id, {_snippet_sql('text', 'that', 'text')} AS snippet FROM documents WHERE contains(lower(text), 'that')
 UNION ALL SELECT 'chat', conv_id || '.' || turn, {_snippet_sql('text', 'that', 'chat')} FROM conversations WHERE contains(lower(text), 'that')"""


def _tables(spark, folder):
    chat = load(spark, folder, "conversations").withColumn(
        "id", F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")))
    return {
        "text": (documents(spark, folder), "doc_id", ["text"]),
        "chat": (chat, "id", ["text"]),
        "page": (load(spark, folder, "pages"), "page_id", ["html"]),
    }


@query("u04_search_over_tables", _HITS)
def u04(spark, folder):
    return R.search_content(_tables(spark, folder), "That", ["text", "chat"])


@query(
    "r07_limited_search",
    f"SELECT *, (SELECT count(*) FROM ({_HITS})) AS total_results FROM ({_HITS}) ORDER BY content_type, encode(id) LIMIT 50",
)
def r07(spark, folder):
    return R.limited(R.search_content(_tables(spark, folder), "That", ["text", "chat"]))


@query(
    "r08_content_details",
    """SELECT event_id, event_type, CASE WHEN json_valid(metadata) THEN CAST(CAST(metadata AS JSON) ->> '$' AS VARCHAR) ELSE metadata END AS metadata
       FROM (SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN '{"k":1}' ELSE 'text ' || props END AS metadata FROM events) WHERE event_id IN (17)""",
)
def r08(spark, folder):
    rows = load(spark, folder, "events").select(
        "event_id", "event_type",
        F.when(F.col("event_id") % 2 == 0, '{"k":1}').otherwise(F.concat(F.lit("text "), "props")).alias("metadata"))
    return R.content_details(rows, "event_id", 17)


@query(
    "j12_rows_in_search_result",
    f"""SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM ({POSTINGS_SQL}) WHERE starts_with(token, 'license'))""",
)
def j12(spark, folder):
    hits = stored_postings(spark, folder).search(spark, "license")
    return in_search_result(load(spark, folder, "documents").select("doc_id", "source"), hits, "doc_id")
