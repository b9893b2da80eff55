"""Chunking of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import oracle
from docloom.catalog.registered import query
from docloom.operators.chunking import chunk, chunk_where_needed
from docloom.operators.consolidate import extract_chunked
from docloom.operators.rules import DOCUMENT_RULES
from docloom.sources.tables import load, spread

# The given lines stand alone; doubling their breaks makes paragraphs.
PARAGRAPHS = "SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents"


def documents(spark, folder):
    return spread(load(spark, folder, "documents").select("doc_id", "text"))


def paragraphs(spark, folder):
    return documents(spark, folder).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def fold_sql(source: str, segments: str, size: int, overlap: int, key: str = "doc_id") -> str:
    """Greedy fold written over strings: current chunk and finished chunks."""
    start = "{'out': CAST([] AS VARCHAR[]), 'cur': '', 'x': ''}"
    full = f"(acc.cur <> '' AND length(acc.cur) + length(s.x) > {size})"
    base = f"(CASE WHEN {full} THEN right(acc.cur, {overlap}) ELSE acc.cur END)" if overlap else (
        f"(CASE WHEN {full} THEN '' ELSE acc.cur END)")
    step = (
        f"{{'out': CASE WHEN {full} THEN list_append(acc.out, acc.cur) ELSE acc.out END, "
        f"'cur': CASE WHEN {base} = '' THEN s.x ELSE {base} || ' ' || s.x END, 'x': ''}}"
    )
    return f"""
WITH src AS ({source}),
parts AS (SELECT {key}, list_transform({segments}, lambda p: {{'out': CAST([] AS VARCHAR[]), 'cur': '', 'x': p}}) AS parts FROM src),
done AS (SELECT {key}, list_reduce(list_prepend({start}, parts), lambda acc, s: {step}) AS r FROM parts),
lists AS (SELECT {key}, CASE WHEN r.cur <> '' THEN list_append(r.out, r.cur) ELSE r.out END AS chunks FROM done)
SELECT {key}, CAST(unnest(range(0, len(chunks))) AS INTEGER) AS chunk_index, unnest(chunks) AS chunk_text FROM lists"""


@query("k01_paragraph_chunks", fold_sql(PARAGRAPHS, r"regexp_split_to_array(text, '\n\s*\n')", 600, 60))
def k01(spark, folder):
    return chunk(paragraphs(spark, folder), ["doc_id"], "paragraph", 600, 60)


@query("k02_line_chunks", fold_sql("SELECT doc_id, text FROM documents", "string_split(text, chr(10))", 400, 40))
def k02(spark, folder):
    return chunk(documents(spark, folder), ["doc_id"], "line", 400, 40)


@query("k02_line_chunks_without_overlap",
       fold_sql("SELECT doc_id, text FROM documents", "string_split(text, chr(10))", 400, 0))
def k02_plain(spark, folder):
    return chunk(documents(spark, folder), ["doc_id"], "line", 400, 0)


@query("k03_token_chunks", fold_sql(
    "SELECT doc_id, text FROM documents", r"regexp_split_to_array(text, '[ \t\n\x0B\f\r]+|[.,;!?]')", 300, 30))
def k03(spark, folder):
    return chunk(documents(spark, folder), ["doc_id"], "token", 300, 30)


@query(
    "k04_character_chunks",
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, text[i * 450 + 1 : i * 450 + 500] AS chunk_text
       FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS i
             FROM documents WHERE length(text) > 0)""",
)
def k04(spark, folder):
    return chunk(documents(spark, folder), ["doc_id"], "character", 500, 50)


@query(
    "k05_size_chunks",
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(octet_length(part) AS INTEGER) AS bytes, md5(part) AS hash
       FROM (SELECT doc_id, i, encode(text)[i * 700 + 1 : i * 700 + 700] AS part
             FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(octet_length(encode(text)) / 700.0) AS BIGINT), 1))) AS i
                   FROM documents WHERE length(text) > 0))""",
)
def k05(spark, folder):
    rows = chunk(documents(spark, folder), ["doc_id"], "size", 700)
    return rows.select(
        "doc_id", "chunk_index", F.octet_length("chunk_bytes").alias("bytes"), F.md5("chunk_bytes").alias("hash"))


def _blank_line_sql(size: int, overlap: int) -> str:
    blank = "(s.x = '' AND acc.cur <> '')"
    whole = "acc.cur || chr(10) || chr(10)"
    closes = f"({blank} AND length(acc.cur) + 2 >= {size})"
    step = (
        f"{{'out': CASE WHEN {closes} THEN list_append(acc.out, {whole}) ELSE acc.out END, "
        f"'cur': CASE WHEN {closes} THEN regexp_replace(right({whole} || chr(10), {overlap}), '\\n+$', '') "
        f"WHEN {blank} THEN {whole} ELSE acc.cur || s.x || chr(10) END, 'x': ''}}"
    )
    start = "{'out': CAST([] AS VARCHAR[]), 'cur': '', 'x': ''}"
    return f"""
WITH src AS ({PARAGRAPHS}),
parts AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda p: {{'out': CAST([] AS VARCHAR[]), 'cur': '', 'x': p}}) AS parts
          FROM src WHERE length(text) > 0),
done AS (SELECT doc_id, list_reduce(list_prepend({start}, parts), lambda acc, s: {step}) AS r FROM parts),
lists AS (SELECT doc_id, CASE WHEN r.cur <> '' THEN list_append(r.out, r.cur) ELSE r.out END AS chunks FROM done)
SELECT doc_id, CAST(unnest(range(0, len(chunks))) AS INTEGER) AS chunk_index, unnest(chunks) AS chunk_text FROM lists"""


@query("k06_blank_line_chunks", _blank_line_sql(800, 80))
def k06(spark, folder):
    return chunk(paragraphs(spark, folder), ["doc_id"], "blank_line", 800, 80)


def _sentence_sql(size: int, overlap: int) -> str:
    """Pieces end at a mark and a blank; those that end in an abbreviation are joined to the next one."""
    word = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
    whole = "(acc.cur || s.x)"
    ends = (
        f"(regexp_matches({whole}, '[.?!]\\s$') AND NOT regexp_matches({whole}, '{word}\\.{word}.\\s$') "
        f"AND NOT regexp_matches({whole}, '[A-Z][a-z]\\.\\s$'))"
    )
    split = (
        f"{{'out': CASE WHEN {ends} THEN list_append(acc.out, {whole}[:-2]) ELSE acc.out END, "
        f"'cur': CASE WHEN {ends} THEN '' ELSE {whole} END, 'x': ''}}"
    )
    start = "{'out': CAST([] AS VARCHAR[]), 'cur': '', 'x': ''}"
    empty = "{'out': CAST([] AS VARCHAR[]), 'parts': CAST([] AS VARCHAR[]), 'size': CAST(0 AS BIGINT), 'x': ''}"
    full = f"(len(acc.parts) > 0 AND acc.size + length(s.x) > {size})"
    tail = (
        f"len(list_filter(range(1, len(acc.parts) + 1), lambda i: "
        f"list_sum(list_transform(list_reverse(acc.parts)[1:i], lambda p: length(p) + 1)) - 1 <= {overlap}))"
    )
    kept = f"(CASE WHEN {full} THEN acc.parts[len(acc.parts) - {tail} + 1:] ELSE acc.parts END)"
    kept_size = f"coalesce(list_sum(list_transform({kept}, lambda p: length(p) + 1)), 0)"
    fold = (
        f"{{'out': CASE WHEN {full} THEN list_append(acc.out, array_to_string(acc.parts, ' ')) ELSE acc.out END, "
        f"'parts': list_append({kept}, s.x), 'size': CAST({kept_size} + length(s.x) + 1 AS BIGINT), 'x': ''}}"
    )
    return f"""
WITH pieces AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).*?[.?!]\\s|.+', 0), lambda p: {{'out': CAST([] AS VARCHAR[]), 'cur': '', 'x': p}}) AS ps FROM documents),
ends AS (SELECT doc_id, list_reduce(list_prepend({start}, ps), lambda acc, s: {split}) AS r FROM pieces),
sentences AS (SELECT doc_id, list_append(r.out, r.cur) AS ss FROM ends),
done AS (SELECT doc_id, list_reduce(list_prepend({empty}, list_transform(ss, lambda p: {{'out': CAST([] AS VARCHAR[]), 'parts': CAST([] AS VARCHAR[]), 'size': CAST(0 AS BIGINT), 'x': p}})), lambda acc, s: {fold}) AS r FROM sentences),
lists AS (SELECT doc_id, list_append(r.out, array_to_string(r.parts, ' ')) AS chunks FROM done)
SELECT doc_id, CAST(unnest(range(0, len(chunks))) AS INTEGER) AS chunk_index, unnest(chunks) AS chunk_text FROM lists"""


@query("k07_sentence_chunks", _sentence_sql(500, 100))
def k07(spark, folder):
    return chunk(documents(spark, folder), ["doc_id"], "sentence", 500, 100)


_LONG = fold_sql("SELECT doc_id, text FROM documents WHERE length(text) > 2000", "string_split(text, chr(10))", 2000, 200)


@query("k_chunks_where_needed",
       f"{_LONG} UNION ALL SELECT doc_id, CAST(0 AS INTEGER), text FROM documents WHERE length(text) <= 2000")
def k_needed(spark, folder):
    return chunk_where_needed(documents(spark, folder), ["doc_id"], F.length("text") > 2000, "line", 2000, 200)


_CHUNKS = fold_sql("SELECT doc_id, text FROM documents", "string_split(text, chr(10))", 1500, 100)


@query(
    "k10_chunked_extraction",
    f"""WITH mentions AS ({oracle.prose_sql(f"SELECT doc_id, chunk_index, doc_id || ':' || chunk_index AS ck, chunk_text AS text FROM ({_CHUNKS})", DOCUMENT_RULES, "doc_id, ck")})
SELECT doc_id, entity_type, name, max(relevance) AS relevance, count(*) AS mention_count FROM mentions GROUP BY 1, 2, 3""",
)
def k10(spark, folder):
    rows = extract_chunked(documents(spark, folder), ["doc_id"], "line", 1500, 100, rules=DOCUMENT_RULES)
    return rows.select("doc_id", "entity_type", "name", "relevance", "mention_count")
