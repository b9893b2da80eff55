"""Detection, routing and metadata of content."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog import oracle
from docloom.catalog.code import SOURCE
from docloom.catalog.registered import query
from docloom.catalog.views import CODE_SQL, NOTES_SQL, code_files, notes
from docloom.functions.json_columns import entities_from_json, merge_json, salvage_json
from docloom.functions.language import language_by_path, language_by_text, outline_language, outline_language_by_text
from docloom.functions.mime import (
    MIME_BY_EXTENSION, detect_content_type, is_text_type, mime_by_extension, mime_by_first_line, mime_by_text,
)
from docloom.functions.names import validate_type
from docloom.functions.text import md5_hash, token_estimate
from docloom.operators import metadata as D
from docloom.operators.chunking import chunk_parent
from docloom.operators.extraction import explode_once, extract_result
from docloom.operators.outline import extract_outline
from docloom.operators.registry import Registry, apply_filters, extract_with_analyser
from docloom.operators.routing import (
    DEFAULT_EXTRACTORS, content_kind, effective_strategy, matching_content_types, reject_short,
    resolve_extractor, should_chunk, should_chunk_bytes,
)
from docloom.operators.rules import DOCUMENT_RULES, PROSE_RULES
from docloom.options import ChunkOptions, ExtractOptions
from docloom.sources.tables import load, spread

# A file name per web page: its suffix comes from the page number.
_SUFFIXES = "html,PY,md,json,unknown,tar.gz,docx,JPEG,noext,csv,rs,mp4,pdf"
_PAGE_PATH = (
    "CASE WHEN split_part('{s}', ',', CAST(page_id % 13 + 1 AS INT)) = 'noext' THEN concat('/data/page', CAST(page_id AS STRING)) "
    "ELSE concat('/data/page', CAST(page_id AS STRING), '.', split_part('{s}', ',', CAST(page_id % 13 + 1 AS INT))) END"
).format(s=_SUFFIXES)
_MIME_CASE = "CASE suffix " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MIME_BY_EXTENSION.items()) + " END"
_PAGES = (
    f"SELECT *, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS suffix "
    f"FROM (SELECT page_id, html, {_PAGE_PATH} AS path FROM pages)"
)


def page_files(spark, folder):
    return spread(load(spark, folder, "pages")).select("page_id", "html", F.expr(_PAGE_PATH).alias("path"))


@query("p01_mime_by_extension", f"SELECT page_id, path, {_MIME_CASE} AS mime FROM ({_PAGES})")
def p01(spark, folder):
    return page_files(spark, folder).select("page_id", "path", mime_by_extension(F.col("path")).alias("mime"))


def sniff_sql(text: str) -> str:
    head = f"trim({text}, ' ' || chr(9) || chr(10) || chr(13))"
    return f"""CASE
 WHEN starts_with({head}, '<!DOCTYPE html>') OR starts_with({head}, '<html') THEN 'text/html'
 WHEN starts_with({head}, '<?xml') THEN 'application/xml'
 WHEN (starts_with({head}, '{{') OR starts_with({head}, '[')) AND json_valid({text}) THEN 'application/json'
 WHEN contains({text}, '# ') OR contains({text}, '## ') OR contains({text}, '```') OR contains({text}, '**') THEN 'text/markdown'
 WHEN contains({text}, 'def ') OR contains({text}, 'import ') OR contains({text}, 'class ') THEN 'text/x-python'
 WHEN contains({text}, 'function ') OR contains({text}, 'const ') OR contains({text}, 'let ') OR contains({text}, 'var ') THEN 'text/javascript'
 WHEN contains({text}, '#!/bin/') OR contains({text}, 'export ') OR starts_with({text}, '#!') THEN 'application/x-sh'
 WHEN contains({text}, ',') AND len(list_filter(string_split({text}, chr(10)), lambda l: NOT contains(l, ','))) = 0 THEN 'text/csv'
 ELSE 'text/plain' END"""


# Every kind of text the tables hold, under one key.
_TEXTS = f"""SELECT 'd' || doc_id AS id, text FROM documents UNION ALL
SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'c' || p_partkey, text FROM ({CODE_SQL}) UNION ALL
SELECT 'e' || event_id, props FROM events UNION ALL SELECT 't' || conv_id || '.' || turn, text FROM conversations"""


def all_texts(spark, folder):
    def part(df, letter, key, text):
        return df.select(F.concat(F.lit(letter), key).alias("id"), F.col(text).alias("text"))

    k = lambda c: F.col(c).cast("string")
    parts = [
        part(spread(load(spark, folder, "documents").select("doc_id", "text")), "d", k("doc_id"), "text"),
        part(spread(load(spark, folder, "pages").select("page_id", "html")), "p", k("page_id"), "html"),
        part(code_files(spark, folder), "c", k("p_partkey"), "text"),
        part(load(spark, folder, "events"), "e", k("event_id"), "props"),
        part(load(spark, folder, "conversations"), "t", F.concat(k("conv_id"), F.lit("."), k("turn")), "text"),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


@query("p02_mime_by_text", f"SELECT id, {sniff_sql('text')} AS mime FROM ({_TEXTS})")
def p02(spark, folder):
    return all_texts(spark, folder).select("id", mime_by_text(F.col("text")).alias("mime"))


@query(
    "p03_detect_content_type",
    f"SELECT page_id, coalesce({_MIME_CASE}, {sniff_sql('substr(html, 1, 4096)')}) AS mime FROM ({_PAGES})",
)
def p03(spark, folder):
    return page_files(spark, folder).select(
        "page_id", detect_content_type(F.col("path"), F.col("html")).alias("mime"))


_FIRST = "string_split(text, chr(10))[1]"


@query(
    "p04_mime_by_first_line",
    f"""SELECT id, CASE WHEN regexp_matches({_FIRST}, '^\\s*\\{{.*\\}}\\s*$') THEN 'application/json'
 WHEN starts_with({_FIRST}, '<?xml') OR starts_with({_FIRST}, '<html') OR starts_with({_FIRST}, '<!DOCTYPE') THEN 'application/xml'
 WHEN regexp_matches({_FIRST}, '^(import|from|def|class)') THEN 'text/x-python' ELSE 'text/plain' END AS mime
 FROM ({_TEXTS})""",
)
def p04(spark, folder):
    return all_texts(spark, folder).select("id", mime_by_first_line(F.col("text")).alias("mime"))


@query("p05_language_by_path", f"SELECT p_partkey, path, language FROM ({SOURCE})")
def p05(spark, folder):
    return code_files(spark, folder).select("p_partkey", "path", language_by_path(F.col("path")).alias("language"))


def _any(*words: str) -> str:
    return "(" + " OR ".join(f"contains(text, '{w}')" for w in words) + ")"


@query(
    "p06_language_by_text",
    f"""SELECT id, CASE
 WHEN {_any('def ')} AND {_any(':')} AND {_any('import ', 'from ')} THEN 'python'
 WHEN {_any('function ', '=>')} AND {_any('const ', 'let ', 'var ')}
      AND {_any('interface ', ': string', ': number', ': boolean', '<T>')} THEN 'typescript'
 WHEN {_any('function ', '=>')} AND {_any('const ', 'let ', 'var ')} THEN 'javascript'
 WHEN {_any('public class ', 'private class ')} OR ({_any('import java.')} AND {_any('}')}) THEN 'java'
 WHEN ({_any('#include <')} OR ({_any('int main(')} AND {_any('}')})) AND {_any('std::', 'namespace ', 'class ', 'template<')} THEN 'cpp'
 WHEN {_any('#include <')} OR ({_any('int main(')} AND {_any('}')}) THEN 'c'
 WHEN {_any('package ')} AND {_any('func ')} AND {_any('import (')} THEN 'go'
 WHEN {_any('def ')} AND {_any('end')} AND {_any('require ', 'class ')} THEN 'ruby'
 WHEN {_any('<?php')} OR ({_any('function ')} AND {_any('$')}) THEN 'php'
 WHEN {_any('fn ')} AND {_any('-> ')} AND {_any('let mut ')} THEN 'rust'
 ELSE 'unknown' END AS language FROM ({_TEXTS})""",
)
def p06(spark, folder):
    return all_texts(spark, folder).select("id", language_by_text(F.col("text")).alias("language"))


@query(
    "p07_p08_text_type_and_chunk_admission",
    f"""SELECT id, mime, (starts_with(mime, 'text/') OR mime IN ('application/json', 'application/xml', 'application/javascript')) AS is_text,
 (starts_with(mime, 'text/') OR mime IN ('application/json', 'application/xml', 'application/javascript')) AND length(text) > 2000 AS by_characters,
 octet_length(encode(text)) > 2000 AND (starts_with(mime, 'text/') OR mime IN ('application/json', 'application/xml', 'application/pdf', 'application/javascript')) AS by_bytes
 FROM (SELECT id, text, {sniff_sql('text')} AS mime FROM ({_TEXTS}))""",
)
def p07_p08(spark, folder):
    rows = all_texts(spark, folder).withColumn("mime", mime_by_text(F.col("text")))
    return rows.select(
        "id", "mime", is_text_type(F.col("mime")).alias("is_text"),
        should_chunk(F.col("text"), F.col("mime"), ChunkOptions(max_size=2000)).alias("by_characters"),
        should_chunk_bytes(F.octet_length("text"), F.col("mime"), 2000).alias("by_bytes"),
    )


@query(
    "p09_content_kind",
    f"""SELECT page_id, mime, CASE WHEN starts_with(mime, 'image/') THEN 'image' WHEN starts_with(mime, 'video/') THEN 'video'
 WHEN mime = 'application/pdf' THEN 'document' WHEN mime = 'text/plain' THEN 'text'
 WHEN mime IN ('text/x-python', 'text/x-c', 'text/x-java', 'application/json', 'application/xml', 'text/x-javascript', 'text/x-typescript') THEN 'code'
 ELSE 'generic' END AS kind
 FROM (SELECT page_id, coalesce({_MIME_CASE}, 'text/plain') AS mime FROM ({_PAGES}))""",
)
def p09(spark, folder):
    mime = F.coalesce(mime_by_extension(F.col("path")), F.lit("text/plain"))
    return page_files(spark, folder).select("page_id", mime.alias("mime")).withColumn("kind", content_kind(F.col("mime")))


@query(
    "j10_matching_content_types",
    f"""SELECT page_id, mime AS content_type, t.name AS type_name
 FROM (SELECT page_id, coalesce({_MIME_CASE}, 'text/plain') AS mime FROM ({_PAGES}))
 JOIN (VALUES ('text', 'text/%'), ('image', 'image/%'), ('video', 'video/%'), ('document', 'application/pdf'), ('code', 'text/x-%'),
       ('json', 'application/json'), ('xml', 'application/xml'), ('generic', '%/%')) t(name, pattern) ON mime LIKE t.pattern""",
)
def j10(spark, folder):
    mime = F.coalesce(mime_by_extension(F.col("path")), F.lit("text/plain"))
    rows = page_files(spark, folder).select("page_id", mime.alias("content_type"))
    return matching_content_types(rows, ["page_id"])


_EXACT = {k: v for k, v in DEFAULT_EXTRACTORS.items() if not k.endswith("*")}
_CASES = " ".join(f"WHEN mime = '{k}' THEN '{v}'" for k, v in _EXACT.items())


@query(
    "p10_resolve_extractor",
    f"""SELECT page_id, mime AS content_type, extractor, extractor IS NOT NULL AS success,
 CASE WHEN extractor IS NULL THEN 'No entity extractor found for content type: ' || mime END AS error
 FROM (SELECT page_id, mime, CASE {_CASES} WHEN mime LIKE 'text/%' THEN 'text' WHEN mime LIKE 'image/%' THEN 'image'
        WHEN mime LIKE 'video/%' THEN 'video' WHEN mime LIKE 'application/%' THEN 'fallback' END AS extractor
       FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'audio/mpeg' ELSE coalesce({_MIME_CASE}, 'text/plain') END AS mime FROM ({_PAGES})))""",
)
def p10(spark, folder):
    mime = F.when(F.col("page_id") % 7 == 0, "audio/mpeg").otherwise(
        F.coalesce(mime_by_extension(F.col("path")), F.lit("text/plain")))
    return resolve_extractor(page_files(spark, folder).select("page_id", mime.alias("content_type")))


@query(
    "p13_validate_type",
    """SELECT event_id, kind, CASE WHEN lower(kind) IN ('person', 'organization', 'location', 'date', 'product', 'technology', 'event', 'other')
        THEN lower(kind) ELSE 'other' END AS entity_type
       FROM (SELECT event_id, split_part('Person,EVENT,concept,date,Location,widget', ',', CAST(event_id % 6 + 1 AS INT)) AS kind FROM events)""",
)
def p13(spark, folder):
    kind = F.expr("split_part('Person,EVENT,concept,date,Location,widget', ',', CAST(event_id % 6 + 1 AS INT))")
    rows = load(spark, folder, "events").select("event_id", kind.alias("kind"))
    return rows.withColumn("entity_type", validate_type(F.col("kind")))


@query("p14_reject_short", f"SELECT id FROM ({_TEXTS}) WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 10")
def p14(spark, folder):
    return reject_short(all_texts(spark, folder)).select("id")


@query(
    "k08_chunk_parent",
    f"""SELECT p_partkey, '{{"chunk_info":{{"original_file":"' || split_part(path, '/', 2) || '","chunking_strategy":"size","chunk_size":500000,"chunk_overlap":5000,"file_size":'
 || octet_length(encode(text)) || '}}}}' AS analysis FROM ({CODE_SQL})""",
)
def k08(spark, folder):
    return chunk_parent(code_files(spark, folder), ["p_partkey"], "size", "path")


_CHUNKABLE = (
    "(starts_with(mime, 'text/') OR mime IN ('application/json', 'application/xml', 'application/pdf') OR contains(mime, 'script'))"
)
_CODE_MIMES = "('text/x-python', 'text/x-c', 'text/x-java', 'text/x-javascript', 'text/x-typescript')"


@query(
    "k09_effective_strategy",
    f"""SELECT page_id, mime, asked, CASE WHEN NOT {_CHUNKABLE} THEN 'size' WHEN mime IN {_CODE_MIMES} AND asked = 'size' THEN 'paragraph' ELSE asked END AS strategy
 FROM (SELECT page_id, coalesce({_MIME_CASE}, 'text/plain') AS mime, split_part('size,paragraph,sentence', ',', CAST(page_id % 3 + 1 AS INT)) AS asked FROM ({_PAGES}))""",
)
def k09(spark, folder):
    rows = page_files(spark, folder).select(
        "page_id", F.coalesce(mime_by_extension(F.col("path")), F.lit("text/plain")).alias("mime"),
        F.expr("split_part('size,paragraph,sentence', ',', CAST(page_id % 3 + 1 AS INT))").alias("asked"),
    )
    return rows.withColumn("strategy", effective_strategy(F.col("mime"), F.col("asked")))


# ------------------------------------------------------------------------------- metadata
def _lines(condition: str, edit: str = "l") -> str:
    kept = f"list_filter(string_split(text, chr(10)), lambda l: {condition})"
    return f"array_to_string(list_transform({kept}, lambda l: {edit}), '|')"


_BREAKS = "CAST(length(text) - length(replace(text, chr(10), '')) AS INTEGER)"
_BYTES = "CAST(octet_length(encode(text)) AS INTEGER)"


def _struct(df, key, struct):
    return df.select(key, struct.alias("m")).select(key, "m.*")


@query(
    "d01_text_metadata",
    f"""SELECT id, {_BREAKS} AS lines, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS INTEGER) AS words,
        {_BYTES} AS size, 'UTF-8' AS encoding FROM ({_TEXTS})""",
)
def d01(spark, folder):
    return _struct(all_texts(spark, folder), "id", D.text_metadata(F.col("text")))


@query(
    "d02_markdown_metadata",
    f"""SELECT id, regexp_replace(string_split(text, chr(10))[1], '^#* ', '') AS title,
        {_lines("regexp_matches(l, '^#{1,6} ')", "regexp_replace(l, '^#* ', '')")} AS headings,
        CAST(len(list_filter(string_split(text, chr(10)), lambda l: contains(l, '```'))) AS INTEGER) AS codeblocks FROM ({_TEXTS})""",
)
def d02(spark, folder):
    return _struct(all_texts(spark, folder), "id", D.markdown_metadata(F.col("text")))


@query(
    "d03_html_metadata",
    r"""SELECT page_id, array_to_string(regexp_extract_all(html, '<title>([^<\n]*)</title>', 1), chr(10)) AS title,
        array_to_string(regexp_extract_all(html, 'href="([^"\n]*)"', 1), '|') AS links,
        array_to_string(regexp_extract_all(html, 'src="([^"\n]*)"', 1), '|') AS images,
        array_to_string(list_filter(list_transform(string_split(html, chr(10)), lambda l: regexp_replace(l, '<[^>]*>', '', 'g')), lambda l: l <> ''), chr(10)) AS text
       FROM pages""",
)
def d03(spark, folder):
    rows = page_files(spark, folder).select(
        "page_id", D.html_metadata(F.col("html")).alias("m"), D.html_text(F.col("html")).alias("text"))
    return rows.select("page_id", "m.*", "text")


@query(
    "d04_csv_metadata",
    f"""SELECT id, string_split(text, chr(10))[1] AS headers, {_BREAKS} AS rows,
        CAST(CASE WHEN string_split(text, chr(10))[1] = '' THEN 0 ELSE len(string_split(string_split(text, chr(10))[1], ',')) END AS INTEGER) AS columns
       FROM ({_TEXTS})""",
)
def d04(spark, folder):
    return _struct(all_texts(spark, folder), "id", D.csv_metadata(F.col("text")))


@query(
    "d05_json_metadata",
    """SELECT event_id, json_valid(doc) AS valid, CAST(octet_length(encode(doc)) AS INTEGER) AS size,
        coalesce(CASE WHEN json_valid(doc) THEN array_to_string(list_sort(json_keys(doc)), '|') END, '') AS keys
       FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"z": ' || event_id || ', "a": ' || props || '}' ELSE 'broken ' || props END AS doc FROM events)""",
)
def d05(spark, folder):
    doc = F.expr(
        """CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('{"z": ', CAST(event_id AS STRING), ', "a": ', props, '}') ELSE concat('broken ', props) END"""
    )
    return _struct(load(spark, folder, "events").withColumn("doc", doc), "event_id", D.json_metadata(F.col("doc")))


@query(
    "d06_xml_metadata",
    r"""SELECT page_id, replace(regexp_extract(html, '<[^? \n][^ >\n]*', 0), '<', '') AS root_element,
        CAST(octet_length(encode(html)) AS INTEGER) AS size FROM pages""",
)
def d06(spark, folder):
    return _struct(page_files(spark, folder), "page_id", D.xml_metadata(F.col("html")))


def _code(spark, folder):
    return code_files(spark, folder)


@query(
    "d07_python_metadata",
    f"""SELECT p_partkey, {_lines("regexp_matches(l, '^import|^from .* import')")} AS imports,
        {_lines("regexp_matches(l, '^class ')", "regexp_replace(l, 'class ([^(:]*).*', '\\1')")} AS classes,
        {_lines("regexp_matches(l, '^def ')", "regexp_replace(l, 'def ([^(]*).*', '\\1')")} AS functions,
        coalesce(regexp_replace(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '\"\"\"'))[1], '^\"\"\"(.*)\"\"\"', '\\1'), '') AS docstring,
        'python' AS language FROM ({CODE_SQL})""",
)
def d07(spark, folder):
    return _struct(_code(spark, folder), "p_partkey", D.python_metadata(F.col("text")))


@query(
    "d08_javascript_metadata",
    f"""SELECT p_partkey, {_lines("regexp_matches(l, 'import |require\\(')")} AS imports,
        {_lines("regexp_matches(l, 'function [a-zA-Z0-9_]+\\(')", "regexp_replace(l, 'function ([^(]*).*', '\\1')")} AS functions,
        {_lines("regexp_matches(l, 'class [a-zA-Z0-9_]+ ')", "regexp_replace(l, 'class ([^ {]*).*', '\\1')")} AS classes,
        'javascript' AS language FROM ({CODE_SQL})""",
)
def d08(spark, folder):
    return _struct(_code(spark, folder), "p_partkey", D.javascript_metadata(F.col("text")))


@query(
    "d09_c_metadata",
    f"""SELECT p_partkey, {_lines("regexp_matches(l, '^#include')")} AS includes,
        {_lines("regexp_matches(l, '^[a-zA-Z0-9_]+ [a-zA-Z0-9_]+\\(')", "regexp_replace(l, '[a-zA-Z0-9_]* ([^(]*).*', '\\1')")} AS functions,
        {_lines("regexp_matches(l, '^struct [a-zA-Z0-9_]+ ')", "regexp_replace(l, 'struct ([^ {]*).*', '\\1')")} AS structs,
        CASE WHEN contains(text, 'class') OR contains(text, 'namespace') OR regexp_matches(path, '\\.(cpp|cxx|cc|hpp)$') THEN 'c++' ELSE 'c' END AS language
       FROM ({CODE_SQL})""",
)
def d09(spark, folder):
    return _struct(_code(spark, folder), "p_partkey", D.c_metadata(F.col("text"), F.col("path")))


@query(
    "d10_shell_metadata",
    f"""SELECT p_partkey, CASE WHEN starts_with(text, '#!') THEN string_split(text, chr(10))[1] ELSE '' END AS shebang,
        {_lines("regexp_matches(l, '^[a-zA-Z0-9_]+\\(\\)')", "regexp_replace(l, '([^(]*).*', '\\1')")} AS functions,
        CASE WHEN starts_with(text, '#!') AND contains(string_split(text, chr(10))[1], 'bash') THEN 'bash' ELSE 'sh' END AS shell_type, 'shell' AS language
       FROM ({CODE_SQL})""",
)
def d10(spark, folder):
    return _struct(_code(spark, folder), "p_partkey", D.shell_metadata(F.col("text")))


@query(
    "d11_code_metadata",
    f"""SELECT p_partkey, CASE suffix WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'c' THEN 'c'
         WHEN 'cpp' THEN 'c++' WHEN 'java' THEN 'java' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust'
         WHEN 'sh' THEN 'shell' ELSE 'unknown' END AS language, suffix AS extension, {_BREAKS} AS lines, {_BYTES} AS size FROM ({CODE_SQL})""",
)
def d11(spark, folder):
    return _struct(_code(spark, folder), "p_partkey", D.code_metadata(F.col("text"), F.col("path")))


@query(
    "d12_fallback_metadata",
    f"""SELECT page_id, CAST(octet_length(encode(html)) AS INTEGER) AS size, mime AS mimetype,
        CASE WHEN starts_with(mime, 'text/') OR mime IN ('application/json', 'application/xml', 'application/javascript') THEN html END AS text
       FROM (SELECT page_id, html, coalesce({_MIME_CASE}, 'application/octet-stream') AS mime FROM ({_PAGES}))""",
)
def d12(spark, folder):
    mime = F.coalesce(mime_by_extension(F.col("path")), F.lit("application/octet-stream"))
    rows = page_files(spark, folder).withColumn("mime", mime)
    return rows.select(
        "page_id", D.fallback_metadata(F.col("html"), F.col("mime")).alias("m"),
        D.fallback_text(F.col("html"), F.col("mime")).alias("text")).select("page_id", "m.*", "text")


@query(
    "d14_result_metadata",
    f"""SELECT p_partkey, CAST(length(text) AS INTEGER) AS size, split_part(path, '/', 2) AS file_name, DATE '2024-02-01' AS processed_at FROM ({CODE_SQL})""",
)
def d14(spark, folder):
    now = F.lit("2024-02-01").cast("date")
    return _struct(_code(spark, folder), "p_partkey", D.result_metadata(F.col("text"), F.col("path"), now))


@query("d15_token_estimate", f"SELECT id, CAST(octet_length(encode(text)) // 4 AS BIGINT) AS tokens FROM ({_TEXTS})")
def d15(spark, folder):
    return all_texts(spark, folder).select("id", token_estimate(F.col("text")).alias("tokens"))


@query("d16_content_hash", f"SELECT id, md5(text) AS hash FROM ({_TEXTS})")
def d16(spark, folder):
    return all_texts(spark, folder).select("id", md5_hash(F.col("text")).alias("hash"))


@query("d16_exact_duplicates", "SELECT md5(text) AS hash, count(*) AS items FROM documents GROUP BY 1 HAVING count(*) > 1")
def d16_duplicates(spark, folder):
    return D.exact_duplicates(load(spark, folder, "documents"))


# ------------------------------------------------------------------------------- JSON columns
_ANSWER = """CASE event_id % 4 WHEN 0 THEN concat('{"entities": [{"name": "', event_type, '", "type": "event", "mentions": []}]}')
 WHEN 1 THEN props WHEN 2 THEN concat('Here it is: ', props, ' done') ELSE concat('no json for ', event_type) END"""


@query(
    "s13_entities_from_json",
    f"""SELECT event_id, event_type AS name, 'event' AS entity_type FROM events WHERE event_id % 4 = 0""",
)
def s13(spark, folder):
    rows = load(spark, folder, "events").select("event_id", F.expr(_ANSWER).alias("answer"))
    found = explode_once(rows, ["event_id"], entities_from_json(F.col("answer")), "e")
    return found.select("event_id", "e.name", F.col("e.type").alias("entity_type"))


@query(
    "s14_salvage_json",
    f"""SELECT event_id, CASE WHEN json_valid(answer) THEN answer
        WHEN regexp_extract(answer, '\\{{.*\\}}', 0) <> '' AND json_valid(regexp_extract(answer, '\\{{.*\\}}', 0)) THEN regexp_extract(answer, '\\{{.*\\}}', 0)
        ELSE '{{"error":"Failed to get valid JSON response","raw_response":"' || answer || '"}}' END AS answer
       FROM (SELECT event_id, {_ANSWER} AS answer FROM events)""",
)
def s14(spark, folder):
    rows = load(spark, folder, "events").select("event_id", F.expr(_ANSWER).alias("answer"))
    return rows.select("event_id", salvage_json(F.col("answer")).alias("answer"))


# ------------------------------------------------------------------------------- hooks
@query(
    "g01_g02_registry",
    f"""SELECT id, mime, CASE WHEN mime = 'text/html' THEN 'page' WHEN starts_with(mime, 'text/') THEN 'text' ELSE 'data' END AS hook,
        length(text) AS size FROM (SELECT id, text, {sniff_sql('text')} AS mime FROM ({_TEXTS}))
       WHERE starts_with(mime, 'text/') OR starts_with(mime, 'application/')""",
)
def g01(spark, folder):
    def hook(name):
        return lambda: F.array(F.struct("id", "mime", F.lit(name).alias("hook"), F.length("text").cast("long").alias("size")))

    registry = Registry().register_rows("text/html", hook("page")).register_rows("text/*", hook("text"))
    registry.register_rows("application/*", hook("data"))
    rows = all_texts(spark, folder).withColumn("mime", mime_by_text(F.col("text")))
    return registry.apply(rows, "mime")


def _tagged(texts):
    """Stand-in analyser: answers for some texts, with prose around the JSON."""
    return texts.map(
        lambda t: 'found {"entities":[{"name":"Long Text","type":"other","mentions":[{"context":"x","position":1,"relevance":0.9}]}]}'
        if len(t) > 3000 else "nothing here"
    )


@query(
    "g04_external_analyser",
    f"""WITH rest AS ({oracle.prose_sql(f"SELECT * FROM ({NOTES_SQL}) WHERE length(text) <= 3000", PROSE_RULES)}) SELECT doc_id, 'Long Text' AS name, 'other' AS entity_type, 'x' AS context,
        CAST(1 AS INTEGER) AS position, CAST(0.9 AS DOUBLE) AS relevance FROM ({NOTES_SQL}) WHERE length(text) > 3000
       UNION ALL SELECT doc_id, name, entity_type, context, position, relevance FROM rest""",
)
def g04(spark, folder):
    return extract_with_analyser(notes(spark, folder), ["doc_id"], _tagged).drop("ordinal", "description")


@query(
    "g05_content_filters",
    """SELECT doc_id, replace(regexp_replace(text, '[0-9]+', '#', 'g'), 'License', 'Permit') AS text FROM documents""",
)
def g05(spark, folder):
    docs = spread(load(spark, folder, "documents").select("doc_id", "text"))
    return apply_filters(docs, [lambda c: F.regexp_replace(c, "[0-9]+", "#"),
                                lambda c: F.replace(c, F.lit("License"), F.lit("Permit"))])


@query(
    "sf_merge_json",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"k":"new","z":"1"}' ELSE '{"k":"' || (props ->> '$.k') || '","z":"1"}' END AS merged FROM events""",
)
def sf_merge_json(spark, folder):
    patch = F.when(F.col("event_id") % 2 == 0, '{"z": "1", "k": "new"}').otherwise('{"z": "1"}')
    return load(spark, folder, "events").select("event_id", merge_json(F.col("props"), patch).alias("merged"))


_TURNS = (
    "SELECT conv_id * 100 + turn AS id, CASE WHEN role = 'system' THEN '  ' ELSE text END AS text FROM conversations"
)


@query(
    "m09_extract_results",
    f"""WITH texts AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '  ' ELSE text END AS text FROM conversations),
 keyed AS (SELECT conv_id * 100 + turn AS id, text FROM texts), found AS ({oracle.prose_sql(_TURNS, DOCUMENT_RULES, "id")}),
 counts AS (SELECT id, least(count(*), 5) AS n FROM (SELECT DISTINCT id, entity_type, name FROM found WHERE relevance >= 0.6) GROUP BY id)
SELECT keyed.id, trim(text) <> '' AS success, CASE WHEN trim(text) = '' THEN 'Empty text content' END AS error,
       CAST(CASE WHEN trim(text) = '' THEN 0 ELSE coalesce(n, 0) END AS INTEGER) AS entity_count FROM keyed LEFT JOIN counts USING (id)""",
)
def m09(spark, folder):
    rows = load(spark, folder, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.when(F.col("role") == "system", "  ").otherwise(F.col("text")).alias("text"),
    )
    options = ExtractOptions(confidence_threshold=0.6, max_entities=5)
    return extract_result(rows, ["id"], "text", DOCUMENT_RULES, None, options)


@query(
    "c40_outline_language",
    f"SELECT p_partkey, 'language' AS rule_id, CASE WHEN language = 'bash' THEN 'shell' ELSE language END AS name, 'technology' AS entity_type, "
    f"'Programming language' AS context, CAST(0 AS INTEGER) AS position, CAST(0.95 AS DOUBLE) AS relevance FROM ({SOURCE})",
)
def c40(spark, folder):
    rows = code_files(spark, folder).withColumn("language", outline_language(F.col("path")))
    return extract_outline(rows, ["p_partkey"]).filter(F.col("rule_id") == "language").drop("ordinal")


@query("c40_outline_language_by_text", f"""SELECT id, CASE
 WHEN {_any('import ', 'def ', 'class ')} OR regexp_matches(text, 'if __name__ == .__main__.:') THEN 'python'
 WHEN {_any('function ', 'const ', 'let ', 'var ', '=> ', 'import from')} THEN 'javascript'
 WHEN {_any('#include ', 'int main(', 'void main(')} THEN 'c' WHEN {_any('$', '@', '<?php')} THEN 'php'
 WHEN {_any('package ', 'public class ', 'import java')} THEN 'java' WHEN {_any('#!/bin/', 'function () {', 'echo "')} THEN 'shell'
 ELSE 'unknown' END AS language FROM ({_TEXTS})""")
def c40_text(spark, folder):
    return all_texts(spark, folder).select("id", outline_language_by_text(F.col("text")).alias("language"))
