"""Metadata of content by type: each function turns a text column into a struct column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.json_columns import top_level_keys
from docloom.functions.language import metadata_language
from docloom.functions.mime import is_text_type, is_valid_json
from docloom.functions.text import basename, find_all, first_line, last_suffix, lines_of


def _line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _matching(text: Column, pattern: str) -> Column:
    return F.filter(lines_of(text), lambda line: line.rlike(pattern))


def _edited(lines: Column, pattern: str, replacement: str) -> Column:
    return F.transform(lines, lambda line: F.regexp_replace(line, pattern, replacement))


def _piped(lines: Column) -> Column:
    return F.array_join(lines, "|")


def text_metadata(text: Column) -> Column:
    return F.struct(
        _line_breaks(text).alias("lines"),
        F.regexp_count(text, F.lit(r"\S+")).alias("words"),
        F.octet_length(text).alias("size"),
        F.lit("UTF-8").alias("encoding"),
    )


def markdown_metadata(text: Column) -> Column:
    return F.struct(
        F.regexp_replace(first_line(text), r"^#* ", "").alias("title"),
        _piped(_edited(_matching(text, r"^#{1,6} "), r"^#* ", "")).alias("headings"),
        F.size(F.filter(lines_of(text), lambda line: line.contains("```"))).alias("codeblocks"),
    )


def html_text(html: Column) -> Column:
    """Text without tags, line by line, empty lines dropped."""
    bare = _edited(lines_of(html), r"<[^>]*>", "")
    return F.array_join(F.filter(bare, lambda line: line != ""), "\n")


def html_metadata(html: Column) -> Column:
    return F.struct(
        F.array_join(find_all(html, r"<title>([^<\n]*)</title>", 1), "\n").alias("title"),
        _piped(find_all(html, r'href="([^"\n]*)"', 1)).alias("links"),
        _piped(find_all(html, r'src="([^"\n]*)"', 1)).alias("images"),
    )


def csv_metadata(text: Column) -> Column:
    header = first_line(text)
    return F.struct(
        header.alias("headers"),
        _line_breaks(text).alias("rows"),
        F.when(header == "", 0).otherwise(F.size(F.split(header, ","))).alias("columns"),
    )


def json_metadata(text: Column) -> Column:
    return F.struct(
        is_valid_json(text).alias("valid"),
        F.octet_length(text).alias("size"),
        F.coalesce(F.array_join(top_level_keys(text), "|"), F.lit("")).alias("keys"),
    )


def xml_metadata(text: Column) -> Column:
    root = F.replace(F.regexp_extract(text, r"<[^? \n][^ >\n]*", 0), F.lit("<"), F.lit(""))
    return F.struct(root.alias("root_element"), F.octet_length(text).alias("size"))


def python_metadata(text: Column) -> Column:
    opening = F.get(F.filter(lines_of(text), lambda line: line.startswith('"""')), F.lit(0))
    return F.struct(
        _piped(_matching(text, r"^import|^from .* import")).alias("imports"),
        _piped(_edited(_matching(text, r"^class "), r"class ([^(:]*).*", "$1")).alias("classes"),
        _piped(_edited(_matching(text, r"^def "), r"def ([^(]*).*", "$1")).alias("functions"),
        F.coalesce(F.regexp_replace(opening, r'^"""(.*)"""', "$1"), F.lit("")).alias("docstring"),
        F.lit("python").alias("language"),
    )


def javascript_metadata(text: Column) -> Column:
    return F.struct(
        _piped(_matching(text, r"import |require\(")).alias("imports"),
        _piped(_edited(_matching(text, r"function [a-zA-Z0-9_]+\("), r"function ([^(]*).*", "$1"))
        .alias("functions"),
        _piped(_edited(_matching(text, r"class [a-zA-Z0-9_]+ "), r"class ([^ {]*).*", "$1"))
        .alias("classes"),
        F.lit("javascript").alias("language"),
    )


def c_metadata(text: Column, path: Column) -> Column:
    plus = text.contains("class") | text.contains("namespace") | path.rlike(r"\.(cpp|cxx|cc|hpp)$")
    return F.struct(
        _piped(_matching(text, r"^#include")).alias("includes"),
        _piped(_edited(_matching(text, r"^[a-zA-Z0-9_]+ [a-zA-Z0-9_]+\("), r"[a-zA-Z0-9_]* ([^(]*).*", "$1"))
        .alias("functions"),
        _piped(_edited(_matching(text, r"^struct [a-zA-Z0-9_]+ "), r"struct ([^ {]*).*", "$1"))
        .alias("structs"),
        F.when(plus, "c++").otherwise("c").alias("language"),
    )


def shell_metadata(text: Column) -> Column:
    head = first_line(text)
    shebang = F.when(head.startswith("#!"), head).otherwise(F.lit(""))
    kind = (
        F.when(shebang.contains("bash"), "bash").when(shebang.contains("zsh"), "zsh")
        .when(shebang.contains("ksh"), "ksh").otherwise("sh")
    )
    return F.struct(
        shebang.alias("shebang"),
        _piped(_edited(_matching(text, r"^[a-zA-Z0-9_]+\(\)"), r"([^(]*).*", "$1")).alias("functions"),
        kind.alias("shell_type"),
        F.lit("shell").alias("language"),
    )


def code_metadata(text: Column, path: Column) -> Column:
    return F.struct(
        metadata_language(path).alias("language"),
        last_suffix(path).alias("extension"),
        _line_breaks(text).alias("lines"),
        F.octet_length(text).alias("size"),
    )


def fallback_metadata(text: Column, mime: Column) -> Column:
    return F.struct(F.octet_length(text).alias("size"), mime.alias("mimetype"))


def fallback_text(text: Column, mime: Column) -> Column:
    """The text itself where the type is textual, nothing otherwise."""
    return F.when(is_text_type(mime), text)


def result_metadata(text: Column, path: Column, now: Column) -> Column:
    return F.struct(
        F.length(text).alias("size"), basename(path).alias("file_name"), now.alias("processed_at")
    )


def extract_metadata(df: DataFrame, text: str = "text", content_type: str = "content_type",
                     path: str = "file_path", output: str = "metadata") -> DataFrame:
    """Add the metadata of each row's content type as JSON text."""
    body, mime, where = F.col(text), F.col(content_type), F.col(path)
    js = F.to_json
    return df.withColumn(
        output,
        F.when(mime == "text/plain", js(text_metadata(body)))
        .when(mime == "text/markdown", js(markdown_metadata(body)))
        .when(mime == "text/html", js(html_metadata(body)))
        .when(mime == "text/csv", js(csv_metadata(body)))
        .when(mime == "application/json", js(json_metadata(body)))
        .when(mime == "application/xml", js(xml_metadata(body)))
        .when(mime == "text/x-python", js(python_metadata(body)))
        .when(mime == "text/javascript", js(javascript_metadata(body)))
        .when(mime == "text/x-c", js(c_metadata(body, where)))
        .when(mime == "application/x-sh", js(shell_metadata(body)))
        .when(mime.startswith("text/x-"), js(code_metadata(body, where)))
        .otherwise(js(fallback_metadata(body, mime))),
    )


def merge_extracted(own: DataFrame, extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Entity rows of processed records; extracted ones only for records that have none of their own."""
    missing = extracted.join(own.select(*keys).distinct(), keys, "left_anti")
    return own.unionByName(missing)


def exact_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """Content hashes that occur more than once, with their number of items."""
    return (
        df.groupBy(F.md5(F.col(text).cast("binary")).alias("hash"))
        .agg(F.count(F.lit(1)).alias("items"))
        .filter(F.col("items") > 1)
    )
