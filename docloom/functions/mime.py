"""MIME detection by suffix, by text and by first line."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import contains_any, extension, first_line, strip

# MIME type per file suffix.
MIME_BY_EXTENSION = {
    "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown",
    "html": "text/html", "htm": "text/html", "css": "text/css", "csv": "text/csv",
    "js": "text/javascript", "ts": "text/typescript", "tsx": "text/typescript",
    "jsx": "text/javascript", "py": "text/x-python", "java": "text/x-java", "c": "text/x-c",
    "cpp": "text/x-c++", "h": "text/x-c", "hpp": "text/x-c++", "sh": "application/x-sh",
    "rb": "text/x-ruby", "go": "text/x-go", "php": "text/x-php", "rs": "text/x-rust",
    "swift": "text/x-swift",
    "pdf": "application/pdf", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "json": "application/json", "xml": "application/xml", "yaml": "application/yaml",
    "yml": "application/yaml", "toml": "application/toml",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff",
    "tif": "image/tiff",
    "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "flac": "audio/flac",
    "aac": "audio/aac",
    "mp4": "video/mp4", "webm": "video/webm", "avi": "video/x-msvideo", "mov": "video/quicktime",
    "wmv": "video/x-ms-wmv", "mkv": "video/x-matroska",
    "zip": "application/zip", "tar": "application/x-tar", "gz": "application/gzip",
    "rar": "application/vnd.rar", "7z": "application/x-7z-compressed",
    "exe": "application/x-msdownload", "dll": "application/x-msdownload",
    "bin": "application/octet-stream", "iso": "application/x-iso9660-image",
}

# Fixed value: how many opening characters are looked at unless a caller says otherwise.
SNIFF_LENGTH = 4096


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small constant table, null if absent."""
    literals = [F.lit(x) for x in chain.from_iterable(table.items())]
    return F.try_element_at(F.create_map(*literals), key)


def mime_by_extension(path: Column) -> Column:
    return lookup(MIME_BY_EXTENSION, extension(path))


def is_valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def mime_by_text(text: Column) -> Column:
    """First matching content test wins; plain text is what remains."""
    head = strip(text)
    looks_json = head.startswith("{") | head.startswith("[")
    line_without_comma = text.rlike(r"(?:\A|\n)[^,\n]*(?:\n|\z)")
    return (
        F.when(head.startswith("<!DOCTYPE html>") | head.startswith("<html"), "text/html")
        .when(head.startswith("<?xml"), "application/xml")
        .when(looks_json & is_valid_json(F.when(looks_json, text)), "application/json")
        .when(contains_any(text, ("# ", "## ", "```", "**")), "text/markdown")
        .when(contains_any(text, ("def ", "import ", "class ")), "text/x-python")
        .when(contains_any(text, ("function ", "const ", "let ", "var ")), "text/javascript")
        .when(contains_any(text, ("#!/bin/", "export ")) | text.startswith("#!"), "application/x-sh")
        .when(text.contains(",") & ~line_without_comma, "text/csv")
        .otherwise("text/plain")
    )


def detect_content_type(path: Column, text: Column, sniff: int | None = SNIFF_LENGTH) -> Column:
    """By suffix, else by the opening characters of the text; ``None`` looks at all of it."""
    head = text if sniff is None else F.substring(text, 1, sniff)
    return F.coalesce(mime_by_extension(path), mime_by_text(head))


def mime_by_first_line(text: Column) -> Column:
    line = first_line(text)
    return (
        F.when(line.rlike(r"^\s*\{.*\}\s*\z"), "application/json")
        .when(line.startswith("<?xml") | line.startswith("<html") | line.startswith("<!DOCTYPE"),
              "application/xml")
        .when(line.rlike(r"^(?:import|from|def|class)"), "text/x-python")
        .otherwise("text/plain")
    )


def is_text_type(mime: Column) -> Column:
    return mime.startswith("text/") | mime.isin(
        "application/json", "application/xml", "application/javascript"
    )
