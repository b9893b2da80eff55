"""Programming language of a file, by suffix or by text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.mime import lookup
from docloom.functions.text import contains_any, extension, last_suffix

# Language per suffix.
LANGUAGE_BY_EXTENSION = {
    "js": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java",
    "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp", "hpp": "cpp", "go": "go",
    "rb": "ruby", "php": "php", "rs": "rust", "swift": "swift", "cs": "csharp", "kt": "kotlin",
    "kts": "kotlin", "scala": "scala", "r": "r", "sh": "bash", "bash": "bash", "pl": "perl",
    "lua": "lua", "html": "html", "css": "css", "sql": "sql",
}

# Language per suffix as the metadata of generic code files names it.
METADATA_LANGUAGE_BY_SUFFIX = {
    "py": "python", "js": "javascript", "ts": "typescript", "c": "c", "h": "c", "cpp": "c++",
    "cxx": "c++", "cc": "c++", "hpp": "c++", "java": "java", "rb": "ruby", "php": "php",
    "go": "go", "rs": "rust", "swift": "swift", "sh": "shell", "bash": "shell", "pl": "perl",
    "cs": "csharp", "r": "r",
}

# Language per suffix as the outline extractor names it.
OUTLINE_LANGUAGE_BY_SUFFIX = {
    "py": "python", "js": "javascript", "ts": "typescript", "c": "c", "h": "c", "cpp": "cpp",
    "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "java": "java", "rb": "ruby", "php": "php",
    "go": "go", "rs": "rust", "swift": "swift", "sh": "shell", "bash": "shell", "pl": "perl",
}


def language_by_path(path: Column) -> Column:
    return lookup(LANGUAGE_BY_EXTENSION, extension(path))


def metadata_language(path: Column) -> Column:
    return F.coalesce(lookup(METADATA_LANGUAGE_BY_SUFFIX, last_suffix(path)), F.lit("unknown"))


def outline_language(path: Column) -> Column:
    return F.coalesce(lookup(OUTLINE_LANGUAGE_BY_SUFFIX, last_suffix(path)), F.lit("unknown"))


def language_by_text(text: Column) -> Column:
    """Marker words, tested in a fixed order; ``unknown`` if none applies."""
    has = text.contains
    scripted = contains_any(text, ("function ", "=>")) & contains_any(text, ("const ", "let ", "var "))
    typed = contains_any(text, ("interface ", ": string", ": number", ": boolean", "<T>"))
    c_like = has("#include <") | (has("int main(") & has("}"))
    cpp = contains_any(text, ("std::", "namespace ", "class ", "template<"))
    return (
        F.when(has("def ") & has(":") & contains_any(text, ("import ", "from ")), "python")
        .when(scripted & typed, "typescript")
        .when(scripted, "javascript")
        .when(contains_any(text, ("public class ", "private class ")) | (has("import java.") & has("}")),
              "java")
        .when(c_like & cpp, "cpp")
        .when(c_like, "c")
        .when(has("package ") & has("func ") & has("import ("), "go")
        .when(has("def ") & has("end") & contains_any(text, ("require ", "class ")), "ruby")
        .when(has("<?php") | (has("function ") & has("$")), "php")
        .when(has("fn ") & has("-> ") & has("let mut "), "rust")
        .otherwise("unknown")
    )


def language_of(path: Column, text: Column) -> Column:
    return F.coalesce(language_by_path(path), language_by_text(text))


def outline_language_by_text(text: Column) -> Column:
    """Marker words of the outline extractor, tested in a fixed order."""
    return (
        F.when(text.rlike(r"import |def |class |if __name__ == .__main__.:"), "python")
        .when(text.rlike(r"function |const |let |var |=> |import from"), "javascript")
        .when(contains_any(text, ("#include ", "int main(", "void main(")), "c")
        .when(contains_any(text, ("$", "@", "<?php")), "php")
        .when(contains_any(text, ("package ", "public class ", "import java")), "java")
        .when(contains_any(text, ("#!/bin/", "function () {", 'echo "')), "shell")
        .otherwise("unknown")
    )
