"""Outline of source files: line-based declarations with the two lines that show them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import find_all, lines_of
from docloom.operators.extraction import explode_once


@dataclass(frozen=True)
class OutlineRule:
    """Lines to take, edits that leave the name, and where its context comes from.

    ``anchor`` is the text, with ``{}`` for the name, whose first line gives context and position; a
    leading line break ties it to a line start.  Without it the context is fixed and the position 0.
    """

    rule_id: str
    languages: tuple[str, ...]
    relevance: float
    keep: str
    edits: tuple[tuple[str, str], ...]
    drop: str | None = None
    anchor: str | None = None
    context_lines: int = 2
    context: str | None = None
    words: str | None = None
    distinct: bool = False


# --------------------------------------------------------------------------------------------
# Outline patterns, contexts and relevances.
# --------------------------------------------------------------------------------------------
OUTLINE_RULES = (
    OutlineRule("python_classes", ("python",), 0.9, r"^class [A-Za-z0-9_]+(\(.*\))?:",
                ((r"class ([A-Za-z0-9_]+).*", "$1"),), anchor="class {}"),
    OutlineRule("python_functions", ("python",), 0.85, r"^def [A-Za-z0-9_]+\(",
                ((r"def ([A-Za-z0-9_]+).*", "$1"),), anchor="def {}"),
    OutlineRule("python_imports", ("python",), 0.7, r"^(import |from )",
                ((r"import ([A-Za-z0-9_.]+).*", "$1"), (r"from ([A-Za-z0-9_.]+).*", "$1")),
                context="Python import"),
    OutlineRule("script_classes", ("javascript", "typescript"), 0.9,
                r"class [A-Za-z0-9_]+ (extends|implements|\{)",
                ((r"class ([A-Za-z0-9_]+).*", "$1"),), anchor="class {}"),
    OutlineRule("script_functions", ("javascript", "typescript"), 0.85,
                r"(function [A-Za-z0-9_]+\(|[A-Za-z0-9_]+ = function\(|const [A-Za-z0-9_]+ = \([^)]*\) =>)",
                ((r"function ([A-Za-z0-9_]+).*", "$1"), (r"([A-Za-z0-9_]+) = function.*", "$1"),
                 (r"const ([A-Za-z0-9_]+) =.*", "$1")),
                context="JavaScript function"),
    OutlineRule("script_imports", ("javascript", "typescript"), 0.7, r"(import |require\()",
                ((r""".*from .([^"']+).*""", "$1"), (r""".*require\(.([^"']+).*""", "$1")),
                context="JavaScript import"),
    OutlineRule("c_functions", ("c", "cpp"), 0.85, r"^[a-zA-Z0-9_]+ [a-zA-Z0-9_]+\(",
                ((r"[a-zA-Z0-9_]+ ([a-zA-Z0-9_]+).*", "$1"),), drop=r"^(if|for|while|switch)",
                anchor="{}(", context_lines=1),
    OutlineRule("c_types", ("c", "cpp"), 0.9, r"^(struct|class) [a-zA-Z0-9_]+",
                ((r"(struct|class) ([a-zA-Z0-9_]+).*", "$2"),), anchor="struct {}"),
    OutlineRule("c_includes", ("c", "cpp"), 0.7, r"^#include",
                ((r"""#include [<"]([^>"]*)[>"].*""", "$1"),), context="C/C++ include"),
    OutlineRule("shell_functions", ("shell",), 0.85, r"^[a-zA-Z0-9_]+\(\)",
                ((r"([a-zA-Z0-9_]+)\(\).*", "$1"),), anchor="\n{}()"),
    OutlineRule("shell_variables", ("shell",), 0.75, r"^[A-Z_]+=.*$",
                ((r"([A-Z_]+)=.*", "$1"),), anchor="\n{}=", context_lines=1),
    OutlineRule("shell_commands", ("shell",), 0.6, r"", (), distinct=True,
                words=r"\b(grep|sed|awk|find|cat|echo|mv|cp|rm|mkdir|touch|chmod|chown|curl|wget|tar"
                      r"|zip|unzip|ssh|rsync)\b",
                context="Shell command"),
    OutlineRule("other_functions", (), 0.7,
                r"(function |def |void |int |char |double |float |class |struct |interface |impl )",
                ((r"(.*)\(", "$1"),), words=r"[a-zA-Z0-9_]+\(", context="Function in {} code"),
)
NAMED_LANGUAGES = ("python", "javascript", "typescript", "c", "cpp", "shell")
LANGUAGE_CONTEXT, LANGUAGE_RELEVANCE = "Programming language", 0.95

_EMPTY = "array<struct<rule_id:string,name:string,anchor:string,n:int,context:string,relevance:double>>"


def _declared(rule: OutlineRule, text: Column, lines: Column, language: Column) -> Column:
    taken = lines
    if rule.keep:
        taken = F.filter(taken, lambda line: line.rlike(rule.keep))
    if rule.drop:
        taken = F.filter(taken, lambda line: ~line.rlike(rule.drop))
    if rule.words:
        taken = F.flatten(F.transform(taken, lambda line: find_all(line, "(?U)" + rule.words)))
    for pattern, replacement in rule.edits:
        taken = _edited(taken, pattern, replacement)
    if rule.distinct:
        taken = F.array_sort(F.array_distinct(taken))
    fixed = rule.context
    context = F.lit(None).cast("string") if fixed is None else (
        F.concat(F.lit(fixed.split("{}")[0]), language, F.lit(fixed.split("{}")[1]))
        if "{}" in fixed else F.lit(fixed)
    )

    def anchor(name: Column) -> Column:
        if rule.anchor is None:
            return F.lit(None).cast("string")
        ahead, behind = rule.anchor.split("{}")
        if rule.rule_id == "c_types":
            as_class = F.concat(F.lit("class "), name)
            return F.when(F.contains(text, as_class), as_class).otherwise(F.concat(F.lit(ahead), name))
        return F.concat(F.lit(ahead), name, F.lit(behind))

    rows = F.transform(
        F.filter(taken, lambda name: name != ""),
        lambda name: F.struct(
            F.lit(rule.rule_id).alias("rule_id"), name.alias("name"), anchor(name).alias("anchor"),
            F.lit(rule.context_lines).alias("n"), context.alias("context"),
            F.lit(rule.relevance).alias("relevance"),
        ),
    )
    applies = language.isin(*rule.languages) if rule.languages else ~language.isin(*NAMED_LANGUAGES)
    return F.coalesce(F.when(applies, rows), F.array().cast(_EMPTY))


def _edited(names: Column, pattern: str, replacement: str) -> Column:
    return F.transform(names, lambda name: F.regexp_replace(name, pattern, replacement))


def extract_outline(df: DataFrame, keys: list[str], text: str = "text", language: str = "language") -> DataFrame:
    """Declarations of source files and, where it is known, the language itself."""
    lang = F.col(language)
    df = df.select(*dict.fromkeys([*keys, text, language])).withColumn("_lines", lines_of(F.col(text)))
    arrays = [_declared(rule, F.col(text), F.col("_lines"), lang) for rule in OUTLINE_RULES]
    itself = F.array(
        F.struct(
            F.lit("language").alias("rule_id"), lang.alias("name"),
            F.lit(None).cast("string").alias("anchor"), F.lit(1).alias("n"),
            F.lit(LANGUAGE_CONTEXT).alias("context"), F.lit(LANGUAGE_RELEVANCE).alias("relevance"),
        )
    )
    arrays.append(F.coalesce(F.when(lang != "unknown", itself), F.array().cast(_EMPTY)))
    rows = explode_once(df, dict.fromkeys([*keys, text]), F.concat(*arrays), "_d")
    rows = rows.select(*keys, F.col(text).alias("_text"), "ordinal", "_d.*")
    # A leading line break makes "at a line start" a plain substring test.
    body = F.concat(F.lit("\n"), F.regexp_replace("_text", r"\n\z", ""))
    before = F.call_function("substring_index", body, F.col("anchor"), F.lit(1))
    found = F.length(before) < F.length(body)
    tied = F.when(F.col("anchor").startswith("\n"), F.lit("\n")).otherwise(F.lit(""))
    from_line = F.concat(
        F.substring_index(F.concat(before, tied), "\n", -1),
        F.substring(body, F.length(before) + F.length(tied) + 1, F.length(body)),
    )
    breaks = F.length(F.concat(before, tied)) - F.length(
        F.replace(F.concat(before, tied), F.lit("\n"), F.lit(""))
    )
    one = F.substring_index(from_line, "\n", 1)
    two = F.concat(F.replace(F.substring_index(from_line, "\n", 2), F.lit("\n"), F.lit(" ")), F.lit(" "))
    anchored = F.col("anchor").isNotNull()
    return rows.select(
        *keys, "rule_id", "ordinal", "name", F.lit("technology").alias("entity_type"),
        F.when(anchored & found, F.when(F.col("n") == 1, one).otherwise(two))
        .when(anchored, F.lit(""))
        .otherwise(F.col("context")).alias("context"),
        F.when(anchored & found, breaks).otherwise(F.lit(0)).alias("position"),
        "relevance",
    )
