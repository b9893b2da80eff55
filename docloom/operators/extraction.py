"""Rule-based entity extraction, one row of text at a time and without a shuffle.

Every rule is a constant regular expression evaluated inside the row, so a document never leaves its
partition: all rules share one scan, and only the small match rows go on to later operators.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.names import normalize_name
from docloom.functions.json_columns import top_level_keys
from docloom.functions.text import SPACE_CHARS, bound, contains_any, find_all, is_blank, lines_of, strip
from docloom.operators.rules import (
    CODE_RULES, DOCUMENT_RULES, OFFSET_RULES, OFFSET_WIDTH, PROSE_RULES, Rule,
)
from docloom.options import ExtractOptions

# Word classes and word edges of the prose and code patterns are the Unicode ones.
UNICODE = "(?U)"

MENTION_COLUMNS = (
    "rule_id", "ordinal", "name", "entity_type", "description", "context", "position", "relevance",
)
CANDIDATES = (
    "array<struct<rule_id:string,match:string,name:string,entity_type:string,description:string,"
    "label:string,width:int,relevance:double>>"
)


def explode_once(df: DataFrame, keep, array: Column, name: str) -> DataFrame:
    """Rows of an array with their index.

    The outer form keeps the optimizer from adding a size test of the array, which would evaluate a
    costly array expression a second time; rows of empty arrays are dropped afterwards.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("ordinal", name))
    return rows.filter(F.col("ordinal").isNotNull())


def _stays_in_line(pattern: str) -> bool:
    """Whether a pattern cannot match across a line break, so that the whole text can be scanned."""
    return not re.search(r"\\s|\[\^|\(\?s\)", pattern)


def _opening_literal(pattern: str) -> tuple[str, ...]:
    """The plain characters every match of a pattern begins with, if it has any."""
    if re.search(r"\|(?![^(\[]*[)\]])", pattern):
        return ()
    word = re.match(r"[A-Za-z#@:_]+", pattern)
    if not word:
        return ()
    optional = pattern[word.end():word.end() + 1] in ("?", "*", "{")
    literal = word.group(0)[:-1] if optional else word.group(0)
    return (literal,) if literal else ()


def _matches(text: Column, lines: Column, pattern: str, start: str, needs: tuple[str, ...]) -> Column:
    """Distinct matches of a pattern, line by line, in binary order.

    Two cheap tests spare most of the work and change no match: a text without any of the literals in
    ``needs`` is not searched, and ``start``, what a match can begin with, is tested ahead of the
    costlier word edge.
    """
    guard = f"(?={start})(?:{pattern})" if start else pattern
    if _stays_in_line(pattern):
        found = find_all(text, UNICODE + guard)
    else:
        found = F.flatten(F.transform(lines, lambda line: find_all(line, UNICODE + guard)))
    needs = needs or _opening_literal(pattern)
    if needs:
        found = F.coalesce(F.when(contains_any(text, needs), found), F.array().cast("array<string>"))
    return F.sort_array(F.array_distinct(found))


def _fill(template: str, match: Column, pattern: str) -> Column:
    """A format such as ``{1}.{2}`` filled with the groups of ``pattern`` on ``match``."""
    parts = []
    for piece in re.split(r"(\{\d\})", template):
        if re.fullmatch(r"\{\d\}", piece):
            parts.append(F.regexp_extract(match, pattern, int(piece[1])))
        elif piece:
            parts.append(F.lit(piece))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _entity_name(rule: Rule, match: Column) -> Column:
    options = []
    for pattern, template in rule.captures:
        if template == "{1}" and not rule.skip_captures:
            options.append(F.nullif(F.regexp_extract(match, pattern, 1), F.lit("")))
            continue
        hit = ~F.regexp_extract(match, pattern, 1).isin("", *rule.skip_captures)
        options.append(F.when(hit, _fill(template, match, pattern)))
    if not rule.must_capture:
        options.append(match)
    name = F.coalesce(*options) if len(options) > 1 else options[0]
    if rule.trim:
        name = strip(name)
    if rule.normalize:
        name = normalize_name(name, F.lit(rule.entity_type))
    return name


def _description(rule: Rule, match: Column) -> Column:
    """A description made of the match; null where it is made of the label and the name."""
    if rule.description:
        return _fill(rule.description, match, rule.captures[0][0])
    return F.lit(None).cast("string")


def _candidates(rule: Rule, text: Column, lines: Column, language: Column | None) -> Column:
    """Array of candidate structs of one rule, pattern by pattern."""
    starts = rule.starts or ("",) * len(rule.patterns)
    needs = rule.needs or ((),) * len(rule.patterns)
    found = [
        _matches(text, lines, p, s, n) for p, s, n in zip(rule.patterns, starts, needs, strict=True)
    ]
    if rule.strip_prefix:
        found = [F.transform(a, lambda m: F.regexp_replace(m, rule.strip_prefix, "")) for a in found]
    if rule.union:
        found = [F.array_distinct(F.concat(*found) if len(found) > 1 else found[0])]
    matches = F.concat(*found) if len(found) > 1 else found[0]
    if rule.min_length > 1:
        matches = F.filter(matches, lambda m: F.length(m) >= rule.min_length)

    def candidate(match: Column) -> Column:
        return F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            match.alias("match"),
            _entity_name(rule, match).alias("name"),
            F.lit(rule.entity_type).alias("entity_type"),
            _description(rule, match).alias("description"),
            F.lit(rule.label).cast("string").alias("label"),
            F.lit(rule.width).alias("width"),
            F.lit(rule.relevance).alias("relevance"),
        )

    structs = F.transform(matches, candidate)
    if rule.must_capture:
        structs = F.filter(structs, lambda c: c["name"].isNotNull())
    if rule.skip_names:
        structs = F.filter(structs, lambda c: ~c["name"].isin(*rule.skip_names))
    if rule.languages:
        if language is None:
            raise ValueError(f"rule {rule.rule_id} needs a language column")
        structs = F.coalesce(
            F.when(F.lower(language).isin(*rule.languages), structs), F.array().cast(CANDIDATES)
        )
    return structs


def _entity_id(candidate: Column) -> Column:
    return F.concat_ws(":", candidate["entity_type"], candidate["name"])


def _apply_options(candidates: Column, options: ExtractOptions) -> Column:
    """Confidence, then type, then the first N entities, inside the row."""
    passing = candidates
    if options.confidence_threshold is not None:
        passing = F.filter(passing, lambda c: c["relevance"] >= options.confidence_threshold)
    if options.entity_types:
        passing = F.filter(passing, lambda c: c["entity_type"].isin(*options.entity_types))
    every = F.array_distinct(F.transform(candidates, _entity_id))
    kept = F.array_intersect(every, F.array_distinct(F.transform(passing, _entity_id)))
    if options.max_entities is not None:
        kept = F.slice(kept, 1, options.max_entities)
    return kept


def _all_pass(rules: tuple[Rule, ...], options: ExtractOptions) -> bool:
    """Whether the options can't drop an entity of these rules."""
    least = options.confidence_threshold
    every = least is None or all(rule.relevance >= least for rule in rules)
    return every and not options.entity_types and options.max_entities is None


def with_candidates(df: DataFrame, keep: list[str], text: str, rules: tuple[Rule, ...],
                    language: str | None = None, options: ExtractOptions | None = None) -> DataFrame:
    """The kept columns with the ordered candidate array ``_candidates`` and, with options, the ids
    ``_kept`` of the entities that pass."""
    if options is not None and options.entity_types:
        # An entity of another type passes in no case, so its rules needn't run.
        rules = tuple(rule for rule in rules if rule.entity_type in options.entity_types) or rules
    lang = F.col(language) if language else None
    body, lines = F.col(text), F.col("_lines")
    arrays = [_candidates(rule, body, lines, lang) for rule in rules]
    every = (F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("_candidates")
    df = df.select(*dict.fromkeys([*keep, text, *([language] if language else [])]), lines_of(body).alias("_lines"))
    df = df.select(*keep, every)
    if options is None:
        return df
    candidates = F.col("_candidates")
    df = df.select("*", _apply_options(candidates, options).alias("_kept"))
    if _all_pass(rules, options):
        return df
    # Bound to a variable, the ids are made once; as a column they would move into the filter and be made for each candidate.
    chosen = bound(F.col("_kept"), lambda kept: F.filter(candidates, lambda c: F.array_contains(kept, _entity_id(c))))
    return df.select(*keep, chosen.alias("_candidates"), "_kept")


def place(text: str, names: list[str], widths: list[int]) -> list[dict]:
    """Line number and context of the first literal occurrence of each name, in one pass over the text.

    The context window reaches ``width`` characters to both sides within the line.  Near the line
    start the last occurrence that begins within ``width`` characters carries the right part.  A name
    that the text does not hold has line 0 and itself as context.
    """
    finder, wanted, first = ahocorasick.Automaton(), set(names) - {""}, {}
    for name in wanted:
        finder.add_word(name, name)
    if wanted:
        finder.make_automaton()
        for end, name in finder.iter(text):
            first.setdefault(name, end - len(name) + 1)
            if len(first) == len(wanted):
                break
    breaks = [m.start() for m in re.finditer("\n", text)]
    spots = []
    for name, width in zip(names, widths, strict=True):
        at = first.get(name)
        if at is None:
            spots.append({"context": name, "position": 0})
            continue
        line = bisect.bisect_left(breaks, at)
        start = breaks[line - 1] + 1 if line else 0
        right = text[at:at + len(name) + 2 * width].split("\n", 1)[0]
        if at - start < width:
            whole = text[start:at] + right
            last = whole[:width + len(name)].rfind(name)
            context = whole[:last + len(name) + width]
        else:
            context = text[at - width:at] + right[:len(name) + width]
        spots.append({"context": context.strip(SPACE_CHARS) or name, "position": line + 1})
    return spots


#: Names and characters of text whose places are held as Python objects at once.
PART_NAMES, PART_CHARS = 4096, 1 << 20


def _in_parts(rows: Iterator[tuple], work: Callable[..., list[dict]], kind: pa.DataType) -> pa.Array:
    """The results of ``work`` on rows of Arrow values (text, names, …), turned to Arrow a few at a time.

    Python objects take many times the room of their Arrow form, so those of a whole batch are never held together.
    """
    parts, held, names, chars = [], [], 0, 0
    for row in rows:
        text, found, *_ = values = [x.as_py() for x in row]
        held.append(work(*values) if text and found else [])
        names, chars = names + len(held[-1]), chars + len(text or "")
        if names >= PART_NAMES or chars >= PART_CHARS:
            parts.append(pa.array(held, kind))
            held, names, chars = [], 0, 0
    return pa.concat_arrays([*parts, pa.array(held, kind)])


@F.arrow_udf(T.ArrayType(T.StructType().add("context", "string").add("position", "integer")))
def _spots(text: pa.Array, names: pa.Array, widths: pa.Array) -> pa.Array:
    """``place`` for every row: built-in functions can only search for one name at a time, which costs
    text length times names."""
    kind = pa.list_(pa.struct([("context", pa.string()), ("position", pa.int32())]))
    return _in_parts(zip(text, names, widths, strict=True), place, kind)


def _place(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Mention rows with line number and context of the first occurrence of ``match`` in the text.

    The context window reaches ``width`` characters to both sides within the line.  Near the line
    start the last occurrence that begins within ``width`` characters carries the right part.
    """
    body, match, width, size = F.col(text), F.col("match"), F.col("width"), F.length("match")
    before = F.col("_before")
    given = [F.col(c) for c in dict.fromkeys([*keys, "match", "rule_id", "ordinal", "name", "entity_type",
                                              "description", "width", "relevance"])]
    df = df.select(*given, *(() if text in keys else (text,)),
                   F.call_function("substring_index", body, match, F.lit(1)).alias("_before"))
    df = df.select(
        *given,
        F.substring_index(before, "\n", -1).alias("_left"),
        F.substring_index(F.substring(body, F.length(before) + 1, size + width * 2), "\n", 1).alias("_right"),
        (F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit("")))).alias("_breaks"),
        (F.octet_length(before) < F.octet_length(body)).alias("_found"),
    )
    line = F.concat("_left", "_right")
    head = F.substring(line, F.lit(1), width + size)
    last = F.length(head) - F.length(F.call_function("substring_index", head, match, F.lit(-1))) - size
    near = F.substring(line, F.lit(1), last + size + width)
    far = F.concat(F.right("_left", width), F.substring("_right", F.lit(1), size + width))
    context = strip(F.when(F.length("_left") < width, near).otherwise(far))
    return df.select(
        *keys, "match", "rule_id", "ordinal", "name", "entity_type", "description",
        F.when(F.col("_found") & (context != ""), context).otherwise(match).alias("context"),
        F.when(F.col("_found"), F.col("_breaks") + 1).otherwise(F.lit(0)).alias("position"),
        "relevance",
    )


def extract(df: DataFrame, keys: list[str], text: str = "text", rules: tuple[Rule, ...] = PROSE_RULES,
            language: str | None = None, options: ExtractOptions | None = None, one_pass: bool = True) -> DataFrame:
    """Mention rows of every text: one row per rule, pattern and distinct match.

    ``ordinal`` is the order of the mention in its text (rule order, then binary order).  An Arrow function finds lines and
    contexts in one pass over each text.  Without ``one_pass`` built-in functions do, which cost text length times names: less for
    short texts with few names.  The rows are the same.
    """
    keep = list(dict.fromkeys([*keys, text]))
    rows = with_candidates(df, keep, text, rules, language, options)
    if one_pass:
        # Places are found ahead of the explode, so that no mention row carries the text.
        spots = _spots(F.col(text), F.col("_candidates.match"), F.col("_candidates.width"))
        rows = rows.select(*keys, F.col("_candidates").alias("c"), spots.alias("s"))
        keep = keys
    each = F.arrays_zip("c", "s") if one_pass else F.col("_candidates")
    rows = rows.select(*keep, F.posexplode_outer(each).alias("ordinal", "_c"))
    c, spot = (F.col("_c.c"), F.col("_c.s")) if one_pass else (F.col("_c"), None)
    rows = rows.filter(F.length(strip(c["match"])) > 0)
    described = F.coalesce(c["description"], F.concat(c["label"], F.lit(": "), c["name"]))
    placed = [spot["context"].alias("context"), spot["position"].alias("position")] if one_pass else []
    rows = rows.select(*keep, c["match"].alias("match"), c["rule_id"].alias("rule_id"), "ordinal",
                       c["name"].alias("name"), c["entity_type"].alias("entity_type"),
                       described.alias("description"), *placed, c["width"].alias("width"),
                       c["relevance"].alias("relevance"))
    if options is not None and not options.extract_mentions:
        nothing = {"context": "string", "position": "int", "relevance": "double"}
        rows = rows.withColumns({n: F.lit(None).cast(kind) for n, kind in nothing.items()})
        return rows.dropDuplicates([*keys, "entity_type", "name"]).select(*keys, "match", *MENTION_COLUMNS)
    return rows.drop("width") if one_pass else _place(rows, keys, text)


def extract_document_text(df: DataFrame, keys: list[str], text: str = "text",
                          options: ExtractOptions | None = None, one_pass: bool = True) -> DataFrame:
    """The rules for text taken from paged documents; names come out normalised."""
    return extract(df, keys, text, DOCUMENT_RULES, None, options, one_pass)


def extract_code(df: DataFrame, keys: list[str], text: str = "text", language: str = "language",
                 options: ExtractOptions | None = None, one_pass: bool = True) -> DataFrame:
    """Code rules: the common set first, then those of the row's language."""
    return extract(df, keys, text, CODE_RULES, language, options, one_pass)


def extract_result(df: DataFrame, keys: list[str], text: str = "text",
                   rules: tuple[Rule, ...] = PROSE_RULES, language: str | None = None,
                   options: ExtractOptions = ExtractOptions(), empty_error: str = "Empty text content",
                   ) -> DataFrame:
    """One outcome row per item: success, error text and entity count; blank input is a failure."""
    rows = with_candidates(df, list(dict.fromkeys([*keys, text])), text, rules, language, options)
    blank = is_blank(F.col(text))
    return rows.select(
        *keys,
        (~blank).alias("success"),
        F.when(blank, F.lit(empty_error)).alias("error"),
        F.when(blank, F.lit(0)).otherwise(F.size("_kept")).alias("entity_count"),
    )


def offsets_of(text: str, names: list[str], gaps: list[int], sizes: list[int]) -> list[dict]:
    """Offset and surroundings of each name, given the lengths of the gaps ahead of it; ``sizes`` names of a rule start over."""
    out, at = [], 0
    for size in sizes:
        here = 0
        for name, gap in zip(names[at:at + size], gaps[at:at + size], strict=True):
            here += gap
            out.append({"position": here, "context": text[max(0, here - OFFSET_WIDTH):here + len(name) + OFFSET_WIDTH]})
            here += len(name)
        at += size
    return out


@F.arrow_udf(T.ArrayType(T.StructType().add("position", "integer").add("context", "string")))
def _offsets(text: pa.Array, names: pa.Array, gaps: pa.Array, sizes: pa.Array) -> pa.Array:
    """``offsets_of`` for every row; running sums as array expressions would copy what is summed for each match."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("context", pa.string())]))
    return _in_parts(zip(text, names, gaps, sizes, strict=True), offsets_of, kind)


def _typed(entity_type: str, relevance: float):
    return lambda m: F.struct(m.alias("name"), F.lit(entity_type).alias("entity_type"), F.lit(relevance).alias("relevance"))


def extract_offsets(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every match of the offset rules with its 0-based character offset and its surroundings.

    Matches and what lies between them come from two linear scans per rule; offsets are the running sums of their lengths.
    """
    body, found = F.col(text), {}
    for at, (entity_type, relevance, pattern) in enumerate(OFFSET_RULES):
        found[f"_names{at}"] = find_all(body, pattern)
        found[f"_gaps{at}"] = F.transform(F.split(body, pattern, -1), F.length)
    rows = df.select(*dict.fromkeys([*keys, text]), *[c.alias(n) for n, c in found.items()])
    names = [F.col(f"_names{at}") for at in range(len(OFFSET_RULES))]
    gaps = [F.slice(f"_gaps{at}", F.lit(1), F.size(n)) for at, n in enumerate(names)]
    spots = _offsets(body, F.concat(*names), F.concat(*gaps), F.array(*map(F.size, names)))
    kinds = [F.transform(n, _typed(kind, relevance)) for n, (kind, relevance, _) in zip(names, OFFSET_RULES, strict=True)]
    rows = rows.select(*keys, F.concat(*kinds).alias("m"), spots.alias("s"))
    rows = explode_once(rows, keys, F.arrays_zip("m", "s"), "_z")
    return rows.select(*keys, "ordinal", "_z.m.name", "_z.m.entity_type", "_z.s.position", "_z.m.relevance", "_z.s.context")


def _plain(keys: list[str], df: DataFrame, names: Column) -> DataFrame:
    return explode_once(df, keys, names, "name").select(
        *keys, "ordinal", "name", F.lit("other").alias("entity_type"), F.lit("").alias("context"),
        F.lit(0).alias("position"), F.lit(0.5).alias("relevance"),
    )


def extract_json_keys(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Top-level keys of JSON objects as entities, sorted; invalid JSON yields none."""
    return _plain(keys, df, top_level_keys(F.col(text)))


# Fixed value: an opening tag within a line, its name in the group.
TAG_NAME = r"<([^/!>\n ][^ >\n]*)[^>\n]*>"


def extract_tag_names(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Distinct tag names of markup as entities, sorted."""
    return _plain(keys, df, F.array_sort(F.array_distinct(find_all(F.col(text), TAG_NAME, 1))))


# Document property, entity type, context and relevance.
PROPERTY_RULES = (
    ("title", "other", "PDF Title", 0.9),
    ("author", "person", "PDF Author", 0.9),
    ("creation_date", "date", "PDF Creation Date", 0.9),
    ("producer", "technology", "PDF Producer", 0.8),
)


def extract_properties(df: DataFrame, keys: list[str]) -> DataFrame:
    """Entities of the document properties title, author, creation_date and producer."""
    entries = F.array(
        *[
            F.struct(
                F.col(column).alias("name"), F.lit(kind).alias("entity_type"),
                F.lit(context).alias("context"), F.lit(0).alias("position"),
                F.lit(relevance).alias("relevance"),
            )
            for column, kind, context, relevance in PROPERTY_RULES
        ]
    )
    known = F.filter(entries, lambda e: F.coalesce(e["name"], F.lit("")) != "")
    return explode_once(df, keys, known, "_e").select(*keys, "ordinal", "_e.*")


def union_mentions(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Property mentions ahead of text mentions: the second list continues the ordinals of the first."""
    shared = [c for c in first.columns if c in second.columns]
    late = second.select(*shared).withColumn("part", F.lit(1))
    return first.select(*shared).withColumn("part", F.lit(0)).unionByName(late)
