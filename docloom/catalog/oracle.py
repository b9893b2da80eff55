"""SQL texts that restate the extraction rules on the other engine."""

from __future__ import annotations

import re

from docloom.operators.rules import Rule

# The other engine knows only ASCII word edges.  Other letters become "_" and other signs "~", one for
# one, so that word edges fall where the Unicode ones do; no pattern matches either sign.
_SIGNS = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x00-\x7F™®©]"
_LETTERS = r"[^\x00-\x7F™®©]"
SAFE_TEXT = f"regexp_replace(regexp_replace(text, '{_SIGNS}', '~', 'g'), '{_LETTERS}', '_', 'g')"
BLANKS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(expression: str) -> str:
    return f"regexp_replace({expression}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def title_case(expression: str) -> str:
    words = f"string_split(lower({expression}), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || w[2:]), ' ')"


def normalized(name: str, kind: str) -> str:
    clean = trimmed(f"regexp_replace(replace({name}, chr(34), ''), '{BLANKS}+', ' ', 'g')")
    swapped = rf"regexp_replace({clean}, '^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{2,4}})$', '\3-\1-\2')"
    return (
        f"CASE WHEN {kind} IN ('person', 'location') THEN {title_case(clean)} "
        f"WHEN {kind} = 'date' THEN {swapped} ELSE {clean} END"
    )


def place_ctes(keys: str) -> str:
    """First line that holds each match, and the context around it."""
    return f"""
lines AS (
  SELECT {keys}, unnest(string_split(text, chr(10))) AS line,
         unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n
  FROM src),
strings AS (SELECT DISTINCT {keys}, m, width FROM found),
firsts AS (
  SELECT {keys}, m, width, min(n) AS n, arg_min(line, n) AS line
  FROM strings JOIN lines USING ({keys}) WHERE contains(line, m) GROUP BY {keys}, m, width),
placed AS (
  SELECT {keys}, m, width, CAST(n AS INTEGER) AS position,
         {trimmed("regexp_extract(line, '.{0,' || width || '}' || regexp_escape(m) || '.{0,' || width || '}', 0)")} AS ctx
  FROM firsts)"""


def prose_sql(source: str, rules: tuple[Rule, ...], keys: str = "doc_id") -> str:
    """Mentions of prose rules over a source with the keys and a text."""
    parts = []
    for number, rule in enumerate(rules):
        for pattern in rule.patterns:
            m = f"unnest(regexp_extract_all(safe, {quoted(pattern)}, 0))"
            parts.append(
                f"SELECT {keys}, {number} AS rule, {quoted(rule.rule_id)} AS rule_id, "
                f"{quoted(rule.entity_type)} AS entity_type, CAST({rule.relevance} AS DOUBLE) AS relevance, "
                f"{rule.width} AS width, {rule.min_length} AS least, {rule.normalize} AS tidy, {m} AS m0 FROM safe"
            )
    strip = rules_strip(rules)
    return f"""
WITH src AS ({source}),
safe AS (SELECT {keys}, {SAFE_TEXT} AS safe FROM src),
hits AS ({" UNION ALL ".join(parts)}),
found AS (SELECT DISTINCT {keys}, rule_id, entity_type, relevance, width, tidy, {strip} AS m, least FROM hits),
{place_ctes(keys)}
SELECT {keys}, rule_id, f.m AS "match", CASE WHEN tidy THEN {normalized("f.m", "entity_type")} ELSE f.m END AS name,
       entity_type, position, CASE WHEN ctx = '' THEN f.m ELSE ctx END AS context, relevance
FROM found f JOIN placed p USING ({keys}, m, width) WHERE length(f.m) >= least"""


def rules_strip(rules: tuple[Rule, ...]) -> str:
    expression = "m0"
    for rule in rules:
        if rule.strip_prefix:
            expression = (
                f"CASE WHEN rule_id = {quoted(rule.rule_id)} "
                f"THEN regexp_replace(m0, {quoted(rule.strip_prefix)}, '') ELSE {expression} END"
            )
    return expression


def _filled(template: str, pattern: str) -> str:
    parts = []
    for piece in re.split(r"(\{\d\})", template):
        if re.fullmatch(r"\{\d\}", piece):
            parts.append(f"regexp_extract(m, {quoted(pattern)}, {piece[1]})")
        elif piece:
            parts.append(quoted(piece))
    return "concat(" + ", ".join(parts) + ")"


def code_sql(source: str, rules: tuple[Rule, ...], keys: str = "p_partkey") -> str:
    """Mentions of code rules over a source with the keys, a language and a text."""
    parts, names, descriptions = [], [], []
    for rule in rules:
        languages = ", ".join(quoted(x) for x in rule.languages)
        where = f"WHERE lower(language) IN ({languages})" if languages else ""
        for number, pattern in enumerate(rule.patterns):
            parts.append(
                f"SELECT {keys}, {quoted(rule.rule_id)} AS rule_id, {number} AS pattern, "
                f"CAST({rule.relevance} AS DOUBLE) AS relevance, {rule.width} AS width, "
                f"unnest(regexp_extract_all(line, {quoted(pattern)}, 0)) AS m FROM code_lines {where}"
            )
        options = []
        for pattern, template in rule.captures:
            skip = "".join(
                f" AND regexp_extract(m, {quoted(pattern)}, 1) <> {quoted(w)}" for w in rule.skip_captures
            )
            options.append(
                f"WHEN regexp_extract(m, {quoted(pattern)}, 1) <> ''{skip} THEN {_filled(template, pattern)}"
            )
        rest = "NULL" if rule.must_capture else "m"
        name = f"CASE {' '.join(options)} ELSE {rest} END" if options else "m"
        if rule.captures:
            name = trimmed(name)
        names.append(f"WHEN rule_id = {quoted(rule.rule_id)} THEN {name}")
        described = (
            _filled(rule.description, rule.captures[0][0]) if rule.description
            else f"{quoted((rule.label or '') + ': ')} || name"
        )
        descriptions.append(f"WHEN rule_id = {quoted(rule.rule_id)} THEN {described}")
    skipped = [w for rule in rules for w in rule.skip_names]
    drop = f"AND NOT (rule_id = 'functions' AND name IN ({', '.join(map(quoted, skipped))}))" if skipped else ""
    return f"""
WITH src AS ({source}),
code_lines AS (SELECT {keys}, language, unnest(string_split(text, chr(10))) AS line FROM src),
hits AS ({" UNION ALL ".join(parts)}),
found AS (SELECT DISTINCT {keys}, rule_id, pattern, relevance, width, m FROM hits WHERE {trimmed("m")} <> ''),
{place_ctes(keys)},
named AS (SELECT *, CASE {" ".join(names)} END AS name FROM found JOIN placed USING ({keys}, m, width))
SELECT {keys}, rule_id, m AS "match", name, 'technology' AS entity_type, CASE {" ".join(descriptions)} END AS description,
       position, CASE WHEN ctx = '' THEN m ELSE ctx END AS context, relevance
FROM named WHERE name IS NOT NULL {drop}"""


def outline_sql(source: str, rules, named_languages: tuple[str, ...], keys: str = "p_partkey") -> str:
    """Declarations of source files, rule by rule, placed by line number."""
    parts = []
    for rule in rules:
        where = ["TRUE"]
        if rule.keep:
            where.append(f"regexp_matches(line, {quoted(rule.keep)})")
        if rule.drop:
            where.append(f"NOT regexp_matches(line, {quoted(rule.drop)})")
        languages = ", ".join(map(quoted, rule.languages or named_languages))
        where.append(f"language {'IN' if rule.languages else 'NOT IN'} ({languages})")
        name = f"unnest(regexp_extract_all(line, {quoted(rule.words)}, 0))" if rule.words else "line"
        edited = "raw"
        for pattern, replacement in rule.edits:
            edited = f"regexp_replace({edited}, {quoted(pattern)}, {quoted(replacement.replace('$', chr(92)))})"
        only = "DISTINCT " if rule.distinct else ""
        anchor = "NULL"
        if rule.anchor:
            ahead, behind = rule.anchor.split("{}")
            lead = "chr(10) || " if ahead.startswith(chr(10)) else ""
            anchor = f"{lead}{quoted(ahead.lstrip(chr(10)))} || name || {quoted(behind)}"
            if rule.rule_id == "c_types":
                anchor = f"CASE WHEN contains(text, 'class ' || name) THEN 'class ' || name ELSE {anchor} END"
        fixed = "NULL" if rule.context is None else quoted(rule.context)
        if rule.context and "{}" in rule.context:
            ahead, behind = rule.context.split("{}")
            fixed = f"{quoted(ahead)} || language || {quoted(behind)}"
        parts.append(
            f"SELECT {keys}, text, {quoted(rule.rule_id)} AS rule_id, name, CAST({anchor} AS VARCHAR) AS anchor, {rule.context_lines} AS n, "
            f"CAST({fixed} AS VARCHAR) AS fixed, CAST({rule.relevance} AS DOUBLE) AS relevance FROM "
            f"(SELECT {only}{keys}, text, language, {edited} AS name FROM "
            f"(SELECT {keys}, text, language, {name} AS raw FROM code_lines WHERE {' AND '.join(where)})) WHERE name <> ''"
        )
    return f"""
WITH src AS ({source}),
code_lines AS (SELECT {keys}, text, language, unnest(string_split(text, chr(10))) AS line FROM src),
named AS ({" UNION ALL ".join(parts)}),
bodies AS (SELECT *, regexp_replace(text, '\n$', '') AS body FROM named),
spots AS (SELECT *, strpos(chr(10) || body, anchor) AS spot, string_split(body, chr(10)) AS ls FROM bodies),
placed AS (SELECT *, CASE WHEN spot > 0 THEN len(string_split(left(chr(10) || body, spot - 1 + CASE WHEN starts_with(anchor, chr(10)) THEN 1 ELSE 0 END), chr(10))) - 1 END AS ln FROM spots)
SELECT {keys}, rule_id, name, 'technology' AS entity_type,
  CASE WHEN anchor IS NULL THEN fixed WHEN ln IS NULL THEN '' WHEN n = 1 THEN ls[ln]
       ELSE ls[ln] || ' ' || CASE WHEN ln < len(ls) THEN ls[ln + 1] || ' ' ELSE '' END END AS context,
  CAST(coalesce(ln, 0) AS INTEGER) AS position, relevance
FROM placed"""
