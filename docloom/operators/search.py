"""Full-text search: a postings table, prefix and substring search, snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.json_columns import parse_or_text
from docloom.functions.text import bound, contains_folded, quoted_regex
from docloom.options import SEARCH_LIMIT
from docloom.session import cut_lineage

# What separates tokens, and the reach of a snippet.
TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"
SNIPPET_BEFORE, SNIPPET_AFTER = 30, 60


def build_index(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Postings (token, key, tf) over text columns.

    Equal tokens of a document are counted ahead of the shuffle, which is by (token, key): a token of
    every document does not gather in one task.  Empty pieces are dropped as rows, which costs less than within the array.
    """
    text = F.concat_ws(" ", *columns)
    rows = df.select(key, F.explode(F.split(F.lower(text), TOKEN_SEPARATOR)).alias("token")).filter("token <> ''")
    return rows.groupBy("token", key).agg(F.count(F.lit(1)).alias("tf"))


def counted_tokens(tokens: Column) -> Column:
    """Distinct tokens, sorted and joined by spaces, which no token has, and how often each occurs: (tokens, tf array<int>)."""
    def count(sorted_tokens: Column) -> Column:
        at = F.transform(sorted_tokens, lambda _, i: i)
        first = F.filter(at, lambda i: (i == 0) | (F.get(sorted_tokens, i) != F.get(sorted_tokens, i - 1)))
        return bound(first, lambda cuts: F.struct(
            F.array_join(F.transform(cuts, lambda i: F.get(sorted_tokens, i)), " ").alias("tokens"),
            F.transform(cuts, lambda i, k: F.coalesce(F.get(cuts, k + 1), F.size(sorted_tokens)) - i).alias("tf")))

    return bound(F.sort_array(tokens), count)


def row_postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The postings of each row of ``df``, counted within the row: (key, tokens, tf)."""
    pieces = F.split(F.lower(F.concat_ws(" ", *columns)), TOKEN_SEPARATOR)
    return df.select(key, counted_tokens(F.filter(pieces, lambda t: t != "")).alias("_p")).select(key, "_p.*")


def joined_postings(rows: DataFrame, by: list[str]) -> DataFrame:
    """Row postings summed within ``by``: (…, tokens, tf).  A group of one row stays as it is."""
    split = F.transform("_all", lambda p: F.flatten(F.transform(
        F.arrays_zip(F.split(p["tokens"], " ").alias("t"), p["tf"].alias("n")), lambda z: F.array_repeat(z["t"], F.coalesce(z["n"], F.lit(0))))))
    every = F.when(F.size("_all") == 1, F.get("_all", F.lit(0))).otherwise(counted_tokens(F.flatten(split)))
    return rows.groupBy(*by).agg(F.collect_list(F.struct("tokens", "tf")).alias("_all")).select(*by, every.alias("_p")).select(*by, "_p.*")


def exploded_postings(rows: DataFrame, key: str) -> DataFrame:
    """Row postings as postings (key, token, tf)."""
    each = F.arrays_zip(F.split("tokens", " ").alias("token"), F.col("tf").alias("tf"))
    found = rows.filter("tokens <> ''").select(key, F.explode(each).alias("_p"))
    return found.select(key, "_p.token", F.col("_p.tf").cast("long").alias("tf"))


def build_entity_index(entities: DataFrame, key: str = "entity_id") -> DataFrame:
    return build_index(entities, key, ["name", "entity_type", "description"])


def write_index(index: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """Postings sorted by token and key, so that a search reads only the files of its tokens.

    Ranges are cut by both columns; a frequent token spans several files.
    """
    parts = (partitions,) if partitions else ()
    ordered = index.repartitionByRange(*parts, "token", key).sortWithinPartitions("token", key)
    ordered.write.mode("overwrite").parquet(path)


def refresh_index(index: DataFrame, changed: DataFrame, key: str, columns: list[str],
                  deleted: DataFrame | None = None) -> DataFrame:
    """Postings after inserts, updates and deletes of documents."""
    stale = changed.select(key)
    if deleted is not None:
        stale = stale.unionByName(deleted.select(key))
    kept = index.join(stale.distinct(), key, "left_anti")
    return kept.unionByName(build_index(changed, key, columns).select(*kept.columns))


def query_terms(query: str) -> list[str]:
    """Distinct lower-case terms in order; the last one is a prefix."""
    return [t for t in re.split(r"[^\w]+|_+", query.lower()) if t]


def search_index(index: DataFrame, query: str, key: str) -> DataFrame:
    """Keys of documents that have every term, the last one as a prefix, with the hits summed."""
    terms = query_terms(query)
    if not terms:
        return index.select(key, F.col("tf").alias("hits")).limit(0)
    *whole, last = terms
    token = F.col("token")
    wanted = [*dict.fromkeys(whole)]
    condition = token.startswith(last)
    for term in wanted:
        condition = condition | (token == term)
    found = index.filter(condition)
    checks = [F.bool_or(token == t) for t in wanted] + [F.bool_or(token.startswith(last))]
    every = checks[0]
    for check in checks[1:]:
        every = every & check
    return (
        found.groupBy(key).agg(F.sum("tf").alias("hits"), every.alias("_all"))
        .filter("_all").drop("_all")
    )


def search_like(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query as a substring of any of the columns, case ignored."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(contains_folded(F.col(name), query), F.lit(False))
    return df.filter(hit)


def snippet(columns: list[str], query: str, table: str) -> Column:
    """The surroundings of the first hit in the first matching column, every hit marked."""
    literal = quoted_regex(query)
    options = []
    for name in columns:
        value = F.col(name)
        at = F.locate(query.lower(), F.lower(value)) - 1
        start = F.greatest(at - SNIPPET_BEFORE, F.lit(0))
        end = F.least(F.length(value), start + len(query) + SNIPPET_AFTER)
        cut = F.concat(
            F.when(start > 0, "...").otherwise(""),
            F.substring(value, start + 1, end - start),
            F.when(end < F.length(value), "...").otherwise(""),
        )
        marked = F.regexp_replace(cut, f"(?iu){literal}", "<mark>$0</mark>")
        options.append(F.when(at >= 0, marked))
    return F.coalesce(*options, F.lit(f"Match found in {table}"))


def search_content(tables: dict[str, tuple[DataFrame, str, list[str]]], query: str,
                   types: list[str] | None = None) -> DataFrame:
    """Hits over several tables, given as (table, key column, text columns) per content type.

    One scan per table; the rows carry their content type, key and snippet.
    """
    chosen = {n: t for n, t in tables.items() if not types or n in types}
    parts = [
        search_like(df, query, columns).select(
            F.lit(name).alias("content_type"),
            F.col(key).cast("string").alias("id"),
            snippet(columns, query, name).alias("snippet"),
        )
        for name, (df, key, columns) in chosen.items()
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def limited(hits: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first results in a fixed order, with the total before the limit.

    Hits are written once, so the search runs once for the rows and for their number.
    """
    hits = cut_lineage(hits)
    total = hits.agg(F.count(F.lit(1)).alias("n")).scalar()
    return hits.orderBy("content_type", "id").limit(limit).withColumn("total_results", total)


def content_details(df: DataFrame, key: str, value: object, json_columns: tuple[str, ...] = ("analysis", "metadata")) -> DataFrame:
    """One row by key, JSON columns normalised where they parse."""
    row = df.filter(F.col(key) == F.lit(value))
    for name in json_columns:
        if name in row.columns:
            row = row.withColumn(name, parse_or_text(F.col(name)))
    return row
