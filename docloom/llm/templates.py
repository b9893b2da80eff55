"""Line dedup by a log-template tree, with DataFrame functions only.

A line's path in the tree has a fixed depth: its number of tokens, then its first ``DEPTH`` tokens; tokens with a digit
are variable fields.  Within a leaf a token stays part of the template where at least ``MIN_TEXTS`` texts have it at its
place, else the place is a variable field too.  A template recurs if it stands in at least ``MIN_TEXTS`` different
texts, and counts only if ``MIN_CONSTANT`` of its places are constant.  Lines of recurring templates are dropped.

Exact copies of a text count once, and a text that would lose all its lines stays as it is: copies are for the near
duplicate operators to judge.  Blank lines have no template and stay.  Null and empty texts stay; repeated rows change
alike; other columns pass through, ``n_chars`` is set anew for texts that change if the table has it.

Leaves, forms and tokens are counted with partial aggregation ahead of each shuffle; only lines of leaves that recur
are looked at again, and a leaf of any size is only joined and counted, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import bound, free_name, shared_table

DEPTH, MIN_TEXTS, MIN_CONSTANT = 3, 10, 0.6
FIELD = "<*>"


def tokens(line: Column) -> Column:
    """Tokens of a line, with a field in place of every token that has a digit."""
    plain = F.translate(line, "\t\r\v\f", "    ")
    masked = F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(plain)
    return F.array_remove(F.split(masked, " "), "")


def _has_token(line: Column) -> Column:
    """Whether a line has a token; tested without making tokens."""
    return F.length(F.btrim(line, F.lit(" \t\r\v\f"))) > 0


def _lines(docs: DataFrame, text_column: str, depth: int) -> DataFrame:
    """Lines with a token: (mark, line, tokens, leaf); a mark stands for all rows of one text."""
    return (
        docs.select(F.xxhash64(text_column).alias("mark"), F.col(text_column).alias("text"))  # a hash once a text, not once a line
        .select("mark", F.posexplode(F.split("text", "\n")).alias("line", "content"))
        .where(_has_token(F.col("content"))).select("mark", "line", tokens(F.col("content")).alias("tokens"))
        .withColumn("leaf", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth)))
    )


def recurring_lines(docs: DataFrame, text_column: str = "text", depth: int = DEPTH, min_texts: int = MIN_TEXTS,
                    min_constant: float = MIN_CONSTANT) -> DataFrame:
    """(mark, gone): the numbers of the lines to drop for each text (by the 64-bit hash of it) that has any."""
    lines = _lines(docs, text_column, depth)
    leaves = shared_table(
        lines.select("leaf", "mark").distinct().groupBy("leaf").count().where(F.col("count") >= min_texts).select("leaf"), "leaves"
    )
    held = shared_table(
        lines.join(leaves, "leaf").withColumn("form", F.xxhash64("leaf", "tokens")), "lines"
    )
    forms = shared_table(
        held.select("leaf", "form", "mark", "tokens").groupBy("leaf", "form", "mark").agg(F.first("tokens").alias("tokens"))
        .groupBy("leaf", "form").agg(F.count("*").alias("texts"), F.first("tokens").alias("tokens")), "forms"
    )
    placed = forms.select("leaf", "form", "texts", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token")).where(F.col("token") != FIELD)
    constant = placed.groupBy("leaf", "place", "token").agg(F.sum("texts").alias("all")).where(F.col("all") >= min_texts).drop("all")
    templates = (
        placed.join(constant, ["leaf", "place", "token"]).groupBy("leaf", "form", "n", "texts")
        .agg(F.count("*").alias("constants"), F.xxhash64(F.array_sort(F.collect_list(F.struct("place", "token")))).alias("template"))
        .where(F.col("constants") >= F.col("n") * min_constant)
    )
    common = templates.groupBy("leaf", "template").agg(F.sum("texts").alias("all")).where(F.col("all") >= min_texts).select("leaf", "template")
    gone = templates.join(common, ["leaf", "template"]).select("form")
    return held.select("mark", "line", "form").join(gone, "form").groupBy("mark").agg(F.collect_set("line").alias("gone"))


def drop_recurring(docs: DataFrame, text_column: str = "text", counts: bool = False, **limits) -> DataFrame:
    """``docs`` without lines of recurring templates; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    mark, lost, edited, new = (free_name(docs, n) for n in ("_mark", "_gone", "_changed", "_text"))
    gone = recurring_lines(docs, text_column, **limits).withColumnRenamed("mark", mark).withColumnRenamed("gone", lost)
    parts = F.split(text_column, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
    lines = bound(parts, lambda p: F.transform(left, lambda i: F.get(p, i)))  # the text is split once, not once a line
    kept = bound(lines, lambda k: F.when(F.exists(k, _has_token), F.array_join(k, "\n")))
    joined = docs.withColumn(mark, F.xxhash64(text_column)).join(gone, mark, "left")
    out = joined.withColumn(new, F.when(F.col(lost).isNotNull(), kept)).withColumn(edited, F.col(new).isNotNull())
    out = out.withColumn(new, F.coalesce(new, text_column))
    columns = [F.col(new).alias(c) if c == text_column else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = F.when(F.col(edited), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    if counts:
        columns.append(F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"))
        columns.append(F.when(F.col(edited), F.size(lost)).otherwise(0).cast("long").alias("n_dropped"))
    return out.select(*columns)
