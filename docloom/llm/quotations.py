"""Quotation linking: nested quotes are parsed, joined to the messages they come from, and taken out.

A line's quote level is its number of leading ``>`` marks; lines of one level in a row are a passage.  Passages and
lines are normalised (lower case, runs of white space and punctuation as one space) and hashed.  A quoted passage
belongs to the earliest message of its thread with an own passage of that hash, else to the one that has most of its
lines (ties: the earliest), else, over all threads, to the only message that has it.  A message quotes only messages with a
smaller id.  It replies to the one it quotes most at its lowest quoted level (ties: the latest), and conversations are
the trees of replies, ordered by depth and then by id.

Each hash is reduced to one original ahead of the joins, so a line that a third of all messages share costs one row.
Null and empty texts have no passage; messages with a null id are roots by themselves; of repeated rows (same id and
text) each comes back; rows of one id with different texts are one message for links.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.shared import bound, shared_table

# Possessive, as a group that may give back what it took recurses once a mark.
_MARKS = "^ {0,3}((?:>[ \t]?)++)"
#: A message id is its conversation times this plus its turn, so conversations of up to so many turns never share ids.
MOST_TURNS = 1 << 24


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def _normal(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(line, _MARKS, ""), r"[\s\p{Punct}]+", " ")))


def passages(messages: DataFrame) -> DataFrame:
    """(id, thread, level, run, mark, lines) of each passage of ``messages`` (id, thread, text)."""
    lines = (
        messages.select("id", "thread", F.xxhash64("text").alias("row"), "text").dropDuplicates(["id", "thread", "row"])
        .select("id", "thread", "row", F.posexplode(F.split("text", "\n")).alias("line", "content"))
        .select("id", "thread", "row", "line", _level(F.col("content")).alias("level"), _normal(F.col("content")).alias("normal"))
        .where("normal != ''")
    )
    order = Window.partitionBy("id", "thread", "row").orderBy("line")  # one message's lines
    runs = lines.withColumn("new", F.coalesce(F.col("level") != F.lag("level").over(order), F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = runs.groupBy("id", "thread", "row", "level", "run").agg(F.array_sort(F.collect_list(F.struct("line", "normal"))).alias("parts"))
    return found.select(
        "id", "thread", "level", F.xxhash64("row", "run").alias("run"), F.xxhash64(F.array_join("parts.normal", "\n")).alias("mark"),
        F.transform("parts.normal", lambda x: F.xxhash64(x)).alias("lines"),
    )


def links(messages: DataFrame) -> DataFrame:
    """(id, run, level, original, hits): the message that each quoted passage comes from."""
    found = shared_table(passages(messages.where("id IS NOT NULL")), "passages")
    own, quoted = found.where("level = 0"), found.where("level > 0").withColumn("size", F.size("lines"))
    by_passage = own.groupBy("thread", "mark").agg(F.min("id").alias("original"))
    by_line = own.select("id", "thread", F.explode("lines").alias("mark")).groupBy("thread", "mark").agg(F.min("id").alias("original"))
    out = ["id", "thread", "run", "level", "original", "hits"]
    whole = quoted.join(by_passage, ["thread", "mark"]).where("original < id").select(*out[:-1], F.col("size").cast("long").alias("hits"))
    rest = quoted.join(whole.select("id", "thread", "run"), ["id", "thread", "run"], "left_anti")
    asked = rest.select("id", "thread", "run", "level", F.explode("lines").alias("mark"))

    def most(hits: DataFrame) -> DataFrame:
        counts = hits.where("original < id").groupBy("id", "thread", "run", "level", "original").agg(F.count("*").alias("hits"))
        best = F.max_by("original", F.struct("hits", -F.col("original"))).alias("original")
        return counts.groupBy("id", "thread", "run", "level").agg(best, F.max("hits").alias("hits")).select(*out)

    near = most(asked.join(by_line, ["thread", "mark"]))
    only = (
        own.select("id", F.explode("lines").alias("mark")).groupBy("mark").agg(F.min("id").alias("original"), F.max("id").alias("last"))
        .where("original = last").drop("last")
    )
    far = most(asked.join(near.select("id", "thread", "run"), ["id", "thread", "run"], "left_anti").join(only, "mark"))
    return whole.unionByName(near).unionByName(far)


def roots(parents: DataFrame) -> DataFrame:
    """(id, root, depth) of every id of ``parents`` (id, parent), by doubling the step to an ancestor.

    Ids that have come to their root are set aside, so later rounds hold only those of longer chains.
    """
    first = parents.select("id", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("done"))
    now = shared_table(first, "roots")
    placed = now.limit(0)
    while True:
        up = placed.unionByName(now).select(F.col("id").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"), F.col("done").alias("ended"))
        step = now.join(up, "root", "left").select(
            "id", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("ended", F.lit(True)).alias("done"),
        )
        step = shared_table(step, "roots")
        placed, now = placed.unionByName(step.where("done")), step.where("NOT done")
        if now.limit(1).count() == 0:
            return placed.drop("done")


def without_quotes(text: Column) -> Column:
    """A text's own lines, without blank lines at either end."""
    own = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(_MARKS))

    def inner(lines: Column) -> Column:
        full = F.transform(lines, lambda line: F.length(F.btrim(line, F.lit(" \t"))) > 0)
        first, behind = F.array_position(full, True), F.array_position(F.reverse(full), True)
        length = F.size(lines) - first - behind + 2
        return F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), length.cast("int")), "\n")).otherwise("")

    return F.when(text.isNotNull(), bound(own, inner))


def quoted_runs(text: Column) -> Column:
    """Number of quoted passages: changes to a level above zero from one full line to the next."""
    levels = F.transform(F.split(text, "\n"), lambda line: F.when(_normal(line) != "", _level(line)))
    ahead = lambda x: F.concat(F.array(F.lit(0)), x)
    starts = bound(F.filter(levels, lambda x: x.isNotNull()), lambda x: F.size(F.filter(F.zip_with(x, ahead(x), lambda a, b: (a > 0) & (a != b)), lambda s: s)))
    return F.when(text.isNotNull(), starts).otherwise(0).cast("long")


def link_conversations(messages: DataFrame, id_column: str = "msg_id", thread_column: str | None = None, text_column: str = "text") -> DataFrame:
    """(id, parent, root, depth, n_quotes, n_linked, text) of every row; reply order is root, depth, id."""
    thread = F.col(thread_column).cast("string") if thread_column else F.lit(None).cast("string")
    rows = messages.select(F.col(id_column).alias("id"), F.coalesce(thread, F.lit("")).alias("thread"), F.col(text_column).alias("text"))
    found = shared_table(links(rows), "links")
    lowest = found.groupBy("id", "level", "original").agg(F.sum("hits").alias("hits"))
    parent = F.max_by("original", F.struct(-F.col("level"), "hits", "original")).alias("parent")
    parents = shared_table(lowest.groupBy("id").agg(parent), "parents")
    placed = parents.join(roots(parents), "id").join(found.groupBy("id").agg(F.count("*").alias("n_linked")), "id")
    return rows.withColumn("n_quotes", quoted_runs(F.col("text"))).join(placed, "id", "left").select(
        "id", "parent", F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), without_quotes(F.col("text")).alias("text"),
    )


def as_mail(turns: DataFrame) -> DataFrame:
    """(msg_id, conv_id, text): turns as mail, each with the turn before quoted once and the one before that twice."""
    said = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def quoted(name: str, back: int) -> DataFrame:
        return said.select("conv_id", (F.col("turn") + back).alias("turn"), F.concat(F.lit(">" * back + " "), F.replace("said", F.lit("\n"), F.lit("\n" + ">" * back + " "))).alias(name))

    mail = turns.select("conv_id", "turn", "text").join(quoted("one", 1), ["conv_id", "turn"], "left").join(quoted("two", 2), ["conv_id", "turn"], "left")
    return mail.select((F.col("conv_id").cast("long") * MOST_TURNS + F.col("turn")).alias("msg_id"), "conv_id", F.concat_ws("\n", "two", "one", F.lit(""), "text").alias("text"))
