"""Mixing sources to target weights by hash-threshold histograms, without sorting any document.

A source's target is its share of ``share`` times all words by the weights of the sources, which repeat ``weights`` in
code-point order of the names (null last).  A target stops at ``most`` times the words of its source; what is above is
shared again by weight until no target is above.

A document is taken whole once for each full pass of its source's target; what then remains is a budget of the next
pass.  Budgets are nested: each document has one hash, and each pass takes the documents below a threshold of it, so a
smaller target takes a part of what a larger one takes.  The threshold of a source is found by histograms: words are summed by
source and the first ``BITS`` bits of the hash, the running sum over those buckets (``2 ** BITS`` at most a source)
names the one in which the budget ends, and only the documents of that bucket are summed again by the next bits, until
each source's boundary is one hash.  The documents of that hash (one, but for rows equal in id and text) share what is
left in proportion to their words, rounded down: their first words are taken.  So a source misses its target by less
than one word for each of these rows, and by half a word for a target that isn't a whole number.

Null and empty texts have size 0 and nothing of them is taken.  Rows with a null id are told apart by their texts; equal
rows get equal parts.  A null source is a source of its own.  In an empty table there is nothing to mix.  Other columns
are ignored by ``mixture`` and come back from ``mixed_texts``, whose own columns take free names.

One key only meets in sums with partial aggregation: a source that holds a third of all rows is 4096 rows in the
windows.  The driver sees a handful of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.shared import free_name, shared_table

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of the hash, and of one histogram.
HASH, BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column, text: Column) -> Column:
    """A hash of 60 bits over id and text, as a long."""
    name = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, HASH // 4), 16, 10).cast("long")


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with ``weight``: the weights in turn, by code point of the source, null last.

    A name's rank is the number of names in ranges before its own plus its rank there, so no task ranks all names.
    """
    ranged = shared_table(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    before = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.pmod(F.col("before") + F.col("own"), F.lit(len(weights))).cast("int")
    ranks = ranged.withColumn("own", own).join(before, "part")
    return ranks.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), turn).alias("weight"))


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    Each turn takes the sources above their limit out and shares the rest by weight; the rate never falls, so turns end.
    """
    limit = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    words, rate, capped = share * total, 0.0, -1
    while True:
        over = limit < F.col("weight") * F.lit(rate) if capped >= 0 else F.lit(False)
        held, free, count = sources.agg(
            F.sum(F.when(over, limit).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count_if(over)
        ).first()
        if count == capped or not free:
            break
        rate, capped = (words - held) / free, count
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(rate)))


def thresholds(sizes: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target, passes, edge, rest, edge_size) of each source of ``goals``.

    Documents below the hash ``edge`` are taken once more than ``passes`` times; those at it share ``rest`` words.
    """
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.floor(F.col("target") + 0.5) / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("passes") * F.col("source_size")
    budgets = goals.withColumn("passes", whole).withColumn("rest", F.greatest(rest, F.lit(0)))
    budgets = shared_table(budgets.select("source", "source_size", "target", "passes", "rest"), "budgets")
    open_ones, found, shift = budgets.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("bucket")), None, HASH
    while True:
        above, shift = shift, shift - BITS
        asked = open_ones.withColumnsRenamed({"source": "name", "bucket": "within"})
        inside = sizes.where("size > 0").join(asked, F.col("source").eqNullSafe(F.col("name")) & (F.shiftright("place", above) == F.col("within")))
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("place").alias("low"), F.max("place").alias("high"), F.first("rest").alias("rest")
        )
        order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = (
            sums.withColumn("upto", F.sum("words").over(order)).where("upto > rest AND upto - words <= rest")
            .select("source", "bucket", "low", "high", "words", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))
        )
        edge = shared_table(edge, "edges")
        done = edge.where("low = high") if shift else edge
        done = done.selectExpr("source AS name", "low AS edge", "rest AS edge_rest", "words AS edge_size")
        found = done if found is None else found.unionByName(done)
        open_ones = edge.where("low < high").select("source", "rest", "bucket")
        if not shift or open_ones.isEmpty():
            return budgets.join(found, F.col("source").eqNullSafe(F.col("name")), "left").select(
                "source", "source_size", "target", "passes", "edge", F.coalesce("edge_rest", F.lit(0)).alias("rest"), "edge_size")


def _plan(docs: DataFrame, id_column: str, text_column: str, source_column: str, weights, share, most) -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows, written, and for each source (name, source_size, target, cut), where ``cut`` has what decides its rows."""
    sizes = shared_table(docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), words_in(F.col(text_column)).alias("size"),
        place(F.col(id_column), F.col(text_column)).alias("place")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = thresholds(sizes, targets(weighted(sources, weights), share, most), most)
    return sizes, cuts.select(F.col("source").alias("name"), "source_size", "target", F.struct("passes", "edge", "rest", "edge_size").alias("cut"))


def _copies(size: Column, at: Column, cut: Column) -> Column:
    return cut["passes"] + F.when((size > 0) & (at < cut["edge"]), 1).otherwise(0)


def _part(size: Column, at: Column, cut: Column) -> Column:
    share = F.call_function("div", cut["rest"].cast("decimal(38,0)") * size, cut["edge_size"].cast("decimal(38,0)"))
    return F.when((size > 0) & (at == cut["edge"]), share).otherwise(F.lit(0)).cast("long")


def mixture(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
            weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(id, size, source_size, target, copies, part) of every row: whole copies, and words of one more that isn't whole."""
    sizes, cuts = _plan(docs, id_column, text_column, source_column, weights, share, most)
    row = F.col("size"), F.col("place"), F.col("cut")
    return sizes.join(cuts, F.col("source").eqNullSafe(F.col("name"))).select(
        "id", "size", "source_size", "target", _copies(*row).alias("copies"), _part(*row).alias("part"))


def mixed_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, and one with its first words, joined by spaces, for a part."""
    cuts = _plan(docs, id_column, text_column, source_column, weights, share, most)[1]
    taken, source, cut = (free_name(docs, n) for n in ("_taken", "_source", "_cut"))
    joined = docs.join(cuts.select(F.col("name").alias(source), F.col("cut").alias(cut)), F.col(source_column).eqNullSafe(F.col(source)))
    row = words_in(F.col(text_column)), place(F.col(id_column), F.col(text_column)), F.col(cut)
    whole, part = F.array_repeat(F.lit(-1).cast("long"), _copies(*row).cast("int")), _part(*row)
    rows = joined.withColumn(taken, F.explode(F.concat(whole, F.array_remove(F.array(part), 0))))
    first = F.slice(F.array_remove(F.split(text_column, r"[\x20\x09-\x0D]+"), ""), F.lit(1), F.greatest(F.col(taken), F.lit(0)).cast("int"))
    text = F.when(F.col(taken) < 0, F.col(text_column)).otherwise(F.array_join(first, " "))
    return rows.select(*[text.alias(c) if c == text_column else F.col(c) for c in docs.columns])
