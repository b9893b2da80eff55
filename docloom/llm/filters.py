"""How filters overlap: every document's failures, and what each filter removes in every order of filters.

Words decide two of the filters by a sparse document-term matrix.
  1. Each task cuts its texts into books of about ``BOOK_BYTES`` and these into shards of about ``SHARD_BYTES``, and counts words
     in rows of compressed sparse form, by numbers that hold within the book; a shard's new words go along.  Shards are written.
  2. All words together are dealt by a hash of the word and sorted; a word's rank in its bucket makes its term id, the same in
     every book.
  3. Each book gets the ids of its own words back and renumbers the columns of its shards: the matrix, whose row sums are the
     numbers of words and whose nonzero counts are the numbers of distinct words.

A book sends a word once, however often its documents have it, and the sort of a bucket spills, so no word is too
frequent.  A text is never cut: one that is larger than a shard is a shard of its own.

A shard is one row, and Parquet's writers and readers and Arrow's batches hold many rows at once: a writer looks at its size
every 100 rows at first, a reader takes up to 4096 rows of a row group.  So shards are small, and the row groups of the written
shards are bounded by ``GROUP_BYTES``: what a task holds follows these and not its share of the input.

Filters: A fewer than 100 words; B fewer than 80 distinct words in 100; C more than 10 of 100 code points in A to Z; D any
of the characters ``#$%&*|``; E equal to the text of a smaller id.  Copies of a text are counted by part and label before
they meet, so a group of copies of any size is a few rows.

A null text counts as an empty one, which fails A, and E too if a smaller id has an empty text.  A null id is smaller
than none and greater than none.  Rows of one id and text don't make each other fail E.  Labels of one id count once, each as 1
if any row of it is.  A null part is the empty string.  An empty table has no part and so gives no row.  Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import count, islice, permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.shared import shared_table
from docloom.llm.wordhash import text_bytes

BOOK_BYTES, SHARD_BYTES, BUCKET_WORDS = 16 << 20, 256 << 10, 1 << 20
#: Encoded bytes of a row group of written shards, and the rows after which its size is looked at.
GROUP_BYTES, GROUP_ROWS = 4 << 20, 8
FILTERS = "ABCDE"
#: At least so many words, so many distinct ones of 100, at most so many capitals of 100 code points.
WORDS, DISTINCT, CAPITALS = 100, 80, 10
SIGNS = "[#$%&*|]"


class Shard:
    """Texts of a shard as rows of counts, by the word numbers of its book."""

    def __init__(self, number: _Numbers):
        self.number, self.known = number, len(number)
        self.found: list[np.ndarray] = []
        self.kept: list[pa.RecordBatch] = []
        self.bytes = 0

    def add(self, text: bytes) -> None:
        words = text.split()
        self.found.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.bytes += len(text)

    def row(self, book: int, shard: int, names: list[str]) -> pa.RecordBatch:
        """The shard as one row: columns of its documents, the matrix and the words new to the book, each as a list."""
        sizes = np.array([len(x) for x in self.found], dtype=np.int64)
        cells, counts = np.unique((np.repeat(np.arange(len(sizes)), sizes) << 32) | np.concatenate(self.found), return_counts=True)
        starts = np.searchsorted(cells, np.arange(len(sizes) + 1) << 32)
        table = pa.Table.from_batches(self.kept)
        lists = [table.column(n).combine_chunks() for n in names] + [
            pa.array(starts.astype(np.int32)), pa.array(np.diff((cells & 0xFFFFFFFF).astype(np.int32), prepend=np.int32(0))), pa.array(counts.astype(np.int32)),
            pa.array(list(islice(self.number, self.known, None)), pa.binary()).cast(pa.string()),
        ]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        numbers = [pa.array([x], pa.int64()) for x in (book, shard)]
        first = pa.array([self.known], pa.int32())
        return pa.RecordBatch.from_arrays([*numbers, *columns, first], names=["book", "shard", *names, "starts", "steps", "counts", "words", "first"])


class _Numbers(dict):
    """Numbers of words, given at first sight."""

    def __init__(self, numbers: Iterator[int]):
        self.numbers = numbers

    def __missing__(self, word: bytes) -> int:
        self[word] = number = next(self.numbers)
        return number


def shards(docs: DataFrame, text_column: str, names: list[str], most: int = SHARD_BYTES) -> DataFrame:
    """Rows (book, shard, lists of ``names``, starts, steps, counts, words, first) that hold all rows of ``docs``.

    ``steps`` are the differences of the column numbers, which are small and take less room than the numbers.  ``words`` are those
    that no earlier shard of the book has, numbered from ``first``.
    """
    whole = max(most, BOOK_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = number = TaskContext.get().partitionId() << 32
        words, held = _Numbers(count()), 0
        shard = Shard(words)
        for batch in batches:
            data, bounds = text_bytes(batch.column(len(names)))
            first = 0
            for i in range(batch.num_rows):
                shard.add(data[bounds[i]:bounds[i + 1]].tobytes())
                if shard.bytes >= most or i + 1 == batch.num_rows:
                    # A copy, as a slice would keep its whole batch.
                    shard.kept.append(batch.select(names).take(pa.array(range(first, i + 1), pa.int32())))
                    first = i + 1
                if shard.bytes >= most:
                    yield shard.row(book, number, names)
                    held, number = held + shard.bytes, number + 1
                    if held >= whole:
                        book, words, held = number, _Numbers(count()), 0
                    shard = Shard(words)
        if shard.found:
            yield shard.row(book, number, names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    lists = "".join(f", `{n}` array<{kinds[n]}>" for n in names)
    return docs.select(*names, F.col(text_column)).mapInArrow(
        run, f"book long, shard long{lists}, starts array<int>, steps array<int>, counts array<int>, words array<string>, first int")


def terms(written: DataFrame) -> DataFrame:
    """(book, number, bucket, word, term): the term id of each word of each book, one id for one word."""
    total = written.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    buckets = max(total // BUCKET_WORDS, int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = written.select("book", "first", F.posexplode("words").alias("at", "word"))
    words = words.select("book", (F.col("first") + F.col("at")).alias("number"), F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket"), "word")
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")).cast("long") - 1
    return words.select("book", "number", "bucket", "word", (rank * buckets + F.col("bucket")).alias("term"))


def matrix(docs: DataFrame, text_column: str = "text", names: list[str] | None = None) -> DataFrame:
    """Shards of the document-term matrix: (shard, lists of ``names``, starts, terms, counts)."""
    names = names or []
    options = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": GROUP_ROWS}
    written = shared_table(shards(docs, text_column, names), "matrix", options)

    def renumber(rows: pa.Table, ids: pa.Table) -> pa.Table:
        numbers, found = (_flat(ids, n) for n in ("numbers", "terms"))
        own = np.zeros(len(numbers), dtype=np.int64)
        own[numbers] = found
        parts = []
        for at in range(rows.num_rows):
            row = rows.slice(at, 1)
            columns = own[np.cumsum(_flat(row, "steps"), dtype=np.int32)]
            listed = pa.ListArray.from_arrays(pa.array([0, len(columns)], pa.int32()), pa.array(columns))
            parts.append(row.select(["shard", *names, "starts"]).append_column("terms", listed).append_column("counts", row.column("counts")))
        return pa.concat_tables(parts)

    kinds = {f.name: f.dataType.simpleString() for f in written.schema}
    lists = "".join(f", `{n}` {kinds[n]}" for n in names)
    # A bucket's task packs what each book gets from it ahead of the shuffle by book.
    ids = terms(written.select("book", "first", "words")).groupBy("book", "bucket").agg(
        F.collect_list("number").alias("numbers"), F.collect_list("term").alias("terms"))
    return (
        written.drop("words", "first").groupBy("book").cogroup(ids.drop("bucket").groupBy("book"))
        .applyInArrow(renumber, f"shard long{lists}, starts array<int>, terms array<bigint>, counts array<int>")
    )


def _flat(table: pa.Table, name: str) -> np.ndarray:
    """All values of a column of lists."""
    column = table.column(name)
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]) if column.num_chunks else np.zeros(0, dtype=np.int64)


def measured(shards_of: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of every row with its row sum and its nonzero count: (…, words, distinct)."""
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                starts, counts = (row.column(row.schema.get_field_index(n)).flatten().to_numpy() for n in ("starts", "counts"))
                sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[starts]
                kept = [row.column(row.schema.get_field_index(n)).flatten() for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(sums)), pa.array(np.diff(starts).astype(np.int64))], names=[*names, "words", "distinct"])

    kinds = {f.name: f.dataType.elementType.simpleString() for f in shards_of.schema if f.name in names}
    return shards_of.select(*names, "starts", "counts").mapInArrow(run, "".join(f"`{n}` {kinds[n]}, " for n in names) + "words long, distinct long")


def doc_facts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(id, part, mark, fails) of every row: a 128-bit digest of the text, and filters A to D that it fails as bits."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    signs = (100 * capitals > CAPITALS * F.length("text")).cast("int") * 4 + F.col("text").rlike(SIGNS).cast("int") * 8
    rows = rows.select("id", "part", F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("mark"), signs.alias("signs"), "text")
    names = ["id", "part", "mark", "signs"]
    counted = measured(matrix(rows, "text", names), names)
    fails = (F.col("words") < WORDS).cast("int") + (100 * F.col("distinct") < DISTINCT * F.col("words")).cast("int") * 2 + F.col("signs")
    return counted.select("id", "part", "mark", fails.alias("fails"))


def kinds_of(facts: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(part, fails, n, good, toxic): rows of each part by the filters that they fail, E included."""
    rows = facts.groupBy("id", "part", "mark", "fails").agg(F.count("*").alias("n"))
    flags = [F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")]
    marks = labels.groupBy(F.col(id_column).alias("own")).agg(*flags).withColumn("null_part", F.lit(0).cast("long"))
    # Null ids are spread by their text's digest, or all would come to one task; they find no label.
    spread = F.when(F.col("id").isNull(), F.xxhash64("mark")).otherwise(0).cast("long")
    rows = rows.withColumn("spread", spread).join(marks, (F.col("id") == F.col("own")) & (F.col("spread") == F.col("null_part")), "left")
    by_copy = rows.groupBy("mark", "part", "fails", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min("id").alias("least"), F.min_by("n", "id").alias("first"))
    least = F.min("least").over(Window.partitionBy("mark"))
    later = F.col("n") - F.col("nameless") - F.when(F.col("least") == F.col("lowest"), F.col("first")).otherwise(0)
    split = by_copy.withColumn("lowest", least).withColumn("later", later).select("part", "quality", "toxic", F.explode(F.array(
        F.struct("fails", (F.col("n") - F.col("later")).alias("n")), F.struct((F.col("fails") + 16).alias("fails"), F.col("later").alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.fails").alias("fails")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("quality")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def _steps() -> str:
    """All orders of the filters, step by step: the step's filter and those before it as bits."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for step, letter in enumerate(order, 1):
            before = sum(1 << k for k in order[:step - 1])
            out.append({"o": "".join(FILTERS[k] for k in order), "s": step, "own": 1 << letter, "before": before})
    return json.dumps(out)


def audit(facts: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each part, order and step; of a part only the 32 kinds of failing meet the 600 steps."""
    kinds = kinds_of(facts, labels, id_column)
    steps = F.from_json(F.lit(_steps()), "array<struct<o string, s int, own int, before int>>")
    own, fails, n = F.col("own"), F.col("fails"), F.col("n")
    hit, gone = fails.bitwiseAND(own) != 0, fails.bitwiseAND(F.col("before")) != 0
    orders = F.lit(len(list(permutations(FILTERS))))

    def total(which, what=n):
        return F.sum(F.when(which, what).otherwise(F.lit(0)))

    met = kinds.select("*", F.explode(steps).alias("at")).select("*", "at.own", "at.before")
    return met.groupBy("part", F.col("at.o").alias("filter_order"), F.col("at.s").alias("step")).agg(
        total(~hit & ~gone).alias("kept"), total(hit & ~gone).alias("removed"), total(hit & gone).alias("redundant"),
        total(fails == own).alias("unique_fails"), total(hit & ~gone, F.col("good")).alias("good_lost"),
        total(hit & ~gone, F.col("toxic")).alias("toxic_lost"),
        # Of all orders, a failing filter comes first of a document's failing ones in the same number.
        total(hit, n * F.call_function("div", orders, F.bit_count("fails"))).cast("long").alias("shapley"))
