"""Chunking: one row of text in, one row per chunk out, all inside the row.

The greedy fold works on segment lengths.  Because segments are joined with one space, every chunk is
a contiguous part of the joined text; the fold keeps only its bounds and the text is cut once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import basename, bound, lines_of
from docloom.operators.extraction import explode_once
from docloom.options import SHELL_CHUNK_OVERLAP, SHELL_CHUNK_SIZE, ChunkOptions

# Where segments end, and where sentences end.
PARAGRAPH_BREAK = r"\n\s*\n"
LINE_BREAK = r"\n"
TOKEN_BREAK = r"\s+|[.,;!?]"
SENTENCE_BREAK = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|!)\s"

SEGMENT_BREAKS = {"paragraph": PARAGRAPH_BREAK, "line": LINE_BREAK, "token": TOKEN_BREAK}

_BOUNDS = "array<struct<from:int,until:int>>"


def _bounds(lengths: Column, size: int, overlap: int) -> Column:
    """Bounds of the greedy chunks over segments of the given lengths, in the joined text."""
    start = F.struct(
        F.array().cast(_BOUNDS).alias("out"),
        F.lit(0).alias("from"), F.lit(0).alias("until"), F.lit(0).alias("next"),
    )

    def step(acc: Column, length: Column) -> Column:
        held = acc["until"] - acc["from"]
        full = (held > 0) & (held + length > size)
        kept = F.when(full, F.least(held, F.lit(overlap))).otherwise(held)
        return F.struct(
            F.when(
                full,
                F.concat(acc["out"], F.array(F.struct(acc["from"].alias("from"), acc["until"].alias("until")))),
            ).otherwise(acc["out"]).alias("out"),
            # An empty chunk starts with the segment; otherwise the kept tail is continued.
            F.when(kept > 0, acc["until"] - kept).otherwise(acc["next"]).alias("from"),
            (acc["next"] + length).alias("until"),
            (acc["next"] + length + 1).alias("next"),
        )

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["from"].alias("from"), acc["until"].alias("until")))
        return F.when(acc["until"] > acc["from"], F.concat(acc["out"], last)).otherwise(acc["out"])

    return F.aggregate(lengths, start, step, finish)


def _chunk_rows(df: DataFrame, keys: list[str], array: Column) -> DataFrame:
    rows = explode_once(df, keys, array, "chunk_text")
    return rows.select(*keys, F.col("ordinal").alias("chunk_index"), "chunk_text")


def _by_segments(df: DataFrame, keys: list[str], text: str, pattern: str, size: int, overlap: int) -> DataFrame:
    parts = df.select(*keys, F.split(F.col(text), pattern, -1).alias("_segments"))
    parts = parts.select(
        *keys,
        F.array_join("_segments", " ").alias("_joined"),
        _bounds(F.transform("_segments", F.length), size, overlap).alias("_bounds"),
    )
    rows = explode_once(parts, [*keys, "_joined"], F.col("_bounds"), "_b")
    cut = F.substring(F.col("_joined"), F.col("_b.from") + 1, F.col("_b.until") - F.col("_b.from"))
    return rows.select(*keys, F.col("ordinal").alias("chunk_index"), cut.alias("chunk_text"))


def _strides(length: Column, size: int, overlap: int) -> Column:
    """0-based chunk starts with a fixed stride; the last chunk reaches the end."""
    stride = size - overlap
    if stride <= 0:
        raise ValueError("the overlap must be smaller than the chunk size")
    count = F.greatest(F.ceil((length - overlap) / stride).cast("int"), F.lit(1))
    starts = F.transform(F.sequence(F.lit(1), count), lambda i: (i - 1) * stride)
    return F.when(length > 0, starts).otherwise(F.array().cast("array<int>"))


def _by_character(df: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    body = F.col(text)
    rows = explode_once(df, dict.fromkeys([*keys, text]), _strides(F.length(body), size, overlap), "_s")
    cut = F.substring(body, F.col("_s") + 1, F.lit(size))
    return rows.select(*keys, F.col("ordinal").alias("chunk_index"), cut.alias("chunk_text"))


def _by_size(df: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """Fixed numbers of bytes; a character cut in two is shown by the replacement character."""
    body = F.col("_bytes")
    df = df.select(*keys, F.encode(F.col(text), "UTF-8").alias("_bytes"))
    rows = explode_once(df, [*keys, "_bytes"], _strides(F.octet_length(body), size, 0), "_s")
    cut = F.substring(body, F.col("_s") + 1, F.lit(size))
    return rows.select(
        *keys,
        F.col("ordinal").alias("chunk_index"),
        F.make_valid_utf8(cut.cast("string")).alias("chunk_text"),
        cut.alias("chunk_bytes"),
    )


_BLOCKS = "array<struct<tail:string,first:int,count:int,closed:boolean>>"


def _block_text(lines: Column, block: Column) -> Column:
    """The carried tail and the lines of a block; blank lines stand for two breaks, but for one that opens a text."""
    own = F.slice(lines, block["first"] + 1, block["count"])
    opened = F.length(block["tail"]) > 0
    pieces = F.transform(own, lambda line, i: F.when((line == "") & (opened | (i > 0)), F.lit("\n\n")).otherwise(F.concat(line, F.lit("\n"))))
    return F.concat(block["tail"], F.array_join(pieces, ""), F.when(block["closed"], "\n\n").otherwise(""))


def _block(tail: Column, first: Column, count: Column, closed: bool) -> Column:
    return F.struct(tail.alias("tail"), first.alias("first"), count.alias("count"), F.lit(closed).alias("closed"))


def _by_blank_line(df: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """Close a chunk at a blank line once it is large enough; carry its last characters.

    Sizes count characters, so that a carried tail never splits one.  The fold keeps numbers of lines and the carried tail; a chunk's
    text is made of its own lines.
    """
    lines = lines_of(F.regexp_replace(F.col(text), r"\n\z", ""))

    def blocks(rows: Column) -> Column:
        start = F.struct(
            F.array().cast(_BLOCKS).alias("out"), F.lit("").alias("tail"), F.lit(0).alias("first"),
            F.lit(0).alias("count"), F.lit(0).alias("size"),
        )

        def step(acc: Column, line: Column) -> Column:
            blank = (line == "") & (acc["size"] > 0)
            closes = blank & (acc["size"] + 2 >= size)
            whole = _block(acc["tail"], acc["first"], acc["count"], True)
            if overlap > 0:
                tail = F.regexp_replace(F.right(F.concat(_block_text(rows, whole), F.lit("\n")), F.lit(overlap)), r"\n+\z", "")
            else:
                tail = F.lit("")
            kept = bound(F.when(closes, tail).otherwise(acc["tail"]), lambda t: F.struct(t.alias("tail"), F.length(t).alias("length")))
            added = F.when(blank, 2).otherwise(F.length(line) + 1)
            return bound(kept, lambda k: F.struct(
                F.when(closes, F.concat(acc["out"], F.array(whole))).otherwise(acc["out"]).alias("out"),
                k["tail"].alias("tail"),
                F.when(closes, acc["first"] + acc["count"] + 1).otherwise(acc["first"]).alias("first"),
                F.when(closes, 0).otherwise(acc["count"] + 1).alias("count"),
                F.when(closes, k["length"]).otherwise(acc["size"] + added).alias("size"),
            ))

        def finish(acc: Column) -> Column:
            rest = F.array(_block(acc["tail"], acc["first"], acc["count"], False))
            return F.when(acc["size"] > 0, F.concat(acc["out"], rest)).otherwise(acc["out"])

        return F.transform(F.aggregate(rows, start, step, finish), lambda block: _block_text(rows, block))

    body = F.when(F.length(text) > 0, bound(lines, blocks))
    return _chunk_rows(df, keys, body)


_RUNS = "array<struct<first:int,count:int>>"


def _by_sentence(df: DataFrame, keys: list[str], text: str, size: int, overlap: int) -> DataFrame:
    """Whole sentences; the overlap is made of the trailing sentences that fit.

    The fold keeps numbers of sentences; a chunk's text is made of its own sentences.
    """
    sentences = F.split(F.col(text), SENTENCE_BREAK, -1)

    def trailing(lengths: Column) -> Column:
        """How many trailing sentences fit and what they measure, one blank each included."""
        def fits(acc: Column, length: Column) -> Column:
            return acc["open"] & (acc["size"] + length <= overlap)

        return F.aggregate(
            F.reverse(lengths),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open")),
            lambda acc, x: F.struct(
                F.when(fits(acc, x), acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                F.when(fits(acc, x), acc["size"] + x + 1).otherwise(acc["size"]).alias("size"),
                fits(acc, x).alias("open"),
            ),
        )

    def runs(lengths: Column) -> Column:
        start = F.struct(F.array().cast(_RUNS).alias("out"), F.lit(0).alias("first"), F.lit(0).alias("count"), F.lit(0).alias("size"))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open"))

        def run(acc: Column) -> Column:
            return F.array(F.struct(acc["first"].alias("first"), acc["count"].alias("count")))

        def step(acc: Column, length: Column) -> Column:
            full = (acc["count"] > 0) & (acc["size"] + length > size)
            kept = trailing(F.slice(lengths, acc["first"] + 1, acc["count"])) if overlap > 0 else none
            carried = F.when(full, kept).otherwise(F.struct(acc["count"].alias("n"), acc["size"].alias("size"), F.lit(True).alias("open")))
            return bound(carried, lambda k: F.struct(
                F.when(full, F.concat(acc["out"], run(acc))).otherwise(acc["out"]).alias("out"),
                F.when(full, acc["first"] + acc["count"] - k["n"]).otherwise(acc["first"]).alias("first"),
                (k["n"] + 1).alias("count"),
                (k["size"] + length + 1).alias("size"),
            ))

        return F.aggregate(lengths, start, step, lambda acc: F.concat(acc["out"], run(acc)))

    def texts(parts: Column) -> Column:
        return F.transform(bound(F.transform(parts, F.length), runs),
                           lambda run: F.array_join(F.slice(parts, run["first"] + 1, run["count"]), " "))

    return _chunk_rows(df, keys, bound(sentences, texts))


def chunk(df: DataFrame, keys: list[str], strategy: str = "paragraph", max_size: int | None = None,
          overlap: int | None = None, text: str = "text") -> DataFrame:
    """Rows (keys, chunk_index, chunk_text) of the chunks of every text."""
    size, overlap = ChunkOptions(strategy, max_size, overlap).resolved()
    if strategy in SEGMENT_BREAKS:
        return _by_segments(df, keys, text, SEGMENT_BREAKS[strategy], size, overlap)
    if strategy == "character":
        return _by_character(df, keys, text, size, overlap)
    if strategy == "size":
        return _by_size(df, keys, text, size)
    if strategy == "blank_line":
        return _by_blank_line(df, keys, text, size, overlap)
    if strategy == "sentence":
        return _by_sentence(df, keys, text, size, overlap)
    raise ValueError(f"unknown chunk strategy: {strategy}")


def chunk_where_needed(df: DataFrame, keys: list[str], needed: Column, strategy: str = "paragraph",
                       max_size: int | None = None, overlap: int | None = None,
                       text: str = "text") -> DataFrame:
    """Chunks of the rows that need it, the whole text as chunk 0 of the others."""
    long = chunk(df.filter(needed), keys, strategy, max_size, overlap, text)
    whole = df.filter(~F.coalesce(needed, F.lit(False))).select(
        *keys, F.lit(0).alias("chunk_index"), F.col(text).alias("chunk_text")
    )
    return long.select(*keys, "chunk_index", "chunk_text").unionByName(whole)


def chunk_parent(df: DataFrame, keys: list[str], strategy: str, path: str = "file_path",
                 text: str = "text", max_size: int = SHELL_CHUNK_SIZE,
                 overlap: int = SHELL_CHUNK_OVERLAP) -> DataFrame:
    """Parent record of a chunked item: how it was cut and how large it is."""
    info = F.struct(
        basename(F.col(path)).alias("original_file"),
        F.lit(strategy).alias("chunking_strategy"),
        F.lit(max_size).alias("chunk_size"),
        F.lit(overlap).alias("chunk_overlap"),
        F.octet_length(text).alias("file_size"),
    )
    return df.select(*keys, F.to_json(F.struct(info.alias("chunk_info"))).alias("analysis"))
