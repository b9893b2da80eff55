"""Periodic runs of words, as maximal pairs of an LCP-interval tree.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(LEAST, TIMES * q)`` words that no
neighbouring word extends.  Its beginning and the place ``q`` words on are a maximal pair: the same words follow both for
the run's length less ``q``, the words before them differ (or there is none), and so do the words after.  Such a pair belongs to the LCP interval whose
depth is that length, so the length of the run is read off the tree and nothing is extended.

Suffixes are sorted by prefix doubling, in numpy; depths come from the ranks of the doubling steps.  The tree is walked
bottom-up.  An interval has the list of its places in order, each in the class of the word to its left; smaller lists
are merged into the largest.  Two places of different children and different classes are a maximal pair; they make a run if
their distance is at most a (``TIMES`` - 1)-th of the depth.  Only neighbours in the list have to be asked: a place between
the two would give the stretch a smaller period.  So each merged place asks its two neighbours, and a text of ``n`` words takes
about ``n log n`` steps however often a word repeats.  No run has a shorter pair than ``LEAST - 1`` words, so
only suffixes that share so many words enter the tree.

A word is dropped if a run contains it after that run's first ``q`` words; the rest is the collapsed text.

Each text is worked on by itself, in one task: memory grows with the longest text (about 0.3 KB a word while it is worked on), not with
the table.  Null and empty texts have no words, no runs and an empty collapsed text.  Repeated rows come back as often as
given, null ids too; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.wordhash import text_bytes

LEAST, TIMES = 6, 4
Run = tuple[int, int, int]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SQL = "struct<start: bigint, length: bigint, period: bigint>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def prefix_ranks(x: np.ndarray, depth: int) -> list[np.ndarray] | None:
    """Ranks of the prefixes of 1, 2, 4, … words of all suffixes, until all differ; none if they differ before ``depth`` words."""
    levels, span = [x.astype(np.int32)], 1
    while True:
        last = levels[-1]
        following = np.zeros(len(x), dtype=np.int64)
        following[:max(0, len(x) - span)] = last[span:] + 1
        kinds, ranks = np.unique(last.astype(np.int64) * (len(x) + 1) + following, return_inverse=True)
        span *= 2
        if len(kinds) == len(x):
            if span < depth:
                return None
            levels.append(ranks.astype(np.int32))
            return levels
        levels.append(ranks.astype(np.int32))


def common_depths(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Number of words that each suffix in order shares with the one after it."""
    left, right = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    depth, count = np.zeros(len(left), dtype=np.int64), len(order)
    for power in range(len(levels) - 1, -1, -1):
        a, b = left + depth, right + depth
        inside = (a < count) & (b < count)
        same = levels[power][np.where(inside, a, 0)] == levels[power][np.where(inside, b, 0)]
        depth += np.where(inside & same, 1 << power, 0)
    return depth


def _close(depth: int, children: list[list[int]], before: list[int], times: int, least: int, found: set[Run]) -> list[int]:
    """An interval's places from its children's; runs among them join ``found``."""
    children.sort(key=len)
    places = children.pop()
    owner = {place: child for child, own in enumerate(children) for place in own}
    for place in owner:
        insort(places, place)
    last = len(places) - 1
    for place, child in owner.items():
        at = bisect_left(places, place)
        for k in (at - 1, at + 1):
            if 0 <= k <= last:
                first, second = (places[k], place) if k < at else (place, places[k])
                period = second - first
                if (
                    period * (times - 1) <= depth and period + depth >= least
                    and before[first] != before[second] and owner.get(places[k], -1) != child
                ):
                    found.add((first, depth + period, period))
    return places


def runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every run, by start and then period."""
    if len(words) < least:
        return []
    x, depth = numbered(words), min(least - 1, (times - 1) * (least // times + 1))
    levels = prefix_ranks(x, depth)
    if levels is None:
        return []
    order = np.empty(len(x), dtype=np.int64)
    order[levels[-1]] = np.arange(len(x))
    shared = common_depths(levels, order)
    deep = np.flatnonzero(shared >= depth)
    if not len(deep):
        return []
    before = np.concatenate([[-1], x[:-1]]).tolist()
    found: set[Run] = set()
    cuts = np.flatnonzero(np.diff(deep) > 1) + 1
    for group in np.split(deep, cuts):  # subtrees below ``depth``
        places, depths = order[group[0]:group[-1] + 2].tolist(), [*shared[group[0]:group[-1] + 1].tolist(), 0]
        open_ones: list[tuple[int, list[list[int]]]] = []
        for place, now in zip(places, depths, strict=True):
            last = [place]
            while open_ones and open_ones[-1][0] > now:
                down, children = open_ones.pop()
                last = _close(down, [*children, last], before, times, least, found)
            if open_ones and open_ones[-1][0] == now:
                open_ones[-1][1].append(last)
            else:
                open_ones.append((now, [last]))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if found:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in found:
            keep[start + period:start + length] = False
        words = list(compress(words, keep))
    return b" ".join(words)


def best_run(found: list[Run]) -> Run | None:
    """The run of the greatest exact length by period; of ties the first, then that of the smaller period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _structs(rows: list[Run | None]) -> pa.Array:
    return pa.array([None if r is None else dict(zip(("start", "length", "period"), r, strict=True)) for r in rows], _RUN)


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(id, n_words, runs, best, collapsed) of every row; ``best`` is null where there is no run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            sizes, flat, cuts, bests, texts = [], [], [0], [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                words = data[a:b].tobytes().split()
                found = runs(words, least, times)
                sizes.append(len(words))
                flat.extend(found)
                cuts.append(len(flat))
                bests.append(best_run(found))
                texts.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), _structs(flat)),
                 _structs(bests), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["id", "n_words", "runs", "best", "collapsed"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, runs array<{_SQL}>, best {_SQL}, collapsed string")


def with_planted_tails(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id and text only) with the tail of every tenth text, by a checksum of the id, made periodic; null ids stay as they are."""
    check = F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8"))
    rows = docs.select(id_column, text_column, check.alias("_check")).withColumn(
        "_words", F.when(F.col("_check") % 10 == 0, F.array_remove(F.split(text_column, r"[\x20\x09-\x0D]+"), "")))
    rows = rows.withColumn("_n", F.size("_words").cast("long")).withColumn("_g", F.floor(F.col("_check") / 10))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tail = F.slice("_words", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    made = F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), F.flatten(F.array_repeat(tail, times))), F.lit(1), F.col("_n").cast("int"))
    text = F.when(F.col("_a").isNotNull(), F.array_join(made, " ")).otherwise(F.col(text_column))
    return rows.select(id_column, text.alias(text_column))
