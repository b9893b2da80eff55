"""Texts whose five-word shingles have a Jaccard similarity of 0.8 or more, for the near-duplicate stage.

Three bits of 64 find copies with hardly an edit: a similarity of 0.8 is about ten bits, where equal segments of
fingerprints no longer tell pairs from chance.  So this search follows the fingerprints: MinHash bands bring together texts
that may be similar, and pairs that the sketch leaves in doubt are judged by their shingles.

A text is known by its mark, a hash of it, so copies are one item and unlike texts of one fingerprint are two.  What is sought is
the components of all similar texts, so a bucket needn't give all its pairs.  It first joins its texts by a spanning forest of pairs that
the sketch is sure of, and of pairs in doubt each text asks its ``FIRST`` likeliest ones beyond its tree.  Where that was not all, a bucket that still
holds texts of different components asks on, eight times as many each round and never a pair twice, until none is left: so a pair that decides a
component is judged whatever the bucket's size, and a family of copies that are joined already costs no more tests.  A pair in doubt is asked in
the first band it meets in and not in each.  A bucket of more than
``TILE`` texts is dealt to pairs of tiles.  Words are those of the fingerprints; texts of fewer than five words are similar only if they are
equal, so they have no bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.wordhash import mix, word_batches

SIZE, SHARE = 5, 0.8
#: A pair of similarity 0.8 meets in one of the bands but for 7 cases in 100,000.
BANDS, ROWS = 24, 5
#: Shares of equal sketch values: below ``DOUBT`` never similar, from ``SURE`` on always (four standard errors).
DOUBT, SURE = 0.66, 0.94
FIRST, MORE, TILE = 4, 8, 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str) -> set[bytes]:
    """The distinct shingles of a text of five words or more."""
    words = text.encode().lower().split()
    return {b" ".join(words[i:i + SIZE]) for i in range(len(words) - SIZE + 1)}


def similar(left: str, right: str, share: float = SHARE) -> bool:
    a, b = shingles(left), shingles(right)
    both = len(a & b)
    return both > 0 and both * 1000 >= round(share * 1000) * (len(a) + len(b) - both)


def signatures(rows: DataFrame) -> DataFrame:
    """(mark, keys, sketch) of each row of ``rows`` (mark, text) with five words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in word_batches(batches, "text", table=_LOWER):
            at = np.flatnonzero(words.whole(SIZE))
            own, first = np.unique(words.text[at], return_index=True)
            runs = words.runs(words.hashes(), SIZE)[at] if len(at) else np.zeros(0, dtype=np.uint64)
            least = np.empty((len(own), BANDS * ROWS), dtype=np.uint64)
            for k in range(BANDS * ROWS if len(own) else 0):
                least[:, k] = np.minimum.reduceat(runs * _SEEDS[k], first)
            least = mix(least)
            folded = np.zeros((len(own), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for row in range(ROWS):
                folded = mix(folded + least[:, row::ROWS])
            sketch = (least & np.uint64(255)).astype(np.uint8)
            keys = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * BANDS, pa.array(folded.ravel().view(np.int64)))
            marks = batch.column(0).take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([marks, keys, pa.array([s.tobytes() for s in sketch], pa.binary())], names=["mark", "keys", "sketch"])

    return rows.select("mark", "text").mapInArrow(run, "mark long, keys array<bigint>, sketch binary")


def _alike(sketch: np.ndarray, row: int) -> np.ndarray:
    """Share of equal values of one sketch and each of all, less the equal ones of chance."""
    return ((sketch == sketch[row]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def _trees(sketch: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Each row's tree in a spanning forest of the pairs that the sketch is sure of, and its edges."""
    tree, edges, left = np.zeros(len(sketch), dtype=np.int64), [], np.ones(len(sketch), dtype=bool)
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        tree[root], open_rows = root, [root]
        while open_rows:
            row = open_rows.pop()
            near = np.flatnonzero(left & (_alike(sketch, row) >= SURE)) if left.any() else []
            left[near], tree[near] = False, root
            open_rows.extend(np.asarray(near).tolist())
            edges.extend((row, int(k)) for k in near)
    return tree, edges


def bucket_pairs(sketch: np.ndarray, labels: np.ndarray | None, asked: set[tuple[int, int]], most: int,
                 keys: np.ndarray | None = None) -> tuple[list[tuple[int, int, bool]], bool]:
    """Pairs of a bucket that may be similar, each sure or in doubt, and whether there are more.

    Without ``labels`` it is the first round, which joins what is sure.  Later pairs are of different labels and not in ``asked``.
    ``keys`` are the texts' keys in the bands ahead of the bucket's own: a pair in doubt that meets in one of these is left to it,
    so that it is asked once and not once a band.
    """
    out: dict[tuple[int, int], bool] = {}
    more, places = False, np.arange(len(sketch))
    if labels is None:
        labels, edges = _trees(sketch)
        out.update({(min(e), max(e)): True for e in edges})
    if (labels == labels[0]).all():
        return [(*pair, sure) for pair, sure in out.items()], False
    known: dict[int, list[int]] = {}
    for i, k in asked:
        known.setdefault(i, []).append(k)
        known.setdefault(k, []).append(i)
    for row in range(len(sketch)):
        share = _alike(sketch, row)
        fit = (labels != labels[row]) & (share >= DOUBT)
        fit[known.get(row, [])] = False
        near = np.flatnonzero(fit)
        if keys is not None and len(near):
            near = near[~(keys[near] == keys[row]).any(axis=1)]
        if len(near) > most:
            near, more = near[np.lexsort((places[near], -share[near]))[:most]], True
        out.update({(min(row, k), max(row, k)): False for k in near.tolist()})
    return [(*pair, sure) for pair, sure in out.items()], more


def _pairs(first: bool, most: int):
    """Candidates among rows sorted by bucket; a bucket is held until the next begins."""
    names = ["key", "a", "b", "sure", "more"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list[int] = []
        held: list[tuple[bytes, int, list[int]]] = []
        asked: list[tuple[int, int]] = []
        key, out = None, []

        def close() -> None:
            if len(marks) > 1:
                place = {m: i for i, m in enumerate(marks)}
                sketch = np.frombuffer(b"".join(s for s, *_ in held), dtype=np.uint8).reshape(len(held), -1)
                labels = None if first else np.array([label for _, label, _ in held])
                ahead = np.array([k for *_, k in held], dtype=np.int64).reshape(len(held), -1)
                found, more = bucket_pairs(sketch, labels, {(place[a], place[b]) for a, b in asked}, most, ahead)
                out.extend((key, min(marks[i], marks[j]), max(marks[i], marks[j]), sure, more and not sure) for i, j, sure in found)
            marks.clear(), held.clear(), asked.clear()

        def table() -> pa.RecordBatch:
            columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for now, a, b, sketch, label, ahead in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if now != key:
                    close()
                    key = now
                if b is None:
                    marks.append(a)
                    held.append((sketch, label, ahead))
                else:
                    asked.append((a, b))
            yield table()
        close()
        yield table()

    return run


def bands(items: DataFrame) -> DataFrame:
    """(mark, band, key): the bands of ``items`` (mark, keys, sketch)."""
    return items.select("mark", F.posexplode("keys").alias("band", "key"))


def undecided(items: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, count): the bands whose texts are of more than one component of ``labels`` (mark, component), and their texts' number.

    It is one row a band of a text, so a band of many texts that are joined already costs no more than they are.
    """
    labelled = bands(items).join(labels, "mark", "left").select("key", F.coalesce("component", "mark").alias("label"))
    return labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("count")).where("low < high").select("key", "count")


def buckets(items: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(key, mark, sketch, ahead): the buckets of ``items`` (mark, keys, sketch) with more than one text, cut into pairs of tiles.

    ``ahead`` has the text's keys in the bands ahead of the bucket's.  ``wanted`` (key, count) says which bands, where not all.
    """
    keys = bands(items)
    met = keys.groupBy("key").count().where("count > 1") if wanted is None else wanted
    return (
        keys.join(met, "key").join(items.select("mark", "sketch", "keys"), "mark")
        .withColumn("tiles", F.expr(f"int(ceil(count / {TILE}))"))
        .withColumn("tile", F.expr("int(pmod(xxhash64(mark, 7), tiles))"))
        .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        .select(F.expr("if(tiles = 1, key, xxhash64(key, least(tile, other), greatest(tile, other)))").alias("key"), "mark", "sketch", F.expr("slice(keys, 1, band)").alias("ahead"))
    )


def candidates(held: DataFrame, most: int, asked: DataFrame | None = None) -> DataFrame:
    """(key, a, b, sure, more) of the pairs of each bucket of ``held`` (key, mark, sketch, ahead, and label after the first round)."""
    first = asked is None
    label = F.lit(None).cast("long") if first else F.col("label")
    rows = held.select("key", F.col("mark").alias("a"), F.lit(None).cast("long").alias("b"), "sketch", label.alias("label"), "ahead")
    if not first:
        rows = rows.unionByName(asked.select("key", "a", "b"), allowMissingColumns=True)
    return rows.repartition("key").sortWithinPartitions("key", "b", "a").mapInArrow(
        _pairs(first, most), "key long, a long, b long, sure boolean, more boolean")


def judged(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (mark, text) are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(np.flatnonzero(good), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in range(2)], names=["a", "b"])

    left, right = texts.toDF("a", "left"), texts.toDF("b", "right")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")
