"""SimHash fingerprints, and exact near-duplicate groups of them by pigeonring filtering.

Two fingerprints that differ in at most 3 of 64 bits are cut into 16 segments on a ring.  By the pigeonring
principle some chain of consecutive segments starts where every prefix of ``l`` segments differs in at most
``3 * l / 16`` bits: nothing in the first 5 segments, one bit in the first 10, two in the first 15.  So one of
the two halves of segments 6 to 10 is equal too, and 16 starts x 2 halves of 30 equal bits find every pair.
Chains are checked against their budgets before the full Hamming distance.

Copies share a fingerprint and are one item.  A bucket is compared in numpy and gives the edges of a
spanning forest, at most one for each item; a bucket of more than ``TILE`` items is dealt to pairs of tiles.

Null and empty texts have fingerprint 0 and link like others; repeated rows come back as often as given; rows
with a null id keep their fingerprint and count for nothing in a group's name; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.graph import components
from docloom.llm.shared import shared_table
from docloom.llm.similar import FIRST, MORE, buckets, candidates, judged, signatures, undecided

SEGMENTS, WIDTH, MOST = 16, 4, 3
TILE = 1024
#: Bits that may differ in the first ``l`` segments of a chain, for l = 1 to 16.
BUDGETS = [length * MOST // SEGMENTS for length in range(1, SEGMENTS + 1)]
_BATCH = 1 << 15


def simhash(text: str | None, size: int = 3) -> int:
    """The 64-bit fingerprint of one text: bit by bit the majority of the hashes of its ``size``-word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    joined, ends = b" ".join(words), np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:max(1, len(words) - size + 1)]
    stops = ends[min(size, len(words)) - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _BATCH):
        pairs = zip(starts[at:at + _BATCH].tolist(), stops[at:at + _BATCH].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3,
                 also: str | None = None) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long, one row for each row of ``docs``; ``also`` names a long to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([simhash(x.as_py(), size) for x in batch.column(1)], dtype=np.uint64)
            more = [batch.column(2)] if also else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64)), *more], names=["id", "fp", *kept])

    kind, kept = docs.schema[id_column].dataType.simpleString(), [also] if also else []
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), *kept)
    return rows.mapInArrow(run, f"id {kind}, fp long" + "".join(f", {c} long" for c in kept))


def _chained(left: np.ndarray, right: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs keep the budgets of a chain from their start segment on, ending with the whole fingerprint."""
    start = start.astype(np.uint64) * np.uint64(WIDTH)
    back = (np.uint64(64) - start) & np.uint64(63)
    differ = left ^ right
    differ = (differ << start) | np.where(start == 0, np.uint64(0), differ >> back)
    good = np.ones(len(differ), dtype=bool)
    for length in range(1, SEGMENTS + 1):
        if length == SEGMENTS or BUDGETS[length] > BUDGETS[length - 1]:  # budgets bind where they rise
            good &= np.bitwise_count(differ >> np.uint64(64 - WIDTH * length)) <= BUDGETS[length - 1]
    return good


def _bucket_edges(key: np.ndarray, fp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of each bucket of sorted keys; large buckets give the edges of a spanning forest."""
    left, right = [], []
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    size = np.diff(bounds)
    for at in np.flatnonzero(size > 16):
        a, b = bounds[at], bounds[at + 1]
        marks, label = fp[a:b], np.arange(b - a)
        near = np.empty((b - a, b - a), dtype=bool)
        for row in range(b - a):
            near[row] = _chained(np.full(b - a, marks[row]), marks, np.full(b - a, start[a]))
        while True:
            least = np.where(near, label[None, :], b - a).min(axis=1)
            least = np.minimum(least, label)
            least = least[least]
            if (least == label).all():
                break
            label = least
        left.append(marks)
        right.append(marks[label])
    small = np.repeat(size <= 16, size)
    for step in range(1, min(16, int(size.max(initial=1)))):
        same = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
        same = same[_chained(fp[same], fp[same + step], start[same])]
        left.append(fp[same])
        right.append(fp[same + step])
    if not left:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges among rows sorted by bucket; the last bucket of a batch waits for the next batch."""
    rest = None
    for batch in _and_end(batches):
        if batch is not None:
            now = [np.asarray(batch.column(i)) for i in range(3)]
            rest = now if rest is None else [np.concatenate(pair) for pair in zip(rest, now, strict=True)]
            if not len(rest[0]):
                continue
            cut = int(np.searchsorted(rest[0], rest[0][-1]))
        else:
            if rest is None:
                return
            cut = len(rest[0])
        done, rest = [x[:cut] for x in rest], [x[cut:] for x in rest]
        a, b = _bucket_edges(done[0], done[1].astype(np.int64).view(np.uint64), done[2])
        keep = a != b
        yield pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)) for x in (a, b)], names=["a", "b"])


def _and_end(batches):
    yield from batches
    yield None


def linked_fingerprints(marks: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints in column ``fp`` of at most 3 differing bits."""
    turn = "(shiftleft(fp, s) | shiftrightunsigned(fp, 64 - s))"
    keys = (
        marks.select("fp").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENTS - 1))))
        .withColumn("s", F.expr(f"int(t div 2) * {WIDTH}"))
        .selectExpr("fp", "t", f"shiftrightunsigned({turn}, 44) AS head", f"shiftrightunsigned({turn}, if(t % 2 = 0, 34, 24)) & 1023L AS half")
        .selectExpr("fp", "int(t div 2) AS start", "(bigint(t) * 1048576 + head) * 1024 + half AS key")
    )
    hot = keys.groupBy("key").count().where(F.col("count") > TILE).selectExpr("key", "int(ceil(count / %d)) AS tiles" % TILE)
    # Bucket keys are below 2**35; tile pairs of hot buckets are negative numbers.
    parts = (
        keys.join(hot, "key", "left")
        .withColumn("tile", F.expr("int(pmod(xxhash64(fp, 7), coalesce(tiles, 1)))"))
        .withColumn("other", F.explode(F.expr("sequence(0, coalesce(tiles, 1) - 1)")))
        .selectExpr(
            "CASE WHEN tiles IS NULL THEN key ELSE -1 - shiftrightunsigned(xxhash64(key, least(tile, other), greatest(tile, other)), 1) END AS key",
            "fp", "start",
        )
    )
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def near_fingerprints(marks: DataFrame) -> DataFrame:
    """(node, component) of all distinct fingerprints in column ``fp`` that link with another one."""
    return components(linked_fingerprints(marks), "a", "b")


def _named(marks: DataFrame, linked: DataFrame, node: str = "fp") -> DataFrame:
    """(node, component_id): the smallest id of each node's component; ``node`` is a column of ``marks``."""
    least = (
        marks.groupBy(node).agg(F.min("id").alias("first")).join(linked.withColumnRenamed("node", node), node, "left")
        .withColumn("group", F.coalesce("component", node))
    )
    named = least.groupBy("group").agg(F.min("first").alias("component_id"))
    return least.join(named, "group").select(node, "component_id")


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3) -> DataFrame:
    """(id, fp, component_id): fingerprint and smallest id reachable by links of at most 3 differing bits."""
    marks = shared_table(fingerprints(docs, id_column, text_column, size), "fingerprints")
    linked = shared_table(near_fingerprints(marks), "components")
    return marks.join(_named(marks, linked), "fp").select("id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its group; rows with a null id stay.

    Fingerprints of at most 3 differing bits link, and so do texts whose five-word shingles have a similarity of 0.8 or
    more (``docloom.llm.similar``).  Of rows of one id only those whose text is in a group with a smaller id go.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    marks = shared_table(fingerprints(rows, "id", "text", also="mark"), "fingerprints")
    distinct = marks.select("fp", "mark").distinct()
    one = shared_table(distinct.groupBy("fp").agg(F.min("mark").alias("least")), "representatives")
    ends = linked_fingerprints(marks).join(one.toDF("a", "left"), "a").join(one.toDF("b", "right"), "b")
    links = shared_table(
        ends.selectExpr("left AS a", "right AS b").unionByName(distinct.join(one, "fp").where("mark != least").selectExpr("mark AS a", "least AS b")), "links"
    )
    items = shared_table(signatures(rows.dropDuplicates(["mark"])), "signatures")
    groups = shared_table(components(_similar_links(items, rows, links), "a", "b"), "components")
    named = marks.join(_named(marks, groups, "mark"), "mark")
    gone = named.where("id != component_id").select(F.col("id").alias("_gone"), F.col("mark").alias("_gone_mark")).distinct()
    mark = F.xxhash64(F.coalesce(docs[text_column], F.lit("")))
    return docs.join(gone, (docs[id_column] == gone["_gone"]) & (mark == gone["_gone_mark"]), "left_anti")


def _similar_links(items: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` (a, b) with links that join all texts of ``rows`` (mark, text) that the bands of ``items`` bring together and that are similar."""
    held, most, emitted = buckets(items), FIRST, None
    while True:
        found = shared_table(candidates(held, most, emitted), "candidates")
        doubt = found.where("NOT sure").select("a", "b").distinct()
        asked = doubt.select(F.col("a").alias("mark")).unionByName(doubt.select(F.col("b").alias("mark"))).distinct()
        texts = rows.select("mark", "text").join(asked, "mark", "left_semi").dropDuplicates(["mark"])
        links = shared_table(links.unionByName(found.where("sure").select("a", "b")).unionByName(judged(doubt, texts)), "links")
        own = found.where("NOT sure").select("key", "a", "b")
        emitted = own if emitted is None else emitted.unionByName(own)
        rest = found.where("more").select("key").distinct()
        if rest.isEmpty():
            return links
        labels = shared_table(components(links, "a", "b"), "labels").withColumnRenamed("node", "mark")
        # Buckets that have asked only a part of their pairs and still hold more than one component.
        wanted = shared_table(undecided(items, labels), "undecided")
        part = buckets(items, wanted).join(rest, "key", "left_semi").join(labels, "mark", "left")
        part = shared_table(part.select("key", "mark", "sketch", "ahead", F.coalesce("component", "mark").alias("label")), "buckets")
        mixed = part.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        held, most = part.join(mixed, "key", "left_semi"), most * MORE
        if mixed.isEmpty():
            return links
