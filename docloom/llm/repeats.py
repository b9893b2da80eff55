"""Removal of repeated word runs by fixed-block anchors.

The reference index holds the hash of every ``BLOCK``-word block at a multiple of ``BLOCK`` in its document; every
rolling window of ``BLOCK`` words probes it.  ``window >= 2 * BLOCK - 1``, so each window holds an aligned block, and a
window that occurs twice is around an anchor: a block of the index that occurs elsewhere too.  Hits are extended
to every window around an anchor; windows are compared by 96 bits, and runs of repeated windows are the maximal
repeats.  The first occurrence (smallest id, then place) stays, all words of later ones go.

Documents are dealt to chunks of about ``CHUNK_BYTES`` of text.  A chunk sends each hash once, packed by bucket, so a
passage that a third of all documents share costs one entry a chunk and no group of its rows ever meets:
  1. chunk -> bucket: block hashes of the index, hashes of all rolling windows;
  2. bucket -> chunk: anchors;
  3. chunk -> bucket: the chunk's first occurrence of each window around an anchor, with its place;
  4. bucket -> chunk: places of windows that start earlier elsewhere.
The anchors' 40-bit values are only a filter: a false one costs time, not a result.

Null and empty texts have no words.  Null ids come first.  Rows of one id are ordered by a hash of their text, and
equal rows by their order in the chunk, so of repeated rows one keeps its words.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.wordhash import Words, text_bytes

WINDOW, BLOCK = 20, 10
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20
_NULL = -(1 << 63)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed bytes."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    rows, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        out.append(np.frombuffer(data, dtype=kind, count=rows, offset=at))
        at += rows * np.dtype(kind).itemsize
    return out


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 32-bit values; steps compress better than values."""
    return pack(np.diff(values, prepend=np.uint32(0)).astype(np.uint32))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, "<u4")[0], dtype=np.uint32)


class Chunk:
    """The documents of a chunk in document order, and their words."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").combine_chunks().fill_null(_NULL).to_numpy(zero_copy_only=False)
        marks = table.column("mark").combine_chunks().to_numpy(zero_copy_only=False)
        self.table = table.take(pa.array(np.lexsort((marks, ids)))).combine_chunks()
        self.ids, self.marks = np.sort(ids), marks[np.lexsort((marks, ids))]
        texts = self.table.column("text")
        self.words = Words(*text_bytes(texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())))

    def blocks(self, hashes: np.ndarray, size: int, buckets: int) -> np.ndarray:
        """40-bit value of the run from each word on (bucket and low bits); meaningless where no run is."""
        runs = self.words.runs(hashes, size)
        return ((runs >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (runs & np.uint64(0xFFFFFFFF))


def _rows(out: dict[str, list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pydict({n: pa.array(out[n], schema.field(n).type) for n in schema.names}, schema=schema)


def _probes(buckets: int, block: int):
    """Step 1: per bucket the chunk's distinct run hashes, those that repeat within it, and those of the index."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("many", pa.binary()), ("index", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in schema.names}
        chunk = Chunk(table)
        words = chunk.words
        if len(words):
            values, whole = chunk.blocks(words.hashes(), block, buckets), words.whole(block)
            aligned = whole & ((np.arange(len(words)) - words.first[words.text]) % block == 0)
            distinct, counts = np.unique(values[whole], return_counts=True)
            index = np.unique(values[aligned])
            number = table.column("chunk")[0].as_py()
            parts = [(x, np.searchsorted(x >> np.uint64(32), np.arange(buckets + 1))) for x in (distinct, distinct[counts > 1], index)]
            for bucket in range(buckets):
                cut = [x[at[bucket]:at[bucket + 1]].astype(np.uint32) for x, at in parts]
                if len(cut[0]):
                    for name, value in zip(schema.names, (bucket, number, *map(pack_sorted, cut)), strict=True):
                        out[name].append(value)
        return _rows(out, schema)

    return run, "bucket int, chunk int, once binary, many binary, index binary"


def _anchors(table: pa.Table) -> pa.Table:
    """Step 2: for each chunk its hashes that are in the index and occur at more than one place."""
    schema = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hits", pa.binary())])
    out: dict[str, list] = {n: [] for n in schema.names}
    once = [unpack_sorted(x.as_py()) for x in table.column("once")]
    values, counts = np.unique(np.concatenate(once), return_counts=True)
    many = np.unique(np.concatenate([unpack_sorted(x.as_py()) for x in table.column("many")]))
    index = np.unique(np.concatenate([unpack_sorted(x.as_py()) for x in table.column("index")]))
    good = np.intersect1d(np.union1d(values[counts > 1], many), index, assume_unique=True)
    for chunk, own in zip(table.column("chunk").to_pylist(), once, strict=True):
        hits = own[np.isin(own, good, assume_unique=True)]
        if len(hits):
            for name, value in zip(schema.names, (chunk, table.column("bucket")[0].as_py(), pack_sorted(hits)), strict=True):
                out[name].append(value)
    return _rows(out, schema)


def _windows(buckets: int, parts: int, window: int, block: int):
    """Step 3: windows around anchors, as the chunk's first occurrences by part, and places of its later ones."""
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.binary()), ("later", pa.binary())])

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in schema.names}
        if not docs.num_rows or not hits.num_rows:
            return _rows(out, schema)
        chunk, number = Chunk(docs), docs.column("chunk")[0].as_py()
        words = chunk.words
        hashes = words.hashes()
        known = np.sort(np.concatenate([
            unpack_sorted(h).astype(np.uint64) | np.uint64(b) << np.uint64(32)
            for b, h in zip(hits.column("bucket").to_pylist(), hits.column("hits").to_pylist(), strict=True)
        ]))
        values = chunk.blocks(hashes, block, buckets)
        spot = np.searchsorted(known, values)
        spot[spot == len(known)] = 0
        met = np.concatenate([[0], np.cumsum((known[spot] == values) & words.whole(block))])
        at = np.flatnonzero(words.whole(window))
        at = at[met[at + window - block + 1] > met[at]]
        one = words.runs(hashes, window)[at]
        two = (words.runs(hashes, window, second=True)[at] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((two, one))  # stable, so of equal windows the first place comes first
        new = np.ones(len(at), dtype=bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        first = np.zeros(len(at), dtype=bool)
        first[order[new]] = True
        part = (one % np.uint64(parts)).astype(np.int32)
        by_part = np.flatnonzero(first)
        by_part = by_part[np.argsort(part[by_part], kind="stable")]
        cuts = np.searchsorted(part[by_part], np.arange(parts + 1))
        later = at[~first].astype(np.uint32)
        for p in range(parts):
            own = by_part[cuts[p]:cuts[p + 1]]
            gone = later if p == number % parts else later[:0]
            if len(own) or len(gone):
                text = words.text[at[own]]
                blob = pack(one[own], chunk.ids[text], chunk.marks[text], two[own], np.diff(at[own], prepend=0).astype(np.uint32))
                for name, value in zip(schema.names, (p, number, blob, pack_sorted(gone)), strict=True):
                    out[name].append(value)
        return _rows(out, schema)

    return run, "part int, chunk int, first binary, later binary"


def _earlier(table: pa.Table) -> pa.Table:
    """Step 4: for each chunk the places of windows that start earlier in another chunk or in itself."""
    schema = pa.schema([("chunk", pa.int32()), ("places", pa.binary())])
    out: dict[str, list] = {n: [] for n in schema.names}
    chunks = table.column("chunk").to_pylist()
    read = [unpack(x.as_py(), "<u8", "<i8", "<i8", "<u4", "<u4") for x in table.column("first")]
    owner = np.repeat(np.arange(len(chunks)), [len(r[0]) for r in read])
    one, ids, marks, two = (np.concatenate([r[i] for r in read]) for i in range(4))
    order = np.lexsort((np.asarray(chunks)[owner], marks, ids, two, one))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    lost = np.zeros(len(order), dtype=bool)
    lost[order] = again
    for k, (chunk, later) in enumerate(zip(chunks, table.column("later").to_pylist(), strict=True)):
        places = np.cumsum(read[k][4], dtype=np.uint32)[lost[owner == k]]
        places = np.sort(np.concatenate([places, unpack_sorted(later)]))
        if len(places):
            out["chunk"].append(chunk)
            out["places"].append(pack_sorted(places))
    return _rows(out, schema)


def _finish(window: int, texts: bool):
    """Last step: words that no repeated window covers."""
    names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        chunk = Chunk(docs)
        words = chunk.words
        cover = np.zeros(len(words) + window + 1, dtype=np.int32)
        for blob in places.column("places").to_pylist():
            at = unpack_sorted(blob)
            cover[at] += 1
            cover[at + window] -= 1
        kept = np.cumsum(cover[:len(words)]) == 0
        out: dict[str, list] = {n: [] for n in names[1:]}
        for i in range(docs.num_rows):
            a, b = words.first[i], words.first[i + 1]
            own = kept[a:b]
            joined = b""
            if own.any():
                begin, end = words.start[a:b][own], words.end[a:b][own]
                low = begin[0]
                mask = np.zeros(end[-1] - low + 2, dtype=np.int8)
                mask[begin - low] += 1
                mask[end - low + 1] -= 1  # each kept word and the byte after it, which becomes the space
                raw = np.concatenate([words.data[low:end[-1]], np.zeros(1, dtype=np.uint8)])
                raw[end - low] = 32
                joined = raw[np.cumsum(mask)[:len(raw)] > 0].tobytes()[:-1]
            for name, value in zip(names[1:], (int(b - a), int(b - a - own.sum()), hashlib.sha256(joined).hexdigest(), joined), strict=False):
                out[name].append(value)
        columns = [chunk.table.column("id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                   pa.array(out["kept_sha256"], pa.string())]
        if texts:
            columns.append(pa.array([x.decode() for x in out["kept"]], pa.string()))
        return pa.Table.from_arrays(columns, names=names)

    return run, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW,
                   block: int = BLOCK, texts: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for every row; with ``texts`` also the kept words (``kept``)."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold an aligned block: window >= 2 * block - 1")
    size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    chunks = size // CHUNK_BYTES + 1
    buckets = size // 6 * 4 // BUCKET_BYTES + 1
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).withColumn(
        "chunk", F.pmod(F.xxhash64("id", "mark"), F.lit(chunks)).cast("int"))
    probes, kind = _probes(buckets, block)
    probes = rows.groupBy("chunk").applyInArrow(probes, kind)
    anchors = probes.groupBy("bucket").applyInArrow(_anchors, "chunk int, bucket int, hits binary")
    windows, kind = _windows(buckets, buckets, window, block)
    windows = rows.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(windows, kind)
    places = windows.groupBy("part").applyInArrow(_earlier, "chunk int, places binary")
    finish, kind = _finish(window, texts)
    return rows.groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(finish, kind)
