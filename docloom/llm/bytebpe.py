"""Byte-level BPE over a rank file, by overlapping chunks.

A text is cut into chunks of ``CHUNK`` characters that overlap by ``OVERLAP``, and chunks are pre-tokenised in
parallel.  The first chunk starts at a pre-token boundary; each other one starts anywhere, and joins where one of its
boundaries meets one of its predecessor's: from there on the pattern, which never looks back, gives the same
pre-tokens.  A boundary counts only where the pattern saw two characters beyond it.  Then pieces are encoded in
parallel, each chunk from its joint to the next, and their ids are put together in order.  Where two chunks do
not meet within the overlap (a piece longer than it), the text is pre-tokenised whole, so results never differ.

Texts of one chunk, nearly all, go from scan to ids without a shuffle.  Decoding concatenates raw bytes of ids.
Null texts count as empty; an empty text has no ids; rows of equal id and text are worked once and come back as often
as given; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 32_768, 512
CACHE = 400_000
SHORT, NEVER = 24, 1 << 62
_AHEAD = 2  # characters beyond a boundary that the pattern may look at (a contraction after an apostrophe)


class Encoder:
    """Ranks, the pattern, and the pieces met lately."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def ends(self, text: str) -> np.ndarray:
        """Where each pre-token of a text ends; they cover the text without a gap."""
        return np.array([m.end() for m in self.pattern.finditer(text)], dtype=np.int64)

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank, leftmost first, is joined until none has a rank."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        size = len(raw)
        if size <= SHORT:
            parts = [raw[i:i + 1] for i in range(size)]
            found = [ranks.get(raw[i:i + 2], NEVER) for i in range(size - 1)]
            while found and (least := min(found)) != NEVER:
                at = found.index(least)
                parts[at] += parts.pop(at + 1)
                del found[at]
                if at < len(found):
                    found[at] = ranks.get(parts[at] + parts[at + 1], NEVER)
                if at:
                    found[at - 1] = ranks.get(parts[at - 1] + parts[at], NEVER)
            return [ranks[p] for p in parts]
        after, before, stop = list(range(1, size + 1)), list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(ranks[raw[i:i + 2]], i, i + 2) for i in range(size - 1) if raw[i:i + 2] in ranks]
        heapq.heapify(heap)
        alive = [True] * size
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else size
            if j >= size or stop[j] != end:
                continue  # one of the two was joined meanwhile
            alive[j], after[i], stop[i] = False, after[j], end
            if after[i] < size:
                before[after[i]] = i
                if (r := ranks.get(raw[i:stop[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop[after[i]]))
            if before[i] >= 0 and (r := ranks.get(raw[before[i]:end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        return [ranks[raw[i:stop[i]]] for i in range(size) if alive[i]]

    def pieces(self, parts: list[str]) -> bytes:
        """Ids of pieces in a row, as little-endian unsigned 32-bit integers."""
        cache = self.cache
        try:
            return b"".join([cache[p] for p in parts])
        except KeyError:
            pass
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for part in parts:
            ids = cache.get(part)
            if ids is None:
                got = self.piece(part.encode())
                ids = struct.pack(f"<{len(got)}I", *got)
                if len(part) < 64:
                    cache[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return self.pieces(self.pattern.findall(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder of a rank file; read once."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def joints(chunks: list[tuple[int, np.ndarray]], length: int) -> list[int] | None:
    """Where each chunk (start, global ends of its sure pre-tokens) takes over; None where two do not meet."""
    out = [0]
    for (_, left), (start, right) in zip(chunks, chunks[1:], strict=False):
        left = left[left > out[-1]]
        meet = np.intersect1d(left, np.concatenate([[start], right]), assume_unique=True)
        if not len(meet):
            return None
        out.append(int(meet[0]))
    return [*out, length]


def _finish(code: Encoder, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(code.decode(ids)).hexdigest()


_OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_LISTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text",
                     chunk: int = CHUNK, overlap: int = OVERLAP, ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row; with ``ids`` also the raw ids (``ids``)."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    out = _OUT + ", ids binary" * ids
    names = [*_LISTS, *["ids"] * ids]

    def table(columns: list[pa.Array], found: list[tuple[int, str, str]], raw: list[bytes], more: list[str]) -> pa.RecordBatch:
        made = [pa.array([f[k] for f in found], pa.int64() if k == 0 else pa.string()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*columns, *made, *[pa.array(raw, pa.binary())] * ids], names=[*more, *names])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                raw = [code.encode(x.as_py()) for x in part.column(1)]
                yield table([part.column(0)], [_finish(code, x) for x in raw], raw, ["id"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boundaries of each chunk that are sure."""
        code = encoder(path, pattern)
        for batch in batches:
            blobs = []
            for start, text, last in zip(*(batch.column(k).to_pylist() for k in ("start", "part", "last")), strict=True):
                ends = code.ends(text)
                blobs.append((ends[(ends + _AHEAD <= len(text)) | last] + start).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("key", "n", "start")), pa.array(blobs, pa.binary())],
                                             names=["key", "n", "start", "ends"])

    def stitch(cuts: pa.Table) -> pa.Table:
        cuts = cuts.sort_by("start")
        starts = cuts.column("start").to_pylist()
        ends = [np.frombuffer(x.as_py(), dtype=np.int64) for x in cuts.column("ends")]
        at = joints(list(zip(starts, ends, strict=True)), cuts.column("n")[0].as_py())
        keys = [cuts.column("key")[0].as_py()] * len(starts)
        if at is None:
            return pa.table({"key": keys, "start": starts, "begin": [None] * len(starts), "stop": [None] * len(starts)}, schema=cut_schema)
        return pa.table({"key": keys, "start": starts, "begin": at[:-1], "stop": at[1:]}, schema=cut_schema)

    cut_schema = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            blobs = []
            for start, text, begin, stop in zip(*(batch.column(k).to_pylist() for k in ("start", "part", "begin", "stop")), strict=True):
                own = []
                for match in code.pattern.finditer(text, begin - start):
                    if match.start() + start >= stop:
                        break
                    own.append(match.group())
                blobs.append(code.pieces(own))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), pa.array(blobs, pa.binary())], names=["key", "start", "blob"])

    def join(parts: pa.Table) -> pa.Table:
        code = encoder(path, pattern)
        raw = b"".join(parts.sort_by("start").column("blob").to_pylist())
        return pa.Table.from_batches([table([pa.array([parts.column("key")[0].as_py()], pa.binary())], [_finish(code, raw)], [raw], ["key"])])

    whole = rows.where(F.length("text") <= chunk).mapInArrow(short, f"id {kind}, {out}")
    long = (
        rows.where(F.length("text") > chunk).withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        .withColumn("n", F.length("text").cast("long"))
    )
    parts = (
        long.select("key", "n", "text").dropDuplicates(["key"])
        .withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))))
        .selectExpr("key", "n", "start", f"substring(text, int(start) + 1, {chunk + overlap}) AS part",
                    f"start + {chunk + overlap} >= n AS last")
        .where(f"start = 0 OR start - {chunk} + {chunk + overlap} < n")  # the text's end is reached before
    )
    cuts = parts.mapInArrow(split, "key binary, n long, start long, ends binary").groupBy("key").applyInArrow(
        stitch, "key binary, start long, begin long, stop long")
    met = parts.join(cuts.where("begin IS NOT NULL"), ["key", "start"]).mapInArrow(pieces, "key binary, start long, blob binary")
    met = met.groupBy("key").applyInArrow(join, f"key binary, {out}")
    # A piece longer than the overlap: the document is pre-tokenised whole.
    odd = cuts.where("begin IS NULL").select("key").distinct()
    one = long.select("key", "text").dropDuplicates(["key"]).join(odd, "key", "left_semi")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, pattern)
        for batch in batches:
            for at in range(batch.num_rows):
                raw = code.encode(batch.column(1)[at].as_py())
                yield table([batch.column(0).slice(at, 1)], [_finish(code, raw)], [raw], ["key"])

    done = met.unionByName(one.mapInArrow(alone, f"key binary, {out}"))
    return whole.unionByName(long.select("id", "key").join(done, "key").drop("key"))
