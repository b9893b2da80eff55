"""Token ids as raw payload shards, with a minimal perfect hash index from document keys to shard offsets.

Three kinds of data lie in the store's folder, all written and read by Spark, so that any shared file system will do:
* ``payload``: one record for each shard: raw little-endian ids (16 bits where the vocabulary allows, else 32) of
  the documents in ascending id order, and the shard's first key, which names it;
* ``index``: one record for each bucket of keys: displacements, and by slot a 32-bit fingerprint, the shard's name,
  offset and length, and the ids of all documents before;
* ``directory``: shards in order with their first id number.

A key's bucket, displacement and slot are computed, so a lookup reads one slot; the stored fingerprint tells keys that
are not in the store, up to one in 2**32.  Keys are (id, occurrence), so repeated ids are kept apart, in the order of a
hash of their texts.  Null ids come first and are a key like others; null and empty texts hold the end id alone; an
empty table gives an empty store; other columns are ignored.  Rows of one id share a partition when shards are packed.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.shared import shared_path
from docloom.llm.wordhash import mix

SHARD_BYTES, BUCKET_KEYS, GROUP = 4 << 20, 4096, 4
CACHE = 1_500_000
NULL_ID = -(1 << 63)
_TAIL = ",.!?;:|&%$#"


class WordEncoder:
    """A tokenizer whose words never depend on others, so each distinct word is encoded once.

    A word is its core and the ASCII punctuation after a final letter or digit; both are met more often than it.
    Cores of letters alone are encoded many at a time and told apart by the tokens that end a word.  With ``special``,
    texts are cut at the special tokens first, which then have ids of their own as in the library; without, they are text.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.final = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        added = self.tokenizer.get_added_tokens_decoder().items() if special else []
        # No word has a line feed, so these are no words.
        self.marks = {"\n" + token.content: np.array([i], dtype=self.kind).tobytes() for i, token in added if token.special}
        self.cut = re.compile("(" + "|".join(re.escape(m[1:]) for m in self.marks) + ")") if self.marks else None
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, bytes] = {"": b"", **self.marks}
        self.parts: dict[str, bytes] = {"": b""}

    def _learn(self, parts: list[str]) -> None:
        plain = [p for p in parts if p.isalpha() and len(p) < 64]
        single = [p for p in parts if not p.isalpha() or len(p) >= 64]
        groups = [plain[at:at + 200] for at in range(0, len(plain), 200)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, dtype=self.kind)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(group):  # a letter whose lower case is more than a letter
                single.extend(group)
                continue
            raw, width = ids.tobytes(), self.kind.itemsize
            cuts = [0, *(ends * width).tolist()]
            self.parts.update(zip(group, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
        for at in range(0, len(single), 1000):
            some = single[at:at + 1000]
            for part, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.parts[part] = np.array(got.ids, dtype=self.kind).tobytes()

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Raw ids of each text, with the end id."""
        split = []
        for text in texts:
            for white in "\t\n\v\f\r":
                if white in text:
                    text = text.replace(white, " ")
            if self.cut is not None and self.cut.search(text):
                pieces = self.cut.split(text)
                split.append([w for k, piece in enumerate(pieces) for w in (["\n" + piece] if k % 2 else piece.split(" "))])
            else:
                split.append(text.split(" "))
        if len(self.words) + len(self.parts) > CACHE:
            self._forget()
        words, parts = self.words, self.parts
        new = {}
        for word in set().union(*split).difference(words):
            core = word.rstrip(_TAIL)
            last = core[-1:]
            if not (last if last.isascii() else unicodedata.normalize("NFC", last).lower()[-1:]).isalnum():
                core = word  # what ends the core in the tokenizer's form may run on into the punctuation
            new[word] = (core.lower() if core.isascii() else core, word[len(core):])
        self._learn(list({p for pair in new.values() for p in pair if p not in parts}))
        for word, (core, tail) in new.items():
            words[word] = parts[core] + parts[tail]
        last = np.array([end], dtype=self.kind).tobytes()
        return [b"".join(map(words.__getitem__, own)) + last for own in split]


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def word_encoder(path: str, special: bool = False) -> WordEncoder:
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = WordEncoder(path, special)
    return _ENCODERS[path, special]


def _pack(path: str, end: int, shard_bytes: int, special: bool):
    """Shard records from rows in ascending id order."""
    names = ["first_id", "first_nth", "ids", "nths", "sizes", "payload"]

    def record(rows: list[tuple[int, int, bytes]], width: int) -> pa.RecordBatch:
        ids, nths, blobs = zip(*rows, strict=True)
        sizes = [len(b) // width for b in blobs]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[0]], pa.int64()), pa.array([nths[0]], pa.int32()), pa.array([list(ids)], pa.list_(pa.int64())),
             pa.array([list(nths)], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(blobs)], pa.binary())],
            names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, rows, size, last, nth = word_encoder(path, special), [], 0, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for key, blob in zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist(), end), strict=True):
                    nth = nth + 1 if key == last else 0
                    last = key
                    rows.append((key, nth, blob))
                    size += len(blob)
                    if size >= shard_bytes:
                        yield record(rows, code.kind.itemsize)
                        rows, size = [], 0
        if rows:
            yield record(rows, code.kind.itemsize)

    return run


def key_hash(ids: np.ndarray, nths: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(np.int64).view(np.uint64)) + nths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def slot(hashes: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """Slots under displacements ``seeds``; arrays are broadcast against each other."""
    return (mix(hashes + seeds.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) % np.uint64(size)).astype(np.int64)


def displacements(hashes: np.ndarray) -> np.ndarray:
    """Hash and displace: one seed for each group of about ``GROUP`` keys, so that all keys have slots of their own."""
    size = len(hashes)
    groups = -(-size // GROUP)
    group = (hashes >> np.uint64(32)) % np.uint64(groups)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    seeds, free = np.zeros(groups, dtype=np.uint32), np.ones(size, dtype=bool)
    for at in np.argsort(-np.diff(bounds), kind="stable"):
        own = hashes[order[bounds[at]:bounds[at + 1]]]
        if not len(own):
            break
        first, step = 0, 32
        while True:
            tries = np.arange(first, first + step)
            spots = slot(own[None, :], tries[:, None], size)
            good = free[spots].all(axis=1)
            if len(own) > 1:
                ranked = np.sort(spots, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                pick = int(np.argmax(good))
                seeds[at] = first + pick
                free[spots[pick]] = False
                break
            first, step = first + step, min(4096, step * 2)
    return seeds


_INDEX = pa.schema([("bucket", pa.int32()), ("seeds", pa.binary()), ("marks", pa.binary()), ("entries", pa.binary())])
_ENTRY = np.dtype([("first_id", "<i8"), ("first_nth", "<i4"), ("offset", "<u4"), ("size", "<u4"), ("start", "<i8")])


def _build(keys: pa.Table) -> pa.Table:
    """The index record of one bucket."""
    read = {n: keys.column(n).to_numpy() for n in keys.column_names}
    hashes = key_hash(read["id"], read["nth"])
    seeds = displacements(hashes)
    group = (hashes >> np.uint64(32)) % np.uint64(len(seeds))
    spots = slot(hashes, seeds[group.astype(np.int64)], len(hashes))
    marks, entries = np.zeros(len(hashes), dtype="<u4"), np.zeros(len(hashes), dtype=_ENTRY)
    marks[spots] = hashes.astype(np.uint32)
    for name in _ENTRY.names:
        entries[name][spots] = read[name]
    return pa.table({"bucket": keys.column("bucket").slice(0, 1), "seeds": [seeds.tobytes()], "marks": [marks.tobytes()],
                     "entries": [entries.tobytes()]}, schema=_INDEX)


def find(ids: np.ndarray, nths: np.ndarray, seeds: bytes, marks: bytes, entries: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which keys a bucket's record holds, and the entries of those."""
    seed, mark, entry = np.frombuffer(seeds, "<u4"), np.frombuffer(marks, "<u4"), np.frombuffer(entries, _ENTRY)
    hashes = key_hash(ids, nths)
    group = ((hashes >> np.uint64(32)) % np.uint64(len(seed))).astype(np.int64)
    spots = slot(hashes, seed[group], len(mark))
    held = mark[spots] == hashes.astype(np.uint32)
    return held, entry[spots[held]]


_FOUND = "id long, nth int, first_id long, first_nth int, offset long, size long, start long"
_FOUND_SCHEMA = pa.schema([(n, pa.int32() if n.endswith("nth") else pa.int64()) for n in ("id", "nth", "first_id", "first_nth", "offset", "size", "start")])


def _find(keys: pa.Table, index: pa.Table) -> pa.Table:
    if not keys.num_rows or not index.num_rows:
        return _FOUND_SCHEMA.empty_table()
    ids, nths = keys.column("id").to_numpy(), keys.column("nth").to_numpy()
    held, entries = find(ids, nths, *(index.column(n)[0].as_py() for n in ("seeds", "marks", "entries")))
    columns = [ids[held], nths[held], *(entries[n] for n in ("first_id", "first_nth", "offset", "size", "start"))]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((c.astype(np.int64) for c in columns), _FOUND_SCHEMA, strict=True)], schema=_FOUND_SCHEMA)


def _bucketed(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("id", "nth"), F.lit(buckets)).cast("int"))


def write_store(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, id_column: str = "doc_id",
                text_column: str = "text", shard_bytes: int = SHARD_BYTES, special: bool = False) -> None:
    """Encode all documents and write payload, directory and index below ``folder``."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    (
        rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
        .mapInArrow(_pack(tokenizer, end, shard_bytes, special),
                    "first_id long, first_nth int, ids array<bigint>, nths array<int>, sizes array<int>, payload binary")
        .write.option("compression", "zstd").parquet(f"{folder}/payload")
    )
    shards = spark.read.parquet(f"{folder}/payload").drop("payload")
    total = F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")
    order = Window.orderBy("first_id", "first_nth")  # one small row for each shard of many documents
    (
        shards.select("first_id", "first_nth", F.size("ids").cast("long").alias("keys"), total.alias("total"))
        .withColumn("start", F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total"))
        .withColumn("shard", F.row_number().over(order) - 1)
        .write.parquet(f"{folder}/directory")
    )
    directory = spark.read.parquet(f"{folder}/directory")
    buckets = (directory.agg(F.sum("keys")).first()[0] or 0) // BUCKET_KEYS + 1
    placed = shards.join(directory.select("first_id", "first_nth", F.col("start").alias("shard_start")), ["first_id", "first_nth"])
    offsets = _offsets(placed)
    (
        _bucketed(offsets, buckets).groupBy("bucket")
        .applyInArrow(_build, "bucket int, seeds binary, marks binary, entries binary").write.parquet(f"{folder}/index")
    )


def _offsets(shards: DataFrame) -> DataFrame:
    """A row for each key of each shard: offset and length in the shard, and the ids of all documents before."""
    schema = pa.schema([("id", pa.int64()), ("nth", pa.int32()), ("first_id", pa.int64()), ("first_nth", pa.int32()),
                        ("offset", pa.int64()), ("size", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                offset = np.cumsum(sizes) - sizes
                same = np.ones(len(sizes), dtype=np.int64)
                columns = (row["ids"], row["nths"], same * row["first_id"], same * row["first_nth"], offset, sizes, offset + row["shard_start"])
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return shards.mapInArrow(run, "id long, nth int, first_id long, first_nth int, offset long, size long, start long")


def lookup(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Where the keys (id, nth) of ``keys`` lie: shard, offset, length and start; keys not held are left out."""
    index = spark.read.parquet(f"{folder}/index")
    buckets = (spark.read.parquet(f"{folder}/directory").agg(F.sum("keys")).first()[0] or 0) // BUCKET_KEYS + 1
    ready = _bucketed(keys.select(F.coalesce(F.col("id"), F.lit(NULL_ID)).alias("id"), F.col("nth").cast("int").alias("nth")), buckets)
    return ready.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_find, _FOUND)


def read_store(spark: SparkSession, folder: str, keys: DataFrame, width: int = 2, ids: bool = False) -> DataFrame:
    """(id, nth, start, n_tokens, ids_crc32) for every key held, from the payload; with ``ids`` also the ids."""
    schema = pa.schema([("id", pa.int64()), ("nth", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                       + [("ids", pa.list_(pa.int64()))] * ids)

    def run(found: pa.Table, shards: pa.Table) -> pa.Table:
        if not found.num_rows or not shards.num_rows:
            return schema.empty_table()
        raw = np.frombuffer(shards.column("payload")[0].as_py(), dtype=f"<u{width}")
        parts = [raw[a:a + n] for a, n in zip(found.column("offset").to_pylist(), found.column("size").to_pylist(), strict=True)]
        columns = [found.column("id"), found.column("nth"), found.column("start"), found.column("size"),
                   pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())]
        if ids:
            columns.append(pa.array([p.tolist() for p in parts], schema.field("ids").type))
        return pa.Table.from_arrays(columns, schema=schema)

    payload = spark.read.parquet(f"{folder}/payload").select("first_id", "first_nth", "payload")
    shard = ["first_id", "first_nth"]
    kind = "id long, nth int, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * ids
    out = lookup(spark, folder, keys).groupBy(*shard).cogroup(payload.groupBy(*shard)).applyInArrow(run, kind)
    return out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))


def document_keys(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The keys (id, nth) of all rows; ids are counted ahead of the shuffle."""
    counts = docs.groupBy(F.col(id_column).cast("long").alias("id")).agg(F.count("*").alias("n"))
    return counts.select("id", F.explode(F.expr("sequence(0L, n - 1)")).alias("nth"))


def stored_ids(docs: DataFrame, tokenizer: str, end: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write a store to the shared folder and read every document back through its index."""
    folder = shared_path(docs.sparkSession, "idstore")
    write_store(docs, folder, tokenizer, end, id_column, text_column, special=True)
    return read_store(docs.sparkSession, folder, document_keys(docs, id_column), word_encoder(tokenizer).kind.itemsize)
