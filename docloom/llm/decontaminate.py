"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Items are partitioned by their number of shingles.  An item's signature is its bottom-k MinHash sketch, and the
partition sets k = s - ceil(t * s) + 1: a document that holds the share t of s shingles must hold one of the k
smallest, so no document is missed, however long it is and however small its Jaccard similarity.  A document's
side of the sketch is the set of its shingle hashes among all signatures.  Candidates are then verified on the
shingles' texts.

Items come in blocks of about ``BLOCK_ROWS``, so what a task holds is bounded; each block is one pass over
all documents without a shuffle.  More items mean more passes, never larger ones.

Text is compared in lower case (A-Z) with ASCII punctuation as white space, in shingles of five words; an item of
fewer words is one shingle of all its words, and one without words matches nothing.  Null and empty texts match
nothing, repeated rows come back as often as they came, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import free_name
from docloom.llm.wordhash import word_batches

SIZE, SHARE, BLOCK_ROWS = 5, 0.8, 20_000
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Bytes to the bytes that are compared: lower case, and a space for punctuation and other white space.
TABLE = bytes(32 if c in _PUNCTUATION or c in b"\t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str, size: int = SIZE) -> set[bytes]:
    """The distinct shingles of a text."""
    words = text.encode().translate(TABLE).split()
    return {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def needed(count: int, share: float = SHARE) -> int:
    """How many of ``count`` shingles make the share; whole-number arithmetic in thousandths."""
    return -(-count * round(share * 1000) // 1000)


class Items:
    """A block of test items: hashes of all their shingles, and signatures by size partition."""

    def __init__(self, items: list[tuple], share: float = SHARE):
        self.sets = [shingles(text or "") for _, text in items]
        self.ids = [i for i, _ in items]
        self.need = [needed(len(s), share) for s in self.sets]
        marks, owners = {}, {}
        for at, parts in enumerate(self.sets):
            length = SIZE if len(parts) != 1 else len(next(iter(parts)).split())
            hashes = np.sort(shingle_hashes(parts, length)) if parts else np.zeros(0, dtype=np.uint64)
            keep = hashes[:len(hashes) - self.need[at] + 1] if parts else hashes
            marks.setdefault(length, []).append(keep)
            owners.setdefault(length, []).append(np.full(len(keep), at))
        self.by_length = {}
        for length in marks:
            mark, owner = np.concatenate(marks[length]), np.concatenate(owners[length])
            order = np.argsort(mark, kind="stable")
            self.by_length[length] = (mark[order], owner[order])


def shingle_hashes(parts: set[bytes], length: int) -> np.ndarray:
    """Hashes of shingles of ``length`` words as the scan of the documents makes them."""
    column = pa.array([p.decode("utf-8", "surrogateescape") for p in parts], pa.large_string())
    out = [w.runs(w.hashes(), length)[w.first[:-1]] for _, w in word_batches([pa.RecordBatch.from_arrays([column], ["t"])], "t")]
    return np.concatenate(out)


def search(docs: DataFrame, items: list[tuple], item_type: str, share: float = SHARE) -> DataFrame:
    """(id, item, hits, containment) of the verified pairs of all ``docs`` (id, text) with one block of items."""
    block = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(block.value, share)
        for batch, words in word_batches(batches, "text", table=TABLE):
            hashes, pairs = words.hashes(), set()
            for length, (mark, owner) in known.by_length.items():
                if not len(mark):
                    continue
                runs = words.runs(hashes, length)
                spot = np.searchsorted(mark, runs)
                spot[spot == len(mark)] = 0
                for at in np.flatnonzero((mark[spot] == runs) & words.whole(length)):
                    first = spot[at]
                    while first < len(mark) and mark[first] == runs[at]:
                        pairs.add((int(words.text[at]), int(owner[first])))
                        first += 1
            out = {name: [] for name in ("row", "item", "hits", "containment")}
            held = None
            for row, at in sorted(pairs):
                if held != row:
                    held, text = row, batch.column(1)[row].as_py()
                    sets = {}
                length = len(next(iter(known.sets[at])).split())
                if length not in sets:
                    sets[length] = shingles(text, length)
                hits = len(known.sets[at] & sets[length])
                if hits >= known.need[at]:
                    for name, value in zip(out, (row, known.ids[at], hits, hits / len(known.sets[at])), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["item"], item_arrow),
                 pa.array(out["hits"], pa.int64()), pa.array(out["containment"], pa.float64())],
                names=["id", "item", "hits", "containment"],
            )

    item_arrow = pa.int64() if item_type in ("bigint", "int", "smallint") else pa.string()
    return docs.mapInArrow(run, f"id {kind}, item {'long' if item_arrow == pa.int64() else 'string'}, hits long, containment double")


def contained_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    item_id: str = "item_id", item_text: str = "text", share: float = SHARE,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, item, hits, containment) for every document that holds at least ``share`` of an item's shingles."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    tests = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    blocks = max(1, -(-tests.count() // block_rows))
    kind = tests.schema["item"].dataType.simpleString()
    found = None
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        part = search(texts, [tuple(r) for r in rows], kind, share)
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  share: float = SHARE) -> DataFrame:
    """Rows of ``docs`` that hold no item; rows with a null id are judged by their text like all others."""
    key = free_name(docs, "_key")
    keyed = docs.select(F.xxhash64(id_column, text_column).alias(key), text_column)
    hits = contained_items(keyed, items, key, text_column, share=share)
    gone = hits.select(F.col("id").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(id_column, text_column)).join(gone, key, "left_anti").select(*docs.columns)
