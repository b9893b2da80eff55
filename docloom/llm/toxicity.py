"""Toxicity by a factorization machine over hashed terms.

Terms are a text's lower-case words, their prefixes of a few lengths, and the magnitude of the number of words; each
is hashed to 32 bits.  A term's value grows with the logarithm of how many distinct words have it.  The machine
learns a weight for each term and, through vectors of ``FACTORS`` numbers, one for each pair of terms, such as an insult
with the mention of a group, or a doubtful prefix with a short text; a linear model of the terms misses those.

It is fitted on at most ``FIT_ROWS`` labelled rows (those of the least id hashes), which is the only bound: term
statistics and training cover that sample, and scoring covers every whole text.  The model holds ``MAX_TERMS`` terms
at most, those that tell the classes apart best, so what is sent to the tasks is bounded too.

Labels are used only for fitting; a score depends on the text alone.  Null texts score like empty ones.  Of several
label rows of one id any toxic one counts, null labels count for nothing, and repeated documents are scored each.  Ids
may be numbers or strings.
Without labelled rows of both classes every score is the smoothed share of toxic rows (0.5 where there are none).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import shared_table

FIT_ROWS, MAX_TERMS, FACTORS, THRESHOLD = 20_000, 1 << 15, 4, 0.7
PREFIXES = (3, 4, 5, 7)
_LEAST_CHI, _LEAST_ROWS = 8.0, 3
_WORD = re.compile(r"\w+")


def term_hashes(word: str) -> list[int]:
    """Hashes of a word's terms."""
    out = [zlib.crc32(word.encode())]
    for size in PREFIXES:
        if len(word) >= size:
            out.append(zlib.crc32(word[:size].encode(), size))
    return out


def length_hash(words: int) -> int:
    return zlib.crc32(b"words %d" % words.bit_length(), 99)


@dataclass
class Model:
    """Sorted term hashes, their weights and vectors."""

    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float
    known: dict = field(default_factory=dict, repr=False)
    places: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}, "places": {}}

    def features(self, text: str | None) -> tuple[list[int], list[float]]:
        """Places and values of the terms of a text that the model holds."""
        if not self.places:
            self.places = {t: i for i, t in enumerate(self.terms.tolist())}
        if len(self.known) > 500_000:
            self.known.clear()
        words = _WORD.findall((text or "").lower())
        counts: Counter = Counter()
        for word in set(words):
            held = self.known.get(word)
            if held is None:
                held = tuple(p for p in map(self.places.get, term_hashes(word)) if p is not None)
                self.known[word] = held
            if held:
                counts.update(held)
        size = self.places.get(length_hash(len(words)))
        if size is not None:
            counts[size] = 1
        places = sorted(counts)
        return places, [1.0 + float(np.log2(counts[p])) if counts[p] > 1 else 1.0 for p in places]

    def score(self, text: str | None) -> float:
        places, values = self.features(text)
        x = np.array(values)
        v = self.vectors[places] * x[:, None]
        margin = self.bias + float(self.weights[places] @ x) + 0.5 * float((v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -30.0, 30.0))))


def train(rows: list[tuple[int, list[int], list[float]]], terms: np.ndarray, factors: int = FACTORS, epochs: int = 25,
          rate: float = 0.15, decay: float = 2e-4, batch: int = 128, seed: int = 11) -> Model:
    """Fit (label, places, values) rows by AdaGrad on the logistic loss; the same rows give the same model."""
    rng = np.random.default_rng(seed)
    label = np.array([r[0] for r in rows], dtype=float)
    share = (label.sum() + 0.5) / (len(label) + 1.0)
    model = Model(terms, np.zeros(len(terms)), np.zeros((len(terms), factors)), float(np.log(share / (1 - share))))
    if not len(rows) or label.min() == label.max() or not len(terms):
        return model
    model.vectors = rng.normal(0.0, 0.05, (len(terms), factors))
    w, v, square_w, square_v, square_b = model.weights, model.vectors, np.full(len(terms), 1e-3), np.full((len(terms), factors), 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            sizes = np.array([len(rows[i][1]) for i in own])
            place = np.concatenate([np.asarray(rows[i][1], dtype=np.int64) for i in own])
            x = np.concatenate([np.asarray(rows[i][2], dtype=float) for i in own])
            row = np.repeat(np.arange(len(own)), sizes)
            vx = v[place] * x[:, None]
            total = np.zeros((len(own), factors))
            np.add.at(total, row, vx)
            square = np.bincount(row, (vx ** 2).sum(axis=1), len(own))
            margin = model.bias + np.bincount(row, w[place] * x, len(own)) + 0.5 * ((total ** 2).sum(axis=1) - square)
            slope = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - label[own]
            used, spot = np.unique(place, return_inverse=True)
            gw = np.bincount(spot, slope[row] * x, len(used)) / len(own) + decay * w[used]
            gv = np.zeros((len(used), factors))
            np.add.at(gv, spot, (slope[row] * x)[:, None] * (total[row] - vx))
            gv = gv / len(own) + decay * v[used]
            square_w[used] += gw ** 2
            square_v[used] += gv ** 2
            w[used] -= rate * gw / np.sqrt(square_w[used])
            v[used] -= 0.3 * rate * gv / np.sqrt(square_v[used])
            gb = slope.mean()
            square_b += gb ** 2
            model.bias -= rate * gb / np.sqrt(square_b)
    return model


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, rows, toxic rows) of each batch; summed over all batches afterwards."""
    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        terms, toxic = [], []
        for text, label in zip(texts, labels, strict=True):
            words = _WORD.findall((text or "").lower())
            own = {h for word in set(words) for h in term_hashes(word)} | {length_hash(len(words))}
            terms.append(np.fromiter(own, dtype=np.int64, count=len(own)))
            toxic.append(np.full(len(own), label, dtype=np.int64))
        found, spot = np.unique(np.concatenate([np.zeros(0, np.int64), *terms]), return_inverse=True)
        hits = np.bincount(spot, np.concatenate([np.zeros(0, np.int64), *toxic]), len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(spot, minlength=len(found)).astype(np.int64)), pa.array(hits)],
                                         names=["term", "n", "hits"])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
        fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled rows that are not held out; ``fit_rows`` bounds the rows it is fitted on."""
    sample = (
        labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).where(~held_out(id_column))
        .groupBy(F.col(id_column).alias("_id")).agg(F.max(label_column).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    )
    # What orders the sample: the id where it is a whole number, else a hash of it.
    order = F.col("_id").cast("long") if isinstance(docs.schema[id_column].dataType, T.IntegralType) else F.xxhash64("_id")
    # The sample has fit_rows rows of two numbers at most, whatever the tables hold.
    rows = (
        docs.select(F.col(id_column).alias("_doc"), F.col(text_column).alias("text"))
        .join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
        .select("text", F.col("_label").alias("label"), order.alias("id"))
    )
    rows = shared_table(rows, "labelled")
    size = rows.agg(F.count("*"), F.sum("label")).first()
    n, hits = size[0], size[1] or 0
    if not 0 < hits < n:
        return train([(int(hits > 0), [], [])] * n, np.zeros(0, dtype=np.int64)) if n else Model(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), 0.0)
    counts = rows.select("text", "label").mapInArrow(_term_counts, "term long, n long, hits long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    expected = F.col("n") * F.lit(hits / n)
    chi = (F.col("hits") - expected) ** 2 / expected * F.lit(n / (n - hits))
    best = counts.where(F.col("n") >= _LEAST_ROWS).withColumn("chi", chi).where(F.col("chi") >= _LEAST_CHI).orderBy(F.desc("chi"), "term").limit(MAX_TERMS)
    terms = np.array(sorted({r.term for r in best.select("term").collect()} | {length_hash((1 << k) - 1 if k else 0) for k in range(24)}), dtype=np.int64)
    held = docs.sparkSession.sparkContext.broadcast(Model(terms, np.zeros(len(terms)), np.zeros((len(terms), FACTORS)), 0.0))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.features(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([np.array(f[0], dtype="<i4").tobytes() for f in found], pa.binary()),
                 pa.array([np.array(f[1], dtype="<f4").tobytes() for f in found], pa.binary())],
                names=["label", "id", "places", "values"])

    made = rows.select("text", "label", "id").mapInArrow(features, "label int, id long, places binary, values binary").collect()
    made.sort(key=lambda r: (r.id, r.label, r.places, r["values"]))
    # Packed bytes: a row of the sample is a few hundred bytes in the driver.
    return train([(r.label, np.frombuffer(r.places, "<i4"), np.frombuffer(r["values"], "<f4")) for r in made], terms)


def held_out(id_column: str) -> Column:
    """Rows whose labels are never learnt: one of three, by the checksum of the id's digits."""
    return F.coalesce(F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def scorer(docs: DataFrame, model: Model):
    """A column function: text to the probability that it is toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([held.value.score(t) for t in part], dtype=float)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    label_column: str = "toxic", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    score = scorer(docs, fit(docs, labels, id_column, text_column, label_column, fit_rows))
    out = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), score(F.col(text_column)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
               label_column: str = "toxic", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows of ``docs`` that score below the threshold."""
    model = fit(docs, labels, id_column, text_column, label_column, fit_rows)
    return docs.where(scorer(docs, model)(F.col(text_column)) < threshold)
