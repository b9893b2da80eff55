import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import toxicity as T
from docloom.llm.queries import op9_factorization_machine

BIGGER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in op9_factorization_machine(spark, BIGGER).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIGGER}/labels.parquet").collect()}
    held = [(rows[i].score, rows[i].predicted, t) for i, t in labels.items() if rows[i].held_out]
    hits = sum(p and t for _, p, t in held)
    said, true = sum(p for _, p, _ in held), sum(t for *_, t in held)
    positive, negative = ([s for s, _, t in held if t == k] for k in (1, 0))
    area = np.mean([[(a > b) + 0.5 * (a == b) for b in negative] for a in positive])
    print("precision", hits / said, "recall", hits / true, "area", area, len(held))
    assert hits / said > 0.95 and hits / true > 0.85 and area > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values()) and len(rows) == 10000


def test_pairs_beat_a_linear_model():
    """Label 1 where both or neither of two terms is there: no weighted sum of the two tells that."""
    rng = np.random.default_rng(0)
    rows = [(int(a == b), [i for i, on in ((0, a), (1, b), (2, True)) if on], [1.0] * (1 + a + b)) for a, b in rng.integers(0, 2, (2000, 2)).tolist()]
    model = T.train(rows, np.arange(3), epochs=40)
    def right(m):
        x = [m.bias + m.weights[p].sum() + 0.5 * ((m.vectors[p].sum(axis=0) ** 2) - (m.vectors[p] ** 2).sum(axis=0)).sum() for _, p, _ in rows]
        return np.mean([(s > 0) == y for s, (y, _, _) in zip(x, rows, strict=True)])
    assert right(model) > 0.98 and right(T.train(rows, np.arange(3), factors=0, epochs=40)) < 0.8


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in [(1, None), (2, ""), (None, "x"), (4, "bad " * 50000), (4, "good")]],
                                 "doc_id long, text string, toxic int, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.score_documents(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(4, 1), (4, None), (None, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    got = T.score_documents(docs, odd).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    by_id = {(r.id, r.held_out) for r in got}
    assert by_id == {(i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i in (1, 2, None, 4)}
    assert T.score_documents(docs.limit(0), odd).collect() == []
    assert T.drop_toxic(docs, none).count() == 5


def test_labels_that_are_held_out_do_not_matter(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "if(crc32(encode(string(doc_id), 'UTF-8')) % 3 = 1, 1 - toxic, toxic) AS toxic")
    one, two = ({r.id: r.score for r in T.score_documents(docs, x).collect()} for x in (labels, other))
    assert one == two


def test_scores_equal_a_plain_scorer(spark, small):
    """Each pair of terms by itself, on terms that are made anew from the text."""
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    model = T.fit(docs, labels)
    at = {t: i for i, t in enumerate(model.terms.tolist())}

    def plain(text):
        words, counts = re.findall(r"\w+", (text or "").lower()), collections.Counter()
        for word in set(words):
            parts = [(word, 0)] + [(word[:n], n) for n in (3, 4, 5, 7) if len(word) >= n]
            counts.update(at[h] for h in (zlib.crc32(p.encode(), seed) for p, seed in parts) if h in at)
        size = zlib.crc32(b"words %d" % len(words).bit_length(), 99)
        counts |= {at[size]: 1} if size in at else {}
        terms = [(i, 1 + math.log2(n)) for i, n in sorted(counts.items())]
        margin = model.bias + sum(model.weights[i] * x for i, x in terms)
        for k, (i, x) in enumerate(terms):
            for j, y in terms[:k]:
                margin += float(model.vectors[i] @ model.vectors[j]) * x * y
        return 1 / (1 + math.exp(-max(-30, min(30, margin))))

    got = {r.id: r.score for r in T.score_documents(docs, labels).collect()}
    for r in docs.limit(60).collect():
        assert abs(got[r.doc_id] - plain(r.text)) < 1e-9
    assert abs(model.score(None) - plain(None)) < 1e-9 and len(model.terms) > 50


def test_string_ids(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id")) for n in ("documents", "labels"))
    rows = T.score_documents(docs, labels).collect()
    assert {r.id for r in rows} == {r.doc_id for r in docs.collect()} and len({r.score for r in rows}) > 10
