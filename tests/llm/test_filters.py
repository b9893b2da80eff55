from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from docloom.llm import filters as A
from docloom.session import ensure_checkpoint_dir


def failures(docs):
    """The filters that each row (id, text, part) fails, as letters."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = []
    for i, text, _ in docs:
        text = text or ""
        words = text.encode().split()
        out.append("".join(letter for letter, fails in [
            ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)), ("D", any(c in "#$%&*|" for c in text)),
            ("E", i is not None and i > least[text])] if fails))
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails, counts, parts = failures(docs), Counter(), {p or "" for _, _, p in docs}
    for order in map("".join, permutations("ABCDE")):
        for step, letter in enumerate(order, 1):
            for (i, _, part), f in zip(docs, fails, strict=True):
                key, gone = (part or "", order, step), any(x in f for x in order[:step - 1])
                counts[key, "kept"] += not gone and letter not in f
                counts[key, "removed"] += not gone and letter in f
                counts[key, "redundant"] += gone and letter in f
                counts[key, "unique_fails"] += f == letter
                counts[key, "good_lost"] += not gone and letter in f and i in good
                counts[key, "toxic_lost"] += not gone and letter in f and i in toxic
    shapley = Counter()
    for (part, order, step), name in list(counts):
        if name == "removed":
            shapley[part, order[step - 1]] += counts[(part, order, step), name]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s, *(counts[(p, o, s), n] for n in names), shapley[p, o[s - 1]])
            for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6)}


WORDS = " ".join(f"w{k}" for k in range(120))


def rows():
    texts = [None, "", " \n\t", WORDS, WORDS + " #", "A B C " + WORDS, "ABCDEFGH", "a " * 200, WORDS.upper(), "x\x1cy " * 110, "é" * 5 + "Z", "ÄÖÜ 100% | *"]
    docs = [(i, t, p) for i, (t, p) in enumerate((t, p) for t in texts for p in ("en", "de", None, ""))]
    docs += [(None, WORDS, "en"), (None, WORDS, "en"), (None, "", "fr"), (3, None, "en"), (3, None, "en"), (500, WORDS, "de"), (500, WORDS, "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(500, None, 1), (500, 1, None), (500, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, [(i, q, None if t is None else int(t)) for i, q, t in labels]


def test_audit(spark):
    docs, labels = rows()
    table = spark.createDataFrame([(*d, "mark", 7) for d in docs], "doc_id long, text string, lang string, mark string, words int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in A.audit(A.doc_facts(table), marks).collect()} == brute(docs, labels)
    none = table.where("false")
    assert A.audit(A.doc_facts(none), marks).count() == 0
    without = A.audit(A.doc_facts(table), marks.where("false"))
    assert {tuple(r) for r in without.collect()} == brute(docs, [])


def test_matrix_is_the_texts(spark, monkeypatch):
    """Small shards: terms are one id for one word over all shards, counts are those of the texts."""
    texts = [f"the {k} and the {k % 7} of word{k % 50} " * (k % 4) for k in range(300)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    local = A.shards(docs, "text", ["id"], most=500)
    assert local.count() > 10 and local.select("shard").distinct().count() == local.count()
    monkeypatch.setattr(A.shards, "__defaults__", (500,))
    word_of = {}
    for r in A.terms(A.shards(docs.orderBy("id"), "text", ["id"], 500)).collect():
        assert word_of.setdefault(r.term, r.word) == r.word
    assert len(set(word_of.values())) == len(word_of) == len({w for t in texts if t for w in t.split()})
    seen = {}
    for r in A.matrix(docs, "text", ["id"]).collect():
        starts = np.array(r.starts)
        assert len(starts) == len(r.id) + 1 and starts[-1] == len(r.terms) == len(r.counts)
        for at, i in enumerate(r.id):
            cells = slice(starts[at], starts[at + 1])
            seen[i] = Counter({word_of[t]: n for t, n in zip(r.terms[cells], r.counts[cells], strict=True)})
    assert seen == {i: Counter((t or "").split()) for i, t in enumerate(texts)}


def test_rows_and_row_groups_are_small(spark, monkeypatch):
    """A task's share of the texts is many small rows in many row groups; a book still names a word once."""
    monkeypatch.setattr(A, "GROUP_BYTES", 1 << 20)
    texts = [" ".join(f"w{w}" for w in crew) for crew in np.random.default_rng(1).integers(0, 5000, (6000, 400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    rows = A.shards(docs, "text", ["id"]).select("book", "shard", "id", "words", "first", F.size("steps").alias("cells")).collect()
    assert sorted(i for r in rows for i in r.id) == list(range(6000)) and len({r.shard for r in rows}) == len(rows)
    assert max(r.cells for r in rows) <= 100_000 < sum(r.cells for r in rows)
    assert max(len(w) for w in (r.words for r in rows)) <= 5000 and len(rows) >= 40
    for book in {r.book for r in rows}:
        words = [w for r in sorted(rows, key=lambda r: r.shard) if r.book == book for w in r.words]
        assert len(words) == len(set(words)) == 5000
    before = set(_written(spark))
    A.matrix(docs, "text", ["id"])
    groups = [g for f in set(_written(spark)) - before for g in _groups(f)]
    assert sum(rows for rows, _ in groups) == len(rows) and max(rows for rows, _ in groups) <= len(rows) // 2
    assert max(size for _, size in groups) <= 2 * A.GROUP_BYTES


def _written(spark):
    return Path(ensure_checkpoint_dir(spark).removeprefix("file:")).rglob("docloom-matrix-*/*.parquet")


def _groups(path):
    found = pq.ParquetFile(path).metadata
    return [(found.row_group(k).num_rows, found.row_group(k).total_byte_size) for k in range(found.num_row_groups)]


def test_one_large_text(spark):
    text = " ".join(f"v{k % 90_000}" for k in range(300_000))
    docs = spark.createDataFrame([(1, text, "en"), (2, "a b", "en")], "doc_id long, text string, lang string")
    assert {(r.id, r.fails) for r in A.doc_facts(docs).collect()} == {(1, 2), (2, 1)}
