import hashlib
import re

import pytest

from docloom.llm import repeats as R


def plain(rows, window=20):
    """{row number: (words, removed, digest)} by a dictionary of all windows in document order."""
    order = sorted(range(len(rows)), key=lambda i: (-(1 << 63) if rows[i][0] is None else rows[i][0]))
    seen, out = set(), {}
    for i in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[i][1] or "")
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            if key in seen:
                gone[at:at + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (rows[i][0], len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_query_table_equals_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_BYTES", 1 << 16)
    monkeypatch.setattr(R, "BUCKET_BYTES", 1 << 15)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in R.remove_repeats(docs).collect())
    assert got == sorted(plain(rows).values())
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def test_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, line), (4, line), (5, "x " + line + "\n" + line), (None, "n " + line[4:]),
            (7, "a " * 50), (8, "é\x85ü " * 40), (9, " ".join(line.split()[:19])), (10, "y" * (3 << 20) + " " + line)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_words int, chunk string")
    got = {r.id: tuple(r) for r in R.remove_repeats(docs).collect()}
    assert got == {v[0]: v for v in plain(rows).values()}
    assert R.remove_repeats(docs.limit(0)).collect() == []
    kept = {r.id: r.kept for r in R.remove_repeats(docs, texts=True).collect()}
    assert kept[4] == "" and hashlib.sha256(kept[5].encode()).hexdigest() == got[5][3]


def test_repeated_rows_keep_one(spark):
    text = " ".join(map(str, range(25)))
    docs = spark.createDataFrame([(1, text)] * 3 + [(1, text + " end")], "doc_id long, text string")
    assert sorted(r.n_removed for r in R.remove_repeats(docs).collect()) in ([0, 25, 25, 25], [1, 25, 25, 25], [0, 25, 25, 26])


def test_window_must_hold_a_block(spark):
    with pytest.raises(ValueError):
        R.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), window=10)
