import collections

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash as S
from docloom.llm.queries import op8_simhash_near_dedup


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(marks):
    """{id: least id} by comparing all distinct fingerprints."""
    distinct = sorted({m for _, m in marks})
    parent = {m: m for m in distinct}

    def root(m):
        while parent[m] != m:
            m = parent[m]
        return m

    array = np.array(distinct, dtype=np.uint64)
    for i, m in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3):
            parent[root(distinct[j])] = root(m)
    least = collections.defaultdict(lambda: 1 << 62)
    for i, m in marks:
        if i is not None:
            least[root(m)] = min(least[root(m)], i)
    return {i: least[root(m)] for i, m in marks if i is not None}


def test_query_equals_brute_force(spark, small):
    rows = op8_simhash_near_dedup(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    marks = [(i, plain(t)) for i, t in texts.items()]
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{m:016x}" for i, m in marks}
    assert {r.doc_id: r.component_id for r in rows} == plain_groups(marks)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (4, "one TWO"), (None, "a b c d"), (7, "é" * 30 + " x" * 90000)]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = collections.Counter((r.id, r.fp % (1 << 64), r.component_id) for r in S.simhash_groups(docs).collect())
    assert got == collections.Counter([(1, 0, 1), (2, 0, 1), (3, 0, 1), (4, plain("one two"), 4), (4, plain("one two"), 4),
                                       (None, plain("a b c d"), None), (7, plain(rows[-1][1]), 7)])
    assert sorted(str(r.doc_id) for r in S.near_dedup(docs).collect()) == ["1", "4", "4", "7", "None"]
    assert S.simhash_groups(docs.limit(0)).collect() == []


def test_all_close_pairs_are_found_and_hot_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 64)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = []
    for k, b in enumerate(base):
        for bit in rng.choice(64, 1 + k % 4, replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        near.append(b)
    hot = base[0] ^ rng.integers(0, 1 << 9, 400, dtype=np.uint64)
    marks = [(i, int(m)) for i, m in enumerate([*base, *near, *hot])]
    table = spark.createDataFrame([(i, m - (1 << 64) if m >> 63 else m) for i, m in marks], "id long, fp long")
    group = {r.node % (1 << 64): r.component for r in S.near_fingerprints(table).collect()}
    least = {}
    for i, m in marks:
        g = group.get(m, m)
        least[g] = min(least.get(g, i), i)
    assert {i: least[group.get(m, m)] for i, m in marks} == plain_groups(marks)


@pytest.mark.parametrize("seed", range(3))
def test_every_pair_within_three_bits_has_a_chain(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64)
    found = np.zeros(5000, dtype=bool)
    for start in range(16):
        found |= S._chained(a, b, np.full(5000, start))
    assert found.all()
