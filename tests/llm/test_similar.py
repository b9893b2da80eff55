import numpy as np

from docloom.llm import similar as N
from docloom.llm import simhash as S


def groups(texts):
    """Smallest place of each group by brute force over all pairs."""
    marks = [S.simhash(t) for t in texts]
    sets = [N.shingles(t or "") for t in texts]
    name = list(range(len(texts)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (marks[i] ^ marks[j]).bit_count() <= 3 or (both and 5 * both >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    return [root(i) for i in range(len(texts))]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, mark string, fp int")


def test_edited_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8):
            other = list(words)
            for at in rng.integers(0, 150, edits):
                other[at] = f"new{rng.integers(0, 9999)}"
            texts.append(" ".join(other))
    texts += [None, "", "  ", "one two three", "ONE two  three", "one two four", "a b c d e", "a b c d f", "long " * 60000 + "end"]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    true = groups(texts)
    docs = frame(spark, texts)
    got = S.near_dedup(docs)
    assert got.columns == docs.columns and got.where("mark != 'x' OR fp != 1").count() == 0
    assert {r.doc_id for r in got.collect()} == {i for i, g in enumerate(true) if i == g}
    assert sum(i != g for i, g in enumerate(true)) > 80


def test_a_large_group_of_near_copies_is_one(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = []
    for k in range(2500):  # more than a tile; all share their bands or nearly
        own = list(base)
        own[rng.integers(0, 200)] = f"edit{k}"
        texts.append(" ".join(own))
    assert [r.doc_id for r in S.near_dedup(frame(spark, texts)).collect()] == [0]


def test_rows_of_one_id_are_judged_by_their_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text is here"), (2, "quite another text is here"), (None, "a b c d e f")],
                                 "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in S.near_dedup(docs).collect())
    assert got == [(0, "a b c d e f"), (1, "a b c d e f"), (2, "quite another text is here"), (2, "quite another text is here")]
    assert S.near_dedup(docs.limit(0)).collect() == []


def test_pairs_of_a_bucket():
    rng = np.random.default_rng(5)
    sketch = rng.integers(0, 256, (40, 120)).astype(np.uint8)
    sketch[20:] = sketch[0]
    pairs, more = N.bucket_pairs(sketch, None, set(), 4)
    assert len(pairs) == 20 and all(sure for *_, sure in pairs) and not more
    sketch[:, :90] = sketch[0, :90]  # now all are in doubt with each other, but for the copies
    pairs, more = N.bucket_pairs(sketch, None, set(), 4)
    assert more and sum(sure for *_, sure in pairs) == 20 and all(sum(not s and i in p for *p, s in pairs) >= 4 for i in range(20))
    labels, asked, seen = np.array([*range(20), *[0] * 20]), {(i, j) for i, j, sure in pairs if not sure}, set()
    for most in (32, 256):
        later, more = N.bucket_pairs(sketch, labels, asked, most)
        assert not asked & {(i, j) for i, j, _ in later}
        asked |= {(i, j) for i, j, _ in later}
    assert not more and len(asked) == 19 * 18 // 2 + 19 * 21  # every pair of two labels, once


def family(rng, size, words, edits):
    """Texts that differ from one base in ``edits`` places each, so that pairs lie around the threshold."""
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for k in range(size):
        own = list(base)
        for at in rng.choice(words, edits, replace=False):
            own[at] = f"new{k}x{at}"
        out.append(" ".join(own))
    return out


def test_large_families_near_the_threshold(spark):
    rng = np.random.default_rng(6)
    texts = family(rng, 200, 180, 2) + family(rng, 60, 150, 2)
    # Of two unlike texts with one fingerprint, neither stands for the other's partners.
    sets = [N.shingles(t) for t in texts]
    near = [len(a & b) / len(a | b) for i, a in enumerate(sets[:200]) for b in sets[:i]]
    assert min(near) < 0.8 < max(near) and 0.02 < np.mean(np.array(near) >= 0.8) < 0.9
    true = groups(texts)
    got = {r.doc_id for r in S.near_dedup(frame(spark, texts)).collect()}
    assert got == {i for i, g in enumerate(true) if i == g}


def test_unlike_texts_of_one_fingerprint(spark):
    """One shingle outweighs the rest, so the fingerprint is that of the repeated part, whatever else the text holds."""
    rng = np.random.default_rng(7)
    tails = [[f"t{k}x{x}" for x in rng.integers(0, 5000, 60)] for k in range(3)]
    heavy = ["same"] * 90
    texts = [" ".join(heavy + tail) for tail in tails]
    assert len({S.simhash(t) for t in texts}) == 1
    texts += [" ".join(["other"] + tail[:58] + ["end"]) for tail in tails] + [" ".join(heavy[:5] + tail) for tail in tails]
    true = groups(texts)
    assert {r.doc_id for r in S.near_dedup(frame(spark, texts)).collect()} == {i for i, g in enumerate(true) if i == g}


def test_all_documents(spark, small):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    true = groups([t for _, t in rows])
    got = {r.doc_id for r in S.near_dedup(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert got == {rows[i][0] for i, g in enumerate(true) if i == g}


def test_a_pair_in_doubt_is_asked_in_one_band(spark):
    rng = np.random.default_rng(8)
    texts = family(rng, 60, 180, 2)
    rows = spark.createDataFrame(list(enumerate(texts)), "mark long, text string")
    items = N.signatures(rows).localCheckpoint()
    asked = [(r.a, r.b) for r in N.candidates(N.buckets(items), 1000).where("NOT sure").collect()]
    assert len(asked) == len(set(asked)) > 100
    keys = {r.mark: r["keys"] for r in items.collect()}
    sketch = {r.mark: np.frombuffer(r.sketch, dtype=np.uint8) for r in items.collect()}
    met = {(a, b) for a in keys for b in keys if a < b and set(keys[a]) & set(keys[b])}
    share = {(a, b): ((sketch[a] == sketch[b]).mean() - 1 / 256) / (1 - 1 / 256) for a, b in met}
    assert {p for p in met if N.DOUBT <= share[p] < N.SURE} - set(asked) == set()
