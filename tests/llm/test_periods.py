import hashlib
import random
import zlib
from fractions import Fraction

from docloom.llm import periods as P
from docloom.llm.queries import op13_periodic_runs


def brute(words):
    """Runs by all periods and starts."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        start = 0
        while start < n - q:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > start and end + q - start >= max(6, 4 * q):
                found.setdefault((start, end + q - start), q)
            start = end + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = best[1] * 1000 // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_random_words():
    random.seed(3)
    for turn in range(3000):
        letters = random.choice([b"ab", b"abc", b"abcdefgh"])
        words = [bytes([random.choice(letters)]) for _ in range(random.randrange(60))]
        if turn % 3 == 0 and words:
            unit = words[:random.randrange(1, 9)]
            words = words + unit * random.randrange(2, 9) + words[:3] + [b"a"] * random.randrange(9)
        assert P.runs(words) == brute(words), words


def test_runs_beside_and_within_each_other():
    inner = ["a"] * 7 + ["b"]
    words = [w.encode() for w in inner * 5 + ["x"] + ["a", "b"] * 4 + ["b"] * 6]
    found = P.runs(words)
    assert found == brute(words)
    assert len({q for _, _, q in found}) >= 3
    # length 24 by period 6 and length 8 by period 2 tie: the first one is the best.
    tie = [w.encode() for w in "p q r s t u".split() * 4 + ["|"] + ["m", "n"] * 4]
    assert [r[2] for r in P.runs(tie)] == [6, 2] and P.best_run(P.runs(tie)) == (0, 24, 6)


def test_long_texts():
    one = [b"w"] * 200_000
    assert P.runs(one) == [(0, 200_000, 1)] and P.collapsed(one, P.runs(one)) == b"w"
    random.seed(5)
    unit = [str(random.randrange(1000)).encode() for _ in range(5_000)]
    words = [b"start", *unit * 8, *unit[:17], b"end"]
    assert P.runs(words) == [(1, 8 * 5_000 + 17, 5_000)]
    boilerplate = [w for k in range(20_000) for w in (str(k).encode(), b"all", b"of", b"the", b"same", b"words")]
    assert P.runs(boilerplate) == []


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, small).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows == {i: expected(i, t) for i, t in texts.items()}
    assert sum(r[1] > 0 for r in rows.values()) > 5


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \t\n\x0b\x0c\r ", "a " * 6, "a b " * 8, "x\x1cy " * 9, "é " * 7 + "ß", "no run here at all", "no run here at all"]
    rows = [(i if i else None, t, "extra", 1) for i, t in enumerate(texts)] + [(30, "a b c d e f g h " * 5, "z", 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, id int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = [expected(i, t) if i is not None else (None, *expected(7, t)[1:]) for i, t, _, _ in rows]
    assert zlib.crc32(b"7") % 10  # so that its text isn't planted
    assert got == sorted(want, key=repr)
    none = docs.where("false")
    assert P.periodic_runs(P.with_planted_tails(none)).count() == 0
    named = P.periodic_runs(docs.selectExpr("concat('d', doc_id) AS doc_id", "text")).where("size(runs) > 0")
    assert {r.id for r in named.collect()} == {"d3", "d4", "d5", "d6", "d30"}
