from docloom.llm import decontaminate as D
from docloom.llm.queries import op6_containment_search


def plain(docs, items, share=0.8):
    found = set()
    for i, text in docs:
        for k, test in items:
            parts = D.shingles(test or "")
            size = len(next(iter(parts)).split()) if parts else 0
            hits = len(parts & D.shingles(text or "", size)) if parts else 0
            if parts and hits >= D.needed(len(parts), share):
                found.add((i, k, hits, hits / len(parts)))
    return found


def rows_of(spark, folder, name, key):
    return [(r[key], r.text) for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def test_query_equals_brute_force(spark, small):
    want = plain(rows_of(spark, small, "documents", "doc_id"), rows_of(spark, small, "benchmark", "item_id"))
    got = op6_containment_search(spark, small).collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)


def test_blocks_of_items_give_the_same_pairs(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "benchmark"))
    want = {tuple(r) for r in op6_containment_search(spark, small).collect()}
    assert {tuple(r) for r in D.contained_items(docs, items, block_rows=9).collect()} == want


def test_share_decides_at_the_limit(spark):
    words = [f"w{i}" for i in range(44)]  # 40 shingles
    def broken(n):  # each change of a word far from others breaks five shingles
        out = list(words)
        for k in range(n):
            out[2 + 10 * k + 2] = "other"
        return "before " + " ".join(out) + " after"
    docs = [(n, broken(n)) for n in range(4)]
    items = [(9, " ".join(words).upper().replace(" ", ", "))]
    got = D.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a b"), (4, "x a b c y"), (4, "x a b c y"), (None, "one TWO-three four five"), (7, "z " * 9000 + "a. B! c")]
    items = [(1, None), (2, ""), (3, "A b, c"), (None, "one two three four five"), (5, "a b c")]
    frame = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, hits int, item string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.contained_items(frame, tests).collect()), key=str)
    assert got == sorted([(i, k, 1, 1.0) for i in (4, 4, 7) for k in (3, 5)] + [(None, None, 1, 1.0)], key=str)
    assert D.contained_items(frame.limit(0), tests).collect() == []
    assert D.contained_items(frame, tests.limit(0)).collect() == []
    kept = D.decontaminate(frame, tests)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
