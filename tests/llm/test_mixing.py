import pytest

from docloom.llm import mixing as M


def waterfill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by giving out what is above the limits again and again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free and rest > 1e-9:
        total = sum(weight[n] for n in free)
        for n in free:
            target[n] += rest * weight[n] / total
        over = {n for n in free if target[n] >= most * sizes[n]}
        rest = sum(target[n] - most * sizes[n] for n in over)
        for n in over:
            target[n] = most * sizes[n]
        free -= over
    return target


def check(docs, rows, tolerance=1):
    sizes = {}
    for d in docs:
        sizes[d[2]] = sizes.get(d[2], 0) + len((d[1] or "").encode().split())
    goal, taken, of = waterfill(sizes), dict.fromkeys(sizes, 0), {}
    for r in rows:
        assert 0 <= r.copies * r.size + r.part <= 2 * r.size and (r.part == 0 or r.part < r.size)
        of[r.source] = (r.source_size, r.target)
        taken[r.source] += r.copies * r.size + r.part
    for name, size in sizes.items():
        assert of[name][0] == size and of[name][1] == pytest.approx(goal[name], abs=1e-6)
        assert abs(taken[name] - goal[name]) <= tolerance
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes) * tolerance)


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, cut int")
    return docs, M.mixture(docs).join(docs.selectExpr("doc_id AS id", "source").distinct(), "id").collect()


def rows_of(sizes):
    return [(i, "w\t" * n, s, "clash", 1) for i, (s, n) in enumerate(sizes)]


def test_targets_and_whole_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = M.mixture(docs).join(docs.selectExpr("doc_id AS id", "source"), "id").collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
    again = {(r.id, r.copies, r.part) for r in M.mixture(docs.repartition(7)).collect()}
    assert again == {(r.id, r.copies, r.part) for r in got}


@pytest.mark.parametrize("sizes", [
    [("a", 1)], [("a", 7), ("b", 1000), ("c", 3)], [(None, 50), ("z", 5), ("Z", 5), ("é", 9), ("\U0001F600", 4), ("�", 4)],
    [("hot", 11)] * 900 + [(f"s{k}", k) for k in range(40)], [("a", 0), ("b", 0)], [("a", 0), ("b", 12)], [("big", 100_000), ("b", 2), ("c", 1)],
])
def test_sources_of_any_size(spark, sizes):
    rows = rows_of(sizes)
    check(rows, mixed(spark, rows)[1])


def test_texts_are_what_the_plan_says(spark):
    rows = rows_of([(s, n) for n in range(1, 60) for s in ("a", "b", "c", None)]) + [(999, None, "a", "x", 1), (998, "", None, "x", 1)]
    docs, plan = mixed(spark, rows)
    check(rows, plan)
    out = M.mixed_texts(docs)
    assert out.columns == docs.columns
    texts = {}
    for r in out.collect():
        texts.setdefault(r.doc_id, []).append(len((r.text or "").split()))
    assert {i: sorted(t) for i, t in texts.items()} == {
        r.id: sorted([r.size] * r.copies + [r.part] * (r.part > 0)) for r in plan if r.copies or r.part}
    assert any(r.part for r in plan)


def test_equal_rows_and_null_ids(spark):
    rows = [(None, "one two three four", "a", "", 0)] * 300 + [(None, f"x {k}", "a", "", 0) for k in range(300)] + [(5, "y", "b", "", 0)] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, cut int")
    got = M.mixture(docs).groupBy("source_size", "target").agg({"*": "count"}).collect()
    assert sorted((r[0], r[2]) for r in got) == [(900, 900), (1800, 600)]
    goal = waterfill({"a": 1800, "b": 900})
    taken = {r.source_size: r.n for r in M.mixture(docs).groupBy("source_size").agg({"*": "count"}).selectExpr("source_size", "`count(1)` AS n").collect()}
    assert taken == {1800: 600, 900: 900}
    sums = M.mixture(docs).selectExpr("source_size", "copies * size + part AS taken").groupBy("source_size").sum("taken").collect()
    for row in sums:  # equal rows share their boundary: less than one word for each of them is lost
        name = "a" if row[0] == 1800 else "b"
        assert abs(row[1] - goal[name]) <= 900
    parts = {(r.size, r.copies, r.part) for r in M.mixture(docs).where("size = 4").collect()}
    assert len(parts) == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mixture(docs).count() == 0 and M.mixed_texts(docs).count() == 0
