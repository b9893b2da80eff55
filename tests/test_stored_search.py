"""Stored indexes: the rows of a full search, from a fraction of the files."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import search as R
from docloom.operators.stored_search import SubstringIndex, TokenIndex, grams
from docloom.sources.tables import load


def scans(node):
    """The leaves of a plan that has run, through what adaptive execution put around its stages."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return scans(node.executedPlan())
    if "QueryStage" in node.nodeName():
        return scans(node.plan())
    children = node.children()
    below = [leaf for i in range(children.size()) for leaf in scans(children.apply(i))]
    return below or [node]


def files(df):
    """Files and bytes that the scans of a query read, as the scans themselves report."""
    df.collect()
    out = [0, 0]
    for leaf in scans(df._jdf.queryExecution().executedPlan()):
        for at, name in enumerate(("numFiles", "filesSize")):
            if leaf.metrics().contains(name):
                out[at] += leaf.metrics().apply(name).value()
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    stored = TokenIndex(str(tmp_path_factory.mktemp("tokens")), "doc_id", buckets=16)
    stored.build(docs, ["text"], parts=16)
    return docs, stored


@pytest.mark.parametrize("query", ["The AND thr", "license", "t", "des les", "zzzz", "the the", "  ", "no_under-score x"])
def test_token_search_equals_the_full_one(spark, index, query):
    docs, stored = index
    want = R.search_index(R.build_index(docs, "doc_id", ["text"]), query, "doc_id")
    assert sorted(map(tuple, stored.search(spark, query).collect())) == sorted(map(tuple, want.collect()))


def test_token_search_reads_a_fraction(spark, index):
    stored = index[1]
    found = stored.search(spark, "The AND thr")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    assert "StringStartsWith(token,thr)" in plan and "EqualTo(token,the)" in plan
    some, every = files(found), files(stored.read(spark))
    assert 0 < some[0] * 2 < every[0] and some[1] * 2 < every[1]


def test_a_frequent_token_spans_files(spark, tmp_path):
    postings = spark.range(20_000).selectExpr("'the' AS token", "id AS doc_id", "1L AS tf")
    stored = TokenIndex(str(tmp_path), "doc_id", buckets=4)
    stored.write(postings, parts=8)
    assert len(list(tmp_path.rglob("part-*.parquet"))) == 8 and stored.search(spark, "the").count() == 20_000


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = load(spark, "/root/testdata/sf0.01", "pages")
    stored = SubstringIndex(str(tmp_path_factory.mktemp("grams")), "page_id", ("html", "url"), buckets=64)
    stored.build(rows, parts=32)
    return rows, stored


@pytest.mark.parametrize("query", ["TION the", "href=", "</title>", "é", "of", "qqqq", "e.com/1", "\n<"])
def test_substring_search_equals_the_full_one(spark, pages, query):
    rows, stored = pages
    want = R.search_like(rows, query, ["html", "url"]).select("page_id", "url")
    got = stored.search(spark, query).select("page_id", "url")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_substring_search_reads_less(spark, pages):
    rows, stored = pages
    one = rows.orderBy("page_id").first()
    got = stored.search(spark, one.url.upper())
    assert one.page_id in {r.page_id for r in got.select("page_id").collect()}
    assert files(got)[1] < files(rows.select("page_id", "html", "url"))[1]


def test_grams_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "aAaa"), (5, "x\n\U0001F600z" * 30_000)], "i int, t string")
    got = {r.i: r.g for r in rows.select("i", grams(F.col("t")).alias("g")).collect()}
    assert (got[1], got[2], got[3], got[4]) == (None, [], [], ["aaa"])
    assert sorted(got[5]) == sorted({"x\n\U0001F600", "\n\U0001F600z", "\U0001F600zx", "zx\n"})


def test_grams_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"page {i} \U0001F600"

    rows = spark.range(40).select("id", text("id").alias("t"))
    SubstringIndex(str(tmp_path), "id", ("t",), buckets=4).build(rows)
    assert made.value == 2 * 40  # once for the rows, once for their grams
    assert spark.read.parquet(str(tmp_path / "grams")).groupBy("gram", "id").count().filter("count > 1").isEmpty()


def test_empty_pieces_of_a_text_are_dropped_as_rows(spark):
    df = spark.createDataFrame([(1, " A b, a "), (2, ""), (3, None), (4, "..")], "i int, t string")
    index = R.build_index(df, "i", ["t"])
    assert "lambda" not in index._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, index.collect())) == [("a", 1, 2), ("b", 1, 1)]


def test_a_large_index_cuts_its_buckets_into_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("docloom.operators.stored_search.estimated_bytes", lambda rows: 7 << 28)
    postings = spark.range(20_000).selectExpr("'the' AS token", "id AS doc_id", "1L AS tf")
    stored = TokenIndex(str(tmp_path), "doc_id", buckets=4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        stored.write(postings)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(list(tmp_path.rglob("part-*.parquet"))) >= 4 and stored.search(spark, "the").count() == 20_000
