"""Plans: what reaches the scan, what shuffles, what runs in Python."""

import contextlib
import io

from pyspark.sql import functions as F

from docloom.operators import joins as J
from docloom.operators import lists as P
from docloom.operators.chunking import chunk
from docloom.operators.extraction import extract, extract_code, extract_offsets, extract_result
from docloom.operators.ordering import keep_newest
from docloom.operators.search import build_index
from docloom.sources.tables import load

def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_extraction_and_chunking_do_not_shuffle(spark, small):
    docs = load(spark, small, "documents")
    code = docs.withColumn("language", F.lit("python"))
    for df in (
        extract(docs, ["doc_id"], one_pass=False), extract_code(code, ["doc_id"], one_pass=False), extract_result(docs, ["doc_id"]),
        *(chunk(docs, ["doc_id"], s, 400, 40) for s in ("paragraph", "line", "token", "character", "sentence", "blank_line")),
    ):
        plan = plan_of(df)
        assert "Exchange" not in plan and "EvalPython" not in plan and "InPandas" not in plan
        assert "struct<doc_id:bigint,text:string>" in plan


def test_placing_names_in_one_pass_does_not_shuffle(spark, small):
    docs = load(spark, small, "documents")
    for df in (extract(docs, ["doc_id"]), extract_offsets(docs, ["doc_id"])):
        plan = plan_of(df)
        assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 2  # the node and its details
        assert "struct<doc_id:bigint,text:string>" in plan


def test_filters_reach_the_scan(spark, small):
    rows = load(spark, small, "orders")
    plan = plan_of(P.batch_filter(rows.withColumnRenamed("o_orderstatus", "content_type"), ["F"], "1996-01-01", None, "o_orderdate").select("o_orderkey"))
    assert "GreaterThan(o_orderdate" in plan and "EqualTo(o_orderstatus,F)" in plan or "In(o_orderstatus" in plan
    assert "PushedFilters: [IsNotNull(ts)" in plan_of(P.retain(load(spark, small, "events").select("event_id", "ts"), "ts", "2024-02-01"))


def test_related_content_has_no_pairing_join(spark, small):
    links = load(spark, small, "lineitem").select(F.col("l_orderkey").alias("content_id"), F.col("l_partkey").alias("entity_id"))
    content = load(spark, small, "orders").select(F.col("o_orderkey").alias("content_id"))
    plan = plan_of(J.related_content(links, content, 5))
    assert "LeftSemi" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "TakeOrderedAndProject" in plan


def test_top_rows_of_a_group_are_cut_ahead_of_the_shuffle(spark, small):
    events = load(spark, small, "events").select("event_type", "ts", "event_id")
    assert "WindowGroupLimit" in plan_of(keep_newest(events, ["event_type"], ["ts"]))


def test_index_is_counted_ahead_of_the_shuffle(spark, small):
    plan = plan_of(build_index(load(spark, small, "documents"), "doc_id", ["text"]))
    assert plan.count("HashAggregate") >= 2 and "partial_count" in plan
