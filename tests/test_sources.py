"""Files, tables, hooks, detection and search helpers."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.functions.json_columns import merge_json, parse_or_text, salvage_json
from docloom.functions.language import language_by_text
from docloom.functions.mime import MIME_BY_EXTENSION, mime_by_extension, mime_by_first_line, mime_by_text
from docloom.operators import metadata as D
from docloom.operators.registry import Registry, apply_filters, extract_with_analyser
from docloom.operators.routing import DEFAULT_EXTRACTORS, resolve
from docloom.operators.search import build_index, query_terms, refresh_index, search_index, snippet, write_index
from docloom.operators.stats import session_tables, table_inventory
from docloom.plans.pipeline import ingest, ingest_to
from docloom.sources import files as S
from docloom.sources.logs import read_logs, read_profiles
from docloom.sources.tables import load, run_select, write_table


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "mime"), [
    ("  <!DOCTYPE html><p>", "text/html"), ("<html>", "text/html"), ("<?xml version='1'?>", "application/xml"),
    ('{"a": 1}', "application/json"), ("[1, 2]", "application/json"), ("{a: 1}", "text/plain"), ("# Title", "text/markdown"),
    ("import os", "text/x-python"), ("const x", "text/javascript"), ("export A=1", "application/x-sh"),
    ("a,b\n1,2", "text/csv"), ("a,b\nplain", "text/plain"), ("a,b\n", "text/plain"), ("", "text/plain"),
])
def test_sniff(spark, text, mime):
    assert value(spark, mime_by_text(F.lit(text))) == mime


def test_extension_table(spark):
    assert len(MIME_BY_EXTENSION) == 64
    for path, mime in (("a/b.PY", "text/x-python"), ("x.tar.gz", "application/gzip"), (".md", None), ("noext", None), ("a.b/c", None)):
        assert value(spark, mime_by_extension(F.lit(path))) == mime


def test_first_line(spark):
    assert value(spark, mime_by_first_line(F.lit('  {"a": 1}  \nrest'))) == "application/json"
    assert value(spark, mime_by_first_line(F.lit("definitely"))) == "text/x-python"


def test_language_order(spark):
    assert value(spark, language_by_text(F.lit("def f():\n import x"))) == "python"
    assert value(spark, language_by_text(F.lit("function f() { const x: string }"))) == "typescript"
    assert value(spark, language_by_text(F.lit("nothing"))) == "unknown"


def test_resolve(spark):
    for mime, name in (("text/plain", "text"), ("text/x-go", "text"), ("application/zip", "fallback"), ("audio/mpeg", None)):
        assert value(spark, resolve(F.lit(mime), DEFAULT_EXTRACTORS)) == name
    assert value(spark, resolve(F.lit("text/x-go"), {"text/x-*": "code"})) == "code"


def test_json_helpers(spark):
    assert value(spark, salvage_json(F.lit('so: {"a": 1} ok'))) == '{"a": 1}'
    failed = json.loads(value(spark, salvage_json(F.lit('no {"json'))))
    assert failed == {"error": "Failed to get valid JSON response", "raw_response": 'no {"json'}
    assert json.loads(value(spark, merge_json(F.lit('{"a": "1", "b": "2"}'), F.lit('{"b": "3"}')))) == {"a": "1", "b": "3"}
    assert value(spark, parse_or_text(F.lit("not json"))) == "not json"


def test_metadata_values(spark):
    got = value(spark, D.python_metadata(F.lit('"""Doc."""\nimport os\nclass A(B):\ndef f(x):\n  def g(y):\n')))
    assert (got.imports, got.classes, got.functions, got.docstring) == ("import os", "A", "f", "Doc.")
    got = value(spark, D.markdown_metadata(F.lit("# Top\ntext\n## Sub\n```\n```")))
    assert (got.title, got.headings, got.codeblocks) == ("Top", "Top|Sub", 2)
    got = value(spark, D.shell_metadata(F.lit("#!/bin/zsh\nrun() {\n")))
    assert (got.shebang, got.functions, got.shell_type) == ("#!/bin/zsh", "run", "zsh")


def test_file_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("print('é')")
    (tmp_path / "b.md").write_text("b")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "sub" / "c.py").write_bytes(b"x\xff")
    everything = S.scan_files(spark, str(tmp_path))
    # The file source lists no empty files.
    assert everything.count() == 3 and S.scan_files(spark, str(tmp_path), recursive=False).count() == 2
    assert S.filter_extensions(everything, "*.py, .txt").count() == 2
    assert S.filter_extensions(everything, "").count() == 3
    assert S.filter_max_size(everything, 1).count() == 1
    assert S.cap_files(everything, 2).count() == 2 and S.cap_files(everything, 0).count() == 3
    texts = {r.path.split("/")[-1]: r.text for r in S.read_text(spark, str(tmp_path)).collect()}
    assert texts == {"a.py": "print('é')", "b.md": "b", "c.py": "x\ufffd"}
    assert S.scan_paths(spark, [str(tmp_path / "a.py")]).count() == 1


def test_items_get_ids(spark):
    df = spark.createDataFrame([("x", "t", None), ("y", "t", "7")], "content string, content_type string, id string")
    rows = S.from_items(df).collect()
    assert all(r.item_id and r.priority == 0 for r in rows) and {r.item_id for r in rows} >= {"7"}


def test_only_select(spark):
    assert run_select(spark, " SELECT :x AS v", {"x": 3}).first().v == 3
    for bad in ("DROP TABLE t", "insert into t select 1", "with a as (select 1) select * from a"):
        with pytest.raises(ValueError):
            run_select(spark, bad)


def test_inventory(spark, small):
    load(spark, small, "nation").createOrReplaceTempView("nation_view")
    found = table_inventory(session_tables(spark))
    rows = [r for r in found.collect() if r.table_name == "nation_view"]
    assert [(r.ordinal, r.column_name, r.data_type, r.rows) for r in sorted(rows)] == [
        (1, "n_nationkey", "int", 25), (2, "n_name", "string", 25), (3, "n_regionkey", "int", 25)]
    assert "ReadSchema: struct<>" in found._jdf.queryExecution().toString()  # counted from the footers
    spark.catalog.dropTempView("nation_view")


def test_snapshot_is_never_overwritten(spark, tmp_path):
    df = spark.range(10).withColumn("kind", (F.col("id") % 2).cast("string"))
    write_table(df, str(tmp_path / "t"), "kind")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_table(df, str(tmp_path / "t"), "kind")


def test_tasks_write_their_own_rows_of_a_dominant_kind(spark, tmp_path):
    df = spark.range(0, 400, 1, 20).withColumn("kind", F.lit("text"))
    write_table(df, str(tmp_path / "t"), "kind")
    assert len(list(tmp_path.rglob("part-*.parquet"))) == 20 and spark.read.parquet(str(tmp_path / "t")).distinct().count() == 400


def test_logs_and_profiles(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"timestamp":"t","level":"info","message":"m","context":{"module":"a","function":"f","line":3}}\n')
    assert read_logs(spark, str(tmp_path / "l.json")).first().context.line == 3
    (tmp_path / "p.csv").write_text("op:a:b,12,100,5,1.5\nplain,1,2,3,4\n")
    rows = read_profiles(spark, str(tmp_path / "p.csv")).orderBy("operation").collect()
    assert [(r.operation, r.info) for r in rows] == [("op", "a:b"), ("plain", None)]


def test_registry_chooses_one_hook(spark):
    df = spark.createDataFrame([("text/plain",), ("text/x-go",), ("image/png",), ("audio/x",)], "content_type string")

    def hook(name):
        return lambda rows: rows.select("content_type", F.lit(name).alias("hook"))

    registry = Registry().register("text/plain", hook("plain")).register("text/*", hook("text")).register("image/*", hook("image"))
    got = {r.content_type: r.hook for r in registry.apply(df).collect()}
    assert got == {"text/plain": "plain", "text/x-go": "text", "image/png": "image"}
    assert [r.content_type for r in registry.unserved(df).collect()] == ["audio/x"]


def test_row_hooks_share_one_scan(spark, small):
    docs = load(spark, small, "documents").withColumn("content_type", F.expr("CASE lang WHEN 'en' THEN 'text/plain' WHEN 'de' THEN 'image/png' WHEN 'fr' THEN 'text/x-go' END"))

    def hook(name, copies):
        return lambda: F.array_repeat(F.struct("doc_id", F.lit(name).alias("hook")), copies)

    registry = Registry().register_rows("text/*", hook("text", 1)).register_rows("text/plain", hook("plain", 2)).register_rows("image/*", hook("image", 0))
    out = registry.apply(docs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    counts = {r.hook: r["count"] for r in out.groupBy("hook").count().collect()}
    langs = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert counts == {"plain": 2 * langs["en"], "text": langs["fr"]}
    # A frame hook beside them, and one that takes the place of a row hook.
    registry.register("text/plain", lambda df: df.select("doc_id", F.lit("frame").alias("hook")))
    assert {r.hook: r["count"] for r in registry.apply(docs).groupBy("hook").count().collect()} == {"frame": langs["en"], "text": langs["fr"]}


def test_filters_and_analyser(spark):
    df = spark.createDataFrame([(1, "has SECRET Ann Lee"), (2, "Bob Ray")], "id long, text string")
    assert apply_filters(df, [lambda c: F.replace(c, F.lit("SECRET"), F.lit("[REDACTED]"))]).first().text == "has [REDACTED] Ann Lee"

    def analyser(texts):
        return texts.map(lambda t: '{"entities": [{"name": "N", "type": "event", "mentions": [{"context": "c", "position": 1, "relevance": 1.0}]}]}' if "SECRET" in t else "?")

    rows = extract_with_analyser(df, ["id"], analyser).collect()
    assert sorted((r.id, r.name, r.entity_type) for r in rows) == [(1, "N", "event"), (2, "Bob Ray", "person")]
    assert extract_with_analyser(df, ["id"], analyser, fallback=False).count() == 1


def test_search(spark, tmp_path):
    df = spark.createDataFrame([(1, "The quick fox"), (2, "the quickest"), (3, "slow fox")], "id long, text string")
    index = build_index(df, "id", ["text"])
    write_index(index, str(tmp_path / "i"), "id", 2)
    index = spark.read.parquet(str(tmp_path / "i"))
    assert query_terms("The, qui") == ["the", "qui"]
    assert sorted(r.id for r in search_index(index, "the qui", "id").collect()) == [1, 2]
    assert sorted(r.id for r in search_index(index, "fo", "id").collect()) == [1, 3]
    assert search_index(index, " ", "id").isEmpty()
    changed = spark.createDataFrame([(1, "plain")], "id long, text string")
    again = refresh_index(index, changed, "id", ["text"], df.filter("id = 3").select("id"))
    assert sorted(r.id for r in search_index(again, "fo", "id").collect()) == []
    text = "x" * 40 + "Fox. and fox" + "y" * 80
    got = spark.createDataFrame([(text,)], "t string").select(snippet(["t"], "fox", "docs").alias("s")).first().s
    cut = text[10:10 + 3 + 60].replace("Fox", "<mark>Fox</mark>").replace("fox", "<mark>fox</mark>")
    assert got == f"...{cut}..."
    assert spark.createDataFrame([("none",)], "t string").select(snippet(["t"], "fox", "docs").alias("s")).first().s == "Match found in docs"


def test_ingest_chain(spark, small):
    out = ingest(load(spark, small, "documents").select("doc_id", "text"), "doc_id")
    assert out.content.count() == 200 and out.chunks.count() == 200
    assert out.links.join(out.entities, "entity_id", "left_anti").isEmpty()
    assert {"content_type", "kind", "hash", "size", "tokens", "metadata"} <= set(out.content.columns)


def test_written_ingest_equals_the_lazy_one(spark, small, tmp_path):
    docs = load(spark, small, "documents").select("doc_id", "text").filter("doc_id < 60")
    lazy, out = ingest(docs, "doc_id"), ingest_to(str(tmp_path / "snap"), docs, "doc_id")
    for name in ("chunks", "mentions", "entities", "links"):
        a, b = getattr(lazy, name), getattr(out, name)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect())), name
    assert out.content.count() == 60


def test_unsearched_ingest_writes_content_and_chunks(spark, small, tmp_path):
    docs = load(spark, small, "documents").select("doc_id", "text").filter("doc_id < 60")
    whole, out = ingest_to(str(tmp_path / "a"), docs, "doc_id"), ingest_to(str(tmp_path / "b"), docs, "doc_id", searched=False)
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == ["chunks", "content"]
    for name in ("content", "chunks", "mentions", "entities", "links"):
        a, b = getattr(whole, name), getattr(out, name)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect())), name


def test_last_patch_wins(spark):
    from docloom.operators.tables import patch_rows

    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    patch = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id long, name string, n long")
    assert sorted(map(tuple, patch_rows(table, patch, "id", ["name"], ["n"]).collect())) == [(1, "y"), (2, "b")]


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    import types

    from docloom.session import ensure_checkpoint_dir

    class Unset:
        def get(self, key, default=None):
            return default

    context = types.SimpleNamespace(master="spark://host:7077", getConf=Unset, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(types.SimpleNamespace(conf=Unset(), sparkContext=context))
