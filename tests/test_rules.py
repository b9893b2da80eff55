"""Extraction rules on inline texts and against a plain model."""

import re
import time

from pyspark.sql import functions as F

from docloom.operators.extraction import (
    extract, extract_code, extract_document_text, extract_json_keys, extract_offsets, extract_result,
    extract_tag_names, place,
)
from docloom.operators.outline import extract_outline
from docloom.operators.rules import PROSE_RULES
from docloom.options import ExtractOptions
from docloom.sources.tables import load


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def found(df, kind):
    return [r.name for r in df.filter(F.col("entity_type") == kind).orderBy("id", "ordinal").collect()]


def test_prose_rules(spark):
    df = extract(texts(spark, "On 12/25/22 Dr. Jane Roe left Acme Group in New York for Phone 12 Pro."), ["id"])
    assert found(df, "person") == ["Acme Group", "Jane Roe", "New York", "Dr. Jane Roe"]
    assert found(df, "organization") == ["Acme Group"]
    # The pattern takes the blank along; storing normalises both names to one.
    assert found(df, "location") == ["New York ", "New York"]
    assert found(df, "date") == ["12/25/22"]
    assert found(df, "product") == ["On 12", "Phone 12 Pro"]


def test_document_rules_normalise_early(spark):
    df = extract_document_text(texts(spark, "NASA met at 12 Main Street on 1/2/2023, Widget™x"), ["id"])
    assert found(df, "date") == ["2023-1-2"]
    assert "NASA" in found(df, "organization")
    assert found(df, "location") == ["12 Main Street"]
    assert "Widget™" in found(df, "product")


def test_word_edges_are_unicode(spark):
    df = extract(texts(spark, "éAnna Berg and Anna Bergé, Zoë Anna Berg"), ["id"])
    assert found(df, "person") == ["Anna Berg"]


def context_model(text, name, width):
    """First line with the name, and the leftmost longest window around it."""
    window = re.compile(".{0,%d}%s.{0,%d}" % (width, re.escape(name), width))
    for number, line in enumerate(text.split("\n"), 1):
        if name in line:
            return number, window.search(line).group(0).strip() or name
    return 0, name


def test_position_and_context_follow_the_model(spark, small):
    docs = load(spark, small, "documents")
    inline = texts(
        spark,
        "x\nParis Paris in Paris and more words until the end of Paris",
        "    New York     \n" + "a" * 50 + " New York " + "b" * 50,
        "Oslo\nin New York New York",
    ).withColumn("doc_id", F.col("id") + 10**6)
    rows = docs.select("doc_id", "text").unionByName(inline.select("doc_id", "text"))
    body = {r.doc_id: r.text for r in rows.collect()}
    got = extract(rows, ["doc_id"]).collect()
    assert got
    for r in got:
        assert (r.position, r.context) == context_model(body[r.doc_id], r.match, 30), r
    assert sorted(got) == sorted(extract(rows, ["doc_id"], one_pass=False).collect())


def test_places_in_a_long_text(spark):
    """8,000 names in half a megabyte; the work grows with the text, not with text times names."""
    word = ["".join(chr(97 + n // 26 ** k % 26) for k in range(3)) for n in range(8000)]
    body = "\n".join(f"the meeting was then held by Jo{w} Be{w}son there and so on" for w in word)
    extract(texts(spark, "Ann Lee", None), ["id"], one_pass=True).collect()
    start = time.time()
    rows = extract(texts(spark, body, None, ""), ["id"], one_pass=True).filter("match LIKE 'Jo% Be%'").collect()
    assert time.time() - start < 10
    at = {r.match: r.position for r in rows}
    assert all(at[f"Jo{w} Be{w}son"] == n for n, w in enumerate(word, 1))


def test_place_of_absent_and_inner_names():
    spots = place("Joann Leeds\nAnn Lee", ["ann Lee", "Ann Lee", "Bob", ""], [3, 3, 3, 3])
    assert [(s["position"], s["context"]) for s in spots] == [(1, "Joann Leeds"), (2, "Ann Lee"), (0, "Bob"), (0, "")]


def test_offsets(spark):
    text = "Ann Lee and Ann Lee on 2024-1-2 at Foo Inc"
    rows = extract_offsets(texts(spark, text), ["id"]).orderBy("ordinal").collect()
    assert [(r.name, r.position) for r in rows] == [
        ("Ann Lee", 0), ("Ann Lee", 12), ("Foo Inc", 35), ("Foo Inc", 35), ("2024-1-2", 23)]
    for r in rows:
        assert text[r.position:r.position + len(r.name)] == r.name
        assert r.context == text[max(0, r.position - 20):r.position + len(r.name) + 20]


def test_offsets_of_many_matches(spark):
    """The work grows with the text: twice the matches cost about twice the time."""
    def timed(n):
        body = " ".join(f"on 2024-1-{k % 28 + 1} ok" for k in range(n))
        start = time.time()
        rows = extract_offsets(texts(spark, body), ["id"]).select("name", "position", "context").collect()
        spent = time.time() - start
        assert len(rows) == n and all(r.context == body[max(0, r.position - 20):r.position + len(r.name) + 20] for r in rows)
        assert all(body[r.position:r.position + len(r.name)] == r.name for r in rows)
        return spent

    timed(2_000)
    one, two = (min(timed(n), timed(n)) for n in (40_000, 80_000))
    assert one < 3 and two < max(2.5 * one, 2)
    assert extract_offsets(texts(spark, None, "", "nothing"), ["id"]).count() == 0


def test_json_keys_and_tags(spark):
    df = texts(spark, '{"b": 1, "a": {"c": 2}}', "{broken", "[1, 2]")
    assert [r.name for r in extract_json_keys(df, ["id"]).orderBy("ordinal").collect()] == ["a", "b"]
    tags = extract_tag_names(texts(spark, '<?xml v?><a x="1"><b/></a><!-- c --><a>'), ["id"])
    assert [r.name for r in tags.orderBy("ordinal").collect()] == ["?xml", "a", "b/"]


def test_code_rules_and_skips(spark):
    code = "if (x)\nint return go(y)\nuse std::io\npublic static int run(int a)\n"
    df = extract_code(texts(spark, code).withColumn("language", F.lit("java")), ["id"])
    names = [r.name for r in df.filter("rule_id = 'functions'").collect()]
    assert "run" in names and "if" not in names
    assert [r.name for r in df.filter("rule_id = 'imports'").collect()] == ["use std::io"]


def test_outline_contexts(spark):
    code = "import os as o\nclass Foo(Base):\n    pass\ndef bar(x):"
    rows = extract_outline(texts(spark, code).withColumn("language", F.lit("python")), ["id"]).orderBy("ordinal").collect()
    assert [(r.name, r.position, r.context) for r in rows] == [
        ("Foo", 2, "class Foo(Base):     pass "), ("bar", 4, "def bar(x): "), ("os", 0, "Python import"),
        ("python", 0, "Programming language")]


def test_options_filter_inside_the_row(spark):
    df = texts(spark, "Ann Lee met Bob Ray and Cy Orr in Paris on 1/2/2023", "   ")
    options = ExtractOptions(confidence_threshold=0.7, entity_types=("person",), max_entities=2)
    assert found(extract(df, ["id"], options=options), "person") == ["Ann Lee", "Bob Ray"]
    bare = extract(df, ["id"], options=ExtractOptions(extract_mentions=False))
    assert all(r.context is None and r.relevance is None for r in bare.collect())
    result = {r.id: r for r in extract_result(df, ["id"], options=options).collect()}
    assert (result[0].success, result[0].entity_count) == (True, 2)
    assert (result[1].success, result[1].error, result[1].entity_count) == (False, "Empty text content", 0)


def test_rules_agree_with_python(spark, small):
    docs = load(spark, small, "documents").select("doc_id", "text")
    got = {(r.doc_id, r.rule_id, r.match) for r in extract(docs, ["doc_id"]).collect()}
    want = set()
    for row in docs.collect():
        for rule in PROSE_RULES:
            for pattern in rule.patterns:
                for line in row.text.split("\n"):
                    for m in re.finditer(pattern, line):
                        match = re.sub(rule.strip_prefix, "", m.group(0)) if rule.strip_prefix else m.group(0)
                        want.add((row.doc_id, rule.rule_id, match))
    assert got == want


def test_rules_of_types_that_cannot_pass_do_not_run(spark):
    from docloom.operators.extraction import with_candidates
    from docloom.operators.rules import PROSE_RULES
    from docloom.options import ExtractOptions

    df = spark.createDataFrame([(1, "Dr. Ann Lee of Foo Company on 1/2/2023")], "id long, text string")
    plan = with_candidates(df, ["id"], "text", PROSE_RULES, None, ExtractOptions(0.6, ("date",), None))._jdf.queryExecution().optimizedPlan().toString()
    whole = with_candidates(df, ["id"], "text", PROSE_RULES, None, ExtractOptions(0.6, None, None))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") < whole.count("regexp_extract_all")


def test_ids_of_passing_entities_are_not_made_for_each_candidate(spark):
    from docloom.operators.extraction import with_candidates
    from docloom.plans.pipeline import WHOLE

    df = spark.createDataFrame([(1, "Ann Lee met Bob Ray in Paris on 2024-01-02, and Ann Lee left.")], "id int, text string")

    def plan(options):
        return with_candidates(df, ["id"], "text", PROSE_RULES, None, options).select("id", "_candidates")._jdf.queryExecution().optimizedPlan().toString()

    assert "array_contains" not in plan(WHOLE)  # nothing can fail, so nothing is tested
    for options in (ExtractOptions(0.7, None, None), ExtractOptions(0.5, None, 2)):
        assert "array_contains(lambda" in plan(options)
    rows = {r.name for r in extract(df, ["id"], options=ExtractOptions(0.5, None, 2)).collect()}
    assert rows == {"Ann Lee", "Bob Ray"}
    assert extract(df, ["id"], options=WHOLE).collect() == extract(df, ["id"]).collect()
