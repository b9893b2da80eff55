"""Names, merging, filtering, upserts: exact values and invariants."""

import pytest
from pyspark.sql import functions as F

from docloom.functions.names import entity_key, normalize_name, validate_type
from docloom.operators import consolidate as C
from docloom.operators import tables as Y
from docloom.operators.joins import check_edges, related_content, related_entities


@pytest.mark.parametrize(("kind", "raw", "clean"), [
    ("person", 'john  "doe"', "John Doe"), ("person", "JANE SMITH", "Jane Smith"), ("person", "o'neil-smith", "O'neil-smith"),
    ("location", " new   york city ", "New York City"), ("location", "Paris ", "Paris"),
    ("organization", "acme corporation", "acme corporation"), ("organization", ' "ABC Inc." ', "ABC Inc."),
    ("date", "01/02/2023", "2023-01-02"), ("date", "12/25/22", "22-12-25"), ("date", "2023-1-2", "2023-1-2"),
    ("product", " Phone  12 ", "Phone 12"), ("person", "zoë berg", "Zoë Berg"),
])
def test_normalize(spark, kind, raw, clean):
    row = spark.range(1).select(normalize_name(F.lit(raw), F.lit(kind)).alias("n")).first()
    assert row.n == clean


@pytest.mark.parametrize(("raw", "kind"), [("person", "person"), ("PERSON", "person"), ("concept", "other"), ("Event", "event")])
def test_validate(spark, raw, kind):
    assert spark.range(1).select(validate_type(F.lit(raw)).alias("t")).first().t == kind


MENTIONS = [
    (1, 0, "Ann", "person", "short", 0.4, "c0"), (1, 1, "Bob", "person", None, 0.9, "c1"),
    (1, 2, "Ann", "person", "much longer", 0.8, "c2"), (1, 3, "Ann", "person", "longer much", 0.1, "c3"),
    (1, 4, "Acme", "organization", "", 0.3, "c4"), (2, 0, "Ann", "person", None, 0.2, "c5"),
]


def mentions(spark):
    schema = "doc long, ordinal int, name string, entity_type string, description string, relevance double, context string"
    return spark.createDataFrame(MENTIONS, schema)


def test_merge(spark):
    rows = {(r.doc, r.name): r for r in C.merge_entities(mentions(spark), ["doc"]).collect()}
    assert rows[1, "Ann"].description == "much longer" and rows[1, "Ann"].mention_count == 3
    first = {(r.doc, r.name): r for r in C.merge_entities(mentions(spark), ["doc"], "first").collect()}
    assert first[1, "Ann"].description == "short" and first[1, "Acme"].description is None


def test_nested_mentions_keep_order(spark):
    rows = C.collect_mentions(mentions(spark).withColumn("position", F.col("ordinal")), ["doc"]).collect()
    ann = next(r for r in rows if r.doc == 1 and r.name == "Ann")
    assert [m.context for m in ann.mentions] == ["c0", "c2", "c3"]
    with pytest.raises(ValueError):
        C.collect_mentions(mentions(spark), [])


def test_filter_chain(spark):
    df = mentions(spark)
    assert {r.name for r in C.filter_entities(df, ["doc"], 0.5, None, None).collect()} == {"Ann", "Bob"}
    assert {r.name for r in C.filter_entities(df, ["doc"], 0.0, ["organization"], None).collect()} == {"Acme"}
    one = C.filter_entities(df, ["doc"], 0.5, ["person"], 1).collect()
    assert [(r.doc, r.name) for r in one] == [(1, "Ann")]


def test_upserts_are_idempotent(spark):
    df = mentions(spark).withColumns({"content_id": F.col("doc"), "content_type": F.lit("text/plain")})
    entities, links = C.store_entities(df)
    again_entities, again_links = C.store_entities(df, entities, links)
    assert sorted(entities.collect()) == sorted(again_entities.collect())
    assert sorted(links.collect()) == sorted(again_links.collect())
    assert links.groupBy(*C.LINK).count().filter("count > 1").isEmpty()
    ann = links.filter((F.col("content_id") == 1) & (F.col("entity_id") == entity_key(F.lit("person"), F.lit("Ann")))).first()
    assert (ann.relevance, ann.context) == (0.1, "c3")


def test_entity_without_mentions_gets_default_link(spark):
    df = mentions(spark).limit(1).withColumns({
        "content_id": F.lit(7), "content_type": F.lit("t"), "relevance": F.lit(None).cast("double"), "context": F.lit(None).cast("string")})
    _, links = C.store_entities(df)
    assert [(r.relevance, r.context) for r in links.collect()] == [(0.5, "")]


def test_known_entities_keep_their_description(spark):
    old = C.with_entity_id(spark.createDataFrame([("person", "Ann", "old")], "entity_type string, name string, description string"))
    rows = {r.name: r.description for r in C.upsert_entities(old, mentions(spark), ["ordinal"]).collect()}
    assert rows["Ann"] == "old" and set(rows) == {"Ann", "Bob", "Acme"}


def test_tagged_mentions(spark):
    rows = spark.createDataFrame([([("c", 1, 0.5)],)], "m array<struct<context:string,position:int,relevance:double>>")
    assert rows.select(C.tag_mentions(F.col("m"), "audio")[0]["source"].alias("s")).first().s == "audio"
    assert rows.filter(C.any_mention_reaches(F.col("m"), 0.5)).count() == 1
    assert rows.filter(C.any_mention_reaches(F.col("m"), 0.6)).isEmpty()


def test_aliases_prefer_confidence(spark):
    names = spark.createDataFrame([("person", "JS"), ("person", "Zed")], "entity_type string, name string")
    aliases = spark.createDataFrame([("e1", "JS", 0.4), ("e2", "JS", 0.9)], "entity_id string, alias string, confidence double")
    rows = {r.name: r.entity_id for r in C.resolve_alias(names, aliases).collect()}
    assert rows["JS"] == "e2" and len(rows["Zed"]) == 64


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, target_id string, relationship_type string, strength double")


def test_relations(spark):
    entities = spark.createDataFrame([("a", "A"), ("b", "B")], "entity_id string, name string")
    all_edges = edges(spark, ("a", "b", "knows", 0.5), ("b", "a", "likes", 0.5), ("a", "z", "knows", 0.5), ("a", "a", "is", 1.0))
    valid, rejected = check_edges(all_edges, entities)
    assert valid.count() == 3 and [r.target_id for r in rejected.collect()] == ["z"]
    rows = related_entities(all_edges, entities, "a", limit=500).collect()
    assert [(r.entity_id, r.direction) for r in rows] == [("b", "incoming"), ("a", "outgoing"), ("b", "outgoing")]
    grown = Y.add_relations(edges(spark, ("a", "b", "knows", 0.1)), all_edges, entities)
    assert sorted((r.source_id, r.target_id, r.strength) for r in grown.collect()) == [("a", "a", 1.0), ("a", "b", 0.1), ("b", "a", 0.5)]


def test_related_content_counts_shared_entities(spark):
    links = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "y"), (4, "z")], "content_id long, entity_id string")
    content = spark.createDataFrame([(i,) for i in range(1, 5)], "content_id long")
    assert [(r.content_id, r.matching_entities) for r in related_content(links, content, 1).collect()] == [(2, 2), (3, 1)]


def test_chain_keeps_every_entity_of_a_chunk(spark):
    from docloom.plans.pipeline import ingest

    names = [f"{a}{b}" for a in ("Anna", "Berta", "Clara", "Dora", "Emma", "Frida", "Greta", "Hanna") for b in ("", "lee", "rose", "may", "lyn", "bell", "dine", "ette")]
    text = ". ".join(f"Mr. {n} Smith" for n in names)
    df = spark.createDataFrame([(1, text)], "k long, text string")
    assert ingest(df, "k").mentions.select("name").distinct().count() > 60


def test_offsets_of_a_long_text_without_a_match_are_quick(spark):
    import time

    from docloom.operators.extraction import extract_offsets

    df = spark.createDataFrame([(1, "no match here, only words " * 40_000), (2, "x Ann Lee y\n2024-01-02")], "k long, text string")
    start = time.time()
    got = {(r.name, r.position) for r in extract_offsets(df, ["k"]).collect()}
    assert got == {("Ann Lee", 2), ("2024-01-02", 12)} and time.time() - start < 10


def test_snippet_takes_any_query(spark):
    from pyspark.sql import functions as F

    from docloom.operators.search import snippet

    df = spark.createDataFrame([(r"open c:\Exx now",)], "t string")
    assert df.select(snippet(["t"], r"c:\Exx", "t").alias("s")).first().s == r"open <mark>c:\Exx</mark> now"
    assert df.select(F.lit(1)).count() == 1
