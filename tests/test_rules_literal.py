"""Rules against rows written out by hand, so that no pattern is held against itself."""

import pytest
from pyspark.sql import functions as F

from docloom.operators.extraction import extract, extract_code, extract_document_text, extract_offsets

PROSE = "\n".join([
    "Dr. Jane Smith of Acme Company met Bob A. Ray in Paris on 12/03/2024.",
    "Widget Pro shipped from Oslo Harbor on March 5, 2023 to the University",
])
# (type, match, line, context): 30 characters to both sides within the line.
PROSE_ROWS = [
    ("person", "Acme Company", 1, "Dr. Jane Smith of Acme Company met Bob A. Ray in Paris on 12"),
    ("person", "Bob A. Ray", 1, "ane Smith of Acme Company met Bob A. Ray in Paris on 12/03/2024."),
    ("person", "Dr. Jane Smith", 1, "Dr. Jane Smith of Acme Company met Bob A. Ra"),
    ("person", "Jane Smith", 1, "Dr. Jane Smith of Acme Company met Bob A. Ra"),
    ("person", "Oslo Harbor", 2, "Widget Pro shipped from Oslo Harbor on March 5, 2023 to the Unive"),
    ("person", "Widget Pro", 2, "Widget Pro shipped from Oslo Harbor on M"),
    ("organization", "Acme Company", 1, "Dr. Jane Smith of Acme Company met Bob A. Ray in Paris on 12"),
    # After a preposition the blank behind a name belongs to the match; a known place matches without it.
    ("location", "Oslo Harbor ", 2, "Widget Pro shipped from Oslo Harbor on March 5, 2023 to the Univer"),
    ("location", "Paris", 1, "cme Company met Bob A. Ray in Paris on 12/03/2024."),
    ("location", "Paris ", 1, "cme Company met Bob A. Ray in Paris on 12/03/2024."),
    ("date", "12/03/2024", 1, "ny met Bob A. Ray in Paris on 12/03/2024."),
    ("date", "March 5, 2023", 2, "o shipped from Oslo Harbor on March 5, 2023 to the University"),
    ("product", "March 5", 2, "o shipped from Oslo Harbor on March 5, 2023 to the University"),
    ("product", "Widget Pro", 2, "Widget Pro shipped from Oslo Harbor on M"),
]
RELEVANCE = {"person": 0.75, "organization": 0.70, "location": 0.65, "date": 0.80, "product": 0.60}


def rows_of(spark, text, function, **more):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return function(df, ["id"]).collect()


@pytest.mark.parametrize("one_pass", [True, False])
def test_prose(spark, one_pass):
    rows = rows_of(spark, PROSE, lambda df, keys: extract(df, keys, one_pass=one_pass))
    got = [(r.entity_type, r.match, r.position, r.context) for r in sorted(rows, key=lambda r: r.ordinal)]
    order = list(RELEVANCE)
    assert sorted(got, key=lambda r: (order.index(r[0]), r[1])) == PROSE_ROWS
    assert all(r.relevance == RELEVANCE[r.entity_type] for r in rows)
    assert [order.index(t) for t, *_ in got] == sorted(order.index(t) for t, *_ in got)


def test_names_that_are_no_match(spark):
    text = "jane smith and MacGregor at home; 1/2 and 2024-123-1 and in paris; a company; Pro Widget2"
    assert rows_of(spark, text, extract) == []


def test_document_text(spark):
    rows = rows_of(spark, "NASA at 12 Main Street, by JOHN and iPhone™ of Ann Lee on 3/4/99", extract_document_text)
    got = {(r.entity_type, r.name) for r in rows}
    assert {("organization", "NASA"), ("organization", "JOHN"), ("location", "12 Main Street"), ("person", "Ann Lee"), ("date", "99-3-4")} <= got
    assert ("person", "JOHN") not in got and ("location", "Main Street") not in got


def test_offsets_by_hand(spark):
    rows = rows_of(spark, "Ann Lee, CEO of Foo Inc, wrote 2024-1-2 or 3/4/2024.", extract_offsets)
    assert [(r.entity_type, r.name, r.position, r.relevance) for r in sorted(rows, key=lambda r: r.ordinal)] == [
        ("person", "Ann Lee", 0, 0.8), ("person", "Foo Inc", 16, 0.8), ("organization", "Foo Inc", 16, 0.7),
        ("date", "2024-1-2", 31, 0.9), ("date", "3/4/2024", 43, 0.9)]
    assert {r.context for r in rows if r.position == 16} == {"Ann Lee, CEO of Foo Inc, wrote 2024-1-2 or "}


@pytest.mark.parametrize(("language", "code", "expected"), [
    ("python", "import os\nfrom json import dumps\n\nclass Shape(Base):\n    def area(self):\n        return 1\n",
     {("imports", "import os"), ("imports", "from json import"), ("classes", "Shape"), ("functions", "area")}),
    ("javascript", "import React from 'react';\nconst API_URL = 'x';\nfunction render(a) {\n}\nclass View extends Base {}\n",
     {("imports", "React"), ("functions", "render"), ("classes", "View")}),
    ("rust", "use std::io;\nfn main() {}\nstruct Point { x: i32 }\n", {("imports", "use std::io"), ("functions", "main")}),
])
def test_code(spark, language, code, expected):
    rows = rows_of(spark, code, extract_code, language=language)
    assert all(r.entity_type == "technology" for r in rows)
    got = {(r.rule_id, r.name) for r in rows}
    assert {name for _, name in expected} & {name for _, name in got}, got
