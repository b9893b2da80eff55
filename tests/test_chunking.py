"""Chunkers against plain models."""

import re

import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docloom.operators.chunking import chunk, chunk_where_needed
from docloom.operators.consolidate import extract_chunked
from docloom.options import ChunkOptions
from docloom.sources.tables import load
from pyspark.sql import functions as F

SPLITS = {"paragraph": r"\n\s*\n", "line": r"\n", "token": r"\s+|[.,;!?]"}


def fold(segments, size, overlap):
    chunks, current = [], ""
    for segment in segments:
        if current and len(current) + len(segment) > size:
            chunks.append(current)
            current = current[len(current) - min(overlap, len(current)):] if overlap else ""
        current = f"{current} {segment}" if current else segment
    return chunks + ([current] if current else [])


def sentences(text, size, overlap):
    chunks, parts, total = [], [], 0
    for s in re.split(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s", text):
        if parts and total + len(s) > size:
            chunks.append(" ".join(parts))
            kept, total = [], 0
            for p in reversed(parts if overlap else []):
                if total + len(p) > overlap:
                    break
                kept.insert(0, p)
                total += len(p) + 1
            parts = kept
        parts.append(s)
        total += len(s) + 1
    return chunks + [" ".join(parts)]


def blank_lines(text, size, overlap):
    chunks, current = [], ""
    for line in (text[:-1] if text.endswith("\n") else text).split("\n") if text else []:
        if line == "" and current:
            current += "\n\n"
            if len(current) >= size:
                chunks.append(current)
                current = (current + "\n")[-overlap:].rstrip("\n") if overlap else ""
        else:
            current += line + "\n"
    return chunks + ([current] if current else [])


def characters(text, size, overlap):
    chunks, at = [], 0
    while at < len(text):
        chunks.append(text[at:at + size])
        if at + size >= len(text):
            break
        at += size - overlap
    return chunks


def model(text, strategy, size, overlap):
    if strategy in SPLITS:
        return fold(re.split(SPLITS[strategy], text), size, overlap)
    return {"character": characters, "sentence": sentences, "blank_line": blank_lines}[strategy](text, size, overlap)


def chunks_of(df, strategy, size, overlap):
    out = {}
    for r in chunk(df, ["doc_id"], strategy, size, overlap).orderBy("doc_id", "chunk_index").collect():
        assert r.chunk_index == len(out.setdefault(r.doc_id, []))
        out[r.doc_id].append(r.chunk_text)
    return out


@pytest.mark.parametrize("strategy", [*SPLITS, "character", "sentence", "blank_line"])
@pytest.mark.parametrize(("size", "overlap"), [(400, 40), (250, 0), (60, 59)])
def test_documents(spark, small, strategy, size, overlap):
    docs = load(spark, small, "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text")))
    got = chunks_of(docs, strategy, size, overlap)
    for row in docs.collect():
        assert got.get(row.doc_id, []) == model(row.text, strategy, size, overlap), row.doc_id


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é.\n ,!", max_size=60), min_size=1, max_size=25), st.integers(2, 20), st.integers(0, 6))
def test_any_text(spark, texts, size, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for strategy in ("paragraph", "line", "token", "blank_line", "sentence"):
        got = chunks_of(df, strategy, size, overlap)
        for i, text in enumerate(texts):
            assert got.get(i, []) == model(text, strategy, size, overlap), (strategy, text)


def test_sizes_are_bytes(spark):
    df = spark.createDataFrame([(1, "aé" * 10)], "doc_id long, text string")
    rows = chunk(df, ["doc_id"], "size", 4).orderBy("chunk_index").collect()
    assert b"".join(bytes(r.chunk_bytes) for r in rows) == ("aé" * 10).encode()
    assert [len(r.chunk_bytes) for r in rows] == [4] * 7 + [2]


def test_defaults_and_explicit_zero():
    assert ChunkOptions().resolved() == (4194304, 419430)
    assert ChunkOptions(max_size=100).resolved() == (100, 10)
    assert ChunkOptions(max_size=100, overlap=0).resolved() == (100, 0)


def test_overlap_must_be_smaller(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    with pytest.raises(ValueError):
        chunk(df, ["doc_id"], "character", 10, 10)
    with pytest.raises(ValueError):
        chunk(df, ["doc_id"], "nothing")


def test_short_texts_stay_whole(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "a")], "doc_id long, text string")
    rows = chunk_where_needed(df, ["doc_id"], F.length("text") > 3, "line", 3, 0).collect()
    assert sorted((r.doc_id, r.chunk_index, r.chunk_text) for r in rows) == [(1, 0, "a b"), (1, 1, "c"), (2, 0, "a")]


def test_chunked_extraction_merges_by_name(spark):
    df = spark.createDataFrame([(1, "Ann Lee x\nAnn Lee y\nBob Ray z")], "doc_id long, text string")
    rows = extract_chunked(df, ["doc_id"], "line", 9, 0).collect()
    assert sorted((r.name, r.mention_count) for r in rows) == [("Ann Lee", 2), ("Bob Ray", 1)]


@pytest.mark.parametrize("strategy", ["sentence", "blank_line"])
@pytest.mark.parametrize("size", [2_000, 4_000_000])
def test_long_texts_take_time_in_proportion(spark, strategy, size):
    """A hundred thousand sentences or lines, in one chunk or in thousands."""
    part = "Some words here. " if strategy == "sentence" else "some words\n\nmore\n"
    df = spark.createDataFrame([(1, part * 60_000)], "id long, text string")
    start = time.time()
    rows = chunk(df, ["id"], strategy, size, 100).select(F.length("chunk_text").alias("n")).collect()
    assert time.time() - start < 20
    assert sum(r.n for r in rows) >= 59_000 * len(part) and all(r.n <= size + 200 for r in rows)
