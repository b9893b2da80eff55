import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from docloom.llm import bytebpe as B
from docloom.llm.queries import op5_overlapping_chunk_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def want(text):
    text = text or ""
    ids = PLAIN.encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_library(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op5_overlapping_chunk_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: want(t) for i, t in texts.items()}


TEXTS = [None, "", "a", " " * 700, "it's we'll they'd I'm\n\n  you've 'tis ''ll", "x" * 900 + " y", "über straße 東京    12 345\t\t\n end",
         "one two 's 'll  three   four\n\n\n five " * 40, "don't " * 100, "\n" * 130 + "word", "!?" * 300, "<|endoftext|> é" * 30, "\x00\x1c\x85 ​"]


@pytest.mark.parametrize("chunk,overlap", [(50, 20), (64, 16), (17, 9)])
def test_small_chunks_equal_library(spark, chunk, overlap):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, n_tokens int, key string")
    rows = B.encode_documents(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap, ids=True).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert tuple(r)[1:4] == want(TEXTS[r.id])
        assert PLAIN.decode_bytes(np.frombuffer(r.ids, "<u4").tolist()) == (TEXTS[r.id] or "").encode()


def test_empty_table_and_null_id(spark):
    docs = spark.createDataFrame([(None, "some text")], "doc_id long, text string")
    assert B.encode_documents(docs.limit(0), PATH, P.PATTERN).collect() == []
    assert tuple(B.encode_documents(docs, PATH, P.PATTERN).collect()[0])[1:] == want("some text")


def test_long_piece_is_not_quadratic():
    ids = B.encoder(PATH, P.PATTERN).piece(b"ab" * 50_000)
    assert b"".join(B.encoder(PATH, P.PATTERN).tokens[i] for i in ids) == b"ab" * 50_000
