import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from docloom.llm import idstore as S
from docloom.llm.queries import op7_perfect_hash_store

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_query_equals_library(spark, small, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_KEYS", 50)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want, start = {}, 0
    for i in sorted(texts):
        ids = ids_of(texts[i])
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    rows = op7_perfect_hash_store(spark, small).collect()
    assert len(rows) == len(want) and {r.doc_id: tuple(r)[1:] for r in rows} == want


def test_odd_rows_and_small_shards(spark, tmp_path):
    rows = [(3, "İstanbul ΣΑΣ ﬁn é é <|endoftext|> x<|startoftext|>y"), (1, None), (2, ""), (2, "two two"), (None, "null id"),
            (2, "two two"), (9, "a\x1cb\x85c d\te\n\nf 's don't 12 ₿"), (5, "long" * 20000), (-4, "neg")]
    docs = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, n_tokens int, first_id string")
    folder = str(tmp_path / "store")
    S.write_store(docs, folder, PATH, shard_bytes=64)
    got = S.read_store(spark, folder, S.document_keys(docs), ids=True).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(ids_of(t)) for _, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: (r.id is not None, r.id or 0, r.nth)):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += r.n_tokens
    missing = spark.createDataFrame([(2, 3), (77, 0)], "id long, nth int")
    assert S.lookup(spark, folder, missing).collect() == []


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.stored_ids(docs, PATH).collect() == []


def test_index_is_minimal_and_perfect():
    for size in (1, 2, 7, 5000):
        hashes = S.key_hash(np.arange(size), np.zeros(size, dtype=np.int64))
        seeds = S.displacements(hashes)
        group = ((hashes >> np.uint64(32)) % np.uint64(len(seeds))).astype(np.int64)
        assert sorted(S.slot(hashes, seeds[group], size)) == list(range(size))


def test_words_equal_library():
    texts = ["a, b. c!? don't, it's. x), (y), 'll, 'll 's!", "İİ a İ, İb.", "½, ³. 12,5 a1. 一二三, Ω…, e.́ ́, a,́ b", "ÉCOLE école É. ß, ǅ ÄÖ, 각",
             "TH!! A,, |,| ## $$$ a### " * 3, "Été, " * 50 + "q" * 200 + ", " + "Z" * 64 + ". " + "z" * 63]
    code = S.WordEncoder(PATH)
    for got, text in zip(code.encode(texts, 1), texts, strict=True):
        assert np.frombuffer(got, code.kind).tolist() == ids_of(text), text


def test_special_tokens_equal_unchanged_library(spark):
    texts = ["a <|endoftext|> b", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|> x", "don<|endoftext|>'t\n<|endoftext|><|endoftext|>", "e<|endoftext|>\u0301 plain"]
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = 0
    for row in sorted(S.stored_ids(docs, PATH).collect(), key=lambda r: r.id):
        ids = [*library.encode(texts[row.id], add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), crc(ids)), texts[row.id]
        at += len(ids)
