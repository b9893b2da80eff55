import time

from docloom.llm import templates as T


def frame(spark, texts):
    return spark.createDataFrame([(i, t, len(t or ""), "g") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, gone string")


def test_variable_fields_are_generalised(spark):
    lines = [f"user u{i} logged in from {place} at noon today" for i, place in enumerate(["home", "work"] * 6)]
    texts = [f"own text {'abcdefghijkl'[i]}{'mnopqrstuvwx'[i]}\n{line}\n\nend {'abcdefghijkl'[i] * 3}" for i, line in enumerate(lines)]
    got = T.drop_recurring(frame(spark, texts), min_texts=6, counts=True).collect()
    assert all(r.n_dropped == 1 and "logged" not in r.text and r.n_chars == len(r.text) and r.n_lines == 4 for r in got)
    assert all("\n\nend" in r.text for r in got)
    names = [f"user u{i} logged in from {'abcdefghijkl'[i]}town at noon today" for i in range(12)]  # a word varies
    got = T.drop_recurring(frame(spark, [f"{t.split(chr(10))[0]}\n{n}" for t, n in zip(texts, names, strict=True)]), min_texts=6).collect()
    assert all("logged" not in r.text for r in got)


def test_what_differs_too_much_stays(spark):
    words = "abcdefghijkl"
    texts = [f"the very same {' '.join(w * 3 + x for x in words)}\nown {w * 5}" for w in words]
    got = T.drop_recurring(frame(spark, texts), min_texts=6).collect()
    assert sorted(r.text for r in got) == sorted(texts)


def test_odd_rows(spark):
    line = "all rights reserved by the owner"
    texts = [None, "", "\n\n", line, *[f"{line}\n{'abcdefghijkl'[i] * 4} more" for i in range(12)], *["copy one\ncopy two"] * 30, line + "\n" + "é " * 90000]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in T.drop_recurring(docs).collect()}
    assert len(got) == len(texts) and T.drop_recurring(docs).columns == docs.columns
    assert got[0].text is None and got[1].text == "" and got[2].text == "\n\n" and got[3].text == line
    assert all(line not in got[i].text for i in range(4, 16)) and all(got[i].text == "copy one\ncopy two" for i in range(16, 46))
    assert got[46].text == "é " * 90000
    assert T.drop_recurring(docs.limit(0)).collect() == []


def test_text_of_many_lines(spark):
    shared = [f"this is the shared line {'abcdefghijkl'[k]}{'mnopqrstuvwx'[k]} of all texts" for k in range(12)]
    texts = ["\n".join(shared + [f"own {'abcdefghijkl'[i] * 3}"]) for i in range(12)]
    long = "\n".join(w for k in range(50_000) for w in (shared[k % 12], "zz" + "abcdefghij"[k % 10] * (k % 17 + 1)))
    start = time.time()
    got = {r.doc_id: r for r in T.drop_recurring(frame(spark, [*texts, long]), counts=True).collect()}
    assert time.time() - start < 30
    assert got[12].n_lines == 100_000 and got[12].n_dropped == 50_000 and "shared" not in got[12].text and got[12].text.count("\n") == 49_999


def test_columns_of_clashing_names_come_back(spark):
    """Names that the filtering operators use inside stay the table's own."""
    from docloom.llm import decontaminate, simhash, toxicity
    names = ["_mark", "_gone", "_changed", "_text", "_key", "_id", "_label", "_doc", "_gone_mark", "id", "label", "component_id", "score"]
    shared = "all rights reserved by the owner"
    docs = spark.createDataFrame([(i, f"{shared}\n{'abcdefghijkl'[i] * 4} more", *range(len(names))) for i in range(12)],
                                 "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    items = spark.createDataFrame([(1, "nothing like any of these words at all")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    for out in (T.drop_recurring(docs), simhash.near_dedup(docs), decontaminate.decontaminate(docs, items), toxicity.drop_toxic(docs, labels)):
        rows = out.collect()
        assert out.columns == docs.columns and all(tuple(r)[2:] == tuple(range(len(names))) for r in rows)
