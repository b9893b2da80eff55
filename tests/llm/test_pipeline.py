import hashlib

import corpus_pipeline as P
from docloom.llm import decontaminate as D
from docloom.llm import toxicity as T
from docloom.llm.shared import shared_table
from test_similar import groups


def test_stages_on_their_own_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, items = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("labels", "benchmark"))
    tables = [docs]
    for name, stage in P.STAGES[:-1]:
        tables.append(shared_table(stage(spark, tables[-1], small), name))
        assert tables[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    bad = {r.id for r in T.score_documents(docs, labels).collect() if r.predicted}
    assert set(rows[1]) == set(rows[0]) - bad
    assert set(rows[2]) == set(rows[1])
    ids = sorted(rows[2])
    true = groups([rows[2][i].text for i in ids])
    assert set(rows[3]) == {i for at, i in enumerate(ids) if true[at] == at} and len(rows[3]) < len(rows[2])
    tests = [(r.item_id, D.shingles(r.text)) for r in items.collect()]
    held = {i for i, r in rows[3].items() if any(len(s & D.shingles(r.text)) >= D.needed(len(s)) for _, s in tests)}
    assert set(rows[4]) == set(rows[3]) - held
    last = P.run(spark, small).collect()
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in rows[4].items()}
