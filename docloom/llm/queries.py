"""The query of each operator, over its whole table with production parameters, and SQL where it can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.bytebpe import encode_documents
from docloom.llm.decontaminate import contained_items
from docloom.llm.descent import near_vectors
from docloom.llm.filters import audit, doc_facts
from docloom.llm.idstore import stored_ids
from docloom.llm.mixing import mixture
from docloom.llm.periods import periodic_runs, with_planted_tails
from docloom.llm.quotations import as_mail, link_conversations
from docloom.llm.repeats import remove_repeats
from docloom.llm.ring import assign_shards
from docloom.llm.simhash import simhash_groups
from docloom.llm.templates import drop_recurring
from docloom.llm.toxicity import score_documents
from docloom.sources.tables import load


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = as_mail(load(spark, sf_dir, "conversations"))
    return link_conversations(mail, thread_column="conv_id").selectExpr(
        "id AS msg_id", "parent AS parent_id", "root AS root_id", "depth", "n_quotes", "n_linked", "text")


def op2_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(load(spark, sf_dir, "documents"), 40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op4_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_overlapping_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op6_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.selectExpr("id AS doc_id", "item AS item_id", "hits", "containment")


def op7_perfect_hash_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored_ids(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.selectExpr("id AS doc_id", "start", "n_tokens", "ids_crc32")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op10_log_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_recurring(load(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op11_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(load(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(doc_facts(load(spark, sf_dir, "documents")), load(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_tails(load(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(listed, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


#: The same rules on strings instead of hashes.
OP10_SQL = r"""
WITH texts AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
parts AS (SELECT text, string_split(text, chr(10)) AS content FROM texts),
numbered AS (SELECT text, unnest(range(0, len(content))) AS line, unnest(content) AS content FROM parts),
lines AS (
    SELECT text, line, list_filter(string_split(regexp_replace(translate(content, chr(9) || chr(13) || chr(11) || chr(12), '    '),
        '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' '), lambda x: x <> '') AS tokens FROM numbered
), full_lines AS (SELECT text, line, tokens, [len(tokens)::VARCHAR] || tokens[1:3] AS leaf FROM lines WHERE len(tokens) > 0),
leaves AS (SELECT leaf FROM full_lines GROUP BY leaf HAVING count(DISTINCT text) >= 10),
held AS (SELECT f.* FROM full_lines f SEMI JOIN leaves USING (leaf)),
forms AS (SELECT leaf, tokens, count(DISTINCT text) AS texts FROM held GROUP BY leaf, tokens),
placed AS (SELECT leaf, tokens, texts, unnest(range(0, len(tokens))) AS place, unnest(tokens) AS token FROM forms),
named AS (SELECT * FROM placed WHERE token <> '<*>'),
constant AS (SELECT leaf, place, token FROM named GROUP BY leaf, place, token HAVING sum(texts) >= 10),
templates AS (
    SELECT leaf, tokens, any_value(texts) AS texts, list({'place': place, 'token': token} ORDER BY place) AS template
    FROM named SEMI JOIN constant USING (leaf, place, token) GROUP BY leaf, tokens HAVING count(*) >= 0.6 * len(tokens)
), common AS (SELECT leaf, template FROM templates GROUP BY leaf, template HAVING sum(texts) >= 10),
gone AS (
    SELECT text, list(line) AS gone FROM held SEMI JOIN (SELECT leaf, tokens FROM templates SEMI JOIN common USING (leaf, template)) USING (leaf, tokens)
    GROUP BY text
), judged AS (
    SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS content, g.gone,
        (SELECT count(*) FROM full_lines f WHERE f.text = d.text) AS full_count
    FROM documents d LEFT JOIN gone g ON d.text = g.text
)
SELECT doc_id, coalesce(len(content), 0)::BIGINT AS n_lines,
    (CASE WHEN gone IS NOT NULL AND len(gone) < full_count THEN len(gone) ELSE 0 END)::BIGINT AS n_dropped,
    md5(CASE WHEN gone IS NOT NULL AND len(gone) < full_count
        THEN array_to_string([content[i + 1] for i in range(0, len(content)) if NOT list_contains(gone, i)], chr(10)) ELSE text END) AS text_md5
FROM judged
"""

QUERIES = {
    "op1_quotation_linking": op1_quotation_linking,
    "op2_hash_ring_shards": op2_hash_ring_shards,
    "op3_nn_descent": op3_nn_descent,
    "op4_fixed_block_anchors": op4_fixed_block_anchors,
    "op5_overlapping_chunk_bpe": op5_overlapping_chunk_bpe,
    "op6_containment_search": op6_containment_search,
    "op7_perfect_hash_store": op7_perfect_hash_store,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_factorization_machine": op9_factorization_machine,
    "op10_log_template_lines": op10_log_template_lines,
    "op11_hash_threshold_mix": op11_hash_threshold_mix,
    "op12_filter_interactions": op12_filter_interactions,
    "op13_periodic_runs": op13_periodic_runs,
}
#: Exact containment of five-word shingles, without signatures; punctuation is a space and A-Z lower case.
OP6_SQL = r"""
WITH plain AS (
    SELECT kind, id, string_split(trim(regexp_replace(regexp_replace(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[!-/:-@\[-`{-~]', ' ', 'g'), '[ \t\n\v\f\r]+', ' ', 'g')), ' ') AS words
    FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark)
), parts AS (
    SELECT DISTINCT kind, id, array_to_string(words[p:p + 4], ' ') AS part
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM plain)
), sizes AS (SELECT id AS item_id, count(*) AS size FROM parts WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS hits, count(*) / any_value(size)::DOUBLE AS containment
FROM parts d JOIN parts i ON d.part = i.part AND d.kind = 'd' AND i.kind = 'i' JOIN sizes ON sizes.item_id = i.id
GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(size)
"""
#: Targets by the sorted limits of all sources at once, thresholds by running sums over all documents in order of the hash.
OP11_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(md5(text), '')), 1, 15))::BIGINT AS place FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, sum(sum(size)) OVER () AS total,
        [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), c AS (
    SELECT *, (1.5 * total - coalesce(sum(2 * source_size) OVER before, 0)) / (sum(weight) OVER ()
        - coalesce(sum(weight) OVER before, 0))::DOUBLE AS rate, 2 * source_size AS most FROM s
    WINDOW before AS (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, least(most::DOUBLE, weight * (SELECT max(rate) FROM c)) AS target FROM c
), b AS (
    SELECT *, CASE WHEN source_size > 0 THEN least(floor(target + 0.5)::BIGINT // source_size, 2) ELSE 0 END AS passes FROM t
), r AS (
    SELECT d.*, b.source_size, b.target, passes, greatest(floor(target + 0.5)::BIGINT - passes * b.source_size, 0) AS rest,
        sum(size) OVER (PARTITION BY d.source ORDER BY place) AS upto, sum(size) OVER (PARTITION BY d.source, place) AS same
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (passes * size + CASE WHEN size = 0 OR rest <= upto - same THEN 0
    WHEN rest >= upto THEN size ELSE (rest - upto + same) * size // same END)::BIGINT AS taken
FROM r
"""
#: Plain word lists and a walk through all orders for each kind of document.
OP12_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), first AS (SELECT text, min(doc_id) AS doc_id FROM d GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, coalesce(d.doc_id > first.doc_id, false) AS e,
        len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
        100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) AS c, regexp_matches(d.text, '[#$%&*|]') AS d
    FROM d JOIN first ON d.text = first.text LEFT JOIN marks ON marks.doc_id = d.doc_id
), kinds AS (
    SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
        CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM flags GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
    SELECT concat(v.l, w.l, x.l, y.l, z.l) AS filter_order FROM letters v, letters w, letters x, letters y, letters z
    WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5
), steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
judged AS (
    SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS letter, fails,
        contains(fails, letter) AS hit, regexp_matches(fails, '[' || substr('_' || filter_order, 1, step) || ']') AS gone FROM kinds, steps
), counted AS (
    SELECT part, filter_order, step, letter, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN hit AND NOT gone AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN hit AND NOT gone AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
    FROM judged GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM counted
"""
ORACLES: dict[str, str] = {
    "op6_containment_search": OP6_SQL, "op10_log_template_lines": OP10_SQL, "op11_hash_threshold_mix": OP11_SQL,
    "op12_filter_interactions": OP12_SQL,
}
