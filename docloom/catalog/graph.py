"""Lists, joins and relation graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.catalog.entities import CONTENT_SQL, ENTITIES_SQL, STORED_SQL, content, rules_of, stored
from docloom.catalog.registered import query
from docloom.catalog.views import ITEMS_SQL, batch_items
from docloom.operators import joins as J
from docloom.operators import lists as P
from docloom.operators import ordering as O
from docloom.session import cut_lineage
from docloom.sources.tables import load

TYPED_LINKS = (
    f"SELECT s.content_id, c.content_type, s.entity_id, s.relevance, arg_max(s.context, (s.ord, s.rank)) AS context FROM "
    f"(SELECT *, 0 AS ord FROM ({STORED_SQL})) s JOIN ({CONTENT_SQL}) c USING (content_id) GROUP BY 1, 2, 3, 4"
)


# ------------------------------------------------------------------ lists
@query(
    "p15_list_content",
    """SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND (contains(lower(text), lower('Licensed Under')) OR contains(lower(source), 'licensed under'))""",
)
def p15(spark, folder):
    docs = load(spark, folder, "documents").withColumn("content_type", F.col("lang"))
    rows = P.list_content(docs, "en", "Licensed Under", ("text", "source"))
    return rows.select("doc_id", "lang", "source")


@query(
    "p16_list_entities",
    """SELECT c_custkey, c_name AS name, c_mktsegment AS entity_type, c_acctbal / 10000 AS confidence FROM customer
       WHERE c_acctbal / 10000 >= 0.5 AND c_mktsegment = 'BUILDING' AND contains(lower(c_name), 'r#0000000')""",
)
def p16(spark, folder):
    rows = load(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("entity_type"),
        (F.col("c_acctbal") / 10000).alias("confidence"))
    return P.list_entities(rows, "BUILDING", "R#0000000", 0.5)


@query(
    "p17_batch_filter",
    """SELECT o_orderkey, o_orderstatus AS content_type FROM orders WHERE o_orderstatus IN ('F', 'O')
       AND o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-06-01'""",
)
def p17(spark, folder):
    rows = load(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("content_type"), "o_orderdate")
    return P.batch_filter(rows, ["F", "O"], "1996-01-01", "1998-06-01", "o_orderdate").drop("o_orderdate")


@query("p21_select_items", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def p21(spark, folder):
    ids = load(spark, folder, "labels").filter("toxic = 1")
    return P.select_items(load(spark, folder, "documents").select("doc_id", "lang"), ids, "doc_id")


_BATCHES = """SELECT o_orderkey AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status,
 o_orderdate AS created_at FROM orders"""


def _batches(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending")
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("batch_id"), status.otherwise("processing").alias("status"),
        F.col("o_orderdate").alias("created_at"))


@query("p22_list_batches", f"SELECT * FROM ({_BATCHES}) WHERE status = 'processing' ORDER BY created_at DESC, batch_id LIMIT 20 OFFSET 40")
def p22_batches(spark, folder):
    return O.page(P.list_batches(_batches(spark, folder), "processing"), O.sort_column("batch", "createdAt"),
                  "batch_id", "desc", 20, 40, O.PAGE_CAPS["batch"])


@query("p22_list_batch_items", f"SELECT * FROM ({ITEMS_SQL}) WHERE batch_id = 5 AND status = 'completed'")
def p22_items(spark, folder):
    return P.list_items(batch_items(spark, folder), 5, "completed")


@query(
    "l01_page",
    f"""SELECT content_id, title FROM ({CONTENT_SQL}) WHERE content_type = 'text/plain' ORDER BY title ASC, content_id LIMIT 25 OFFSET 50""",
)
def l01(spark, folder):
    rows = content(spark, folder).filter(F.col("content_type") == "text/plain").select("content_id", "title")
    return O.page(rows, "title", "content_id", "asc", 25, 50)


@query(
    "l01_a01_page_info",
    """SELECT CAST(25 AS INTEGER) AS "limit", CAST(50 AS INTEGER) AS "offset", count(*) AS total,
        CAST(CASE WHEN count(*) > 75 THEN 75 END AS INTEGER) AS next_offset, CAST(25 AS INTEGER) AS previous_offset FROM documents WHERE lang = 'en'""",
)
def l01_info(spark, folder):
    return O.page_info(load(spark, folder, "documents").filter("lang = 'en'"), 25, 50)


@query(
    "l02_sorted_by_allowed_field",
    f"""SELECT entity_id, name FROM ({ENTITIES_SQL}) WHERE entity_type = 'person' ORDER BY encode(name) DESC, entity_id LIMIT 50""",
)
def l02(spark, folder):
    entities = stored(spark, folder)[0].filter(F.col("entity_type") == "person").select("entity_id", "name")
    return O.page(entities, O.sort_column("entity", "name"), "entity_id", "desc", 500, 0, 50)


@query("l04_items_by_priority", f"""SELECT part, batch_id, line, priority FROM ({ITEMS_SQL}) WHERE status = 'pending'""")
def l04(spark, folder):
    rows = batch_items(spark, folder).filter("status = 'pending'").select("part", "batch_id", "line", "priority")
    return O.by_priority(rows, "batch_id")


# ------------------------------------------------------------------ content and entities
@query(
    "j01_entities_of_content",
    f"SELECT entity_id, name, entity_type, relevance FROM ({STORED_SQL}) WHERE content_id = 14 GROUP BY ALL",
)
def j01(spark, folder):
    entities, links = stored(spark, folder, twice=True)
    return J.entities_of(links, entities, 14).select("entity_id", "name", "entity_type", "relevance")


@query(
    "j01_entities_with_mentions",
    f"""SELECT entity_id, name, type, count(*) AS n_mentions, list(relevance ORDER BY relevance DESC) AS relevances
        FROM (SELECT DISTINCT entity_id, name, entity_type AS type, relevance FROM ({STORED_SQL}) WHERE content_id = 14) GROUP BY 1, 2, 3""",
)
def j01_nested(spark, folder):
    entities, links = stored(spark, folder, twice=True)
    rows = J.entities_with_mentions(links, entities, 14)
    return rows.select("entity_id", "name", "type", F.size("mentions").cast("long").alias("n_mentions"), F.col("mentions.relevance").alias("relevances"))


@query(
    "j02_content_mentioning",
    f"""SELECT DISTINCT s.content_id, s.name, s.relevance, c.title FROM ({STORED_SQL}) s JOIN ({CONTENT_SQL}) c USING (content_id)
        WHERE contains(lower(s.name), 'smith') AND s.entity_type = 'person'""",
)
def j02(spark, folder):
    entities, links = stored(spark, folder, twice=True)
    rows = J.content_mentioning(content(spark, folder), links, entities, "Smith", "person")
    return rows.select("content_id", "name", "relevance", "title")


@query(
    "j03_l03_related_content",
    f"""WITH links AS (SELECT DISTINCT content_id, entity_id FROM ({STORED_SQL}))
SELECT l.content_id, count(*) AS matching_entities, c.source FROM links l JOIN ({CONTENT_SQL}) c USING (content_id)
WHERE l.entity_id IN (SELECT entity_id FROM links WHERE content_id = 14) AND l.content_id <> 14
GROUP BY l.content_id, c.source ORDER BY matching_entities DESC, content_id LIMIT 10""",
)
def j03(spark, folder):
    # Only the two ids are written, so contexts are neither made nor stored.
    links = cut_lineage(stored(spark, folder)[1].select("content_id", "entity_id"))
    return J.related_content(links, content(spark, folder).select("content_id", "source"), 14)


@query(
    "j04_search_entities",
    f"""WITH hits AS (SELECT entity_id, name, entity_type FROM ({ENTITIES_SQL}) WHERE contains(lower(name), 'an') AND entity_type IN ('person', 'location')
                      ORDER BY encode(name), entity_id LIMIT 5)
SELECT h.*, s.content_id, s.relevance FROM hits h LEFT JOIN (SELECT DISTINCT entity_id, content_id, relevance FROM ({STORED_SQL})) s USING (entity_id)""",
)
def j04(spark, folder):
    entities, links = stored(spark, folder, twice=True)
    mentions = links.select("entity_id", "content_id", "relevance")
    return J.search_entities(entities.select("entity_id", "name", "entity_type"), mentions, "an", ["person", "location"], 5)


@query(
    "j05_l05_get_entity",
    f"""SELECT DISTINCT name, entity_type, content_id, relevance FROM ({STORED_SQL}) WHERE name = 'Anna Berg' AND entity_type = 'person'""",
)
def j05(spark, folder):
    entities, links = stored(spark, folder, twice=True)
    rows = J.get_entity(entities, links, name="Anna Berg", entity_type="person")
    return rows.select("name", "entity_type", "content_id", "relevance")


@query(
    "j07_top_mentions",
    f"""SELECT s.content_id, s.name, s.entity_type, s.relevance FROM (SELECT DISTINCT content_id, name, entity_type, relevance FROM ({STORED_SQL})) s
        JOIN ({CONTENT_SQL}) c USING (content_id) WHERE s.entity_type = 'person' AND c.content_type = 'text/plain' AND s.relevance > 0.7
        ORDER BY s.relevance DESC, encode(s.name), s.content_id LIMIT 10""",
)
def j07(spark, folder):
    entities, links = stored(spark, folder, rules=rules_of("person"))
    return J.top_mentions(entities, links, "person", "text/plain", 0.7, 10)


@query(
    "j09_content_with_tag",
    f"""SELECT content_id, source FROM ({CONTENT_SQL}) WHERE content_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def j09(spark, folder):
    tags = load(spark, folder, "labels").select(F.col("quality").alias("tag_id")).distinct()
    tags = tags.withColumn("name", F.when(F.col("tag_id") == 1, "good").otherwise("poor"))
    marks = load(spark, folder, "labels").select(F.col("doc_id").alias("content_id"), F.col("quality").alias("tag_id"))
    return J.with_tag(content(spark, folder), marks, tags, "good").select("content_id", "source")


@query(
    "j11_key_lookup_join",
    """SELECT o_orderkey AS id, o_orderpriority AS content, l_returnflag || l_linestatus AS "key", l_quantity AS value
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag || l_linestatus = 'NO' ORDER BY id DESC, value LIMIT 20""",
)
def j11(spark, folder):
    data = load(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"))
    index = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("data_id"), F.concat("l_returnflag", "l_linestatus").alias("key"),
        F.col("l_quantity").alias("value"))
    return J.key_lookup_join(data, index, "NO", 20)


# ------------------------------------------------------------------ relations
# Entities: customers and nations.  Edges: customer to nation, order's customer to supplier nation.
GRAPH_ENTITIES = """SELECT 'c' || c_custkey AS entity_id, c_name AS name, 'customer' AS entity_type FROM customer WHERE c_custkey % 10 <> 3
 UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation"""
GRAPH_EDGES = """SELECT 'c' || c_custkey AS source_id, 'n' || c_nationkey AS target_id, 'lives_in' AS relationship_type, c_acctbal / 10000 AS strength FROM customer
 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'ordered', o_totalprice / 1000000 FROM orders WHERE o_orderstatus = 'P'"""


def graph(spark, folder):
    customer, nation = load(spark, folder, "customer"), load(spark, folder, "nation")
    orders = load(spark, folder, "orders").filter("o_orderstatus = 'P'")

    def key(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    entities = customer.filter("c_custkey % 10 <> 3").select(
        key("c", "c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.lit("customer").alias("entity_type"))
    entities = entities.unionByName(nation.select(
        key("n", "n_nationkey").alias("entity_id"), F.col("n_name").alias("name"), F.lit("nation").alias("entity_type")))
    edges = customer.select(
        key("c", "c_custkey").alias("source_id"), key("n", "c_nationkey").alias("target_id"),
        F.lit("lives_in").alias("relationship_type"), (F.col("c_acctbal") / 10000).alias("strength"))
    edges = edges.unionByName(orders.select(
        key("c", "o_custkey").alias("source_id"), key("o", "o_orderkey").alias("target_id"),
        F.lit("ordered").alias("relationship_type"), (F.col("o_totalprice") / 1000000).alias("strength")))
    return entities, edges


@query(
    "j06_related_entities",
    f"""WITH e AS ({GRAPH_ENTITIES}), g AS ({GRAPH_EDGES} UNION ALL SELECT 'n3', 'n4', 'next_to', 1.0)
SELECT e.entity_id, relationship_type, direction, e.name, e.entity_type FROM (
  SELECT target_id AS entity_id, relationship_type, 'outgoing' AS direction FROM g WHERE source_id = 'n3'
  UNION ALL SELECT source_id, relationship_type, 'incoming' FROM g WHERE target_id = 'n3' AND source_id <> 'n3') r JOIN e USING (entity_id)
ORDER BY direction, relationship_type, entity_id LIMIT 100""",
)
def j06(spark, folder):
    entities, edges = graph(spark, folder)
    extra = load(spark, folder, "nation").filter("n_nationkey = 3").select(
        F.lit("n3").alias("source_id"), F.lit("n4").alias("target_id"),
        F.lit("next_to").alias("relationship_type"), F.lit(1.0).alias("strength"))
    return J.related_entities(edges.unionByName(extra), entities, "n3", None, 500)


_END = "SELECT entity_id FROM e"


@query(
    "j08_valid_edges",
    f"WITH e AS ({GRAPH_ENTITIES}), g AS ({GRAPH_EDGES}) SELECT * FROM g WHERE source_id IN ({_END}) AND target_id IN ({_END})",
)
def j08_valid(spark, folder):
    entities, edges = graph(spark, folder)
    return J.check_edges(edges, entities)[0]


@query(
    "j08_rejected_edges",
    f"WITH e AS ({GRAPH_ENTITIES}), g AS ({GRAPH_EDGES}) SELECT * FROM g WHERE source_id NOT IN ({_END}) OR target_id NOT IN ({_END})",
)
def j08_rejected(spark, folder):
    entities, edges = graph(spark, folder)
    return J.check_edges(edges, entities)[1]
