"""Embedding near-dedup by NN-descent.

1. Vectors that are equal are one node.  Blocks of at most about ``BLOCK`` nodes with equal signs under random
   hyperplanes, ``TABLES`` times over, give each node a first list of its ``LIST`` nearest nodes.
2. Rounds refine the lists: a node's neighbours and the nodes that have it as neighbour are compared with each other,
   and each keeps its nearest.  Rounds end when no further node gets a threshold neighbour and lists hardly improve.
3. A list full of threshold neighbours may hide more.  So passes with new tables and one round each follow, whose lists
   hold the ``LIST`` nearest nodes of other components; links they find join components, and their nodes are in the way no
   longer.  Passes end when one finds no link between components.
4. Within a threshold component all pairs are compared.  Nodes within half the threshold angle of the component's pivot are linked with each other
   by the triangle inequality, so a group of near copies costs one comparison each; only the other nodes meet all
   nodes of the component, tile by tile.
5. An audit compares ``AUDIT`` nodes with all nodes, other ones each time.  Its recall is the mean over nodes with links
   and knows nothing of links that audits found; those join the graph at the end.  While it is below ``RECALL`` twice as
   many tables and further passes follow.

Links have a cosine in double precision of at least the threshold.  Null, zero and non-finite vectors, and those with
null components, link with nothing; vectors of different length never link.  Repeated rows are vectors of their own; a
null id has its links but names no component.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as count_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.graph import components
from docloom.llm.shared import shared_table

THRESHOLD, LIST, TABLES, BLOCK, TILE = 0.9, 8, 10, 128, 512
AUDIT, RECALL = 512, 0.99
#: Rounds go on while the sum of the lists' similarities grows by more.
GAIN = 1.02
#: Links so near to the threshold depend on rounding; they count, but not against the recall.
SLACK = 1e-9
_EDGES = "src long, dst long, sim double"
_NAMES = ["src", "dst", "sim"]


def unit(blobs: list[bytes]) -> np.ndarray:
    """Unit vectors of one length from their bytes."""
    x = np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that very large and very small ones have a norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _edges(src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float64())], names=_NAMES)


def vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec) of every row, with the vector's bytes as doubles; null where it can't link."""
    kind = table.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                values = x.values.to_numpy(zero_copy_only=False).astype(float) if x.is_valid and not x.values.null_count else np.zeros(0)
                out.append((values + 0.0).astype("<f8").tobytes() if np.isfinite(values).all() and values.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    return table.select(F.col(id_column).alias("id"), vector_column).mapInArrow(run, f"id {kind}, vec binary")


def _codes(bits: int, tables: int, seed: int):
    """Signs of each node under the random hyperplanes of each table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            nodes, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                plane = planes.setdefault(int(size), np.random.default_rng([seed, int(size)]).normal(size=(int(size), tables * bits)))
                signs = (unit([blobs[i] for i in own]) @ plane > 0).reshape(len(own), tables, bits)
                codes = signs @ (1 << np.arange(bits, dtype=np.int64)) + (size << 40)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(nodes[own], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(codes.ravel())],
                    names=["node", "t", "code"])

    return run


def _nearest(nodes: np.ndarray, labels: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's nearest ones of other labels among the given."""
    sims = x @ x.T
    sims[labels[:, None] == labels[None, :]] = -2.0
    most = min(most, len(nodes) - 1)
    pick = np.argpartition(-sims, most - 1, axis=1)[:, :most] if most > 0 else np.zeros((len(nodes), 0), dtype=np.int64)
    near = np.take_along_axis(sims, pick, axis=1).ravel()
    other = near > -1.5
    return np.repeat(nodes, max(most, 0))[other], nodes[pick].ravel()[other], near[other]


def _block(block: pa.Table) -> pa.Table:
    nodes, labels = block.column("node").to_numpy(), block.column("label").to_numpy()
    return pa.Table.from_batches([_edges(*_nearest(nodes, labels, unit(block.column("vec").to_pylist()), LIST))])


def first_lists(nodes: DataFrame, count: int, tables: int, seed: int) -> DataFrame:
    """Edges among nodes of equal signs and different labels; blocks that are too large are cut by a hash of the node."""
    bits = max(1, int(np.ceil(np.log2(max(2, count / (BLOCK / 2))))))
    codes = nodes.select("node", "vec").mapInArrow(_codes(min(bits, 32), tables, seed), "node long, t int, code long")
    large = codes.groupBy("t", "code").count().where(F.col("count") > BLOCK)
    placed = codes.join(large, ["t", "code"], "left").withColumn("part", F.expr(f"pmod(xxhash64(node, t), coalesce(ceil(count / {BLOCK}), 1))"))
    return placed.join(nodes.select("node", "label", "vec"), "node").groupBy("t", "code", "part").applyInArrow(_block, _EDGES)


def best(edges: DataFrame) -> DataFrame:
    """The ``LIST`` nearest of each node."""
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.groupBy("src", "dst").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LIST).drop("rank")


def _meet(group: pa.Table) -> pa.Table:
    """Compare the members around each pivot with each other."""
    pivots, members, labels = (group.column(n).to_numpy() for n in ("pivot", "member", "label"))
    x, order = unit(group.column("vec").to_pylist()), np.argsort(pivots, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(pivots[order])) + 1, [len(order)]])
    found = [_nearest(members[order[a:b]], labels[order[a:b]], x[order[a:b]], 3) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
    if not found:
        return pa.Table.from_batches([_edges(*([],) * 3)])
    src, dst, sim = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = np.unique(np.stack([src, dst]), axis=1, return_index=True)[1]
    return pa.Table.from_batches([_edges(src[keep], dst[keep], sim[keep])])


def refine(edges: DataFrame, nodes: DataFrame, count: int, turn: int, near: DataFrame | None = None) -> DataFrame:
    """One round: neighbours of neighbours, over a node's list, as many of those that list it, and its list in ``near``."""
    order = Window.partitionBy("dst").orderBy(F.xxhash64("src", F.lit(turn)))
    back = edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LIST)
    around = (
        edges.selectExpr("src AS pivot", "dst AS member").unionByName(back.selectExpr("dst AS pivot", "src AS member"))
        .unionByName(edges.selectExpr("src AS pivot", "src AS member"))
    )
    if near is not None:
        around = around.unionByName(near.selectExpr("src AS pivot", "dst AS member"))
    groups = count // 64 + 1
    met = (
        around.distinct().join(nodes.selectExpr("node AS member", "label", "vec"), "member").withColumn("bucket", F.pmod(F.xxhash64("pivot"), F.lit(groups)))
        .groupBy("bucket").applyInArrow(_meet, _EDGES)
    )
    return best(edges.unionByName(met))


def search(nodes: DataFrame, count: int, tables: int, seed: int, threshold: float, near: DataFrame | None = None,
           rounds: int | None = None) -> DataFrame:
    """Lists of the nearest nodes of other labels, from new tables and rounds, at most ``rounds`` of these where given."""
    edges = shared_table(best(first_lists(nodes, count, tables, seed)), "lists")
    state, before = (F.count_distinct(F.when(F.col("sim") >= threshold, F.col("src"))), F.sum(F.col("sim") + 1)), (-1, 0.0)
    for turn in count_from(1):
        if rounds is not None and turn > rounds:
            return edges
        now, gain = edges.agg(*state).first()
        if not gain or (now <= before[0] and gain <= before[1] * GAIN):
            return edges
        before, seed = (now, gain), seed + 1
        edges = shared_table(refine(edges, nodes, count, seed, near), "lists")


def audit(nodes: DataFrame, groups: DataFrame, threshold: float, turn: int) -> tuple[float, DataFrame]:
    """Mean recall over the nodes with links in a bounded sample, another one each turn, and those links that lie between components."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(5 + turn))).limit(AUDIT).select("node", "vec").collect()
    held = nodes.sparkSession.sparkContext.broadcast([(r.node, bytes(r.vec)) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, tuple] = {}
        for size in {len(b) for _, b in held.value}:
            own = [(n, b) for n, b in held.value if len(b) == size]
            by_size[size] = (np.array([n for n, _ in own]), unit([b for _, b in own]))
        for batch in batches:
            ids, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for size, (query, x) in by_size.items():
                own = np.array([i for i, b in enumerate(blobs) if len(b) == size], dtype=np.int64)
                for at in range(0, len(own), 2048):
                    part = own[at:at + 2048]
                    sims = x @ unit([blobs[i] for i in part]).T
                    q, k = np.nonzero(sims >= threshold)
                    keep = query[q] != ids[part[k]]
                    yield _edges(query[q][keep], ids[part[k]][keep], sims[q, k][keep])

    true = shared_table(nodes.select("node", "vec").mapInArrow(run, _EDGES), "audit")
    left = groups.selectExpr("node AS src", "component AS a")
    right = groups.selectExpr("node AS dst", "component AS b")
    judged = true.join(left, "src", "left").join(right, "dst", "left").withColumn("found", F.expr("coalesce(a = b, false)"))
    by_node = judged.where(F.col("sim") >= threshold + SLACK).groupBy("src").agg(F.avg(F.col("found").cast("int")).alias("share"))
    recall = by_node.agg(F.avg("share")).first()[0]
    return (1.0 if recall is None else recall), judged.where("NOT found").select(*_NAMES)


def _core(cosine: float):
    """Which nodes are so near to their component's pivot that they are linked with all other such nodes."""
    half = np.arccos(cosine) / 2 - 1e-7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, p = (unit(batch.column(n).to_pylist()) for n in ("vec", "pivot"))
                near = np.arccos(np.clip((x * p).sum(axis=1), -1.0, 1.0)) <= half
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("component", "node", "vec", "copies")), pa.array(near)],
                                                 names=["component", "node", "vec", "copies", "core"])

    return run


def _tile(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        nodes, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        core, x = group.column("core").to_numpy(zero_copy_only=False), unit(group.column("vec").to_pylist())
        q, t = np.flatnonzero(asks), np.flatnonzero(~asks)
        linked = (x[q] @ x[t].T >= threshold) & (nodes[q][:, None] != nodes[t][None, :])
        counted = np.concatenate([linked @ copies[t], (copies[q] @ linked)[core[t]]]).astype(np.int64)
        owner = np.concatenate([nodes[q], nodes[t][core[t]]])
        return pa.table({"node": pa.array(owner, pa.int64()), "links": pa.array(counted, pa.int64())})

    return run


def link_counts(groups: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, links): rows that each node of a component is linked with, copies of its own vector left out."""
    held = groups.join(nodes.select("node", "vec", "copies"), "node")
    pivot = held.groupBy("component").agg(F.min_by("vec", "node").alias("pivot"))
    held = shared_table(
        held.join(pivot, "component").select("component", "node", "vec", "copies", "pivot")
        .mapInArrow(_core(threshold), "component long, node long, vec binary, copies long, core boolean"), "cores"
    )
    size = held.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("inner"), F.ceil(F.sum(F.when(F.col("core"), 0).otherwise(1)) / TILE).cast("int").alias("asking"),
        F.ceil(F.count("*") / TILE).cast("int").alias("answering"),
    )
    sized = held.join(size, "component")
    inner = sized.select("node", F.when(F.col("core"), F.col("inner") - F.col("copies")).otherwise(0).alias("links"))
    open_ones = sized.where("asking > 0")
    tile = "int(pmod(xxhash64(node, {}), {}))"
    asks = open_ones.where("NOT core").withColumn("q", F.expr(tile.format(1, "asking"))).withColumn("t", F.explode(F.expr("sequence(0, answering - 1)"))).withColumn("asks", F.lit(True))
    answers = open_ones.withColumn("t", F.expr(tile.format(2, "answering"))).withColumn("q", F.explode(F.expr("sequence(0, asking - 1)"))).withColumn("asks", F.lit(False))
    columns = ["component", "q", "t", "asks", "node", "vec", "copies", "core"]
    outer = asks.select(*columns).unionByName(answers.select(*columns)).groupBy("component", "q", "t").applyInArrow(_tile(threshold), "node long, links long")
    return inner.unionByName(outer).groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                 threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    rows = shared_table(vectors(table, id_column, vector_column), "vectors")
    nodes = shared_table(
        rows.where("vec IS NOT NULL").groupBy("vec").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
        .withColumn("node", F.xxhash64("vec")), "nodes"
    )
    count, tables, seed = nodes.count(), TABLES, 0
    placed = nodes.withColumn("label", F.col("node"))
    near = search(placed, count, tables, seed, threshold)
    close, extra, turn = near.where(F.col("sim") >= threshold), None, 0
    while True:
        while True:
            groups = shared_table(components(close, "src", "dst"), "components")
            placed = nodes.join(groups, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
            seed += 1000
            across = search(placed, count, tables, seed, threshold, near, rounds=1).where(F.col("sim") >= threshold)
            if across.isEmpty():
                break
            close = close.unionByName(across)
        recall, missed = audit(nodes, groups, threshold, turn)
        extra = missed if extra is None else extra.unionByName(missed)
        if recall >= RECALL or count <= AUDIT:  # of so few nodes the audit has found all links
            break
        turn, tables = turn + 1, 2 * tables
    groups = shared_table(components(close.unionByName(extra), "src", "dst"), "components")
    links = link_counts(groups, nodes, threshold)
    named = groups.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    by_node = (
        nodes.join(groups, "node", "left").join(named, "component", "left").join(links, "node", "left")
        .select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    )
    return rows.join(by_node, "vec", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
