"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node (a hot vector is one row). Vectors of different lengths have no distance, so each length is searched apart. The graph starts
from overlapping groups with exact neighbours inside a group: a cell of nodes that is larger than `GROUP` is split around a sample of its own nodes
(at most `PIVOTS`, cell by cell and chunk by chunk, so neither pivots nor nodes pass through the driver or one task), and each node joins its nearest
ones, until all cells are small. Each round then joins neighbours of neighbours: a node whose surroundings changed gathers its nearest
neighbours and reverse neighbours with their vectors, all pairs of that short list are measured, and a pair is sent on where it beats the
current K-th distance of one end. The best K per node stay. Rounds end when few edges change.

A query is a node: its pool starts with itself and its neighbours in the graph; the nearest unexpanded nodes of a pool are expanded through
the graph, all queries of a table at once, until the best `pool_size` nodes of each are expanded. A pool is one sorted array in the query's row; only
the nodes to expand are sent through joins. Scores are exact (double precision, original vectors).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from palisade.llm.common import save, shared_dir

NEIGHBOURS = 32  # K of the graph
GATHER = 64  # neighbours and reverse neighbours a node compares, nearest first; neighbours that a search sees of a node
GROUP, PIVOTS, CHUNK = 2000, 1024, 4000  # largest group; nodes a cell is split around at most; nodes of a cell in one task
COPIES, COPIES_BELOW, COPIES_BETWEEN = 6, 3, 2  # groups a node joins where one split is enough; in the last of several; in those before
SPLITS = 8  # after so many splits around nodes a cell that stays large (nodes all alike far) is cut by a hash
CHANGED = 0.001  # share of edges under which rounds end
POOL, FRONT = 240, 24  # nodes a search keeps, see `pool_size`; expands at once
POOL_NODES, POOL_POWER = 50_000, 0.3


def clean_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows that take part: not null, not empty, not zero, finite. One row per vec_id (smallest vector).

    Components stay floats where they are floats, all other numbers become doubles.
    """
    kind = "float" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "double"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    rows = rows.filter(F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def _matrix(column) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _squares(m: np.ndarray, other: np.ndarray) -> np.ndarray:
    middle = other.mean(0, dtype=np.float64)  # far from the origin the products would lose the small differences
    a, b = m - middle, other - middle
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def pool_size(nodes: int) -> int:
    """A search in a larger graph keeps some more nodes, or its recall would fall with the size."""
    return int(POOL * max(1.0, nodes / POOL_NODES) ** POOL_POWER)


def _closest(d: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n smallest values of every row, smallest first."""
    n = min(n, d.shape[1])
    near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(n), (len(d), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


def _to_pivots(copies: int):
    """One chunk of a cell and the pivots of the cell -> (node, vec, pivot) for the nearest pivots of every node."""

    def run(nodes: pa.Table, pivots: pa.Table) -> pa.Table:
        pivots = pivots.sort_by("pivot")
        if not nodes.num_rows or not pivots.num_rows:  # without pivots (of a sample by chance): an arbitrary half
            half = pa.array(nodes.column("node").to_numpy() % 2, pa.int64())
            return pa.table({"node": nodes.column("node"), "vec": nodes.column("vec"), "pivot": half})
        best = _closest(_squares(_matrix(nodes.column("vec")), _matrix(pivots.column("vec"))), copies)
        rows = pa.array(np.repeat(np.arange(len(best)), best.shape[1]))
        at = pivots.column("pivot").to_numpy()[best.ravel()]
        return pa.table({"node": nodes.column("node").take(rows), "vec": nodes.column("vec").take(rows), "pivot": pa.array(at, pa.int64())})

    return run


def _edges(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> pa.Table:
    return pa.table({"src": src.astype(np.int64), "dst": dst.astype(np.int64), "dist": dist.astype(np.float64)})


def _group_edges(k: int):
    """Edges of a group to the k nearest others in it, in blocks of rows."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        ids, m = table.column("node").to_numpy()[order], _matrix(table.column("vec"))[order]
        none = np.zeros(0)
        out = [_edges(none, none, none)]
        for lo in range(0, len(ids) if len(ids) > 1 else 0, 1000):
            d = np.sqrt(_squares(m[lo : lo + 1000], m))
            d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
            near = _closest(d, min(k, len(ids) - 1))
            out.append(_edges(np.repeat(ids[lo : lo + 1000], near.shape[1]), ids[near.ravel()], np.take_along_axis(d, near, 1).ravel()))
        return pa.concat_tables(out)

    return run


def _local_join(k: int):
    """Per node: its gathered list (ids, radii, fresh, vectors) -> better edges between members of the list, unless both were here before."""

    def run(batches):
        for batch in batches:
            out = []
            lists = batch.column(0)
            bounds = lists.offsets.to_numpy()
            items = lists.values
            ids, radius, fresh = (items.field(x).to_numpy(zero_copy_only=False) for x in ("id", "radius", "fresh"))
            starts, flat = items.field("vec").offsets.to_numpy(), items.field("vec").values.to_numpy(zero_copy_only=False)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo < 2:
                    continue
                m = flat[starts[lo] : starts[hi]].reshape(hi - lo, -1)
                d = np.sqrt(_squares(m, m))
                np.fill_diagonal(d, np.inf)
                kth = np.partition(d, min(k, hi - lo) - 1, axis=1)[:, min(k, hi - lo) - 1]
                now = fresh[lo:hi, None] | fresh[None, lo:hi]
                a, b = np.nonzero((d < radius[lo:hi, None]) & (d <= kth[:, None]) & now)
                out.append(_edges(ids[lo:hi][a], ids[lo:hi][b], d[a, b]))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


_EDGE = "src long, dst long, dist double"


def both_ways(graph: DataFrame) -> DataFrame:
    both = graph.select(F.col("src").alias("node"), F.col("dst").alias("other"), "dist", "fresh").union(graph.select("dst", "src", "dist", "fresh"))
    return both.groupBy("node", "other").agg(F.min("dist").alias("dist"), F.max("fresh").alias("fresh"))  # the ends of an edge may know it with other last digits


def starting_groups(nodes: DataFrame, folder: str, group: int = GROUP) -> DataFrame:
    """(length, cell, node, vec): overlapping groups of at most `group` nodes of one length."""
    vec = nodes.schema["vec"].dataType.simpleString()
    members = nodes.select(F.size("vec").alias("length"), F.lit(0).cast("long").alias("cell"), "node", "vec")
    done, step = [], 0
    while True:
        sizes = save(members.groupBy("length", "cell").agg(F.count("*").alias("n")), folder, f"cells-{step}")
        sized = members.join(sizes, ["length", "cell"])
        done.append(sized.filter(F.col("n") <= group).select("length", "cell", "node", "vec"))
        if sizes.filter(F.col("n") > group).isEmpty():
            break
        last = F.col("n") <= group * PIVOTS // (2 * COPIES)
        copies = F.when(~last, COPIES_BETWEEN).otherwise(COPIES if step == 0 else COPIES_BELOW)
        large = sized.filter(F.col("n") > group).withColumns({"copies": copies, "chunks": F.ceil(F.col("n") / CHUNK)})
        large = large.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
        if step >= SPLITS:
            parts = F.ceil(F.col("n") * 2 / group)
            after = large.select("length", F.xxhash64("cell", F.pmod(F.xxhash64("node", "cell"), parts)).alias("cell"), "node", "vec")
        else:
            sampled = F.xxhash64("node", F.lit(step)).cast("double") / 2.0**64 + 0.5 < F.least(F.lit(PIVOTS), 2 * F.col("copies") * F.col("n") / group) / F.col("n")
            pivots = save(large.filter(sampled).select("length", "cell", "chunks", F.col("node").alias("pivot"), "vec"), folder, f"pivots-{step}")
            at_chunks = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            parts = []
            for n in sorted({COPIES_BETWEEN, COPIES if step == 0 else COPIES_BELOW}):
                left = large.filter(F.col("copies") == n).groupBy("length", "cell", "chunk")
                schema = f"length int, cell long, node long, vec {vec}, pivot long"
                split = _keyed(_to_pivots(n))
                parts.append(left.cogroup(at_chunks.groupBy("length", "cell", "chunk")).applyInArrow(split, schema))
            after = parts[0].unionByName(parts[1]).select("length", F.xxhash64("cell", "pivot").alias("cell"), "node", "vec")
        step += 1
        members = save(after, folder, f"members-{step}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _keyed(split):
    def run(key, nodes: pa.Table, pivots: pa.Table) -> pa.Table:
        length, cell, _ = (k.as_py() for k in key)
        out = split(nodes, pivots)
        n = out.num_rows
        return pa.table({"length": pa.array([length] * n, pa.int32()), "cell": pa.array([cell] * n, pa.int64()), "node": out["node"], "vec": out["vec"], "pivot": out["pivot"]})

    return run


def build_graph(nodes: DataFrame, folder: str, k: int = NEIGHBOURS) -> DataFrame:
    """(src, dst, dist, fresh) with the k nearest found of every node, from `nodes` (node, vec), distinct vectors."""
    groups = starting_groups(nodes, folder)
    first = groups.groupBy("length", "cell").applyInArrow(_group_edges(k), _EDGE).groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    graph = save(nearest(first, "src", k, "dist", "dst").withColumn("fresh", F.lit(True)), folder, "graph-0")
    step = 0
    while True:  # ends: a node's list only gets nearer
        step += 1
        radius = graph.groupBy("src").agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(float("inf")).alias("radius"))
        known = nodes.join(radius, nodes.node == radius.src, "left").select(F.col("node").alias("other"), F.coalesce("radius", F.lit(float("inf"))).alias("radius"), "vec")
        around = nearest(both_ways(graph), "node", GATHER, "dist", "other").select("node", "other", "fresh")
        item = F.struct(F.col("other").alias("id"), "radius", "fresh", "vec")
        lists = around.join(known, "other").groupBy("node").agg(F.collect_list(item).alias("items")).filter(F.exists("items", lambda x: x["fresh"])).select("items")
        better = lists.mapInArrow(_local_join(k), _EDGE).distinct()
        merged = graph.select("src", "dst", "dist", F.lit(False).alias("fresh")).unionByName(better.withColumn("fresh", F.lit(True)))
        merged = merged.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
        graph = save(nearest(merged, "src", k, "dist", "dst"), folder, f"graph-{step}")
        counts = graph.agg(F.count("*").alias("n"), F.count_if("fresh").alias("new")).first()
        if counts["new"] <= CHANGED * counts["n"]:
            return graph


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, folder: str, pool: int = POOL) -> DataFrame:
    """(q, node, dist): the best `pool` nodes a greedy graph search finds for each of `queries` (q, qvec), where q is a node of the graph."""
    adjacent = save(nearest(both_ways(graph), "node", GATHER, "dist", "other").groupBy("node").agg(F.collect_list("other").alias("others")), folder, "adjacent")

    def entry(dist: Column, node: Column, done: bool) -> Column:
        return F.struct(dist.alias("dist"), node.alias("node"), F.lit(done).alias("done"))

    def measured(pairs: DataFrame) -> DataFrame:
        """(q, found) from (q, qvec, node): nearest first, with exact distances."""
        rows = pairs.join(nodes, "node").select("q", entry(distance(F.col("qvec"), F.col("vec")), F.col("node"), False).alias("x"))
        return rows.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("x")), 1, pool).alias("found"))

    known = measured(queries.join(graph.select(F.col("src").alias("q"), F.col("dst").alias("node")), "q").select("q", "qvec", "node"))
    start = F.concat(F.array(entry(F.lit(0.0), F.col("q"), False)), F.coalesce("found", F.array()))
    state = save(queries.join(known, "q", "left").select("q", "qvec", F.slice(start, 1, pool).alias("pool")), folder, "pool-0")
    hop = 0
    while True:  # ends: a node is expanded once, and a pool only gets nearer
        hop += 1
        todo = state.select("q", F.slice(F.transform(F.filter("pool", lambda x: ~x["done"]), lambda x: x["node"]), 1, FRONT).alias("front")).filter(F.size("front") > 0)
        front = todo.select("q", F.explode("front").alias("node"))
        reached = front.join(adjacent, "node").groupBy("q").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("reached"))
        fresh = measured(state.join(reached, "q").select("q", "qvec", F.explode(F.array_except("reached", F.transform("pool", lambda x: x["node"]))).alias("node")))
        marked = F.transform("pool", lambda x: F.struct(x["dist"].alias("dist"), x["node"].alias("node"), (x["done"] | F.array_contains(F.coalesce("front", F.array().cast("array<bigint>")), x["node"])).alias("done")))
        after = state.join(todo, "q", "left").join(fresh, "q", "left").select("q", "qvec", F.slice(F.sort_array(F.concat(marked, F.coalesce("found", F.array()))), 1, pool).alias("pool"))
        state = save(after, folder, f"pool-{hop}")
        if state.filter(F.exists("pool", lambda x: ~x["done"])).isEmpty():
            return state.select("q", F.explode("pool").alias("x")).select("q", "x.node", "x.dist")


def nearest_neighbours(rows: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `rows` (vec_id, embedding) that meets `is_query` its k nearest other rows found.

    Nearest first, ties to the smaller vec_id. See `clean_vectors` for rows that take no part. Only vectors of the query's length are candidates. Fewer
    than k others: all of them. Empty table: no rows.
    """
    folder = shared_dir(rows.sparkSession)
    rows = save(clean_vectors(rows), folder, "rows")
    classes = rows.groupBy("embedding").agg(F.min("vec_id").alias("node"))
    nodes = save(classes.select("node", F.col("embedding").alias("vec")), folder, "nodes")
    members = save(rows.join(classes, "embedding").select("vec_id", "node"), folder, "members")
    graph = build_graph(nodes, folder, max(NEIGHBOURS, k))
    asked = members.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
    queries = asked.select("q").distinct().join(nodes.select(F.col("node").alias("q"), F.col("vec").alias("qvec")), "q")
    found = search(save(queries, folder, "queries"), nodes, graph, folder, max(pool_size(nodes.count()), k + 1))
    first = nearest(members, "node", k + 1, "vec_id")  # of equal vectors only the k + 1 smallest ids can be answers
    answers = asked.join(found, "q").join(first, "node").filter("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("dist").alias("score"))
