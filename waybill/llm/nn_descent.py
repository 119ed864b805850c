"""Embedding near-dedup by NN-descent: refine a neighbour graph, keep the edges at the threshold.

1. Equal vectors become one node with a number of copies.
2. A forest of random hyperplanes deals the nodes into blocks; within a block (read in chunks, so a block of any size
   fits) each node takes its nearest as a first list.
3. NN-descent: the neighbours of a node, in both directions, are compared with each other; what is nearer than the last
   of a list enters it. Only pairs with an entry that is new since the last round are compared. Rounds end when few
   entries change. Lists that are full of edges at the threshold are saturated: they are enlarged to twice their length,
   their entries count as new, and the rounds go on, until no list is saturated or the largest length is reached.
4. Edges at the threshold make components, whose members are all compared, chunk against chunk: that gives exact numbers
   of links, without a row for each pair. What a list of the largest length still hides is looked for by restarts that
   keep no lists: new trees deal all nodes, and all links of a chunk between components count (a spanning forest of them
   is kept).
5. Recall is audited: a stated number of nodes, drawn anew each time, is compared with all vectors by brute force. The
   audit only measures. While it sees a missed link, more trees follow; if the mean recall of the asked nodes is still
   below the bound after the last of them, all vectors are compared, block against block.

Cosines are taken in double precision. Defined results: a vector that is null, empty or zero, or has a null or
non-finite component, links with nothing; vectors of different lengths don't link; repeated rows count as copies; a null
vec_id takes part, and components carry their smallest vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import Scratch, connected_components, table

LEAF, CHUNK, LOCAL, BLOCK = 64, 512, 96, 2048
#: Length to which saturated lists grow.
LONGEST = 32
log = logging.getLogger(__name__)
#: Nodes that are compared with all vectors to measure recall.
AUDIT = 1000


def nodes_of(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows (vec_id, vec or null) and nodes (node, vec, dim, copies, vec_id: the smallest)."""
    wide = "double" in dict(vectors.dtypes)["embedding"]
    kind = np.dtype("<f8" if wide else "<f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                v = None
                if x.is_valid and len(x) and not x.values.null_count:
                    v = np.asarray(x.values).astype(np.float64)
                    n = np.square(v).sum()
                    v = v.astype(kind).tobytes() if np.isfinite(v).all() and np.isfinite(n) and n > 0 else None
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    id_type = dict(vectors.dtypes)["vec_id"]
    rows = scratch.put(vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {id_type}, vec binary"))
    nodes = rows.where("vec is not null").groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id"))
    return rows, scratch.put(nodes.select(F.monotonically_increasing_id().alias("node"), "vec", (F.length("vec") / kind.itemsize).cast("int").alias("dim"), "copies", "vec_id"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision, one row each."""
    raw = column.to_pylist() if isinstance(column, pa.Array) else column
    x = np.frombuffer(b"".join(raw), "<f4" if len(raw[0]) == 4 * dim else "<f8").reshape(len(raw), dim).astype(np.float64)
    return x / np.sqrt(np.square(x).sum(1))[:, None]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal values in the first ``keys`` columns, from rows sorted by them, at most CHUNK at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        n = t.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for i in range(keys):
            k = t.column(i).to_numpy()
            change[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            for c in range(a, b, CHUNK):
                yield t.slice(c, min(CHUNK, b - c))
        a = starts[-1]
        while n - a > CHUNK:
            yield t.slice(a, CHUNK)
            a += CHUNK
        rest = t.slice(a)
    if rest is not None and rest.num_rows:
        yield rest


_EDGES = "node bigint, other bigint, sim double"


def _edges(a: list, b: list, s: list) -> pa.RecordBatch:
    cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
    return pa.RecordBatch.from_arrays([cat(a, pa.int64()), cat(b, pa.int64()), cat(s, pa.float64())], ["node", "other", "sim"])


def _spanning(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of links that connect all that the symmetric matrix ``close`` connects: fewer than it has rows."""
    a, b, left = [], [], np.ones(len(close), bool)
    for start in np.flatnonzero(close.any(1)).tolist():
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            i = todo.pop()
            near = np.flatnonzero(close[i] & left).tolist()
            left[near] = False
            a += [i] * len(near)
            b += near
            todo += near
    return np.array(a, np.int64), np.array(b, np.int64)


def _dealt(nodes: DataFrame, depth: int, seeds: range) -> DataFrame:
    """Nodes (node, root, dim, vec) in the blocks (tree, code) of each tree, sorted along one more plane."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims):
                part = t.filter(pa.array(dims == d)).combine_chunks()
                x = _matrix(part.column("vec").to_pylist(), int(d))
                for s in seeds:
                    planes = np.random.default_rng(1000 + s).normal(size=(int(d), depth + 1))
                    p = x @ planes
                    code = (p[:, :depth] > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(x), np.int64)
                    n = len(x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, s * 4096 + int(d))), pa.array(code.astype(np.int64)), pa.array(p[:, depth]), *(part.column(c).combine_chunks() if isinstance(part.column(c), pa.ChunkedArray) else part.column(c) for c in ("node", "root", "dim", "vec"))],
                        ["tree", "code", "along", "node", "root", "dim", "vec"],
                    )

    dealt = nodes.select("node", "root", "dim", "vec").mapInArrow(deal, "tree bigint, code bigint, along double, node bigint, root bigint, dim int, vec binary")
    # by ranges of the sort order, so that a block of any size is spread over tasks
    return dealt.repartitionByRange("tree", "code", "along").sortWithinPartitions("tree", "code", "along")


def forest(nodes: DataFrame, depth: int, seeds: range, k: int) -> DataFrame:
    """First lists (node, other, sim): the k nearest of each node in its block of each tree."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, s, held = [], [], [], 0
        for g in _groups(batches, 2):
            m = g.num_rows
            if m < 2:
                continue
            x = _matrix(g.column("vec").to_pylist(), g.column("dim")[0].as_py())
            ids = g.column("node").to_numpy()
            sim = x @ x.T
            np.fill_diagonal(sim, -2.0)
            kk = min(k, m - 1)
            top = np.argpartition(-sim, kk - 1, axis=1)[:, :kk]
            val = np.take_along_axis(sim, top, 1)
            i, j = np.nonzero(val > -2.0)
            a.append(ids[i]), b.append(ids[top[i, j]]), s.append(val[i, j])
            held += len(i)
            if held > 200_000:
                yield _edges(a, b, s)
                a, b, s, held = [], [], [], 0
        yield _edges(a, b, s)

    found = _dealt(nodes.withColumn("root", F.col("node")), depth, seeds).mapInArrow(pick, _EDGES)
    return found.groupBy("node", "other").agg(F.max("sim").alias("sim"))


def crossings(rooted: DataFrame, depth: int, seeds: range, threshold: float) -> DataFrame:
    """Links (node, other, sim) between components that connect what all such links within a chunk connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 2):
            roots = g.column("root").to_numpy()
            if (roots == roots[0]).all():
                continue
            x = _matrix(g.column("vec").to_pylist(), g.column("dim")[0].as_py())
            sim = x @ x.T
            i, j = _spanning((sim >= threshold) & (roots[:, None] != roots[None, :]))
            ids = g.column("node").to_numpy()
            if len(i):
                yield _edges([ids[i]], [ids[j]], [sim[i, j]])

    return _dealt(rooted, depth, seeds).mapInArrow(run, _EDGES)


def all_crossings(rooted: DataFrame, threshold: float) -> DataFrame:
    """As crossings, but of all nodes: every two blocks of one length of vectors meet in one place. Costs n * n products."""
    sizes = rooted.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = rooted.join(F.broadcast(sizes), "dim").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meet = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = meet.select("dim", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "node", "root", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole_groups(batches, 3):
            x = _matrix(g.column("vec").to_pylist(), g.column("dim")[0].as_py())
            ids, roots, high = g.column("node").to_numpy(), g.column("root").to_numpy(), g.column("block").to_numpy() == g.column("hi")[0].as_py()
            lows = high if g.column("lo")[0].as_py() == g.column("hi")[0].as_py() else ~high
            lows, highs = np.flatnonzero(lows), np.flatnonzero(high)
            close = np.zeros((len(ids), len(ids)), bool)
            near = ((x[lows] @ x[highs].T) >= threshold) & (roots[lows][:, None] != roots[highs][None, :])
            close[np.ix_(lows, highs)] = near
            close[np.ix_(highs, lows)] |= near.T
            i, j = _spanning(close)
            if len(i):
                yield _edges([ids[i]], [ids[j]], [(x[i] * x[j]).sum(1)])

    return dealt.repartition("dim", "lo", "hi").sortWithinPartitions("dim", "lo", "hi").mapInArrow(run, _EDGES)


def nearest(edges: DataFrame) -> DataFrame:
    """The k nearest of each node, k being a column that is equal within a node."""
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    return edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("k")).drop("place")


def enlarge(graph: DataFrame, threshold: float) -> DataFrame:
    """The graph with saturated lists twice as long, and what is in them new again."""
    full = graph.groupBy("node").agg(F.count_if(F.col("sim") >= threshold).alias("close"), F.max("k").alias("k")).where((F.col("close") >= F.col("k")) & (F.col("k") < LONGEST)).select("node", F.lit(True).alias("full"))
    full = graph.join(full, "node", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    return full.withColumn("k", F.when(F.col("full"), F.col("k") * 2).otherwise(F.col("k"))).withColumn("fresh", F.col("fresh") | F.col("full")).drop("full")


def descend(nodes: DataFrame, graph: DataFrame, k: int, scratch: Scratch, turn: int = 0, threshold: float = -1.0) -> DataFrame:
    """One round: neighbours of a node, both ways, meet; graph is (node, other, sim, fresh, k). Neighbourhoods of more than
    LOCAL are cut into other groups each ``turn``. Into a list that was enlarged beyond ``k`` only edges at the threshold
    come: its first places are full of nearer ones."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, s, held = [], [], [], 0
        for g in _groups(batches, 1):
            for c in range(0, g.num_rows, LOCAL):
                t = g.slice(c, LOCAL)
                if t.num_rows < 2:
                    continue
                dims = t.column("dim").to_numpy()
                if not t.column("fresh").to_numpy().any() or (dims != dims[0]).any():
                    continue
                x = _matrix(t.column("vec").to_pylist(), int(dims[0]))
                ids, floor, fresh = t.column("other").to_numpy(), t.column("floor").to_numpy(), t.column("fresh").to_numpy()
                sim = x @ x.T
                np.fill_diagonal(sim, -2.0)
                i, j = np.nonzero((sim > floor[:, None]) & (fresh[:, None] | fresh[None, :]))
                a.append(ids[i]), b.append(ids[j]), s.append(sim[i, j])
                held += len(i)
            if held > 200_000:
                yield _edges(a, b, s)
                a, b, s, held = [], [], [], 0
        yield _edges(a, b, s)

    lists = graph.groupBy("node").agg(F.max("k").alias("k"), F.when(F.count("*") >= F.max("k"), F.min("sim")).when(F.max("k") > k, F.lit(threshold)).otherwise(F.lit(-1.0)).alias("floor"))
    both = graph.select("node", "other", "fresh").unionByName(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh"))
    met = both.groupBy("node", "other").agg(F.max("fresh").alias("fresh")).withColumnRenamed("node", "by")
    # a hub's neighbourhood goes to as many tasks as it has chunks
    hubs = met.groupBy("by").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")).where("parts > 1")
    full = met.join(nodes.select(F.col("node").alias("other"), "dim", "vec"), "other").join(lists.select(F.col("node").alias("other"), "floor"), "other", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))
    full = full.join(hubs, "by", "left").withColumn("order", F.xxhash64("by", "other", F.lit(turn))).withColumn("part", F.pmod("order", F.coalesce("parts", F.lit(1))))
    dealt = full.select("by", "other", "fresh", "floor", "dim", "vec", "part", "order").repartition("by", "part").sortWithinPartitions("by", "part", "order")
    new = dealt.mapInArrow(meet, _EDGES).groupBy("node", "other").agg(F.max("sim").alias("sim"))
    merged = graph.select("node", "other", "sim", F.lit(False).alias("fresh")).unionByName(new.withColumn("fresh", F.lit(True)))
    one = merged.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return scratch.put(nearest(one.join(lists.select("node", "k"), "node", "left").withColumn("k", F.coalesce("k", F.lit(k)))))


def audit(spark: SparkSession, rooted: DataFrame, threshold: float, draw: int, rows: int = AUDIT) -> tuple[float, int]:
    """Recall, as a mean over those of ``rows`` nodes that have links, and the number of missed links.

    The asked nodes, others for each ``draw``, are broadcast (a stated number) and compared with all nodes. A link is found
    when its ends are in one component, as members of a component are compared with each other. Only counts come back.
    """
    order = F.xxhash64(F.lit(5 + draw), "vec")
    asked = [(r.node, r.root, r.dim, bytes(r.vec)) for r in rooted.orderBy(order, "node").limit(rows).select("node", "root", "dim", "vec").collect()]
    shared = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for n, r, d, v in shared.value:
            by.setdefault(d, []).append((n, r, v))
        ready = {d: (np.array([n for n, _, _ in q]), np.array([r for _, r, _ in q]), _matrix([v for _, _, v in q], d)) for d, q in by.items()}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            dims = t.column("dim").to_numpy()
            for d in np.unique(dims):
                if int(d) not in ready:
                    continue
                part = t.filter(pa.array(dims == d))
                ids, roots, q = ready[int(d)]
                close = (q @ _matrix(part.column("vec").to_pylist(), int(d)).T >= threshold) & (ids[:, None] != part.column("node").to_numpy()[None, :])
                found = close & (roots[:, None] == part.column("root").to_numpy()[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(close.sum(1)), pa.array(found.sum(1))], ["node", "links", "found"])

    counts = rooted.select("node", "root", "dim", "vec").mapInArrow(run, "node bigint, links bigint, found bigint").where("links > 0")
    each = counts.groupBy("node").agg(F.sum("links").alias("links"), F.sum("found").alias("found"))
    r = each.agg(F.avg(F.col("found") / F.col("links")).alias("recall"), F.sum(F.col("links") - F.col("found")).alias("missed")).first()
    return (1.0, 0) if r.recall is None else (r.recall, r.missed)


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """Links of each node (node, links), copies counted, among all members (node, root, vec, dim, copies) of its component.

    A component is cut into chunks, and every two chunks of it meet in one place: no task holds more than two.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    cut = members.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    meet = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = meet.select("root", F.least("chunk", "with").alias("lo"), F.greatest("chunk", "with").alias("hi"), "chunk", "node", "dim", "copies", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_n = [], []
        for g in _whole_groups(batches, 3):
            x = _matrix(g.column("vec").to_pylist(), g.column("dim")[0].as_py())
            ids, copies, chunk = g.column("node").to_numpy(), g.column("copies").to_numpy(), g.column("chunk").to_numpy()
            close = (x @ x.T) >= threshold
            np.fill_diagonal(close, False)
            if g.column("lo")[0].as_py() != g.column("hi")[0].as_py():
                close &= chunk[:, None] != chunk[None, :]
            out_a.append(ids), out_n.append(close @ copies)
            if sum(map(len, out_a)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_n))], ["node", "links"])
                out_a, out_n = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_n))], ["node", "links"])

    met = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(run, "node bigint, links bigint")
    return met.groupBy("node").agg(F.sum("links").alias("links"))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """As _groups, but a group comes whole: for groups that are cut to size before."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        n = t.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for i in range(keys):
            k = t.column(i).to_numpy()
            change[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield t.slice(a, b - a)
        rest = t.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = 0.9, k: int = 8, trees: int = 8, least_recall: float = 0.995, rounds: int = 4) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark)
    rows, nodes = nodes_of(vectors, scratch)
    n = nodes.count()
    depth = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    at = F.col("sim") >= threshold
    pair = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))

    graph = scratch.put(nearest(forest(nodes, depth, range(trees), k).withColumn("k", F.lit(k))).withColumn("fresh", F.lit(True)))
    turn = 0
    while True:
        # a larger list needs one round to fill: what is new in it meets all neighbours at once
        for _ in range(1 if turn else rounds):
            nxt = descend(nodes, graph, k, scratch, turn, threshold)
            scratch.drop(graph)
            graph, turn = nxt, turn + 1
            if graph.where("fresh").count() <= 0.01 * k * n:
                break
        larger = scratch.put(enlarge(graph, threshold))
        grew = larger.agg(F.sum("k")).first()[0] != graph.agg(F.sum("k")).first()[0]
        scratch.drop(graph)
        graph = larger
        if not grew:
            break
    edges = scratch.put(graph.where(at).select(*pair).distinct())
    saturated = not graph.groupBy("node").agg(F.count_if(at).alias("c"), F.max("k").alias("k")).where("c >= k").isEmpty()
    scratch.drop(graph)
    for more in range(rounds + 1):
        roots = scratch.put(connected_components(spark, edges, scratch))
        rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        recall, missed = audit(spark, rooted, threshold, more)
        log.info("recall %.5f over an audit of %d nodes, %d links missed, after %d restarts", recall, AUDIT, missed, more)
        # what a full list hides is looked for at least once; the last audit may see misses within the bound
        if missed == 0 and (more > 0 or not saturated) or recall >= least_recall and more == rounds:
            break
        first = trees * (more + 1)
        new = all_crossings(rooted, threshold) if more == rounds else crossings(rooted, max(0, depth - 1), range(first, first + trees), threshold)
        grown = scratch.put(edges.unionByName(new.select(*pair)).distinct())
        scratch.drop(edges)
        edges = grown
    else:
        roots = scratch.put(connected_components(spark, edges, scratch))
    members = nodes.join(roots, "node")
    links = scratch.put(count_links(members, threshold))
    least = members.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = nodes.join(roots, "node", "left").join(least, "root", "left").join(links, "node", "left").select(
        "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    scratch.drop(edges)
    out = rows.join(named, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, row_number() OVER () AS rid FROM embeddings),
ok AS (
  SELECT rid, vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_inner_product(a.e, b.e) / (a.norm * b.norm) END >= 0.9),
reached AS (
  WITH RECURSIVE r(rid, other) AS (SELECT rid, rid FROM v UNION SELECT r.rid, l.b FROM r JOIN links l ON l.a = r.other) SELECT * FROM r),
least AS (SELECT r.rid, min(v.vec_id) AS component_id FROM reached r JOIN v ON v.rid = r.other GROUP BY r.rid),
n AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, l.component_id, coalesce(v.vec_id = l.component_id, false) AS kept
FROM v LEFT JOIN n ON n.rid = v.rid JOIN least l ON l.rid = v.rid
"""
