"""Shared pieces of the training-data operators: tables, words, cut lineage, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(c: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def free(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it (Spark compares names without case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="waybill-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Written tables that cut lineage. A lost executor costs the tasks under way and nothing written.

    ``put`` writes a table to the shared folder and reads it again; ``drop`` deletes those given, once nothing
    reads them any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/waybill-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        # the schema is known: reading it from the files would start another job
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Python workers live on between stages: hand freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Up to this many links (32 bytes each) one task takes all of them; more go by rounds over the cluster, with the same result.
ONE_TASK = 500_000


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component: roots hook to lower roots, then paths are halved."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    m = t.num_rows
    nodes = pa.concat_arrays([c for name in ("a", "b") for c in t.column(name).chunks]).dictionary_encode()
    order = pc.array_sort_indices(nodes.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    at = rank[nodes.indices.to_numpy()]
    root = _roots(len(order), at[:m], at[m:])
    names = nodes.dictionary.take(order)
    for i in range(0, len(order), 10_000):
        yield pa.RecordBatch.from_arrays([names.slice(i, 10_000), names.take(pa.array(root[i : i + 10_000]))], ["node", "root"])


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """Components of an undirected graph as (node, root), root being the smallest node of the component.

    ``edges`` has the columns a and b of one orderable type. Few links (see ONE_TASK) are met in one task. More go by
    alternating large-star and small-star steps: each round is a grouped minimum and a join back, so a hub is
    pre-aggregated before the shuffle and its join is open to adaptive skew splitting. Rounds are written to the shared
    folder; their number grows with the logarithm of the longest path. Self links and nulls are ignored; nodes without
    links don't appear.
    """
    own = scratch or Scratch(spark)
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    if one_task and edges.count() <= one_task:
        kind = edges.schema["a"].dataType.simpleString()
        return own.put(edges.repartition(1).mapInArrow(_components_of, f"node {kind}, root {kind}"))

    def state(links: DataFrame) -> tuple:
        """Number of links and a hash of the set of them: equal only when a round changed nothing."""
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first())

    cur = own.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(cur)
    while True:
        # large star: every neighbour above u moves to the least of u and its neighbours
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: lower neighbours and u itself move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = own.put(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        own.drop(cur)
        cur, after = nxt, state(nxt)
        if after == before:
            break
        before = after
    roots = cur.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
