"""Helpers shared by the corpus operators: row identity, Arrow assembly, lineage cuts and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaClass, JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_MIN = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, mb: int = 4, rows: int = 4096) -> None:
    """Keep Arrow batches small in bytes and rows, so that very long texts don't pile up in one Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stage tables, which the cluster names in spark.checkpoint.dir.

    Where it names none, a master of local threads (tests) gets a temporary folder; a cluster is refused, as its
    executors would not see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codepend-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: A key is hot from this part of the rows on; so there are at most as many hot keys.
HOT_PART = 4096


def skewed_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, many: str = "many") -> DataFrame:
    """left joined (inner) with right, which has each key once, and in `many` how often left (of that many rows) has it.

    Keys with a HOT_PART-th of the rows or more, HOT_PART at most, are broadcast, so their rows stay where they are;
    the others meet in a shuffle, where none of them is large. left is read twice: give it cut or written. No key of left
    may be null.
    """
    hot = F.col(many) * HOT_PART >= rows
    cold = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(right.where(~hot), keys)
    return left.join(F.broadcast(right.where(hot)), keys).unionByName(cold)


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with underscores after it until no column of the frames has it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let go of the files, plans and buffers of finished rounds, which else wait for the driver to run out of memory.

    What the JVM's threads have freed of native memory goes back to the system too: glibc keeps it in an arena for each
    of several threads, and a driver starts hundreds of threads for the exchanges of large plans.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> None:
    """Hand freed native memory of the driver's JVM back, where its diagnostic commands can do so (Linux, JDK 17.0.9 or later)."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(kind: JavaClass, *items: object) -> JavaObject:
        out = new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    kind, management = jvm.java.lang.Class, jvm.java.lang.management.ManagementFactory
    # by reflection, as the server's own class isn't open to callers
    types = [kind.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = kind.forName("javax.management.MBeanServer").getMethod("invoke", array(kind, *types))
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    with contextlib.suppress(Py4JJavaError):  # no such command
        invoke.invoke(management.getPlatformMBeanServer(), array(jvm.java.lang.Object, name, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String)))


def tidy(work: Callable) -> Callable:
    """work on Arrow batches that hands freed memory back to the system at its end.

    Spark keeps Python workers for later tasks; what the allocators hold back would count against the next operator.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return run


def row_key() -> list[Column]:
    """did (a null doc_id is the least long) and rid, a hash of doc_id and text: rows that share both have one text."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    return [F.coalesce(doc, F.lit(LONG_MIN)).alias("did"), F.xxhash64(doc, text).alias("rid")]


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and did and rid, which tell rows apart that share a doc_id but not a text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *row_key())


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1, from 0) and bytes of an Arrow string or binary column without nulls, not copied where possible."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw - raw[0], data[raw[0] : raw[-1]]


def slices(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most size bytes, or of one longer row, for work whose arrays are many times its bytes."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of every pair, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - begin, lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all of its input."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: (node, component), component being the smallest node of each.

    Randomised contraction: in each round every vertex joins the closed neighbour with the least
    seeded hash (at first the least number, which settles stars at once), and edges between merged vertices vanish, so rounds grow with the logarithm of
    the vertices whatever the shape; a vertex's merges are followed when all are known. Only aggregates with map-side combine and equi-joins;
    nothing but an edge count reaches the driver.
    """
    left = cut(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct())
    members = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    for i in range(rounds):
        if left.isEmpty():
            break
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct((F.xxhash64(F.lit(i), c) if i else c).alias("h"), c.alias("v"))  # noqa: B023, E731
        to = cut(both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select("a", F.least(rank(F.col("a")), "m")["v"].alias("to")))
        members = members.join(to, members.root == to.a, "left").select("node", F.coalesce("to", "root").alias("root"))
        ta, tb = to.select(F.col("a"), F.col("to").alias("x")), to.select(F.col("a").alias("b"), F.col("to").alias("y"))
        left = cut(left.join(ta, "a").join(tb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError("the contraction did not end")
    members = cut(members)
    release(members.sparkSession)
    least = members.groupBy("root").agg(F.min("node").alias("component"))
    return members.join(least, "root").select("node", "component")
