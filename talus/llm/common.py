"""Helpers shared by the training-data operators: shared storage, hashing, numbering, components.

Nothing here keeps state on one machine: intermediate tables go to the folder
named by ``spark.checkpoint.dir`` (a shared one on a cluster).
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors once, so its functions can be loaded there."""
    context = spark.sparkContext
    if not getattr(context, "_talus_shipped", False):
        package = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="talus-package-"), "talus-package.zip")
        with zipfile.ZipFile(to, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(to))
        context._talus_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the checkpoint folder that is set.

    Without either this is an error on a cluster, where a folder of one machine would lose
    what the others wrote; a local master, as in tests, has one machine and gets its own.
    """
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="talus-shared-"))
    return named or context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    Cuts the lineage as checkpoint() does, survives lost executors, and is
    columnar and compressed, which keeps the disk needed far below checkpoint()'s rows.
    Shuffle files of the write go when it is over, not when the driver next happens to
    collect its garbage; nothing computed later can want them.
    """
    path, conf = f"{shared_dir(df.sparkSession)}/talus-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._talus_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing still to be computed reads."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._talus_path
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, group: str, order: list[str], name: str, rows: int, rows_per_task: int = 400_000) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... without gaps within each value of ``group``.

    A group is dealt into as many buckets as ``rows`` (the rows of df) asks for, each
    numbered on its own, then shifted by the sizes of the buckets before it, so a group
    that holds most rows is never in one task. Rows equal in every column of ``order``
    may swap numbers, so ``order`` names all columns that tell rows apart.
    """
    buckets = max(1, -(-rows // rows_per_task))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    return (
        dealt.withColumn("_within", within)
        .join(shifts, [group, "_bucket"])
        .withColumn(name, (F.col("_within") + F.col("_shift")).cast("long"))
        .drop("_bucket", "_within", "_shift")
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u long, v long): (node, root), root the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step is a
    grouped minimum, combined before the shuffle, and a join, so a hub never needs its
    neighbours in one place. Nodes without an edge to another node aren't returned.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = stored(e), None
    while True:
        sign = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign[0] == 0 or sign == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = sign
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        old, e = e, stored(small.select("x.*").filter("u <> v").distinct())
        dropped(old)


def local_roots(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.int64)


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] in parent, in place; roots are the smallest members."""
    while len(a):
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        if not len(a):
            return
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


# Rolling hash: sum of byte * BASE^i modulo 2^64. BASE is odd, so a window's hash is
# freed from its place by the inverse power, and all windows cost one cumulative sum.
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    key = "inverse" if inverse else "forward"
    if key not in _powers or len(_powers[key]) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[key] = np.cumprod(p)
    return _powers[key][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads each hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(len(values), False), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[starts[i]:ends[i]]; equal spans have equal hashes wherever they are."""
    return mixed((prefix[ends] - prefix[starts]) * _power(len(prefix), True)[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and \\t to \\r."""
    edge = np.diff(np.concatenate(([True], _SPACE[buf], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def sliced(texts: list, limit: int = 2 << 20) -> Iterator[slice]:
    """Slices of about ``limit`` characters; a longer text is a slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_sample(df: DataFrame, rows: int, *key: Column | str) -> DataFrame:
    """About ``rows`` rows, or all if fewer, chosen by a hash of ``key``; the same ones each time."""
    n = df.count()
    if n <= rows:
        return df
    cut = int(rows / n * 2**31)
    return df.filter(F.pmod(F.xxhash64(*key), F.lit(2**31)) < cut)
