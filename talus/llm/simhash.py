"""SimHash near-duplicates: a binary trie self-join over the fingerprints.

Fingerprints are dealt to tasks by shared bits: with a budget of k differing bits, any two
linked fingerprints agree on at least r of k + r blocks of bits, so each choice of r
blocks is a table of buckets and every link meets in one of them. r grows with the number
of distinct fingerprints, which keeps buckets small. Inside a task the buckets are binary
tries; pairs of trie nodes are walked together, the differing bits of the path are added
up, and a pair is given up once they exceed the budget. Each task returns only a forest
that connects its linked fingerprints. A bucket beyond ``BUCKET_ROWS`` is dealt out
in parts, and every two parts meet in a task of their own.

Defined results: a null text is an empty one; a text without words has fingerprint zero;
rows with a null id take part and get their group's id; repeated rows share a
fingerprint; an empty table gives an empty result; a very long text is hashed on its own;
only id and text are read, and other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, local_roots, stored, table, unite

SHINGLE, BUDGET, SEED = 4, 4, 42
BUCKET_ROWS = 20_000
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: last - 1].tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, stops)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > last].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    kind = dict(docs.select(key).dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(hashed, f"`{key}` {kind}, fp long")


def masks(budget: int, distinct: int, fill: int = 1024) -> list[int]:
    """Bits to agree on, one mask a table: the smallest r that leaves about ``fill`` fingerprints a bucket.

    Comparing a fingerprint with a thousand others costs less than a row for each of the tables
    that a larger r needs.
    """
    for r in range(1, 5):
        blocks = np.array_split(np.arange(64), budget + r)
        if distinct >> min(sum(len(b) for b in c) for c in combinations(blocks, r)) <= fill:
            break
    return [sum(1 << int(i) for b in c for i in b) for c in combinations(blocks, r)]


def trie_links(fps: np.ndarray, bounds: np.ndarray, budget: int, side: np.ndarray | None = None, leaf: int = 64, room: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits inside each bucket fps[bounds[i]:bounds[i+1]].

    Each bucket is sorted and without repeats, so a trie node is a range of it. With
    ``side`` only pairs from different sides count. Node pairs with at most ``leaf``
    fingerprint pairs are compared directly; the walk goes depth first in pieces of ``room``.
    """
    ones: dict[int, np.ndarray] = {}
    first = np.stack([bounds[:-1], bounds[1:], bounds[:-1], bounds[1:], np.zeros(len(bounds) - 1, np.int64)])
    stack = [(63, first[:, first[1] - first[0] > 1])]
    while stack:
        bit, nodes = stack.pop()
        small = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= leaf if bit >= 0 else np.ones(nodes.shape[1], bool)
        near = nodes[:, small]
        for at in range(0, near.shape[1], room // leaf if bit >= 0 else 1):
            a0, a1, b0, b1, _ = near[:, at : at + (room // leaf if bit >= 0 else 1)]
            width = b1 - b0
            count = (a1 - a0) * width
            owner = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            a, b = a0[owner] + nth // width[owner], b0[owner] + nth % width[owner]
            good = (a < b) & (np.bitwise_count(fps[a] ^ fps[b]) <= budget)
            if side is not None:
                good &= side[a] != side[b]
            if good.any():
                yield a[good], b[good]
        nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        count = ones[bit]
        a0, a1, b0, b1, off = nodes
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        same = (a0 == b0) & (a1 == b1)
        below = [np.stack([a0, am, b0, bm, off]), np.stack([am, a1, bm, b1, off]), np.stack([a0, am, bm, b1, off + 1]), np.stack([am, a1, b0, bm, off + 1])[:, ~same]]
        below = np.concatenate(below, axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)]
        for at in range(0, below.shape[1], room):
            stack.append((bit - 1, below[:, at : at + room]))


def linked(distinct: DataFrame, budget: int = BUDGET, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(u, v): edges that connect exactly the fingerprints (column fp) which links connect."""
    n = distinct.count()
    by = masks(budget, n)
    signed = [m - (1 << 64) if m >> 63 else m for m in by]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])
    spread = distinct.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    large = spread.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows).withColumn("parts", F.ceil(F.col("n") / bucket_rows).cast("int"))
    large = stored(large.select("t", "key", "parts"))
    tasks = max(1, n * len(by) // 400_000)
    if large.limit(1).count():
        spread = spread.join(large, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        spread = spread.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        spread = spread.select("fp", F.xxhash64("t", "key", F.least("part", "other"), F.greatest("part", "other")).alias("bucket"), F.when(F.col("part") != F.col("other"), F.col("part")).otherwise(-1).alias("side"))
        tasks = max(tasks, 64)
    else:
        spread = spread.select("fp", F.xxhash64("t", "key").alias("bucket"), F.lit(-1).alias("side"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        fps = np.concatenate([b["fp"].to_numpy() for b in rows]).view(np.uint64)
        bucket = np.concatenate([b["bucket"].to_numpy() for b in rows])
        side = np.concatenate([b["side"].to_numpy() for b in rows])
        order = np.lexsort((fps, bucket))
        fps, bucket, side = fps[order], bucket[order], side[order]
        bounds = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        names, local = np.unique(fps, return_inverse=True)
        parent = local_roots(len(names))
        cross = side if (side >= 0).any() else None
        if cross is not None:  # a bucket that is whole has one side, all of whose pairs count
            cross = np.where(side >= 0, side, -1 - np.arange(len(side)))
        for a, b in trie_links(fps, bounds, budget, cross):
            unite(parent, local[a], local[b])
        moved = np.flatnonzero(parent != np.arange(len(names)))
        yield pd.DataFrame({"u": names[moved].view(np.int64), "v": names[parent[moved]].view(np.int64)})

    return spread.repartition(tasks, "bucket").mapInPandas(joined, "u long, v long")


def grouped(prints: DataFrame, budget: int = BUDGET, key: str = "doc_id") -> DataFrame:
    """Adds component_id, the smallest key that links reach, to each row of (key, fp)."""
    distinct = stored(prints.groupBy("fp").agg(F.min(key).alias("_first")))
    roots = components(linked(distinct.select("fp"), budget)).withColumnRenamed("node", "fp")
    first = roots.join(distinct, "fp").groupBy("root").agg(F.min("_first").alias("_least"))
    named = distinct.join(roots, "fp", "left").join(first, "root", "left").select("fp", F.coalesce("_least", "_first").alias("component_id"))
    return prints.join(stored(named), "fp")  # a row a fingerprint, so that Spark can split what shares one


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grouped(stored(fingerprints(table(spark, sf_dir, "documents"))))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
