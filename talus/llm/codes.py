"""Vector code compression: product quantization whose nearest entries are found by annular norm pruning.

A vector is cut into equal consecutive parts, each told by the number of the nearest entry
of its position's codebook. Entries are sorted by norm; since |q - e| >= ||q| - |e||, only
entries whose norm lies within the best distance found so far of the part's own norm can be
nearer. That interval is found by binary search, ends included, and every entry in it is
compared exactly, in integers. The first guess is the entry of the nearest norm and its
neighbours.

The codebooks are the only thing the driver holds: parts x entries x width integers,
whatever the number of rows. A round sends the sums and counts of the entries, combined in
each task, so a round's shuffle has at most parts x entries rows a task.

Defined results: rows whose vector is null, or holds a null or non-finite component, are
dropped. Vectors of differing length count as filled up with zeros to the longest one's
length, that length as filled up to a multiple of the number of parts; an empty vector is
all zeros. Components are held to +-2^26 after scaling, so that distances fit 64 bits.
With fewer rows than entries the codebooks are that much smaller; an empty table gives an
empty result. Equal ids (or null ones, which come last) are ordered by their vectors to
seed the codebooks; repeated rows each return a row. Rows with equal labels share their
error sum, null labels together. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_MOST = float(1 << 26)
_NEAR = 2  # neighbours by norm on each side that make up the first guess


@dataclass(frozen=True)
class Codebooks:
    """entries: integers by part, entry and position within the part."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def scaled(lists: pa.ListArray, width: int) -> np.ndarray:
    """Integer vectors, a row each, filled up with zeros to ``width``."""
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    flat = np.clip(np.floor(flat * SCALE), -_MOST, _MOST).astype(np.int64)
    sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest(queries: np.ndarray, entries: np.ndarray, room: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``queries`` the index of the nearest row of ``entries`` (the lower on ties) and the squared distance."""
    square = (entries * entries).sum(axis=1)
    order = np.argsort(square, kind="stable")
    ring, norm = entries[order], np.sqrt(square[order].astype(np.float64))
    best_at, best = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    step = max(1, room // max(1, len(entries)))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        own = np.sqrt((q * q).sum(axis=1).astype(np.float64))
        middle = np.searchsorted(norm, own)
        guess = np.full(len(q), np.iinfo(np.int64).max)
        for shift in range(-_NEAR, _NEAR):
            e = ring[np.clip(middle + shift, 0, len(ring) - 1)]
            guess = np.minimum(guess, ((q - e) ** 2).sum(axis=1))
        reach = np.sqrt(guess.astype(np.float64))
        reach += 1e-9 * (1 + reach + own)  # the ends are included whatever the square roots round to
        low, high = np.searchsorted(norm, own - reach, "left"), np.searchsorted(norm, own + reach, "right")
        count = high - low
        begin = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(q)), count)
        place = np.arange(len(owner)) - begin[owner] + low[owner]
        far = ((q[owner] - ring[place]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(far, begin)
        named = np.where(far == least[owner], order[place], len(entries))
        best_at[at : at + step], best[at : at + step] = np.minimum.reduceat(named, begin), least
    return best_at, best


def assigned(vectors: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(codes, errors): the entry of each part and the squared distances summed over parts."""
    parts, _, width = books.entries.shape
    codes, error = np.zeros((len(vectors), parts), np.uint8 if books.entries.shape[1] <= 256 else np.int64), np.zeros(len(vectors), np.int64)
    for p in range(parts):
        at, far = nearest(vectors[:, p * width : (p + 1) * width], books.entries[p])
        codes[:, p] = at
        error += far
    return codes, error


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and finite throughout."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(column).isNotNull() & sound)


def fit(kept: DataFrame, key: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks seeded by the rows of the smallest keys, then moved to the floored means of their parts; None without rows."""
    seeds = kept.select(F.col(key).alias("k"), F.col(column).cast("array<double>").alias("v")).orderBy(F.asc_nulls_last("k"), "v").limit(entries).collect()
    if not seeds:
        return None
    longest = kept.agg(F.max(F.size(column))).first()[0]
    width = max(1, -(-longest // parts))
    first = scaled(pa.array([r.v for r in seeds], pa.list_(pa.float64())), width * parts)
    books = Codebooks(np.ascontiguousarray(first.reshape(-1, parts, width).transpose(1, 0, 2)))
    sums = [f"s{i}" for i in range(width)]
    for _ in range(rounds):

        def told(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            slots = books.entries.shape[0] * books.entries.shape[1]
            count, total = np.zeros(slots, np.int64), np.zeros((slots, width), np.int64)
            for batch in batches:
                vectors = scaled(batch.column(0), width * parts)
                codes, _ = assigned(vectors, books)
                slot = codes.astype(np.int64) + np.arange(parts) * books.entries.shape[1]
                count += np.bincount(slot.ravel(), minlength=slots)
                np.add.at(total, slot.ravel(), vectors.reshape(-1, width))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), *(pa.array(total[some, i]) for i in range(width))], names=["slot", "n", *sums])

        schema = ", ".join(f"{c} long" for c in ["slot", "n", *sums])
        moved = kept.select(F.col(column)).mapInArrow(told, schema).groupBy("slot").agg(*(F.sum(c).alias(c) for c in ["n", *sums])).collect()
        new = books.entries.copy()
        for r in moved:
            new[divmod(r.slot, new.shape[1])] = [r[c] // r.n for c in sums]
        books = Codebooks(new)
    return books


def encoded(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for each usable row; a code has two hex digits a part."""
    if entries > 256:
        raise ValueError("an entry's number has two hex digits")
    kept = usable(vectors, column)
    kinds = dict(kept.dtypes)
    books = fit(kept, key, column, parts, entries, rounds)
    digest = books.digest() if books else ""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = assigned(scaled(batch.column(2), books.entries.shape[0] * books.entries.shape[2]), books)
            digits = codes.tobytes().hex()
            code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], names=["k", "label", "code", "error"])

    narrow = kept.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(column).alias("v"))
    rows = stored(narrow.mapInArrow(coded, f"k {kinds[key]}, label {kinds[label]}, code string, error long"))  # read twice
    sums = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = rows.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("k").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Two rounds and the last assignment, each a join of parts with their position's entries."""
    near = """near{k} AS MATERIALIZED (
  SELECT vec_id, p, v, arg_min(e, d * 256 + e) AS e, min(d) AS d
  FROM (SELECT s.vec_id, s.p, s.v, b.e, list_sum(list_transform(list_zip(s.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM part s JOIN book{k} b ON b.p = s.p) GROUP BY vec_id, p, v)"""
    book = """book{n} AS MATERIALIZED (
  SELECT b.p, b.e, CASE WHEN m.v IS NULL THEN b.v ELSE m.v END AS v
  FROM book{k} b LEFT JOIN (
    SELECT p, e, list(x ORDER BY i) AS v FROM (
      SELECT p, e, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x
      FROM near{k}, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""
    steps = [near.format(k=0), book.format(k=0, n=1), near.format(k=1), book.format(k=1, n=2), near.format(k=2)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS v FROM kept, unnest(range(0, {PARTS})) AS t(p)),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
book0 AS MATERIALIZED (SELECT p, e, v FROM part JOIN seed USING (vec_id)),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


ORACLE_SQL = _sql()
