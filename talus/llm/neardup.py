"""Near-duplicate removal on SimHash components, verified by exact similarity.

One pass describes each text by a 128-bit name of its set of five-word shingles, a SimHash
fingerprint of its distinct words and ``BANDS`` MinHash keys. Texts with one set are one
representative from there on, so copies never meet each other.

SimHash at a small bit budget finds documents of Jaccard similarity 0.8 over five-word
shingles only by luck: they differ in about ten of 64 bits. Over the distinct words the
same documents differ in four or five, so the components of the trie self-join over
fingerprints of distinct words are the first candidates, and five-word shingles decide. In
``HUB_ROUNDS`` rounds each component's hub, the first document with the component's
commonest fingerprint, takes all documents at or above the similarity. No round needs a
component in one place: what joins a component's rows is a stored table with a row a
component, so that skewed joins are split.

Edits that change rare words move more than six bits, and a hub doesn't take all, so links
between the groups found are looked for among all documents that agree in all of ``ROWS``
MinHash values over their five-word shingles in one of ``BANDS`` bands: at similarity 0.8 a
pair meets with probability 1 - (1 - 0.8 ** 4) ** 20 = 99.997 %. Pairs of keys of few
documents are compared one by one, those of other keys in blocks: what lies outside a key's
largest group with that group and with itself. Of each group that links connect the
document with the smallest id stays.

Defined results: null and empty texts are equal to each other; a text of fewer words than
a shingle is one shingle; of rows with equal ids any one may stay; other columns pass
through, whatever their names; an empty table gives an empty result; a very long text is
described on its own, in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, local_roots, mixed, prefix_hash, span_hash, stored, unite, unused, word_spans
from .simhash import grouped

SHINGLE, SIMILARITY, BUDGET, HUB_ROUNDS, PART = 5, 0.8, 6, 2, 256
BANDS, ROWS, FEW = 20, 4, 16
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of lower-cased words, as 32-bit hashes in order."""
    return _shingled(text, size)[0]


def _shingled(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a text, and the hashes of its words."""
    buf = np.frombuffer((text or "").lower().encode(), np.uint8)
    first, last = word_spans(buf)
    names = span_hash(prefix_hash(buf), first, last)
    size = max(1, min(size, len(names)))
    at = np.arange(max(0, len(names) - size + 1))
    return np.unique((span_hash(prefix_hash(names), at, at + size) >> np.uint64(32)).astype(np.uint32)), names


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def described(text: str | None) -> tuple[np.ndarray, int, np.ndarray]:
    """(shingles, fingerprint of the distinct words, band keys)."""
    sh, names = _shingled(text, SHINGLE)
    return sh, majority(np.unique(names)), band_keys(sh)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint whose bits are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > len(hashes)].sum(dtype=np.uint64))


def band_keys(sh: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of the ROWS least products of the shingles with its seeds."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(sh), 4096):
        np.minimum(least, (sh[at : at + 4096].astype(np.uint64) * _SEEDS[:, None]).min(1), out=least)
    least = mixed(least + _SEEDS).reshape(BANDS, ROWS)
    return mixed((least * _SEEDS[:ROWS]).sum(1) + _SEEDS[::ROWS])


def _described(rows: DataFrame) -> DataFrame:
    """(rid, id, same, size, fp, keys); ``same`` is equal for equal shingles."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, size, fps, keys = [], [], [], []
            for t in batch.column(2):
                sh, fp, key = described(t.as_py())
                same.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest())
                size.append(len(sh))
                fps.append(fp)
                keys.append(key)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), keys], names=["rid", "id", "same", "size", "fp", "keys"])

    return rows.select("rid", "id", "text").mapInArrow(made, "rid long, id long, same binary, size long, fp long, keys array<long>")


def _with_shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["sh"] = [shingles(t).tobytes() for t in frame.pop("text")]
        yield frame


def _similar(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x == y else jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(a, b)], dtype=float)

    return similar(a, b)


def _parts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("component_id").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias(name))


def _dealt(rows: DataFrame, sizes: DataFrame, own: str, against: str) -> DataFrame:
    """Rows with their part of ``own`` parts, once for each of ``against`` parts they meet."""
    rows = rows.join(sizes, "component_id").withColumn("part", F.pmod(F.xxhash64("sh"), F.col(own)).cast("int"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(against) - 1)))


def _pairs(left: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between the rids of each component, in blocks of PART by PART rows."""
    spread = _dealt(left, _parts(left, "parts"), "parts", "parts")
    block = F.xxhash64("component_id", F.least("part", "other"), F.greatest("part", "other"))
    side = F.when(F.col("part") != F.col("other"), F.col("part")).otherwise(-1)
    return _blocks(spread.select("rid", "sh", block.alias("block"), side.alias("side")), similarity)


def _across(border: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links of border rows with members of the same component, in blocks."""
    sizes = _parts(border, "near").join(_parts(members, "far"), "component_id")
    border = _dealt(border, sizes, "near", "far").select("rid", "sh", F.xxhash64("component_id", "part", "other").alias("block"), F.lit(0).alias("side"))
    members = _dealt(members, sizes, "far", "near").select("rid", "sh", F.xxhash64("component_id", "other", "part").alias("block"), F.lit(1).alias("side"))
    return _blocks(border.unionByName(members), similarity)


def _blocks(spread: DataFrame, similarity: float) -> DataFrame:
    """(u, v): edges that connect what links of rows of different sides connect, block by block."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, np.uint32) for s in rows["sh"]]
        size = np.array([len(s) for s in sets])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        owner = np.repeat(np.arange(len(sets)), size)
        side, parent = rows["side"].to_numpy(), local_roots(len(sets))
        common = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(flat.max(initial=-1)) + 1, 1 << 14):  # bounds the incidence matrix
            own = (flat >= at) & (flat < at + (1 << 14))
            hit = np.zeros((len(sets), min(1 << 14, int(flat.max()) + 1 - at)), np.float32)
            hit[owner[own], flat[own] - at] = 1
            common += hit @ hit.T
        a, b = np.nonzero(np.triu(common >= similarity * (size[:, None] + size - common) - 1e-6, 1))
        good = (side[a] != side[b]) | (side[a] < 0)
        unite(parent, a[good], b[good])
        moved = np.flatnonzero(parent != np.arange(len(sets)))
        rid = rows["rid"].to_numpy()
        return pd.DataFrame({"u": rid[moved], "v": rid[parent[moved]]})

    return spread.groupBy("block").applyInPandas(compare, "u long, v long")


def _candidates(rows: DataFrame, first: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(rid, id, fp, component_id, sh) of the representatives with a candidate, and the bands (key, rid, size) that have several.

    component_id is null where only a band has others. Texts are shuffled this once.
    """
    found = stored(grouped(first.select("rid", "id", "fp"), budget, "rid"))
    several = stored(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id"))
    keys = first.filter("size > 0").select(F.explode("keys").alias("key"), "rid", "size")
    again = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    met = stored(keys.join(again, "key"))
    need = found.join(several, "component_id").select("rid", "id", "fp", "component_id").join(met.select("rid").distinct(), "rid", "full")
    cols = "rid long, id long, fp long, component_id long"
    sets = rows.select("rid", "text").join(need, "rid").select("rid", "id", "fp", "component_id", "text").mapInPandas(_with_shingles, f"{cols}, sh binary")
    return stored(sets), met


def _missed(met: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links between the groups of labels (rid, g), of representatives with a band in common."""
    keys = met.join(labels.select("rid", "g"), "rid")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("low"), F.max("g").alias("high")).filter("low <> high").select("key", "n")
    met, sets = stored(keys.join(stored(shared), "key")), sets.select("rid", "sh")
    few, many = met.filter(F.col("n") <= FEW), met.filter(F.col("n") > FEW)
    a, b = (few.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("rid", "g", "size"))) for side in "ab")
    pairs = a.join(b, "key").filter("rid_a < rid_b and g_a <> g_b").filter(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6)
    pairs = pairs.select("rid_a", "rid_b", "g_a", "g_b").distinct()
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rid").alias(f"rid_{side}"), F.col("sh").alias(f"sh_{side}")), f"rid_{side}")
    edges = pairs.filter(_similar("sh_a", "sh_b") >= similarity).select(F.col("g_a").alias("u"), F.col("g_b").alias("v"))
    if many.limit(1).count():
        largest = many.groupBy("key", "g").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max(F.struct("size", "g")).alias("x")).select("key", F.col("x.g").alias("most"))
        many = many.select("key", "rid", "g").join(stored(largest), "key").join(sets, "rid")
        many = stored(many.select(F.col("key").alias("component_id"), F.col("g").alias("rid"), "sh", (F.col("g") == F.col("most")).alias("inside")))
        outside = many.filter("not inside").drop("inside")
        edges = edges.unionByName(_pairs(outside, similarity)).unionByName(_across(outside, many.filter("inside").drop("inside"), similarity))
    return edges.distinct()


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, budget: int = BUDGET, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates."""
    rid = unused(docs, "_rid")
    whole = stored(docs.withColumn(rid, F.monotonically_increasing_id()))
    rows = whole.select(F.col(rid).alias("rid"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(text).alias("text"))
    every = stored(_described(rows))
    first = stored(every.groupBy("same").agg(F.min(F.struct("id", "rid", "fp", "size", "keys")).alias("x")).select("same", "x.*"))
    sets, met = _candidates(rows, first, budget)
    labels = stored(_labelled(first, sets.filter("component_id is not null").select("rid", "fp", "component_id", "sh"), similarity))
    labels = _joined(labels, _missed(met, sets, labels, similarity))
    kept = stored(labels.groupBy("g").agg(F.min(F.struct("id", "rid")).alias("x")).select("x.rid"))
    lost = stored(every.select("rid").join(kept, "rid", "left_anti").withColumnRenamed("rid", rid))
    dropped(every, first, sets, met, kept)
    return whole.join(lost, rid, "left_anti").drop(rid)


def _labelled(first: DataFrame, left: DataFrame, similarity: float) -> DataFrame:
    """(rid, id, g): representatives with the hub of their SimHash component (rows of left) that takes them, else themselves."""
    taken = None
    for _ in range(HUB_ROUNDS):
        often = left.groupBy("component_id", "fp").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid")).groupBy("component_id").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("rid")).alias("r"))).alias("x"))
        hubs = often.filter("all > 1").select((-F.col("x.r")).alias("rid"))
        hubs = stored(left.join(hubs, "rid").select("component_id", F.col("rid").alias("hub"), F.col("sh").alias("hub_sh")))
        judged = left.join(hubs, "component_id").withColumn("j", _similar("sh", "hub_sh"))
        judged = stored(judged.select("rid", "fp", "component_id", "hub", "j", F.when(F.col("j") < similarity, F.col("sh")).alias("sh")))
        more = judged.filter(F.col("j") >= similarity).select("rid", F.col("hub").alias("g"))
        taken, left = more if taken is None else taken.unionByName(more), judged.filter(F.col("j") < similarity).drop("hub", "j")
    if taken is None:
        return first.select("rid", "id", F.col("rid").alias("g"))
    return first.select("rid", "id").join(taken, "rid", "left").select("rid", "id", F.coalesce("g", "rid").alias("g"))


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels with the groups that edges connect made one."""
    roots = components(edges)
    return labels.join(roots, labels["g"] == roots["node"], "left").select("rid", "id", F.coalesce("root", "g").alias("g"))
