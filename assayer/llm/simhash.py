"""SimHash near-duplicates: fingerprints, and their pairs within a few bits by vantage-point partitions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settled

SHINGLE = 3
SEED = 42
RADIUS = 3
#: distinct fingerprints that a shard is meant to hold
SHARD_ROWS = 4096
#: a shard of more rows is divided again, over all bits
SHARD_LIMIT = 65_536
#: at most so many shards are divided by a broadcast of their vantage points, some 40 bytes each
BROADCAST_SHARDS = 100_000
LEAF = 256


def fingerprint(raw: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bit majority over the XXH64 values of all shingles; 0 without a word. As a signed integer."""
    words = raw.lower().split() if raw else []  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = np.array([digest(joined, seed)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(sizes + 1) - 1
        spans = zip((end - sizes)[: len(words) - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - width + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hash values, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.uint16)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long) for every row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(x) for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _route(half: np.ndarray, which: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard): each row's way down a tree of vantage points, over one half of the bits.

    At every node stands a vantage point made from the node's number. Rows at most 15 bits from it go to the inner
    side, the others to the outer one; those at 16, which may have an inner row within one bit (triangle
    bound), go to the inner side as well. So two rows within one bit of each other meet in a shard.
    """
    rows, path = np.arange(len(half)), np.ones(len(half), np.uint64)
    for _ in range(depth):
        point = _mixed(path * np.uint64(2) + np.uint64(which)) & np.uint64(0xFFFFFFFF)
        far = np.bitwise_count(half[rows] ^ point)
        inner, outer = far <= 16, far >= 16
        rows = np.concatenate([rows[inner], rows[outer]])
        path = np.concatenate([path[inner] * np.uint64(2), path[outer] * np.uint64(2) + np.uint64(1)])
    return rows, path.astype(np.int64) * 2 + which


def _split(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Two overlapping parts of ``x`` that keep every pair within ``radius`` together, or None if none is much smaller."""
    for k in range(4):
        far = np.bitwise_count(x ^ x[(len(x) * (2 * k + 1)) // 8]).astype(np.int64)
        sizes = np.cumsum(np.bincount(far, minlength=66 + radius))
        cuts = np.arange(64)
        worst = np.maximum(sizes[cuts + radius], len(x) - sizes[cuts])
        m = int(worst.argmin())
        if worst[m] <= 0.8 * len(x):
            return np.flatnonzero(far <= m + radius), np.flatnonzero(far > m)
    return None


def _spread(x: np.ndarray, radius: int):
    """Index pairs that connect what lies within ``radius``; at most four for each row."""
    if len(x) <= 4 * LEAF:
        a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1))
        if len(a) <= 4 * len(x):
            yield from zip(a.tolist(), b.tolist(), strict=True)
            return
    left = np.arange(len(x))
    while len(left):  # one component after another; a row that is reached isn't compared again
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(x[left] ^ x[at]) <= radius
            if near.any():
                found = left[near].tolist()
                yield from ((at, j) for j in found)
                todo += found
                left = left[~near]


def shard_links(x: np.ndarray, which: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a shard by a vantage-point tree: over the shard's half within ``radius // 2`` bits, and where that half
    doesn't divide the rows, over all bits within ``radius``."""
    half = (x >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)
    links, todo = [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        parts = None
        if len(own) > LEAF:
            parts = _split(half[own], radius // 2) or _split(x[own], radius)
        if parts:
            todo += [own[p] for p in parts]
        else:
            links += [(int(own[a]), int(own[b])) for a, b in _spread(x[own], radius)]
    return links


def in_blocks(dense: DataFrame, limit: int) -> DataFrame:
    """``dense(shard, fp, id)`` as shards of some ``limit`` rows: a shard's rows are dealt to blocks of half of that by a hash of the fingerprint,
    and each two blocks meet in a shard of their own, so any two rows meet somewhere and no task holds the whole."""
    n = dense.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / F.lit(limit / 2)).cast("int"))
    d = dense.join(n, "shard").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("own")) | (F.col("blocks") == 1))
    d = d.withColumn("other", F.explode(others))
    pair = F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))
    return d.select(_half_kept(pair).alias("shard"), "fp", "id")


def _half_kept(name):
    """A shard's new name; the last bit still names the half by which its tree divides."""
    return name.bitwiseAND(F.lit(-2)).bitwiseOR(F.col("shard").bitwiseAND(F.lit(1)))


def divided(dealt: DataFrame, limit: int | None = None, rounds: int = 12) -> DataFrame:
    """``dealt(shard, fp, id)`` with shards beyond ``limit`` rows divided by vantage points of their own over all 64 bits.

    The vantage point of a shard is one of its fingerprints, the cut the median distance from it; rows up to RADIUS beyond the cut
    go to both sides, so two rows within RADIUS of each other stay together somewhere. A shard whose larger side would
    keep over 0.8 of it is one dense family; it is dealt as pairs of blocks, and so is what is still beyond ``limit`` after
    ``rounds``.
    """
    limit = SHARD_LIMIT if limit is None else limit
    left, done, dense = dealt, [], []
    for k in range(rounds + 1):
        big = settled(left.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias("point")).where(F.col("n") > limit))
        n = big.count()
        if not n:
            break
        small = F.broadcast if n <= BROADCAST_SHARDS else lambda d: d
        done.append(left.join(small(big.select("shard")), "shard", "left_anti"))
        if k == rounds:
            dense.append(left.join(small(big.select("shard")), "shard", "left_semi"))
            left = left.limit(0)
            break
        far = left.join(small(big), "shard").withColumn("far", F.bit_count(F.col("fp").bitwiseXOR(F.col("point"))))
        cut = far.groupBy("shard").agg(F.percentile_approx("far", 0.5).alias("cut"))
        far = far.join(small(cut), "shard").withColumn("inner", F.col("far") <= F.col("cut") + RADIUS).withColumn("outer", F.col("far") > F.col("cut"))
        sides = far.groupBy("shard").agg(F.greatest(F.count_if("inner"), F.count_if("outer")).alias("worst"), F.max("n").alias("n"))
        good = settled(sides.select("shard", (F.col("worst") <= 0.8 * F.col("n")).alias("good")))
        far = far.join(small(good), "shard")
        side = F.explode(F.array_compact(F.array(F.when(F.col("inner"), 0), F.when(F.col("outer"), 1))))
        left = settled(far.where("good").withColumn("side", side).select(_half_kept(F.xxhash64("shard", "side")).alias("shard"), "fp", "id"))
        dense.append(far.where("NOT good").select("shard", "fp", "id"))
    for d in dense:
        done.append(in_blocks(d, limit))
    return reduce(DataFrame.unionByName, [left, *done])


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of ``nodes(id, fp)``, distinct fingerprints, that connect what lies within RADIUS bits.

    If two fingerprints differ in at most 3 bits, one of their halves differs in at most 1: for each half, a tree of vantage
    points deals the nodes to shards with its boundary copied; shards that are still large are divided again. Each shard
    searches its own tree and returns links that connect its pairs, not all pairs. The depth follows the
    number of nodes; no node or link reaches the driver.
    """
    depth = max(0, math.ceil(math.log2(max(1, nodes.count()) / SHARD_ROWS)))

    def deal(batches):
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for which in (0, 1):
                rows, shard = _route((x >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF), which, depth)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))],
                    ["shard", "fp", "id"],
                )

    def search(t: pa.Table) -> pa.Table:
        x = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        ids = t.column("id").to_numpy()
        links = np.array(shard_links(x, int(t.column("shard")[0].as_py()) & 1), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[links[:, 0]].astype(np.int64), "b": ids[links[:, 1]].astype(np.int64)})

    dealt = settled(nodes.select("fp", "id").mapInArrow(deal, "shard long, fp long, id long"))
    return divided(dealt).groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable by links of at most 3 bits).

    Equal fingerprints are one node, so copies cost nothing beyond their own row; the nodes are searched by
    ``fingerprint_links``. Null or empty texts have fingerprint 0 and link like others. A null doc_id can't name a
    component: it takes that of its fingerprint, or null. Repeated rows give repeated rows. Other columns are ignored.
    """
    fps = settled(fingerprints(docs))
    nodes = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = components(fingerprint_links(nodes.where("id IS NOT NULL")))
    named = nodes.join(roots, nodes["id"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "id").alias("component_id")
    )
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
