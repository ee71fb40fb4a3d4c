"""Near copies by exact Jaccard similarity of five-word shingles, for the pipeline: candidates by the SimHash operator's
vantage-point trees and by MinHash bands, links that connect them.

Trees alone can't find them: texts at a similarity of 0.8 differ in some 10 of 64 bits, 18 for the last of a thousand
pairs, and around unlike texts (32 bits apart, give or take 4) no triangle bound of 18 bits prunes anything. Bands find
what the trees, at 3 bits, leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_name, settled, sliced
from .simhash import fingerprint_links, majority

SHINGLE = 5
#: a link is a Jaccard similarity of at least OF[0] / OF[1]
OF = (4, 5)
#: a pair at that similarity shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS, some 7 in 100,000
BANDS, ROWS = 24, 5
SEED = 42
#: a bucket of more nodes is compared in pairs of blocks of about this size
BLOCK = 256
COLUMNS = 4096
#: at most so many ids with their marks are broadcast, some 60 MB
BROADCAST_ROWS = 1_000_000
_DRAWN = np.random.default_rng(11).integers(0, 2**63, (BANDS * ROWS + ROWS, 1), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS, MIX = _DRAWN[: BANDS * ROWS], _DRAWN[BANDS * ROWS :, 0]


def node(raw: bytes | None) -> tuple[bytes, np.ndarray]:
    """(digest of the words, distinct hash values of the shingles); fewer than five words are one shingle."""
    words = raw.lower().split() if raw else []  # bytes, as in fingerprints
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(sizes + 1) - 1
        n = len(words) - SHINGLE + 1
        spans = zip((end - sizes)[:n].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)
        hashes = np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n))
    return xxhash.xxh3_128_digest(joined), hashes


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: equal where ROWS minima over permuted hash values are."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 8192):
        np.minimum(least, (hashes[at : at + 8192] * FACTORS).min(1), out=least)
    least ^= least >> np.uint64(31)
    return (least.reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64).view(np.int64)


def alike(shared, total):
    """Whether ``shared`` shingles, of ``total`` in both sets together, are enough; in whole numbers."""
    return (OF[0] + OF[1]) * shared >= OF[0] * total


def block_links(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similar sets, from exact counts of shared shingles."""
    sizes = np.array([len(s) for s in sets])
    row, (_, col, n) = np.repeat(np.arange(len(sets)), sizes), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n >= 2  # shingles of a single set add nothing
    row, col = row[often[col]], (np.cumsum(often) - 1)[col[often[col]]]
    order = np.argsort(col, kind="stable")
    row, col, shared = row[order], col[order], np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(col, [at, at + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[lo:hi], col[lo:hi] - at] = 1
        shared += (x @ x.T).astype(np.int64)
    return np.nonzero(np.triu(alike(shared, sizes[:, None] + sizes[None, :]), 1))


def connecting(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the smallest row that the pairs connect it with."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            break
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
    return root


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, mark (of the text), node (digest of its words), component_id: the smallest doc_id reachable by links of Jaccard
    similarity 0.8 or more.

    Texts of equal words, without regard to case and white space, are one node. Candidates are a node and the head of its family
    of five-word SimHash fingerprints linked within 3 bits, and nodes that share a band. First each node is compared
    with the smallest of its bucket; buckets that this doesn't make one component are then compared in full, in
    pairs of blocks. So a family of copies costs a row for each copy, not one for each pair, and every link is
    confirmed by its shingles. Null and empty texts are copies of each other. Rows without a doc_id are left out.
    """
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def sign(batches):
        for b in sliced(batches, 256):
            got = [node(x) for x in b.column(1).cast(pa.binary()).to_pylist()]
            keys = pa.array([bands(h) for _, h in got], pa.list_(pa.int64()))
            fps = pa.array([majority(h) for _, h in got], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([d for d, _ in got], pa.binary()), fps, keys], ["doc_id", "mark", "node", "fp", "bands"])

    def shingled(batches):
        for b in sliced(batches, 256):
            got = [node(x) for x in b.column(1).cast(pa.binary()).to_pylist()]
            sets = pa.array([h.view(np.int64) for _, h in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.binary()), sets], ["node", "shingles"])

    signed = settled(own.withColumn("mark", text_mark()).mapInArrow(sign, "doc_id long, mark long, node binary, fp long, bands array<long>"))
    nodes = settled(signed.groupBy("node").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    heads = settled(nodes.groupBy("fp").agg(F.min_by("node", "id").alias("head"), F.min("id").alias("id")))
    # the trees propose one pair a node: it and the head of the family that its fingerprint is in
    family = components(fingerprint_links(heads.select("id", "fp")))
    of = heads.join(family, heads["id"] == family["node"], "left").select("fp", F.coalesce("root", "id").alias("root"))
    of = of.join(heads.select(F.col("id").alias("root"), F.col("head").alias("b")), "root").select("fp", "b")
    close = settled(nodes.join(of, "fp").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    slots = nodes.select("node", "id", F.posexplode("bands").alias("t", "key"))
    shared = slots.groupBy("t", "key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = settled(slots.join(shared.drop("n"), ["t", "key"]))
    also = nodes.join(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "id")
    need = settled(met.select("node", "id").unionByName(also).distinct())
    texts = own.join(few(need.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    sets = texts.mapInArrow(shingled, "node binary, shingles array<long>").join(need.select("node"), "node", "left_semi")
    sets = settled(sets.dropDuplicates(["node"]))

    sided = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_s"))
    near = alike(F.size(F.array_intersect("a_s", "b_s")), F.size("a_s") + F.size("b_s"))
    confirmed = lambda pairs: pairs.join(sided("a"), "a").join(sided("b"), "b").where(near).select("a", "b")
    by_trees = settled(confirmed(close))
    held = settled(components(by_trees))
    at = lambda c: held.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    pairs = met.where("node <> b").select(F.col("node").alias("a"), "b").distinct().join(at("a"), "a", "left").join(at("b"), "b", "left")
    pairs = pairs.where("a_root IS NULL OR b_root IS NULL OR a_root <> b_root").select("a", "b")  # others are connected already
    links = settled(by_trees.unionByName(confirmed(pairs)))

    rooted = met.join(components(links), "node", "left").select("node", "t", "key", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("t", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
    # of two nodes the first comparison was the only one
    mixed = mixed.where("lo <> hi AND n > 2").select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    left = rooted.drop("root").join(mixed, ["t", "key"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    left = left.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    left = left.select("t", "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "node").join(sets, "node")

    def compare(t: pa.Table) -> pa.Table:
        held = t.column("node").combine_chunks()
        x = [s.values.to_numpy() for s in t.column("shingles")]
        root = connecting(*block_links(x), len(x))
        some = np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": held.take(pa.array(some)), "b": held.take(pa.array(root[some]))})

    more = left.groupBy("t", "key", "a", "b").applyInArrow(compare, "a binary, b binary")
    roots = settled(components(links.unionByName(more)))
    named = nodes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("node", "component_id")
    return signed.select("doc_id", "mark", "node").join(named, "node").select("doc_id", "mark", "node", "component_id")


def few(d: DataFrame) -> DataFrame:
    """``d`` to be broadcast if it has at most ``BROADCAST_ROWS`` rows, else to be joined by a shuffle."""
    return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d


def text_mark(text: str = "text"):
    """A number for a text, by which its row is told from others of the same doc_id."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(text).isNull())


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of those whose doc_id names it, the one with the smallest mark. Columns as they are.

    A doc_id that stands for several texts is judged text by text. Rows without a doc_id stay. Decisions are made on ids and
    marks; texts are not shuffled where what goes is at most ``BROADCAST_ROWS`` rows, and once beyond.
    """
    rows = near_duplicates(docs).groupBy("component_id", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "mark")).alias("best"))
    rows = settled(rows.join(best, "component_id").select("doc_id", "mark", "n", (F.col("best") == F.struct("doc_id", "mark")).alias("first")))
    gone = rows.where("NOT first").select("doc_id", "mark")
    again = rows.where("first AND n > 1").select("doc_id", "mark")
    mark, id_, of = (free_name(docs, c) for c in ("_mark", "_id", "_of"))
    marked, keys = docs.withColumn(mark, text_mark()), lambda d: [F.col("doc_id") == d[id_], F.col(mark) == d[of]]
    named = lambda d: d.select(F.col("doc_id").alias(id_), F.col("mark").alias(of))
    lost = few(named(gone))
    kept = marked.join(lost, keys(lost), "left_anti")
    if again.limit(1).count():  # repeated rows of a kept text: the only ones that have to meet
        more = few(named(again))
        once = kept.join(more, keys(more), "left_semi").dropDuplicates(["doc_id", mark])
        kept = kept.join(more, keys(more), "left_anti").unionByName(once)
    return kept.select(docs.columns)
