"""Benchmark decontamination: short test items inside long documents."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, settled, sliced, words_of

SHINGLE = 5
THRESHOLD = 0.8
#: characters of benchmark text that one pass over the documents carries; more text takes more passes
PASS_CHARS = 32_000_000


def shingles(words: list[bytes], width: int = SHINGLE) -> set[tuple]:
    return set(zip(*(words[k:] for k in range(width)), strict=False))


class Items:
    """Sketches of benchmark items, in partitions by size.

    An item of n distinct shingles is in a document if at least need = ceil(0.8 n) of them are. Such a document lacks
    n - need at most, so it holds one of the item's n - need + 1 smallest hash values: that bottom sketch loses
    nothing, where bands of whole-document signatures would (a short item's Jaccard similarity to a long
    document is near zero). Partitions by powers of two of n let documents skip those whose items need more
    shingles than the document has. Every word of the items has a number, and shingles are kept and compared as rows of
    these numbers: 28 bytes each with the hash value.
    """

    def __init__(self, items: list[tuple[int, str]], width: int = SHINGLE, threshold: float = THRESHOLD):
        self.width = width
        split = [(i, words_of(t)) for i, t in items]
        self.ids = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
        self.items, partitions = {}, {}
        for item, ws in split:
            own = shingles(ws, width)
            if not own:
                continue
            need = math.ceil(threshold * len(own) - 1e-9)
            rows = np.array([[self.ids[w] for w in s] for s in own], np.uint32)
            codes = self.hashed(rows.T)
            order = np.argsort(codes)
            self.items.setdefault(item, []).append((rows, need, codes))
            partitions.setdefault(len(own).bit_length(), []).append((item, need, codes[order[: len(own) - need + 1]]))
        self.partitions = []
        for part in partitions.values():
            values = np.concatenate([s for _, _, s in part])
            owners = np.concatenate([np.full(len(s), k) for k, (_, _, s) in enumerate(part)])
            order = np.argsort(values, kind="stable")
            self.partitions.append((min(n for _, n, _ in part), values[order], owners[order], [i for i, _, _ in part]))

    @staticmethod
    def hashed(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h + c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def within(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, shingles shared, shingles of the item) for every item that the text contains."""
        words = words_of(text)
        n = len(words) - self.width + 1
        if n < 1 or not self.partitions:
            return []
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        known = ids > 0
        full = known[:n].copy()
        for k in range(1, self.width):
            full &= known[k : n + k]
        at = np.flatnonzero(full)
        if not len(at):
            return []
        codes = self.hashed([ids[at + k] for k in range(self.width)])
        distinct = np.unique(codes)
        found = set()
        for need, values, owners, names in self.partitions:
            if len(distinct) < need:
                continue
            lo, hi = np.searchsorted(values, distinct, "left"), np.searchsorted(values, distinct, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update(names[o] for o in owners[a:b].tolist())
        out = []
        for item in sorted(found):
            for rows, need, own_codes in self.items[item]:
                hits = at[np.isin(codes, own_codes)]
                here = set(zip(*(ids[hits + k].tolist() for k in range(self.width)), strict=True))
                shared = len(here & set(map(tuple, rows.tolist())))
                if shared >= need:
                    out.append((item, shared, len(rows)))
        return out


def item_passes(benchmark: DataFrame) -> list[DataFrame]:
    """The distinct items in parts of at most ``PASS_CHARS`` characters (or one item): one part, or more by a hash of the row."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    n = math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / PASS_CHARS)
    if n <= 1:
        return [items]
    while True:
        dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        sizes = dealt.groupBy("part").agg(F.sum(F.length("text")).alias("size"), F.count(F.lit(1)).alias("n"))
        if not sizes.where(f"size > {PASS_CHARS} AND n > 1").limit(1).count():
            return [dealt.where(F.col("part") == k).drop("part") for k in range(n)]
        n += math.ceil(n / 4)


def _finder(part: DataFrame, threshold: float) -> Items:
    return Items([(r["item_id"], r["text"]) for r in part.collect()], threshold=threshold)  # PASS_CHARS at most


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs doc_id, item_id, n_shared, n_shingles, containment: at least ``threshold`` of the item's distinct shingles of
    five words stand in the document, wherever they stand.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Items of fewer than five words have
    no shingle and match nothing; neither do null texts or null item ids. Repeated rows give a pair once.
    Whole documents, however long, are searched, one batch after another; nothing is shuffled but the pairs. A benchmark of
    more than one part is searched part by part, each of which is done and let go before the next is read.
    """
    passes, out = item_passes(benchmark), None
    own = docs.select(F.col("doc_id").cast("long"), "text")
    for part in passes:
        items = _finder(part, threshold)

        def run(batches, items=items):
            for b in sliced(batches):
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in items.within(t)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_shared", "n_shingles"])

        pairs = own.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_shingles long")
        pairs = settled(pairs) if len(passes) > 1 else pairs
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct().withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item; rows and columns otherwise as they are.

    Nothing is shuffled where the benchmark is one part. Where it is more, each part's documents are found and kept as
    digests of (doc_id, text), and all of them are dropped by one join.
    """
    passes = item_passes(benchmark)
    if len(passes) == 1:
        items = _finder(passes[0], threshold)

        def clean(batches):
            for b in sliced(batches):
                yield b.filter(pa.array([not items.within(t) for t in b.column("text").to_pylist()], pa.bool_()))

        return docs.mapInArrow(clean, docs.schema)
    digest, found = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256), None
    own = docs.select(digest.alias("_digest"), "text")
    for part in passes:
        items = _finder(part, threshold)

        def search(batches, items=items):
            for b in sliced(batches):
                yield b.select(["_digest"]).filter(pa.array([bool(items.within(t)) for t in b.column("text").to_pylist()], pa.bool_()))

        here = settled(own.mapInArrow(search, "_digest string").distinct())
        found = here if found is None else found.unionByName(here)
    name = free_name(docs, "_digest")
    gone = found.distinct().withColumnRenamed("_digest", name)
    return docs.withColumn(name, digest).join(gone, name, "left_anti").select(docs.columns)


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """Every shingle of every document against every item's, for DuckDB."""
    words = r"regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "SELECT DISTINCT {k}, ws[i:i+4] AS s FROM (SELECT {k}, ws, unnest(range(1, len(ws) - 3)) AS i FROM (SELECT {k}, " + words + " AS ws FROM {t}))"
    return f"""
WITH i AS ({grams.format(k='item_id', t='benchmark')}), d AS ({grams.format(k='doc_id', t='documents')}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n)::BIGINT AS n_shingles, count(*)::DOUBLE / any_value(n) AS containment
FROM i JOIN d USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil({threshold} * any_value(n) - 1e-9)"""
