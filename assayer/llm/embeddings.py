"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, then exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settled

COSINE = 0.98
WIDTH = 1.0
#: a bucket of more rows is compared in pairs of blocks of this size
BLOCK = 2048
#: expected share of pairs at the threshold that no table finds
MISS = 1e-3


def _alike(distance: float, width: float) -> float:
    """Chance that one quantised projection of two points at a distance agrees."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def table_sizes(rows: int, cosine: float = COSINE, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """(projections a table, tables): so many projections that unlike vectors rarely meet, and tables to make up for it."""
    far, near = _alike(math.sqrt(2), width), _alike(math.sqrt(2 - 2 * cosine), width)
    k = max(6, math.ceil(math.log(max(1, rows) / 50) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``.

    Vectors of one label and size link where some table's bucket holds both and their cosine, in double precision,
    is at least ``cosine``. Equal vectors of a label are one node. Each pair is counted in the first table that
    shows it; pairs are counted where they meet and never listed, and what connects them is one row for each vector.
    Vectors travel in the type they are stored in. Rows are dealt to partitions by bucket and sorted there; a task walks
    through its buckets and holds one at a time. Buckets beyond ``BLOCK`` rows are split into blocks, and every
    pair of blocks is a bucket of its own.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do null labels
    and null ids. Repeated rows are vectors of their own. Other columns are ignored.
    """
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kept = "array<float>" if single else "array<double>"
    v = vectors.select("vec_id", "label", F.col("embedding").cast(kept).alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    nodes = v.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").cast("long").alias("id"), F.count(F.lit(1)).alias("n"))
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = table_sizes(largest, cosine)

    def sign(batches):
        planes: dict[int, tuple] = {}
        for b in batches:
            col = b.column(1)
            sizes = np.diff(col.offsets.to_numpy())
            flat, at = col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            keys = np.zeros((len(sizes), tables), np.int64)
            for d in np.unique(sizes):
                if d not in planes:
                    rng = np.random.default_rng([seed, int(d)])
                    planes[d] = rng.standard_normal((d, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.integers(1, 2**62, k) | 1
                p, shift, mix = planes[d]
                rows = np.flatnonzero(sizes == d)
                cells = np.floor((_unit(np.stack([flat[at[i] : at[i + 1]] for i in rows])) @ p + shift) / WIDTH).astype(np.int64)
                keys[rows] = (cells.reshape(len(rows), tables, k) * mix).sum(2) * 31 + d
            keys = (keys ^ (keys >> 32)).astype(np.int32)  # rows that meet by chance only are told apart by their cosine
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(keys), pa.list_(pa.int32())), col, b.column(2), b.column(3)], ["label", "keys", "embedding", "id", "n"])

    kind = vectors.schema["label"].dataType.simpleString()
    signed = settled(nodes.select("label", "embedding", "id", "n").mapInArrow(sign, f"label {kind}, keys array<int>, embedding {kept}, id long, n long"))
    slots = signed.select("label", "id", F.posexplode("keys").alias("t", "key"))
    shared = slots.groupBy("label", "t", "key").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    met = slots.join(shared, ["label", "t", "key"]).join(signed.select("id", "embedding", "keys", "n"), "id")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    met = met.withColumn("part", part).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    own = ["label", "t", "key", lo, hi, F.size("embedding")]
    names = [F.xxhash64(*own).alias("bucket"), F.xxhash64(F.lit("second"), *own).alias("second")]  # 128 bits name a bucket
    met = met.select(*names, "t", (lo == hi).alias("within"), "part", "id", "n", "embedding", "keys")
    met = met.repartition(F.col("bucket")).sortWithinPartitions("bucket", "second")

    def walk(batches):
        held, size = [], 0

        def flush():
            ids, counts, roots = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array(roots)], ["id", "links", "root"])

        for got in _links_of_buckets(batches, cosine):
            held.append(got)
            size += len(got[0])
            if size > 1 << 16:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    found = settled(met.mapInArrow(walk, "id long, links long, root long").groupBy("id", "root").agg(F.sum("links").alias("links")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = (
        signed.select("label", "embedding", "id", "n")
        .join(links, "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    out = v.where("fine").join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = v.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(col) -> np.ndarray:
    """A list column, whose lists are of one size, as a matrix."""
    return col.flatten().to_numpy().reshape(len(col), -1)


def _links_of_buckets(batches, cosine: float):
    """(ids, links, roots) for each bucket of batches sorted by bucket; one that goes on in the next batch is held until its end."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        first, second = b.column("bucket").to_numpy(), b.column("second").to_numpy()
        cuts = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
        if held and (held[-1].column("bucket")[0].as_py(), held[-1].column("second")[0].as_py()) != (first[0], second[0]):
            yield from _compared(held, cosine)
            held = []
        at = 0
        for end in cuts.tolist():
            held.append(b.slice(at, end - at))
            yield from _compared(held, cosine)
            held, at = [], end
        held.append(b.slice(at))
    if held:
        yield from _compared(held, cosine)


def _compared(parts, cosine: float):
    """Links of one bucket that no earlier table shows, and for each row the smallest row they connect it with."""
    t = pa.Table.from_batches(parts).combine_chunks()
    if len(t) < 2:
        return
    ids, n, part, table = (t.column(c).to_numpy() for c in ("id", "n", "part", "t"))
    keys, of, within = _rows(t.column("keys").combine_chunks()), int(table[0]), t.column("within")[0].as_py()
    x = _unit(_rows(t.column("embedding").combine_chunks()))
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    ii, jj = [], []
    for at in range(0, len(ids), 512):
        i, j = np.nonzero(x[at : at + 512] @ x.T >= cosine)
        i += at
        ok = i < j if within else (i < j) & (part[i] != part[j])
        i, j = i[ok], j[ok]
        if of and len(i):
            new = np.ones(len(i), bool)
            for lo in range(0, len(i), 1 << 16):
                new[lo : lo + (1 << 16)] = ~(keys[i[lo : lo + (1 << 16)], :of] == keys[j[lo : lo + (1 << 16)], :of]).any(1)
            i, j = i[new], j[new]
        for a, b in ((i, j), (j, i)):
            links += np.bincount(a, n[b], len(ids)).astype(np.int64)
        ii.append(i.astype(np.int32))
        jj.append(j.astype(np.int32))
    i, j = np.concatenate(ii), np.concatenate(jj)
    while len(i):
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            break
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
    some = np.flatnonzero(links > 0)
    if len(some):
        yield ids[some], links[some], ids[root[some]]
