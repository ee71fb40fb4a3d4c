"""A Merkle manifest of a table: leaves by rows, one tree a language, and one tree over their roots.

A parent hashes its children's digests one after another. It keeps a copy of the hash state before each child, so when one
child changes, its new digest and the siblings to its right are all that is hashed again; the left ones stand in the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, tabled

#: children of a parent; levels of the tree that one task builds, so a task holds ARITY ** DEPTH digests at most
ARITY, DEPTH = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64  # characters of a digest


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def leaf(**changed: Column) -> Column:
    """The digest of a row: each field with its length in bytes, ``-`` for null. ``changed`` replaces fields by name."""
    fields = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    told = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*told), 256)


class Tree:
    """Some consecutive nodes' common tree: ``levels`` levels of parents, each with its hash states and its runs of children."""

    def __init__(self, digests: list[bytes], levels: int, arity: int):
        self.arity, self.runs, self.states = arity, [], []
        for _ in range(levels):
            runs = [b"".join(digests[i : i + arity]) for i in range(0, len(digests), arity)]
            states, digests = [], []
            for run in runs:
                h = hashlib.sha256()
                for at in range(0, len(run), HEX):
                    states.append(h.copy())
                    h.update(run[at : at + HEX])
                digests.append(h.hexdigest().encode())
            self.runs.append(runs)
            self.states.append(states)
        self.roots = digests

    def siblings(self, i: int) -> list[tuple[bytes, bytes]]:
        """Node ``i``'s siblings on its left and right, level by level."""
        out = []
        for runs in self.runs:
            run, at = runs[i // self.arity], i % self.arity * HEX
            out.append((run[:at], run[at + HEX :]))
            i //= self.arity
        return out

    def fold(self, i: int, digest: bytes) -> bytes:
        """The root if node ``i`` had ``digest``: every parent resumes from its state before the child."""
        for runs, states in zip(self.runs, self.states, strict=True):
            h = states[i].copy()
            h.update(digest)
            h.update(runs[i // self.arity][(i % self.arity + 1) * HEX :])
            digest, i = h.hexdigest().encode(), i // self.arity
        return digest


def _levels(n: int, arity: int, depth: int) -> int:
    """Levels to build over a part of ``n`` nodes: all until one node is left, ``depth`` at most."""
    k = 0
    while n > 1 and k < depth:
        n, k = -(-n // arity), k + 1
    return k


def _nodes(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.argsort(t["pos"].to_numpy(), kind="stable")))


def _tree(t: pa.Table, arity: int, depth: int) -> Tree:
    return Tree([d.encode() for d in t["digest"].to_pylist()], _levels(t["n"][0].as_py(), arity, depth), arity)


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with pos, their place within their part by ``order`` from 0, and n, the part's nodes.

    Sorted over ranges, so a part of any size is dealt to many tasks; the ranges' counts give the offsets.
    """
    ranged = nodes.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    placed, _ = tabled(ranged.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at")))
    part = Window.partitionBy("part")
    spans = placed.groupBy("part", "pid").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("m")).select(
        "part", "pid", "low", F.sum("m").over(part).alias("n"),
        F.coalesce(F.sum("m").over(part.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    pos = (F.col("before") + F.col("at") - F.col("low")).alias("pos")
    return placed.join(spans, ["part", "pid"]).select(*nodes.columns, pos, "n")


def _blocks(nodes: DataFrame, arity: int, depth: int):
    return nodes.withColumn("block", F.expr(f"pos div {arity**depth}")).groupBy("part", "block")


def _risen(nodes: DataFrame, arity: int, depth: int) -> list[DataFrame]:
    """Tables of nodes, each with the roots of the blocks of the one before, up to one node a part."""
    span = arity**depth

    def root(t: pa.Table) -> pa.Table:
        t = _nodes(t)
        n, block = t["n"][0].as_py(), t["pos"][0].as_py() // span
        digest = _tree(t, arity, depth).roots[0].decode()
        return pa.table({"part": [t["part"][0].as_py()], "pos": [block], "n": [-(-n // span)], "digest": [digest]}, out_schema)

    out_schema = pa.schema([("part", pa.binary()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    tables = [nodes]
    while True:
        up, _ = tabled(_blocks(tables[-1].select("part", "pos", "n", "digest"), arity, depth).applyInArrow(root, "part binary, pos long, n long, digest string"))
        tables.append(up)
        if (up.agg(F.max("n")).first()[0] or 1) == 1:
            return tables


ABOVE = "array<struct<left:binary,right:binary>>"


def _sunk(tables: list[DataFrame], tops: DataFrame, arity: int, depth: int) -> DataFrame:
    """For the nodes of ``tables[0]`` (part, pos): ``above``, the siblings of its levels up to the root, from those of the parts'
    roots, ``tops`` (part, pos, above, subroot, root)."""

    def down(nodes: pa.Table, over: pa.Table) -> pa.Table:
        nodes = _nodes(nodes)
        tree, rest = _tree(nodes, arity, depth), over["above"][0].as_py()
        paths = [[{"left": a, "right": b} for a, b in tree.siblings(i)] + rest for i in range(len(nodes))]
        told = {c: [over[c][0].as_py()] * len(nodes) for c in ("subroot", "root")}
        return pa.table({"part": nodes["part"], "pos": nodes["pos"], "above": pa.array(paths, over.schema.field("above").type), **told})

    for nodes in reversed(tables):
        tops, _ = tabled(
            _blocks(nodes.select("part", "pos", "n", "digest"), arity, depth)
            .cogroup(tops.groupBy("part", "pos"))
            .applyInArrow(down, f"part binary, pos long, above {ABOVE}, subroot string, root string")
        )
    return tops


def manifest(
    docs: DataFrame, tampered: Callable[[Column], Column] = lowered, share: int = 3, arity: int = ARITY, depth: int = DEPTH
) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot (of its lang), root, proof_sha256, folded_root, verified.

    Leaves stand by doc_id (null first; equal ids by digest) within their lang, langs by UTF-8 bytes (null first, apart from
    the empty one). Where ``share`` divides the crc32 of the doc_id, the text becomes ``tampered(text)``; folded_root folds the
    leaf so made through the tree, and verified says whether the root comes out. A null doc_id isn't tampered with, nor is a
    null text. Repeated rows are leaves of their own, with equal digests side by side. Other columns of ``docs`` are not read;
    empty tables give no rows; texts of any length are hashed whole. A table of one row has its leaf for a root, and an empty proof.

    Tasks hold ``arity ** depth`` digests at most, whatever a lang's size: blocks of consecutive leaves, then blocks of their roots.
    """
    part = F.when(F.col("lang").isNull(), F.unhex(F.lit(""))).otherwise(F.concat(F.unhex(F.lit("01")), F.col("lang").cast("string").cast("binary")))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % share == 0, F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), leaf().alias("digest"),
        F.when(hit, leaf(text=tampered(F.col("text")))).alias("changed"),
    )
    leaves, _ = tabled(numbered(rows, "doc_id", "digest"))
    langs = _risen(leaves, arity, depth)
    subroots = numbered(langs[-1].select(F.lit(b"").alias("part"), F.col("part").alias("lang"), "digest"), "lang")
    subroots, _ = tabled(subroots)
    tops = _risen(subroots, arity, depth)
    none = F.array().cast(ABOVE).alias("above")
    over = _sunk(tops[:-1], tops[-1].select("part", "pos", none, F.lit("").alias("subroot"), F.col("digest").alias("root")), arity, depth)
    roots = over.join(subroots.select("part", "pos", "lang", "digest"), ["part", "pos"]).select(
        F.col("lang").alias("part"), F.lit(0).cast("long").alias("pos"), "above", F.col("digest").alias("subroot"), "root"
    )
    blocks = _sunk(langs[1:-1], roots, arity, depth)

    def prove(nodes: pa.Table, over: pa.Table) -> pa.Table:
        nodes = _nodes(nodes)
        tree, above = _tree(nodes, arity, depth), over["above"][0].as_py()
        upper = [(hashlib.sha256(s["left"]), s["right"]) for s in above]
        tail = b"".join(s["left"] + s["right"] for s in above)
        root, digests, changed = over["root"][0].as_py(), nodes["digest"].to_pylist(), nodes["changed"].to_pylist()
        proofs, folded = [], []
        for i, (digest, other) in enumerate(zip(digests, changed, strict=True)):
            proofs.append(hashlib.sha256(b"".join(s for pair in tree.siblings(i) for s in pair) + tail).hexdigest())
            at = tree.fold(i, (other or digest).encode())
            for state, right in upper:
                h = state.copy()
                h.update(at)
                h.update(right)
                at = h.hexdigest().encode()
            folded.append(at.decode())
        every = {c: [over[c][0].as_py()] * len(nodes) for c in ("subroot", "root")}
        return pa.table({"doc_id": nodes["doc_id"], "leaf": nodes["digest"], **every, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _blocks(leaves, arity, depth).cogroup(blocks.groupBy("part", "pos")).applyInArrow(prove, schema)


def oracle_sql(levels: int = 8) -> str:
    """The same result for DuckDB, level by level, for trees of ``levels`` levels at most."""
    def field(c):
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    def digest(text):
        return "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"

    # the table of the reflected CRC-32 polynomial, from its rule
    step = ["(SELECT i, i AS v FROM range(256) s(i))"]
    for _ in range(8):
        step.append(f"(SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END AS v FROM {step[-1]})")
    bytes_of = "list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)"
    sql = [
        f"crcs AS (SELECT list(v ORDER BY i) AS steps FROM {step[-1]})",
        f"""c AS (SELECT documents.*, xor(4294967295::BIGINT, list_reduce({bytes_of}, lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS crc FROM documents, crcs)""",
        f"""r AS (SELECT *, CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS other FROM (
  SELECT doc_id, lang, crc, {digest("text")} AS leaf, {digest(f"translate(text, '{UPPER}', '{LOWER}')")} AS changed FROM c))""",
        "n0 AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, leaf AS d, doc_id, other FROM r)",
        "f0 AS (SELECT doc_id, lang, pos, n, d AS leaf, other AS folded, '' AS proof FROM n0)",
    ]

    def up(nodes, fold, k, key):
        same = f"a.{key} IS NOT DISTINCT FROM b.{key}"
        sql.append(f"""{nodes}p{k} AS (SELECT {key}, pos // 8 AS pos, n, string_agg(d, '' ORDER BY pos) AS s FROM {nodes}{k} GROUP BY {key}, pos // 8, n)""")
        sql.append(f"""{nodes}{k + 1} AS (SELECT {key}, pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS d FROM {nodes}p{k})""")
        left, right = "substr(b.s, 1, 64 * (a.pos % 8))", "substr(b.s, 64 * (a.pos % 8) + 65)"
        further = ", a.lang, a.subroot" if key == "one" else ""
        sql.append(f"""{fold}{k + 1} AS (SELECT a.doc_id, a.{key}, a.pos // 8 AS pos, (a.n + 7) // 8 AS n, a.leaf{further},
  CASE WHEN a.n > 1 THEN sha256({left} || a.folded || {right}) ELSE a.folded END AS folded,
  CASE WHEN a.n > 1 THEN a.proof || {left} || {right} ELSE a.proof END AS proof
  FROM {fold}{k} a JOIN {nodes}p{k} b ON {same} AND a.pos // 8 = b.pos)""")

    for k in range(levels):
        up("n", "f", k, "lang")
    sql.append(f"t0 AS (SELECT 1 AS one, lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM n{levels})")
    sql.append(f"g0 AS (SELECT f.doc_id, 1 AS one, f.lang, t.pos, t.n, f.leaf, f.folded, f.proof, t.d AS subroot FROM f{levels} f JOIN t0 t ON f.lang IS NOT DISTINCT FROM t.lang)")
    for k in range(2):
        up("t", "g", k, "one")
    return "WITH " + ",\n".join(sql) + """
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified FROM g2, t2"""
