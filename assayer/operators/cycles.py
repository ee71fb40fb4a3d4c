"""Nodes on cycles, by shrinking what can't branch and colouring the rest with random priorities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import Scratch

#: a round that shrinks the edges to less than this share of what they were goes on shrinking before it colours
SHRUNK = 0.9
#: how tables of the search meet: their size in memory is many times that of their files, so none is sent to all tasks by way of the driver
SORTED = "merge"
#: edges that are left for one task to finish
LOCAL = 100_000


def strong_parts(edges: list[tuple]) -> list[tuple]:
    """(node, part) of the strongly connected parts of two nodes and more, in one pass over depth-first paths."""
    after, index, low, out = defaultdict(list), {}, {}, []
    for a, b in edges:
        after[a].append(b)
    stack, held = [], set()
    for root in list(after):
        if root in index:
            continue
        path = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        while path:
            node, rest = path[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    held.add(to)
                    path.append((to, iter(after.get(to, ()))))
                    break
                if to in held:
                    low[node] = min(low[node], index[to])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == index[node]:
                    part = [stack.pop()]
                    while part[-1] != node:
                        part.append(stack.pop())
                    held.difference_update(part)
                    if len(part) > 1:
                        out += [(x, node) for x in part]
    return out


class _Search:
    """The edges (a, b) that are left, and a log of what was taken out, by which nodes are told in reverse order."""

    def __init__(self, edges: DataFrame, scratch: Scratch):
        self.save, self.log, self.round = scratch, [], 0
        self.edges = scratch(edges)
        self.n = self.edges.count()

    def put(self, edges: DataFrame) -> None:
        old, self.edges = self.edges, self.save(edges)
        self.save.drop(old)
        self.n = self.edges.count()

    def hashed(self, *c: str):
        return F.xxhash64(*c, F.lit(self.round))

    # --- shrinking
    def trim(self) -> None:
        """Self-loops are noted; nodes without an edge in or out can't be on a cycle."""
        if self.round == 1:
            loops = self.save(self.edges.where("a = b").select(F.col("a").alias("node")))
            self.log.append(("loop", loops))
        e = self.edges.where("a <> b")
        tail, head = e.select(F.col("a").alias("b")).distinct(), e.select(F.col("b").alias("a")).distinct()
        self.put(e.join(tail.hint(SORTED), "b", "left_semi").join(head.hint(SORTED), "a", "left_semi").select("a", "b"))

    def chains(self) -> None:
        """Chains of nodes with one edge in and one out become single edges, all at once: both pointers of a link double until
        they leave the chain. What never leaves is a ring of its own."""
        out = self.edges.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("b").alias("up"))
        into = self.edges.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("a").alias("down"))
        links = out.join(into.hint(SORTED), "node").where("n_out = 1 AND n_in = 1").select("node", "up", "down", F.col("node").alias("low"))
        own = links.select(F.col("node").alias("_at"))
        links = links.join(own.withColumnRenamed("_at", "up").withColumn("on_up", F.lit(True)).hint(SORTED), "up", "left").join(own.withColumnRenamed("_at", "down").withColumn("on_down", F.lit(True)).hint(SORTED), "down", "left")
        links = self.save(links.select("node", "up", "down", "low", F.coalesce("on_up", F.lit(False)).alias("on_up"), F.coalesce("on_down", F.lit(False)).alias("on_down")))
        if not (n := links.count()):
            return self.save.drop(links)
        steps, moved = 0, True
        while moved and 2**steps < 2 * n and not links.where("on_up OR on_down").isEmpty():
            far = lambda end, tag: links.select(F.col("node").alias(end), F.col(end).alias(f"{tag}_to"), F.col(f"on_{end}").alias(f"{tag}_on"), F.col("low").alias(f"{tag}_low"))
            j = links.join(far("up", "u").hint(SORTED), "up", "left").join(far("down", "d").hint(SORTED), "down", "left")
            new = self.save(j.select(
                "node", F.coalesce("u_to", "up").alias("up"), F.coalesce("d_to", "down").alias("down"), F.least("low", "u_low", "d_low").alias("low"),
                F.coalesce("u_on", F.lit(False)).alias("on_up"), F.coalesce("d_on", F.lit(False)).alias("on_down"),
                (F.coalesce("u_on", F.lit(False)) != F.col("on_up")).alias("_up"), (F.coalesce("d_on", F.lit(False)) != F.col("on_down")).alias("_down"),
                (F.least("low", "u_low", "d_low") != F.col("low")).alias("_low"),
            ))
            self.save.drop(links)
            # each step takes nodes off every chain that isn't done; where none goes and no smallest node is new, only rings are left, told in full
            links, steps, moved = new, steps + 1, not new.where("_up OR _down OR _low").isEmpty()
        self.log.append(("rings", links.where("on_up OR on_down").select("node", F.col("low").alias("part"))))
        self.log.append(("chains", links.where("NOT (on_up OR on_down)").select("node", "up", "down")))
        gone = links.select(F.col("node").alias("a"))
        rest = self.edges.join(gone.hint(SORTED), "a", "left_anti").join(gone.withColumnRenamed("a", "b").hint(SORTED), "b", "left_anti")
        short = links.where("NOT (on_up OR on_down)").select(F.col("down").alias("a"), F.col("up").alias("b"))
        self.put(rest.select("a", "b").unionByName(short).distinct())
        loops = self.edges.where("a = b").select(F.col("a").alias("node"))
        if not loops.isEmpty():  # a chain whose two ends are one node
            self.log.append(("loop", self.save(loops)))
            self.put(self.edges.where("a <> b"))

    def merge(self) -> None:
        """Two nodes with edges both ways are on a cycle: the one gives its edges to the other. Of all that are so joined, nodes
        go to the neighbour with the smallest hash, if that one stays."""
        pairs = self.edges.join(self.edges.select(F.col("b").alias("a"), F.col("a").alias("b")).hint(SORTED), ["a", "b"], "left_semi")
        to = self.save(pairs.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(self.hashed("b").alias("h"), F.col("b").alias("node"))).alias("to")))
        if to.isEmpty():
            return self.save.drop(to)
        mine = F.struct(self.hashed("node").alias("h"), F.col("node").alias("node"))
        stays = to.where(mine < F.col("to")).select(F.col("node").alias("rep"))
        gone = self.save(to.where(F.col("to") < mine).select("node", F.col("to.node").alias("rep")).join(stays.hint(SORTED), "rep", "left_semi").select("node", "rep"))
        self.save.drop(to)
        self.log.append(("merge", gone))
        e = self.edges
        for end in ("a", "b"):
            e = e.join(gone.withColumnRenamed("node", end).hint(SORTED), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
        self.put(e.where("a <> b").select("a", "b").distinct())

    # --- colouring
    def spread(self, labels: DataFrame, along: DataFrame) -> DataFrame:
        """labels(node, label) after the smallest label that leads to a node along (a, b) has reached it. Every step follows the edges,
        and each node's pointer to one node before it, which doubles; it ends when no label changes."""
        back = along.groupBy(F.col("b").alias("node")).agg(F.min(F.struct(self.hashed("a", "b"), F.col("a").alias("ptr"))).alias("p")).select("node", "p.ptr")
        labels = self.save(labels.join(back.hint(SORTED), "node", "left"))
        kind = labels.schema["label"].dataType
        none = F.lit(None)
        while True:
            at = labels.schema["ptr"].dataType
            own = labels.select("node", "label", none.cast(at).alias("ptr"), F.col("label").alias("was"))
            came = along.join(labels.select(F.col("node").alias("a"), "label").hint(SORTED), "a").select(F.col("b").alias("node"), "label", none.cast(at).alias("ptr"), none.cast(kind).alias("was"))
            far = labels.select(F.col("node").alias("ptr"), F.col("label").alias("far"), F.col("ptr").alias("next"))
            leapt = labels.select("node", "ptr").where("ptr IS NOT NULL").join(far.hint(SORTED), "ptr").select("node", F.col("far").alias("label"), F.col("next").alias("ptr"), none.cast(kind).alias("was"))
            new = own.unionByName(came).unionByName(leapt).groupBy("node").agg(F.min("label").alias("label"), F.max("ptr").alias("ptr"), F.max("was").alias("was"))
            new = self.save(new.select("node", "label", "ptr", (F.col("label") != F.col("was")).alias("moved")))
            self.save.drop(labels)
            labels = new
            if labels.where("moved").isEmpty():
                return labels.select("node", "label")

    def colour(self) -> None:
        """A node's colour is the smallest priority, drawn anew, of all that lead to it. No cycle crosses colours; the nodes of a
        colour that lead back to its first node are one strongly connected part."""
        mine = F.struct(self.hashed("node").alias("h"), F.col("node").alias("node"))
        nodes = self.edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", mine)
        colours = self.spread(nodes, self.edges)
        c = lambda end: colours.select(F.col("node").alias(end), F.col("label").alias(f"c_{end}"))
        inside = self.save(self.edges.join(c("a").hint(SORTED), "a").join(c("b").hint(SORTED), "b").where("c_a = c_b").select("a", "b"))
        start = colours.select("node", F.when(F.col("node") == F.col("label.node"), 0).otherwise(1).alias("label"))
        led = self.spread(start, inside.select(F.col("b").alias("a"), F.col("a").alias("b")))
        part = led.where("label = 0").select("node").join(colours.select("node", F.col("label.node").alias("part")).hint(SORTED), "node")
        part = self.save(part)
        real = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
        self.log.append(("rings", self.save(part.join(real.hint(SORTED), "part", "left_semi").select("node", "part"))))
        gone = part.select(F.col("node").alias("a"))
        self.put(inside.join(gone.hint(SORTED), "a", "left_anti").join(gone.withColumnRenamed("a", "b").hint(SORTED), "b", "left_anti").select("a", "b"))

    def finish(self) -> None:
        """What is left, in one task."""
        kind, name = self.edges.schema["a"].dataType, self.edges.schema["a"].dataType.simpleString()
        plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x

        def parts(batches):
            rows = [r for batch in batches for r in batch.to_pylist()]
            nodes = {plain(x): x for r in rows for x in (r["a"], r["b"])}
            found = strong_parts([(plain(r["a"]), plain(r["b"])) for r in rows])
            if found:
                yield pa.RecordBatch.from_pylist([{"node": nodes[n], "part": nodes[p]} for n, p in found], schema)

        schema = pa.schema([(c, to_arrow_type(kind)) for c in ("node", "part")])
        self.log.append(("rings", self.save(self.edges.coalesce(1).mapInArrow(parts, f"node {name}, part {name}"))))
        self.n = 0

    # --- telling
    def told(self) -> DataFrame | None:
        """(node, part) of all nodes on cycles, from what was found last to what was taken out first; None where there are none."""
        on = None
        for what, frame in reversed(self.log):
            if what == "rings":
                new = frame if on is None else on.unionByName(frame)
            elif what == "loop":
                alone = frame.select("node", F.col("node").alias("part"))
                new = alone if on is None else on.unionByName(alone.join(on.select("node").hint(SORTED), "node", "left_anti"))
            elif what == "merge":
                if on is None:
                    on = self.save(frame.limit(0).select("node", F.col("rep").alias("part")))
                reps = frame.select(F.col("rep").alias("node")).distinct().join(on.hint(SORTED), "node", "left").select("node", F.coalesce("part", "node").alias("part"))
                new = on.join(reps.select("node").hint(SORTED), "node", "left_anti").unionByName(reps).unionByName(frame.join(reps.withColumnRenamed("node", "rep").hint(SORTED), "rep").select("node", "part"))
            elif on is None:
                continue
            else:  # a chain is on a cycle where both its ends are in one part
                ends = lambda end: on.select(F.col("node").alias(end), F.col("part").alias(f"p_{end}"))  # noqa: E731, B023
                found = frame.join(ends("up").hint(SORTED), "up").join(ends("down").hint(SORTED), "down").where("p_up = p_down").select("node", F.col("p_up").alias("part"))
                new = on.unionByName(found)
            new = self.save(new)
            if on is None and new.isEmpty():
                self.save.drop(new)
                continue
            self.save.drop(on)
            on = new
        return on


def cycle_nodes(edges: DataFrame, save: Callable | None = None, local: int = LOCAL) -> DataFrame:
    """Every node on a cycle of child -> parent edges: (node), with the scope columns that ``edges`` has.

    What can't be on a cycle goes, chains become single edges, nodes joined both ways become one. Where that no longer shrinks the
    graph, colours by random priorities cut it and take out strongly connected parts. There is no limit of rounds: each takes
    edges out, their number grows with the logarithm of a chain, ring or ladder, and no node is left undecided. Rows stay
    in proportion to nodes and edges. Once ``local`` edges or fewer are left, one task ends the search. Null ends are no edges; repeated edges count once; an empty table gives no rows. Tables of the
    iteration go while it runs, those that the result is read from stay.

    ``save`` is a ``Scratch``; one of its own is taken where none is given.
    """
    scratch = save if isinstance(save, Scratch) else Scratch()
    held = scratch.frames()
    scope = [c for c in ("property_id", "floor") if c in edges.columns]
    end = lambda c: F.struct(*scope, F.col(c).alias("node")) if scope else F.col(c)
    given = edges.where("child IS NOT NULL AND parent IS NOT NULL")
    s = _Search(given.select(end("child").alias("a"), end("parent").alias("b")).distinct(), scratch)
    while s.n:
        before, s.round = s.n, s.round + 1
        s.trim()
        for step in (s.chains, s.merge, s.colour):
            if 0 < s.n <= local:
                s.finish()
            if s.n and (step != s.colour or s.n >= before * SHRUNK):
                step()
    on = s.told()
    scratch.clear(s.edges if on is None else on, *held)
    if on is None:
        on = s.edges.select(F.col("a").alias("node")).where("false")
    return on.select(*[F.col(f"node.{c}") for c in scope], F.col("node.node").alias("node")).distinct() if scope else on.select("node").distinct()
