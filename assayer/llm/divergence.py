"""How far the sources of a language stand apart, term by term, over the language's vocabulary as a transducer.

The vocabulary is the terms that enough documents hold. Sorted terms become minimal acyclic transducers: walking a term's
bytes adds up the outputs on the arcs to its ordinal, its place in byte order. Texts stream through them to be counted.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, tabled

LEAST_DOCS = 10
#: decimals of a share, as a factor
UNIT = 1_000_000_000
#: terms of one transducer; a language of more is cut into ranges
SHARD_TERMS = 100_000
#: bytes of transducers that every task may hold; above them terms travel to their transducer, in place of transducers to texts
CARRIED_BYTES = 64 << 20
#: bytes of text that are walked at once; keys that a task counts before it hands them on
PIECE, HELD = 4 << 20, 300_000
#: sources of a tile and terms of a block, in which pairs of sources are summed
TILE, BLOCK = 64, 4096

#: bytes -> bytes: ASCII letters in lower case and all bytes of non-ASCII characters kept, the rest blank
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> bytes:
    """The text's UTF-8 bytes, lower-cased, with a blank for every byte between terms."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES) if text else b""


class Transducer:
    """A minimal acyclic transducer of sorted distinct terms: arcs ``state << 8 | byte`` in order, where they lead and what they
    add, and the final states. State 0 is the root."""

    def __init__(self, arcs: np.ndarray, to: np.ndarray, adds: np.ndarray, final: np.ndarray):
        self.arcs, self.to, self.adds, self.final = arcs, to, adds, final

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """Incremental construction: what the next term no longer shares is looked up among the states that stand."""
        known: dict[tuple, int] = {}  # (final, arcs) -> state
        counts: list[int] = [0]  # terms below a state
        states: list[tuple] = [()]  # 0 is the root's place

        def settle(final: bool, arcs: list) -> int:
            key = (final, tuple(arcs))
            if (at := known.get(key)) is None:
                at = known[key] = len(states)
                states.append(key)
                counts.append(final + sum(counts[to] for _, to in arcs))
            return at

        path: list[list] = [[False, []]]  # the states of the last term: final, arcs
        last = b""
        for term in terms:
            same = 0
            while same < len(last) and same < len(term) and last[same] == term[same]:
                same += 1
            for depth in range(len(last), same, -1):
                node = path.pop()
                path[-1][1].append((last[depth - 1], settle(*node)))
            path += [[False, []] for _ in term[same:]]
            path[-1][0], last = True, term
        for depth in range(len(last), 0, -1):
            node = path.pop()
            path[-1][1].append((last[depth - 1], settle(*node)))
        states[0] = (path[0][0], tuple(path[0][1]))
        arcs, to, adds = [], [], []
        for at, (final, out) in enumerate(states):
            before = int(final)
            for byte, nxt in out:
                arcs.append(at << 8 | byte)
                to.append(nxt)
                adds.append(before)
                before += counts[nxt]
        return cls(np.array(arcs, np.int64), np.array(to, np.int32), np.array(adds, np.int32), np.array([s[0] for s in states], bool))

    def dumped(self) -> list[bytes]:
        return [a.tobytes() for a in (self.arcs, self.to, self.adds, self.final)]

    @classmethod
    def loaded(cls, parts: list[bytes]) -> Transducer:
        return cls(*(np.frombuffer(p, t) for p, t in zip(parts, (np.int64, np.int32, np.int32, bool), strict=True)))

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinals of the terms ``data[starts:ends]``, -1 for those that aren't in the vocabulary. All terms go
        on by one byte at a time, until each has ended or found no arc."""
        out = np.full(len(starts), -1, np.int64)
        live, at, state, total = np.arange(len(starts)), starts.copy(), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        while len(live) and len(self.arcs):
            key = state << 8 | data[at]
            found = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            on = self.arcs[found] == key
            live, found, at = live[on], found[on], at[on] + 1
            state, total = self.to[found].astype(np.int64), total[on] + self.adds[found]
            ended = at == ends[live]
            hit = ended & self.final[state]
            out[live[hit]] = total[hit]
            on = ~ended
            live, at, state, total = live[on], at[on], state[on], total[on]
        return out

    def spell(self, ordinal: int) -> bytes:
        """The term of an ordinal: at every state, the last arc that adds no more than what is left."""
        out, state = bytearray(), 0
        while True:
            low, high = np.searchsorted(self.arcs, [state << 8, (state + 1) << 8])
            if ordinal == 0 and self.final[state]:
                return bytes(out)
            k = low + int(np.searchsorted(self.adds[low:high], ordinal, side="right")) - 1
            out.append(int(self.arcs[k]) & 255)
            ordinal, state = ordinal - int(self.adds[k]), int(self.to[k])


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between blanks."""
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` cut at blanks into pieces of some ``size`` bytes."""
    at = 0
    while at < len(data):
        end = len(data) if at + size >= len(data) else data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True)


def _handed(held: dict, schema: pa.Schema) -> pa.RecordBatch:
    """Counted keys as rows; ``held`` is empty afterwards."""
    out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*((*k, n) for k, n in held.items())), schema.types, strict=True)], schema=schema)
    held.clear()
    return out


def vocabulary(texts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Rows (lang, term) of the terms that at least ``least`` documents of their lang hold; counted in each task before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def held(batches):
        seen: dict = {}
        for batch in batches:
            for lang, _, text in _rows(batch):
                for term in {t for piece in _pieces(terms_of(text), PIECE) for t in piece.split()}:
                    key = lang, term
                    seen[key] = seen.get(key, 0) + 1
                if len(seen) > HELD:
                    yield _handed(seen, schema)
        if seen:
            yield _handed(seen, schema)

    counted = texts.mapInArrow(held, "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("lang", "term")


def transducers(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Rows (lang, first, n, base, parts, bytes): the transducers of a lang's sorted terms, ``shard_terms`` each at most, with the
    ordinal of their first term. Terms are sorted over ranges; each task builds those of its range."""

    def built(batches):
        held, of = [], None

        def row():
            parts = Transducer.build(held).dumped()
            return pa.RecordBatch.from_pylist([{"lang": of, "first": held[0], "n": len(held), "parts": parts, "bytes": sum(map(len, parts))}], schema)

        for batch in batches:
            for lang, term in zip(batch["lang"].to_pylist(), batch["term"].to_pylist(), strict=True):
                if held and (lang != of or len(held) >= shard_terms):
                    yield row()
                    held = []
                of = lang
                held.append(term)
        if held:
            yield row()

    schema = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("n", pa.int64()), ("parts", pa.list_(pa.binary())), ("bytes", pa.int64())])
    made, _ = tabled(
        kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
        .mapInArrow(built, "lang string, first binary, n long, parts array<binary>, bytes long")
    )
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.select("lang", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return made.join(bases, ["lang", "first"])


COUNTS = "lang string, source string, ordinal long, n long"
COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ordinal", pa.int64()), ("n", pa.int64())])


def _streamed(texts: DataFrame, machines: DataFrame) -> DataFrame:
    """Transducers go to the texts: each batch's texts of a (lang, source) are walked together."""
    lots: dict = {}
    for r in machines.orderBy("lang", "base").collect():  # at most CARRIED_BYTES
        lots.setdefault(r["lang"], []).append((r["base"], r["n"], r["parts"]))
    sent = texts.sparkSession.sparkContext.broadcast(lots)

    def count(batches):
        ready = {lang: [(base, n, Transducer.loaded(parts)) for base, n, parts in own] for lang, own in sent.value.items()}
        held: dict = {}
        for batch in batches:
            groups: dict = {}
            for lang, source, text in _rows(batch):
                groups.setdefault((lang, source), []).append(terms_of(text))
            for (lang, source), parts in groups.items():
                held.setdefault((lang, source, -1), 0)
                for piece in _pieces(b" ".join(parts), PIECE):
                    data = np.frombuffer(piece, np.uint8)
                    starts, ends = _spans(data)
                    for base, n, machine in ready.get(lang, ()):
                        at = machine.walk(data, starts, ends)
                        times = np.bincount(at[at >= 0], minlength=n)
                        for k in np.flatnonzero(times).tolist():
                            key = lang, source, base + k
                            held[key] = held.get(key, 0) + int(times[k])
                    if len(held) > HELD:
                        yield _handed(held, COUNTS_ARROW)
        if held:
            yield _handed(held, COUNTS_ARROW)

    return texts.mapInArrow(count, COUNTS)


def _gathered(texts: DataFrame, machines: DataFrame) -> DataFrame:
    """Terms go to the transducers: tasks count their terms, and the counts meet the transducer of their range. A range's
    rows stream through the task that loaded its transducer, which comes first in the sorted partition."""
    firsts: dict = {}
    for r in machines.select("lang", "first").orderBy("lang", "first").collect():  # one row a transducer
        firsts.setdefault(r["lang"], []).append(r["first"])
    sent = texts.sparkSession.sparkContext.broadcast(firsts)
    columns = "lang string, shard binary, source string, term binary, n long"
    schema = pa.schema([("lang", pa.string()), ("shard", pa.binary()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64())])

    def count(batches):
        held: dict = {}
        for batch in batches:
            for lang, source, text in _rows(batch):
                own = sent.value.get(lang, ())
                held.setdefault((lang, b"", source, b""), 0)
                for piece in _pieces(terms_of(text), PIECE):
                    for term in piece.split():
                        if at := bisect_right(own, term):
                            key = lang, own[at - 1], source, term
                            held[key] = held.get(key, 0) + 1
                    if len(held) > HELD:
                        yield _handed(held, schema)
        if held:
            yield _handed(held, schema)

    counted = texts.mapInArrow(count, columns).groupBy("lang", "shard", "source", "term").agg(F.sum("n").alias("n"))
    heads = machines.select("lang", F.col("first").alias("shard"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("binary").alias("term"), "n", "base", "parts")
    both = counted.select("*", F.lit(None).cast("long").alias("base"), F.lit(None).cast("array<binary>").alias("parts")).unionByName(heads)

    def walk(batches):
        machine, base = None, 0
        for batch in batches:
            out: dict = {}
            run: list = []

            def done():
                if run and machine:
                    data = np.frombuffer(b" ".join(r[2] for r in run), np.uint8)
                    for (lang, source, _, n), at in zip(run, machine.walk(data, *_spans(data)).tolist(), strict=True):
                        if at >= 0:
                            out[lang, source, base + at] = n
                run.clear()

            for r in batch.to_pylist():
                if r["parts"] is not None:
                    done()
                    machine, base = Transducer.loaded(r["parts"]), r["base"]
                elif r["term"]:
                    run.append((r["lang"], r["source"], r["term"], r["n"]))
                else:
                    out[r["lang"], r["source"], -1] = 0
            done()
            if out:
                yield _handed(out, COUNTS_ARROW)

    return both.repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.col("parts").isNull()).mapInArrow(walk, COUNTS)


def _p(count, total, size):
    """1 + floor(UNIT * (count + 2) / (total + 2 * size)), in decimals, as a long."""
    above = F.expr(f"cast({count} + 2 as decimal(20,0)) * {UNIT}")
    return (F.lit(1) + F.call_function("div", above, F.expr(f"cast({total} + 2 * {size} as decimal(20,0))"))).cast("long")


def _pair_sums(t: pa.Table) -> pa.Table:
    """One block of terms and two tiles of sources: for each pair of sources, the first in the lower tile, the sum of
    floor((p - q) ** 2 / (p + q)) over the block's terms."""
    rows = {c: t[c].to_numpy(zero_copy_only=False) for c in ("g", "ordinal", "p")}
    low, high, width = (t[c][0].as_py() for c in ("low", "high", "width"))
    head = rows["ordinal"] < 0
    names, floor = rows["g"][head], rows["p"][head]
    order = np.argsort(names)
    names, floor = names[order], floor[order]
    shares = np.repeat(floor[:, None], width, axis=1)
    shares[np.searchsorted(names, rows["g"][~head]), rows["ordinal"][~head] % BLOCK] = rows["p"][~head]
    mine, theirs = np.flatnonzero(names // TILE == low), np.flatnonzero(names // TILE == high)
    out = []
    for a in mine:
        others = theirs[names[theirs] > names[a]]
        if len(others):
            d = shares[others] - shares[a]
            out.append((np.full(len(others), names[a]), names[others], (d * d // (shares[others] + shares[a])).sum(axis=1)))
    a, b, v = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
    return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(a), pa.string()), "a": a.astype(np.int64), "b": b.astype(np.int64), "value": v.astype(np.int64)})


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = 10, shard_terms: int = SHARD_TERMS, carried: int = CARRIED_BYTES) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair``: every other source of the lang, by how far the two stand apart over all terms that the lang keeps. Part
    ``term``: the ``top`` kept terms that the source uses more than its lang, by what they add. Ranks go by value, then
    the item's bytes (for terms, their ordinal). Null lang, source and text count as empty. A lang without kept terms has pairs of
    value 0 and no terms; a lang of one source has no pairs; empty tables give no rows. Repeated rows count each time; other
    columns of ``docs`` are ignored; texts of any length are counted whole, in pieces. Integers throughout, divisions in decimals.

    Pairs are the result that is asked for, S * (S - 1) of a lang's S sources. They are summed by blocks of terms
    and tiles of sources, so a task holds ``2 * TILE * BLOCK`` shares at most, whatever the vocabulary.
    """
    texts = _keyed(docs)
    kept, _ = tabled(vocabulary(texts, least))
    machines, _ = tabled(transducers(kept, shard_terms))
    small = (machines.agg(F.sum("bytes")).first()[0] or 0) <= carried
    walked = (_streamed if small else _gathered)(texts, machines)
    counts, _ = tabled(walked.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))

    sizes = machines.groupBy("lang").agg(F.sum("n").alias("v"))
    used = counts.where("ordinal >= 0")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups, _ = tabled(
        totals.join(sizes, "lang", "left")
        .select("lang", "source", "total", F.coalesce("v", F.lit(0)).alias("v"), F.sum("total").over(Window.partitionBy("lang")).alias("lang_total"),
                (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("g"))
    )
    shared = used.join(groups, ["lang", "source"]).withColumn("p", _p("n", "total", "v"))

    # pairs: each group's share of a term it lacks stands in a row of its own in every block
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(v - 1) div {BLOCK}"), F.lit(0).cast("long")))
    heads = groups.select("lang", "g", "v", F.lit(-1).cast("long").alias("ordinal"), F.when(F.col("v") > 0, _p("0", "total", "greatest(v, 1)")).otherwise(1).cast("long").alias("p"), F.explode(blocks).alias("block"))
    filled = heads.unionByName(shared.select("lang", "g", "v", "ordinal", "p", F.expr(f"ordinal div {BLOCK}").alias("block")))
    tiles = groups.groupBy("lang").agg(F.expr(f"max(g) div {TILE}").alias("last"))
    tile = F.expr(f"g div {TILE}")
    dealt = (
        filled.join(tiles, "lang").withColumn("mine", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        .select("lang", "g", "ordinal", "p", "block", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"),
                F.greatest(F.least(F.lit(BLOCK).cast("long"), F.col("v") - F.col("block") * BLOCK), F.lit(0).cast("long")).alias("width"))
    )
    summed = dealt.groupBy("lang", "block", "low", "high").applyInArrow(_pair_sums, "lang string, a long, b long, value long")
    pairs = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "g", "source")
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    said = both.join(names.withColumnRenamed("g", "a"), ["lang", "a"]).join(names.select("lang", F.col("g").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    own = Window.partitionBy("lang", "source")
    pair_rows = said.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(own.orderBy(F.desc("value"), "item")).alias("rank"))

    # terms: against the lang's own counts of the same ordinals
    every = used.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    q = _p("lang_n", "lang_total", "v")
    above = shared.join(every, ["lang", "ordinal"]).withColumn("q", q).where("p > q").withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))
    best = above.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    ordered = _with_terms(best.select("lang", "source", "ordinal", "value", "rank"), machines)
    term_rows = ordered.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    return pair_rows.unionByName(term_rows)


def _with_terms(rows: DataFrame, machines: DataFrame) -> DataFrame:
    """``rows`` with the term of each ordinal: the arcs whose outputs lead to it, read in the transducer of its range."""
    ranges = machines.select("lang", "base", "n")
    asked = rows.select("lang", "ordinal").distinct().join(ranges, ["lang"]).where("ordinal >= base AND ordinal < base + n").select("lang", "base", "ordinal")
    wanted = asked.groupBy("lang", "base").agg(F.collect_set("ordinal").alias("asked")).join(machines.select("lang", "base", "parts"), ["lang", "base"])

    def spelled(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                machine = Transducer.loaded(r["parts"])
                out += [{"lang": r["lang"], "ordinal": o, "term": machine.spell(o - r["base"])} for o in r["asked"]]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("ordinal", pa.int64()), ("term", pa.binary())]))

    return rows.join(wanted.mapInArrow(spelled, "lang string, ordinal long, term binary"), ["lang", "ordinal"])


def oracle_sql(least: int = LEAST_DOCS, top: int = 10) -> str:
    """The same result for DuckDB, every term against every term."""
    word = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {least}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS total, coalesce(v.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang)),
full_p AS (SELECT lang, source, term, coalesce(n, 0) AS n,
  1 + ({UNIT}::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
lang_p AS (SELECT lang, term, 1 + ({UNIT}::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q
  FROM full_p JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, (SELECT coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)
    FROM full_p x JOIN full_p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM full_p JOIN lang_p USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= {top}"""
