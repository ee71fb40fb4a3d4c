"""Language-model scoring: masked pseudo-likelihood of a network that sees a word's neighbours on both sides.

log p(word | neighbours) = log p(class | neighbours) + log p(word | class). Classes are the edge of a text, the most frequent words,
one each, up to a share of all tokens, and buckets of the other words by their last letters. The network reads the
classes of the neighbours as embeddings and predicts the class in two steps, a group of classes and the class within it, both
from its hidden layer; the counts of the whole corpus tell the word within a bucket.
"""

from __future__ import annotations

import math
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, words_of

#: words that a piece of the corpus holds; a longer text is a piece of its own
PIECE = 1_000_000
#: neighbours on each side
SIDE = 2
WIDTH = 16
BATCH = 1024
#: words that are classes of their own: as many as cover this share of all tokens, and no more than this number
COVER, OWN = 0.9, 512
#: they stand at least so often, so that a text's own use of a word doesn't vouch for it
LEAST_OWN = 20
#: distinct words of a bucket, at least on average: a bucket of one word would tell nothing of how rare it is
SHARED = 64
#: rounds in which each task trains on its own texts, with the weights and the optimiser's moments averaged after each
ROUNDS = 6
#: a small corpus is passed over until so many windows have been seen
LEAST_WINDOWS = 120_000
RATE = 0.01
#: added to every word's count, so that a word that no other text holds has a chance as well
UNSEEN = 0.1
#: sets of weights that reach the driver in a round, at most
GROUPS = 32


def pieces(docs: DataFrame) -> DataFrame:
    """The corpus cut into words, in rows of about ``PIECE`` words: piece, doc_ids, sizes, ids (32-bit numbers of the
    words within the piece, compressed), and for the piece's distinct words, in that order, their keys (XXH64), tails (crc32 of the
    last three bytes) and counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known, ids, sizes, names, at = {}, array("i"), [], [], TaskContext.get().partitionId() << 33

        def flush():
            flat = np.frombuffer(ids, np.int32)
            counts = np.bincount(flat, minlength=len(known)).astype(np.int32)
            keys = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in known), np.uint64, len(known)).view(np.int64)
            tails = np.fromiter((zlib.crc32(w[-3:]) for w in known), np.uint32, len(known)).view(np.int32)
            columns = [
                pa.array([at], pa.int64()), pa.LargeListArray.from_arrays([0, len(sizes)], pa.concat_arrays(names)).cast(pa.list_(names[0].type)), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([pa.compress(flat.tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([keys], pa.list_(pa.int64())), pa.array([tails], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["piece", "doc_ids", "sizes", "ids", "keys", "tails", "counts"])

        for b in batches:
            begun = 0
            for i, text in enumerate(b.column(1).to_pylist()):
                words = words_of(text)
                ids.extend([known.setdefault(w, len(known)) for w in words])
                sizes.append(len(words))
                if len(ids) >= PIECE:
                    names.append(b.column(0).slice(begun, i + 1 - begun))
                    yield flush()
                    known, ids, sizes, names, at, begun = {}, array("i"), [], [], at + 1, i + 1
            if begun < b.num_rows:
                names.append(b.column(0).slice(begun))
        if sizes:
            yield flush()

    return settled(docs.select("doc_id", "text").mapInArrow(run, f"piece long, doc_ids array<{kind}>, sizes array<int>, ids binary, keys array<long>, tails array<int>, counts array<int>"))


@dataclass
class Classes:
    """How words fall into classes: ``own`` names those of the frequent words (key to class), the others follow by their
    last three bytes; totals and distinct words of each class."""

    own: dict[int, int]
    buckets: int
    totals: np.ndarray
    distinct: np.ndarray

    @property
    def n(self) -> int:
        return 1 + len(self.own) + self.buckets


def word_classes(counted: DataFrame) -> Classes:
    """Classes for ``counted(key, n, tail)``, one row for each distinct word of the corpus: own words by COVER, OWN and LEAST_OWN, and
    buckets of SHARED words, fewer than OWN. What reaches the driver is a row for each class."""
    seen = counted.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).first()
    top = counted.where(F.col("n") >= LEAST_OWN).orderBy(F.desc("n"), "key").limit(OWN).select("key", "n").collect()
    share = np.cumsum([r["n"] for r in top]) if top else np.zeros(0)
    n_own = int(np.searchsorted(share, COVER * (seen["n"] or 0))) + 1
    own = {r["key"]: k for k, r in enumerate(top[:n_own], 1)}
    classes = Classes(own, max(1, min(OWN - 1, seen["words"] // SHARED)), np.zeros(1), np.zeros(1))
    per = classed(counted, classes).groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    classes.totals, classes.distinct = np.zeros(classes.n), np.zeros(classes.n)
    for r in per:
        classes.totals[r["cls"]], classes.distinct[r["cls"]] = r["n"], r["words"]
    return classes


def classed(words: DataFrame, classes: Classes) -> DataFrame:
    """``words(key, tail, ...)`` with cls; ``own`` is true for frequent words."""
    spark = words.sparkSession
    known = spark.createDataFrame(list(classes.own.items()) or [(0, 0)], "key long, _cls int").where("_cls > 0")  # some hundred rows at most
    d = words.join(F.broadcast(known), "key", "left")
    rest = (F.pmod("tail", F.lit(classes.buckets)) + F.lit(1 + len(classes.own))).cast("int")
    return d.withColumn("own", F.col("_cls").isNotNull()).withColumn("cls", F.coalesce("_cls", rest)).drop("_cls")


def word_scores(ids: np.ndarray, sizes: np.ndarray, cls: np.ndarray, count: np.ndarray, classes: Classes) -> np.ndarray:
    """For each text the sum of log p(word | class) over its words, by the counts of all other texts: a text's own words are
    taken off, so that it doesn't vouch for itself. cls and count stand by the words' numbers; frequent words have count 0."""
    out = np.zeros(len(sizes))
    text = np.repeat(np.arange(len(sizes)), sizes)
    rare = count[ids] > 0
    if not rare.any():
        return out
    text, ids = text[rare], ids[rare]
    pair, n = np.unique(text * np.int64(len(cls)) + ids, return_counts=True)
    of, word = pair // len(cls), pair % len(cls)
    c = cls[word]
    slot, at = np.unique(of * np.int64(classes.n) + c, return_inverse=True)
    held = np.bincount(at, n, len(slot))[at]  # words of that class in the text
    logp = np.log(count[word] - n + UNSEEN) - np.log(classes.totals[c] - held + UNSEEN * classes.distinct[c])
    return out + np.bincount(of, n * logp, len(sizes))


def numbered(corpus: DataFrame, counted: DataFrame, classes: Classes) -> DataFrame:
    """The corpus as classes: doc_ids, sizes, cls (16 bits for each word, compressed), word_scores. Each piece meets the counts of its words
    in a shuffle by piece; words meet their counts in a shuffle by word."""
    words = classed(_dictionary(corpus), classes)
    rare = words.where("NOT own").select("key", "piece", "pos", "cls").join(counted.select("key", F.col("n").alias("count")), "key")
    back = rare.select("piece", "pos", "cls", "count").unionByName(words.where("own").select("piece", "pos", "cls", F.lit(0).cast("long").alias("count")))
    kind = corpus.schema["doc_ids"].dataType.simpleString()

    def meet(texts: pa.Table, told: pa.Table) -> pa.Table:
        cls, count = np.zeros(len(told) + 1, np.uint16), np.zeros(len(told) + 1, np.int64)
        pos = told.column("pos").to_numpy()
        cls[pos], count[pos] = told.column("cls").to_numpy(), told.column("count").to_numpy()
        sizes = np.array(texts.column("sizes")[0].as_py(), np.int64)
        ids = np.frombuffer(pa.decompress(texts.column("ids")[0].as_py(), 4 * int(sizes.sum()), "zstd", asbytes=True), np.int32)
        scores = word_scores(ids, sizes, cls, count, classes)
        return pa.table([texts.column("doc_ids"), texts.column("sizes"), pa.array([pa.compress(cls[ids].tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([scores], pa.list_(pa.float64()))], ["doc_ids", "sizes", "cls", "word_scores"])

    left = corpus.select("piece", "doc_ids", "sizes", "ids").groupBy("piece")
    told_by = back.select(F.col("piece").alias("of"), "pos", "cls", "count").groupBy("of")
    return settled(left.cogroup(told_by).applyInArrow(meet, f"doc_ids {kind}, sizes array<int>, cls binary, word_scores array<double>"))


def _dictionary(corpus: DataFrame) -> DataFrame:
    d = corpus.select("piece", F.posexplode(F.arrays_zip("keys", "tails", "counts")).alias("pos", "w"))
    return d.select("piece", "pos", F.col("w.keys").alias("key"), F.col("w.tails").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tail"), F.col("w.counts").alias("n"))


def unpacked(cls: bytes, sizes: np.ndarray) -> np.ndarray:
    """The classes of a piece's words."""
    return np.frombuffer(pa.decompress(cls, 2 * int(sizes.sum()), "zstd", asbytes=True), np.uint16)


def windows(cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The classes of the SIDE neighbours before and after every word, a row each; beyond either end of a text stands class 0."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(cls)) + SIDE * (text + 1)
    padded = np.zeros(len(cls) + SIDE * (len(sizes) + 1), np.uint16)
    padded[at] = cls
    out = np.empty((len(cls), 2 * SIDE), np.uint16)
    for column, k in enumerate(k for k in range(-SIDE, SIDE + 1) if k):
        out[:, column] = padded[at + k]
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    """Log-probabilities by rows, in place."""
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


class Network:
    """Embeddings of the neighbours, mixed by their places, one tanh layer, and a softmax of two steps: class ``c`` is member
    ``c // side`` of group ``c % side``; with Adam's moments."""

    def __init__(self, n: int, flat: np.ndarray, steps: int = 0):
        self.n, self.flat, self.steps, self.side = n, flat, steps, math.ceil(math.sqrt(n))
        self.weights, self.first, self.second = np.split(flat, 3)  # views: training changes ``flat``
        self.parts = self._split(self.weights)

    @staticmethod
    def shapes(n: int) -> list[tuple]:
        side = math.ceil(math.sqrt(n))
        return [(n, WIDTH), (2 * SIDE * WIDTH, WIDTH), (WIDTH,), (WIDTH, side), (side,), (side, WIDTH, side), (side, side)]

    def _split(self, flat: np.ndarray) -> list[np.ndarray]:
        shapes = self.shapes(self.n)
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return [p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)]

    @classmethod
    def fresh(cls, totals: np.ndarray, seed: int = 3):
        n = len(totals)
        net = cls(n, np.zeros(3 * sum(int(np.prod(s)) for s in cls.shapes(n)), np.float32))
        rng, (e, mix, _, u, c, inner, d) = np.random.default_rng(seed), net.parts
        e[:] = rng.normal(0, 0.3, e.shape)
        mix[:] = rng.normal(0, 0.25, mix.shape)
        u[:] = rng.normal(0, 0.1, u.shape)
        inner[:] = rng.normal(0, 0.1, inner.shape)
        share = np.zeros(net.side**2)
        share[: len(totals)] = (totals + 1.0) / (totals.sum() + n)
        table = share.reshape(net.side, net.side).T  # group, member
        c[:] = np.log(table.sum(1) + 1e-12)
        d[:] = np.where(table > 0, np.log(np.where(table > 0, table, 1) / np.maximum(table.sum(1, keepdims=True), 1e-12)), -30)
        return net

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours' embeddings side by side, and the hidden layer."""
        e, mix, b = self.parts[:3]
        x = e.take(context.ravel(), 0).reshape(len(context), -1)
        h = x @ mix
        h += b
        return x, np.tanh(h, out=h)

    def within(self, h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Log-probabilities of the members of each row's group; rows stand by group. The rows of each group, as (group, slice)."""
        inner, d = self.parts[5:]
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        runs = [(int(group[i]), slice(i, j)) for i, j in zip(begins, [*begins[1:], len(group)], strict=True)]
        z = np.empty((len(h), self.side), np.float32)
        for g, part in runs:
            np.matmul(h[part], inner[g], out=z[part])
            z[part] += d[g]
        return _softmax(z), runs

    def log_probs(self, cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log p(class | neighbours) of every word of the texts."""
        context, out = windows(cls, sizes), np.empty(len(cls), np.float32)
        u, c = self.parts[3:5]
        for at in range(0, len(cls), 16 * BATCH):
            target = cls[at : at + 16 * BATCH]
            order = np.argsort(target % self.side, kind="stable")
            group, member = (target % self.side)[order], (target // self.side)[order]
            h = self.hidden(context[at : at + 16 * BATCH][order])[1]
            rows = np.arange(len(order))
            outer = _softmax(h @ u + c)[rows, group]
            out[at + order] = outer + self.within(h, group)[0][rows, member]
        return out

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        """One step of Adam on a batch of windows."""
        order = np.argsort(target % self.side, kind="stable")
        context, group, member = context[order], (target % self.side)[order], (target // self.side)[order]
        (x, h), rows, n = self.hidden(context), np.arange(len(order)), len(order)
        e, mix, _, u, c, inner, d = self.parts
        grad = np.zeros_like(self.weights)
        de, dmix, db, du, dc, dinner, dd = self._split(grad)
        dz = np.exp(_softmax(h @ u + c))
        dz[rows, group] -= 1
        dz /= n
        dh = dz @ u.T
        du[:], dc[:] = h.T @ dz, dz.sum(0)
        z, runs = self.within(h, group)
        dz = np.exp(z, out=z)
        dz[rows, member] -= 1
        dz /= n
        for g, part in runs:
            dh[part] += dz[part] @ inner[g].T
            dinner[g], dd[g] = h[part].T @ dz[part], dz[part].sum(0)
        dh *= 1 - h * h
        dmix[:], db[:] = x.T @ dh, dh.sum(0)
        ids = context.ravel()
        by = np.argsort(ids, kind="stable")
        there = ids[by]
        begins = np.flatnonzero(np.r_[True, there[1:] != there[:-1]])
        de[there[begins]] = np.add.reduceat((dh @ mix.T).reshape(-1, WIDTH)[by], begins)
        self.steps += 1
        self.first += 0.1 * (grad - self.first)
        self.second += 0.01 * (grad * grad - self.second)
        rise = RATE * math.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        self.weights -= np.float32(rise) * self.first / (np.sqrt(self.second) + np.float32(1e-7))


def train(texts: DataFrame, classes: Classes, rounds: int = ROUNDS) -> Network:
    """The network, trained on every window of every text of ``texts(cls, sizes)``.

    The batches of a piece take turns over the rounds, so that each window trains once in a large corpus. In a round every task goes on from the weights and moments of the
    last one with its own batches, and they are averaged by the windows seen: first in groups on executors, then at
    the driver, which gets ``GROUPS`` sets at most, whatever the corpus.
    """
    net = Network.fresh(classes.totals)
    passes = max(1, math.ceil(LEAST_WINDOWS / max(1.0, classes.totals.sum())))

    def trainer(flat, steps, turn):
        def run(batches):
            own, seen = Network(classes.n, flat.copy(), steps), 0
            for b in batches:
                for raw, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sizes = np.array(sizes, np.int64)
                    cls = unpacked(raw, sizes)
                    context = windows(cls, sizes)
                    short = len(cls) <= rounds * BATCH  # too few batches for turns: all of them train in every round
                    for _ in range(math.ceil(passes / rounds) if short else passes):
                        for at in range(0, len(cls), BATCH):
                            if short or at // BATCH % rounds == turn:
                                part = slice(at, at + BATCH)
                                own.step(context[part], cls[part])
                                seen += len(cls[part])
            if seen:
                yield _told(TaskContext.get().partitionId() % GROUPS, seen, own.steps, own.flat)

        return run

    def average(t: pa.Table) -> pa.Table:
        n = t.column("n").to_numpy()
        flat = sum(np.frombuffer(w.as_py(), np.float32) * np.float32(x) for w, x in zip(t.column("w"), n / n.sum(), strict=True))
        return pa.Table.from_batches([_told(t.column("part")[0].as_py(), int(n.sum()), max(t.column("steps").to_pylist()), flat)])

    for turn in range(rounds):
        told = texts.select("cls", "sizes").mapInArrow(trainer(net.flat, net.steps, turn), _TOLD)
        got = told.groupBy("part").applyInArrow(average, _TOLD).collect()
        if got:
            total = sum(r["n"] for r in got)
            flat = sum(np.frombuffer(r["w"], np.float32) * np.float32(r["n"] / total) for r in got)
            net = Network(classes.n, flat, max(r["steps"] for r in got))
    return net


_TOLD = "part int, n long, steps long, w binary"


def _told(part: int, n: int, steps: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([steps], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "steps", "w"])


def fitted(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, Classes, Network]:
    """(texts as classes, counted words, classes, network) of a corpus."""
    corpus = pieces(docs)
    counted = settled(_dictionary(corpus).groupBy("key").agg(F.sum("n").alias("n"), F.min("tail").alias("tail")))
    classes = word_classes(counted)
    texts = numbered(corpus, counted, classes)
    return texts, counted, classes, train(texts, classes, rounds)


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, score (sum of log p(word | two neighbours on either side) over all its words), mean_score.

    All words of all texts are counted and all windows train the network; a text's own words are taken off the counts before it is
    scored. Texts are cut into words once; a task holds a piece of about ``PIECE`` words, or one longer text, at a time.
    Texts without a word have score 0 and no mean. Repeated rows count as often as they stand and score alike, up to the
    rounding of sums. Null ids stay null; other columns are ignored. Empty tables give no rows.
    """
    texts, _, classes, net = fitted(docs, rounds)
    weights = docs.sparkSession.sparkContext.broadcast(net.flat[: len(net.weights)])  # some 150 kB
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = Network(classes.n, np.concatenate([weights.value, np.zeros(2 * len(weights.value), np.float32)]))
        for b in batches:
            for i in range(b.num_rows):
                sizes = np.array(b.column("sizes")[i].as_py(), np.int64)
                logp = own.log_probs(unpacked(b.column("cls")[i].as_py(), sizes), sizes).astype(np.float64)
                text = np.repeat(np.arange(len(sizes)), sizes)
                scores = np.bincount(text, logp, len(sizes)) + np.array(b.column("word_scores")[i].as_py())
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[i].values, pa.array(sizes), pa.array(scores)], ["doc_id", "n_words", "score"])

    scored = texts.mapInArrow(run, f"doc_id {kind}, n_words long, score double")
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
