"""Toxicity: a learned lexicon, found with its misspellings by Levenshtein automata, and scored in its context."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: labelled rows that the lexicon and the weights are fitted on: those with the smallest hashes
MAX_TRAIN = 20_000
#: likely terms of at most so many bytes are carried to the tasks that count their neighbours; more are joined instead
CARRIED_BYTES = 32_000_000
STEM_SIZES = (3, 4, 5, 6, 7, 8)
#: words and stems of these lengths or more are also matched with one edit
FUZZY_FROM, FUZZY_STEM = 5, 6
WINDOW = 5
FEATURES = 7
MEMORY = 1_000_000  # distinct words a task remembers before it starts over

OPENING, CLOSING = "\"'“‘«„(", "\"'”’»“)"
_EDGES = re.compile(r"^\W+|\W+$")


class Lexicon:
    """Trie of words and stems, intersected with the Levenshtein automaton of one edit.

    States of the intersection are sets of (trie node, edits so far); they are made when first reached and kept, so
    a word is read in one step a letter. ``accepts`` gives 0 for no term, 1 for a term (or a word that
    goes on behind a stem), 2 for a word one edit from a long enough term.
    """

    def __init__(self, words, stems):
        self.nodes: list[dict] = [{}]
        self.word, self.stem = {}, {}
        for terms, mark in ((words, self.word), (stems, self.stem)):
            for t in terms:
                at = 0
                for c in t:
                    if c not in self.nodes[at]:
                        self.nodes[at][c] = len(self.nodes)
                        self.nodes.append({})
                    at = self.nodes[at][c]
                mark[at] = len(t)
        # within[n]: whether a word or stem long enough for an edit ends below
        self.within = [False] * len(self.nodes)
        for n in range(len(self.nodes) - 1, -1, -1):
            self.within[n] = self._fuzzy(n) or any(self.within[m] for m in self.nodes[n].values())
        self.states, self.names, self.steps, self.verdicts, self.begun = [], {}, [], [], []
        self._state(frozenset({(0, 0)}))

    def _fuzzy(self, n: int) -> bool:
        return self.word.get(n, 0) >= FUZZY_FROM or self.stem.get(n, 0) >= FUZZY_STEM

    def _state(self, items: frozenset) -> int:
        if items not in self.names:
            closed, todo = set(items), list(items)
            while todo:  # a letter of the term that the word lacks
                n, e = todo.pop()
                if e == 0:
                    new = {(m, 1) for m in self.nodes[n].values() if self.within[m]} - closed
                    closed |= new
                    todo += new
            self.names[items] = len(self.states)
            self.states.append(closed)
            self.steps.append({})
            exact = any(e == 0 and n in self.word for n, e in closed)
            near = any(e == 1 and self.word.get(n, 0) >= FUZZY_FROM for n, e in closed)
            stem = any(e == 0 and n in self.stem for n, e in items)
            stem_near = any(e == 1 and self.stem.get(n, 0) >= FUZZY_STEM for n, e in closed)
            self.begun.append(1 if stem else 2 if stem_near else 0)
            self.verdicts.append(1 if exact else 2 if near else 0)
        return self.names[items]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for n, e in self.states[state]:
            if c in self.nodes[n]:
                m = self.nodes[n][c]
                if e == 0 or self.within[m]:
                    out.add((m, e))
            if e == 0 and self.within[n]:
                out.add((n, 1))
                out |= {(m, 1) for m in self.nodes[n].values() if self.within[m]}
        self.steps[state][c] = to = self._state(frozenset(out)) if out else -1
        return to

    def accepts(self, word: str) -> int:
        at, steps, begun, near = 0, self.steps, self.begun, 0
        for c in word:
            if begun[at]:  # a stem, and more behind it
                if begun[at] == 1:
                    return 1
                near = 2
            to = steps[at].get(c)
            if to is None:
                to = self._step(at, c)
            if to < 0:
                return near
            at = to
        return self.verdicts[at] or near


class Scanner:
    def __init__(self, words, stems, reporting=()):
        self.lexicon, self.seen, self.hits, self.reporting = Lexicon(words, stems), set(), {}, frozenset(reporting)

    def places(self, ws: list[str]) -> list[tuple[int, int]]:
        """(place, kind) of the terms among the words of a text."""
        distinct = set(ws)
        if new := distinct - self.seen:
            if len(self.seen) > MEMORY:
                self.seen, self.hits, new = set(), {}, distinct
            self.seen |= new
            for w in new:
                if kind := self.lexicon.accepts(w if w.isalnum() else _EDGES.sub("", w)):
                    self.hits[w] = kind
        if self.hits.keys().isdisjoint(distinct):
            return []
        return [(i, self.hits[w]) for i, w in enumerate(ws) if w in self.hits]

    def features(self, text: str | None) -> list[float]:
        """1, terms outside and inside quotation, misspelled terms, share of words, whether any, terms near another."""
        ws = text.lower().split() if text else []
        at = self.places(ws)
        if not at:
            return [1.0] + [0.0] * (FEATURES - 1)
        plain = quoted = fuzzy = close = 0
        for k, (i, kind) in enumerate(at):
            before, after = ws[max(0, i - WINDOW) : i + 1], ws[i : i + WINDOW + 1]
            marks = any(w[0] in OPENING for w in before) and any(w[-1] in CLOSING or w[-2:-1] in CLOSING and w[-2:-1] for w in after)
            if marks or not self.reporting.isdisjoint(before[:-1]):
                quoted += 1
            elif kind == 2:
                fuzzy += 1
            else:
                plain += 1
            close += k > 0 and i - at[k - 1][0] <= WINDOW
        return [1.0, math.log1p(plain), math.log1p(quoted), math.log1p(fuzzy), math.log1p(100 * (plain + fuzzy) / len(ws)), float(plain > 0), math.log1p(close)]


def _key(c="doc_id"):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def held_out(c="doc_id"):
    """Rows whose labels nothing is learned from: crc32 of the id as text, divisible by 5."""
    return F.crc32(_key(c)) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic) of at most ``max_train`` labelled documents outside the held-out fifth, by a hash of the id. An id of several
    rows, repeated or not, gives one text: the one with the smallest hash."""
    ids = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")


def _bare(text: str) -> list[str]:
    return [x for w in text.lower().split() if (x := w if w.isalnum() else _EDGES.sub("", w))]


def _terms(word: str) -> list[str]:
    """The word as a whole, and its first 3 to 8 letters where more follow."""
    return [f"{word}$", *(word[:k] for k in STEM_SIZES if len(word) > k)]


def _excess(nt: int, nn: int, tried: int):
    """Column condition: found far more often with toxic documents (of nt) than with others (of nn), by likelihood ratio.

    The bound on the ratio rises with the number of terms tried.
    """
    share, both = nt / (nt + nn), F.col("t") + F.col("n")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * p))).otherwise(0.0)
    return (F.col("t") / nt > 8 * F.col("n") / nn) & (2 * (part("t", share) + part("n", 1 - share)) > 4 + 2 * math.log(max(tried, 1)))


def learn_lexicon(train: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems that toxic documents hold far more often than others.

    First documents are counted by term, partly in each task, then by a grouped sum. What stands out is counted once more,
    by the different pairs of neighbouring words it stands between: copies of one toxic document repeat all its
    words, but only between the same neighbours. A stem is taken instead of its words only where it is
    found clearly more often than any of them, that is, where its endings vary.
    """

    def by_document(batches):
        for b in sliced(batches):
            n, t = Counter(), Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (t if toxic else n).update({x for w in set(_bare(text)) for x in _terms(w)} | {"$"})
            terms = list(t.keys() | n.keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([t[x] for x in terms], pa.int64()), pa.array([n[x] for x in terms], pa.int64())], ["term", "t", "n"])

    counts = train.mapInArrow(by_document, "term string, t long, n long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    counts = counts.where("t + n >= 3").persist()
    try:
        whole = counts.where("term = '$'").first()
        if not whole or not whole["t"] or not whole["n"]:
            return [], []
        nt, nn, tried = whole["t"], whole["n"], counts.count()
        first = counts.where("term <> '$'").where(_excess(nt, nn, tried)).select("term").persist()
        carried = (first.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) <= CARRIED_BYTES
    finally:
        counts.unpersist()
    likely = {r["term"] for r in first.collect()} if carried else None

    def by_neighbours(batches):
        for b in sliced(batches):
            seen = set()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = _bare(text)
                for i, w in enumerate(ws):
                    for x in _terms(w):
                        if likely is None or x in likely:
                            seen.add((x, f"{ws[i - 1] if i else ''} {ws[i + 1] if i + 1 < len(ws) else ''}", toxic))
            cols = list(zip(*seen, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["term", "between", "toxic"])

    places = train.mapInArrow(by_neighbours, "term string, between string, toxic int").distinct()
    places = places if carried else places.join(first, "term", "left_semi")
    apart = places.groupBy("term").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.count_if(F.col("toxic") == 0).alias("n"))
    found = {r["term"]: r["t"] for r in apart.where(_excess(nt, nn, tried)).collect()}  # the lexicon, as every task holds it
    first.unpersist()
    stems = []
    for p in sorted((x for x in found if x[-1] != "$"), key=len):
        longer = [c for x, c in found.items() if x != p and x.startswith(p) and x != f"{p}$"]
        if found[p] > 1.5 * max(longer, default=0) and not p.startswith(tuple(stems)):
            stems.append(p)
    return sorted(x[:-1] for x in found if x[-1] == "$" and len(x) > 1), stems


def learn_reporting(train: DataFrame, words: list[str], stems: list[str]) -> list[str]:
    """Words that stand before a term far more often in documents that aren't toxic: those that report what was said."""

    def before_terms(batches):
        scanner = Scanner(words, stems)
        for b in sliced(batches):
            n, t = Counter(), Counter()
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = text.lower().split()
                near = {w for i, _ in scanner.places(ws) for w in ws[max(0, i - WINDOW) : i]}
                (t if toxic else n).update(near | {"$"} if near else ())
            terms = list(t.keys() | n.keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([t[x] for x in terms], pa.int64()), pa.array([n[x] for x in terms], pa.int64())], ["term", "n", "t"])

    # the columns are changed over: what is sought here goes with documents that aren't toxic
    counts = train.mapInArrow(before_terms, "term string, n long, t long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where("t + n >= 3").persist()
    try:
        whole = counts.where("term = '$'").first()
        if not whole or not whole["t"] or not whole["n"]:
            return []
        return sorted(r["term"] for r in counts.where("term <> '$'").where(_excess(whole["t"], whole["n"], counts.count())).collect())
    finally:
        counts.unpersist()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, words, stems, weights, reporting=()):
        self.words, self.stems, self.weights, self.reporting = words, stems, weights, reporting

    def scorer(self):
        scanner, w = Scanner(self.words, self.stems, self.reporting), self.weights
        return lambda text: 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(scanner.features(text), w))))))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Lexicon and logistic weights from at most ``max_train`` labelled rows; without labels of both kinds, their share."""
    train = training_rows(docs, labels, max_train).persist()  # documents are read once
    try:
        words, stems = learn_lexicon(train)
        reporting = learn_reporting(train, words, stems)

        def run(batches):
            scanner = Scanner(words, stems, reporting)
            for b in sliced(batches):
                rows = [scanner.features(t) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

        seen = train.mapInArrow(run, "x array<double>, y int").collect()  # max_train rows of seven numbers at most
    finally:
        train.unpersist()
    y = np.array([r["y"] for r in seen], float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return Model([], [], np.array([math.log(p / (1 - p)) if 0 < p < 1 else -5.0] + [0.0] * (FEATURES - 1)))
    return Model(words, stems, _logistic(np.array([r["x"] for r in seen], float), y), reporting)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5) for every row, in order of nothing.

    Only texts are scored; labels teach, and none of the held-out fifth. Null and empty texts score as texts without
    terms. A null doc_id is the text '' in the fold. Repeated rows score alike. Texts of any length are scored whole. Other columns are ignored.
    Rows of ``labels`` that name a document more than once count once, toxic if one of them is.
    """
    model = fit(docs, labels, max_train)

    def run(batches):
        score = model.scorer()
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([score(t) for t in b.column(2).to_pylist()], pa.float64())],
                ["doc_id", "held_out", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` without the documents scored 0.5 or more; rows and columns otherwise as they are, no text is shuffled."""
    model = fit(docs, labels, max_train)

    def run(batches):
        score = model.scorer()
        for b in sliced(batches):
            yield b.filter(pa.array([score(t) < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
