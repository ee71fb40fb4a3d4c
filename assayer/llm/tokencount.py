"""Token counts of a unigram tokenizer: Viterbi that carries scores and piece counts only."""

from __future__ import annotations

import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMORY = 1_000_000  # distinct stretches a task remembers before it starts over


def by_rank(ranks: list[int]) -> list[float]:
    """Log-probabilities of pieces by their ranks from 1: p in proportion to 1 / (rank + 2.7), the Zipf-Mandelbrot law."""
    weights = [1.0 / (r + 2.7) for r in ranks]
    total = math.fsum(weights)
    return [math.log(w / total) for w in weights]


def vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces and log-probabilities of a unigram vocabulary, from a sentencepiece file.

    Control, unknown, unused and byte pieces are left out. A unigram file's scores are log-probabilities and are taken as
    they are. The scores of a byte-pair file are the numbers of its merges and no probabilities, so its pieces get
    those of ``by_rank`` in that order: merges, then single characters, then the runs of blanks that the file
    lists apart. Nothing is trained.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        (sp.id_to_piece(i), sp.get_score(i))
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))
    ]
    if any(s != int(s) for _, s in plain):
        return plain
    order = sorted(plain, key=lambda p: (-p[1], len(p[0])))
    return list(zip((p for p, _ in order), by_rank(list(range(1, len(order) + 1))), strict=True))


class Counter:
    """Counts pieces on the best segmentation.

    Of two ways to the same place with equal scores, the one whose last piece starts earlier wins; a character that is
    no piece by itself may stand for unknown, at the lowest score less 10, after all pieces that end with it. Unknown
    characters count one for each of their bytes (``byte_fallback``), or one for each unbroken run.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, dummy_prefix: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback, self.prefix, self.memory = byte_fallback, dummy_prefix, {}
        # where no piece has a blank behind other characters, and none has a line end, stretches between them stand alone
        apart = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces) and byte_fallback
        lines = "" if any("\n" in p for p, _ in pieces) else "\n"
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}{lines}]+|{SPACE}+|\n" if apart else ".+", re.S).findall

    def best(self, text: str) -> tuple[float, int]:
        n = len(text)
        score, count, open_ = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        at, single = 0, False  # the place being filled ends with text[at]

        def close(at, single):
            if not single:
                s = score[at] + self.unknown
                if score[at + 1] is None or s > score[at + 1]:
                    score[at + 1] = s
                    count[at + 1] = count[at] + (len(text[at].encode("utf-8", "replace")) if self.byte_fallback else not open_[at])
                    open_[at + 1] = True

        for end, (size, own) in self.automaton.iter(text):  # of pieces with the same end the longest comes first
            while at < end:
                close(at, single)
                at, single = at + 1, False
            start = end + 1 - size
            s = score[start] + own
            if score[end + 1] is None or s > score[end + 1]:
                score[end + 1], count[end + 1], open_[end + 1] = s, count[start] + 1, False
            single = single or size == 1
        while at < n:
            close(at, single)
            at, single = at + 1, False
        return score[n], count[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a whole text; null and empty texts have none."""
        if not text:
            return 0, 0.0
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        memory, pieces, total = self.memory, 0, 0.0
        for part in self.stretches(text):
            known = memory.get(part)
            if known is None:
                known = self.best(part)
                if len(memory) >= MEMORY:
                    memory.clear()
                if len(part) <= 64:
                    memory[part] = known
            total += known[0]
            pieces += known[1]
        return pieces, total


def count_tokens(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, score for every row. ``model`` is read on the driver; its pieces go with the tasks.

    Null and empty texts count 0. Repeated rows give repeated rows. Other columns are ignored.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(model))  # as large as the vocabulary file
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        counter = Counter(pieces.value)
        for b in batches:
            got = [counter.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")
