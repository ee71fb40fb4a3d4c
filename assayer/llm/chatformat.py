"""Chat formatting: conversations as one marked text with a loss mask, assembled in columns, and read back."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Every turn is header(role) + role-escaped text + footer. Control strings: <s> </s> [INST] [/INST] [ROLE] [/ROLE]
OPEN, MID, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
INST_OPEN, INST_CLOSE = "<s>[INST] ", " [/INST]</s>"
CONTROL = r"(/?(?:s>|INST\]|ROLE\]))"
_KNOWN = {"user": (INST_OPEN, INST_CLOSE)}
#: bytes of text in one piece of a conversation's output
PIECE_BYTES = 1 << 20


def _marks(role: str) -> tuple[str, str]:
    return _KNOWN.get(role) or (OPEN + escape(role) + MID, CLOSE)


def escape(text: str) -> str:
    """A backslash more after the first character of every control string, so none stands in the result."""
    return re.sub(r"([<\[])(\\*)" + CONTROL, r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[])(\\*)\\" + CONTROL, r"\1\2\3", text)


def _binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a string column."""
    col = values.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with header, escaped text and footer of each turn, the turns' ends in it, and the texts' starts and ends.

    Segment lengths give offsets by a cumulative sum, and the bytes are copied by scatter indices.
    """
    texts = pc.replace_substring_regex(texts.cast(pa.large_string()), r"([<\[])(\\*)" + CONTROL, r"\1\2\\\3")
    codes = roles.dictionary_encode()
    marks = [tuple(x.encode() for x in _marks(r)) for r in codes.dictionary.to_pylist()]
    which = codes.indices.to_numpy(zero_copy_only=False)
    body, starts, sizes = _binary(texts)
    heads, tails = (np.array([len(m[k]) for m in marks], np.int64) for k in (0, 1))
    lengths = np.stack([heads[which], sizes, tails[which]], 1)
    ends = np.cumsum(lengths.ravel()).reshape(-1, 3)
    out = np.empty(int(ends[-1, 2]) if len(ends) else 0, np.uint8)
    for k, role in enumerate(marks):
        rows = np.flatnonzero(which == k)
        for column, mark in ((0, role[0]), (2, role[1])):
            to = (ends[rows, column] - len(mark))[:, None] + np.arange(len(mark))
            out[to] = np.frombuffer(mark, np.uint8)
    shift = np.repeat(ends[:, 0] - starts, sizes)
    source = np.arange(int(sizes.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.zeros(0, int)
    out[source + shift] = body[source]
    return out, ends[:, 2], ends[:, 0], ends[:, 1]


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, piece, text, loss (array of [start, end) byte ranges): the marked text of each conversation in pieces.

    A piece holds whole turns, about ``PIECE_BYTES`` at most, so a conversation of any length streams through; pieces of a
    conversation, joined in order, are its text. The loss covers what assistants say. Turns are in order of turn,
    then role and text where turns are equal; null roles and texts are ''. A null conv_id is a conversation
    like any other. Repeated rows are repeated turns. Other columns are ignored. Sorted partitions, one shuffle.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), "turn", empty("role"), empty("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        at, piece = object(), 0
        for b in batches:
            ids = b.column(0).to_pylist()
            out, ends, lo, hi = assemble(b.column(2), b.column(3))
            said = pc.equal(b.column(2), "assistant").to_pylist()
            cuts, begun = [], 0
            for i in range(len(ids)):  # where a piece ends: at another conversation, or before it gets too long
                if i + 1 == len(ids) or ids[i + 1] != ids[i] or ends[i + 1] - (ends[begun - 1] if begun else 0) > PIECE_BYTES:
                    cuts.append((begun, i + 1))
                    begun = i + 1
            keys, numbers, offsets, losses = [], [], [0], []
            for first, last in cuts:
                piece = piece + 1 if ids[first] == at else 0
                at = ids[first]
                keys.append(at)
                numbers.append(piece)
                offsets.append(int(ends[last - 1]))
                base = int(ends[first - 1]) if first else 0
                losses.append([[int(lo[i]) - base, int(hi[i]) - base] for i in range(first, last) if said[i]])
            text = pa.Array.from_buffers(pa.large_string(), len(keys), [None, pa.py_buffer(np.array(offsets, np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()), text.cast(pa.string()), pa.array(losses, pa.list_(pa.list_(pa.int64())))],
                ["conv_id", "piece", "text", "loss"],
            )

    return rows.mapInArrow(run, "conv_id long, piece long, text string, loss array<array<long>>")


_TURN = re.compile(r"<s>(?:\[INST\] (.*?) \[/INST\]|\[ROLE\](.*?)\[/ROLE\](.*?))</s>", re.S)


def read_turns(text: str):
    """(role, text) of each turn of a marked text."""
    for m in _TURN.finditer(text):
        yield ("user", unescape(m[1])) if m[1] is not None else (unescape(m[2]), unescape(m[3]))


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """What can be read back from ``format_conversations``: counts and digests for each conversation.

    Works on its partitions as they are, piece after piece, with one running state.
    """

    def run(batches):
        state = None

        def closed():
            cid, n, turns, loss_chars, loss, chars = state
            return [cid, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

        for b in batches:
            done = []
            for cid, piece, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if piece == 0:
                    if state:
                        done.append(closed())
                    state = [cid, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                raw = text.encode()
                for lo, hi in loss:
                    said = unescape(raw[lo:hi].decode())
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            yield _digests(done)
        if state:
            yield _digests([closed()])

    def _digests(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: one more conversation, of control strings
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def oracle_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    esc = lambda c: f"regexp_replace({c}, {q(r'([<\[])(\\*)' + CONTROL)}, {q(r'\1\2\\\3')}, 'g')"
    rows = ", ".join(f"({a}, {b}, {q(c)}, {q(d)})" for a, b, c, d in PROBE)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {rows})),
x AS (SELECT *, CASE WHEN role = 'user' THEN {len(INST_OPEN + INST_CLOSE)} ELSE {len(OPEN + MID + CLOSE)} + length({esc('role')}) END + length({esc('text')}) AS n,
  CASE WHEN role = 'assistant' THEN text ELSE '' END AS said FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(length(said))::BIGINT AS loss_chars, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id"""
