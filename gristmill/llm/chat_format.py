"""Chat formatting by token-level assembly.

Each turn's role and text are escaped and encoded as segments of their own; the ids of the control marks are reserved above the
vocabulary and spliced between the segments, so no content can encode to a mark. The escape is reversible: `\\` becomes `\\\\` and
`<|` becomes `<\\|`. Segment lengths give offsets by prefix sums: within a turn on the spot, over a conversation by a streaming sum;
the loss mask is 1 on the segments of assistant texts.

Turns are encoded where they lie, then dealt by conversation and sorted; a conversation is assembled turn by turn in a stream, so
its length bounds no memory: the state is a few hashes and sums. One turn's ids are one row.

Defined cases: a null role or text is empty; null turns come first; equal turns are ordered by role and text; a null conv_id is
one conversation; roles may hold control strings or line ends; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import small_batches
from gristmill.llm.token_counts import PATTERN

#: The control marks, in the order of their ids above the vocabulary.
MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
LOSS_ROLE = "assistant"
#: A run of white space this long is taken out by hand: it is one pre-token, and the pattern's own search would run out of stack.
_RUN = regex.compile(r"\p{White_Space}{10000,}")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    def __init__(self, ranks: dict[bytes, int]):
        self.coding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.start, self.sep, self.end = (self.coding.n_vocab + i for i in range(3))
        self.marks = {self.start: MARKS[0], self.sep: MARKS[1], self.end: MARKS[2]}

    def encode(self, text: str) -> list[int]:
        """The ids of the whole segment, whatever its length: a run of white space before a letter leaves its last blank to the next pre-token."""
        out, at = [], 0
        for m in _RUN.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.coding.encode_ordinary(text[at : m.start()])
            out += self.coding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.coding.encode_ordinary(text[at:]) if at else self.coding.encode_ordinary(text)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn."""
        segments = [[self.start], self.encode(escape(role)), [self.sep], self.encode(escape(text)), [self.end]]
        ends = np.cumsum([len(s) for s in segments])
        change = np.zeros(ends[-1] + 1, np.int64)
        if role == LOSS_ROLE:
            change[ends[2]] += 1
            change[ends[3]] -= 1
        return np.fromiter((t for s in segments for t in s), np.int32, ends[-1]), np.cumsum(change[:-1]).astype(np.int8)

    def plain(self, ids: np.ndarray) -> str:
        return self.coding.decode_bytes(ids.tolist()).decode("utf-8")

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """From a turn's ids and mask: role, text, the masked part, and the length of the formatted text."""
        a, s, e = (int(np.nonzero(ids == x)[0][0]) for x in (self.start, self.sep, self.end))
        if (a, e) != (0, len(ids) - 1) or (ids >= self.start).sum() != 3:
            raise ValueError("marks out of place")
        role, text, loss = self.plain(ids[1:s]), self.plain(ids[s + 1 : e]), self.plain(ids[mask == 1])
        return unescape(role), unescape(text), unescape(loss), len(role) + len(text) + sum(map(len, MARKS))


def assemble(turns: DataFrame, ranks_path: str) -> DataFrame:
    """conv_id, turn, begin, ids, mask: the conversations' turns in order; begin is the turn's first position in its conversation.

    The ranks are broadcast; their size is that of the vocabulary.
    """
    shared = turns.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            rows = [coder.turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.record_batch({
                **{c: batch.column(c) for c in ("conv_id", "turn", "role", "tie")},
                "ids": pa.array([i.tobytes() for i, _ in rows], pa.binary()), "mask": pa.array([m.tobytes() for _, m in rows], pa.binary()),
            })

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = object(), 0
        for batch in batches:
            begin = []
            for conv, ids in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), strict=True):
                if conv != now:
                    now, at = conv, 0
                begin.append(at)
                at += len(ids.as_buffer()) // 4
            yield pa.record_batch({"conv_id": batch.column("conv_id"), "turn": batch.column("turn"), "begin": pa.array(begin, pa.int64()), "ids": batch.column("ids"), "mask": batch.column("mask")})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = small_batches(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("tie"))
    coded = rows.mapInArrow(encode, "conv_id long, turn long, role string, tie string, ids binary, mask binary")
    dealt = coded.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "tie")
    return dealt.mapInArrow(place, "conv_id long, turn long, begin long, ids binary, mask binary")


def digests(assembled: DataFrame, ranks_path: str) -> DataFrame:
    """What the formatted conversations hold, read back from ids and masks in one stream."""
    shared = assembled.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, state, out = Coder(shared.value), None, None, []

        def rows() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=list(names))

        def close() -> None:
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for batch in batches:
            for conv, begin, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "begin", "ids", "mask")), strict=True):
                if begin == 0:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids = np.frombuffer(ids, np.int32)
                role, text, loss, n = coder.read(ids, np.frombuffer(mask, np.int8))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += n
                state[5] += len(ids)
            if len(out) >= 1000:
                yield rows()
                out = []
        close()
        yield rows()

    return assembled.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
