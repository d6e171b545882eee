"""Chat formatting at the token level."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.session import ship

#: Control strings of the template, in the order of their reserved ids.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ANS]", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>"]
_TURN = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[ANS]", "</s>")}
LOSS_ROLE = "assistant"
_ESCAPE = re.compile("(" + "|".join(sorted({re.escape(c[0]) for c in CONTROLS})) + r")(\\*)(" + "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True)) + ")")


def escape(text: str) -> str:
    """One backslash more after the first character of anything that reads as a
    control string, or as one that was escaped already."""
    return _ESCAPE.sub(lambda m: m[1] + "\\" + m[2] + m[3], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] + m[2][1:] + m[3], text)


class Codec:
    """Ranks of a byte-level vocabulary; reserved ids follow its ids."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        base = max(table.values()) + 1
        self.id_of = {c: base + i for i, c in enumerate(CONTROLS)}
        self.control = {i: c for c, i in self.id_of.items()}
        self.base = base

    def segments(self, role: str, text: str) -> list[tuple[str | None, str, bool]]:
        """(control or None, text, under the loss mask) of one turn."""
        if role in _TURN:
            a, b = _TURN[role]
            return [(a, "", False), (None, text, role == LOSS_ROLE), (b, "", False)]
        return [("<<ROLE>>", "", False), (None, role, False), ("<<TEXT>>", "", False), (None, text, False), ("<</ROLE>>", "", False)]

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask: each segment is encoded by itself, so no merge crosses a
        border; the mask is the prefix sum of +1 and -1 at the borders."""
        parts, borders, n = [], [], 0
        for control, piece, loss in self.segments(role, text):
            ids = np.array([self.id_of[control]], np.uint32) if control else self.enc.encode_to_numpy(escape(piece), disallowed_special=())
            if loss:
                borders.append((n, n + len(ids)))
            parts.append(ids)
            n += len(ids)
        steps = np.zeros(n + 1, np.int8)
        for a, b in borders:
            steps[a] += 1
            steps[b] -= 1
        return np.concatenate(parts).astype(np.uint32), np.cumsum(steps[:n], dtype=np.int8)

    def decode(self, ids: np.ndarray) -> str:
        return self.enc.decode_bytes(ids.tolist()).decode("utf-8")

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """(role, text, loss text, formatted code points) of one turn's ids."""
        at = np.flatnonzero(ids >= self.base)
        names = [self.control[i] for i in ids[at].tolist()]
        between = [self.decode(ids[a + 1 : b]) for a, b in zip(at[:-1], at[1:])]
        chars = sum(map(len, names)) + sum(map(len, between))
        if names[0] == "<<ROLE>>":
            role, text = unescape(between[0]), unescape(between[1])
        else:
            role, text = next(r for r, (a, _) in _TURN.items() if a == names[0]), unescape(between[0])
        return role, text, unescape(self.decode(ids[mask == 1])), chars


@functools.lru_cache(2)
def codec_of(ranks: str, pattern: str) -> Codec:
    """One for each vocabulary in a worker process, whatever the number of its tasks."""
    return Codec(ranks, pattern)


def format_turns(conversations: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(conv_id, turn, role, ids, mask): one row of token ids per turn.

    A conversation is the id of ``<s>`` and then its turns' ids by (turn, role,
    ids).  Ids are made where a turn is read: nothing is shuffled or gathered.
    Null role and text are empty; a null turn sorts first; repeated rows stay
    repeated; an empty table gives no rows; other columns are ignored.
    """
    ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(ranks, pattern)
        for b in batches:
            done = [codec.turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([i.tobytes() for i, _ in done], pa.binary()), pa.array([m.tobytes() for _, m in done], pa.binary())], ["conv_id", "turn", "role", "ids", "mask"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, ids binary, mask binary")


def digests(formatted: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """What the formatted ids say, read back: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars for each conversation.

    Rows of a conversation meet in order in one partition, since the digests are
    sequential, and pass through it as a stream: a conversation of any length
    needs the memory of one batch.  A null conv_id is a conversation of its own; empty turns count as
    turns; repeated rows are turns each; an empty table gives no rows.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in schema.split(", ")]
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids").select("conv_id", "ids", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, open_ = codec_of(ranks, pattern), None, False
        turns = loss = None
        n = loss_chars = chars = 0
        done: list[tuple] = []

        def close() -> None:
            if open_:
                done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def out() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [()] * len(names)
            done.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            for conv, ids, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not open_ or conv != now:
                    close()
                    now, open_, n, loss_chars, chars = conv, True, 0, 0, len(CONTROLS[0])
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                role, text, trained, size = codec.read(np.frombuffer(ids, np.uint32), np.frombuffer(mask, np.int8))
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(trained.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(trained), chars + size
            yield out()
        close()
        yield out()

    return ordered.mapInArrow(run, schema)
