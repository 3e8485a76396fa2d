"""Chat formatting by token-level assembly.

Roles and texts are escaped and encoded on their own, reserved ids that no text can
produce are spliced between them, and the loss mask follows from prefix sums over segment
lengths. A turn reads ``### role: text</turn>`` and a newline; inside roles and texts a
backslash stands before each backslash and each control string, so that the rendered
text, too, can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ranks_of
from .common import bounded, text_array

#: Control strings of the template; the reserved ids follow the vocabulary in this order.
CONTROLS = ("### ", ": ", "</turn>\n")
#: The id after the last one of the vocabulary file and its end-of-text id.
RESERVED = 50257
OPEN, COLON, CLOSE = range(RESERVED, RESERVED + 3)

_ESCAPE = re.compile(r"\\|###|</turn>")
_ROLE_ESCAPE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_ESCAPE if role else _ESCAPE).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@bounded
def encode_turns(turns: DataFrame, rank_file: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, ids, loss array<boolean>): each row as a turn of the template.

    Null roles and texts count as empty; null conversation ids and turns are carried
    through; repeated rows are turns of their own; an empty table gives no rows; other
    columns are not read. ``loss`` is true for the ids of the texts of ``learn_role``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ranks_of(rank_file)
        roles: dict[str, list[int]] = {}
        for b in batches:
            segments: list[list[int]] = []
            learn = []
            for role, text in zip(text_array(b.column(2)).to_pylist(), text_array(b.column(3)).to_pylist(), strict=True):
                if role not in roles:
                    if len(roles) > 10_000:
                        roles.clear()
                    roles[role] = enc.encode_ordinary(escape(role, role=True))
                segments += [OPEN], roles[role], [COLON], enc.encode_ordinary(escape(text)), [CLOSE]
                learn += 0, 0, 0, int(role == learn_role), 0
            lengths = np.array([len(s) for s in segments], np.int64)
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            step = np.zeros(total + 1, np.int64)  # +1 where a learned segment starts, -1 behind it
            mark = np.array(learn, np.int64)
            np.add.at(step, ends - lengths, mark)
            np.add.at(step, ends, -mark)
            mask = np.cumsum(step)[:total] > 0
            at = pa.array(np.concatenate([[0], ends[4::5]]), pa.int32())
            flat = pa.array(np.fromiter((i for s in segments for i in s), np.int32, total))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, flat), pa.ListArray.from_arrays(at, pa.array(mask))], ["c", "t", "i", "l"])

    cols = turns.select(F.col(conv_col).cast("long"), F.col(turn_col).cast("long"), role_col, text_col)
    return cols.mapInArrow(run, f"{conv_col} long, {turn_col} long, ids array<int>, loss array<boolean>")


def read_turn(enc, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, int]:
    """(role, text, text under the mask, rendered code points) of one turn's ids."""
    at = np.flatnonzero(ids >= RESERVED)
    if ids[at].tolist() != [OPEN, COLON, CLOSE] or at[0] != 0 or at[2] != len(ids) - 1:
        raise ValueError("not a turn of this template")
    text_of = lambda x: enc.decode_bytes(x.tolist()).decode()
    role, text = text_of(ids[1 : at[1]]), text_of(ids[at[1] + 1 : -1])
    shown = sum(map(len, CONTROLS)) + len(role) + len(text)
    return unescape(role), unescape(text), unescape(text_of(ids[loss])), shown


@bounded
def read_back(turns: DataFrame, rank_file: str) -> DataFrame:
    """One row per conversation of ``encode_turns``'s output, read from its ids alone:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows of a conversation are streamed in turn order (ties: by ids), never gathered; the
    task that has it holds one turn and the running digests. Null conversation ids form
    one conversation; null turns come first.
    """
    conv, turn = turns.columns[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ranks_of(rank_file)
        out: list[tuple] = []
        now, state = object(), None

        def close():
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["c", "n", "t", "lc", "ls", "f"])

        for b in batches:
            ids, loss = b.column(2), b.column(3)
            for i, c in enumerate(b.column(0).to_pylist()):
                if state is None or c != now:
                    close()
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learned, shown = read_turn(enc, ids[i].values.to_numpy(), ids_mask(loss[i]))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += shown
            if len(out) >= 1000:
                yield flush()
                out.clear()
        close()
        yield flush()

    rows = turns.repartition(F.col(conv)).sortWithinPartitions(conv, turn, "ids")
    return rows.mapInArrow(run, f"{conv} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def ids_mask(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False).astype(bool)
