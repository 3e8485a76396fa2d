"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of white-space markers and the characters up to the next marker. No
piece of the vocabulary has a marker after another character, so no merge crosses the
start of a chunk, and a text's ids are the ids of its chunks in order. Each task keeps a
bounded table of the chunks it has met, segments each distinct one once with the library
and joins ids back by position. No shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import re
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, text_array

MARK = "▁"
#: Chunks that a task remembers, and the longest one it keeps.
TABLE_CHUNKS = 400_000
TABLE_CHUNK_CHARS = 64

_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*|^[^ {MARK}]+")


class Codec:
    """Encodes and decodes as the library does with its model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a white-space marker")
        self.mark_id, self.end_id = self.sp.piece_to_id(MARK), self.sp.eos_id()
        self.table: dict[str, tuple[tuple[int, ...], str, str]] = {}

    def _chunk(self, chunk: str) -> tuple[tuple[int, ...], str, str]:
        """(ids, their decimals, decoded text) of a chunk that starts with a marker."""
        ids = self.sp.encode(chunk[1:]) if len(chunk) > 1 else [self.mark_id]  # the library puts one marker first, but none for ''
        # Decoded behind another marker, so that the one the library strips isn't the chunk's.
        found = (tuple(ids), " ".join(map(str, ids)), self.sp.decode([self.mark_id, *ids]))
        if len(chunk) <= TABLE_CHUNK_CHARS:
            if len(self.table) >= TABLE_CHUNKS:
                self.table.clear()
            self.table[chunk] = found
        return found

    def chunks(self, text: str) -> list[tuple[tuple[int, ...], str, str]]:
        if not text:
            return []
        get, make = self.table.get, self._chunk
        return [get(c) or make(c) for c in _CHUNK.findall(MARK + text)]

    def encode(self, text: str, end: bool = True) -> list[int]:
        ids = [i for c in self.chunks(text) for i in c[0]]
        return [*ids, self.end_id] if end else ids

    def digests(self, text: str) -> tuple[int, str, str]:
        """(ids with the end id, digest of their decimals, digest of the decoded text)."""
        found = self.chunks(text)
        names = " ".join([*(c[1] for c in found), str(self.end_id)])
        decoded = "".join([c[2] for c in found])[1:]  # the first marker is the library's own
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return sum(len(c[0]) for c in found) + 1, sha(names), sha(decoded)


@functools.lru_cache(maxsize=2)
def codec_of(model_file: str) -> Codec:
    """One codec for each Python worker, so that its table outlives a task."""
    return Codec(model_file)


@bounded
def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row, with the end id.

    A null text counts as empty and gives the end id alone; null ids and repeated rows are
    carried through; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        codec = codec_of(model_file)
        for b in batches:
            ids = [codec.encode(t) for t in text_array(b.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, ids array<int>")


@bounded
def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256); nulls as in ``encode``."""

    def run(batches):
        codec = codec_of(model_file)
        for b in batches:
            rows = [codec.digests(t) for t in text_array(b.column(1)).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["id", "n", "e", "d"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@bounded
def decode(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of arrays of ids, by the library's decode; null gives an empty text."""

    def run(batches):
        codec = codec_of(model_file)
        for b in batches:
            out = [codec.sp.decode(x) if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"{id_col} long, text string")
