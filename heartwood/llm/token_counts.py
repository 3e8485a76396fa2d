"""Token counts under a unigram vocabulary, without the ids.

Aho-Corasick lists every vocabulary match in a chunk; dynamic programming over its
characters carries the best score and the number of pieces on that path. Ties follow the
unigram tokenizer: matches are taken by start, then by length, and a later path replaces
an earlier one only when strictly better. A character that no single-character piece
covers costs the lowest score less a penalty of 10 and becomes one piece for each byte.

No piece has a white-space marker after another character, so a best path passes through
the start of every marked chunk; each distinct chunk is solved once a task.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, text_array

MARK = "▁"
UNKNOWN_PENALTY = 10.0
TABLE_CHUNKS = 400_000
TABLE_CHUNK_CHARS = 64
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}]*|^[^ {MARK}]+")


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a piece model, in id order; control and byte pieces too."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


def matchable(vocab: list[tuple[str, float]]) -> dict[str, float]:
    """The pieces that can match a text: all but control, unknown and byte pieces."""
    special = re.compile(r"<0x[0-9A-F]{2}>|<unk>|<s>|</s>")
    return {p: s for p, s in vocab if not special.fullmatch(p)}


class Counter:
    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        pieces = matchable(vocab)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses a white-space marker")
        self.auto = ahocorasick.Automaton()
        for p, s in pieces.items():
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.table: dict[str, int] = {}

    def solve(self, chunk: str) -> int:
        """Pieces on the best path through a chunk."""
        n = len(chunk)
        by_end: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = bytearray(n)
        for end, found in self.auto.iter(chunk):
            by_end[end].append(found)
            if found[0] == 1:
                single[end] = 1
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            best = None
            for length, s in sorted(by_end[end], reverse=True):  # earliest start first
                at = score[end + 1 - length] + s
                if best is None or at > best:
                    best, pieces = at, count[end + 1 - length] + 1
            if not single[end]:
                at = score[end] + self.unknown
                if best is None or at > best:
                    best, pieces = at, count[end] + len(chunk[end].encode())
            score[end + 1], count[end + 1] = best, pieces
        return count[n]

    def _chunk(self, chunk: str) -> int:
        n = self.solve(chunk)
        if len(chunk) <= TABLE_CHUNK_CHARS:
            if len(self.table) >= TABLE_CHUNKS:
                self.table.clear()
            self.table[chunk] = n
        return n

    def count(self, text: str) -> int:
        """Pieces of the text behind one marker, with spaces as markers; 0 for ''."""
        if not text:
            return 0
        get, make = self.table.get, self._chunk
        return sum([get(c) or make(c) for c in _CHUNK.findall((MARK + text).replace(" ", MARK))])


@functools.lru_cache(maxsize=2)
def counter_of(model_file: str) -> Counter:
    """One counter for each Python worker, so that its table outlives a task."""
    return Counter(vocabulary(model_file))


@bounded
def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of each row's whole text.

    A null or empty text has 0 tokens; null ids and repeated rows are carried through; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_file)
        for b in batches:
            n = [counter.count(t) for t in text_array(b.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_tokens long")
