"""Byte-level BPE ids from a rank file, equal to those of the same vocabulary's JSON file.

The JSON file's one added token is the end of a text. ``encode`` with it allowed takes its
string in a text as that token, as the JSON tokenizer does by default;
``encode_ordinary`` takes it as ordinary text.
"""

from __future__ import annotations

import base64
import functools

#: The pattern that splits text before the merges of public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: the added token of the vocabulary.
ADDED = {"<|endoftext|>": 50256}


@functools.lru_cache(maxsize=2)
def ranks_of(rank_file: str):
    """The encoder of a rank file, made once for each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(rank_file, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
