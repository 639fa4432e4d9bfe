"""A public tokenizer's vocabulary: as an encoder, and as a list of words.

The file is read once by the driver; what tasks need of it is broadcast (its size is the vocabulary's, some
50,000 entries, whatever the input), so no executor has to have the file.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Where the tokenizer's ranks lie; overridden by the operators' parameter.
TOKENIZER = os.environ.get("ENGRAMLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Vocabularies that together say which words are common, in English and other languages.
WORD_LISTS = (TOKENIZER, os.path.join(os.path.dirname(TOKENIZER), "byte_bpe_multi_50k.tiktoken"))
#: The pre-tokenizer that belongs to these ranks (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def ranks(ranks_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}


@lru_cache(maxsize=4)
def encoder(ranks_file: bytes):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(ranks_file), special_tokens={})


@lru_cache(maxsize=4)
def word_classes(paths: tuple[str, ...]) -> dict[str, str]:
    """How a word (lower case) stands in the vocabularies: how early in small letters (1 to 3, 0 not at all) and, with c, capitalised."""
    low: dict[str, int] = {}
    cap: set[str] = set()
    for path in paths:
        for token, rank in ranks(content(path)).items():
            try:
                word = token.decode()
            except UnicodeDecodeError:
                continue
            if word[:1] == " " and (word := word[1:]).isalpha():
                if word == word.lower():
                    low[word] = min(low.get(word, 3), 1 if rank < 5000 else 2 if rank < 20000 else 3)
                elif word == word.capitalize():
                    cap.add(word.lower())
    return {w: str(low.get(w, 0)) + "c" * (w in cap) for w in sorted(low.keys() | cap)}
