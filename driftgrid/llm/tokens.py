"""Byte-level token coder that runs inside tasks."""

from __future__ import annotations

import json
import os
import re

# Letters that one alternative of the patterns covers, and the split pattern of the vocabulary;
# texts with other letters take the library's own path.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The bytes that stand for themselves in byte-level vocabularies; the others follow from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
MEMO = 400_000


def byte_letters() -> dict[int, str]:
    rest = [b for b in range(256) if b not in PLAIN]
    return {**{b: chr(b) for b in PLAIN}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class ByteTokens:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes, equal to those of the vocabulary's own library.

    Ids are merge ranks here, so a rank coder over the same vocabulary gives the same ids, faster. Texts
    with other letters, and special tokens spelled out, go to the library itself.
    """

    OTHER = re.compile(f"[^\t\n\r\x20-\x7e{LATIN}]|<\\|endoftext\\|>")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import tiktoken
        from tokenizers import Tokenizer
        self.np, self.library = np, Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        content = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in content["added_tokens"]}
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes([byte_of[c] for c in token]): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids if self.OTHER.search(text) else self.ranked.encode_ordinary(text)
        return self.np.array(ids, dtype="<u4").tobytes()
