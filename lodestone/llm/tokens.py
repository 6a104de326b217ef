"""Byte-level BPE over the public vocabulary files."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken

#: Folder of the vocabulary files (a parameter of every operator that tokenises) and the file used.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pieces without going back within a run, which is quicker; tiktoken's own form of it.
_QUICK = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Free in the vocabulary file; ends a document.
END = 50256
_NONE = np.zeros(0, np.uint32)


class Encoder:
    def __init__(self, folder: str = FOLDER, vocabulary: str = VOCABULARY):
        with open(f"{folder}/{vocabulary}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=_QUICK, mergeable_ranks=ranks, special_tokens={"<|end|>": END})
        self.size = max(ranks.values()) + 1

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, as int32, and the number of ids of each text; a null has none."""
        ids = [self._one(t) if t else _NONE for t in texts]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.concatenate([_NONE, *ids]).view(np.int32), n

    def _one(self, text: str) -> np.ndarray:
        """Without Python's numbers in between. No special token is allowed, so one that a text spells out is text."""
        try:
            return self.bpe.encode_to_numpy(text, disallowed_special=())
        except UnicodeEncodeError:  # half of a surrogate pair, which this way can't replace
            return np.array(self.bpe.encode_ordinary(text), np.uint32)
