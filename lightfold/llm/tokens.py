"""Token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k"
END = 0
SPECIAL = "<|endoftext|>"  # the vocabulary's one added token, numbered after all others
_ODD_SPACE = re.compile(r"\s\s")
CACHE = 400_000


class Encoder:
    """Ids as the tokenizers file gives them, through the same vocabulary's ranks.

    The vocabulary's pattern never joins text across a single space or line end between two
    other characters, and never across SPECIAL, which is one id, so a text without two white-space characters in a row falls into chunks
    that are encoded alone and remembered. All other texts are encoded whole.
    """

    def __init__(self, name: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = np.array([len(ranks)], "<u4").tobytes()
        self.known: dict[str, bytes] = {}

    def _new(self, chunk: str) -> bytes:
        got = np.array(self.whole(chunk), "<u4").tobytes()
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[chunk] = got
        return got

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if SPECIAL in text:
            return self.special.join(map(self._plain, text.split(SPECIAL)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or "  " in text:
            return np.array(self.whole(text), "<u4").tobytes()
        known, new = self.known.get, self._new
        head, *chunks = text.replace("\n", " \n").split(" ")
        # a chunk after a space keeps it; one after a line end has taken its place
        out = [known(head) or new(head)] if head else []
        for c in chunks:
            key = c if c[:1] == "\n" else " " + c
            out.append(known(key) or new(key))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY) -> Encoder:
    return Encoder(name)
