"""Token ids of whole texts with a public BPE tokenizer, cached by pre-token.

Both supported vocabularies split a text with a regular expression and merge inside each piece alone, so the
ids of a text are those of its pieces in order. Texts made of ASCII and the Latin-1 letters, where the classes
of that expression are certain, are split here and looked up in a cache that the tokenizer itself fills; every
other text goes to the tokenizer whole, and so does a text that holds the string of a special token, which the
library turns into that token's id. A test holds both ways against each other.
"""

from __future__ import annotations

import re

import numpy as np

#: Anything else in a text sends it to the tokenizer whole.
_UNSURE = re.compile("[^\t-\r -~À-ÿ]")
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPLIT = {
    "byte": re.compile(rf"'(?:[smtd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+"),
}
#: Pieces cached in one worker before the cache starts anew; bounds its memory.
CACHE_PIECES = 250_000


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in both vocabularies: a printable one for itself, then the rest in
    order from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Pieces(dict):
    def __init__(self, model, dtype):
        super().__init__()
        self.model, self.dtype, self.characters = model, dtype, _byte_characters()

    def __missing__(self, piece: str) -> bytes:
        # a piece is normalized and split already, so its bytes go to the merges as they are
        merged = self.model.tokenize(piece.encode().decode("latin-1").translate(self.characters))
        ids = [token.id for token in merged]
        if len(self) >= CACHE_PIECES:
            self.clear()
        found = np.asarray(ids, self.dtype).tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found


class Encoder:
    """``encode(text)`` gives the ids as little-endian bytes, ``width`` bytes each."""

    _loaded: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.lower = self.tokenizer.normalizer is not None
        self.split = _SPLIT["word" if self.lower else "byte"]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.pieces = _Pieces(self.tokenizer.model, self.dtype)

    @classmethod
    def load(cls, path: str) -> Encoder:
        """One encoder for each path and Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _UNSURE.search(text) or any(x in text for x in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if self.lower:
            text = text.lower()
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))
