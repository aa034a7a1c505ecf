"""Byte-level BPE ids of whole texts by the tokenizers library, one word at a time.

The words of a text (the pattern of the byte-level pre-tokenizer) are encoded
once and remembered, as most are met again.  The pattern below is stated for
the Latin, Greek and Cyrillic blocks; a stretch with any other character goes
through the tokenizer itself, which gives the same ids more slowly, as does a
whole text that spells one of the tokenizer's added tokens.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

_LAST = 0x52F
_SPACES = "\t-\r \x85\xa0"
#: Words that a worker remembers; later ones are encoded anew each time.
REMEMBERED = 500_000
#: Characters that are cut into words at once.
STRETCH = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranges(category: str) -> str:
    """The characters of a Unicode category up to ``_LAST`` as regex ranges."""
    inside = [unicodedata.category(chr(i)).startswith(category) for i in range(_LAST + 1)]
    return "".join(re.escape(chr(i)) for i, yes in enumerate(inside) if yes)


class _Words(dict):
    """Word -> its ids as bytes; a word not seen yet is encoded."""

    def __init__(self, model, dtype: str):
        super().__init__()
        self.model, self.dtype = model, dtype
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(spelled)], self.dtype).tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts with a tokenizer file; ids come as a numpy array."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.words = _Words(self.tokenizer.model, self.dtype)
        letters, numbers = _ranges("L"), _ranges("N")
        self.pattern = re.compile(
            f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+"
            f"| ?[^{_SPACES}{letters}{numbers}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
        )
        self.strange = re.compile(f"[^\x00-{chr(_LAST)}]")
        self.cut = re.compile(f"[^{_SPACES}](?=[{_SPACES}])")
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)")

    def _stretches(self, text: str):
        """Cuts before white space that follows another character: no word spans them."""
        at = 0
        while len(text) - at > STRETCH:
            found = self.cut.search(text, at + STRETCH)
            if not found:
                break
            yield text[at : found.end()]
            at = found.end()
        yield text[at:] if at else text

    def encode(self, text: str | None, end: int | None = None) -> np.ndarray:
        """Ids of the text (null: none), then ``end`` if given."""
        out, text = [], text or ""
        # A cut may not fall into an added token or beside one.
        spelled = self.added.search(text) is not None
        for part in [text] if spelled else self._stretches(text):
            if spelled or self.strange.search(part):
                ids = self.tokenizer.encode(part, add_special_tokens=False).ids
                out.append(np.array(ids, self.dtype).tobytes())
            else:
                out.append(b"".join(map(self.words.__getitem__, self.pattern.findall(part))))
        if end is not None:
            out.append(np.array([end], self.dtype).tobytes())
        return np.frombuffer(b"".join(out), self.dtype)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)
