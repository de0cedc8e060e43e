"""Byte-level BPE ids for whole texts, with a bounded cache of space-led chunks.

A byte-level BPE vocabulary of this kind first cuts a text into words by a pattern in which
a blank always opens a new piece.  A text may therefore be cut before every blank and
the chunks encoded on their own: the joined ids are those of the whole text.  The one exception
is a blank with white space on both sides, where the pattern looks across the cut; such texts are
encoded whole.  Chunks recur, so most of them come from a cache of bounded size.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np

#: A blank between two white-space characters: here a text is not cut.
UNSAFE = re.compile(r"\s \s")
#: Unicode white space that may stand before a blank.
WIDE_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0                　"
WIDE_THEN_BLANK = re.compile(f"[{WIDE_SPACE}] ")
#: Letters, then marks alone.
LETTERS_MARKS = re.compile(r"([^\W\d_]+)([^\s\w]+)")
#: Entries of each of the two generations of the cache, about 120 bytes each.
CACHE_ENTRIES = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def default_vocabulary() -> str:
    """Path of the public 50k byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def splits_at_blanks(text: str) -> bool:
    """True if cutting before every blank cannot change the ids."""
    if "  " in text or "\n " in text or "\t " in text or "\r " in text or "\x0b " in text or "\x0c " in text:
        return UNSAFE.search(text) is None
    return text.isascii() or WIDE_THEN_BLANK.search(text) is None or UNSAFE.search(text) is None


class ChunkEncoder:
    """Encodes texts to little-endian ids of ``dtype``; one per Python worker.

    Null texts count as empty and give no ids.  ``end_id`` is appended to each text.
    """

    def __init__(self, vocabulary: str, end_id: int | None = 0, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        #: Words after a blank and words without, each with an older generation.
        self.caches: list[dict[str, bytes]] = [{}, {}, {}, {}]
        self.cache_entries = cache_entries

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _new(self, word: str, blank: str) -> bytes:
        """Ids of one chunk; marks after letters, and a line end between words, are pieces of their own."""
        if word.isalpha():  # one piece of the pattern, so the model alone
            piece = (blank + word).encode().decode("latin-1").translate(self.letters)
            return array(self.dtype.char, [x.id for x in self.model.tokenize(piece)]).tobytes()
        if (m := LETTERS_MARKS.fullmatch(word)) and m[1].isalpha():
            return self._cached(m[1], blank) + self._cached(m[2], "")
        lines = word.split("\n")
        if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            return self._cached("\n", "").join([self._cached(lines[0], blank), *(self._cached(x, "") for x in lines[1:])])
        return self._raw(blank + word)

    def _cached(self, word: str, blank: str = " ") -> bytes:
        k = 0 if blank else 2
        if (ids := self.caches[k].get(word)) is None:
            if (ids := self.caches[k + 1].get(word)) is None:
                ids = self._new(word, blank)
            if len(word) <= 48 and "\n" not in word[:-1]:
                if len(self.caches[k]) >= self.cache_entries:
                    self.caches[k : k + 2] = {}, self.caches[k]
                self.caches[k][word] = ids
        return ids

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text, as bytes, with the end id."""
        out: list[bytes] = []
        for text in texts:
            if not text:
                out.append(self.end)
            elif not splits_at_blanks(text):
                out.append(self._raw(text) + self.end)
            else:
                head, *words = text.split(" ")
                ids = list(map(self.caches[0].get, words))
                if None in ids:
                    ids = [self._cached(word) if found is None else found for word, found in zip(words, ids, strict=True)]
                out.append(b"".join([self._cached(head, "") if head else b"", *ids, self.end]))
        return out

    def ids(self, encoded: bytes) -> np.ndarray:
        return np.frombuffer(encoded, self.dtype)


_ENCODERS: dict[tuple[str, int | None], ChunkEncoder] = {}


def encoder(vocabulary: str, end_id: int | None = 0) -> ChunkEncoder:
    """The worker's encoder; Python workers are reused, so its cache lives over tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (vocabulary, end_id) not in _ENCODERS:
        _ENCODERS[vocabulary, end_id] = ChunkEncoder(vocabulary, end_id)
    return _ENCODERS[vocabulary, end_id]
