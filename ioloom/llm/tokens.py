"""Token ids of many texts by the tokenizers library, each distinct word encoded once per worker.

In both vocabularies a single space or line feed between two other characters ends a pre-token, and
no merge crosses it. A text whose white space is of that kind only is cut there; each distinct word
(with the space before it, where the vocabulary keeps that) is encoded by the library once, and the
ids are joined. Any other text goes to the library whole. Either way the ids are those of the whole text.
"""

from __future__ import annotations

import array
import os
import re
import sys
import unicodedata
from functools import lru_cache

#: Bytes that an encoder's words take in a worker process at most: a quarter for each of its two dictionaries and what
#: each held at its last turn.
CACHE_BYTES = 448 << 20
#: What a word takes beside its letters and ids: two objects and their place in a dictionary.
ENTRY_BYTES = 220
#: Longer words are encoded each time.
CACHE_CHARS = 48


def _plain_letters() -> str:
    """The Latin letters that stay one letter, composed with nothing, when a vocabulary lower-cases and composes them."""
    lone = lambda c: c.isalpha() and len(c.lower()) == 1 and all(unicodedata.normalize("NFC", x) == x for x in (c, c.lower()))
    return "".join(c for c in map(chr, range(0x41, 0x250)) if lone(c))


#: Such letters, then ASCII marks without the apostrophe: two pre-tokens in both vocabularies.
_MARKED = re.compile(rf"([{_plain_letters()}]+)([!-&(-/:-@\[-^`{{-~]+)")


def _byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: its own, or for those without a visible one the next from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


_LETTERS = _byte_letters()


class _Words(dict):
    """word -> its ids. A word that isn't there is taken over from the turn before, or encoded.

    A word of letters only is one pre-token, so its bytes go to the merges at once, a third of the work: as it is in the
    vocabulary that keeps spaces and changes no text, in lower case, and of ASCII letters only, in the other.
    """

    def __init__(self, tokenizer, before: str, bare: _Words | None, spaced: bool):
        self.tokenizer, self.before, self.bare, self.spaced = tokenizer, before, self if bare is None else bare, spaced
        self.merges = tokenizer.model
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if marked := _MARKED.fullmatch(word):
                ids = self[marked[1]] + self.bare[marked[2]]
            elif word.isalpha() and (self.spaced or word.isascii()):
                plain = self.before + word if self.spaced else word.lower()
                ids = _packed([t.id for t in self.merges.tokenize("".join([_LETTERS[b] for b in plain.encode()]))])
            else:
                ids = _packed(self.tokenizer.encode(self.before + word, add_special_tokens=False).ids)
        if len(word) <= CACHE_CHARS and self.bytes < CACHE_BYTES // 4:
            self[word] = ids
            self.bytes += ENTRY_BYTES + len(word) + len(ids)
        return ids

    def turn(self) -> None:
        """Forgets the words that weren't met since the last turn."""
        self.old = dict(self)
        self.clear()
        self.bytes = 0


class WordEncoder:
    def __init__(self, path: str, spaced: bool):
        """spaced: a word's ids depend on the space before it; else white space is dropped."""
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.first = _Words(self.tokenizer, "", None, spaced)  # words at a line's start
        self.inner = _Words(self.tokenizer, " ", self.first, spaced)  # words after a space
        self.line_feed = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 16-bit integers; both vocabularies have under 65,536 ids."""
        for words in (self.first, self.inner):
            if words.bytes >= CACHE_BYTES // 4:
                words.turn()
        words = text.split()
        if not words or " ".join(words) != text.replace("\n", " "):
            return self._whole(text)
        first, inner = self.first.__getitem__, self.inner.__getitem__
        if not self.spaced:
            return b"".join(map(first, words))
        lines = [line.split(" ") for line in text.split("\n")]
        return self.line_feed.join([first(line[0]) + b"".join(map(inner, line[1:])) for line in lines])


def _packed(ids: list[int]) -> bytes:
    a = array.array("H", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, spaced)
