"""Token ids of whole texts with an installed tokenizer file, cached by word.

``WordTokenizer`` gives exactly the ids of ``tokenizers`` on the same file
(``add_special_tokens=False``) for vocabularies whose pre-tokenizer drops white
space: text is cut at blanks, tabs and line ends, which such a pre-tokenizer never
joins across, and the ids of each piece are remembered."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

CACHE = 500_000          # texts remembered, of words and of pieces
# lower-case letters up to U+024F, whose category and case are settled, with a tail of ASCII marks but "'"
_PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
# Latin-1 characters that the pre-tokenizer takes for marks: all but letters, numbers and its white space
_MARK = "[%s]" % "".join(re.escape(c) for c in map(chr, range(256)) if not c.isalnum() and c not in "\t\n\v\f\r \x85\xa0")
# a full stop or comma beside another mark: they are encoded together
_RUN = re.compile(f"[.,]{_MARK}|{_MARK}[.,]")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others take the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Ids(dict):
    """text -> id bytes, made when first asked for; starts anew beyond CACHE entries."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, text: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[text] = self.make(text)
        return ids


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.ids = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.letters = _byte_letters()
        self.words, self.pieces = _Ids(self._word), _Ids(self._piece)

    def _word(self, word: str) -> bytes:
        ids = self.ids
        raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([ids[t.id] for t in self.tokenize(raw)])

    def _piece(self, piece: str) -> bytes:
        if m := _PLAIN.fullmatch(piece.lower()):
            word, marks = m.groups()
            return self.words[word] + self.words[marks] if marks else self._word(word)
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        text = text.replace("\n", " ").replace("\t", " ")
        if _latin(text) and "<|" not in text and not _RUN.search(text):  # fewer pieces, the same ids
            text = text.lower().replace(".", " .").replace(",", " ,")
        return b"".join(map(self.pieces.__getitem__, text.split(" ")))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so its caches serve the tasks that follow."""
    return WordTokenizer(path)
