"""Plain words of a text, whatever its writing, for operators that compare or rate texts."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import regex
import xxhash

#: Letters that look like ASCII ones (Cyrillic, Greek, Armenian, after case folding). Fixed values.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ғ": "f", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe",
}
_LOOK = str.maketrans(LOOKALIKES)
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[>|*\s]*(?=[^\W\d_])")
_ASCII = re.compile(r"[a-z0-9]+")
_WORDS = regex.compile(r"\p{Han}|[^\W_\p{Han}]+")


def plain(text: str) -> str:
    """Lower case without marks, format characters, markup, escapes and hyphens at line ends."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = text.replace("\\n", " ").replace("\\t", " ")
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).casefold()
        text = _MARKS.sub("", text).translate(_LOOK)
    else:
        text = text.lower()
    if "-" in text:
        text = _BREAK.sub("", text)
    return text


def words_of(plain_text: str) -> list[str]:
    """Words and numbers; every Han character is a word."""
    return _ASCII.findall(plain_text) if plain_text.isascii() else _WORDS.findall(plain_text)


class Hasher(dict):
    """Word to 64-bit hash, remembered; forgets all beyond ``limit`` words, so it can't grow without end."""

    limit = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
