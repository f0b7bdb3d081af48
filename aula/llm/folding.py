"""Words of a text as 64-bit hashes, vectorised over a block of texts.

A word is a run of letters and digits of the text's folded form: the consistent form of ``look_alike``, lowercased.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

from aula.llm.look_alike import ALIKE, INVISIBLE, LETTERS

_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_MARK = re.compile("[̀-ͯ]")
_TABLE = str.maketrans(ALIKE)
#: Small letters whose capitals look Latin: without case they must go the way of the capitals.
_SMALL = {ord(a.lower()): b.lower() for a, b in LETTERS.items() if len(a.lower()) == 1 and a.isupper()}
_P = np.uint64(0x9E3779B97F4A7C15)
SEPARATOR = "\n"


def fold(text: str) -> str:
    """The consistent form (look-alikes as Latin letters), lowercased."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text)).translate(_TABLE)
        if _MARK.search(text):
            text = unicodedata.normalize("NFC", text)
        return text.lower().translate(_SMALL)
    return text.lower()


@cache
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@cache
def _inverse() -> np.uint64:
    return np.uint64(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and for each text the number of the first word (one more at the end)."""
    folded = [fold(t) for t in texts]
    points = np.frombuffer(SEPARATOR.join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, folded), np.int64, len(folded))
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])  # the separator is no word character
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _word_characters()[points]
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(points), _P))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers)])
        back = np.cumprod(np.full(len(points), _inverse()))
        # the sum over a word, moved to the front so that it does not depend on the word's place
        hashes = mix((sums[last] - sums[first]) * back[first])
    return hashes, np.searchsorted(first, begin)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each word but the last k - 1."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _P + words[i : i + n]
    return mix(out)


def string_hashes(strings: list[str]) -> np.ndarray:
    """64-bit hashes of whole strings."""
    if not strings:
        return np.empty(0, np.uint64)
    points = np.frombuffer(SEPARATOR.join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(points) + 1, _P))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)])])
        back = np.cumprod(np.full(len(points) + 1, _inverse()))
        return mix((sums[first + lengths] - sums[first]) * back[first])
