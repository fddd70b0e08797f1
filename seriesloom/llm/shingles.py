"""Sets of word shingles as sorted 128-bit hashes.

A word's hash is its BLAKE2b digest of 128 bits, under a key of this module; a shingle's two halves are linear forms, with odd
weights by position, of the halves of its words' digests. Two different shingles agree with probability about 2**-128,
whatever the words look like; so do the digests of different sets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

from seriesloom.llm.shared import SPACE

_U = np.uint64
_KEY = b"word shingles"
_GAP = re.compile(rf"[{SPACE}]".encode())
#: Distinct words that a hasher remembers, the longest of them, and the bytes of a text that are cut into words at once.
MOST_WORDS, LONGEST, AT_ONCE = 1 << 17, 64, 1 << 20
EMPTY = np.zeros((2, 0), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Digests(dict):
    """Digest of each word; forgets all when it has too many."""

    def __missing__(self, word: bytes) -> bytes:
        made = hashlib.blake2b(word, digest_size=16, key=_KEY).digest()
        if len(word) <= LONGEST:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = made
        return made


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of about AT_ONCE bytes that end at white space."""
    start = 0
    while len(data) - start > AT_ONCE:
        gap = _GAP.search(data, start + AT_ONCE)
        if gap is None:
            break
        yield data[start : gap.start()]
        start = gap.end()
    yield data[start:] if start else data


class Hasher:
    """Shingles of texts, A-Z lower-cased; words are runs of other than ASCII white space."""

    def __init__(self, width: int):
        self.width = width
        self.digests = _Digests()
        self.weights = mixed(np.arange(1, 2 * width + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).reshape(2, width) | _U(1)

    def words(self, text: str) -> np.ndarray:
        """128-bit digests of the words, two columns."""
        digest = self.digests.__getitem__
        # the bytes methods know exactly the six white-space characters and A-Z
        joined = b"".join(b"".join(map(digest, piece.split())) for piece in _pieces(text.encode("utf-8", "surrogatepass").lower()))
        return np.frombuffer(joined, dtype="<u8").reshape(-1, 2)

    def shingles(self, text: str | None, halves: int = 2) -> np.ndarray:
        """Two rows, the halves of each shingle in order, or the first alone; fewer words than a shingle has make one shingle, none make none."""
        words = self.words(text) if text else EMPTY.T
        if not len(words):
            return EMPTY[:halves]
        n = max(1, len(words) - self.width + 1)
        out = np.zeros((halves, n), dtype=np.uint64)
        for k in range(min(self.width, len(words))):
            for half in range(halves):
                out[half] += words[k : k + n, half] * self.weights[half, k]
        if len(words) < self.width:
            out += mixed(np.array([[len(words)], [len(words) + self.width]], dtype=np.uint64))[:halves]
        return mixed(out)

    def set_of(self, text: str | None) -> np.ndarray:
        """The distinct shingles in order, two rows."""
        return distinct(self.shingles(text))


def distinct(grams: np.ndarray) -> np.ndarray:
    """Columns in order and once each."""
    if grams.shape[1] < 2:
        return grams
    made = grams[:, np.argsort(grams[0])]
    same = made[0, 1:] == made[0, :-1]
    if same.any():
        if (made[1, 1:] != made[1, :-1])[same].any():  # halves that agree by chance
            made = grams[:, np.lexsort((grams[1], grams[0]))]
            same = (made[:, 1:] == made[:, :-1]).all(axis=0)
        made = made[:, np.concatenate([[True], ~same])]
    return np.ascontiguousarray(made)


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    made = hashlib.blake2b(own.tobytes(), digest_size=16, key=_KEY).digest()
    return int.from_bytes(made[:8], "little", signed=True), int.from_bytes(made[8:], "little", signed=True)
