"""Words, their hashes and rolling hashes of word sequences, shared by the shingle operators."""

from __future__ import annotations

import numpy as np
import xxhash

from lodestone.llm.common import holds

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word (uint64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; a bounded cache."""

    def __init__(self, keep: int = 200_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= self.keep:
                self.clear()
            self[word] = h
        return h

    def begin(self) -> None:
        """A stage that uses the cache begins in this worker."""
        holds(f"words-{id(self)}", self.clear)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_POWERS: dict[str, np.ndarray] = {"step": np.ones(1, dtype=np.uint64), "back": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["step"]) < n:
        size = max(n, 2 * len(_POWERS["step"]))
        for name, base in (("step", _STEP), ("back", _BACK)):
            full = np.full(size, base, dtype=np.uint64)
            full[0] = 1
            _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["step"][:n], _POWERS["back"][:n]


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes; equal runs have equal hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    step, back = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * step[:-1], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * back[:n])
