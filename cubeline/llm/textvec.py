"""Words and word shingles as 64-bit hashes, vectorised over many texts at once.

Texts are taken whole. Memory is bounded by working through blocks of bytes; a
text longer than a block is cut at separators, and only its word hashes (8 bytes
a word) are held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that part words: space and \x09-\x0D.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and ASCII characters that are no letters or digits part words too.
LETTERS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in LOWER)
BLOCK = 1 << 20

_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(0, 1 << 32, 256, dtype=np.uint64) << np.uint64(32) | _RNG.randint(0, 1 << 32, 256, dtype=np.uint64)
_POSITION = _RNG.randint(0, 1 << 32, 8, dtype=np.uint64) << np.uint64(32) | _RNG.randint(0, 1 << 32, 8, dtype=np.uint64) | np.uint64(1)
_M = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        for key, base in (("up", _M), ("down", pow(_M, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one block."""
    buf = np.frombuffer(data, np.uint8)
    sep = _IS_SEP[buf]
    edge = np.diff(np.concatenate(([True], sep, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts])


def _cut(data: bytes) -> Iterator[bytes]:
    """Pieces of about a block each, cut after separators."""
    at = 0
    while len(data) - at > BLOCK:
        end = at + BLOCK
        while end < len(data) and data[end] not in SEPARATORS:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: list[str | None], table: bytes = LOWER) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first text, the word hashes of each text), block by block; null counts as empty.

    table: bytes as they count; by default A-Z as a-z.
    """
    held: list[bytes] = []
    size = first = 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").translate(table)
        if held and size + len(data) > BLOCK:
            yield first, _block(held)
            held, size, first = [], 0, k
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, _block(held)


def _block(held: list[bytes]) -> list[np.ndarray]:
    if len(held) == 1 and len(held[0]) > BLOCK:
        return [np.concatenate([_words(piece)[2] for piece in _cut(held[0])])]
    starts, _, hashes = _words(b"\n".join(held))
    edges = np.cumsum([len(x) + 1 for x in held])[:-1]
    return np.split(hashes, np.searchsorted(starts, edges))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole sequence if shorter; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < width:
        return mix(np.array([(words * _POSITION[:n]).sum() + np.uint64(n)], np.uint64))
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h += words[k : n - width + 1 + k] * _POSITION[k]
    return np.unique(mix(h))
