"""Words of many texts at once, as 64-bit hashes, with numpy.

Texts are treated as UTF-8 bytes.  A table maps A-Z to a-z and each separator to a space, so every run of
other bytes is a word.  A word's hash is a polynomial over random byte values modulo 2**64, mixed
afterwards; it depends on the word alone, so it is the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once; longer texts are cut between words.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def byte_table(is_separator) -> bytes:
    """Translation of bytes: A-Z to lower case, then separators to a space."""
    out = bytearray(range(256))
    for b in range(65, 91):
        out[b] = b + 32
    return bytes(32 if b < 128 and is_separator(out[b]) else out[b] for b in range(256))


#: Words are runs of 0-9, a-z and everything beyond ASCII.
ALNUM = byte_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
#: Words are runs of anything but the six ASCII white space characters.
NON_SPACE = byte_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit numbers (the finaliser known from splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        n = max(n, CHUNK * 2)
        back = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", back)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _hash_buffer(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words in translated bytes."""
    buf = np.frombuffer(data, dtype=np.uint8)
    inside = np.empty(len(buf) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.not_equal(buf, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[buf] * up[: len(buf)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def _pieces(data: bytes) -> Iterator[bytes]:
    """Cuts one long translated text between words."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def hashed_words(texts: list[str | None], table: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of whole texts as (index of the first text, word hashes, offsets of each text in them).

    ``offsets`` has one entry more than the group has texts.  Null texts have no words.
    """
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass").translate(table)
        if len(data) > CHUNK:
            if group:
                yield first, *_hash_group(group)
            hashes = np.concatenate([_hash_buffer(p)[1] for p in _pieces(data)])
            yield i, hashes, np.array([0, len(hashes)])
            group, size, first = [], 0, i + 1
            continue
        group.append(data)
        size += len(data) + 1
        if size >= CHUNK:
            yield first, *_hash_group(group)
            group, size, first = [], 0, i + 1
    if group:
        yield first, *_hash_group(group)


def _hash_group(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.cumsum([0, *(len(d) + 1 for d in group)])
    starts, hashes = _hash_buffer(b" ".join(group))
    return hashes, np.searchsorted(starts, bounds)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on; the last n - 1 positions are left out."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + hashes[j : j + size]
    return mix(out + np.uint64(n))
