"""Words and hashes of whole texts on NumPy arrays: the inner loops of the operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are taken, and spans hashed, in groups of about so many bytes, to bound the memory of a worker.
GROUP_BYTES = 256 << 10

#: Each frees what an operator keeps in a worker from task to task. Workers outlive stages, so an operator that needs much memory calls release().
keepers: list[Callable[[], None]] = []


def release() -> None:
    for free in keepers:
        free()


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U))
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """BASE ** i and INVERSE ** i modulo 2 ** 64 for i < n at least. Tables for more than a group (one very long span) are not kept."""
    if _powers and n <= len(_powers[0]):
        return _powers
    made = []
    for b in (BASE, INVERSE):
        p = np.full(max(n, GROUP_BYTES + 1), b, U)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= GROUP_BYTES + 1:
        _powers[:] = made
    return made


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span, the same wherever a span stands; spans ascend and do not overlap. fold: a byte table applied first."""
    out = np.empty(len(start), U)
    table = BYTES if fold is None else BYTES[fold]
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + GROUP_BYTES, "right")))
        some = data[start[i] : end[j - 1]]
        up, down = powers(len(some) + 1)
        sums = np.empty(len(some) + 1, U)
        sums[0] = 0
        np.cumsum(table[some] * up[: len(some)], out=sums[1:])
        a, b = start[i:j] - start[i], end[i:j] - start[i]
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + U(0x632BE59BD9B4E019) * (b - a).astype(U))
        i = j
    return out


def groups(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs first:last of texts (null: empty) as UTF-8 bytes and the offsets of each text in them; a text longer than size, GROUP_BYTES if it is not given, stands alone."""
    size = size or GROUP_BYTES
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (maximal run of bytes that are not ASCII white space), and offsets of each text in these."""
    n = len(data)
    solid = np.zeros(n + 2, dtype=bool)
    solid[1:-1] = ~SPACE[data]
    head = np.zeros(n + 1, dtype=bool)
    head[offsets] = True  # a text begins or ends here
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | head[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | head[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; of the whole sequence if there are fewer, with its length."""
    if len(h) < k:
        k = len(h)
        if not k:
            return np.empty(0, U)
    n = len(h) - k + 1
    out = np.full(n, U(k))
    for i in range(k):
        out = mix(out * BASE + h[i : i + n])
    return out
