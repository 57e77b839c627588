"""Context model of crack codes: the next difference of codes is written by its rank among those that follow the last few."""

from __future__ import annotations

from itertools import permutations

import numpy as np

#: Orders of the four codes, by number.
ORDERS = list(permutations(range(4)))
NUMBER = {p: i for i, p in enumerate(ORDERS)}
#: Ranks 0 to 3 as bits, the first in the lowest bit, and their lengths.
WORDS = ((0b0, 1), (0b01, 2), (0b011, 3), (0b111, 3))


def contexts(d: np.ndarray, order: int) -> np.ndarray:
    """The context of each difference: the order ones before it in base 4, the last one highest; missing ones are 0."""
    out = np.zeros(len(d), np.int64)
    for k in range(1, order + 1):
        if k < len(d):
            out[k:] += d[:-k].astype(np.int64) << (2 * (order - k))
    return out


def keys(d: np.ndarray, order: int) -> np.ndarray:
    """4 * context + difference, for each difference."""
    return contexts(d, order) * 4 + d


def histogram(slices: list[np.ndarray], order: int) -> np.ndarray:
    """4 ** order x 4: how often each difference follows each context."""
    out = np.zeros(4 ** (order + 1), np.int64)
    for d in slices:
        out += np.bincount(keys(d, order), minlength=len(out))
    return out.reshape(-1, 4)


def ranking(counts: np.ndarray) -> np.ndarray:
    """For each context, the codes from the most to the least frequent; ties in the order of codes."""
    return np.argsort(-counts, axis=1, kind="stable")


def pack_bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Values of so many bits, one after another, lowest bits first."""
    start = np.cumsum(lengths) - lengths
    bits = np.zeros(int(lengths.sum()), np.uint8)
    for k in range(int(lengths.max()) if len(lengths) else 0):
        has = lengths > k
        bits[start[has] + k] = (values[has] >> k) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def write_model(ranks: np.ndarray) -> bytes:
    numbers = np.array([NUMBER[tuple(r)] for r in ranks.tolist()])
    return pack_bits(numbers, np.full(len(numbers), 5))


def model_bytes(order: int) -> int:
    return (4**order * 5 + 7) // 8 if order else 0


def read_model(raw: bytes, order: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: 5 * 4**order].reshape(-1, 5)
    return np.array(ORDERS)[(bits << np.arange(5)).sum(axis=1)]


def encode(d: np.ndarray, ranks: np.ndarray, order: int) -> bytes:
    """The first difference in two bits, each other one by the word of its rank."""
    if not len(d):
        return b""
    place = np.argsort(ranks, axis=1)
    r = place[contexts(d, order), d][1:]
    words, lengths = np.array(WORDS).T
    return pack_bits(np.concatenate([d[:1], words[r]]), np.concatenate([[2], lengths[r]]))


def decode(raw: bytes, ranks: np.ndarray, order: int) -> list[int]:
    """Codes; what the last bits left over spell is kept, as chains say where they end."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").tolist()
    if len(bits) < 2:
        return []
    table, top = ranks.tolist(), 2 * (order - 1)
    d = code = bits[0] | bits[1] << 1
    context, out, at, n = d << top, [code], 2, len(bits)
    while at < n:
        rank = 0
        while rank < 3 and at < n and bits[at]:
            rank += 1
            at += 1
        if rank < 3:
            at += 1
        d = table[context][rank]
        code = (code + d) & 3
        out.append(code)
        context = context >> 2 | d << top
    return out
