"""Checksums of the stream format, on arrays."""

from __future__ import annotations

from functools import cache

import numpy as np

#: The reflected polynomials of CRC32C and of the header's CRC8.
CRC32C, CRC8 = 0x82F63B78, 0xE7


def byte_table(polynomial: int) -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (polynomial if i & 1 else 0)
        out.append(i)
    return out


TABLE8 = byte_table(CRC8)
TABLE32 = np.array(byte_table(CRC32C), np.uint32)


def crc8(data: bytes) -> int:
    c = 0xFF
    for b in data:
        c = TABLE8[c ^ b]
    return c


def applied(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit words, given by the images of the 32 bits, applied to each word of x."""
    out = np.zeros_like(x)
    for k in range(32):
        out ^= np.where((x >> np.uint32(k)) & np.uint32(1), op[k], np.uint32(0))
    return out


@cache
def zeros_behind(log_n: int) -> np.ndarray:
    """What 2 ** log_n bytes of 0 do to a running checksum."""
    if log_n == 0:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return (bits >> np.uint32(8)) ^ TABLE32[bits & np.uint32(255)]
    half = zeros_behind(log_n - 1)
    return applied(half, half)


def shifted(x: np.ndarray, n: int) -> np.ndarray:
    k = 0
    while n >> k:
        if n >> k & 1:
            x = applied(zeros_behind(k), x)
        k += 1
    return x


def crc32c(data: bytes | np.ndarray) -> int:
    """Lanes of equal length run side by side; pairs of lanes are then joined, as the checksum is linear."""
    raw = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else np.ascontiguousarray(data).view(np.uint8).reshape(-1)
    n = len(raw)
    lanes = 1 << max(0, (n.bit_length() - 1) // 2)
    size = -(-n // lanes) if n else 0
    grid = np.zeros(lanes * size, np.uint8)
    grid[len(grid) - n :] = raw  # zeros in front change nothing
    c = np.zeros(lanes, np.uint32)
    for column in grid.reshape(lanes, size).T if size else ():
        c = (c >> np.uint32(8)) ^ TABLE32[(c ^ column) & np.uint32(255)]
    while len(c) > 1:
        c = shifted(c[::2], size) ^ c[1::2]
        size *= 2
    start = shifted(np.array([0xFFFFFFFF], np.uint32), n)
    return int(c[0] ^ start[0]) ^ 0xFFFFFFFF
