"""Boundaries of a slice as chains of moves along the cracks between pixels.

Corners of pixels are the nodes of a graph, cracks its edges. Each connected part
of the graph is one walk over all its edges. A walk is written in moves of two
bits; a pair of opposite moves, which no walk makes, stands for a branch (come
back here later) or an end (go back to the last branch).
"""

from __future__ import annotations

import numpy as np

from ..operators.components import united

# Codes of the moves.
UP, RIGHT, DOWN, LEFT = 0, 1, 2, 3
STEP = {UP: (0, -1), RIGHT: (1, 0), DOWN: (0, 1), LEFT: (-1, 0)}
BRANCH, END = 4, 5
#: The pairs of moves for a branch and an end; the second is for behind the move that would be taken for part of the first.
PAIRS = {BRANCH: ((UP, DOWN), (LEFT, RIGHT), DOWN), END: ((DOWN, UP), (RIGHT, LEFT), UP)}


def width_of(n: int) -> int:
    """The fewest bytes, of 1, 2, 4, 8, that hold n."""
    return next(w for w in (1, 2, 4, 8) if n < 1 << (8 * w))


def cracks_of(labels: np.ndarray, equal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Inner cracks of a slice (x, y) that are drawn: across x (right of each pixel but the last) and across y. equal: between equal labels, else unequal ones."""
    across_x, across_y = labels[1:, :] != labels[:-1, :], labels[:, 1:] != labels[:, :-1]
    return (~across_x, ~across_y) if equal else (across_x, across_y)


def walks(across_x: np.ndarray, across_y: np.ndarray, shape: tuple[int, int]) -> list[tuple[int, list[int]]]:
    """(start node, symbols) of each connected part, in the order of start nodes. Node x + (sx + 1) * y is the upper left corner of pixel (x, y)."""
    sx, sy = shape
    wide = sx + 1
    moves: dict[int, set[int]] = {}
    ends = []
    for x, y in np.argwhere(across_x).tolist():  # the crack right of pixel (x, y) runs down from corner (x + 1, y)
        ends.append((x + 1 + wide * y, DOWN, wide))
    for x, y in np.argwhere(across_y).tolist():  # the crack below it runs right from corner (x, y + 1)
        ends.append((x + wide * (y + 1), RIGHT, 1))
    for node, move, by in ends:
        moves.setdefault(node, set()).add(move)
        moves.setdefault(node + by, set()).add(move ^ 2)
    by = {UP: -wide, RIGHT: 1, DOWN: wide, LEFT: -1}
    out = []
    for start in sorted(moves):
        if not moves[start]:
            continue
        node, symbols, open_ = start, [], []
        while True:
            left = moves[node]
            if left:
                if len(left) > 1:
                    open_.append((node, len(symbols)))
                    symbols.append(BRANCH)
                move = min(left)
                left.remove(move)
                node += by[move]
                moves[node].remove(move ^ 2)
                symbols.append(move)
                continue
            while open_ and not moves[open_[-1][0]]:  # nothing is left there: the branch was none
                symbols[open_.pop()[1]] = None
            symbols.append(END)
            if not open_:
                break
            node = open_.pop()[0]
        out.append((start, [s for s in symbols if s is not None]))
    return out


def to_codes(symbols: list[int]) -> list[int]:
    out, before = [], None
    for s in symbols:
        if s < 4:
            out.append(s)
            before = s
        else:
            usual, other, clash = PAIRS[s]
            out += other if before == clash else usual
            before = None
    return out


def write_index(nodes: list[int], shape: tuple[int, int]) -> bytes:
    """Start nodes by row: size, number of rows; for each row its distance from the one before, its number of nodes, and their distances."""
    sx, sy = shape
    wx, wy = width_of(sx + 1), width_of(sy + 1)
    rows: dict[int, list[int]] = {}
    for n in nodes:
        rows.setdefault(n // (sx + 1), []).append(n % (sx + 1))
    body, last = [len(rows).to_bytes(wy, "little")], 0
    for y, xs in rows.items():
        body += [(y - last).to_bytes(wy, "little"), len(xs).to_bytes(wx, "little"), *((b - a).to_bytes(wx, "little") for a, b in zip([0, *xs[:-1]], xs, strict=True))]
        last = y
    raw = b"".join(body)
    return len(raw).to_bytes(4, "little") + raw


def read_index(raw: bytes, shape: tuple[int, int]) -> tuple[list[int], int]:
    """Start nodes, and where the codes begin."""
    sx, sy = shape
    wx, wy = width_of(sx + 1), width_of(sy + 1)
    end, at = 4 + int.from_bytes(raw[:4], "little"), 4

    def take(w: int) -> int:
        nonlocal at
        at += w
        return int.from_bytes(raw[at - w : at], "little")

    out, y = [], 0
    for _ in range(take(wy)):
        y += take(wy)
        x = 0
        for _ in range(take(wx)):
            x += take(wx)
            out.append(x + (sx + 1) * y)
    return out, end


def differences(codes: np.ndarray) -> np.ndarray:
    return np.diff(codes, prepend=0) & 3


def pack(codes: np.ndarray) -> bytes:
    """Four differences of codes in a byte, the first in the lowest bits."""
    d = differences(codes)
    d = np.pad(d, (0, -len(d) % 4)).reshape(-1, 4)
    return (d << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    return np.cumsum(((b[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1).astype(np.int64)) & 3


def draw(nodes: list[int], codes: list[int], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The cracks that the walks from nodes go along, as of cracks_of."""
    sx, sy = shape
    across_x, across_y = np.zeros((max(0, sx - 1), sy), bool), np.zeros((sx, max(0, sy - 1)), bool)
    xs, ys, vx, vy = [], [], [], []
    at, n = 0, len(codes)
    for node in nodes:
        y, x = divmod(node, sx + 1)
        back = [(x, y)]
        waiting = None  # a move that the next one may turn into a sign
        todo = 1
        while todo and at < n:
            move = codes[at]
            at += 1
            if waiting is not None and move ^ waiting == 2:
                waiting = None
                if move in (UP, LEFT):
                    todo -= 1
                    if todo:
                        x, y = back.pop()
                else:
                    todo += 1
                    back.append((x, y))
                continue
            if waiting is not None:
                if waiting == RIGHT:
                    vx.append(x)
                    vy.append(y)
                    x += 1
                elif waiting == LEFT:
                    x -= 1
                    vx.append(x)
                    vy.append(y)
                elif waiting == DOWN:
                    xs.append(x)
                    ys.append(y)
                    y += 1
                else:
                    y -= 1
                    xs.append(x)
                    ys.append(y)
            waiting = move
        if todo:
            raise ValueError("a chain has no end")
    xs, ys, vx, vy = (np.array(a, np.int64) for a in (xs, ys, vx, vy))
    for a, hi in ((xs - 1, sx - 1), (ys, sy), (vx, sx), (vy - 1, sy - 1)):
        if len(a) and (a.min() < 0 or a.max() >= hi):
            raise ValueError("a chain leaves the slice")
    across_x[xs - 1, ys] = True
    across_y[vx, vy - 1] = True
    return across_x, across_y


def regions(across_x: np.ndarray, across_y: np.ndarray, shape: tuple[int, int], equal: bool) -> np.ndarray:
    """Component ids (x, y) of the pixels joined across the cracks that are no boundaries, numbered by first pixel with x fastest."""
    sx, sy = shape
    joined_x, joined_y = (across_x, across_y) if equal else (~across_x, ~across_y)
    at = np.arange(sx * sy).reshape(sy, sx).T
    a = np.concatenate([at[:-1, :][joined_x], at[:, :-1][joined_y]])
    b = np.concatenate([at[1:, :][joined_x], at[:, 1:][joined_y]])
    root = united(sx * sy, a, b)
    return np.unique(root, return_inverse=True)[1].reshape(sy, sx).T.astype(np.uint32)
