"""SetSketch registers: mergeable, locality-sensitive summaries of sets.

Each element runs a Poisson process over the registers; a register keeps the
smallest arrival time of all elements, truncated to exponentially spaced
levels: ``floor(1 - log_b(time))`` held within 0 and ``LIMIT``. The union of
two sets has the register-wise maximum of their sketches.
"""

from __future__ import annotations

import numpy as np

from .textkit import U, mix

REGISTERS = 120
BASE = 1.001
RATE = 20.0
LIMIT = 65535
MISS = 1e-6

_LOG_BASE = np.log(BASE)
_STEP = U(0x9E3779B97F4A7C15)


def sketch(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS, uint16) of the sets ``values[first[i]:first[i+1]]``; empty sets give zeros."""
    rows = len(first) - 1
    lowest = np.full(rows * REGISTERS, np.inf)
    owner = np.repeat(np.arange(rows), np.diff(first))
    time = np.zeros(len(values))
    live, step = values, 0
    while len(live):
        ahead = int(np.clip(40_000 // len(live), 1, 64))
        drawn = mix(live[:, None] + _STEP * np.arange(step + 1, step + ahead + 1, dtype=np.uint64))
        waits = -np.log((((drawn >> U(24)).astype(np.float64)) + 0.5) / 2.0**40) / (REGISTERS * RATE)
        times = time[:, None] + np.cumsum(waits, axis=1)
        slot = ((drawn & U(0xFFFFFF)) * U(REGISTERS)) >> U(24)
        np.minimum.at(lowest, (owner[:, None] * REGISTERS + slot.astype(np.int64)).ravel(), times.ravel())
        step += ahead
        # an arrival after a row's last register was hit cannot lower any register
        last = lowest.reshape(rows, REGISTERS).max(axis=1)
        going = times[:, -1] < last[owner]
        live, time, owner = live[going], times[going, -1], owner[going]
    levels = np.floor(1 - np.log(lowest) / _LOG_BASE)
    return np.clip(levels, 0, LIMIT).astype(np.uint16).reshape(rows, REGISTERS)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_rows(similarity: float) -> int:
    """The most registers a band can have while two sets of this similarity share no band with probability under MISS."""
    for rows in (8, 6, 5, 4, 3, 2):
        if (1 - similarity**rows) ** (REGISTERS // rows) < MISS:
            return rows
    return 1


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each row and band of ``rows`` register values."""
    bands = REGISTERS // rows
    parts = registers.reshape(len(registers), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(registers), bands))
    for j in range(rows):
        key = mix(key + parts[:, :, j] * U(0xD6E8FEB86659FD93) + U(j))
    return key.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of row pairs from both sketches jointly and the set sizes.

    The counts of registers that are larger in a, larger in b and equal follow a
    multinomial law in the similarity; its logarithm is maximized over a grid.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / np.maximum(n_a + n_b, 1)
    v = 1 - u
    top = np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)
    best, where = np.full(len(u), -np.inf), np.zeros(len(u))

    def larger(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / _LOG_BASE, 1e-12, 1)

    for part in np.linspace(0, 1, 101):
        j = part * top
        p, q = larger(u - v * j), larger(v - u * j)
        value = more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))
        better = value > best
        best, where = np.where(better, value, best), np.where(better, j, where)
    return where
