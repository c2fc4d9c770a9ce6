"""The 32-bit feature hashes: vectorised over bytes in numpy, and as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def djb2(data: bytes, start: int = 5381) -> int:
    h = start
    for b in data:
        h = (h * 33 + b) & MASK
    return h


def djb2_joined(left: int, right_from_zero: int, right_length: int) -> int:
    """Hash of a concatenation from the hash of its left part and the hash from 0 of its right part."""
    return (left * pow(33, right_length, 1 << 32) + right_from_zero) & MASK


def sdbm(data: bytes) -> int:
    h = 0
    for b in data:
        h = (b + h * 65599) & MASK
    return h


def jenkins(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h + b) & MASK
        h = (h + (h << 10)) & MASK
        h ^= h >> 6
    h = (h + (h << 3)) & MASK
    h ^= h >> 11
    return (h + (h << 15)) & MASK


def rolling(data: np.ndarray, size: int, kind: str = "djb2") -> np.ndarray:
    """Hash of each run of ``size`` bytes, all runs at once (uint32)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    x = data.astype(np.uint32)
    h = np.full(n, 5381 if kind == "djb2" else 0, np.uint32)
    for j in range(size):
        b = x[j : j + n]
        if kind == "djb2":
            h = h * np.uint32(33) + b
        elif kind == "sdbm":
            h = h * np.uint32(65599) + b
        else:
            h = h + b
            h = h + (h << np.uint32(10))
            h ^= h >> np.uint32(6)
    if kind == "jenkins":
        h = h + (h << np.uint32(3))
        h ^= h >> np.uint32(11)
        h = h + (h << np.uint32(15))
    return h


ONE = {"djb2": djb2, "sdbm": sdbm, "jenkins": jenkins}
#: Multiplier and start of the polynomial hashes.
POLYNOMIAL = {"djb2": (33, 5381), "sdbm": (65599, 0)}


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint32), np.cumprod(np.full(n, base & MASK, np.uint32), dtype=np.uint32)])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, first: np.ndarray, kind: str = "djb2") -> np.ndarray:
    """Hash of the bytes of each run of ``size`` spans, all runs at once (uint32). first: of each run its first span."""
    if not len(first):
        return np.zeros(0, np.uint32)
    lengths = ends - starts
    if kind in POLYNOMIAL:
        base, start = POLYNOMIAL[kind]
        power, back = _powers(base, int(max(len(data), lengths.max() * size)) + 1), _powers(pow(base, -1, 1 << 32), len(data))
        run = np.concatenate([np.zeros(1, np.uint32), np.cumsum(data.astype(np.uint32) * back[:-1], dtype=np.uint32)])
        sums = (run[ends] - run[starts]) * power[ends] * back[1] if len(data) else np.zeros(len(starts), np.uint32)
        h = np.full(len(first), start, np.uint32)
        for j in range(size):
            h = h * power[lengths[first + j]] + sums[first + j]
        return h
    h = np.zeros(len(first), np.uint32)
    for j in range(size):
        span = first + j
        order = np.argsort(-lengths[span], kind="stable")
        sizes, at = lengths[span][order], starts[span][order]
        for i in range(int(sizes[0])):
            live = order[: np.searchsorted(-sizes, -i)]  # those longer than i
            x = h[live] + data[at[: len(live)] + i]
            x = x + (x << np.uint32(10))
            h[live] = x ^ (x >> np.uint32(6))
    h = h + (h << np.uint32(3))
    h ^= h >> np.uint32(11)
    return h + (h << np.uint32(15))


def byte_values(data: Column) -> Column:
    """array<bigint> of a binary column's unsigned bytes."""
    text = F.hex(data)
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1, F.lit(2)), lambda i: F.conv(F.substr(text, i, F.lit(2)), 16, 10).cast("bigint"))


def hash_column(data: Column, kind: str = "djb2") -> Column:
    """The hash of a binary column as bigint, without Python; for few or short values."""
    m = F.lit(MASK).cast("bigint")
    if kind == "djb2":
        step, start = (lambda h, b: (h * 33 + b).bitwiseAND(m)), 5381
    elif kind == "sdbm":
        step, start = (lambda h, b: (h * 65599 + b).bitwiseAND(m)), 0
    else:
        start = 0

        def step(h: Column, b: Column) -> Column:
            h = (h + b).bitwiseAND(m)
            h = (h + F.shiftleft(h, 10)).bitwiseAND(m)
            return h.bitwiseXOR(F.shiftright(h, 6))

    def finish(h: Column) -> Column:
        if kind != "jenkins":
            return h
        h = (h + F.shiftleft(h, 3)).bitwiseAND(m)
        h = h.bitwiseXOR(F.shiftright(h, 11))
        return (h + F.shiftleft(h, 15)).bitwiseAND(m)

    values = F.when(F.octet_length(data) > 0, byte_values(data)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(values, F.lit(start).cast("bigint"), step, finish)
