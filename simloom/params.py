"""Parameters of fingerprinting and comparison, with the presets of each execution style."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    shred_size: int = 4
    window_size: int = 1
    fp_bits: int = 1 << 18
    threshold: float = 0.6
    max_set_ratio: float | None = 0.7
    hashes: tuple[str, ...] = ("djb2",)

    def __post_init__(self) -> None:
        if self.shred_size < 1 or self.window_size < 1:
            raise ValueError("shred_size and window_size are at least 1")
        if self.fp_bits < 8 or self.fp_bits & (self.fp_bits - 1):
            raise ValueError("fp_bits is a power of two, 8 at least")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold is between 0 and 1")


PRESETS = {
    "single": Params(),
    "single_text": Params(shred_size=1),
    "steps": Params(),
    "openmp": Params(16, 12, threshold=0.7, max_set_ratio=None),
    "hadoop": Params(16, 12, threshold=0.5, max_set_ratio=None),
    "cc": Params(fp_bits=1 << 24, max_set_ratio=None),
    "cc_hadoop": Params(16, 12, max_set_ratio=None),
}
