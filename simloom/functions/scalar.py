"""Scalar helpers: code lengths, names, and number formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_star(n: float) -> int:
    """How often log2 is taken until the value is 1 or less."""
    count = 0
    while n > 1:
        n, count = math.log2(n), count + 1
    return count


def entropy_bits(n1: float, n0: float) -> float:
    """Code length of n1 ones and n0 zeros; 0 if either is missing."""
    if n1 <= 0 or n0 <= 0:
        return 0.0
    n = n1 + n0
    return n1 * math.log2(n / n1) + n0 * math.log2(n / n0)


def short_name(path: Column) -> Column:
    """Last path component, 32 characters at most."""
    return F.substring(F.element_at(F.split(path, "/"), -1), 1, 32)


def field(line: Column, i: int, sep: str = ":") -> Column:
    return F.try_element_at(F.split(line, sep), F.lit(i + 1))


def int_list(text: Column) -> Column:
    """Integers of a comma-separated list."""
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))


def similarity_text(sim: Column, style: str = "steps") -> Column:
    """Six places, three places, or up to six without trailing zeros."""
    if style == "steps":
        return F.format_string("%.6f", sim)
    if style == "openmp":
        return F.format_string("%.3f", sim)
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", sim), "0+$", ""), r"\.$", "")


def threshold_name(t: float, style: str = "single") -> str:
    return f"cdb_{int(t * 100):03d}" if style == "openmp" else f"cdb_{t:0.3f}" + (".txt" if style == "single" else "")
