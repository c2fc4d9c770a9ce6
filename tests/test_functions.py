import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from simloom.functions import hashing as h
from simloom.functions.scalar import entropy_bits, log_star, threshold_name
from simloom.operators import fingerprint as fp
from simloom.operators.cocluster import best_groups, code_lengths, description_cost, permutation
from simloom.params import Params
from simloom.sources.readers import code_sections, file_offset, pe_sections, robust_sections


def test_hash_vectors():
    assert h.djb2(b"abcd") == 2090069583
    assert h.djb2(b"\xff\x80") == ((5381 * 33 + 255) * 33 + 128) & h.MASK
    for kind, one in h.ONE.items():
        data = bytes(random.Random(1).randrange(256) for _ in range(50))
        assert h.rolling(np.frombuffer(data, np.uint8), 5, kind).tolist() == [one(data[i : i + 5]) for i in range(46)]
    assert h.djb2_joined(h.djb2(b"ab"), h.djb2(b"cd", 0), 2) == h.djb2(b"abcd")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=30), st.integers(1, 8))
def test_winnow_is_rightmost_minimum(values, w):
    x = np.array(values, np.uint32)
    want = {max(i + j for j in range(w) if values[i + j] == min(values[i : i + w])) for i in range(len(values) - w + 1)}
    assert set(fp.winnow(x, w).tolist()) == want


def test_lines():
    pieces = lambda x: [x[a:z] for a, z in zip(*fp.text_spans(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[:2])]
    assert pieces(b"a\nb") == [b"a\n", b"b"] and pieces(b"a\n") == [b"a\n"] and pieces(b"") == []
    assert [len(x) for x in pieces(b"x" * 20000)] == [8190, 8190, 3620]
    assert pieces(b"ab\0cd\n") == [b"ab"]
    assert [len(x) for x in fp.text_shreds([b"a\nb\n", b"", b"a\nb\nc"], 3)] == [0, 0, 1]


def test_params_and_scalars():
    for bad in ({"shred_size": 0}, {"fp_bits": 100}, {"threshold": 1.5}):
        with pytest.raises(ValueError):
            Params(**bad)
    assert [log_star(x) for x in (1, 2, 4, 16, 17)] == [0, 1, 2, 3, 4]
    assert entropy_bits(4, 4) == 8 and entropy_bits(0, 9) == 0
    assert threshold_name(0.6) == "cdb_0.600.txt" and threshold_name(0.55, "openmp").startswith("cdb_05")


def image(entry: int, sections: list[tuple[bytes, int, int, bytes]]) -> bytes:
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HH", 0x14C, len(sections)) + b"\0" * 12 + struct.pack("<HH", 32, 0)
    head += (b"\0" * 16 + struct.pack("<I", entry)).ljust(32, b"\0")
    at, table, body = len(head) + 40 * len(sections), b"", b""
    for name, va, flags, data in sections:
        table += struct.pack("<8sIIII", name, len(data), va, len(data), at + len(body)) + b"\0" * 12 + struct.pack("<I", flags)
        body += data
    return head + table + body


def test_pe_sections():
    two = image(0x1004, [(b".data", 0x3000, 0x40, b"d" * 8), (b"own", 0x1000, 0x20, b"c" * 16), (b".text", 0x2000, 0x20, b"t" * 8)])
    assert [s["data"] for s in code_sections(two)] == [b"c" * 16]
    assert [s["name"] for s in code_sections(two, "entry_or_named")] == [".text", "own"]
    assert [s["name"] for s in code_sections(two, "named")] == [".text"]
    assert code_sections(image(0x3001, [(b".data", 0x3000, 0x40, b"d" * 8), (b"x", 0x3000, 0x20, b"c" * 8)])) == []
    for bad in (None, b"", b"MZ", b"hello" * 30, two[:100]):
        assert code_sections(bad) == []
    assert pe_sections(two)[0] == 0x1004


def test_block_decisions():
    g, own, other = np.array([[8, 0], [0, 8]]), np.array([2, 2]), np.array([4, 4])
    assert best_groups(np.array([0, 1]), np.array([[4, 0], [0, 4]]), g, own, other).tolist() == [0, 1]
    assert best_groups(np.array([1]), np.array([[4, 0]]), np.array([[8, 0], [4, 8]]), np.array([2, 3]), other).tolist() == [0]
    assert code_lengths(g, np.outer(own, other)).sum() == 0
    assert description_cost(g, own, other) > 0
    assert permutation(g, own, other)[0] == [0, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\n\0é"), max_size=30), max_size=4), st.integers(1, 3), st.sampled_from(["djb2", "sdbm", "jenkins"]))
def test_text_shreds_equal_plain_loops(texts, size, kind):
    want = []
    for t in texts:
        lines = [x for x in t.encode().split(b"\n")]
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        pieces = [x.split(b"\0", 1)[0] for x in lines]
        want.append([h.ONE[kind](b"".join(pieces[i : i + size])) for i in range(len(pieces) - size + 1)])
    assert [x.tolist() for x in fp.text_shreds([t.encode() for t in texts], size, kind)] == want


def wide_image(wide: bool) -> bytes:
    optional = 240 if wide else 224
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HH", 0x14C, 2) + b"\0" * 12 + struct.pack("<HH", optional, 0)
    body = struct.pack("<H", 0x20B if wide else 0x10B).ljust(16, b"\0") + struct.pack("<I", 0x1010)
    body = body.ljust(32, b"\0") + struct.pack("<II", 0x1000, 0x200) + b"\0" * 20 + struct.pack("<I", 0x300)
    table = b"".join(struct.pack("<8sIIII", name, vsize, va, raw, where) + b"\0" * 12 + struct.pack("<I", 0x20) for name, vsize, va, raw, where in ((b".text", 0, 0x1004, 0x150, 0x400), (b".more", 0x10, 0x2000, 0x900, 0x600)))
    return (head + body.ljust(optional, b"\0") + table).ljust(0x400, b"\0") + b"t" * 0x200 + b"m" * 0x100


@pytest.mark.parametrize("wide", [False, True])
def test_robust_headers(wide):
    data = wide_image(wide)
    entry, headers, sections = robust_sections(data)
    assert entry == 0x1010 and headers == 0x1000
    assert [(s["va"], s["vsize"], s["where"], s["raw"]) for s in sections] == [(0x1000, 0x1000, 0x400, 0x200), (0x2000, 0x1000, 0x600, 0x100)]
    assert file_offset(data, 0x20) == 0x20 and file_offset(data, 0x1010) == 0x410 and file_offset(data, 0x2100) is None and file_offset(data, 0x2010) == 0x610
    assert robust_sections(data[:200])[2] == robust_sections(b"")[2] == []
