"""Entropy levels cost a few passes over the bytes, and pieces of the text meet without a seam."""

import time

import numpy as np

from costlens.llm import fingerprint


def _seconds(job):
    def once():
        start = time.process_time()
        job()
        return time.process_time() - start

    return min(once() for _ in range(3))


def test_entropy_levels_cost():
    words = np.random.default_rng(3).choice([b"the ", b"cost ", b"of ", b"a ", b"model ", b"request ", b"is ", b"told\n"], 230_000)
    data = np.frombuffer(b"".join(words.tolist()), np.uint8)[:1_000_000]
    yardstick = _seconds(lambda: sum(i * i for i in range(1_000_000)))
    assert _seconds(lambda: fingerprint.entropy_levels(data)) < 3 * yardstick


def test_entropy_levels_across_pieces(monkeypatch):
    data = np.random.default_rng(4).integers(97, 103, 1000, dtype=np.uint8)
    whole = fingerprint.entropy_levels(data)
    for size in (1, 63, 64, 100):
        monkeypatch.setattr(fingerprint, "_PIECE", size)
        assert (fingerprint.entropy_levels(data) == whole).all()
    for at in (0, 500, len(whole) - 1):
        share = np.bincount(data[at:at + 64]) / 64
        share = share[share > 0]
        assert abs(whole[at] - -(share * np.log2(share)).sum() / 6 * 1000) < 0.51
