"""Numbers of symbols, and what the transform writes."""

import numpy as np
import pytest

from trustweave.llm import suffix_dedup


@pytest.mark.parametrize("bits", [16, 63])
def test_numbers_are_equal_where_values_are(bits):
    x = np.random.default_rng(0).integers(0, 1 << 14, 5000)
    got = suffix_dedup._numbered(x, bits)
    pairs = set(zip(x.tolist(), got.tolist(), strict=True))
    assert len(pairs) == len(set(x.tolist())) == len(set(got.tolist())) and 0 <= got.min() and got.max() < len(x)


def test_symbols_of_any_width():
    data = bytes(np.random.default_rng(1).integers(0, 2, 3000, dtype=np.uint8))
    for width in (1, 2, 4, 8, 20, 40):
        filled, got = data + b"\0" * width, suffix_dedup.symbols(data, width).tolist()
        own = [filled[i : i + width] for i in range(len(data))]
        assert len(set(own)) == len(set(got)) == len(set(zip(own, got, strict=True)))


def test_nothing_is_written_that_no_round_reads(tmp_path, monkeypatch):
    writes, put = [], suffix_dedup.External.__setitem__
    monkeypatch.setattr(suffix_dedup.External, "__setitem__", lambda self, name, values: (writes.append(name), put(self, name, values)))
    a = bytes(np.random.default_rng(2).integers(0, 256, 210, dtype=np.uint8))
    got = suffix_dedup.repeated_starts([a + b"x", b"y" + a], f"file://{tmp_path}")
    assert [g.tolist() for g in got] == [list(range(11)), list(range(1, 12))]
    assert writes.count("bwt") == writes.count("entries") == writes.count("lcp") - 1
