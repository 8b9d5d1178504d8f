"""Long texts cut into pieces."""

import random

import numpy as np
import pytest

from tidemark.llm import anchors, bwt_dedup


@pytest.mark.parametrize("extra", [0, 1, 99, 100, 101, 102, 500])
def test_windows_belong_to_one_piece(extra, monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 400)
    text = np.frombuffer(random.Random(extra).randbytes(700 + extra), np.uint8)
    got = anchors.blocks(text, np.array([0, len(text)]), 100, 28)
    places = np.concatenate([np.arange(a, a + n) for a, n in zip(got.start, got.n, strict=True)])
    assert sorted(places.tolist()) == list(range(len(text) - 99))


def test_a_place_does_not_repeat_itself():
    """The same place may come in two blocks."""
    r = random.Random(5)
    text = bytes(r.choice(b"abcdefghij") for _ in range(300))
    same = [text[:150], text[:150], text[50:200]]
    found = bwt_dedup.repeated_windows(same, np.array([1, 1, 1]), np.array([0, 0, 50]), 100)
    assert found.shape == (2, 0)
    found = bwt_dedup.repeated_windows([text[:150], text[:150]], np.array([1, 2]), np.array([0, 7]), 100)
    assert sorted(map(tuple, found.T.tolist())) == [(k, 1) for k in range(51)]
