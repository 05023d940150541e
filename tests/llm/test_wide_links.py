"""Links of wide fingerprints: none within the radius is left out, whatever bytes the two share."""

from __future__ import annotations

import numpy as np
import pytest

from evispark.llm import simhash
from evispark.llm.common import components

RADIUS = 42


def planted(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of 256 bits, and those of copies that differ in a bit of every byte and ten more: they share no key."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (n, 32, 8), dtype=np.uint8)
    copies = base.copy()
    copies[np.arange(n)[:, None], np.arange(32), rng.integers(0, 8, (n, 32))] ^= 1
    flat = copies.reshape(n, 256)
    for row, own in zip(flat, base.reshape(n, 256)):
        row[rng.choice(np.nonzero(row == own)[0], RADIUS - 32, replace=False)] ^= 1
    return tuple(np.packbits(x.reshape(n, 256), axis=1, bitorder="little").view("<i8") for x in (base, copies))


def test_every_pair_of_copies_is_linked(spark):
    base, copies = planted(100)
    assert (np.bitwise_count((base ^ copies).view(np.uint64)).sum(1) == RADIUS).all()
    rows = [(tuple(map(int, f)),) for f in np.concatenate([base, copies])]
    points = spark.createDataFrame(rows, "fp struct<w0: long, w1: long, w2: long, w3: long>")
    for shard in (None, 60):
        roots = {tuple(r[0]): tuple(r[1]) for r in components(simhash.links(points, len(rows), RADIUS, shard)).collect()}
        assert all(roots[a[0]] == roots[b[0]] for a, b in zip(rows[:100], rows[100:])) and len(set(roots.values())) == 100


@pytest.mark.parametrize("group", [0, 3000])
def test_blocks_find_what_comparing_all_finds(group):
    """Parts too large to compare all pairs; with ``group``, most of them are near copies of one."""
    rng = np.random.default_rng(5)
    own = rng.integers(0, 2, 256, dtype=np.uint8) ^ (rng.random((group, 256)) < 0.07)
    fps = np.concatenate([*planted(2600), np.packbits(own.astype(np.uint8), axis=1, bitorder="little").view("<i8").reshape(group, 4)])
    fps = fps[rng.permutation(len(fps))]
    part = np.arange(len(fps)) % 2
    assert min((part == 0).sum(), (part == 1).sum()) > simhash.FEW
    up = simhash.Joined(len(fps))
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        up.link(*simhash.wide_forest(fps, part, lo, hi, RADIUS))
    want = simhash.Joined(len(fps))
    for a in range(0, len(fps), 200):
        u = fps.view(np.uint64)
        near = np.nonzero(np.bitwise_count(u[a : a + 200, None] ^ u[None]).sum(2, dtype=np.int64) <= RADIUS)
        want.link(near[0] + a, near[1])
    assert (up.root == want.root).all()


def test_allowances_cover_the_radius():
    for radius in (0, 4, 15, 16, 42, 43, 100):
        assert sum(a + 1 for a in simhash.allowances(radius, 16)) == radius + 1
