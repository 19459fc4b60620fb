"""Overlaps that come from a leader's answers, against full intersections."""

import numpy as np
import pytest

from lexloom.llm import jaccard


def group(seed: int, g: int, size: int, shared: float) -> list[np.ndarray]:
    """A leader and followers that keep from nearly all to nearly none of it, with elements beyond it that some share."""
    rng = np.random.default_rng(seed)
    own = np.unique(rng.integers(1, 1 << 60, size, dtype=np.uint64))
    beyond = np.unique(rng.integers(1, 1 << 60, size, dtype=np.uint64))
    sets = [own]
    for _ in range(g - 1):
        share = rng.choice([shared, 0.9, 0.6, 0.3, 0.02])
        mine = own[rng.random(len(own)) < share]
        others = beyond[rng.random(len(beyond)) < rng.choice([0.0, 0.05, 0.3])]
        alone = rng.integers(1, 1 << 60, 2, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([mine, others, alone])))
    return sets


def parts(sets: list[np.ndarray], leader: int):
    own, n = sets[leader], np.array([len(x) for x in sets])
    values = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, values), len(own) - 1).astype(np.int32)
    inside = own[at] == values
    overlap = np.add.reduceat(inside.astype(np.int32), np.concatenate([[0], np.cumsum(n)])[:-1])
    return n, jaccard.differences(values, np.repeat(np.arange(len(sets), dtype=np.int32), n), at, inside, overlap, len(own))


@pytest.mark.parametrize("seed,g,size,shared", [(1, 12, 40, 0.95), (2, 30, 200, 0.85), (3, 5, 1, 1.0), (4, 40, 3, 0.7), (5, 25, 500, 0.99)])
def test_derived_overlaps_are_full_intersections(seed, g, size, shared):
    sets = group(seed, g, size, shared)
    for leader in (0, g // 2, g - 1):
        _, (lacking, kept, columns, row, sign) = parts(sets, leader)
        table = np.zeros((g, int(columns.max()) + 1 if len(columns) else 0))
        table[row, columns] = sign
        found = jaccard.from_leader(lacking, kept, lacking, kept, len(sets[leader])) + table @ table.T
        for i in range(g):
            for j in range(g):
                if i != j:
                    assert found[i, j] == len(np.intersect1d(sets[i], sets[j])), (leader, i, j)


def test_near_copies_leave_only_their_differences():
    own = np.arange(1, 10_001, dtype=np.uint64)
    sets = [own] + [np.delete(own, [i, i + 1]) for i in range(50)]
    _, (lacking, kept, columns, _, _) = parts(sets, 0)
    assert lacking[1:].all() and (kept[1:] == 2).all()
    assert len(columns) == 98 and len(np.unique(columns)) == 49  # the two places that one set alone lacks are left out


@pytest.mark.parametrize("seed", range(6))
def test_links_join_what_is_similar(seed):
    rng = np.random.default_rng(seed)
    sets = group(seed, 60, 80, 0.93)
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) < 0.97], rng.integers(1, 1 << 60, 1, dtype=np.uint64)])) for s in sets[1:20]]
    nodes = np.arange(len(sets)) * 3
    for leader in (0, 7):
        parent = list(range(len(sets)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
        want = [root(i) for i in range(len(sets))]
        label = list(range(len(sets)))
        for a, b in jaccard.group_links(nodes, sets, leader, tile=7, width=16):
            label[b // 3] = a // 3
        assert label == want
