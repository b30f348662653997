"""The matching of two trees is the largest one, whatever their size."""

from __future__ import annotations

import random

from cairnfield.llm import wrapper


def test_large_trees_are_matched_exactly():
    """Both lists of children have one label, so their sequence alone does not tell which pair holds most."""
    lists = lambda *sizes: (["r", *[x for tag, n in sizes for x in ["div", *[tag] * n]]], [0, *[x for _, n in sizes for x in [1, *[2] * n]]])
    (la, da), (lb, db) = lists(("p", 3), ("q", 2_500)), lists(("q", 2_500))
    assert len(wrapper.simple_tree_matching(la, da, lb, db)) == 2_502


def test_rows_of_arrays_match_as_loops_do(monkeypatch):
    rng = random.Random(5)

    def tree(most):
        labels, depths = ["r"], [0]
        for _ in range(rng.randint(1, most)):
            labels.append(rng.choice("abc"))
            depths.append(rng.randint(1, min(3, depths[-1] + 1)))
        return labels, depths

    for _ in range(200):
        a, b = tree(30), tree(30)
        made = []
        for cells in (0, 10**9):
            monkeypatch.setattr(wrapper, "LOOP_CELLS", cells)
            made.append(wrapper.simple_tree_matching(*a, *b))
        assert made[0] == made[1]


def test_long_flat_pages_are_matched():
    la, lb = ["r", *["p", "h2"] * 2_000], ["r", "h1", *["p", "h2"] * 2_000]
    assert len(wrapper.simple_tree_matching(la, [0, *[1] * 4_000], lb, [0, *[1] * 4_001])) == len(la)
