"""Cells of the upper levels: no pair lost, far cells never met."""

from collections import Counter

import numpy as np
from helixframe.llm import cover_tree


def brute(x, labels, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = (u @ u.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(c, False)
    root = np.arange(len(x))
    while True:
        near = np.where(c, root[None, :], len(x)).min(1)
        after = np.minimum(root, near)
        if (after == root).all():
            return c.sum(1), root
        root = after


def test_cells_lose_no_link(spark):
    g = np.random.default_rng(4)
    centres = g.normal(size=(12, 16))
    x = centres[g.integers(0, 12, 900)] + 0.25 * g.normal(size=(900, 16))
    x[100:400] = x[0] + 0.02 * g.normal(size=(300, 16))
    x[400:450] = x[0]
    labels = np.where(np.arange(900) < 700, 0, 1)
    rows = [(k, x[k].tolist(), f"name {labels[k]}") for k in range(900)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)
    n, root = brute(x, labels, 0.93)
    for block in (40, 300):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(d, 0.93, block).collect()}
        assert all(got[k] == (n[k], root[k], root[k] == k) for k in range(900)), block


def test_far_cells_share_no_unit(spark):
    g = np.random.default_rng(5)
    x = np.repeat(np.eye(8), 50, axis=0) + 0.01 * g.normal(size=(400, 8))
    points = spark.createDataFrame([("a", x[k].tolist(), k, 1, 8) for k in range(400)], "label string, v array<double>, id long, weight long, dim int")
    cells, pairs = cover_tree._cells(points, float(np.sqrt(2 - 2 * 0.93)), 50)
    assert cells.count() == 400
    met = Counter((r.a == r.b) for r in pairs.collect())
    assert met[True] == 8 and met[False] == 0


def test_repeated_ids_and_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(7, a, 1), (7, b, 1), (9, b, 1), (9, b, 1), (4, a, None), (None, a, 1), (11, [0.0, 1.0, -0.0], 1), (12, None, 1), (13, [float("inf"), 0.0, 0.0], 1)]
    got = sorted((tuple(r) for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=repr)
    want = [(7, 0, 7, True), (7, 3, 7, True), (9, 3, 7, False), (9, 3, 7, False), (11, 3, 7, False), (4, 0, 4, True), (None, 0, None, False), (12, 0, 12, True), (13, 0, 13, True)]
    assert got == sorted(want, key=repr)


def test_trees_are_walked_in_large_blocks(spark):
    """3,600 points of a label, more pairs than are compared at once."""
    g = np.random.default_rng(9)
    centres = g.normal(size=(60, 24))
    x = centres[g.integers(0, 60, 4200)] + 0.3 * g.normal(size=(4200, 24))
    x[500:900] = x[3] + 0.01 * g.normal(size=(400, 24))
    x[900:1000] = x[3]
    labels = np.where(np.arange(4200) < 3600, 0, 1)
    d = spark.createDataFrame([(k, x[k].tolist(), int(labels[k])) for k in range(4200)], "vec_id long, embedding array<double>, label int").repartition(4)
    n, root = brute(x, labels, 0.93)
    walked = []
    tree = cover_tree.CoverTree(x[:3600] / np.linalg.norm(x[:3600], axis=1, keepdims=True))
    for i, j in cover_tree.linked(tree, tree, 0.93, True):
        walked.append(len(i))
    assert len(walked) > 50 and sum(walked) == n[:3600].sum() // 2
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(d, 0.93).collect()}
    assert all(got[k] == (n[k], root[k], root[k] == k) for k in range(4200))
