"""Certified groups, and bins near the bound."""

import numpy as np
from helixframe.llm import packing


def pieces(spark, sizes):
    return spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(sizes)], packing.PIECES)


def test_certified_groups_keep_their_bins(spark):
    sizes = [2048] * 400  # every group of an even number of halves is full
    got = packing.packed_with_gap(pieces(spark, sizes), 4096, group=50, turns=3).collect()
    assert {r.gap for r in got} == {0}
    # of each of the 8 groups the least filled bin may go on, and no other
    assert sum(r.sequence_id >> 56 > 0 for r in got) <= 8
    assert len({r.sequence_id for r in got}) == 200


def test_groups_with_a_gap_exchange(spark):
    g = np.random.default_rng(8)
    sizes = g.integers(1300, 1500, 900)  # three fit a sequence if they are small enough
    rows = packing.packed_with_gap(pieces(spark, sizes), 4096, group=60, turns=4).collect()
    bound = packing.needed_bins(pieces(spark, sizes), 4096)
    assert bound <= len({r.sequence_id for r in rows}) and len(rows) == 900
    assert any(r.sequence_id >> 56 for r in rows)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096


def test_bins_are_within_a_hundredth_of_the_bound(spark, sf):
    from helixframe.llm import bpe  # noqa: F401
    from helixframe.llm.queries import op7_best_fit_packing

    got = op7_best_fit_packing(spark, sf).collect()
    bound = packing.lower_bound(np.array([r.length for r in got]), 4096)
    assert len({r.sequence_id for r in got}) <= bound * 1.01 + 1


def test_empty_table_has_no_bins(spark):
    assert packing.packed_with_gap(pieces(spark, []), 4096).count() == 0 and packing.needed_bins(pieces(spark, []), 4096) == 0
