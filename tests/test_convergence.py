"""Iterative operators say so if they stop before they converge."""

import pytest

from proxweave.operators.community import label_propagation
from proxweave.operators.layout import harmonic_interpolate


def test_limits_are_reported(spark):
    ends = [(i, i + 1) for i in range(9)]
    e = spark.createDataFrame([(a, b, 1.0 + a) for a, b in ends], "src long, dst long, weight double")
    nodes = spark.range(10)
    with pytest.warns(RuntimeWarning, match="label propagation"):
        label_propagation(e, nodes, max_rounds=1)
    p = spark.createDataFrame([(a, b, 0.5) for x in ends for a, b in (x, x[::-1])], "src long, dst long, p double")
    known = spark.createDataFrame([(0, [0.0]), (9, [9.0])], "id long, y array<double>")
    with pytest.warns(RuntimeWarning, match="harmonic"):
        harmonic_interpolate(p, known, nodes, max_iter=1)
