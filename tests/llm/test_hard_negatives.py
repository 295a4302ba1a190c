"""Hard negatives against a brute force in plain whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import hard_negatives
from gleaner.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, anchor string, block long, score double"


def brute(rows, is_anchor, positives=5, negatives=5, low=80):
    usable = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        if sum((abs(256 * c) + 1) * (abs(256 * c) + 1) for c in x) > 2.0**61:
            continue
        usable.append((i, [math.floor(256 * c) for c in x], label))
    out = []
    for k, (i, x, label) in enumerate(usable):
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j, other) for n, (j, y, other) in enumerate(usable) if n != k and len(y) == len(x)]
        own = sorted((s, j) for s, j, other in scored if other == label)[:positives]
        for s, j in own:
            fitting = sorted((t, n) for t, n, other in scored if other != label and low * -s <= 100 * -t <= 100 * -s)[:negatives]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fitting, 1)]
    return sorted(out)


def result(spark, rows, **more):
    df = spark.createDataFrame([(i, x, label, "x", 1, "y", 2, 0.5) for i, x, label in rows], SCHEMA).repartition(3)
    return sorted(
        tuple(r)
        for r in mine(df, F.col("vec_id") % 10 == 0, **more).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
        ).collect()
    )


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    out = [(i, (base[i % 6] + 0.4 * rng.normal(size=8)).tolist(), int(rng.integers(3))) for i in range(300)]
    out += [(1000 + i, base[0].tolist(), i % 2) for i in range(120)]  # equal rows: ties everywhere
    out += [(20, out[20][1], out[20][2]), (20, out[20][1], out[20][2]), (20, base[3].tolist(), 1), (30, out[31][1], 0)]  # repeated ids and rows
    out += [
        (None, out[1][1], 1), (2000, None, 1), (2010, [math.nan] * 8, 1), (2020, [math.inf] + [0.0] * 7, 1), (2030, [None] + [1.0] * 7, 1),
        (2040, [1.0] * 8, None),
    ]
    out += [
        (3000, [1.0, 2.0], 0), (3001, [1.0, 1.5], 1), (3002, [2.0, 2.0], 0), (3010, [], 0), (3011, [], 1), (3012, [], 0),
        (3020, [0.0] * 8, 0), (-10, [-0.1] * 8, 2),
    ]
    return out


def test_brute_force(spark, rows):
    expected = brute(rows, lambda i: i % 10 == 0)
    assert result(spark, rows) == expected and len(expected) > 200


def test_small_blocks(spark, rows, monkeypatch):
    """Results don't depend on how rows and anchors are cut."""
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    few = [r for k, r in enumerate(rows) if k % 3 == 0 or k > 400]
    assert result(spark, few, positives=3, negatives=7, low=50) == brute(few, lambda i: i % 10 == 0, 3, 7, 50)


def test_large_components(spark):
    """Products beyond what floating point holds are whole all the same; rows whose scores could leave 64 bits take no part."""
    rows = [
        (0, [2.0**21 + 0.5, 3.0], 0), (1, [2.0**21, 1.0], 0), (2, [2.0**21 - 1 / 256, 7.0], 1), (3, [2.0**21 - 2 / 256, 7.0], 1),
        (4, [1e300, 0.0], 1), (10, [1e25, 1.0], 0),
    ]
    got = result(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and [r[3] for r in got] == [2, 3]


def test_empty(spark):
    assert result(spark, []) == []
    assert result(spark, [(1, [1.0], 0)]) == []
    assert result(spark, [(0, [1.0], 0)]) == []
    assert result(spark, [(0, [1.0], 0), (1, [1.0], 1)]) == []
