import random

import numpy as np
import pytest

from pairset.operators.quantiles import exact_median, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
TIGHT = dict(direct_rows=0, bracket_rows=20, accuracy=50)


@pytest.mark.parametrize("name, values", [
    ("distinct", [random.Random(1).gauss(0, 50) for _ in range(4001)]),
    ("a third equal", [7.0] * 1000 + [random.Random(2).uniform(0, 20) for _ in range(2000)]),
    ("few values", [float(i % 3) for i in range(1000)]),
    ("one", [5.0]),
    ("constant", [2.5] * 500),
    ("ties next to many values", [0.0] * 700 + [0.001 * i for i in range(1, 701)]),
    ("whole numbers", [float(random.Random(i).randrange(-40, 40)) for i in range(2500)]),
])
def test_narrowed_quantiles_are_exact(spark, name, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    want = np.quantile(values, PROBS)
    assert exact_quantiles(df, "v", PROBS, **TIGHT) == pytest.approx(list(want), rel=1e-12)
    assert exact_quantiles(df, "v", PROBS) == pytest.approx(list(want), rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_median(df, "v") is None
