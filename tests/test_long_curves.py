"""Curves cut into many tasks give the peaks of whole ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanlake.operators import peaks as K
from scanlake.operators.series import baseline, noise_level


@pytest.fixture(scope="module")
def curves(spark):
    """Two long curves with peaks near and far, long quiet stretches, ties and a peak at either end; a short and a flat one."""
    rng = np.random.default_rng(6)
    rows = []
    for name, n in (("a", 6000), ("b", 3500)):
        t = np.arange(n) * 0.01
        y = rng.integers(0, 3, n).astype(float)
        for c in [0.02, t[-1], *np.sort(rng.random(70) * t[-1])]:
            y += np.round(rng.choice([80, 200, 900]) * np.exp(-0.5 * ((t - c) / rng.choice([0.03, 0.06, 0.1])) ** 2))
        y[n // 2 : n // 2 + 900] = 0.0
        rows += list(zip([name] * n, t.tolist(), y.tolist()))
    rows += [("short", 0.0, 1.0), ("short", 0.1, 5.0)] + [("flat", 0.1 * i, 4.0) for i in range(30)]
    return spark.createDataFrame(rows, "sample_id string, rt double, value double").repartition(5).persist()


def rounded(df):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("find,least", [(K.tic_peaks, 60), (K.chromatogram_peaks, 20), (lambda c, by, rows: K.xic_peaks(c, by, least_height=30.0, most_width=9.0, rows=rows), 20)])
def test_tasks_of_a_curve_give_its_peaks(curves, find, least):
    whole = rounded(find(curves, ["sample_id"], rows=10**9))
    assert len(whole) >= least
    assert rounded(find(curves, ["sample_id"], rows=400)) == whole


def test_a_long_curve_is_many_tasks(curves):
    x = baseline(curves, ["sample_id"])
    x = x.join(noise_level(x, ["sample_id"]), "sample_id").withColumn("n", F.lit(0))
    from pyspark.sql.types import IntegerType, StructField

    sizes = K.per_curve(x, ["sample_id"], F.col("body_corrected") <= F.col("noise_level"), F.lit(4), [StructField("n", IntegerType())], lambda part: [(len(part),)], 400).where("sample_id = 'a'").collect()
    assert len(sizes) > 8 and sum(r["n"] for r in sizes) == 6000 and max(r["n"] for r in sizes) < 1500
