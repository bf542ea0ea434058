"""Clusters of crowded m/z: what is folded does not grow with the points."""

from pyspark.sql import functions as F

from scanlake.operators import match as M


def test_points_of_one_mz_are_one_row(spark, monkeypatch):
    """Many points on 40 m/z without a gap: the same clusters as of a point per m/z and scan, from 40 rows."""
    folded = []
    pieces = M.in_pieces

    def counted(df, *rest):
        folded.append(df.count())
        return pieces(df, *rest)

    monkeypatch.setattr(M, "in_pieces", counted)
    x = spark.range(40).select((500 + F.col("id") / 256).alias("mz"), (F.col("id") % 5 + 1).cast("double").alias("intensity"), F.concat(F.lit("s"), F.col("id") % 3).alias("scan_id"))
    many = x.crossJoin(spark.range(50).select(F.col("id").alias("k")))
    plain = lambda df, n: sorted((round(r[0], 9), r[1] / n, *r[2:]) for r in df.collect())
    want = plain(M.clusters(x, [], 20.0, piece_rows=15), 1)
    assert plain(M.clusters(many.drop("k"), [], 20.0, piece_rows=15), 50) == want and len(want) > 5
    assert folded == [40, 40]
