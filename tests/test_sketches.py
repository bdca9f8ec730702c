import random

from pyspark.sql import functions as F

from siltwork.operators import sketches


def test_merged_sketches_keep_their_bounds(spark):
    rng = random.Random(7)
    values = [(k % 9 if k % 11 else None, rng.choice([rng.gauss(0, 1), float(rng.randrange(50)), None]), float(k % 300)) for k in range(30000)]
    df = spark.createDataFrame(values, "day int, x double, y double").repartition(6)
    parts = sketches.sketch(df, ["x", "y"], ["day"])
    assert parts.count() == 20
    found = {r.column: r for r in sketches.told(sketches.merge(parts), [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    for c, at in (("x", 1), ("y", 2)):
        own = sorted(v[at] for v in values if v[at] is not None)
        r = found[c]
        assert (r.rows, r.missing, r.least, r.greatest) == (30000, 30000 - len(own), own[0], own[-1])
        assert abs(r.distinct - len(set(own))) <= sketches.DISTINCT_ERROR * len(set(own))
        for p, q in zip([0.0, 0.1, 0.5, 0.9, 1.0], r.quantiles):
            below, upto = sum(v < q for v in own) / len(own), sum(v <= q for v in own) / len(own)
            assert below - sketches.RANK_ERROR <= p <= upto + sketches.RANK_ERROR
    by_half = sketches.merge(parts.withColumn("half", F.col("day") < 5), ["half"])
    assert by_half.count() == 6 and by_half.agg(F.sum("rows")).first()[0] == 60000
    whole = {r.column: r for r in sketches.told(sketches.sketch(df, ["x", "y"]), [0.5]).collect()}
    assert abs(whole["x"].distinct - found["x"].distinct) <= sketches.DISTINCT_ERROR * found["x"].distinct


def test_columns_without_numbers(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, None)], "day int, x double")
    r = sketches.told(sketches.merge(sketches.sketch(df, ["x"], ["day"])), [0.5]).first()
    assert (r.rows, r.missing, r.least, r.quantiles) == (3, 3, None, None)
    assert sketches.merge(sketches.sketch(df.limit(0), ["x"], ["day"])).count() == 0
