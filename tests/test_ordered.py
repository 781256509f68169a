"""Running totals and trailing counts against plain loops, with a key that holds most rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from sparkloom import shared
from sparkloom.operators import ordered


def test_running_totals(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.randint(0, 40), rnd.choice([1, 2, None, -3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, v int, i int").repartition(6)
    got = ordered.running(df, ["k"], ["o", "i"], {"n": F.lit(1), "s": F.col("v")}).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    want = {}
    for k, own in groups.items():
        n = s = 0
        for r in sorted(own, key=lambda r: (r[1], r[3])):
            n, s = n + 1, s + (r[2] or 0)
            want[r[3]] = (k, n, s, len(own), sum(x[2] or 0 for x in own))
    assert {r.i: (r.k, r.n, r.s, r.n_total, r.s_total) for r in got} == want and len(got) == len(rows)


def test_equal_rows_are_dealt_out(spark):
    df = spark.range(5000).select(F.lit(None).cast("string").alias("k"), F.lit(1).alias("o"))
    got = ordered.running(df, ["k"], ["o"], {"n": F.lit(1)})
    assert sorted(r.n for r in got.collect()) == list(range(1, 5001))
    assert ordered.running(df.limit(0), ["k"], ["o"], {"n": F.lit(1)}).count() == 0


def test_cleanup(spark):
    shared.stored(spark.range(3), "some")
    assert shared.cleanup(spark) >= 1 and shared.cleanup(spark) == 0
