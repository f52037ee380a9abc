import random

import duckdb
import pyarrow as pa
import pytest

from plumbline.operators.quantiles import exact_quantiles, group_quantile
from plumbline.plans.shapes import rounded


def test_groups_to_the_last_bit(spark):
    r = random.Random(5)
    rows = [(g, g % 3, round(r.uniform(-1, 3), 2)) for g in range(400) for _ in range(r.randint(1, 120))]
    rows += [(400, 1, None), (400, 1, None), (401, 2, 1.5), (401, 2, None), (402, 0, 1.23), (402, 0, 1.23), (403, 0, float("nan")), (403, 0, 1.0)]
    df = spark.createDataFrame(rows, "a long, b long, z double").repartition(5)
    got = {x.a: (x.b, x.q, x.n) for x in group_quantile(df, ["a", "b"], "z", 0.02, "q").collect()}
    t = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "z"])
    want = {a: (b, q, n) for a, b, q, n in duckdb.connect().register("t", t).execute("select a, b, quantile_cont(z, 0.02), count(*) from t group by 1, 2").fetchall()}
    assert repr(got.pop(403)) == repr(want.pop(403)) and got == want


def test_whole_column_to_the_last_bit(spark):
    r = random.Random(6)
    for n in (1, 2, 7, 38, 98):
        z = [round(r.uniform(0, 3), 2) for _ in range(n)]
        (want,) = duckdb.execute("select [quantile_cont(z, 0.02), quantile_cont(z, 0.37), quantile_cont(z, 0.5)] from (select unnest(?::double[]) as z)", [z]).fetchone()
        assert exact_quantiles(spark.createDataFrame([(x,) for x in z], "z double"), "z", [0.02, 0.37, 0.5]) == (n, want)


@pytest.mark.parametrize("sign", [1, -1])
def test_rounding_as_in_sql(spark, sign):
    r = random.Random(7)
    xs = [sign * x for x in [0.0, 1e-17, 1.3915375, 1.3915374999999999, 560.1234565, *(round(r.uniform(0, 300), 6) + 5e-7 for _ in range(3000))]]
    got = [x.y for x in spark.createDataFrame(list(enumerate(xs)), "i long, x double").select("i", rounded("x").alias("y")).orderBy("i").collect()]
    want = [y for (y,) in duckdb.execute("select round(x, 6) from (select unnest(?::double[]) as x)", [xs]).fetchall()]
    assert list(map(repr, got)) == list(map(repr, want))
