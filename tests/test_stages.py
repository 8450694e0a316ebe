"""Stage versions, the pruned refresh and the loess decomposition."""

import glob
import os
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.operators import loess
from demandspark.sources import stages
from demandspark.streaming import refresh

DAY = date(2020, 1, 1)


def test_a_broken_write_leaves_the_former_version(spark, tmp_path):
    base = str(tmp_path / "stages")
    stages.write_stage(spark.range(5), base, "t")
    old = stages.read_stage(spark, base, "t")
    broken = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        stages.write_stage(broken, base, "t")
    assert stages.stage_exists(spark, base, "t") and stages.read_stage(spark, base, "t").count() == 5
    stages.write_stage(spark.range(7), base, "t")
    assert stages.read_stage(spark, base, "t").count() == 7
    # whoever read the version before still can, until the write after next
    assert old.count() == 5
    stages.write_stage(spark.range(8), base, "t")
    versions = [os.path.basename(p) for p in glob.glob(f"{base}/t/version-*")]
    assert len(versions) == 2 and stages.current_version(spark, base, "t").rsplit("/", 1)[1] in versions
    assert not glob.glob(f"{base}/t/_current-*")


def test_a_table_may_be_rewritten_from_itself(spark, tmp_path):
    base = str(tmp_path / "stages")
    stages.write_stage(spark.range(3), base, "t")
    for n in range(3):
        stages.write_stage(stages.read_stage(spark, base, "t").selectExpr("id + 1 AS id"), base, "t")
    assert sorted(r.id for r in stages.read_stage(spark, base, "t").collect()) == [3, 4, 5]
    with pytest.raises(FileNotFoundError):
        stages.read_stage(spark, base, "missing")


def test_months_of_a_version_are_pruned(spark, tmp_path):
    base = str(tmp_path / "stages")
    rows = [(DAY + timedelta(days=i), float(i)) for i in range(90)]
    stages.write_stage(spark.createDataFrame(rows, "date date, v double"), base, "facts", "date")
    some = stages.read_stage(spark, base, "facts", first=date(2020, 2, 10), last=date(2020, 2, 20))
    assert some.count() == 11 and some.columns == ["date", "v"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year_month" in plan


def test_refresh_reads_only_the_months_touched(spark, tmp_path):
    source, target = str(tmp_path / "sales"), str(tmp_path / "daily")
    rows = [(DAY + timedelta(days=i), "P1", "S1", float(i), 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "date date, product_id string, store_id string, sales_quantity double, unit_price double")
    df.withColumn("year_month", F.date_format("date", "yyyy-MM")).write.partitionBy("year_month").parquet(source)
    refresh.refresh_months(df, spark.read.parquet(source), target)
    whole = spark.read.parquet(source)
    # January cannot be read any more; February can still be refreshed
    for file in glob.glob(f"{source}/year_month=2020-01/*.parquet"):
        with open(file, "wb") as out:
            out.write(b"not parquet")
    refresh.refresh_months(df.filter("date = '2020-02-05'"), whole, target)
    refresh.refresh_months(df.limit(0), whole, target)
    got = {r.date: r.total_sales for r in refresh.read_daily(spark, target).collect()}
    assert got == {d: q for d, _, _, q, _ in rows}


def plain_loess(y, span):
    n, out = len(y), []
    for i in range(n):
        near = sorted(range(n), key=lambda j: (abs(j - i), j))[: min(span, n)]
        lo = min(max(i - span // 2, 0), max(n - span, 0))
        near = list(range(lo, min(lo + span, n)))
        reach = max(i - near[0], near[-1] - i) + (max(span - n, 0)) // 2
        w = [(1 - (abs(j - i) / reach) ** 3) ** 3 if 0 < abs(j - i) <= 0.999 * reach else float(abs(j - i) == 0) for j in near]
        a = np.sqrt(np.array(w))[:, None] * np.column_stack([np.ones(len(near)), np.array(near) - i])
        out.append(np.linalg.lstsq(a, np.sqrt(np.array(w)) * y[near], rcond=None)[0][0])
    return np.array(out)


def plain_stl(y, period, trend_span):
    n, trend = len(y), np.zeros(len(y))
    for _ in range(2):
        left = y - trend
        means = [left[[i for i in range(n) if i % period == k]].mean() for k in range(period)]
        cycle = np.array([means[i % period] for i in range(-period, n + period)])
        low = cycle
        for width in (period, period, 3):
            low = np.array([low[i: i + width].mean() for i in range(len(low) - width + 1)])
        seasonal = cycle[period: period + n] - plain_loess(low, period)
        trend = plain_loess(y - seasonal, trend_span)
    return trend, np.array([seasonal[[j for j in range(n) if j % period == i % period]].mean() for i in range(n)])


@pytest.mark.parametrize("n", [14, 15, 40, 200])
def test_loess_equals_a_written_out_version(n):
    rng = np.random.default_rng(n)
    y = 50 + 0.1 * np.arange(n) + 8 * np.sin(2 * np.pi * np.arange(n) / 7) + rng.normal(0, 1, n)
    trend, seasonal = loess.stl(y, 7)
    want = plain_stl(y, 7, 11 if n > 15 else loess._odd(1.5 * 7 / (1 - 1.5 / (10 * n + 1))))
    assert np.allclose(trend, want[0], atol=1e-8) and np.allclose(seasonal, want[1], atol=1e-8)


def test_loess_per_series(spark):
    rng = np.random.default_rng(1)
    season = np.array([3, -1, -2, 0, 4, -3, -1], float)
    wave = 100 + 0.3 * np.arange(210) + season[np.arange(210) % 7] + rng.normal(0, 0.1, 210)
    rows = [("wave", DAY + timedelta(days=i), float(v)) for i, v in enumerate(wave)] + [("short", DAY + timedelta(days=i), 2.0 * i) for i in range(5)]
    rows += [("short", DAY + timedelta(days=9), None)]
    df = spark.createDataFrame(rows, "k string, date date, total_sales double")
    got = loess.decompose_loess(df, keys=("k",)).orderBy("k", "date").collect()
    assert len(got) == 215 and all(abs(r.observed - r.trend - r.seasonal - r.remainder) < 1e-9 for r in got)
    own = [r for r in got if r.k == "wave"]
    assert np.allclose([r.seasonal for r in own[:7]], season, atol=0.15) and abs(own[100].trend - (100 + 30)) < 0.3
    assert {(r.trend, r.seasonal) for r in got if r.k == "short"} == {(4.0, 0.0)}
    with pytest.raises(Exception, match="do not identify a row"):
        loess.decompose_loess(df.unionByName(df.limit(1)), keys=("k",)).collect()
    assert loess.decompose_loess(df.limit(0), keys=("k",)).count() == 0
