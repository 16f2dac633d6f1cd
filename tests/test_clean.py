import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.dates import cf_date, cf_days, julian_day, month_from_name
from panelspark.operators import clean, skew, timeline


def panel(spark, rows, kind="date"):
    df = spark.createDataFrame(rows, "entity_id string, ts string, value double")
    return df.select("entity_id", F.col("ts").cast(kind).alias("ts"), "value")


def pchip(x, y, q):
    """Separate implementation with loops over knots."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    n = len(x)
    m = np.zeros(n)
    for i in range(1, n - 1):
        if d[i - 1] * d[i] > 0:
            a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (a + b) / (a / d[i - 1] + b / d[i])
    def end(h0, h1, d0, d1):
        e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(e) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(e) > 3 * abs(d0) else e
    if n == 2:
        m[:] = d[0]
    else:
        m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    k = min(max(np.searchsorted(x, q, side="right") - 1, 0), n - 2)
    t = (q - x[k]) / h[k]
    return ((1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * m[k]
            + t * t * (3 - 2 * t) * y[k + 1] + t * t * (t - 1) * h[k] * m[k + 1])


def test_month_calendar(spark):
    assert timeline.calendar(spark, "1948-01-01", "2020-01-01").count() == 865
    first = timeline.calendar(spark, "1948-01-02", "1948-03-31").orderBy("ts").collect()
    assert [r.ts for r in first] == [dt.date(1948, 2, 1), dt.date(1948, 3, 1)]


def test_dates(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2000-01-01 00:00:00' a, TIMESTAMP_NTZ '2000-01-01 18:00:00' b, DATE '2000-01-01' d,"
                   " 'GLDAS_NOAH025_M.A194801.021.nc4' n")
    r = df.select(julian_day(F.col("a")).alias("a"), julian_day(F.col("b")).alias("b"), cf_days(F.col("d")).alias("c"),
                  cf_date(cf_days(F.col("d"))).alias("d"), month_from_name(F.col("n")).alias("n")).first()
    assert (r.a, r.b, r.c) == (2451544.5, 2451545.25, 730121.0)
    assert r.d == dt.date(2000, 1, 1) and r.n == dt.date(1948, 1, 1)


@pytest.mark.parametrize("kind", ["date", "timestamp_ntz"])
def test_interpolation_equals_loop(spark, kind):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for e in range(6):
        n = [1, 2, 3, 40, 200, 400][e]
        days = np.sort(rng.choice(1500, n, replace=False))
        y = rng.normal(size=n).cumsum()
        dates = [dt.date(1990, 1, 1) + dt.timedelta(int(d)) for d in days]
        rows += [(str(e), str(d), float(v)) for d, v in zip(dates, y)]
        x = np.array([d.toordinal() for d in dates], float)
        for m in range(50):
            q = dt.date(1990 + m // 12, m % 12 + 1, 1)
            if n > 1 and dates[0] <= q <= dates[-1]:
                want[(str(e), q)] = pchip(x, y, q.toordinal())
    got = {(r.entity_id, r.ts): r.value for r in clean.interpolate(panel(spark, rows, kind)).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_interpolate_regular_equals_interpolate(spark):
    rows = [("a", f"2000-{m:02d}-01", float(v)) for m, v in ((1, 1), (2, 4), (5, 3), (6, 8), (11, 2))]
    p = panel(spark, rows)
    dense = timeline.densify(p, "1999-11-01", "2001-01-01")
    a = {r.ts: r.c for r in clean.interpolate_regular(dense, "c").collect()}
    b = {r.ts: r.value for r in clean.interpolate(p).collect()}
    assert {k: v for k, v in a.items() if v is not None}.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in b)


def test_gap_mask(spark):
    p = panel(spark, [("a", "2000-01-01", 1.0), ("a", "2003-01-01", 2.0)])
    got = {r.ts: r.value for r in clean.interpolate(p, gap_days=365, pad_days=90).collect()}
    hidden = [k for k, v in got.items() if v is None]
    assert len(got) == 37
    assert min(hidden) == dt.date(2000, 4, 1) and max(hidden) == dt.date(2002, 10, 1) and len(hidden) == 31
    assert clean.gaps(p, 365).first().gap_days == 1096
    # no padding hides the two readings of the gap as well
    bare = [r for r in clean.interpolate(p, gap_days=365, pad_days=0).collect() if r.value is not None]
    assert bare == []


def test_slot_edges_keep_at_most_four_readings(spark):
    rows = [("a", f"2000-01-{d:02d}", float(d)) for d in range(1, 31)] + [("a", "2000-02-03", 1.0)]
    edges = clean.slot_edges(panel(spark, rows)).groupBy("_slot").count().collect()
    assert sorted(r["count"] for r in edges) == [1, 4]


def test_outliers(spark):
    rows = [("a", f"2000-01-{d:02d}", 1.0) for d in range(1, 21)] + [("a", "2000-02-01", 100.0), ("b", "2000-01-01", 5.0)]
    got = {(r.entity_id, str(r.ts)): r.value for r in clean.remove_outliers(panel(spark, rows)).collect()}
    assert got[("a", "2000-02-01")] is None and got[("b", "2000-01-01")] == 5.0
    assert sum(v is not None for v in got.values()) == 21
    with pytest.raises(ValueError):
        clean.outlier_bounds(panel(spark, rows), 0)


def test_attach_spreads_hot_keys(spark):
    hot = spark.range(3000).selectExpr("'hot' k", "id v").unionByName(spark.range(50).selectExpr("cast(id as string) k", "id v"))
    per_key = hot.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    out = skew.attach(hot, per_key, "k", spread="v", hot_share=0.1, salts=7)
    assert out.count() == 3050
    assert out.filter("k = 'hot'").select("top").distinct().first().top == 2999


def test_qualification_bounds(spark):
    rows = [("a", f"2000-{m:02d}-15", 1.0) for m in range(1, 7)] + [("b", f"2000-{m:02d}-15", 1.0) for m in range(1, 5)]
    assert {r.entity_id for r in clean.qualifying(panel(spark, rows), "2000-01-01", "2000-07-01", 5).collect()} == {"a"}
    # the last month start is the end: only readings on that very day count
    counts = {r.entity_id: r.n_months for r in clean.month_counts(panel(spark, rows), "2000-01-10", "2000-06-20").collect()}
    assert counts == {"a": 4, "b": 3}


def test_clean_panel_is_the_composition(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e in range(8):
        for d in np.sort(rng.choice(3000, 20 + 40 * e, replace=False)):
            rows.append((str(e), str(dt.date(1990, 1, 1) + dt.timedelta(int(d))), float(rng.normal() + 9 * (rng.random() < 0.02))))
    p = panel(spark, rows)
    fused = clean.clean_panel(p, "1990-02-10", "1997-11-20", min_months=30)
    kept = clean.remove_outliers(p)
    steps = clean.interpolate(clean.qualifying(kept, "1990-02-10", "1997-11-20", 30), "month", 365, 90)
    a = sorted((r.entity_id, r.ts, r.value) for r in fused.collect() if r.value is not None)
    b = sorted((r.entity_id, r.ts, r.value) for r in steps.collect() if r.value is not None)
    assert len(a) > 100 and a == b


def test_same_result_for_one_partition(spark):
    rows = [(str(e), f"{1990 + i // 12}-{i % 12 + 1:02d}-{1 + e:02d}", float((i * 7 + e) % 11)) for e in range(5) for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, clean.interpolate(panel(spark, rows)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_despike(spark):
    rows = [("a", f"2000-{m:02d}-01", v) for m, v in enumerate([1.0, 1.1, 0.9, 50.0, 1.0, 1.2, 1.0], 1)]
    got = {r.ts.month: r.value for r in clean.despike(panel(spark, rows), 7).collect()}
    assert got[4] == 1.0 and got[2] == 1.1


def test_every_kth_time(spark):
    rows = [(e, f"2000-{m:02d}-01", 1.0) for e in "ab" for m in range(1, 8)]
    got = {r.ts.month for r in timeline.every_kth_time(panel(spark, rows), 3).collect()}
    assert got == {1, 4, 7}


def test_gaps_shorter_than_a_slot(spark):
    import datetime as dt
    days = [dt.date(2000, 1, 1), dt.date(2000, 1, 3), dt.date(2000, 1, 20), dt.date(2000, 1, 21), dt.date(2000, 3, 1)]
    panel = spark.createDataFrame([("a", d, 1.0) for d in days], "entity_id string, ts date, value double")
    got = {(r.gap_start, r.gap_days) for r in clean.gaps(panel, 10).collect()}
    assert got == {(days[1], 17), (days[3], 40)}
    assert clean.gaps(panel, 40).count() == 0


def test_calendar_steps(spark):
    import datetime as dt
    from panelspark.operators import timeline
    day = lambda step: [r.ts for r in timeline.calendar(spark, "2020-01-02", "2020-07-15", step).orderBy("ts").collect()]
    assert day("week")[:2] == [dt.date(2020, 1, 6), dt.date(2020, 1, 13)] and day("week")[-1] == dt.date(2020, 7, 13)
    assert day("quarter") == [dt.date(2020, 4, 1), dt.date(2020, 7, 1)]
    assert day("year") == []


def test_cells_are_read_by_range(spark, tmp_path):
    from panelspark.sources import tables
    rows = spark.range(5000).selectExpr("id AS cell_id", "date'2000-01-01' AS ts", "CAST(id AS DOUBLE) AS a", "1.0D AS b")
    tables.write_stage(rows, str(tmp_path), "g", sort_by=["cell_id", "ts"])
    got = tables.read_cells(spark, str(tmp_path), "g", spark.createDataFrame([(7,), (9,)], "cell_id long"), ["a"])
    assert sorted(r.a for r in got.collect()) == [7.0, 9.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cell_id,7)" in plan and "LessThanOrEqual(cell_id,9)" in plan and "b#" not in plan.split("ReadSchema")[1]
    assert tables.read_cells(spark, str(tmp_path), "g", spark.createDataFrame([], "cell_id long"), ["a"]).count() == 0
