"""Adapters from the given tables to panels, points, polygons and grids, in Spark and in SQL.

The tables have no geography, so coordinates and cells are arithmetic on keys. Panel values are
rounded once in the adapter, so both engines start from identical doubles, and divided by a number
that leaves no short decimals: means of those would often lie exactly between two rounded results.
"""

from pyspark.sql import functions as F

from panelspark.config import FEATURE_VARIABLES, GridSpec

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def R(expr, digits=6):
    """SQL rounding without negative zero."""
    return f"(round({expr}, {digits}) + 0e0)"


def rounded(df, digits=6, **special):
    """Round all DOUBLE columns for comparison."""
    return df.select(*[F.round(F.col(f"`{c}`"), special.get(c, digits)).alias(c) if t == "double"
                       else F.col(f"`{c}`") for c, t in df.dtypes])


def with_(*names, **extra):
    ctes = {n: CTE[n] for n in names} | extra
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes.items()) + "\n"


# --- panels -----------------------------------------------------------------------------

def pd_daily(spark, sf):
    """customer/day avg(o_totalprice): about ten readings per entity, many long gaps."""
    return (table(spark, sf, "orders")
            .groupBy(F.col("o_custkey").cast("string").alias("entity_id"),
                     F.col("o_orderdate").cast("date").alias("ts"))
            .agg((F.round(F.avg("o_totalprice"), 4) / 0.97000731).alias("value")))


def pa_daily(spark, sf):
    """supplier/day avg(l_quantity): dense series."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").cast("string").alias("entity_id"),
                     F.col("l_shipdate").cast("date").alias("ts"))
            .agg((F.round(F.avg("l_quantity"), 6) / 0.97000731).alias("value")))


def pa_monthly(spark, sf):
    """supplier/month avg(l_quantity)."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").cast("string").alias("entity_id"),
                     F.trunc("l_shipdate", "MM").alias("ts"))
            .agg((F.round(F.avg("l_quantity"), 6) / 0.97000731).alias("value")))


def pb_monthly(spark, sf):
    """nation/month sum(o_totalprice) in units of 970; some months are missing."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("entity_id"), F.trunc("o_orderdate", "MM").alias("ts"))
            .agg((F.round(F.sum("o_totalprice"), 2) / 970.00731).alias("value")))


def pc_events(spark, sf):
    """user/instant value: irregular, 30 days."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("entity_id"), "ts", "value")


CTE = {
    "pd": """SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(o_orderdate AS DATE) AS ts,
        round(avg(o_totalprice), 4) / 0.97000731e0 AS value FROM orders GROUP BY 1, 2""",
    "pa": """SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, CAST(l_shipdate AS DATE) AS ts,
        round(avg(l_quantity), 6) / 0.97000731e0 AS value FROM lineitem GROUP BY 1, 2""",
    "pam": """SELECT CAST(l_suppkey AS VARCHAR) AS entity_id,
        CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
        round(avg(l_quantity), 6) / 0.97000731e0 AS value FROM lineitem GROUP BY 1, 2""",
    "pb": """SELECT n_name AS entity_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts,
        round(sum(o_totalprice), 2) / 970.00731e0 AS value
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2""",
    "pc": "SELECT CAST(user_id AS VARCHAR) AS entity_id, ts, value FROM events",
}

START, END = "1995-01-01", "2001-12-01"  # month calendar that covers orders and lineitem


# --- points -----------------------------------------------------------------------------

def _lon_lat(k):
    return ((((k * 37) % 360) - 180 + F.lit(0.5)).cast("double").alias("lon"),
            (((k * 53) % 140) - 60 + F.lit(0.5)).cast("double").alias("lat"))


def _lon_lat_sql(k):
    return f"(({k} * 37) % 360) - 180 + 0.5e0 AS lon, (({k} * 53) % 140) - 60 + 0.5e0 AS lat"


def nation_points(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("entity_id"), *_lon_lat(F.col("n_nationkey")))


def supplier_points(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("entity_id"), *_lon_lat(F.col("s_suppkey")))


def customer_points(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"), *_lon_lat(F.col("c_custkey")))


CTE |= {
    "npts": f"SELECT n_name AS entity_id, {_lon_lat_sql('n_nationkey')} FROM nation",
    "spts": f"SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, {_lon_lat_sql('s_suppkey')} FROM supplier",
    "cpts": f"SELECT CAST(c_custkey AS VARCHAR) AS entity_id, {_lon_lat_sql('c_custkey')} FROM customer",
}


# --- polygons: a diamond around every supplier, every third one with a hole ---------------

def diamond_edges(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k.cast("int").alias("poly_id"), *_lon_lat(k),
                                            (3 + k % 5).cast("double").alias("radius"))
    rings = s.withColumn("ring_id", F.explode(F.when(F.col("poly_id") % 3 == 0, F.array(F.lit(0), F.lit(1)))
                                              .otherwise(F.array(F.lit(0)))))
    r = F.when(F.col("ring_id") == 0, F.col("radius")).otherwise(F.lit(1.0))
    x, y = F.col("lon"), F.col("lat")
    corner = [(x + r, y), (x, y + r), (x - r, y), (x, y - r)]
    sides = F.array(*[F.struct(F.lit(i).alias("seq"), a[0].alias("x1"), a[1].alias("y1"),
                               b[0].alias("x2"), b[1].alias("y2"))
                      for i, (a, b) in enumerate(zip(corner, corner[1:] + corner[:1]))])
    return rings.select("poly_id", "ring_id", F.inline(sides))


CTE["diamonds"] = f"""SELECT s_suppkey AS poly_id, {_lon_lat_sql('s_suppkey')},
    CAST(3 + s_suppkey % 5 AS DOUBLE) AS radius, s_suppkey % 3 = 0 AS has_hole FROM supplier"""
CTE["box"] = """SELECT min(lon - radius) AS x_min, min(lat - radius) AS y_min,
    max(lon + radius) AS x_max, max(lat + radius) AS y_max FROM diamonds"""


# --- grids ------------------------------------------------------------------------------

# coarse world grid with a dense series in (almost) every cell
COARSE = GridSpec(x_min=-165.0, y_min=-60.0, x_max=165.0, y_max=60.0, res_x=30.0, res_y=30.0)


def grid_sql(spec):
    return f"""SELECT id AS cell_id, CAST(id // {spec.n_cols} AS INTEGER) AS row,
        CAST(id % {spec.n_cols} AS INTEGER) AS col,
        {spec.x_min}e0 + (id % {spec.n_cols}) * {spec.res_x}e0 AS lon,
        {spec.y_max}e0 - (id // {spec.n_cols}) * {spec.res_y}e0 AS lat
        FROM (SELECT unnest(range({spec.n_cells})) AS id)"""


# one aggregate per feature variable; the text is valid in both engines
COVARIATES = {v: f"CAST(sum(l_quantity) * {i + 1} + count(*) * {(i * 7) % 5 + 1} AS DOUBLE)"
              for i, v in enumerate(FEATURE_VARIABLES)}


def _by_cell(spark, sf):
    cell = (F.col("l_partkey") % 5 * 12 + F.col("l_suppkey") % 12).cast("bigint")
    return table(spark, sf, "lineitem").groupBy(cell.alias("cell_id"), F.trunc("l_shipdate", "MM").alias("ts"))


def land_grid(spark, sf):
    return _by_cell(spark, sf).agg(*[F.expr(text).alias(v) for v, text in COVARIATES.items()])


def drought_grid(spark, sf):
    return (_by_cell(spark, sf)
            .agg((F.sum("l_quantity") / 64 - F.count(F.lit(1))).alias("sc_PDSI_pm_filled")))


_SQL_CELL = "CAST(l_partkey % 5 * 12 + l_suppkey % 12 AS BIGINT)"
CTE["land"] = f"""SELECT {_SQL_CELL} AS cell_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
    {', '.join(f'{text} AS "{v}"' for v, text in COVARIATES.items())} FROM lineitem GROUP BY 1, 2"""
CTE["drought"] = f"""SELECT {_SQL_CELL} AS cell_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
    sum(l_quantity) / 64 - count(*) AS "sc_PDSI_pm_filled" FROM lineitem GROUP BY 1, 2"""
CTE["cells"] = grid_sql(COARSE)


# --- raster: monthly mean per coarse cell -------------------------------------------------

def raster(spark, sf):
    row = (F.col("l_partkey") % 5).cast("int")
    col = (F.col("l_suppkey") % 12).cast("int")
    return (table(spark, sf, "lineitem")
            .groupBy(F.trunc("l_shipdate", "MM").alias("ts"), row.alias("row"), col.alias("col"))
            .agg((F.round(F.avg("l_quantity"), 6) / 0.97000731).alias("value"))
            .select("ts", "row", "col", (F.col("col") * 30.0 - 165.0).alias("lon"),
                    (60.0 - F.col("row") * 30.0).alias("lat"), "value"))


CTE["raster"] = """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
    CAST(l_partkey % 5 AS INTEGER) AS row, CAST(l_suppkey % 12 AS INTEGER) AS col,
    CAST(l_suppkey % 12 AS INTEGER) * 30e0 - 165e0 AS lon, 60e0 - CAST(l_partkey % 5 AS INTEGER) * 30e0 AS lat,
    round(avg(l_quantity), 6) / 0.97000731e0 AS value FROM lineitem GROUP BY 1, 2, 3, 4, 5"""


# --- interpolation as SQL -----------------------------------------------------------------

JD = "(date_diff('day', DATE '1970-01-01', {}) + 2440587.5e0)"


def _end(h, hn, s, sn):
    e = f"(((2 * {h} + {hn}) * {s} - {h} * {sn}) / ({h} + {hn}))"
    return (f"CASE WHEN sign({e}) <> sign({s}) THEN 0e0 "
            f"WHEN sign({s}) <> sign({sn}) AND abs({e}) > 3 * abs({s}) THEN 3 * {s} ELSE {e} END")


def _inner(hl, hr, sl, sr):
    wl, wr = f"(2 * {hr} + {hl})", f"({hr} + 2 * {hl})"
    return f"CASE WHEN {sl} * {sr} <= 0 THEN 0e0 ELSE ({wl} + {wr}) / ({wl} / {sl} + {wr} / {sr}) END"


def pchip_ctes(src, gap_days=None, pad_days=90, prefix=""):
    """CTEs that end in `<prefix>interp` (entity_id, ts, value) with a row per month start."""
    p = prefix
    mask = "TRUE"
    if gap_days is not None:
        mask = f"NOT (floor(x2 - x) > {gap_days} AND xq >= x + {pad_days} AND xq <= x2 - {pad_days})"
    return {
        f"{p}knots": f"SELECT entity_id, ts, {JD.format('ts')} AS x, value AS y FROM {src} WHERE value IS NOT NULL",
        f"{p}near": f"""SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2,
            lead(x, 2) OVER w AS x3, lead(y, 2) OVER w AS y3, lead(ts) OVER w AS nts
            FROM {p}knots WINDOW w AS (PARTITION BY entity_id ORDER BY ts)""",
        f"{p}seg": f"""SELECT *, x2 - x AS h, (y2 - y) / (x2 - x) AS s, x - x0 AS hl, (y - y0) / (x - x0) AS sl,
            x3 - x2 AS hr, (y3 - y2) / (x3 - x2) AS sr FROM {p}near WHERE x2 IS NOT NULL""",
        f"{p}der": f"""SELECT *, CASE WHEN x0 IS NULL AND x3 IS NULL THEN s WHEN x0 IS NULL THEN {_end('h', 'hr', 's', 'sr')}
            ELSE {_inner('hl', 'h', 'sl', 's')} END AS d1,
            CASE WHEN x0 IS NULL AND x3 IS NULL THEN s WHEN x3 IS NULL THEN {_end('h', 'hl', 's', 'sl')}
            ELSE {_inner('h', 'hr', 's', 'sr')} END AS d2 FROM {p}seg""",
        f"{p}slots": f"""SELECT *, CAST(unnest(generate_series(
            CASE WHEN date_trunc('month', ts) = ts THEN date_trunc('month', ts) ELSE date_trunc('month', ts) + INTERVAL 1 MONTH END,
            date_trunc('month', nts), INTERVAL 1 MONTH)) AS DATE) AS q FROM {p}der""",
        f"{p}interp": f"""SELECT entity_id, q AS ts, CASE WHEN {mask} THEN
            (1 + 2 * t) * u * u * y + t * u * u * h * d1 + t * t * (3 - 2 * t) * y2 + t * t * (t - 1) * h * d2 END AS value
            FROM (SELECT *, (xq - x) / h AS t, 1 - (xq - x) / h AS u FROM
                  (SELECT *, {JD.format('q')} AS xq FROM {p}slots)) WHERE xq < x2 OR x3 IS NULL""",
    }


def calendar_sql(start=START, end=END):
    return (f"SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 MONTH)) AS DATE) AS ts")


def dense_sql(src):
    """Every entity of `src` on the month calendar."""
    return f"""SELECT e.entity_id, c.ts, p.value FROM (SELECT DISTINCT entity_id FROM {src}) e
        CROSS JOIN ({calendar_sql()}) c LEFT JOIN {src} p ON p.entity_id = e.entity_id AND p.ts = c.ts"""
