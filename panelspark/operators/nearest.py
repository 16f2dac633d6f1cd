"""The nearest sites of every point, by descending a tree over the sites.

The tree splits where the sites are, so a leaf holds a few of them wherever they lie. A point goes down twice. The first way, to the nearest child
each time, gives a distance within which enough sites lie; the second follows all nodes within that distance. Both are joins of
points with the tree's levels, without a shuffle as long as a level is small, and a point meets the sites of a few leaves only.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.geometry import squared_distance
from panelspark.operators.skew import spread
from panelspark.operators.tree import ROOT, children, grow, small
from panelspark.session import cut_lineage

FAN = 64
LEAF = 16
FEW = 256  # so many sites need no tree


def has_position(lon="lon", lat="lat") -> Column:
    """True where both coordinates are numbers."""
    return F.coalesce(F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(F.col(lon).cast("double"))
                      & ~F.isnan(F.col(lat).cast("double")), F.lit(False))


def without_position(points: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, status) of the points that spatial operators leave out."""
    return points.filter(~has_position()).select(key, F.lit("no position").alias("status"))


def _gap(v, lo, hi):
    return F.greatest(lo - v, v - hi, F.lit(0.0))


def _reach(v, lo, hi):
    return F.greatest(F.abs(v - lo), F.abs(hi - v))


def _square(f, box) -> Column:
    """Squared distance of the point from the nearest (`_gap`) or farthest (`_reach`) place of a box; sites never lie nearer or farther."""
    return squared_distance(f(F.col("lon"), box["x0"], box["x1"]), F.lit(0.0), F.lit(0.0), f(F.col("lat"), box["y0"], box["y1"]))


def met(points: DataFrame, sites: DataFrame, wanted: int, site: str = "site") -> DataFrame:
    """The rows of `points` (lon, lat) with the sites (array of site, _x, _y) of each leaf that can hold one of the `wanted` nearest.

    `_bound` is the squared distance within which they lie, NULL if there are fewer sites.
    """
    first = F.row_number().over(Window.partitionBy("_x", "_y").orderBy(site))
    sites = sites.withColumn("_first", first).filter(F.col("_first") <= wanted).drop("_first")  # enough of those at one position
    packed = F.collect_list(F.struct(site, "_x", "_y")).alias("_sites")
    if sites.limit(FEW + 1).count() <= FEW:
        levels, leaves = [], F.broadcast(sites.groupBy(F.lit(ROOT).cast("long").alias("node")).agg(packed))
    else:
        members, tables, counts = grow(sites, FAN, LEAF, x="_x", y="_y")
        levels = [small(children(table, FAN), n) for table, n in zip(tables[1:], counts)]
        leaves = cut_lineage(members.groupBy("node").agg(packed), "tree-leaves")
    seen = points.withColumns({"node": F.lit(ROOT).cast("long"), "_bound": F.lit(None).cast("double")})
    for table in levels:
        enough = F.array_min(F.transform(F.filter("kids", lambda c: c["n"] >= wanted), lambda c: _square(_reach, c)))
        down = F.array_min(F.transform("kids", lambda c: F.struct(_square(_gap, c), c["node"])))["node"]
        seen = (seen.join(table, "node", "left").withColumn("_bound", F.least("_bound", enough))
                .withColumn("node", F.coalesce(down, "node")).drop("kids"))
    own = F.array_sort(F.transform("_sites", lambda s: squared_distance(F.col("lon"), F.col("lat"), s["_x"], s["_y"])))
    seen = (seen.join(leaves, "node").withColumn("_bound", F.least("_bound", F.get(own, F.lit(wanted - 1)))).drop("_sites", "node")
            .withColumn("node", F.lit(ROOT).cast("long")))
    within = lambda c: F.col("_bound").isNull() | (_square(_gap, c) <= F.col("_bound"))
    for table in levels:
        front = F.transform(F.filter("kids", within), lambda c: c["node"])
        seen = (seen.join(table, "node", "left").withColumn("node", F.explode(F.when(F.col("kids").isNull(), F.array("node")).otherwise(front)))
                .drop("kids"))
    return seen.join(leaves, "node").select(*points.columns, "_bound", "_sites")


def nearest(points: DataFrame, sites: DataFrame, k: int = 1, key: str = "entity_id", site: str = "site",
            others_only: bool = False) -> DataFrame:
    """(key, site, distance, rank): the k nearest sites of each point with a position; ties by site.

    Distances are Euclidean in the coordinates' unit. With `others_only` a site of the point's own name doesn't count.
    """
    points = points.filter(has_position()).select(key, F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    sites = sites.filter(has_position()).select(site, F.col("lon").cast("double").alias("_x"), F.col("lat").cast("double").alias("_y"))
    # dealt by key once: what follows is narrow up to the ranks of each key
    found = met(spread(points, key), sites, k + 1 if others_only else k, site)
    apart = lambda s: squared_distance(F.col("lon"), F.col("lat"), s["_x"], s["_y"])
    near = F.filter("_sites", lambda s: F.col("_bound").isNull() | (apart(s) <= F.col("_bound")))
    found = found.select(key, F.inline(F.transform(near, lambda s: F.struct(s[site].alias(site), apart(s).alias("_d2")))))
    if others_only:
        found = found.filter(F.col(site) != F.col(key))
    order = Window.partitionBy(key).orderBy("_d2", site)
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select(key, site, F.sqrt("_d2").alias("distance"), "rank"))
