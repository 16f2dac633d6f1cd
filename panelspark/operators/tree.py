"""A tree over positions that splits where they are: by quantiles of a node's longer side, level by level.

A level is one aggregation (counts, boxes, approximate quantiles, combined before the shuffle) and one join with its small result,
so clusters, strips and a single far position all end in leaves of bounded size. Only positions that are equal stay together.
"""

import functools

from pyspark.sql import DataFrame, Observation, functions as F

from panelspark.session import cut_lineage

BROADCAST_NODES = 4096  # a level of at most so many nodes is broadcast
ROOT = 1                # children of node i are fan * i ... fan * i + fan - 1, so ids of all levels differ
MAX_LEVELS = {2: 62, 4: 31, 8: 20, 16: 15, 64: 10}


def small(nodes: DataFrame, n: int) -> DataFrame:
    """The nodes, to be broadcast if there are few."""
    return F.broadcast(nodes) if n <= BROADCAST_NODES else nodes


def grow(points: DataFrame, fan: int = 64, leaf: int = 16, by: tuple[str, ...] = (), **axes: str) -> tuple[DataFrame, list[DataFrame], list[int]]:
    """(members, levels, nodes per level): `points` with their leaf as `node`; (by, node, level, n, x0, x1, y0, y1, split) of each level's nodes.

    One tree for each value of the columns `by`. `axes` names the coordinates: x="lon", y="lat" unless given, any number of them, each with
    its pair of bounds in the boxes. A leaf holds at most `leaf` rows, or rows of one position. Coordinates must not be null or NaN. `fan` is
    a key of MAX_LEVELS.
    """
    axes = axes or {"x": "lon", "y": "lat"}
    key = [*by, "node"]
    state = cut_lineage(points, "tree-rows").withColumn("node", F.lit(ROOT).cast("long"))
    grid = ", ".join(f"{i / fan}d" for i in range(1, fan))
    levels, counts = [], []
    for level in range(MAX_LEVELS[fan] + 1):
        # rows of nodes that were split last have ids of this level
        found = state.filter(F.col("node") >= ROOT * fan ** level).groupBy(*key).agg(
            F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{a}{i}") for a, c in axes.items() for i, f in enumerate((F.min, F.max))],
            *[F.expr(f"percentile_approx(`{c}`, array({grid}), 200)").alias(f"_q{a}") for a, c in axes.items()])
        sides = F.array(*[F.struct((F.col(f"{a}1") - F.col(f"{a}0")).alias("size"), F.lit(-i).alias("axis"), F.col(f"{a}0").alias("low"), F.col(f"{a}1").alias("high"),
                                   F.col(f"_q{a}").alias("q")) for i, a in enumerate(axes)])
        found = found.withColumn("_side", F.array_max(sides))  # the longest
        split = (F.col("n") > leaf) & (F.col("_side.size") > 0) & F.lit(level < MAX_LEVELS[fan])
        parts = F.least(F.ceil(2 * F.col("n") / leaf), F.lit(fan)).cast("int")  # half full, as quantiles are approximate and coordinates tie
        chosen = F.transform(F.when(parts > 1, F.sequence(F.lit(1), parts - 1)).otherwise(F.array().cast("array<int>")),
                             lambda i: F.get("_side.q", F.floor(i * fan / parts).cast("int") - 1))
        # a border is a position's own coordinate and the largest one is none, so no child is empty
        borders = F.filter(F.array_distinct(chosen), lambda b: b < F.col("_side.high"))
        found = found.withColumns({"split": split, "_axis": -F.col("_side.axis"), "level": F.lit(level),
                                   "_borders": F.when(F.size(borders) > 0, borders).otherwise(F.array("_side.low"))}).drop("_side", *[f"_q{a}" for a in axes])
        seen = Observation()
        found = cut_lineage(found.observe(seen, F.count(F.lit(1)).alias("nodes"), F.count_if("split").alias("open")), "tree-level")
        if not seen.get["nodes"]:
            break
        counts.append(seen.get["nodes"])
        levels.append(found.drop("_axis", "_borders"))
        if not seen.get["open"]:
            break
        # rows of leaves keep their node
        open_ = small(found.filter("split").select(*key, "_axis", "_borders"), counts[-1])
        at = F.get(F.array(*axes.values()), F.col("_axis"))
        child = F.col("node") * fan + F.size(F.filter("_borders", lambda b: b < at))
        state = state.join(open_, key, "left").withColumn("node", F.when(F.col("_axis").isNotNull(), child).otherwise(F.col("node"))).drop("_axis", "_borders")
        if level % 4 == 3:
            state = cut_lineage(state, "tree-rows")
    return state, levels or [found.drop("_axis", "_borders")], counts


def all_nodes(levels: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, levels)


def children(level: DataFrame, fan: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, kids): for each split node the children that `level` holds, at most `fan` of them, with counts and boxes."""
    kid = F.struct("node", "n", "x0", "x1", "y0", "y1")
    return (level.groupBy(*by, F.expr(f"node div {fan}").alias("_parent")).agg(F.collect_list(kid).alias("kids"))
            .withColumnRenamed("_parent", "node"))
