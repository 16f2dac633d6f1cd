"""Least squares on several features for every entity and fold, from aggregates, without a Python worker.

Each labelled row goes once into sums of products, kept by the set of folds that train on it (a bit mask, so at most one group for each test fold and
choice of validation rows). A fold's normal equations are the sums over the masks that hold the fold, the final fit's those over all masks. They
are scaled to correlations and solved by elimination in column functions. A feature that the ones before it determine (constant, or with less than `TOLERANCE` of
its variance left) gets coefficient 0, so month indicators and sums of other features have a defined answer: the last of a dependent set drops out.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.operators.folds import assign_folds
from panelspark.operators.skew import spread
from panelspark.session import cut_lineage

TOLERANCE = 1e-9   # variance left after the features before, as a share
CONSTANT = 1e-12   # variance against the mean square, below which a feature is constant
FINAL = -1


def with_splits(rows: DataFrame, k: int = 5, validation_split: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds `splits`, the row's split in folds 1 to k as of `folds.split_rows` (NULL without label). One exchange by entity; rows are not repeated."""
    rows = assign_folds(spread(rows, "entity_id"), k, label="value")
    names = []
    for fold in range(1, k + 1):
        is_test = F.col("test_fold") == fold
        w = Window.partitionBy("entity_id", is_test)
        lot = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("entity_id").cast("string"), F.lit(str(fold)), F.col("ts").cast("date").cast("string")))
        chosen = F.row_number().over(w.orderBy(lot, "ts")) <= F.ceil(F.count(F.lit(1)).over(w) * F.lit(float(validation_split)))
        names.append(f"_s{fold}")
        rows = rows.withColumn(names[-1], F.when(is_test, "test").when(chosen & ~is_test, "validation").when(~is_test, "train"))
    return rows.withColumn("splits", F.when(F.col("test_fold").isNotNull(), F.array(*names))).drop("test_fold", *names)


def _products(rows: DataFrame, p: int, k: int) -> DataFrame:
    """(entity_id, fold, g, held): for each fold, and FINAL, the matrix of sums of products of (1, y, features) over its rows, and how many rows it validates on."""
    u = F.concat(F.array(F.lit(1.0), F.col("value") - F.col("_y0")), F.zip_with("x", "_x0", lambda a, b: a - b))
    mask = sum((F.when(F.get("splits", F.lit(f)) == "train", 1 << f).otherwise(0) for f in range(k)), F.lit(0))
    lines = (rows.filter("splits IS NOT NULL").select("entity_id", mask.alias("mask"), u.alias("u"))
             .select("entity_id", "mask", "u", F.posexplode("u").alias("i", "_u")))
    sums = [F.sum(F.col("_u") * F.get("u", F.lit(j))).alias(f"_{j}") for j in range(p + 2)]
    by_mask = lines.groupBy("entity_id", "mask", "i").agg(*sums)
    folds = F.concat(*[F.when(F.col("mask").bitwiseAND(1 << f) != 0, F.array(F.lit(f + 1))).otherwise(F.array().cast("array<int>")) for f in range(k)], F.array(F.lit(FINAL)))
    by_fold = (by_mask.withColumn("fold", F.explode(folds)).groupBy("entity_id", "fold", "i")
               .agg(*[F.sum(f"_{j}").alias(f"_{j}") for j in range(p + 2)]))
    g = F.sort_array(F.collect_list(F.struct("i", F.array(*[f"_{j}" for j in range(p + 2)]).alias("line"))))
    held = (rows.filter("splits IS NOT NULL").select("entity_id", F.posexplode("splits").alias("f", "s")).groupBy("entity_id", (F.col("f") + 1).alias("fold"))
            .agg(F.count_if(F.col("s") == "validation").alias("held")))
    return (by_fold.groupBy("entity_id", "fold").agg(g.alias("g")).withColumn("g", F.col("g.line"))
            .join(held, ["entity_id", "fold"], "left"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _solved(sums: DataFrame, p: int) -> DataFrame:
    """Adds b0 and b, the coefficients, to rows with matrices `g`."""
    at = lambda i, j: F.get(F.get("g", i if isinstance(i, Column) else F.lit(i)), j if isinstance(j, Column) else F.lit(j))
    n, index = at(0, 0), F.sequence(F.lit(2), F.lit(p + 1))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    means = F.transform(F.get("g", F.lit(0)), lambda v: v / n)
    out = sums.withColumn("_m", means)
    mean = lambda i: F.get("_m", i)
    var = F.transform(F.sequence(F.lit(0), F.lit(p + 1)), lambda i: F.struct((at(i, i) / n).alias("q"), (at(i, i) / n - mean(i) * mean(i)).alias("v")))
    # deviation of each feature, 0 where it is constant
    out = out.withColumn("_sd", F.transform(var, lambda x: F.when(x["v"] > CONSTANT * x["q"], F.sqrt(x["v"])).otherwise(F.lit(0.0))))
    sd = lambda i: F.get("_sd", i)
    entry = lambda i, j: ratio(at(i, j) / n - mean(i) * mean(j), sd(i) * sd(j))
    right = lambda i: ratio(at(i, 1) / n - mean(i) * mean(F.lit(1)), sd(i))
    lines = F.transform(index, lambda i: F.concat(F.transform(index, lambda j: entry(i, j)), F.array(right(i))))
    out = out.withColumn("_lines", lines)
    none = F.expr("CAST(array() AS array<array<double>>)")

    def eliminate(state, _):
        head = F.get(state["rest"], F.lit(0))
        pivot = F.get(head, F.lit(0))
        tail = F.when(pivot > TOLERANCE, F.transform(F.slice(head, 2, F.size(head) - 1), lambda v: v / pivot)).otherwise(
            F.transform(F.slice(head, 2, F.size(head) - 1), lambda v: F.lit(0.0)))
        rest = F.transform(F.slice(state["rest"], 2, F.size(state["rest"]) - 1), lambda line: F.zip_with(
            F.slice(line, 2, F.size(line) - 1), tail, lambda v, u: v - F.get(line, F.lit(0)) * u))
        return F.struct(rest.alias("rest"), F.concat(state["done"], F.array(tail)).alias("done"))

    done = F.aggregate(index, F.struct(F.col("_lines").alias("rest"), none.alias("done")), eliminate, lambda s: s["done"])
    out = out.withColumn("_done", F.reverse(done))
    beta = F.aggregate("_done", F.expr("CAST(array() AS array<double>)"), lambda acc, u: F.concat(
        F.array(F.element_at(u, -1) - _dot(F.slice(u, 1, F.size(u) - 1), acc)), acc))
    out = out.withColumn("b", F.zip_with(beta, F.slice("_sd", 3, p), ratio))
    return out.withColumn("b0", mean(F.lit(1)) - _dot(F.col("b"), F.slice("_m", 3, p))).drop("_m", "_sd", "_lines", "_done", "g")


def fit_and_predict(rows: DataFrame, k: int = 5, validation_split: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(predictions, status). Rows: entity_id, ts, value (label or NULL), scaled and passed ARRAY<DOUBLE> (features, in this order).

    predictions: entity_id, ts, fold, split, value, yhat for folds 1 to k and fold -1, the final fit to all labelled rows (split 'all'), for each
    row. status: entity_id, fold, status: 'ok', or why there are no predictions; an entity without all its folds has no final fit.
    """
    # entities may differ in their number of features: what is missing is 0 everywhere, so a constant
    p = rows.agg(F.max(F.size("scaled") + F.size("passed"))).first()[0] or 1
    w = Window.partitionBy("entity_id")
    rows = rows.select("entity_id", F.col("ts").cast("date").alias("ts"), "value", F.concat("scaled", "passed", F.array_repeat(F.lit(0.0), p - F.size("scaled") - F.size("passed"))).alias("x"))
    # features and labels count from a point of their own entity, so that products keep their digits
    rows = with_splits(rows, k, validation_split, seed).withColumns({"_x0": F.min_by("x", "ts").over(w), "_y0": F.avg("value").over(w)})
    rows = cut_lineage(rows, "least-squares-rows")
    sums = _products(rows, p, k).withColumn("ok", (F.get(F.get("g", F.lit(0)), F.lit(0)) >= 2) & ((F.col("held") >= 1) | (F.col("fold") == FINAL)))
    sums = cut_lineage(sums, "least-squares-sums")
    # a final fit needs all folds, and one without any row to train on has no matrix
    whole = sums.filter((F.col("fold") != FINAL) & F.col("ok")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("_good"))
    judged = sums.join(whole, "entity_id", "left").withColumn("ok", F.when(F.col("fold") == FINAL, F.coalesce(F.col("_good") == k, F.lit(False))).otherwise(F.col("ok")))
    known = rows.select("entity_id").distinct().withColumn("fold", F.explode(F.array(*[F.lit(f) for f in (*range(1, k + 1), FINAL)])))
    status = (known.join(judged.select("entity_id", "fold", "ok"), ["entity_id", "fold"], "left")
              .filter((F.col("fold") != FINAL) | F.coalesce("ok", F.lit(False)))
              .select("entity_id", "fold", F.when(F.col("ok"), "ok").otherwise("failed: too few labelled rows").alias("status")))
    fits = cut_lineage(_solved(judged.filter("ok").select("entity_id", "fold", "g"), p), "least-squares-fits")
    fits = fits.groupBy("entity_id").agg(F.collect_list(F.struct("fold", "b0", "b")).alias("_fits"))
    met = rows.join(fits, "entity_id").withColumn("x", F.zip_with("x", "_x0", lambda a, b: a - b))
    one = F.transform("_fits", lambda f: F.struct(
        f["fold"].alias("fold"),
        F.when(f["fold"] == FINAL, F.when(F.col("splits").isNotNull(), F.lit("all"))).otherwise(F.get("splits", f["fold"] - 1)).alias("split"),
        (F.col("_y0") + f["b0"] + _dot(f["b"], F.col("x"))).alias("yhat")))
    found = met.select("entity_id", "ts", "value", F.explode(one).alias("_f"))
    return found.select("entity_id", "ts", "_f.fold", "_f.split", "value", "_f.yhat"), status
