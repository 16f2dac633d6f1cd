"""Joining per-key tables to large tables whose keys may be very unevenly filled."""

from pyspark.sql import DataFrame, functions as F

HOT_SHARE = 1.0 / 512


def attach(rows: DataFrame, per_key: DataFrame, key: str, spread: str, n: str = "n",
           hot_share: float = HOT_SHARE, salts: int | None = None) -> DataFrame:
    """Inner join of `rows` with one row per `key`, safe against hot keys.

    `per_key` carries in column `n` how many rows each key has. Keys with more than
    `hot_share` of all rows are hot; there are fewer than 1/hot_share of them, so their
    list is broadcast. Rows of hot keys are spread by a hash of `spread` over `salts`
    partitions and the matching key row is repeated for each; all other keys join as usual.
    """
    spark = rows.sparkSession
    salts = salts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    total = per_key.agg(F.sum(n)).scalar()
    hot = (per_key.filter(F.col(n) > F.lit(hot_share) * total)
           .select(key, F.lit(salts).alias("_salts")))
    hot = F.broadcast(hot)
    left = (rows.join(hot, key, "left")
            .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")))
            .drop("_salts"))
    right = (per_key.drop(n).join(hot, key, "left")
             .withColumn("_salt", F.explode(F.sequence(
                 F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
             .drop("_salts"))
    return left.join(right, [key, "_salt"]).drop("_salt")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning by `keys` into all shuffle partitions, never merged by size.

    For rows that grow or cost much per byte afterwards (explodes, grouped fits, matrix
    products): adaptive execution would merge their partitions by the size they have before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
