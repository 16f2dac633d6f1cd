"""Refinement of imputed series with the help of related neighbours."""

from dataclasses import replace

from pyspark.sql import DataFrame

from panelspark.config import MONTHS, RunConfig
from panelspark.operators import features as feat, relate
from panelspark.operators.clean import despike
from panelspark.operators.prior import prior_features
from panelspark.operators.timeline import densify
from panelspark.plans.imputation import fit_and_fill
from panelspark.session import cut_lineage
from pyspark.sql import functions as F


def neighbour_rows(panel: DataFrame, data: DataFrame, points: DataFrame, config: RunConfig
                   ) -> tuple[DataFrame, DataFrame]:
    """(feature rows, chosen relations): prior, month indicators and the best neighbours."""
    dense = densify(panel.join(data.select("entity_id").distinct(), "entity_id", "left_semi"),
                    config.start, config.end)
    chosen = cut_lineage(relate.top_relations(
        dense, data, points, config.num_features, config.feature_threshold,
        config.weight_correlation), "relations")
    neighbours = relate.neighbour_features(chosen, data)
    priors = prior_features(dense, config.refine_fractions, config.intercept_fraction,
                            config.refine_windows, config.anchor)
    rolling = [f"{n}m_rw" for n in config.refine_windows]
    rows = feat.month_one_hot(feat.complete_rows(priors, rolling).join(neighbours, ["entity_id", "ts"]))
    packed = rows.select(
        "entity_id", F.col("ts").cast("date").alias("ts"), "value",
        F.concat(F.array(*[F.col(f"`{c}`") for c in rolling]), "neighbours").alias("scaled"),
        F.array(*[F.col(m).cast("double") for m in sorted(MONTHS)]).alias("passed"))
    return packed, chosen


def refine_once(panel: DataFrame, data: DataFrame, points: DataFrame, config: RunConfig) -> dict[str, DataFrame]:
    rows, chosen = neighbour_rows(panel, data, points, config)
    out = fit_and_fill(panel, rows, config)
    out["relations"] = chosen
    out["correlations"] = relate.relation_summary(chosen, config.num_features)
    return out


def iterative_refinement(panel: DataFrame, data: DataFrame, points: DataFrame,
                         config: RunConfig = RunConfig(), on_iteration=None, done=()) -> list[dict[str, DataFrame]]:
    """One result per iteration; the filled series of those `done` already are given and not computed again.

    With `chain` an iteration takes the previous one's filled series as candidates, otherwise
    every iteration starts from the same input. A series whose fit failed keeps its previous
    values as a candidate. Each iteration's data is a written table. `on_iteration(i, out)` may
    persist further results.
    """
    located = points.join(data.select("entity_id").distinct(), "entity_id", "left_semi")
    results, current = [], data.select("entity_id", "ts", "value")

    def feed(i, filled):
        new = filled.select("entity_id", "ts", "value")
        kept = current.join(new.select("entity_id").distinct(), "entity_id", "left_anti")
        return cut_lineage(new.unionByName(kept), f"candidates-{i}") if config.chain else current

    for i, filled in enumerate(done, 1):
        results.append({"data": filled})
        current = feed(i, filled)
    for i in range(len(done) + 1, config.n_iterations + 1):
        source = despike(current, config.despike_window) if config.despike_window else current
        out = refine_once(panel, source, located, replace(config, seed=config.seed + i))
        out["data"] = cut_lineage(out["data"], f"refined-{i}")
        out["locations"] = located.join(out["predictions"].select("entity_id").distinct(), "entity_id", "left_semi")
        if on_iteration:
            on_iteration(i, out)
        results.append(out)
        current = feed(i, out["data"])
    return results
