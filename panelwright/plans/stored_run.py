"""The classical run with a result store: resumable, every series and model accounted for.

Entities are dealt into batches by hash. Each batch is one run of all models
over its entities and is committed as a whole, with a status row for every
entity and model. Running again takes up what no committed batch holds. The
report tables read the store.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import arma as ar
from panelwright.operators.derive import feature_columns
from panelwright.operators.impute import attach
from panelwright.operators.metrics import METRICS, cv_average, diebold_mariano, forecast_metrics
from panelwright.operators.window import time_split
from panelwright.plans import reports as rp
from panelwright.plans.classical import COMPARISONS, information_table, run_models
from panelwright.plans.diagnostics import run_diagnostics
from panelwright.plans.panel import LIQUIDITY, TARGET
from panelwright.session import settle
from panelwright.sources.store import RunStore

#: What a batch stores of a run for every model, and once per entity; metrics and comparisons are derived when read.
PER_MODEL, PER_ENTITY = ("best", "forecasts", "cv_folds"), ("var", "irf")
#: Status of a batch that failed; it is tried again by the next run.
FAILED = "failed: "


def entity_models(features: DataFrame, models: Sequence[str], entity: str = "industry") -> DataFrame:
    """(entity, model): all that a run has to account for."""
    every = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    return features.select(entity).distinct().select(entity, every)


def run_status(out: Mapping[str, DataFrame], models: Sequence[str], entity: str = "industry") -> DataFrame:
    """Status per entity and model: why there is no model, or how its forecasts came about."""
    every = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    rows = out["status"].select(entity, "n_train", "d", F.col("status").alias("_s"), "reduced", every)
    best = out["best"].select(entity, "model", F.lit(True).alias("_fit"))
    test = out["forecasts"].filter("split = 'test'").groupBy(entity, "model").agg(F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("_f"))
    rows = attach(attach(rows, best, [entity, "model"], ["_fit"]), test, [entity, "model"], ["_f"])
    status = F.when(F.col("_s") != "ok", F.col("_s")).when(F.col("_fit").isNull(), "no usable candidate")
    return rows.select(entity, "model", "n_train", "d", status.otherwise(F.coalesce("_f", F.lit("ok"))).alias("status"), "reduced")


def failed_status(todo: DataFrame, error: Exception, entity: str = "industry") -> DataFrame:
    told = F.lit(f"{FAILED}{type(error).__name__}")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return todo.select(entity, "model", null("long", "n_train"), null("int", "d"), told.alias("status"), null("string", "reduced"))


def _jobs(todo: DataFrame, batches: int, entity: str) -> Iterator[tuple[DataFrame, list[str]]]:
    """(entities, models) of each batch: entities of one hash bucket that lack the same models."""
    sets = todo.groupBy(entity).agg(F.array_sort(F.collect_set("model")).alias("models"))
    sets = settle(sets.withColumn("bucket", F.pmod(F.xxhash64(entity), F.lit(batches)).cast("int")), "todo")
    # At most batches x 2 ** models rows.
    for r in sets.select("bucket", "models").distinct().orderBy("bucket", "models").collect():
        same = F.array(*[F.lit(m) for m in r["models"]])
        yield sets.filter((F.col("bucket") == r["bucket"]) & (F.col("models") == same)).select(entity), list(r["models"])


def run_stored(
    features: DataFrame,
    path: str,
    models: Mapping[str, ar.Arma] | None = None,
    target: str = TARGET,
    entity: str = "industry",
    period: str = "year",
    season: int = 1,
    batches: int = 8,
    isolate: bool = False,
    diagnostics: bool = False,
    liquidity: Sequence[str] = tuple(LIQUIDITY),
    most: int | None = None,
    **options,
) -> RunStore:
    """Run what the store at ``path`` does not hold yet and commit it batch by batch.

    ``options`` go to ``run_models``. With ``isolate`` an error of a batch
    becomes a status row for each of its entities and models and the run goes
    on; those are tried again next time. ``most`` ends the run after so many
    batches, as a planned stop would. With ``diagnostics`` the diagnostic tables
    of every entity and model are stored too.
    """
    spark = features.sparkSession
    store = RunStore(spark, path)
    exog = feature_columns(features, None, None, containing=("lag",))
    models = dict(models or ar.default_models(exog))
    todo = store.pending(entity_models(features, list(models), entity), "status", f"status NOT LIKE '{FAILED}%'")
    for n, (entities, names) in enumerate(_jobs(todo, batches, entity)):
        if most is not None and n >= most:
            break
        part = features.join(entities, features[entity].eqNullSafe(entities[entity]), "left_semi")
        try:
            out = run_models(part, target, entity, period, {m: models[m] for m in names}, season, **options)
            tables = {"status": run_status(out, names, entity), **{t: out[t] for t in (*PER_MODEL, *PER_ENTITY) if t in out}}
            if diagnostics:
                train = time_split(part, [entity], period).filter("split = 'train'")
                tables |= run_diagnostics(train, out["residuals"], target, liquidity, entity, period, season)
            if len(names) < len(models):
                # What has no model is there already from the batch with the other models.
                tables = {t: df for t, df in tables.items() if "model" in df.columns and t != "manifest"}
            store.append(tables)
        except (PySparkException, ValueError, ArithmeticError) as error:
            if not isolate:
                raise
            store.append({"status": failed_status(entity_models(part, names, entity), error, entity)})
    return store


def latest_status(store: RunStore, entity: str = "industry") -> DataFrame:
    """One status row per entity and model; a later success replaces a failure."""
    rows = store.read("status")
    worked = (~F.col("status").startswith(FAILED)).cast("int")
    payload = [c for c in rows.columns if c not in (entity, "model")]
    best = rows.groupBy(entity, "model").agg(F.max(F.struct(worked.alias("_w"), *payload)).alias("s"))
    return best.select(entity, "model", *[F.col(f"s.{c}").alias(c) for c in payload])


def run_reports(
    store: RunStore, entity: str = "industry", period: str = "year", labels: DataFrame | Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """The report tables of a stored run, each built when it is asked for."""
    forecasts = store.read("forecasts")
    best = store.read("best")
    metrics = forecast_metrics(forecasts, [entity, "model", "split"])
    have = [r[0] for r in best.select("model").distinct().orderBy("model").collect()]
    pairs = [p for p in COMPARISONS if set(p) <= set(have)] or ([tuple(have[:2])] if len(have) > 1 else [])
    out = {
        "status": latest_status(store, entity),
        "metrics": rp.mark_best(metrics, "RMSE", [entity, "split"]),
        "information": rp.ic_report(information_table(best, entity), [entity]),
    }
    if "shock" in forecasts.columns:
        out["timeline"] = rp.forecast_timeline(forecasts, entity, period)
    if pairs:
        out["comparisons"] = rp.dm_report(diebold_mariano(forecasts.filter("split = 'test'"), pairs, [entity], period))
    folds, irf = store.read("cv_folds"), store.read("irf")
    if folds is not None:
        out["folds"] = rp.cv_report(folds, METRICS, [entity, "model"])
        out["fold_averages"] = cv_average(folds, [entity, "model"], METRICS)
    if irf is not None:
        out["responses"] = rp.irf_report(irf, [entity])
    if labels is not None:
        out["grid"] = rp.cross_entity_grid(metrics, "RMSE", have, labels, "test", entity)
    return out


__all__ = ["entity_models", "latest_status", "run_reports", "run_status", "run_stored"]
