"""The batch job: one Spark application from tables to reports.

    python -m ledgerspark.plans.run --sf-dir /root/testdata/sf0.1 --adapter lineitem --out /shared/out

Steps: load (adapter, or ``--transactions``/``--users`` Parquet tables) ->
train the three models (I16) -> predictions (I19) -> recommendations (J7)
-> explanations (K10) -> month summaries (D1) -> write every output as
Parquet (metrics as JSON, models with the ``pyspark.ml`` writers). Lineage
is cut in the shared folder named by ``spark.checkpoint.dir``; outputs are
written with the committer, so a lost executor re-runs tasks, not the job.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json


from ..operators import summary as D
from ..session import checkpoint_dir, get_spark
from ..sources import files as IO
from ..sources.adapters import ADAPTERS, Ledger
from . import jobs


def load(spark, args) -> Ledger:
    if args.transactions:
        txn = spark.read.parquet(args.transactions)
        users = spark.read.parquet(args.users)
        as_of = dt.date.fromisoformat(args.as_of) if args.as_of else dt.date.today()
        return Ledger(txn, users, as_of)
    led = ADAPTERS[args.adapter](spark, args.sf_dir)
    if args.as_of:
        led.as_of = dt.date.fromisoformat(args.as_of)
    return led


def run(spark, led: Ledger, out: str, num_trees: int = 200, risk_iters: int = 150, folds: int = 5,
        forecast_days: int = 30, forecast_model: str = "ridge") -> dict:
    checkpoint_dir(spark)
    models = jobs.train_all(led.txn, led.users, num_trees=num_trees, risk_iters=risk_iters, folds=folds,
                            forecast_model=forecast_model)
    IO.metrics_sink(spark, models.metrics, f"{out}/metrics")
    IO.save_models(
        f"{out}/models",
        {"category": models.category.pipeline, "merchant_index": models.category.merchant_index,
         "risk": models.risk.pipeline, "forecast": models.forecast.pipeline},
        {"risk_features": models.risk.features, "risk_importances": models.risk.importances,
         "category_importances": models.category.importances, "metrics": models.metrics},
    )
    jobs.prediction_report(led.txn, led.users, models, forecast_days).write.mode("overwrite").parquet(
        f"{out}/predictions")
    rollup = jobs.shared_rollup(led.txn)
    recs = jobs.recommendation_job(led.txn, led.users, led.as_of, models, rollup=rollup)
    recs.write.mode("overwrite").parquet(f"{out}/recommendations")
    jobs.explain_report(led.txn, led.users, led.as_of, models).write.mode("overwrite").parquet(
        f"{out}/explanations")
    D.month_summary(led.txn, led.users, led.as_of).write.mode("overwrite").parquet(f"{out}/month_summary")
    D.monthly_summaries(led.txn).write.mode("overwrite").parquet(f"{out}/monthly_summaries")
    return models.metrics


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--adapter", choices=sorted(ADAPTERS), default="lineitem")
    ap.add_argument("--transactions", help="Parquet transactions table (instead of an adapter)")
    ap.add_argument("--users", help="Parquet users table (with --transactions)")
    ap.add_argument("--as-of", help="report date, yyyy-MM-dd")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--trees", type=int, default=200)
    ap.add_argument("--risk-iters", type=int, default=150)
    ap.add_argument("--folds", type=int, default=5)
    ap.add_argument("--forecast-days", type=int, default=30)
    ap.add_argument("--forecast-model", choices=["ridge", "seasonal"], default="ridge")
    args = ap.parse_args(argv)
    spark = get_spark(app="ledgerspark-batch")
    metrics = run(spark, load(spark, args), args.out.rstrip("/"), args.trees, args.risk_iters, args.folds,
                  args.forecast_days, args.forecast_model)
    print(json.dumps(metrics, default=str))


if __name__ == "__main__":
    main()
