"""File sources and sinks (ops A1, A9, A10, A11, H25)."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.scalars import parse_amount, parse_date
from . import versions


CSV_REQUIRED = ["date", "amount", "category"]
CSV_OPTIONAL = ["merchant", "description"]


def csv_source(spark: SparkSession, path: str, user_id: int | None = None, batch_id: str | None = None) -> DataFrame:
    """A1: a transaction CSV with a header naming ``date, amount, category``
    and optionally ``merchant, description``, in any order. Columns are
    matched by header name (as the upload does), every value is read as a
    string (no inference pass over the data), blank lines are skipped, a
    missing optional column or an empty value is NULL. Returns the raw
    upload shape for A2; a missing required column is an error."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    missing = [c for c in CSV_REQUIRED if c not in names]
    if missing:
        raise ValueError(f"CSV is missing required columns: {missing}")

    def pick(name):
        return F.col(f"`{names[name]}`").cast("string") if name in names else F.lit(None).cast("string")

    return raw.select(
        (F.lit(batch_id) if batch_id is not None else F.input_file_name()).cast("string").alias("batch_id"),
        F.lit(None if user_id is None else str(user_id)).cast("string").alias("user_id"),
        pick("date").alias("date"),
        pick("amount").alias("amount"),
        pick("category").alias("category"),
        F.nullif(pick("merchant"), F.lit("")).alias("merchant"),
        F.nullif(pick("description"), F.lit("")).alias("description"),
    )


def typed_csv(raw: DataFrame) -> DataFrame:
    """A1 typing: date and amount parsed, NULL where they do not parse."""
    return raw.withColumns({"date": parse_date("date"), "amount": parse_amount("amount")})


def csv_sink(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Transactions as CSV with a header (no index column)."""
    cols = [c for c in ("date", "amount", "category", "merchant", "description") if c in df.columns]
    out = df.select(*cols).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    out.write.mode(mode).option("header", True).csv(path)


def metrics_sink(spark: SparkSession, metrics: dict, path: str) -> DataFrame:
    """A10 + G3: one-row metrics document written as JSON (later keys win)."""
    merged: dict = {}
    for k, v in metrics.items():
        merged[k] = v
    df = spark.createDataFrame([tuple(merged.values())], list(merged.keys())) if merged else spark.range(0)
    df.coalesce(1).write.mode("overwrite").json(path)
    return df


def missing(spark: SparkSession, path: str) -> bool:
    """Whether nothing exists at ``path``; any other trouble is raised when reading."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return True
        raise
    return False


def metrics_source(spark: SparkSession, path: str) -> dict:
    """A10: the metrics document back as a dict; empty when missing."""
    if missing(spark, path):
        return {}
    rows = spark.read.json(path).limit(1).collect()
    return rows[0].asDict() if rows else {}


def merge_metrics(*docs: dict) -> dict:
    """Merge metric maps, later keys win."""
    out: dict = {}
    for d in docs:
        out.update(d or {})
    return out


def _kinds() -> dict:
    """How each kind of stored model is read."""
    from pyspark.ml import PipelineModel

    from ..operators.forecast_users import UserRidge, UserSeasonal
    from ..operators.models import MerchantIndex

    return {
        "pipeline": lambda spark, path: PipelineModel.load(path),
        "merchant_index": MerchantIndex.load,
        "user_ridge": UserRidge.load,
        "user_seasonal": UserSeasonal.load,
    }


def _kind(model) -> str:
    name = type(model).__name__
    return {"MerchantIndex": "merchant_index", "UserRidge": "user_ridge", "UserSeasonal": "user_seasonal"}.get(name, "pipeline")


def save_models(path: str, models: dict, meta: dict) -> None:
    """A new version of the model store. Every fitted model goes to a folder of the
    version; the version is published when all are written, with the metadata (feature
    lists, importances, metrics). Until then, and if the job dies, readers get the set
    before."""
    path = path.rstrip("/")
    spark = SparkSession.getActiveSession()
    folder = versions.new_name()
    kinds = {}
    for name, m in models.items():
        if m is None:
            continue
        target = f"{path}/{folder}/{name}"
        if hasattr(m, "write"):
            m.write().save(target)  # pyspark.ml models
        else:
            m.save(target)  # tables such as the merchant index
        kinds[name] = _kind(m)
    doc = {"folder": folder, "models": kinds, "meta": json.loads(json.dumps(meta, default=str))}
    for _ in range(5):
        try:
            return versions.publish(spark, path, versions.latest(spark, path)[0] + 1, doc)
        except versions.VersionConflict:  # another job published; this set is the newer one
            continue
    raise versions.VersionConflict(path)


def load_models(spark: SparkSession, path: str, names: list[str]) -> tuple[dict, dict]:
    """The models of the newest whole version (one that is not in it -> None, heuristic
    mode I18; a damaged one fails the job) and its metadata."""
    path = path.rstrip("/")
    read = _kinds()
    doc = versions.latest(spark, path)[1]
    if doc is not None:
        models = {n: read[doc["models"][n]](spark, f"{path}/{doc['folder']}/{n}") if n in doc["models"] else None for n in names}
        return models, doc["meta"]
    for n in names:  # a folder without a version is no empty store
        if not missing(spark, f"{path}/{n}"):
            raise ValueError(f"{path} holds {n}, but no published version")
    return dict.fromkeys(names), {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder next to the shared checkpoint folder for written tables."""
    from ..session import checkpoint_dir

    base = checkpoint_dir(spark)
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set: no shared folder for written tables")
    return os.path.join(base, "tables", name)
