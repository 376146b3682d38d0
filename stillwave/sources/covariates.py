"""Covariates of subjects and the name/value settings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

COVARIATE_SCHEMA = "age double, sex string, height double, weight double, subject string"


def read_covariates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=COVARIATE_SCHEMA, header=True)


def _complete(names: Sequence[str]) -> Column:
    whole = F.lit(True)
    for n in names:
        text = F.trim(F.col(n).cast("string"))
        whole = whole & text.isNotNull() & (text != "")
    return whole


def rejected_subjects(settings: DataFrame, covariates: DataFrame, names: Sequence[str]) -> DataFrame:
    """Subjects in the settings without covariates, or with a blank one, and why."""
    known = covariates.select("subject", _complete(names).alias("_whole"))
    joined = settings.select("subject").distinct().join(known, "subject", "left")
    return joined.filter(~F.coalesce("_whole", F.lit(False))).select(
        "subject", F.when(F.col("_whole").isNull(), "no covariates").otherwise("blank covariate").alias("reason"))


def upsert_settings(settings: DataFrame, covariates: DataFrame, names: Sequence[str]) -> DataFrame:
    """Set the named settings of every subject with complete covariates; drop the other subjects."""
    complete = covariates.filter(_complete(names))
    new = complete.select("subject", *[F.col(n).cast("string").alias(n) for n in names]).unpivot(
        ["subject"], list(names), "settingName", "_new")
    kept = settings.join(complete.select("subject"), "subject", "left_semi")
    return kept.join(new, ["subject", "settingName"], "left").select(
        "subject", "settingName", F.coalesce("_new", "settingValue").alias("settingValue"))
