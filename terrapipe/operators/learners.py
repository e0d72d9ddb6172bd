"""Isotonic recalibration, fold by fold."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PROBABILITY_CLIP
from ..functions.agro import clipped


def each_fold(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Union of ``fit`` of the training and test rows of each ``fold``; folds without either are left out."""
    have = [{r.fold for r in d.select("fold").distinct().collect()} for d in (train, test)]
    found = [fit(train.where(F.col("fold") == k), test.where(F.col("fold") == k)) for k in sorted(have[0] & have[1])]
    if not found:
        raise ValueError("no usable folds")
    return reduce(DataFrame.unionByName, found)


def isotonic(train: DataFrame, test: DataFrame) -> DataFrame:
    """``p`` of test rows recalibrated by an isotonic fit of y on p in training rows."""
    model = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="iso").fit(train.where("y IS NOT NULL AND p IS NOT NULL"))
    return model.transform(test).withColumn("p", clipped(F.col("iso"), PROBABILITY_CLIP)).drop("iso")
