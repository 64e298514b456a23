"""Encoding, scaling and assembling features as one short list of ML stages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FeaturePlan:
    """Which columns become features.

    One indexer, one encoder, one scaler and two assemblers cover any number of
    columns, where a stage pair per column would add a scan per fitted stage.
    """

    categorical: tuple[str, ...]
    numeric: tuple[str, ...]

    def stages(self) -> list:
        result: list = []
        inputs: list[str] = []
        if self.categorical:
            index = [f"{c}_idx" for c in self.categorical]
            hot = [f"{c}_vec" for c in self.categorical]
            result += [
                StringIndexer(
                    inputCols=list(self.categorical),
                    outputCols=index,
                    handleInvalid="skip",
                    stringOrderType="frequencyDesc",
                ),
                OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
            ]
            inputs += hot
        if self.numeric:
            result += [
                VectorAssembler(inputCols=list(self.numeric), outputCol="numeric_raw"),
                StandardScaler(inputCol="numeric_raw", outputCol="numeric_scaled", withStd=True, withMean=False),
            ]
            inputs.append("numeric_scaled")
        if not inputs:
            raise ValueError("no feature columns")
        return [*result, VectorAssembler(inputCols=inputs, outputCol="features")]


def string_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """Rank of each category by frequency (ties by name); NULL rows are skipped."""
    return _indexer(col, out).fit(df).transform(df)


def _indexer(col: str, out: str) -> StringIndexer:
    return StringIndexer(inputCol=col, outputCol=out, handleInvalid="skip", stringOrderType="frequencyDesc")


def scale_to_unit_std(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Vector of ``cols`` divided by their sample standard deviations, not centred."""
    raw = VectorAssembler(inputCols=list(cols), outputCol="_raw").transform(df)
    scaler = StandardScaler(inputCol="_raw", outputCol=out, withStd=True, withMean=False)
    return scaler.fit(raw).transform(raw).drop("_raw")


def vectors_only(fitted: Transformer, df: DataFrame, *keep: str) -> DataFrame:
    """The prepared vectors with the columns to keep, ready to be cached."""
    return fitted.transform(df).select(*keep, "features")
