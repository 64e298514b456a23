"""Train/test and fold assignment that depends on the key alone.

A random split draws per partition, so the same customer can change sides when
the partitioning does, or when a lost partition is recomputed. Here the side is
a function of the key's MD5, which any engine can reproduce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 10_000


def key_slot(key: str, seed: int) -> Column:
    """A number in [0, 10000) from the key and the seed."""
    digest = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(SLOTS)).cast("int")


def in_train(key: str, seed: int, share: float = 0.7) -> Column:
    return key_slot(key, seed) < F.lit(round(share * SLOTS))


def train_test(df: DataFrame, key: str, seed: int, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    chosen = in_train(key, seed, share)
    return df.where(chosen), df.where(~chosen)


def random_train_test(df: DataFrame, seed: int, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Spark's own random split, for callers who accept its dependence on partitions."""
    train, test = df.randomSplit([share, 1 - share], seed=seed)
    return train, test


def with_folds(df: DataFrame, key: str, seed: int, folds: int, name: str = "fold") -> DataFrame:
    return df.withColumn(name, F.pmod(key_slot(key, seed), F.lit(folds)).cast("int"))
