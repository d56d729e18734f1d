"""Column expressions over array<float|double> vectors; all arithmetic is done in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(df: DataFrame, vec_col: str, zero: str = "keep") -> DataFrame:
    """Scale each vector to unit length as float32.

    ``zero="keep"`` leaves an all-zero vector as it is, ``zero="nan"`` gives NaN entries as a plain
    division does.
    """
    length = F.col("__len")
    scaled = F.transform(as_double(F.col(vec_col)), lambda x: x / length)
    if zero == "keep":
        out = F.when(length == 0.0, as_double(F.col(vec_col))).otherwise(scaled)
    else:
        out = F.when(
            length == 0.0, F.transform(F.col(vec_col), lambda _: F.lit(float("nan")))
        ).otherwise(scaled)
    return (
        df.withColumn("__len", norm(F.col(vec_col)))
        .withColumn(vec_col, out.cast("array<float>"))
        .drop("__len")
    )


def profile(df: DataFrame, vec_col: str, by: list[str]) -> DataFrame:
    """Count, dimension range and float32 bytes per group."""
    dim = F.size(vec_col).cast("long")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.min(dim).alias("min_dim"),
        F.max(dim).alias("max_dim"),
        F.sum(dim * 4).alias("float32_bytes"),
    )


def group_means(df: DataFrame, vec_col: str, by: str) -> DataFrame:
    """Mean vector per group; partial sums are merged before the shuffle, no vector is exploded."""
    return (
        df.groupBy(by)
        .agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("__m"))
        .select(by, vector_to_array("__m").alias("centroid"))
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_f32(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to a vector."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(T.BinaryType())
def encode_f32(vec: pd.Series) -> pd.Series:
    return vec.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
