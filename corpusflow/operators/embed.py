"""VEC-1..3: embedding port, the default hashing embedder, mean pooling."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import text as tx
from corpusflow.functions import vectors as vx
from corpusflow.settings import EMBED_BATCH, EMBEDDING_DIM, PASSAGE_PREFIX


def embed(df: DataFrame, text_col: str, make_predict_fn: Callable, dim: int = EMBEDDING_DIM,
          batch_size: int = EMBED_BATCH, prefix: str = PASSAGE_PREFIX, out: str = "embedding_vector") -> DataFrame:
    """VEC-1: prefix, batch through the caller's model, normalise, check the dimension.

    ``make_predict_fn()`` runs once per worker and returns fn(array of str) -> 2-d float array.
    """
    from pyspark.ml.functions import predict_batch_udf
    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    raw = df.withColumn("_raw", predict(tx.with_prefix(text_col, prefix)))
    wrong = F.concat(F.lit(f"expected dimension {dim}, got "), F.size("_raw").cast("string"))
    checked = F.when(F.size("_raw") == dim, vx.l2_normalize("_raw").cast("array<float>")).otherwise(
        F.raise_error(wrong))
    return raw.withColumn(out, checked).drop("_raw")


def _histogram(dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vector(signed: pd.Series) -> pd.Series:
        import numpy as np
        floor = 1e-12

        def one(codes):
            if codes is None or len(codes) == 0:
                return np.zeros(dim)
            codes = np.asarray(codes)
            v = np.bincount(np.abs(codes) - 1, weights=np.sign(codes), minlength=dim)
            return v / max(float(np.sqrt((v * v).sum())), floor)

        return signed.map(one)

    return vector


def add_hash_vector(df: DataFrame, text_col: str, dim: int = EMBEDDING_DIM, out: str = "vector") -> DataFrame:
    """VEC-2: signed feature hashing of lower-cased words, L2-normalised.

    Words are hashed in the JVM; one integer per word goes through Arrow to be counted, in
    the text's own row.  Exploding the words instead would exchange up to ``dim`` rows a text.
    """
    def code(h):
        bucket = F.pmod(F.conv(F.substring(h, 1, 7), 16, 10).cast("int"), F.lit(dim)) + 1
        return F.when(F.substring(h, 8, 1) < "8", bucket).otherwise(-bucket)

    codes = F.transform(F.transform(tx.words(F.lower(F.col(text_col))), F.md5), code)
    return df.withColumn(out, _histogram(dim)(codes))


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = EMBEDDING_DIM) -> DataFrame:
    """VEC-2 as (id, vector)."""
    return add_hash_vector(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")), "_t", dim).drop("_t")


def mean_pool(tokens: DataFrame, id_col: str, vector_col: str, mask: Column | None = None) -> DataFrame:
    """VEC-3/AGG-11: (id, vector): mean of the unmasked token vectors, L2-normalised.

    Masked rows count as zero vectors with weight 0, so an id with no unmasked row gives a
    zero vector.  Partial sums are combined before the shuffle.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    on = F.lit(1.0) if mask is None else F.when(mask, F.lit(1.0)).otherwise(F.lit(0.0))
    rows = tokens.select(F.col(id_col).alias("id"), on.alias("on"), F.col(vector_col).alias("v"))
    values = F.col("v").cast("array<double>")
    masked = values if mask is None else F.transform(values, lambda x: x * F.col("on"))
    sums = rows.groupBy("id").agg(F.sum("on").alias("n"), Summarizer.sum(array_to_vector(masked)).alias("s"))
    mean = sums.select("id", "n", vector_to_array("s").alias("s"))
    mean = mean.withColumn("m", F.transform("s", lambda x: x / F.greatest(F.col("n"), F.lit(1.0))))
    return mean.select("id", vx.l2_normalize("m").alias("vector"))
