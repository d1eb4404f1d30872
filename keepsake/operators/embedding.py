"""Vectors for texts: an encoder of the caller's, or hashed words."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions import text as tx


def hashed(rows: DataFrame, text_col: str, dims: int = 384, out: str = "embedding") -> DataFrame:
    """Unit vectors of hashed word counts, computed by Spark's own feature stages."""
    words = rows.withColumn("_w", F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_w", "_tf", "_unit")


def encoded(rows: DataFrame, text_col: str, encoder: Callable, chunk: int = 64, out: str = "embedding", retries: int = 2) -> DataFrame:
    """Vectors by ``encoder(list of texts) -> 2-d array``, in chunks inside the tasks.

    Equal texts are encoded once.
    """
    distinct = rows.select(F.col(text_col).alias("_text")).distinct()
    schema = T.StructType([T.StructField("_text", T.StringType()), T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for a in range(0, len(texts), chunk):
                part = texts[a : a + chunk]
                for attempt in range(retries + 1):
                    try:
                        vectors = encoder(part)
                        break
                    except Exception:
                        if attempt == retries:
                            raise
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))], names=["_text", out]
                )

    return rows.join(distinct.mapInArrow(run, schema), rows[text_col] == F.col("_text"), "left").drop("_text")
