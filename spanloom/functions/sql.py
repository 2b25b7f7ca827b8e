"""The functions of this package that run in Python, by name in a session's SQL.

* ``align(reference, hypothesis)``: a table function, a row (pos, tag, reference, hypothesis) for each edit operation;
* ``word_distance(reference, hypothesis)`` and ``edit_counts(reference, hypothesis)``: of two arrays of words, or two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .distance import _distances, _split, align


class Align:
    """A null array counts as an empty one."""

    def eval(self, reference: list[str], hypothesis: list[str]) -> Iterator[tuple[int, str, str | None, str | None]]:
        for pos, op in enumerate(align(reference or [], hypothesis or [])):
            yield pos, *op


def register(spark: SparkSession) -> SparkSession:
    """``spark``, whose SQL has these functions; again does no harm."""
    from ..shipping import ship

    ship(spark)
    spark.udtf.register("align", F.udtf(Align, returnType="pos int, tag string, reference string, hypothesis string", useArrow=True))
    spark.udf.register("word_distance", F.arrow_udf(_distances, "bigint"))
    spark.udf.register("edit_counts", F.arrow_udf(_split, "struct<hits:bigint,substitutions:bigint,deletions:bigint,insertions:bigint>"))
    return spark
