"""Brute-force versions of the library's joins, for small fixtures and the bench baseline."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def brute_force_join(left: DataFrame, right: DataFrame, threshold: int = 5, left_id: str = "id", right_id: str = "id",
                     fp: str = "fp", order: str | None = None) -> DataFrame:
    """The Hamming join as a theta join: every pair is compared."""
    l = left.select(F.col(left_id).alias("l_id"), F.col(fp).alias("l_fp"))
    r = right.select(F.col(right_id).alias("r_id"), F.col(fp).alias("r_fp"))
    cond = F.bit_count(F.col("l_fp").bitwiseXOR(F.col("r_fp"))) <= threshold
    if order == "lt":
        cond = cond & (F.col("l_id") < F.col("r_id"))
    return (l.join(r, cond)
            .select("l_id", "l_fp", "r_id", "r_fp", F.bit_count(F.col("l_fp").bitwiseXOR(F.col("r_fp"))).cast("int").alias("distance")))
