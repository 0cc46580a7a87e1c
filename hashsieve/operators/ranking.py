"""Running sums and positions inside groups without a whole-group window.

``Window.partitionBy(group)`` sends each group to one task; a batch or user
holding a third of all rows would be sorted by a single task.  Here:

1. range-partition by ``(group, order)``: a large group spans many partitions,
   equal keys stay together;
2. running sums inside each (partition, group) slice (a window over at most one
   partition's rows);
3. per (partition, group) totals, and for each slice the sum of the slices
   before it in the same group (a window over at most one row per partition);
4. join the offsets back.

The range-partitioned rows are checkpointed once, so every step sees the same
slice ids (a recomputed ``spark_partition_id`` could differ between branches).

The result equals a ``ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW`` window
over the whole group (rows with equal order keys get distinct positions, as
with ``row_number``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_within(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column],
                   firsts: list[str] | None = None, partitions: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` names the columns that travel besides group, order and sums (None: all of them).

    Add ``<name>`` = running sum of each ``sums[name]`` (inclusive), ``<name>_total``
    = its group total, and ``<col>_first`` = the group minimum of each ``firsts`` column."""
    firsts = firsts or []
    d = df.withColumns({f"_v_{k}": v for k, v in sums.items()})
    if keep is not None:
        d = d.select(list(dict.fromkeys([*group, *order, *firsts, *keep, *(f"_v_{k}" for k in sums)])))
    keys = [F.col(c) for c in group + order]
    d = (d.repartitionByRange(partitions, *keys) if partitions else d.repartitionByRange(*keys))
    # the slice id must be the same in both uses below: materialise it once
    d = cut_lineage(d.withColumn("_pid", F.spark_partition_id()))
    slice_keys = ["_pid", *group]
    w_local = Window.partitionBy(*slice_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = d.withColumns({f"_l_{k}": F.sum(f"_v_{k}").over(w_local) for k in sums})
    tot = d.groupBy(*slice_keys).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums],
                                     *[F.min(c).alias(f"_m_{c}") for c in firsts])
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    off = tot.select(*slice_keys,
                     *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
                     *[F.sum(f"_t_{k}").over(whole).alias(f"{k}_total") for k in sums],
                     *[F.min(f"_m_{c}").over(whole).alias(f"{c}_first") for c in firsts])
    out = local.join(off, slice_keys)
    out = out.withColumns({k: F.col(f"_l_{k}") + F.col(f"_o_{k}") for k in sums})
    drop = ["_pid"] + [f"_{p}_{k}" for k in sums for p in ("v", "l", "o")]
    return out.drop(*drop)
