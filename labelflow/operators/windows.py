"""Order-dependent operators that stay distributed when one group holds most of the rows.

``running_sums`` computes exact cumulative sums over an ordered group without putting the whole
group into one window partition: rows are range-partitioned on (group, order), each range
partition computes its local running sums, and a tiny table of per-partition totals (at most
#partitions + #groups rows) supplies the offsets through a broadcast join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.operators.common import materialize


def _order_col(c: str, descending: bool) -> Column:
    return F.col(c).desc() if descending else F.col(c).asc()


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def running_agg(df: DataFrame, keys: list[str], order: list[str], values: list[str], fn: str = "sum",
                descending: bool = False, exclusive: bool = False, partitions: int | None = None,
                suffix: str | None = None, totals: bool = False) -> DataFrame:
    """Adds ``<v><suffix>`` = fn (sum/min/max) of v over the rows of the same key group that come
    before the current one in ``order`` (and the current one unless ``exclusive``). ``order`` must
    make rows unique within a group for a deterministic result (collapse ties first). ``totals`` adds
    ``<v>_total``, fn over the whole group, from the same small table that holds the offsets."""
    spark = df.sparkSession
    agg = _AGG[fn]
    suffix = suffix or f"_{'x' if exclusive else ''}{'cum' if fn == 'sum' else 'run' + fn}"
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ords = [F.col(k).asc() for k in keys] + [_order_col(o, descending) for o in order]
    # materialised once (reliable checkpoint): range bounds come from sampling, so the partition id
    # must be fixed before the two branches below read it
    d = materialize(df.repartitionByRange(n, *ords).withColumn("_pid", F.spark_partition_id()))
    local_w = (Window.partitionBy("_pid", *keys).orderBy(*[_order_col(o, descending) for o in order])
               .rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow))
    local = d.select("*", *[agg(v).over(local_w).alias(f"_l_{v}") for v in values])
    part_totals = d.groupBy("_pid", *keys).agg(*[agg(v).alias(f"_t_{v}") for v in values])
    prev_w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_totals.select("_pid", *keys, *[agg(f"_t_{v}").over(prev_w).alias(f"_o_{v}") for v in values],
                                 *[agg(f"_t_{v}").over(Window.partitionBy(*keys)).alias(f"{v}_total") for v in values if totals])
    # offsets has at most (#range partitions + #groups) rows: a range partition covers a contiguous
    # key range, so the broadcast size is bounded by the partition count, not by the data
    j = local.join(F.broadcast(offsets), ["_pid", *keys])

    def comb(v):
        l, o = F.col(f"_l_{v}"), F.col(f"_o_{v}")
        if fn == "sum":
            return F.coalesce(l, F.lit(0)) + F.coalesce(o, F.lit(0))
        pick = F.least if fn == "min" else F.greatest
        return pick(l, o)  # least/greatest skip nulls
    return j.select(*df.columns, *[comb(v).alias(f"{v}{suffix}") for v in values], *[f"{v}_total" for v in values if totals])


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: list[str], descending: bool = True,
                 partitions: int | None = None, suffix: str = "_cum", totals: bool = False) -> DataFrame:
    """Cumulative sums (inclusive) per key group in ``order`` (see running_agg)."""
    return running_agg(df, keys, order, values, "sum", descending, False, partitions, suffix, totals)


def consecutive_ids(df: DataFrame, order: list[str], name: str = "row_id", start: int = 0,
                    keys: list[str] | None = None) -> DataFrame:
    """Dense consecutive ids (start, start+1, ...) in a declared order, optionally per key group,
    without a single-partition window (the running-sum scheme above on a constant 1)."""
    keys = keys or []
    d = df.withColumn("_one", F.lit(1))
    r = running_sums(d, keys, order, ["_one"], descending=False)
    return r.withColumn(name, (F.col("_one_cum") - 1 + start).cast("long")).drop("_one", "_one_cum")
