"""Control charts as tables, and the constants they need."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidymesh.operators.group import _known
from tidymesh.table import Table, add_pipe, named, verb


def c_sd(n: float) -> float:
    """Expected sample deviation of ``n`` normal values over the true one."""
    return math.sqrt(2 / (n - 1)) * math.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2))


def B3(n: float) -> float:
    """Lower limit of a chart of deviations over their mean."""
    return max(0.0, 1 - 3 / c_sd(n) * math.sqrt(1 - c_sd(n) ** 2))


def B4(n: float) -> float:
    return 1 + 3 / c_sd(n) * math.sqrt(1 - c_sd(n) ** 2)


def _c4(n):
    """c_sd as a column, by lgamma's series far from 0 (shifted by 7)."""

    def lg(z):
        y = z + 7
        shift = F.ln(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6))
        return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift

    return F.sqrt(2 / (n - 1)) * F.exp(lg(n / 2) - lg((n - 1) / 2))


@verb
def tran_xbs(df: Table, group: Any, var: Any, n_side: int = 9, n_delta: int = 6) -> Table:
    """The table of an X-bar and S chart: for each group and each of the two charts its value, centre and limits, whether
    it is outside, one of ``n_side`` or more in a row on one side of the centre, or one of ``n_delta`` or more that rise
    or fall in a row, and a glyph that says which.

    Groups are aggregated first; the windows then run over groups (as many as the chart has points), not rows.
    """
    g, v = named(group), F.col(f"`{named(var)}`")
    stats = _known(df.df, [g]).groupBy(F.col(f"`{g}`")).agg(F.avg(v).alias("X"), F.stddev_samp(v).alias("S"), F.count(v).cast("double").alias("n"))
    whole = stats.agg(F.avg("X").alias("mx"), F.avg("S").alias("ms"), F.avg("n").alias("mn"))
    c4 = _c4(F.col("mn"))
    half = 3 * F.col("ms") / (c4 * F.sqrt("mn"))
    spread = 3 / c4 * F.sqrt(1 - c4 * c4)
    limits = whole.select(
        F.struct(F.col("mx").alias("c"), (F.col("mx") - half).alias("lo"), (F.col("mx") + half).alias("up")).alias("lim_x"),
        F.struct(F.col("ms").alias("c"), (F.col("ms") * F.greatest(1 - spread, F.lit(0.0))).alias("lo"), (F.col("ms") * (1 + spread)).alias("up")).alias("lim_s"),
    )
    both = stats.crossJoin(F.broadcast(limits))  # one row
    rows = F.explode(F.array(F.struct(F.lit("X").alias("_var"), F.col("X").alias("_value"), F.col("lim_x").alias("l")), F.struct(F.lit("S").alias("_var"), F.col("S").alias("_value"), F.col("lim_s").alias("l"))))
    long = both.select(F.col(f"`{g}`"), rows.alias("r")).select(g, "r._var", "r._value", F.col("r.l.c").alias("_center"), F.col("r.l.lo").alias("_lo"), F.col("r.l.up").alias("_up"))
    order = Window.partitionBy("_var").orderBy(g)
    side = F.signum(F.col("_value") - F.col("_center"))
    rise = F.signum(F.col("_value") - F.lag("_value").over(order))
    long = long.withColumn("__side", side).withColumn("__rise", rise)
    for name in ("__side", "__rise"):
        long = long.withColumn(f"{name}_new", F.coalesce((F.col(name) != F.lag(name).over(order)).cast("int"), F.lit(1)))
        long = long.withColumn(f"{name}_run", F.sum(f"{name}_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        long = long.withColumn(f"{name}_n", F.count(F.lit(1)).over(Window.partitionBy("_var", f"{name}_run")))
    outlier = (F.col("_value") < F.col("_lo")) | (F.col("_value") > F.col("_up"))
    below = F.coalesce((F.col("__side_n") >= n_side) & (F.col("__side") != 0), F.lit(False))
    # a run of changes of one sign joins one point more than it has changes
    trend = F.coalesce((F.col("__rise_n") >= n_delta - 1) & (F.col("__rise") != 0), F.lit(False))
    glyph = F.when(outlier, "Below Limit").when(below, f"{n_side} Consecutive Same Side").when(trend, f"{n_delta} Consecutive Trend").otherwise("None")
    glyph = F.when(F.col("_value") > F.col("_up"), "Above Limit").otherwise(glyph)
    return Table(long.select(g, "_var", "_value", "_center", "_lo", "_up", outlier.alias("_outlier"), below.alias("_run"), trend.alias("_trend"), glyph.alias("_glyph")))


tf_xbs = add_pipe(tran_xbs)
