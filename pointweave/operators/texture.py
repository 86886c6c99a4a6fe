"""Texture of regions: co-occurrence of grey levels with the thirteen Haralick values, and gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Half of the eight neighbours; the other half counts by symmetry.
OFFSETS = [(0, 1), (1, 0), (1, 1), (1, -1)]
NAMES = [
    "asm", "contrast", "correlation", "sum_of_squares", "idm", "sum_average", "sum_variance", "sum_entropy", "entropy",
    "difference_variance", "difference_entropy", "imc1", "imc2",
]


def cooccurrence(pix: DataFrame, key: str, v: str, levels: int = 16, top: int = 256) -> DataFrame:
    """(key, i, j, p): share of neighbouring pixels of a region with the grey levels i and j, both ways counted.

    Levels from 0 to top - 1 fall into so many equal bins. Pairs are one join on places; the counts of a region are at
    most levels^2 rows.
    """
    level = F.floor(F.col(v) * levels / top).cast("int")
    here = pix.select(F.col(key), "py", "px", level.alias("i"))
    moved = here.select(key, F.col("i").alias("j"), F.inline(F.array(*[F.struct((F.col("py") + a).alias("py"), (F.col("px") + b).alias("px")) for a, b in OFFSETS])))
    pairs = here.join(moved, [key, "py", "px"]).groupBy(key, "i", "j").agg(F.count("*").alias("n"))
    both = pairs.unionAll(pairs.select(key, F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy(key, "i", "j").agg(F.sum("n").alias("n"))
    return both.select(key, "i", "j", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("p"))


def haralick(pix: DataFrame, key: str, v: str, levels: int = 16, top: int = 256) -> DataFrame:
    """The thirteen Haralick values of each region (key, py, px, v); regions without neighbouring pixels have no row.

    Entropies are in bits. Correlation and the first information measure are 0 where their divisor is 0.
    """
    p = cooccurrence(pix, key, v, levels, top)
    plog = lambda c: -F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(c)).otherwise(0.0))
    side = p.groupBy(key, F.col("i").alias("k")).agg(F.sum("p").alias("m"))
    margins = side.groupBy(key).agg(F.sum(F.col("k") * F.col("m")).alias("mu"), F.sum(F.col("k") * F.col("k") * F.col("m")).alias("sq"), plog("m").alias("hx"))
    sums = p.groupBy(key, (F.col("i") + F.col("j")).alias("k")).agg(F.sum("p").alias("m"))
    sums = sums.groupBy(key).agg(F.sum(F.col("k") * F.col("m")).alias("sum_average"), F.sum(F.col("k") * F.col("k") * F.col("m")).alias("sum_sq"), plog("m").alias("sum_entropy"))
    gaps = p.groupBy(key, F.abs(F.col("i") - F.col("j")).alias("k")).agg(F.sum("p").alias("m"))
    gaps = gaps.groupBy(key).agg(F.sum(F.col("k") * F.col("m")).alias("gap"), F.sum(F.col("k") * F.col("k") * F.col("m")).alias("contrast"), plog("m").alias("difference_entropy"))
    # the cross entropies of the table and of its margins' product with the margins
    m = p.join(side.select(key, F.col("k").alias("i"), F.col("m").alias("mi")), [key, "i"]).join(side.select(key, F.col("k").alias("j"), F.col("m").alias("mj")), [key, "j"])
    whole = m.groupBy(key).agg(
        F.sum(F.col("p") * F.col("p")).alias("asm"), F.sum(F.col("p") / (1 + (F.col("i") - F.col("j")) * (F.col("i") - F.col("j")))).alias("idm"),
        F.sum(F.col("i") * F.col("j") * F.col("p")).alias("ij"), plog("p").alias("entropy"),
        (-F.sum(F.col("p") * F.log2(F.col("mi") * F.col("mj")))).alias("hxy1"),
    )
    var = F.col("sq") - F.col("mu") * F.col("mu")
    hxy2 = 2 * F.col("hx")
    ratio = lambda a, b: F.when(F.abs(b) < 1e-12, 0.0).otherwise(a / b)
    out = whole.join(margins, key).join(sums, key).join(gaps, key)
    return out.select(
        key, "asm", "contrast", ratio(F.col("ij") - F.col("mu") * F.col("mu"), var).alias("correlation"), var.alias("sum_of_squares"), "idm",
        "sum_average", (F.col("sum_sq") - F.col("sum_average") * F.col("sum_average")).alias("sum_variance"), "sum_entropy", "entropy",
        (F.col("contrast") - F.col("gap") * F.col("gap")).alias("difference_variance"), "difference_entropy",
        ratio(F.col("entropy") - F.col("hxy1"), F.col("hx")).alias("imc1"),
        F.sqrt(F.greatest(1 - F.exp(-2 * (hxy2 - F.col("entropy"))), F.lit(0.0))).alias("imc2"),
    )


def gradient(pix: DataFrame, v: str) -> DataFrame:
    """pix with gradient, the length of the slope of v: central differences, one-sided at the ends of a row or column."""

    def slope(along, across):
        line = Window.partitionBy(across).orderBy(along)
        before, after = F.coalesce(F.lag(v).over(line), F.col(v)), F.coalesce(F.lead(v).over(line), F.col(v))
        first, last = F.coalesce(F.lag(along).over(line), F.col(along)), F.coalesce(F.lead(along).over(line), F.col(along))
        return F.coalesce(F.try_divide((after - before).cast("double"), last - first), F.lit(0.0))

    steep = pix.withColumn("_y", slope("py", "px")).withColumn("_x", slope("px", "py"))
    return steep.withColumn("gradient", F.sqrt(F.col("_y") * F.col("_y") + F.col("_x") * F.col("_x"))).drop("_y", "_x")
