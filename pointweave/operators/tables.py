"""Relational operators over nuclei, tiles and pixels: filters, lookups, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import kurtosis, skewness
from ..sources.storage import broadcast_if_small, materialize

TILE_KEYS = ["image_id", "tile_row", "tile_col"]


def with_tile(nuc: DataFrame, size: int = 1024) -> DataFrame:
    return nuc.withColumn("tile_row", F.floor(F.col("y") / size).cast("int")).withColumn(
        "tile_col", F.floor(F.col("x") / size).cast("int")
    )


def density_input(nuc: DataFrame, tiles: DataFrame, tissue: float = 0.25, size: int = 1024) -> DataFrame:
    """Nuclei of the tiles whose tissue share is above the limit."""
    good = tiles.where(F.col("tissue") > tissue).select(*TILE_KEYS)
    return with_tile(nuc, size).join(good, TILE_KEYS, "left_semi").drop("tile_row", "tile_col")


def shape_filter(nuc: DataFrame, eccentricity: float = 0.8, solidity: float = 0.9, area: float = 50) -> DataFrame:
    return nuc.where(
        (F.col("eccentricity") < eccentricity) & (F.col("solidity") > solidity) & (F.col("area") < area)
    )


def tile_grid(width: Column, height: Column, size: int) -> Column:
    """(row, col) of the whole tiles of a scene; parts at the right and bottom edge are left out."""
    rows, cols = F.floor(height / size).cast("int"), F.floor(width / size).cast("int")
    grid = F.transform(
        F.sequence(F.lit(0), F.greatest(rows, F.lit(1)) - 1),
        lambda r: F.transform(
            F.sequence(F.lit(0), F.greatest(cols, F.lit(1)) - 1), lambda c: F.struct(r.alias("row"), c.alias("col"))
        ),
    )
    return F.when((rows > 0) & (cols > 0), F.flatten(grid)).otherwise(F.array().cast("array<struct<row:int,col:int>>"))


NAME = r"^(.*)__R([0-9]+)_C([0-9]+)_TS([0-9]+)_OL([0-9]+)"


def tile_name_keys(name: Column) -> list[Column]:
    """Keys that tile names carry: scene, row, column, size and overlap; null where a name has another form."""
    part = lambda i: F.when(name.rlike(NAME), F.regexp_extract(name, NAME, i))
    return [part(1).alias("scene")] + [
        part(i).cast("int").alias(c) for i, c in enumerate(("tile_row", "tile_col", "tile_size", "overlap"), 2)
    ]


def boxes(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y")
    )


def tiles_in_boxes(tiles: DataFrame, box: DataFrame, margin: int, size: int = 1024) -> DataFrame:
    """Tiles strictly inside any box of their image grown by margin.

    A box is spread over the tiles that it touches, so the join is on tile keys and never on inequalities alone.
    """
    cells = (
        box.withColumn("tile_col", F.explode(F.sequence(F.floor((F.col("min_x") - margin) / size), F.floor((F.col("max_x") + margin) / size))))
        .withColumn("tile_row", F.explode(F.sequence(F.floor((F.col("min_y") - margin) / size), F.floor((F.col("max_y") + margin) / size))))
        .where(
            (F.col("tile_col") * size > F.col("min_x") - margin) & ((F.col("tile_col") + 1) * size < F.col("max_x") + margin)
            & (F.col("tile_row") * size > F.col("min_y") - margin) & ((F.col("tile_row") + 1) * size < F.col("max_y") + margin)
        )
        .select("image_id", F.col("tile_row").cast("int"), F.col("tile_col").cast("int"))
    )
    return tiles.join(cells, TILE_KEYS, "left_semi")


def join_positions(left: DataFrame, right: DataFrame, keys: list[str], decimals: int = 5) -> DataFrame:
    """Inner join on keys and on x and y rounded half to even; every pair of equal places is a row, as is x, y rounded."""
    near = lambda df: df.withColumns({c: F.bround(F.col(c).cast("double"), decimals) for c in ("x", "y")})
    return near(left).join(near(right), [*keys, "x", "y"])


def first_tiles(tiles: DataFrame, count: int = 5, tissue: float = 0.5, nuclei: int = 50) -> DataFrame:
    """The first tiles by image, row and column that hold enough tissue and nuclei."""
    good = tiles.where((F.col("tissue") > tissue) & (F.col("num_nuclei") > nuclei))
    return good.orderBy(*TILE_KEYS).limit(count)


def pyramid_level(levels: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """keys and level, width, height of the narrowest level at least as large as asked; images without one have no row."""
    fits = levels.where((F.col("width") >= width) & (F.col("height") >= height))
    at = F.min_by(F.struct("level", "width", "height"), F.struct("width", "level"))
    return fits.groupBy(*keys).agg(at.alias("_at")).select(*keys, "_at.*")


def match_ids(ids: DataFrame, known: DataFrame) -> DataFrame:
    """ids (id) with known_id: the id with -0 for -, else that and V0, whichever is among known (known_id); else null."""
    padded = F.replace(F.col("id"), F.lit("-"), F.lit("-0"))
    forms = ids.select("id", F.posexplode(F.array(padded, F.concat(padded, F.lit("V0")))).alias("form", "known_id"))
    found = forms.join(known.select("known_id").distinct(), "known_id").groupBy("id").agg(F.min_by("known_id", "form").alias("known_id"))
    return ids.join(found, "id", "left")


def point_lookup(points: DataFrame, raster: DataFrame, scale: float, value: str) -> DataFrame:
    """points with the raster value at their scaled, truncated position; null outside the raster."""
    at = raster.select(F.col("py").alias("_y"), F.col("px").alias("_x"), value)
    y, x = (F.col("y") * scale).cast("int"), (F.col("x") * scale).cast("int")
    return points.join(at, (y == F.col("_y")) & (x == F.col("_x")), "left").drop("_y", "_x")


def last_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One row for each key: the value that comes last in the order."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def object_intensity(pix: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """Minimum, maximum, truncated mean and truncated population deviation of a channel."""
    return pix.groupBy(*keys).agg(
        F.min(channel).alias("min_intensity"),
        F.max(channel).alias("max_intensity"),
        F.avg(channel).cast("int").alias("avg_intensity"),
        F.stddev_pop(channel).cast("int").alias("std_intensity"),
    )


def full_intensity(pix: DataFrame, keys: list[str], channel: str, bins: int = 10) -> DataFrame:
    """Order statistics, moments and histogram energy and entropy of a channel for each group.

    v_mad is the median absolute deviation from the group's median. Everything follows from the counts of a group's levels,
    so no group's pixels meet in one task; missing values count in the histogram only.
    """
    levels = materialize(pix.groupBy(*keys, F.col(channel).alias("_v")).agg(F.count("*").alias("_n")))
    of = lambda k: [F.col(c).alias(f"_{c}") for c in k]
    same = lambda df: [df[c].eqNullSafe(F.col(f"_{c}")) for c in keys]
    q = lambda p: F.percentile("_v", p, F.col("_n"))
    known = F.when(F.col("_v").isNotNull(), F.col("_n"))
    stats = levels.groupBy(*of(keys)).agg(
        F.min("_v").alias("v_min"), F.max("_v").alias("v_max"), (F.sum(F.col("_v") * F.col("_n")) / F.sum(known)).alias("v_mean"),
        q(0.5).alias("v_median"), (q(0.75) - q(0.25)).alias("v_iqr"), F.sum(known).cast("double").alias("_m"),
    )
    met = levels.join(broadcast_if_small(materialize(stats), 100_000), same(levels))
    off = F.col("_v") - F.col("v_mean")
    power = lambda k: (F.sum(off**k * F.col("_n")) / F.first("_m")).alias(f"_p{k}")
    fixed = ["v_min", "v_max", "v_mean", "v_median", "v_iqr", "_m"]
    out = met.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in fixed], *[power(k) for k in (2, 3, 4)],
        F.percentile(F.abs(F.col("_v") - F.col("v_median")), 0.5, F.col("_n")).alias("v_mad"),
    )
    m, p2 = F.col("_m"), F.col("_p2")
    skew = F.when((m > 2) & (p2 > 0), F.try_divide(F.col("_p3"), p2**1.5) * F.sqrt(m * (m - 1)) / (m - 2))
    g2 = F.try_divide(m - 1, (m - 2) * (m - 3)) * ((m + 1) * (F.try_divide(F.col("_p4"), p2 * p2) - 3) + 6)
    stats = out.select(
        *keys, "v_min", "v_max", "v_mean", "v_median", (F.col("v_mean") - F.col("v_median")).alias("v_mean_median"),
        F.sqrt("_p2").alias("v_std"), "v_iqr", skew.alias("v_skew"), F.when((m > 3) & (p2 > 0), g2).alias("v_kurt"), "v_mad",
    )
    width = 256 / bins
    share = levels.groupBy(*keys, F.floor(F.col("_v") / width).alias("bin")).agg(F.sum("_n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    hist = (
        share.withColumn("p", p)
        .groupBy(*keys)
        .agg(F.sum(F.col("p") * F.col("p")).alias("hist_energy"), (-F.sum(F.col("p") * F.log2("p"))).alias("hist_entropy"))
    )
    return stats.join(hist, keys)


def moments(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean, sample deviation, range, skewness and kurtosis of each column and the count; missing values are 0."""
    out = [F.count("*").alias("count")]
    for c in columns:
        out += [
            F.avg(c).alias(f"mean_{c}"),
            F.stddev_samp(c).alias(f"std_{c}"),
            (F.max(c) - F.min(c)).alias(f"range_{c}"),
            skewness(c).alias(f"skew_{c}"),
            kurtosis(c).alias(f"kurt_{c}"),
        ]
    return df.groupBy(*keys).agg(*out).na.fill(0)


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the mean of their column; the means are one row and are broadcast."""
    means = df.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(means))
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def correlations(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns as rows."""
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in left for b in right])
    pairs = F.array(*[F.struct(F.lit(a).alias("feature"), F.lit(b).alias("target"), F.col(f"{a}|{b}").alias("r")) for a in left for b in right])
    return one.select(F.inline(pairs))


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left join to the first of several right rows of a key."""
    value = [c for c in right.columns if c != key]
    one = right.groupBy(key).agg(F.min_by(F.struct(*value), order).alias("_v"))
    return left.join(one, key, "left").select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in value])


def largest_group(df: DataFrame, group: str, key: str) -> DataFrame:
    """The key with most rows of each group, the least one among equals."""
    n = df.groupBy(group, key).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.max_by(key, F.struct("n", -F.col(key))).alias(key), F.max("n").alias("n"))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Sum of a where b is set, as a share of all of a."""
    return F.try_divide(F.sum(a * b), F.sum(a))


def valid_scenes(scenes: DataFrame, valid: float) -> DataFrame:
    """Scenes whose magnification, cut to a whole number, is the valid one's."""
    return scenes.where(F.col("magnification").cast("int") == int(valid))


def tissue_density(pixels: DataFrame, nuclei: DataFrame, keys: list[str], mm: float, magnification: float) -> DataFrame:
    """(keys, fraction, nuclei, density) of superpixels: nuclei over their share of tissue times mm times magnification.

    pixels: keys, tissue (boolean). A superpixel without nuclei has density 0; one without tissue divides by 1e-8.
    """
    share = pixels.groupBy(*keys).agg(F.avg(F.col("tissue").cast("int")).alias("fraction"))
    found = nuclei.groupBy(*keys).agg(F.count("*").alias("nuclei"))
    out = share.join(found, keys, "left").na.fill(0, ["nuclei"])
    return out.withColumn("density", F.col("nuclei") / (F.col("fraction") * mm * magnification + 1e-8))


def numbered(df: DataFrame, keys: list[str], order: str, name: str, cuts: int = 64, then: tuple[str, ...] = ()) -> DataFrame:
    """df with name, 1 to N in the order of a numeric column and the columns then within each group; equal rows take any order.

    Rows are numbered within ranges of the column whose sizes are summed before, so no group is ordered in one task;
    where the ranges are cut changes nothing. Keys may be null and form a group of their own.
    """
    edges = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.percentile_approx(order, [i / cuts for i in range(1, cuts)]).alias("_cuts"))
    edges = broadcast_if_small(materialize(edges), 10_000)
    ranged = df.join(edges, [df[k].eqNullSafe(edges[f"_{k}"]) for k in keys])
    ranged = ranged.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).select(*df.columns, "_range")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "_range").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    starts = broadcast_if_small(materialize(starts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_in"), "_start")), 100_000)
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order, *then)) + F.col("_start")
    placed = ranged.join(starts, [*[ranged[k].eqNullSafe(starts[f"_{k}"]) for k in keys], ranged["_range"] == starts["_in"]])
    return placed.withColumn(name, place.cast("long")).select(*df.columns, name)


def subject_statistics(tiles: DataFrame, nuclei: DataFrame, dtfe: DataFrame, side: float, tissue: float, least: int) -> DataFrame:
    """One row for each image: mean and sample variance of the nuclei to a unit of tissue and of the density field.

    tiles: image_id, tile_row, tile_col, num_nuclei, tissue; only those over tissue and least count, side is a tile's
    length. nuclei: image_id, tile_row, tile_col, x, y; dtfe: image_id, x, y, dtfe. Nuclei of such tiles meet their
    density by place to one digit, where several meet all count. Images without such tiles have no row.
    """
    kept = tiles.where((F.col("tissue") > tissue) & (F.col("num_nuclei") > least))
    density = F.col("num_nuclei") / (F.col("tissue") * side * side)
    counts = kept.groupBy("image_id").agg(F.avg(density).alias("avg_nuclei_density"), F.var_samp(density).alias("var_nuclei_density"))
    inside = nuclei.join(kept.select("image_id", "tile_row", "tile_col"), ["image_id", "tile_row", "tile_col"], "left_semi")
    fields = join_positions(inside.select("image_id", "x", "y"), dtfe.select("image_id", "x", "y", "dtfe"), ["image_id"], 1)
    fields = fields.groupBy("image_id").agg(F.avg("dtfe").alias("avg_dtfe"), F.var_samp("dtfe").alias("var_dtfe"))
    return counts.join(fields, "image_id", "left")


def lookup(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """df with the columns of known; the query fails at a key that known does not have, null included."""
    found = df.join(known.withColumn("_known", F.lit(True)), key, "left")
    miss = F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.where(F.when(F.col("_known"), True).otherwise(miss.cast("boolean"))).drop("_known")


def aligned(parts: list[DataFrame], key: str) -> DataFrame:
    """Columns of all parts beside each other, one row for each key of any; numbers that a part lacks are 0."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "full")
    return out.na.fill(0)


def one_line(df: DataFrame) -> DataFrame:
    """df without line breaks in texts and column names; names without blanks at their ends."""
    breaks = "[\\r\\n]+"
    texts = {c for c, t in df.dtypes if t == "string"}
    tidy = lambda c: c.replace("\r", "").replace("\n", "").strip()
    value = lambda c: F.regexp_replace(f"`{c}`", breaks, "") if c in texts else F.col(f"`{c}`")
    return df.select(*[value(c).alias(tidy(c)) for c in df.columns])
