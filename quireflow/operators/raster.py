"""Operators on rasters as relations px(page, y, x, g), for probes and for checks of the dense kernels.

Each works page by page, so all windows and aggregations are partitioned by the
page; pixel-level windows are also partitioned by row or column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTRAST, DARKNESS_GATE, CONTRAST_GATE, TILE_BLOCKS, TILE_CONTENT, TILE_PIXELS, TILE_CONTRAST = 20.0, 0.15, 0.3, 64, 24, 50, 0.3
BAND, PAPER_FRACTION, SMOOTH_LIMIT = 20, 0.6, 0.08


def histogram(px: DataFrame) -> DataFrame:
    return px.groupBy("page", "g").agg(F.count("*").alias("n"))


def dense_histogram(px: DataFrame) -> DataFrame:
    """A row for each of a page's 256 levels."""
    bins = histogram(px)
    levels = bins.select("page").distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return levels.join(bins, ["page", "g"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _splits(px: DataFrame) -> DataFrame:
    """page, t, m0, m1, v: means of both sides of each threshold t and the between-class variance; best first by k."""
    below = Window.partitionBy("page").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("page")
    s = F.col("n") * F.col("g")
    sums = dense_histogram(px).select("page", F.col("g").alias("t"), F.sum("n").over(below).alias("c"), F.sum(s).over(below).alias("s"), F.sum("n").over(whole).alias("tot"), F.sum(s).over(whole).alias("sum"))
    sides = sums.where("t >= 1 and c > 0 and c < tot").select("page", "t", (F.col("s") / F.col("c")).alias("m0"), ((F.col("sum") - F.col("s")) / (F.col("tot") - F.col("c"))).alias("m1"), "c", "tot")
    gap = F.col("m0") - F.col("m1")
    v = F.col("c").cast("double") * (F.col("tot") - F.col("c")).cast("double") * gap * gap
    return sides.withColumn("v", v).withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("v"), "t"))).where("k = 1 and v > 0")


def otsu(px: DataFrame) -> DataFrame:
    """page, t: the smallest threshold of the largest between-class variance; 128 for a flat page."""
    return px.select("page").distinct().join(_splits(px).select("page", "t"), "page", "left").select("page", F.coalesce("t", F.lit(128)).alias("t"))


def class_means(px: DataFrame) -> DataFrame:
    """page, ink, paper of pages with two classes."""
    return _splits(px).select("page", F.col("m0").alias("ink"), F.col("m1").alias("paper"))


def paper_peak(px: DataFrame) -> DataFrame:
    """page, peak, mass, total: the level with the most pixels within 20 levels of it (the first of equals)."""
    band = Window.partitionBy("page").orderBy("g").rangeBetween(-BAND, BAND)
    mass = dense_histogram(px).select("page", "g", F.sum("n").over(band).alias("mass"), F.sum("n").over(Window.partitionBy("page")).alias("total"))
    best = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("mass"), "g"))
    return mass.withColumn("k", best).where("k = 1").select("page", F.col("g").alias("peak"), "mass", "total")


def smooth_midtone(px: DataFrame) -> DataFrame:
    """page, samples, smooth: grid points inside the page, and those of a middle level among four like neighbours."""
    row, column = Window.partitionBy("page", "y").orderBy("x"), Window.partitionBy("page", "x").orderBy("y")
    near = [F.lag("g").over(row), F.lead("g").over(row), F.lag("g").over(column), F.lead("g").over(column)]
    size = px.groupBy("page").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    step = F.greatest(F.lit(1), F.floor(F.least("w", "h") / 512)).cast("int")
    at = px.withColumns({"lo": F.least(*near), "hi": F.greatest(*near)}).join(size, "page").join(paper_peak(px).select("page", "peak"), "page").withColumn("step", step)
    at = at.where("y >= 1 and x >= 1 and y < h - 1 and x < w - 1 and (y - 1) % step = 0 and (x - 1) % step = 0")
    smooth = F.col("g").between(40, F.col("peak") - BAND - 5) & (F.col("hi") - F.col("lo") < 12)
    return at.groupBy("page").agg(F.count("*").alias("samples"), F.count_if(smooth).alias("smooth"))


def classify(px: DataFrame) -> DataFrame:
    """page, kind: text or photo."""
    found = paper_peak(px).join(smooth_midtone(px), "page", "left")
    kind = (
        F.when(F.col("peak") < 128, "photo").when(F.col("mass") / F.col("total") < PAPER_FRACTION, "photo").when(F.col("peak") - BAND - 5 <= 40, "text")
        .when(F.coalesce("samples", F.lit(0)) == 0, "text").when(F.col("smooth") / F.col("samples") <= SMOOTH_LIMIT, "text").otherwise("photo")
    )
    return found.select("page", kind.alias("kind"))


def threshold(px: DataFrame) -> DataFrame:
    """px with ink by the page's Otsu threshold."""
    return px.join(otsu(px), "page").withColumn("ink", F.col("g") < F.col("t")).drop("t")


def sauvola(px: DataFrame, r: int = 12, k: float = 0.15, dynamic_range: float = 128.0) -> DataFrame:
    """px with ink by the mean and deviation of a (2r+1) square, cut off at the page's edges: sums by row, then by column."""
    row = Window.partitionBy("page", "y").orderBy("x").rowsBetween(-r, r)
    column = Window.partitionBy("page", "x").orderBy("y").rowsBetween(-r, r)
    g = F.col("g").cast("long")
    sums = px.withColumns({"s": F.sum(g).over(row), "q": F.sum(g * g).over(row), "c": F.count("*").over(row)})
    sums = sums.withColumns({n: F.sum(n).over(column) for n in ("s", "q", "c")})
    mean = F.col("s") / F.col("c")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("c") - mean * mean))
    return sums.withColumn("ink", F.col("g") < mean * (1 + k * (deviation / dynamic_range - 1))).drop("s", "q", "c")


def block_stats(binary: DataFrame, block: int = 4) -> DataFrame:
    """page, by, bx, n, g_sum, n_ink, g_min, g_max of whole blocks."""
    size = binary.groupBy("page").agg(F.floor((F.max("x") + 1) / block).alias("sw"), F.floor((F.max("y") + 1) / block).alias("sh"))
    at = binary.join(size, "page").withColumns({"by": F.floor(F.col("y") / block), "bx": F.floor(F.col("x") / block)}).where("by < sh and bx < sw")
    return at.groupBy("page", "by", "bx").agg(F.count("*").alias("n"), F.sum("g").alias("g_sum"), F.count_if("ink").alias("n_ink"), F.min("g").alias("g_min"), F.max("g").alias("g_max"))


def tile_levels(binary: DataFrame, block: int = 4, tile_blocks: int = TILE_BLOCKS) -> DataFrame:
    """page, ty, tx, ink_n, ink_sum, pap_n, pap_sum over the area of whole blocks."""
    tile = block * tile_blocks
    size = binary.groupBy("page").agg(F.floor((F.max("x") + 1) / block).alias("sw"), F.floor((F.max("y") + 1) / block).alias("sh"))
    at = binary.join(size, "page").where(f"y < sh * {block} and x < sw * {block}")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("g"))), F.lit(0)).cast("long")
    return at.groupBy("page", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")).agg(
        F.count_if("ink").alias("ink_n"), total(F.col("ink")).alias("ink_sum"), F.count_if(~F.col("ink")).alias("pap_n"), total(~F.col("ink")).alias("pap_sum")
    )


def damage(binary: DataFrame, block: int = 4, tile_blocks: int = TILE_BLOCKS, min_content: int = TILE_CONTENT) -> DataFrame:
    """page, damage: the worst tile's mean distance between the gray blocks and their binary image in the tile's own levels."""
    means = class_means(binary).withColumn("contrast", F.col("paper") - F.col("ink")).where(f"contrast > {CONTRAST}").withColumnRenamed("ink", "ink_level")
    blocks = block_stats(binary, block).join(means, "page")
    mean = F.col("g_sum") / F.col("n")
    blocks = blocks.withColumns({"mean": mean, "ty": F.floor(F.col("by") / tile_blocks), "tx": F.floor(F.col("bx") / tile_blocks)})
    blocks = blocks.where((F.col("mean") < F.col("paper") - DARKNESS_GATE * F.col("contrast")) & (F.col("g_max") - F.col("g_min") > CONTRAST_GATE * F.col("contrast")))
    blocks = blocks.join(tile_levels(binary, block, tile_blocks), ["page", "ty", "tx"])
    ink = F.when(F.col("ink_n") > TILE_PIXELS, F.col("ink_sum") / F.col("ink_n")).otherwise(F.col("ink_level"))
    paper = F.when(F.col("pap_n") > TILE_PIXELS, F.col("pap_sum") / F.col("pap_n")).otherwise(F.col("paper"))
    share = F.col("n_ink") / F.col("n")
    off = F.abs(share * ink + (1 - share) * paper - F.col("mean")) / F.greatest(paper - ink, TILE_CONTRAST * F.col("contrast"))
    tiles = blocks.withColumn("off", off).groupBy("page", "ty", "tx").agg(F.avg("off").alias("off"), F.count("*").alias("n")).where(F.col("n") >= min_content)
    return binary.select("page").distinct().join(tiles.groupBy("page").agg(F.max("off").alias("off")), "page", "left").select("page", F.coalesce("off", F.lit(0.0)).alias("damage"))


def gray4_levels(px: DataFrame) -> DataFrame:
    """px with level: gray in 16 steps."""
    return px.withColumn("level", F.floor(F.col("g") / 17 + 0.5).cast("int"))


def up_filter(px: DataFrame) -> DataFrame:
    """page, y, b, up: packed 4-bit bytes (high nibble first) less those above, modulo 256."""
    byte = gray4_levels(px).groupBy("page", "y", F.floor(F.col("x") / 2).cast("int").alias("b")).agg(F.sum(F.when(F.col("x") % 2 == 0, F.col("level") * 16).otherwise(F.col("level"))).alias("v"))
    above = F.coalesce(F.lag("v").over(Window.partitionBy("page", "b").orderBy("y")), F.lit(0))
    return byte.select("page", "y", "b", F.pmod(F.col("v") - above, F.lit(256)).cast("int").alias("up"))


def mass_trim(binary: DataFrame, axis: str = "x") -> DataFrame:
    """page, lo, hi, trim_lo, trim_hi: the ink's extent along an axis, and without tails of up to 0.3 % of the ink each."""
    mass = binary.where("ink").groupBy("page", axis).agg(F.count("*").alias("m"))
    up = Window.partitionBy("page").orderBy(axis)
    down = Window.partitionBy("page").orderBy(F.desc(axis))
    sums = mass.withColumns({"from_lo": F.sum("m").over(up), "from_hi": F.sum("m").over(down), "total": F.sum("m").over(Window.partitionBy("page"))})
    budget = F.floor(F.col("total") * 3 / 1000)
    return sums.groupBy("page").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"), F.min(F.when(F.col("from_lo") > budget, F.col(axis))).alias("trim_lo"), F.max(F.when(F.col("from_hi") > budget, F.col(axis))).alias("trim_hi"))
