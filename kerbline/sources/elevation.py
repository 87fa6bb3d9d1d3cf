"""Heights from binary tiles: a tile of one degree is cut into blocks of samples, and places are joined with their block.

A tile is a square of n x n signed 16-bit big-endian metres, rows from north to south, named after its south-west corner (N52E013.hgt);
its outer samples lie on the degrees, so neighbouring tiles share them. Whatever is joined or shuffled is a block of
BLOCK + 1 samples to each side, not a tile, and all of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import gradient

c = F.col
BLOCK = 64
# Fixed value: the height that marks a sample without data.
VOID = -32768


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """south, west (degrees), n (samples to a side) and content of the .hgt files of a folder; other names and files of no square are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").option("recursiveFileLookup", True).load(folder)
    name = lambda i: F.regexp_extract("path", r"([NS])(\d{2})([EW])(\d{3})\.hgt$", i)
    degrees = lambda letter, number, minus: F.when(name(letter) == minus, -name(number).cast("int")).otherwise(name(number).cast("int"))
    named = raw.where(name(1) != "").select(degrees(1, 2, "S").alias("south"), degrees(3, 4, "W").alias("west"), F.round(F.sqrt(c("length") / 2)).cast("int").alias("n"), "length", "content")
    return named.where((c("n") >= 2) & (c("n") * c("n") * 2 == c("length"))).drop("length")


def blocks(tiles: DataFrame) -> DataFrame:
    """south, west, n, bi, bj and rows (binaries of the block's samples): sample (i, j) of a tile is in block (i / BLOCK, j / BLOCK); a block also has its neighbours' first row and column."""
    last = F.floor((c("n") - 2) / BLOCK).cast("int")
    each = tiles.select("south", "west", "n", "content", F.explode(F.sequence(F.lit(0), last)).alias("bi")).withColumn("bj", F.explode(F.sequence(F.lit(0), last)))
    height, width = (F.least(F.lit(BLOCK + 1), c("n") - c(k) * BLOCK).cast("int") for k in ("bi", "bj"))
    row = lambda i: F.substring(c("content"), ((c("bi") * BLOCK + i) * c("n") + c("bj") * BLOCK).cast("int") * 2 + 1, width * 2)
    return each.select("south", "west", "n", "bi", "bj", F.transform(F.sequence(F.lit(0), height - 1), row).alias("rows"))


def _sample(rows: Column, i: Column, j: Column) -> Column:
    """The height at row i, column j of a block; null without data."""
    raw = F.conv(F.hex(F.substring(F.element_at(rows, i + 1), j * 2 + 1, F.lit(2))), 16, 10).cast("int")
    value = F.when(raw >= 32768, raw - 65536).otherwise(raw)
    return F.when(value != VOID, value.cast("double"))


def elevations(places: DataFrame, tile_blocks: DataFrame, key: str = "node") -> DataFrame:
    """key and elevation of places (key, lon, lat): bilinear between the four samples around, of which those without data don't count; null without a tile or any sample.

    A place on the border of two tiles takes the northern and the eastern one; the outermost border of the tiles
    has no heights, as the tile that would begin there is missing.
    """
    sides = tile_blocks.select("south", "west", "n").distinct()
    at = places.select(key, "lon", "lat", F.floor("lat").cast("int").alias("south"), F.floor("lon").cast("int").alias("west")).join(sides, ["south", "west"])
    y, x = (c("south") + 1 - c("lat")) * (c("n") - 1), (c("lon") - c("west")) * (c("n") - 1)
    inner = lambda v: F.least(F.floor(v), c("n") - 2).cast("int")
    cut = at.withColumns({"i": inner(y), "j": inner(x), "fy": y - inner(y), "fx": x - inner(x)}).withColumns({"bi": F.floor(c("i") / BLOCK).cast("int"), "bj": F.floor(c("j") / BLOCK).cast("int")})
    both = cut.join(tile_blocks.select("south", "west", "bi", "bj", "rows"), ["south", "west", "bi", "bj"])
    i, j = c("i") - c("bi") * BLOCK, c("j") - c("bj") * BLOCK
    corners = [(_sample(c("rows"), i + a, j + b), (c("fy") if a else 1 - c("fy")) * (c("fx") if b else 1 - c("fx"))) for a in (0, 1) for b in (0, 1)]
    total = sum((F.coalesce(h * w, F.lit(0.0)) for h, w in corners), F.lit(0.0))
    weight = sum((F.when(h.isNotNull(), w).otherwise(0.0) for h, w in corners), F.lit(0.0))
    found = both.select(key, F.when(weight > 0, total / weight).alias("elevation"))
    return places.select(key).join(found, key, "left")


def with_gradients(edges: DataFrame, tile_blocks: DataFrame) -> DataFrame:
    """edges with gradient_percent, the rise from the first to the last vertex of the line; null where either has no height."""
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    ends = edges.where(F.size("line") > 0).select(F.explode(F.array(first, last)).alias("p")).distinct().select("p", "p.lon", "p.lat")
    heights = elevations(ends, tile_blocks, "p")
    side = lambda end, name: heights.select(c("p").alias(end), c("elevation").alias(name))
    both = edges.withColumns({"__first": first, "__last": last}).join(side("__first", "__from"), "__first", "left").join(side("__last", "__to"), "__last", "left")
    return both.withColumn("gradient_percent", gradient(c("__from"), c("__to"), c("metres"))).drop("__first", "__last", "__from", "__to")
