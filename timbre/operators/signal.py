"""Signal features on numeric rows: (signal, i, x) with i counting from 0.

Window functions run within one signal (a recording), which bounds their frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SILENCE, CLIPPING = 0.01, 0.999


def level_stats(samples: DataFrame, key: str = "signal") -> DataFrame:
    """Peak, rms, dc offset, and fractions of silent and clipped samples."""
    x = F.col("x")
    return samples.groupBy(key).agg(
        F.count("*").alias("n"), F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(x * x)).alias("rms"), F.avg(x).alias("dc"),
        F.avg((F.abs(x) <= SILENCE).cast("double")).alias("silence"), F.avg((F.abs(x) >= CLIPPING).cast("double")).alias("clipping"),
    )


def frames(samples: DataFrame, size: int, hop: int, key: str = "signal") -> DataFrame:
    """(signal, frame, rms, zcr) of overlapping frames; zcr is crossings for each sample of the frame (times the rate: in Hz).  An incomplete last frame is dropped."""
    first = F.greatest(F.lit(0), F.floor((F.col("i") - size + hop) / hop)).cast("int")
    at = samples.withColumn("frame", F.explode(F.sequence(first, F.floor(F.col("i") / hop).cast("int"))))
    before = F.lag("x").over(Window.partitionBy(key, "frame").orderBy("i"))
    crossing = ((before < 0) != (F.col("x") < 0)).cast("int")
    at = at.withColumn("crossing", F.coalesce(crossing, F.lit(0)))
    out = at.groupBy(key, "frame").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), (F.sum("crossing") / size).alias("zcr"))
    return out.where(F.col("n") == size).drop("n")


#: The lowest threshold of activity (-50 dBFS), multiples of the noise floor, parts of the loudest frame.
LEAST_ACTIVE, FLOOR_TIMES, FLOOR_MOST, PEAK_PART, FLOOR_PLACE = 10 ** (-50 / 20), 3.0, 0.5, 0.04, 0.2


def activity(framed: DataFrame, key: str = "signal") -> DataFrame:
    """Adds ``active``: rms above the largest of -50 dBFS, the noise floor's multiple (at most half the peak) and a part of the peak.

    The floor is the frame a fifth of the way up the sorted levels, by index.
    """
    bounds = framed.groupBy(key).agg(F.array_sort(F.collect_list("rms")).alias("levels"), F.max("rms").alias("top"))
    at = F.least(F.size("levels") - 1, F.floor(F.size("levels") * FLOOR_PLACE).cast("int"))
    threshold = F.greatest(F.lit(LEAST_ACTIVE), F.least(F.get("levels", at) * FLOOR_TIMES, F.col("top") * FLOOR_MOST), F.col("top") * PEAK_PART)
    return framed.join(bounds.select(key, threshold.alias("threshold")), key).withColumn("active", F.col("rms") > F.col("threshold")).drop("threshold")


def runs(framed: DataFrame, key: str = "signal") -> DataFrame:
    """(signal, island, active, first, last, length): maximal runs of equal activity."""
    order = Window.partitionBy(key).orderBy("frame")
    change = (F.col("active") != F.lag("active").over(order)).cast("int")
    island = F.sum(F.coalesce(change, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = framed.withColumn("island", island)
    return marked.groupBy(key, "island", "active").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("length"))


def pauses(framed: DataFrame, least: int, key: str = "signal") -> DataFrame:
    """Inactive runs of ``least`` frames or more between two active ones."""
    ends = framed.where("active").groupBy(key).agg(F.min("frame").alias("from"), F.max("frame").alias("to"))
    return runs(framed, key).where(~F.col("active")).join(ends, key).where((F.col("first") > F.col("from")) & (F.col("last") < F.col("to")) & (F.col("length") >= least)).drop("from", "to", "active")


def phrases(framed: DataFrame, least: int, key: str = "signal") -> DataFrame:
    """(signal, phrase, first, last, length): stretches from the first active frame to the last, split by pauses only; shorter gaps belong to them."""
    ends = framed.where("active").groupBy(key).agg(F.min("frame").alias("from"), F.max("frame").alias("to"))
    broken = pauses(framed, least, key).select(key, F.explode(F.sequence("first", "last")).alias("frame"), F.lit(True).alias("pause"))
    inside = framed.join(ends, key).where(F.col("frame").between(F.col("from"), F.col("to"))).join(broken, [key, "frame"], "left")
    spoken = inside.select(key, "frame", F.col("pause").isNull().alias("active"))
    return runs(spoken, key).where("active").select(key, F.col("island").alias("phrase"), "first", "last", "length")


def windows(samples: DataFrame, size: int, key: str = "signal") -> DataFrame:
    """(signal, window, level): rms of tumbling windows; a last part of half a window or more counts."""
    out = samples.groupBy(key, F.floor(F.col("i") / size).cast("int").alias("window")).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("level"))
    return out.where(F.col("n") * 2 >= size)


def spread(column: str) -> list:
    """Mean, population deviation and coefficient of variation; null for fewer than two values or a mean not above zero."""
    x = F.col(column)
    std = F.when(F.count(x) >= 2, F.stddev_pop(x))
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), std.alias("std"), F.when(F.avg(x) > 0, std / F.avg(x)).alias("cv")]


def envelope(samples: DataFrame, bins: int, key: str = "signal") -> DataFrame:
    """(signal, bin, energy, zcr): ``bins`` equal stretches; a zero carries the sign before it."""
    n = samples.groupBy(key).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy("i")
    sign = F.signum("x")
    before = F.last(F.when(sign != 0, sign), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flip = ((sign != 0) & before.isNotNull() & (sign != before)).cast("int")
    at = samples.withColumn("flip", flip).join(n, key).withColumn("bin", F.floor(F.col("i") * bins / F.col("n")).cast("int"))
    return at.groupBy(key, "bin").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("energy"), F.avg(F.coalesce("flip", F.lit(0)).cast("double")).alias("zcr"))
