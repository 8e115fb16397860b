"""Histograms, what is read off them, image statistics, and the comparison of two rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelquilt.functions.pixels import luma
from pixelquilt.plans.raster import Raster

BINS = 256
#: Pixels of the subsample that image statistics are taken from: part of their definition.
SAMPLE = 262_144


def binned(r: Raster, value: Column | None = None) -> DataFrame:
    """(image_id, bin, n, lo, hi): bytes have the range 0..255, floats that of their image's luma."""
    px = r.pixels.select("image_id", luma(r).alias("l"), (luma(r) if value is None else value).alias("v"))
    if r.fmt == "RGBA8":
        px = px.withColumns({"lo": F.lit(0.0), "hi": F.lit(255.0)})
    else:
        span = px.groupBy("image_id").agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
        px = px.join(span.withColumn("hi", F.expr("if(hi - lo < 1e-12, lo + 1, hi)")), "image_id")
    return px.groupBy("image_id", _bin().alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def _arrays(hist: DataFrame) -> DataFrame:
    """(image_id, lo, hi, h): one array of 256 counts an image, its filled bins with as many zeros before each as are empty."""
    got = hist.groupBy("image_id", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("bin", F.col("n").cast("double").alias("n")))).alias("b"))
    each = "transform(b, (x, i) -> concat(array_repeat(0.0D, x.bin - if(i = 0, 0, b[i - 1].bin + 1)), array(x.n)))"
    return got.select("image_id", "lo", "hi", F.expr(f"flatten(concat({each}, array(array_repeat(0.0D, {BINS - 1} - element_at(b, -1).bin))))").alias("h"))


def _dense(hist: DataFrame) -> DataFrame:
    """(image_id, lo, hi, bin, n) with the empty bins."""
    return _arrays(hist).select("image_id", "lo", "hi", F.posexplode("h").alias("bin", "n"))


def _value(at: Column) -> Column:
    return F.col("lo") + at / 255.0 * (F.col("hi") - F.col("lo"))


def otsu(hist: DataFrame) -> DataFrame:
    """(image_id, t): between-class variance at its largest, the middle of a plateau."""
    own = Window.partitionBy("image_id")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = _dense(hist).withColumns({"wb": F.sum("n").over(upto), "sb": F.sum(F.col("n") * F.col("bin")).over(upto), "all": F.sum("n").over(own), "total": F.sum(F.col("n") * F.col("bin")).over(own)})
    between = F.expr("wb * (all - wb) * power(sb / wb - (total - sb) / (all - wb), 2)")
    d = d.withColumn("b", F.when((F.col("wb") > 0) & (F.col("wb") < F.col("all")), between))
    best = d.withColumn("best", F.max("b").over(own))
    flat = F.when(F.expr("b > best - greatest(1e-9, abs(best) * 1e-12)"), F.col("bin"))
    return best.groupBy("image_id", "lo", "hi").agg(F.coalesce((F.min(flat) + F.max(flat)) / 2.0, F.lit(128.0)).alias("bin")).select("image_id", _value(F.col("bin")).alias("t"))


def triangle(hist: DataFrame) -> DataFrame:
    """(image_id, t): the bin farthest from the chord between the peak and the end of the longer tail."""
    own = Window.partitionBy("image_id")
    d = _dense(hist)
    some = F.when(F.col("n") > 0, F.col("bin"))
    d = d.withColumns({"peak": -F.max(F.struct("n", (-F.col("bin")).alias("b"))).over(own)["b"], "first": F.min(some).over(own), "last": F.max(some).over(own)})
    right = F.col("peak") - F.col("first") < F.col("last") - F.col("peak")
    d = d.withColumns({"a": F.when(right, F.col("peak")).otherwise(F.col("first")), "z": F.when(right, F.col("last")).otherwise(F.col("peak"))})
    d = d.withColumns({"y0": F.max(F.when(F.col("bin") == F.col("a"), F.col("n"))).over(own), "y1": F.max(F.when(F.col("bin") == F.col("z"), F.col("n"))).over(own)})
    d = d.withColumn("d", F.when(F.expr("bin between a and z and z > a"), F.expr("abs((y1 - y0) * (bin - a) - (z - a) * (n - y0)) / sqrt(power(z - a, 2) + power(y1 - y0, 2))")))
    far = d.groupBy("image_id", "lo", "hi").agg(F.max(F.struct("d", (-F.col("bin")).alias("b"))).alias("x"), F.first("peak").alias("peak"))
    return far.select("image_id", _value(F.when(F.col("x.d").isNull(), F.col("peak")).otherwise(-F.col("x.b")).cast("double")).alias("t"))


def isodata(hist: DataFrame) -> DataFrame:
    """(image_id, t): halfway between the means of both classes, from 128 on, 128 times at most.

    Counts and sums are added up along the filled bins, once; a step looks its bin's up.
    """
    up = Window.partitionBy("image_id").orderBy("bin")
    total = lambda v: F.sum(F.expr(v)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    d = hist.withColumns({"cnt": total("cast(n as double)"), "sum": total("cast(n * bin as double)"), "next": F.coalesce(F.lead("bin").over(up), F.lit(BINS))})
    d = d.groupBy("image_id", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("bin", "next", F.struct("cnt", "sum").alias("up")))).alias("b"))
    none = "named_struct('cnt', 0.0D, 'sum', 0.0D)"
    each = f"flatten(concat(array(array_repeat({none}, b[0].bin)), transform(b, x -> array_repeat(x.up, x.next - x.bin))))"
    step = f"""aggregate(sequence(1, 128), 128, (t, i) ->
        case when c[t].cnt = 0 or c[{BINS - 1}].cnt - c[t].cnt = 0 then t
             else cast(floor((c[t].sum / c[t].cnt + (c[{BINS - 1}].sum - c[t].sum) / (c[{BINS - 1}].cnt - c[t].cnt)) * 0.5 + 0.5) as int) end)"""
    #: An array of one, so that its value is made once and not at every step.
    return d.select("image_id", _value(F.expr(f"transform(array({each}), c -> {step})[0]").cast("double")).alias("t"))


def finish(hist: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(image_id, count, mean, variance, sd, median, percentile, least, most, peak) over bin values."""
    own = Window.partitionBy("image_id")
    d = hist.withColumn("v", _value(F.col("bin").cast("double"))).withColumn("up", F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(own))
    d = d.groupBy("image_id").agg(
        F.sum("n").alias("count"),
        (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("n") * F.col("v") * F.col("v")) / F.sum("n")).alias("square"),
        F.min(F.when(F.col("up") >= 0.5 * F.col("all"), F.col("v"))).alias("median"),
        F.min(F.when(F.col("up") >= fraction * F.col("all"), F.col("v"))).alias("percentile"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        (-F.max(F.struct("n", (-F.col("bin")).alias("b")))["b"]).alias("peak"),
    )
    var = F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))
    return d.withColumns({"variance": var, "sd": F.sqrt(var)}).drop("square")


def sample_step(w: Column, h: Column) -> Column:
    """The smallest step whose successor leaves SAMPLE pixels at most, in whole divisions."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.sqrt(w.cast("double") * h / SAMPLE)).cast("int") + 1))
    fits = F.filter(steps, lambda s: F.floor(w / (s + 1)) * F.floor(h / (s + 1)) <= SAMPLE)
    return F.element_at(fits, 1)


def _sampled(r: Raster) -> Raster:
    """Every step-th pixel of every step-th row, from the first on, in whole steps."""
    step = sample_step(F.col("w"), F.col("h"))
    px = r.pixels.withColumn("step", step).where("x % step = 0 and y % step = 0 and x div step < greatest(1, w div step) and y div step < greatest(1, h div step)")
    return r.with_pixels(px)


def image_histograms(r: Raster) -> DataFrame:
    """(image_id, lo, hi, red, green, blue, luma): counts of 256 bins each over the subsample, the colours
    null in one-channel images.

    A pixel becomes one code for each histogram, (histogram, bin) in a number; tasks count codes
    before the shuffle, and an image is at most 1024 counts after it.
    """
    px = _sampled(r).pixels.withColumn("l", luma(r))
    if r.fmt == "RGBA8":
        px = px.withColumns({"lo": F.lit(0.0), "hi": F.lit(255.0)})
    else:
        span = px.groupBy("image_id").agg(F.min("l").alias("lo"), F.max("l").alias("hi"))
        px = px.join(span.withColumn("hi", F.expr("if(hi - lo < 1e-12, lo + 1, hi)")), "image_id")
    names = ["luma"] if len(r.channels) == 1 else ["luma", "red", "green", "blue"]
    code = lambda k, c: F.expr(f"cast(greatest(0, least(255, floor(({c} - lo) / (hi - lo) * 255 + 0.5))) as int) + {BINS * k}")
    codes = px.select("image_id", "lo", "hi", F.explode(F.array(*[code(k, c) for k, c in enumerate(["l", "c0", "c1", "c2"][: len(names)])])).alias("code"))
    counts = codes.groupBy("image_id", "lo", "hi", "code").agg(F.count(F.lit(1)).alias("n"))
    own = counts.groupBy("image_id", "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("m"))
    dense = lambda k: F.transform(F.sequence(F.lit(BINS * k), F.lit(BINS * k + BINS - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))
    each = {n: dense(k) for k, n in enumerate(names)}
    return own.select("image_id", "lo", "hi", *[each.get(n, F.lit(None).cast("array<bigint>")).alias(n) for n in ("red", "green", "blue", "luma")])


def image_stats(r: Raster) -> DataFrame:
    """One row an image: count, mean, median and sd of the luma over the subsample, the shares of its end
    bins, the tallest interior bin over the colours, the end of the luma's range, and whether it is a float beyond 1."""
    names = ["luma"] if len(r.channels) == 1 else ["red", "green", "blue"]
    walk = """aggregate(luma, cast(struct(0 as i, 0 as n, 0 as s, 0 as q, null as median) as struct<i:int,n:bigint,s:double,q:double,median:double>),
        (a, c) -> struct(a.i + 1 as i, a.n + c as n, a.s + c * (lo + a.i / 255d * (hi - lo)) as s, a.q + c * pow(lo + a.i / 255d * (hi - lo), 2) as q,
            if(a.median is null and c > 0 and a.n + c >= 0.5d * total, lo + a.i / 255d * (hi - lo), a.median) as median))"""
    d = image_histograms(r).withColumn("total", F.expr("aggregate(luma, 0L, (a, c) -> a + c)")).withColumn("x", F.expr(walk))
    mean = F.col("x.s") / F.col("total")
    tallest = F.greatest(*[F.array_max(F.slice(n, 2, BINS - 2)) for n in names]) if len(names) > 1 else F.array_max(F.slice("luma", 2, BINS - 2))
    end = lambda i: F.element_at("luma", i) / F.col("total")
    return d.select("image_id", F.col("total").alias("count"), mean.alias("mean"), F.col("x.median").alias("median"), F.sqrt(F.greatest(F.lit(0.0), F.col("x.q") / F.col("total") - mean * mean)).alias("sd"), end(1).alias("clip_low"), end(BINS).alias("clip_high"), F.when(tallest > 0, tallest).alias("peak_count"), F.col("hi").alias("max_value"), (F.lit(r.fmt != "RGBA8") & (F.col("hi") > 1.0001)).alias("headroom"))


def _beside(a: Raster, b: Raster) -> tuple[DataFrame, list[Column]]:
    """Pixels of images that both have, ``same`` where their sizes agree, and the colours' differences."""
    if a.fmt != b.fmt:
        raise ValueError(f"formats differ: {a.fmt} and {b.fmt}")
    other = b.pixels.select("image_id", "x", "y", F.col("w").alias("ow"), F.col("h").alias("oh"), *[F.col(c).alias(f"o{c}") for c in b.colours])
    both = a.pixels.join(other, ["image_id", "x", "y"]).withColumn("same", (F.col("w") == F.col("ow")) & (F.col("h") == F.col("oh")))
    return both, [F.abs(F.col(c) - F.col(f"o{c}")) for c in a.colours]


def compare(a: Raster, b: Raster, tolerance: float) -> DataFrame:
    """(image_id, max_diff, mean_diff, rmse, diff_pixels, pixels) over the colours of images that both have.

    Formats must agree; where sizes differ all numbers are 0, as nothing was compared.
    """
    both, diffs = _beside(a, b)
    n = len(diffs)
    worst = F.greatest(*diffs) if n > 1 else diffs[0]
    counted = F.count(F.when(F.col("same"), 1))
    mean = lambda total: F.coalesce(F.sum(F.when(F.col("same"), total)) / F.nullif(counted * n, F.lit(0)), F.lit(0.0))
    return both.groupBy("image_id").agg(
        F.coalesce(F.max(F.when(F.col("same"), worst)), F.lit(0.0)).alias("max_diff"),
        mean(sum(diffs[1:], diffs[0])).alias("mean_diff"),
        F.sqrt(mean(sum((d * d for d in diffs[1:]), diffs[0] * diffs[0]))).alias("rmse"),
        F.count(F.when(F.col("same") & (worst > tolerance), 1)).alias("diff_pixels"),
        counted.alias("pixels"),
    )


def diff_image(a: Raster, b: Raster, amplify: float = 16.0) -> Raster:
    """The worst channel's difference, amplified, as an RGBA8 picture in warm colours; none where sizes differ."""
    both, diffs = _beside(a, b)
    both = both.where("same")
    worst = F.greatest(*diffs) if len(diffs) > 1 else diffs[0]
    scale = F.lit(1.0)
    if a.fmt != "RGBA8":
        sizes = [F.abs(F.col(c)) for c in a.colours]
        top = a.pixels.groupBy("image_id").agg(F.max(F.greatest(*sizes) if len(sizes) > 1 else sizes[0]).alias("top"))
        both = both.join(top, "image_id")
        scale = F.when(F.col("top") <= 1e-9, 255.0).otherwise(255.0 / F.col("top"))
    v = F.least(F.lit(255.0), worst * scale * amplify)
    px = both.withColumns({"v": v}).select("image_id", "x", "y", "w", "h", F.floor("v").cast("double").alias("c0"), F.floor(F.col("v") * 0.25).cast("double").alias("c1"), F.floor(F.col("v") * 0.25).cast("double").alias("c2"), F.lit(255.0).alias("c3"))
    return Raster(px, "RGBA8")


#: Side of the squares that points and pixels meet by.
SQUARE = 32


def _near(r: Raster, points: DataFrame, radius: int, value: Column) -> DataFrame:
    """(point_id, image_id, v, n) for each pixel of each point's window; n: how often it counts, as
    places beyond the image repeat the edge.

    Points and pixels meet by the squares that a window reaches, so no point sees a far pixel; a
    point is at most ((2 * radius) div SQUARE + 2) squared rows.
    """
    sizes = r.pixels.groupBy("image_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    p = points.select("point_id", F.col("image_id").cast("long").alias("image_id"), F.col("x").cast("long").alias("cx"), F.col("y").cast("long").alias("cy")).join(sizes, "image_id")
    ends = lambda c, n: (clamped(F.col(c) - radius, n), clamped(F.col(c) + radius, n))
    clamped = lambda v, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, v))
    (x0, x1), (y0, y1) = ends("cx", "w"), ends("cy", "h")
    reach = lambda a, b: F.sequence(F.floor(a / SQUARE), F.floor(b / SQUARE))
    p = p.select("point_id", "image_id", "cx", "cy", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), F.explode(reach(x0, x1)).alias("sx"), "w", "h").select("*", F.explode(reach(F.col("y0"), F.col("y1"))).alias("sy")).drop("w", "h")
    px = r.pixels.select("image_id", "x", "y", "w", "h", value.alias("v"), F.floor(F.col("x") / SQUARE).alias("sx"), F.floor(F.col("y") / SQUARE).alias("sy"))
    both = p.join(px, ["image_id", "sx", "sy"]).where("x between x0 and x1 and y between y0 and y1")
    times = lambda at, n, c: F.greatest(F.lit(1), F.when(F.col(n) == 1, F.lit(2 * radius + 1)).when(F.col(at) == 0, F.least(F.lit(2 * radius + 1), radius - F.col(c) + 1)).when(F.col(at) == F.col(n) - 1, F.least(F.lit(2 * radius + 1), F.col(c) + radius - F.col(n) + 2)).otherwise(1))
    return both.select("point_id", "image_id", "v", (times("x", "w", "cx") * times("y", "h", "cy")).cast("long").alias("n"))


def _channel(r: Raster, channel: int) -> Column:
    """A channel's value, or the luma for -1 and in one-channel images."""
    return luma(r) if channel < 0 or len(r.channels) == 1 else F.col(f"c{min(channel, 3)}")


def window_stats(r: Raster, points: DataFrame, radius: int, channel: int = -1) -> DataFrame:
    """(point_id, image_id, n, mean, sd, least, most) of the square window around each point.

    points: (point_id, image_id, x, y), anywhere, also outside their image; ids repeat only for
    the same point.  A negative radius, or an image that isn't there, gives zeros.
    """
    own = points.select("point_id", F.col("image_id").cast("long").alias("image_id")).distinct()
    if radius < 0:
        return own.select("*", F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("mean", "sd", "least", "most")])
    total, v = F.sum("n"), F.col("v")
    got = _near(r, points.dropDuplicates(["point_id"]), radius, _channel(r, channel)).groupBy("point_id").agg(total.alias("n"), (F.sum(v * F.col("n")) / total).alias("mean"), (F.sum(v * v * F.col("n")) / total).alias("square"), F.min("v").alias("least"), F.max("v").alias("most"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")))
    return own.join(got, "point_id", "left").select("point_id", "image_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in ((F.col("mean"), "mean"), (sd, "sd"), (F.col("least"), "least"), (F.col("most"), "most"))])


def window_histogram(r: Raster, points: DataFrame, radius: int, channel: int = -1) -> DataFrame:
    """(point_id, image_id, bin, n): the filled bins of each point's window; bins span what the image's own histogram spans."""
    near = _near(r, points.dropDuplicates(["point_id"]), radius, _channel(r, channel))
    if r.fmt == "RGBA8":
        near = near.withColumns({"lo": F.lit(0.0), "hi": F.lit(255.0)})
    else:
        span = r.pixels.groupBy("image_id").agg(F.min(luma(r)).alias("lo"), F.max(luma(r)).alias("hi"))
        near = near.join(span.withColumn("hi", F.expr("if(hi - lo < 1e-12, lo + 1, hi)")), "image_id")
    return near.groupBy("point_id", "image_id", _bin().alias("bin")).agg(F.sum("n").alias("n"))


def _bin() -> Column:
    return F.expr("cast(greatest(0, least(255, floor((v - lo) / (hi - lo) * 255 + 0.5))) as int)")
