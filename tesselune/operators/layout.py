"""Layout, fragments, sections and timelines: slicing, ordering and prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselune.operators.ranges import before


def crop(samples: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """The rectangle's samples, with coordinates from its corner; the filter reaches the scan where it can."""
    inside = F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1)
    return samples.where(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def paste(samples: DataFrame, piece: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """The rectangle from (x0, y0) replaced by the samples of a piece, whose coordinates count from its corner.

    Samples of the piece beyond the rectangle are not written, and places that it lacks are left out.
    """
    inside = F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1)
    moved = piece.withColumns({"x": F.col("x") + x0, "y": F.col("y") + y0}).where(inside)
    return samples.where(~inside).unionByName(moved)


def oriented(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Where a sample goes under one of the eight Exif orientations."""
    right, down = width - 1 - x, height - 1 - y
    new_x = F.when(orientation.isin(2, 3), right).when(orientation.isin(5, 8), y).when(orientation.isin(6, 7), down).otherwise(x)
    new_y = F.when(orientation.isin(3, 4), down).when(orientation.isin(5, 6), x).when(orientation.isin(7, 8), right).otherwise(y)
    return new_x, new_y


def out_of_range(samples: DataFrame, bits: int) -> DataFrame:
    """(image_id, channel, samples, low, high, bad) of each plane; bad counts values outside 0 to 2**bits - 1."""
    v = F.col("v")
    return samples.groupBy("image_id", "channel").agg(F.count("*").alias("samples"), F.min("v").alias("low"), F.max("v").alias("high"), F.count_if((v < 0) | (v >= 1 << bits)).alias("bad"))


def prefix_offsets(rows: DataFrame, keys: tuple[str, ...], order: str, size: str, out: str) -> DataFrame:
    """Adds the sum of the sizes before a row, by keys in an order (a number); a hot key is cut into ranges of it."""
    return before(rows, keys, order, F.col(size)).withColumn(out, F.col("_before").cast("long")).drop("_before")


def section_count(groups: Column, dc_groups: Column, passes: Column) -> Column:
    """Sections of a frame: one if there is one group and pass, else two, the DC groups, and each pass's groups."""
    return F.when((groups == 1) & (passes == 1), 1).otherwise(2 + dc_groups + passes * groups)


def joined_parts(parts: DataFrame, key: str, seq: str, payload: str, first: int = 0, last: str | None = None) -> DataFrame:
    """(key, parts, complete, joined) of numbered parts: complete if the numbers run from ``first`` without gap or
    repeat, and, where a column ``last`` is named, if it is true of the final part alone; joined in order of number."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(payload).alias("p"))))
    per = parts.groupBy(key).agg(ordered.alias("a"), F.count("*").alias("parts"), F.count_distinct(seq).alias("d"), F.min(seq).alias("lo"), F.max(seq).alias("hi"))
    if last:
        flags = parts.groupBy(F.col(key).alias("_k")).agg(F.count_if(last).alias("_flags"), F.max(F.when(F.col(last), F.col(seq))).alias("_at"))
        per = per.join(flags, F.col(key).eqNullSafe(F.col("_k")))
    whole = (F.col("_flags") == 1) & (F.col("_at") == F.col("hi")) if last else F.lit(True)
    complete = (F.col("d") == F.col("parts")) & (F.col("lo") == first) & (F.col("hi") == first + F.col("parts") - 1) & F.coalesce(whole, F.lit(False))
    return per.select(key, "parts", complete.alias("complete"), F.array_join(F.transform("a", lambda e: e["p"]), "").alias("joined"))



def metadata_check(entries: Column, required: Column, most: int, more: int = 0) -> tuple[Column, Column, Column]:
    """Of a map of names to bytes: whether it has all required names, its bytes with their names and ``more`` added,
    and whether these are at most ``most``."""
    size = F.aggregate(F.map_entries(entries), F.lit(more).cast("long"), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return F.size(F.array_except(required, F.map_keys(entries))) == 0, size, size <= most


def planes_by_role(samples: DataFrame, order: str, roles: str) -> DataFrame:
    """(image_id, channel, y, x, v) of interleaved samples (image_id, y, x, v): x counts components, which stand in ``order``
    (as "bgr") in each pixel; channel k is the role ``roles[k]``. Samples of other components, and of a pixel cut off, are left out."""
    if len(set(order)) != len(order) or not set(roles) <= set(order):
        raise ValueError(f"roles {roles} are not components of {order}")
    n = len(order)
    full = samples.withColumn("_n", F.max("x").over(Window.partitionBy("image_id", "y")) + 1).where(F.floor(F.col("x") / n) < F.floor(F.col("_n") / n))
    at = F.create_map(*(F.lit(v) for k, role in enumerate(roles) for v in (order.index(role), k)))
    out = full.select("image_id", F.element_at(at, (F.col("x") % n).cast("int")).alias("channel"), "y", F.floor(F.col("x") / n).alias("x"), "v")
    return out.where("channel IS NOT NULL")


def checked(samples: DataFrame, bits: int) -> DataFrame:
    """The samples; one outside 0 to 2**bits - 1 ends the job."""
    bad = F.concat(F.lit("sample out of range at "), F.col("y"), F.lit(", "), F.col("x"))
    return samples.withColumn("v", F.when(F.col("v").between(0, (1 << bits) - 1), F.col("v")).otherwise(F.raise_error(bad).cast("long")))


def bridged(coefs: DataFrame, dc_quantiser: int | None) -> DataFrame:
    """Coefficients (..., v, u, q) of JPEG blocks as the bridge holds them: axes changed, and, unless colours were transformed
    (no quantiser given), the mean set off by 1024 / dc_quantiser."""
    offset = 0 if dc_quantiser is None else 1024 // dc_quantiser
    moved = F.col("q") + F.when((F.col("v") == 0) & (F.col("u") == 0), offset).otherwise(0)
    rows = coefs.withColumn("q", moved)
    return rows.select(*[F.col({"v": "u", "u": "v"}.get(c, c)).alias(c) for c in coefs.columns])


def channel_classes(channels: DataFrame, dim: int) -> DataFrame:
    """Adds kind to channels (image_id, channel, width, height, hshift, vshift, meta): in which sections they are coded.

    global: before the first channel that is not meta and larger than a group; dc: later ones shrunk eightfold or more
    both ways; ac: the others.
    """
    large = F.when(~F.col("meta") & ((F.col("width") > dim) | (F.col("height") > dim)), F.col("channel"))
    first = F.min(large).over(Window.partitionBy("image_id"))  # an image has few channels
    kind = F.when(F.col("_first").isNull() | (F.col("channel") < F.col("_first")), "global").when((F.col("hshift") >= 3) & (F.col("vshift") >= 3), "dc").otherwise("ac")
    return channels.withColumn("_first", first).withColumn("kind", kind).drop("_first")


def group_slices(channels: DataFrame, dim: int) -> DataFrame:
    """(image_id, channel, kind, gy, gx, y0, x0, h, w) of the parts of channels that their groups hold, by ``channel_classes``.

    A group covers ``dim`` samples of the image a side, eight times as many for dc; a channel's part is that square
    shrunk as the channel is. Negative shifts count as none; global channels, and empty parts, have no rows.
    """
    rows = channel_classes(channels, dim).where("kind <> 'global'").withColumn("_dim", F.when(F.col("kind") == "dc", 8 * dim).otherwise(dim))

    def groups(size: str, shift: str) -> Column:
        own = f"greatest(0, {shift})"
        return F.expr(f"filter(transform(sequence(0L, shiftleft(CAST({size} AS bigint), {own}) div _dim), g -> named_struct('g', g, 'a', shiftright(g * _dim, {own}), 'b', least({size}, shiftright((g + 1) * _dim, {own})))), s -> s.a < s.b)")

    rows = rows.withColumn("_y", F.explode(groups("height", "vshift"))).withColumn("_x", F.explode(groups("width", "hshift")))
    at = {"gy": "_y.g", "gx": "_x.g", "y0": "_y.a", "x0": "_x.a"}
    return rows.select("image_id", "channel", "kind", *[F.col(c).cast("long").alias(n) for n, c in at.items()], (F.col("_y.b") - F.col("_y.a")).cast("long").alias("h"), (F.col("_x.b") - F.col("_x.a")).cast("long").alias("w"))
