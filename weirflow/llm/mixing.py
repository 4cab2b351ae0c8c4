"""Mixing sources to target weights.

Sizes are summed by source; targets follow the weights, with a cap on the repetition of any source; the rate
of a source is its target over its size. Each document is emitted floor(rate) times plus one more time with
probability equal to the fraction, decided by one hash-seeded draw.

The draw is systematic, so that sources of few or uneven documents come near their targets too, while each document's
probability stays exactly the fraction: a source's documents stand in the order of their sizes on a line, one unit each, those of
equal size at hashed places of their common stretch; the line, shifted by a hash of seed and source, is marked over the fraction
of every 1 / fraction units, and what a mark hits is copied. The places follow from counts by source and size, where sizes from 256
on stand by their eight leading bits, so a source has some three thousand of them at most. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm._shared import apart, place, renamed, written

#: Rows of the table by source and size (some 60 bytes each) up to which it is broadcast; beyond, documents are salted.
MOST_SOURCES = 200_000
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null counts 0."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda x: x != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_repeat: int) -> DataFrame:
    """Adds ``target`` to a frame of source, size, weight: the total is shared by weight, no target is above ``max_repeat`` times its size, and the excess is shared again by weight among the rest.

    In the order of size over weight the capped sources come first; each prefix tells whether its next source is capped.
    One window over the sources, of which there is one row each.
    """
    order = Window.orderBy(F.col("size") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("size") * max_repeat
    t = sizes.select(
        "*",
        F.sum("size").over(every).alias("all_size"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum(cap).over(order), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(order), F.lit(0)).alias("weight_before"),
    )
    level = (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    t = t.withColumn("level", level).withColumn("capped", cap.cast("double") <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("weight_before"), F.col("level")))).over(every)["level"]
    return t.withColumn("open_level", first).select(
        "source", "size", "weight", F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("open_level") * F.col("weight")).alias("target")
    )


#: Columns that ``plan_mix`` adds.
PLANNED = ("__wf_size", "__wf_source_size", "__wf_target", "__wf_copies")


def _unit(*parts: Column) -> Column:
    """A number from 0 to 1 from the hash of texts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _leading(size: Column) -> Column:
    """A size with all but its eight leading bits zero."""
    return F.call_function("shiftleft", F.call_function("shiftright", size, F.greatest(F.length(F.bin(size)) - 8, F.lit(0))), F.greatest(F.length(F.bin(size)) - 8, F.lit(0)))


def _planned(docs: DataFrame, *, weights: DataFrame | None = None, cycle: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> tuple[DataFrame, list[str]]:
    """The documents with columns c0, c1, ... by place, size, source_size, target and copies."""
    base, inner = renamed(docs)
    own = lambda name: F.col(inner[place(docs, name)])
    size = F.coalesce(own(size_col).cast("long"), F.lit(0)) if size_col else word_count(own(text_col).cast("string"))
    rows = base.select(*inner, size.alias("size"), own(source_col).cast("string").alias("source"), F.coalesce(own(id_col).cast("string"), F.lit("null")).alias("key"))
    rows = rows.withColumn("class", _leading(F.col("size")))
    sizes = written(rows.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "sizes")
    sums = sizes.groupBy("source").agg(F.sum("words").alias("size"))
    if weights is None:
        turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        sums = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (turn % len(cycle) + 1).cast("int")))
    else:
        sums = sums.join(weights.select(F.col("source").alias("w"), F.col("weight")), F.col("source").eqNullSafe(F.col("w"))).drop("w")
    each = targets(sums, max_repeat).select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = sizes.select("source", "class", "n", before.alias("before")).join(each, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    shift = _unit(F.lit(str(seed)), F.coalesce("source", F.lit("null")))
    table = written(table.select(F.col("source").alias("t_source"), F.col("class").alias("t_class"), "n", "before", "source_size", "target", shift.alias("shift")), "plan")
    found = _with_source(rows, table, table.count() <= MOST_SOURCES)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = rate - F.floor(rate)
    at = F.col("shift") + part * (F.col("before") + F.col("n") * _unit(F.lit(str(seed)), F.lit("document"), F.col("key")))
    extra = F.when((part > 0) & (at - F.floor(at) < part), 1).otherwise(0)
    copies = F.coalesce(F.least(F.floor(rate) + extra, F.lit(max_repeat)).cast("int"), F.lit(0))
    return found.select(*inner, "size", "source_size", "target", copies.alias("copies")), inner


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents with ``__wf_size`` (words), ``__wf_source_size``, ``__wf_target`` and ``__wf_copies`` (times the mix takes the document).

    ``weights`` has source and weight (positive; a source without a row is not taken); by default the sources by code point,
    null last, weigh the numbers of ``cycle`` in turn. All targets sum to all sizes. A null source is a source; null and empty
    texts have size 0; a source of size 0 has target 0 and is not taken. ``size_col`` names sizes that are known already. Rows of
    one size and source that repeat an id share its draw, so do rows with a null id. Other columns stay; one that has the name
    of an added column gets an underscore behind its own. An empty table gives an empty result.
    """
    found, inner = _planned(docs, **options)
    return found.toDF(*apart(docs.columns, PLANNED), *PLANNED)


def _with_source(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """Joins the table by source and size: broadcast if it was counted to be small, else with both sides salted, so that a hot source spreads."""
    same = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("class") == F.col("t_class"))
    if few:
        return rows.join(F.broadcast(table), same, "left")
    table = table.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return rows.join(table, same & (F.col("salt") == F.col("t_salt")), "left")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each repeated as often as ``plan_mix`` says, with the columns of ``docs``."""
    planned, inner = _planned(docs, **options)
    times = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>")))
    return planned.withColumn("copy", times).select(*inner).toDF(*docs.columns)
