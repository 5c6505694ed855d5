"""Mixing sources to target weights by entropy balancing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rates are whole multiples of 1 / UNIT, so that sums do not depend on their order.
UNIT = 1 << 20
#: Parts that the documents of one source and size are dealt into for rounding.
SLOTS = 256
#: Sizes that are summed as a block before the sums of blocks are added up.
BLOCK = 256
STEPS, CLOSE = 60, 1e-7
WORD = r"[^\x20\x09-\x0D]++"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_turn(totals: DataFrame) -> DataFrame:
    """``totals`` with ``_turn``, the place of each source by code point, null last.

    Sources may be as many as hosts: they are sorted by ranges, and only the ranges'
    numbers of rows, as many as partitions, are summed up in one task.
    """
    dealt = totals.repartitionByRange("_null", "_s").sortWithinPartitions("_null", "_s").withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt, "mix-order").withColumn("_range", F.expr("shiftright(_at, 33)")).withColumn("_in", F.expr("_at & 8589934591"))
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_range", before.alias("_before"))
    return dealt.join(F.broadcast(ranges), "_range").withColumn("_turn", F.col("_before") + F.col("_in")).drop("_at", "_range", "_in", "_before")


def source_targets(totals: DataFrame, *, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``totals`` (_s, _null, source_size) with ``target``.

    Sources by code point, null last, take the weights in turn and divide ``share`` of
    all sizes; none gets over ``most`` times its own size. Filling up by weight ends
    at one level: target = min(most * size, level * weight). Each step to that level is
    one aggregation, fills the sources that the last level would overfill, and deals
    what is left to the others; sums are of whole numbers, so reruns agree.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_turn", F.lit(len(weights))) + 1).cast("int"))
    t = materialize(in_turn(totals).select("_s", "source_size", w.cast("long").alias("_w"), (F.col("source_size") * F.lit(most)).alias("_cap")), "mix-weights")
    whole = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0))
    everything = float(t.agg(whole("source_size")).first()[0]) * share
    level, filled = 0.0, -1
    while True:
        over = F.col("_cap") < F.lit(level) * F.col("_w")
        n, caps, rest = t.groupBy().agg(
            F.count_if(over), whole("_cap") - F.coalesce(F.sum(F.when(~over, F.col("_cap").cast("decimal(38,0)"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0))
        ).first()
        if n <= filled or not rest:
            break
        filled, level = n, (everything - float(caps)) / float(rest)
    return t.select("_s", "source_size", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_w")).alias("target"))


def rate(tilt: Column, size: Column, mean: Column, most: float) -> Column:
    """The tilted rate in units: min(most, exp(tilt * size / mean))."""
    tilted = F.exp(F.least(tilt * size / mean, F.lit(50.0)))
    return F.round(F.least(tilted, F.lit(float(most))) * UNIT).cast("long")


def balance(cells: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Solves the dual of entropy balancing for each source by Newton's method.

    ``cells`` (_s, size, n) is the sufficient statistic. Of all rates between 0 and
    ``most``, those of the form min(most, exp(tilt * size / mean)) have the least
    entropy relative to 1 among those with sum(rate * size) = target. Each step is one
    aggregation; a step that leaves the known bracket halves it instead. Sources that
    are to be taken ``most`` times in whole have no finite tilt; they are marked full.
    """
    mean = cells.filter("size > 0").groupBy("_s").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_mean"))
    full = F.col("target") >= F.col("source_size") * F.lit(float(most)) * (1 - 1e-9)
    state = targets.join(mean, "_s", "left").select(
        "*", full.alias("_full"), F.log(F.try_divide("target", "source_size")).alias("_tilt"),
        F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi"), (full | (F.col("source_size") == 0)).alias("_done"),
    )
    state = materialize(state, "mix-tilt")
    r = rate(F.col("_tilt"), F.col("size"), F.col("_mean"), most)
    exact = lambda c: c.cast("decimal(38,0)")
    weight = exact(F.col("n") * F.col("size"))
    for _ in range(STEPS):
        if state.filter("not _done").isEmpty():
            break
        at = cells.filter("size > 0").join(state.filter("not _done").select("_s", "_tilt", "_mean"), "_s").withColumn("_r", r)
        sums = at.groupBy("_s").agg(
            F.sum((weight * F.col("_r")).cast("decimal(38,0)")).alias("_got"),
            F.sum(F.when(F.col("_r") < F.lit(most * UNIT), (weight * F.col("size") * F.col("_r")).cast("decimal(38,0)"))).alias("_slope"),
        )
        gap = F.col("_got").cast("double") / UNIT - F.col("target")
        s = state.join(sums, "_s", "left").withColumn("_gap", gap).withColumn("_slope", F.coalesce(F.col("_slope").cast("double"), F.lit(0.0)) / UNIT / F.col("_mean"))
        s = s.withColumn("_close", F.abs("_gap") <= F.greatest(F.col("target") * CLOSE, F.lit(0.5)))
        s = s.withColumn("_lo2", F.when(F.col("_gap") < 0, F.col("_tilt")).otherwise(F.col("_lo"))).withColumn("_hi2", F.when(F.col("_gap") >= 0, F.col("_tilt")).otherwise(F.col("_hi")))
        newton = F.col("_tilt") - F.col("_gap") / F.nullif(F.col("_slope"), F.lit(0.0))
        inside = (F.col("_lo2").isNull() | (newton > F.col("_lo2"))) & (F.col("_hi2").isNull() | (newton < F.col("_hi2")))
        fallback = (
            F.when(F.col("_lo2").isNull(), F.least(F.col("_hi2") * 2, F.lit(-1.0)))
            .when(F.col("_hi2").isNull(), F.greatest(F.col("_lo2") * 2, F.lit(1.0)))
            .otherwise((F.col("_lo2") + F.col("_hi2")) / 2)
        )
        step = F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(fallback)
        stay = F.col("_done") | F.coalesce(F.col("_close"), F.lit(False))
        state = s.select("_s", "source_size", "target", "_mean", "_full", F.when(stay, F.col("_tilt")).otherwise(step).alias("_tilt"), F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), stay.alias("_done"))
        state = materialize(state, "mix-tilt")
    return state


def settle(cells: DataFrame, most: int) -> DataFrame:
    """``cells`` (_s, size, _slot, n, target, _base, _extra) with ``_extra`` corrected.

    What a source's copies miss of its target is made up by single documents: up to
    eight cells for each quarter power of two of the size, from large to small, give or
    take as many copies as fit. A source brings at most 2016 cells, folded in one row.
    """
    took = F.sum(F.col("size") * (F.col("n") * F.col("_base") + F.col("_extra")))
    # written apart, so that its size is known and a large source's cells need not meet
    gap = materialize(cells.groupBy("_s").agg(F.round(F.max("target") - took).cast("long").alias("_gap")), "mix-gaps")
    spare = F.when(F.col("_gap") < 0, F.col("_extra")).when(F.col("_base") < most, F.col("n") - F.col("_extra")).otherwise(0)
    fit = cells.join(gap, "_s").withColumn("_spare", spare.cast("long")).filter("_spare > 0 and size > 0 and size <= abs(_gap)")
    best = fit.groupBy("_s", F.floor(F.log2("size") * 4).alias("_power"), (F.col("_slot") % 8).alias("_part")).agg(F.max(F.struct("_spare", "size", "_slot")).alias("_c"), F.max("_gap").alias("_gap"))
    row = best.groupBy("_s").agg(F.max("_gap").alias("_gap"), F.reverse(F.array_sort(F.collect_list(F.struct("_power", "_part", "_c")))).alias("_cells"))
    given = F.expr("""aggregate(_cells, named_struct('rest', abs(_gap), 'given', cast(array() as array<struct<size: bigint, _slot: int, _more: bigint>>)),
        (a, x) -> named_struct('rest', a.rest - least(x._c._spare, a.rest div x._c.size) * x._c.size, 'given', concat(a.given,
            array(named_struct('size', x._c.size, '_slot', x._c._slot, '_more', cast(sign(_gap) as bigint) * least(x._c._spare, a.rest div x._c.size))))), a -> a.given)""")
    more = row.select("_s", F.inline(given))
    return cells.join(more, ["_s", "size", "_slot"], "left").withColumn("_extra", F.col("_extra") + F.coalesce("_more", F.lit(0))).drop("_more")


def _row(keep: list[str] | None, text_col: str) -> list[Column]:
    return [F.struct(*keep).alias("_row"), F.xxhash64(text_col).alias("_text")] if keep else []


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2,
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``) of every row.

    ``size`` counts words (null text: 0). Each source's rates solve its token constraint
    (see ``balance``) and become whole copies: documents stand in the order of their
    size and of their id's hash, and a copy is made where the running sum of rates
    passes a half; single copies then make up what is missing of the target (see
    ``settle``). A null source is a source. Null and repeated ids are
    allowed; equal rows are interchangeable. An empty table gives an empty result;
    other columns are not read. With ``keep`` each row brings those columns as the
    struct ``row``: rows of one id, or without, have their own places by their text.

    Sizes are counted once. Newton's steps run on counts by (source, size). Running
    sums are taken within blocks of sizes and over blocks, and the documents of one
    source and size are dealt into slots, so no task gets a source whole.
    """
    named = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    d = docs.select(F.col(id_col).alias("_id"), named.alias("_s"), words(F.col(text_col)).alias("size"), *_row(keep, text_col))
    mixed = F.when(F.col("_id").isNull(), F.col("_text")).otherwise(F.xxhash64("_id")) if keep else F.xxhash64("_id")
    d = rows = d.withColumn("_mix", mixed).withColumn("_slot", F.pmod("_mix", F.lit(SLOTS)).cast("int"))
    d = materialize(d.drop("_row", "_text"), "mix-sizes")
    slots = materialize(d.groupBy("_s", "size", "_slot").agg(F.count("*").alias("n")), "mix-cells")
    cells = slots.groupBy("_s", "size").agg(F.sum("n").alias("n"))
    totals = cells.groupBy("_s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("_null", F.col("_s") == "n")
    targets = materialize(source_targets(totals, weights=weights, share=share, most=most), "mix-targets")
    tilts = balance(materialize(cells, "mix-sums"), targets, most)

    solved = F.when(F.col("_full") | (F.col("size") == 0), F.lit(most * UNIT)).otherwise(rate(F.col("_tilt"), F.col("size"), F.col("_mean"), most))
    solved = F.when(F.col("size") == 0, F.lit(UNIT)).otherwise(solved)  # no words: taken once
    c = slots.join(tilts, "_s").withColumn("_rate", solved.cast("long")).withColumn("_base", F.expr(f"_rate div {UNIT}")).withColumn("_part", F.col("n") * (F.col("_rate") % UNIT))
    c = c.withColumn("_block", F.expr(f"size div {BLOCK}"))
    by_size = c.groupBy("_s", "_block", "size").agg(F.sum("_part").alias("_part"))
    by_block = by_size.groupBy("_s", "_block").agg(F.sum("_part").alias("_part"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda *by: F.coalesce(F.sum("_part").over(before(*by)), F.lit(0))
    by_block = by_block.select("_s", "_block", upto("_s", "_block").alias("_b0"))
    by_size = by_size.select("_s", "_block", "size", upto("_s", "_block", "size").alias("_b1")).join(by_block, ["_s", "_block"]).select("_s", "size", (F.col("_b0") + F.col("_b1")).alias("_b"))
    c = c.withColumn("_b2", upto("_s", "size", "_slot")).join(by_size, ["_s", "size"]).withColumn("_from", F.col("_b") + F.col("_b2") + UNIT // 2)
    c = c.withColumn("_extra", F.expr(f"(_from + _part) div {UNIT} - _from div {UNIT}"))
    c = settle(materialize(c.select("_s", "size", "_slot", "n", "source_size", "target", "_base", "_extra"), "mix-copies"), most).drop("n")

    place = F.row_number().over(Window.partitionBy("_s", "size", "_slot").orderBy("_mix", "_id", *(["_text"] if keep else [])))
    out = (rows if keep else d).withColumn("_place", place).join(c, ["_s", "size", "_slot"]).withColumn("copies", (F.col("_base") + (F.col("_place") <= F.col("_extra")).cast("long")).cast("long"))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *([F.col("_row").alias("row")] if keep else []))
