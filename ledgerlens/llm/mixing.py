"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and `cap` copies.  Among all rates that meet each source's token target, those
closest in relative entropy to an even draw are exponentially tilted: odds exp(lambda_source * x), with x the document's
tokens over its source's mean.  One lambda for each source solves the convex dual; Newton steps, kept within a bracket,
find all of them at once, with one grouped sum over the (source, size) table in each step.  Rates then become whole
copies: the whole part is taken, and rest copies go by a hash of the document until the source's target is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, unit_hash

#: Fixed by the contract: weights of the sources in code-point order, repeated.
WEIGHTS = (3.0, 1.0, 2.0)
BINS = 1024
#: A source's last rows, which are put in order.
FEW = 64


def with_targets(sources: DataFrame, share: float, cap: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with target: `share` of all sizes by weight, none above cap times its source's size.

    The excess of capped sources goes to the others by weight.  Sources are capped in the order of size over weight,
    so running sums in that order give the level at which no more are.  One row a source passes through here.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, all_rows = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(F.lit(1))
    left = weighed.select(
        "*",
        (F.sum("most").over(upto) - F.col("most")).alias("capped_before"),
        (F.sum("weight").over(all_rows) - F.sum("weight").over(upto) + F.col("weight")).alias("weight_left"),
        (F.sum("source_size").over(all_rows) * float(share)).alias("total"),
    ).withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
    fits = left.withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    level = F.min(F.when(F.col("fits"), F.struct(F.col("capped_before").alias("at"), F.col("level").alias("level")))).over(all_rows)["level"]
    return fits.select("source", "source_size", F.least("most", F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"))


def solve_tilts(sizes: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-9, most_steps: int = 200) -> DataFrame:
    """(source, size, n) and targets to (source, source_size, target, mean_size, tilt); tilt is null where the rate is 0 or cap.

    Each step is one grouped sum over the whole (source, size) table, combined before the shuffle.  Ends when every
    target is met to `tolerance`, or when no bracket can be halved any more; `most_steps` without either is an error.
    """
    means = sizes.filter("size > 0").groupBy(F.col("source").alias("of")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_size"))
    part = F.coalesce(F.try_divide("target", F.col("source_size") * float(cap)), F.lit(0.0))  # 0 for a source without words
    state = targets.join(means, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    open_ = F.col("mean_size").isNotNull() & (part > 0) & (part < 1 - 1e-12)
    state = materialize(state.select("source", "source_size", "target", "mean_size", F.when(open_, F.log(part / (1 - part))).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(1.0).alias("off")))
    for _ in range(most_steps):
        x = F.col("size") / F.col("mean_size")
        z = F.col("tilt") * x
        odds = F.exp(-F.abs(z))
        p = F.when(z >= 0, 1 / (1 + odds)).otherwise(odds / (1 + odds))
        tokens = F.col("n") * F.col("size") * float(cap)
        active = state.filter("tilt is not null")
        at = active.withColumnRenamed("source", "of")
        sums = sizes.filter("size > 0").join(at, sizes["source"].eqNullSafe(at["of"])).groupBy("of", "source_size", "target", "mean_size", "tilt", "low", "high").agg((F.sum(tokens * p) - F.first("target")).alias("f"), F.sum(tokens * p * (odds / (1 + odds) + F.when(z < 0, (1 - odds) / (1 + odds)).otherwise(0.0)) * x).alias("g"))
        low, high = F.when(F.col("f") < 0, F.col("tilt")).otherwise(F.col("low")), F.when(F.col("f") > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide("f", "g")
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        tilt = F.when(F.col("f") == 0, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2)
        stepped = sums.select(F.col("of").alias("source"), "source_size", "target", "mean_size", tilt.alias("tilt"), low.alias("low"), high.alias("high"), (F.abs("f") / F.col("target")).alias("off"))
        state = materialize(stepped.unionByName(state.filter("tilt is null").withColumn("off", F.lit(0.0))).coalesce(1))
        going = (F.col("off") >= tolerance) & (F.col("high") - F.col("low") > 1e-12 * F.greatest(F.abs("tilt"), F.lit(1.0)))
        if state.filter(F.col("tilt").isNotNull() & going).limit(1).count() == 0:
            return state.select("source", "source_size", "target", "mean_size", "tilt")
    raise ArithmeticError(f"targets aren't met after {most_steps} steps")


def mix_sources(docs: DataFrame, share: float = 1.5, cap: int = 2, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, source, text) to (kept, source, size, source_size, target, rate, copies), a row a row of docs.

    `kept` is a struct of the columns that `keep` names, doc_id by default, so their names can't clash.  Size is the
    number of words.  Null or empty texts have size 0 and get no copies; a null source is a source and comes last;
    repeated rows and rows without doc_id are documents of their own.  A source's taken words differ from its target by
    less than its longest document.  A source without words has target 0 and no copies.  Texts of any length are counted whole; an empty table gives
    an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*(keep or ["doc_id"])).alias("kept"), "source", F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"), unit_hash("doc_id", text, F.lit("copy")).alias("draw"))
    rows = materialize(rows.withColumn("tie", unit_hash(F.monotonically_increasing_id())))
    sizes = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    of = solve_tilts(sizes, with_targets(sources, share, cap), cap).withColumnRenamed("source", "of")
    z = F.col("tilt") * F.col("size") / F.col("mean_size")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNotNull(), float(cap) / (1 + F.exp(-z))).otherwise(F.when(F.col("target") > 0, float(cap)).otherwise(0.0))
    rated = rows.join(of, rows["source"].eqNullSafe(of["of"])).drop("of").withColumn("rate", rate)
    return _round_up(rated)


def _narrowed(rows: DataFrame, state: DataFrame, by: str) -> DataFrame:
    """Narrows each source's range of `by` to the few rows among which its running sum of sizes reaches `need`.

    state: (of, need, start, low, high, n), a row a source: n rows from low to high, `start` words before them.  The
    range is cut into BINS, and the one in which the need is met is the next range, until it has FEW rows or one value.
    """
    while True:
        busy = state.filter((F.col("n") > FEW) & (F.col("high") > F.col("low")))
        if busy.limit(1).count() == 0:
            return state
        at = F.least(F.floor((F.col(by) - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        inside = rows.join(busy, rows["source"].eqNullSafe(busy["of"])).filter(F.col(by).between(F.col("low"), F.col("high"))).withColumn("bin", at)
        bins = inside.groupBy("of", "need", "start", "bin").agg(F.sum("size").alias("more"), F.count("*").alias("rows"), F.min(by).alias("lo"), F.max(by).alias("hi"))
        end = F.col("start") + F.sum("more").over(Window.partitionBy("of").orderBy("bin"))
        met = bins.withColumn("end", end).filter((F.col("end") >= F.col("need")) & (F.col("end") - F.col("more") < F.col("need")))
        met = met.select("of", "need", (F.col("end") - F.col("more")).alias("start"), F.col("lo").alias("low"), F.col("hi").alias("high"), F.col("rows").alias("n"))
        done = state.filter((F.col("n") <= FEW) | (F.col("high") == F.col("low")))
        state = materialize(met.unionByName(done).coalesce(1))


def _round_up(rated: DataFrame) -> DataFrame:
    """Takes the whole part of each rate, then rest copies in the order of draw over rest until the source's target is reached.

    Where the target falls is found by narrowing ranges of that order, then, among rows equal in it, of their ties, with
    grouped sums; only the last few rows of each source are put in order.
    """
    rest = F.col("rate") - F.floor("rate")
    order = F.when(rest > 0, F.col("draw") / rest / (1 + F.col("draw") / rest))
    keyed = rated.withColumns({"whole": F.floor("rate").cast("long"), "order": order})
    slim = keyed.select("source", "target", "size", "whole", "order", "tie")
    some = F.col("order").isNotNull()
    state = slim.groupBy(F.col("source").alias("of")).agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"), F.sum(F.when(some, F.col("size")).otherwise(0)).alias("all"), F.min("order").alias("low"), F.max("order").alias("high"), F.count_if(some).alias("n"))
    # Nothing is taken where nothing is needed, everything where all is too little.
    ends = F.when(F.col("need") <= 0, -1.0).when(F.col("need") > F.col("all"), 2.0)
    state = state.select("of", "need", F.lit(0).cast("long").alias("start"), F.coalesce(ends, "low").alias("low"), F.coalesce(ends, "high").alias("high"), "n")
    state = _narrowed(slim.filter(some), materialize(state), "order")
    equal = state.filter((F.col("n") > FEW) & F.col("low").between(0, 1))
    among = slim.join(equal.select("of", "need", "start", "low"), slim["source"].eqNullSafe(F.col("of")) & (F.col("order") == F.col("low"))).select("source", "size", "tie", "of", "need", "start")
    ties = among.groupBy("of", "need", "start").agg(F.min("tie").alias("low"), F.max("tie").alias("high"), F.count("*").alias("n"))
    ties = _narrowed(among.select("source", "size", "tie"), materialize(ties), "tie").select(F.col("of").alias("tied"), F.col("start").alias("tie_start"), F.col("low").alias("tie_low"), F.col("high").alias("tie_high"))
    # Written, so that its size is known and small before it meets the documents.
    state = materialize(state.join(ties, F.col("of").eqNullSafe(F.col("tied")), "left").drop("tied", "n").coalesce(1))
    placed = keyed.join(state, keyed["source"].eqNullSafe(state["of"])).drop("of")
    # -1 before the last few rows of its source, 0 among them, 1 behind.
    side = lambda x, low, high: F.when(x < low, -1).when(x > high, 1).otherwise(0)
    first = side(F.col("order"), F.col("low"), F.col("high"))
    where = F.when(F.col("order").isNull(), 1).when((first == 0) & F.col("tie_low").isNotNull(), side(F.col("tie"), F.col("tie_low"), F.col("tie_high"))).otherwise(first)
    placed = placed.withColumns({"where": where, "start": F.coalesce("tie_start", "start")})
    columns = ["kept", "source", "size", "source_size", "target", "rate", "whole"]
    plain = placed.filter("where <> 0").select(*columns, (F.col("where") < 0).alias("extra"))
    upto = F.col("start") + F.sum("size").over(Window.partitionBy("source").orderBy("order", "tie").rowsBetween(Window.unboundedPreceding, 0))
    last = placed.filter("where = 0").select(*columns, (upto - F.col("size") / 2 <= F.col("need")).alias("extra"))
    return plain.unionByName(last).select("kept", "source", "size", "source_size", "target", "rate", (F.col("whole") + F.col("extra").cast("long")).alias("copies"))
