"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of all words by weight, at most ``most`` times what it
has. Its documents are wanted target / size times on average, longer ones more often
and shorter ones less, by as much as the limits of none and ``most`` copies allow. What is whole
in a document's number of copies it gets for certain; the fraction is its inclusion
probability for one copy more. For that copy documents are ranked by Pareto's value, their
random odds divided by their inclusion odds, and taken in that order as long as the words stay
within the target; one later document fills what is left. So the sample has a fixed size
in words and its probabilities differ between documents. The random number is a
hash of the document's id, so reruns agree.

No source is sorted as a whole: documents are counted by bins of their value,
the bin that contains the end of the sample is found from the counts, and only
the documents of that bin are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.textbits import fresh
from tidemark.session import materialize

#: Size in words at which half of the preference for long documents is reached.
HALF = 256
#: Bins of Pareto's value, mapped to 0..1; a bin of a source holds about 1 / BINS of its documents.
BINS = 1 << 16
SEED = 20_24


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_number(key: Column, seed: int = SEED) -> Column:
    """A number strictly between 0 and 1, by hash of the key."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, have the weights in turn. Each gets
    a share of all words by weight, but not above ``most`` times its size; what
    is above is shared among the others by weight, until none is above. Hence
    one level: a source has the smaller of level * weight and most * size. In
    the order of most * size / weight the sources that are cut come first; one is
    cut if the level without it and those after it reaches its quotient. The
    windows run over the table of sources, one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    total = Window.partitionBy()
    before = Window.orderBy("quotient", "weight", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("quotient", most * F.col("source_size") / F.col("weight")).select(
        "*",
        F.sum("source_size").over(total).alias("all"),
        F.sum("weight").over(total).alias("weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("less"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("less_weight"),
    )
    level = (F.col("all") - most * F.col("less")) / (F.col("weights") - F.col("less_weight"))
    cut = ranked.withColumn("cut", level >= F.col("quotient"))
    rest_size = F.sum(F.when(F.col("cut"), F.col("source_size")).otherwise(0)).over(total)
    rest_weight = F.sum(F.when(F.col("cut"), 0.0).otherwise(F.col("weight"))).over(total)
    share = (F.col("all") - most * rest_size) * F.col("weight") / rest_weight
    target = F.when(F.col("cut"), most * F.col("source_size")).otherwise(share)
    return cut.select("source", "source_size", target.cast("double").alias("target"))


def _lift(size: str) -> Column:
    """0 to 999, more for longer documents. Whole, so that its sums do not depend on their order."""
    return F.expr(f"1000 * {size} div ({size} + {HALF})")


def _share(size: str, prefix: str) -> tuple[Column, Column]:
    """(whole copies, inclusion probability of one more) of a document of ``size``."""
    mean, swing = F.col(f"{prefix}mean"), F.col(f"{prefix}swing")
    copies = F.when(F.col(size) > 0, F.col(f"{prefix}ratio") + swing * (_lift(size) / 1000.0 - mean)).otherwise(0.0)
    whole = F.floor(copies + 1e-9)
    return whole, F.when(copies - whole > 1e-9, copies - whole).otherwise(0.0)


def pareto(u: Column, odds: Column) -> Column:
    """Pareto's value q = u / (1 - u) / (p / (1 - p)) as q / (1 + q), which has the same order; null where p is 0."""
    own, other = u * (1 - odds), (1 - u) * odds
    return F.when(odds > 0, own / (own + other))


def chances(sized: DataFrame, wanted: DataFrame, most: float) -> DataFrame:
    """Rows (name, source_size, target, ratio, mean, swing): what a document's size needs to become its probability.

    Copies are ``ratio + swing * (lift - mean)``, ``mean`` being the size-weighted mean of the lift, so
    over a source they make the target; ``swing`` keeps them within 0 and ``most``.
    """
    sums = sized.groupBy(F.col("source").alias("name")).agg(F.sum(_lift("size") * F.col("size")).alias("lifted"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = F.when(F.col("source_size") > 0, F.col("lifted") / (1000.0 * F.col("source_size"))).otherwise(0.0)
    joined = wanted.join(sums, F.col("source").eqNullSafe(F.col("name"))).select("name", "source_size", "target", ratio.alias("ratio"), mean.alias("mean"))
    return joined.withColumn("swing", F.greatest(F.least(F.col("ratio"), most - F.col("ratio")), F.lit(0.0)))


def plan(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, bins: int = BINS) -> DataFrame:
    """Rows (source, source_size, target, ratio, mean, swing, cut, extra) from rows (source, size, u): what decides on every document.

    A document has its whole copies, and one more if its Pareto value is at most ``cut`` or equals ``extra``.
    """
    wanted = materialize(targets(sized, weights, most), "targets")
    goals = materialize(chances(sized, wanted, most), "chances")
    same = F.col("source").eqNullSafe(F.col("name"))
    whole, odds = _share("size", "")
    drawn = sized.where("size > 0").join(goals, same).select("source", "size", "target", whole.alias("whole"), pareto(F.col("u"), odds).alias("v"))
    certain = drawn.groupBy(F.col("source").alias("sure_name")).agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    certain = goals.join(certain, F.col("name").eqNullSafe(F.col("sure_name")), "left")
    rest = materialize(certain.select("name", (F.col("target") - F.coalesce("sure", F.lit(0))).alias("rest")), "rests")
    some = drawn.where("v IS NOT NULL").select("source", "size", "v", F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    per_bin = some.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = per_bin.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).join(rest, same)
    end = reach.where("rest > before AND rest <= before + n").select(F.col("name").alias("end_name"), F.col("bin").alias("end_bin"), "before", "rest")
    end = materialize(end, "ends")
    inside = some.join(end, F.col("source").eqNullSafe(F.col("end_name")) & (F.col("bin") == F.col("end_bin")))
    equal = inside.groupBy("source", "v", "bin", "before", "rest").agg(F.sum("size").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("v"))
    near = equal.withColumn("taken", upto <= F.col("rest")).withColumn("upto", upto)
    ends = near.groupBy(F.col("source").alias("end_name")).agg(
        F.coalesce(F.max(F.when(F.col("taken"), F.col("v"))), F.min(F.col("bin")) / bins).alias("cut"),
        (F.first("rest") - F.coalesce(F.max(F.when(F.col("taken"), F.col("upto"))), F.first("before"))).alias("gap"),
    )
    ends = materialize(ends, "cuts")
    # of the documents after the end, the one whose size fills the gap best, if it brings the sum nearer
    after = some.join(ends, F.col("source").eqNullSafe(F.col("end_name")) & (F.col("v") > F.col("cut")))
    miss = F.abs(F.col("n") - F.col("gap"))
    fits = after.groupBy("source", "v", "gap").agg(F.sum("size").alias("n")).where(miss < F.col("gap"))
    best = fits.groupBy(F.col("source").alias("best_name")).agg(F.min(F.struct(miss.alias("miss"), "v")).alias("best"))
    # where even all values together stay below the rest, by rounding, all are taken
    left = goals.join(ends, F.col("name").eqNullSafe(F.col("end_name")), "left").join(best, F.col("name").eqNullSafe(F.col("best_name")), "left")
    sums = per_bin.groupBy(F.col("source").alias("sum_name")).agg(F.sum("n").alias("n"))
    left = left.join(sums, F.col("name").eqNullSafe(F.col("sum_name")), "left").join(rest.toDF("rest_name", "rest"), F.col("name").eqNullSafe(F.col("rest_name")), "left")
    all_of = F.when(F.col("rest") > F.col("n"), 1.0).otherwise(-1.0)
    return left.select(
        F.col("name").alias("source"), "source_size", "target", "ratio", "mean", "swing", F.coalesce("cut", all_of).alias("cut"), F.coalesce("best.v", F.lit(-1.0)).alias("extra")
    )


def _copies(size: str, u: str, prefix: str) -> Column:
    whole, odds = _share(size, prefix)
    v = pareto(F.col(u), odds)
    more = F.coalesce((v <= F.col(f"{prefix}cut")) | (v == F.col(f"{prefix}extra")), F.lit(False))
    return F.when(F.col(size) > 0, whole + more.cast("long")).otherwise(F.lit(0)).cast("long")


def _planned(sized: DataFrame, prefix: str, **options) -> DataFrame:
    table = materialize(plan(sized, **options), "mix")
    return table.select(*[F.col(c).alias(f"{prefix}{c}") for c in table.columns])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Rows (id, size, source_size, target, copies, taken) for every row of ``docs``; ``taken`` is copies * size.

    ``options``: weights, most, bins. A null, empty or blank text has size 0 and
    takes nothing. A null source is a source of its own. Rows with equal ids have
    the same random number and are taken alike within a source. Other columns
    play no part; an empty table gives an empty table.
    """
    sized = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), random_number(F.col(f"`{id_col}`")).alias("u")
    )
    sized = materialize(sized, "sizes")
    joined = sized.join(_planned(sized, "p_", **options), F.col("source").eqNullSafe(F.col("p_source")))
    copies = _copies("size", "u", "p_")
    return joined.select(
        F.col("id").alias(id_col), "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (not at all, once or more), columns unchanged."""
    key, words = random_number(F.col(f"`{id_col}`")), word_count(F.col(f"`{text_col}`"))
    sized = materialize(docs.select(F.col(f"`{source_col}`").alias("source"), words.alias("size"), key.alias("u")), "sizes")
    size, u, copy, mark = fresh(docs, "_size", "_u", "_copy", "_plan")
    while any(c.lower().startswith(f"{mark}_".lower()) for c in docs.columns):
        mark = f"_{mark}"
    joined = docs.join(_planned(sized, f"{mark}_", **options), F.col(f"`{source_col}`").eqNullSafe(F.col(f"{mark}_source")))
    joined = joined.withColumn(size, words).withColumn(u, key)
    copies = F.array_repeat(F.lit(1), _copies(size, u, f"{mark}_").cast("int"))
    return joined.withColumn(copy, F.explode(copies)).select(*[f"`{c}`" for c in docs.columns])
