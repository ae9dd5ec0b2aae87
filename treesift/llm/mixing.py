"""Mixing sources to target weights by temperature, in DataFrame operations alone.

Each source's share of all tokens is raised to an exponent between 0 (all
sources alike) and 1 (as they are) and normalised.  The exponent is found by
bisection: the largest that meets a target entropy, or, where that would
repeat a source too often, the smallest that keeps to the repetition limit.

The weights are realised over a budget of tokens.  Each source is read in
passes; every pass is a permutation of its documents by a seeded hash, cut into
blocks of the permutation.  All but the last pass are whole.  The last takes
documents in order until the source's budget is met: block sums, added up in
two levels, tell in which block that is, and only that block's documents are
put in order.  So no task ever holds a source.  Without a budget the least one
is taken at which every source is read once in full, so nothing is left out.

Defined results: a null source is a source of its own; a null or empty text has
no tokens, and a source without tokens has weight 0 and is read once.  Rows
that repeat a doc_id are taken or left together.  An empty table gives no rows.
Other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treesift.llm.common import kept

#: Documents in a block of a permutation, about, and blocks that are added up at once.
BLOCK_DOCS = 1024
BLOCKS_AT_ONCE = 4096
SECTIONS, PASSES = 64, 4


@dataclass(frozen=True)
class MixTarget:
    """``entropy``: as a share of the greatest possible; ``repeats``: how often a
    source may be read at most; ``budget``: tokens in all, or None."""

    entropy: float = 0.9
    repeats: float = 2.0
    budget: float | None = None
    seed: int = 17


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens, all_tokens, share) from (source, n_tokens) rows, as a table."""
    totals = kept(docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "totals")
    every = totals.agg(F.sum("n_tokens")).first()[0] or 0
    share = F.col("n_tokens") / F.lit(float(every)) if every else F.lit(0.0)
    return totals.withColumns({"all_tokens": F.lit(every).cast("long"), "share": share})


def _at_exponents(totals: DataFrame, low: float, high: float, budget: float | None) -> list[tuple[float, float, float]]:
    """(exponent, share of the greatest entropy, most repeats) at SECTIONS + 1 exponents."""
    steps = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
    alpha, share = F.col("alpha"), F.col("share")
    power = F.pow(share, alpha)
    spread = totals.where("share > 0").withColumn("alpha", F.explode(F.array(*map(F.lit, steps))))
    sums = spread.groupBy("alpha").agg(
        F.sum(power).alias("z"),
        F.sum(alpha * power * F.log(share)).alias("e"),
        F.max(F.pow(share, alpha - 1)).alias("most"),
        F.min(F.pow(share, alpha - 1)).alias("least"),
        F.count("*").alias("n"),
        F.max("all_tokens").alias("tokens"),
    )
    entropy = F.log("z") - F.col("e") / F.col("z")
    repeats = F.col("most") / F.col("least") if budget is None else F.col("most") / F.col("z") * F.lit(float(budget)) / F.col("tokens")
    relative = F.when(F.col("n") > 1, entropy / F.log(F.col("n").cast("double"))).otherwise(F.lit(1.0))
    return sorted((r[0], r[1], r[2]) for r in sums.select("alpha", relative, repeats).collect())  # SECTIONS + 1 rows


def find_exponent(totals: DataFrame, target: MixTarget) -> float:
    """By bisection, six halvings a pass.  Entropy falls as the exponent grows, and so do repeats."""

    def search(fits) -> float | None:
        """The end of the interval from which ``fits`` holds on."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            points = _at_exponents(totals, low, high, target.budget)
            if not points:
                return None
            good = [fits(p) for p in points]
            if all(good) or not any(good):
                return points[-1 if good[0] else 0][0] if low == 0.0 and high == 1.0 else (points[0][0] if good[0] else points[-1][0])
            at = next(i for i in range(1, len(points)) if good[i] != good[i - 1])
            low, high = points[at - 1][0], points[at][0]
        return low if fits_low else high

    fits_low = True
    alpha = search(lambda p: p[1] >= target.entropy)  # holds for small exponents
    if alpha is None:
        return 1.0
    if _at_exponents(totals, alpha, alpha, target.budget)[0][2] > target.repeats:
        fits_low = False
        alpha = search(lambda p: p[2] <= target.repeats)  # holds for large exponents
        alpha = 1.0 if alpha is None else alpha
    return alpha


def source_weights(totals: DataFrame, target: MixTarget) -> DataFrame:
    """``totals`` with weight, target_tokens, epochs, whole (passes) and rest (tokens of the last pass)."""
    alpha = find_exponent(totals, target)
    powered = totals.withColumn("power", F.when(F.col("share") > 0, F.pow("share", F.lit(alpha))).otherwise(F.lit(0.0)))
    z, cover = powered.agg(F.sum("power"), F.max(F.when(F.col("power") > 0, F.col("n_tokens") / F.col("power")))).first()
    z = z or 0.0
    budget = F.lit(float(target.budget if target.budget is not None else (cover or 0.0) * z))
    # a source that is to be read a whole number of times is so, whatever the last bit of the division
    epochs = F.when(F.col("power") > 0, F.round(F.col("target_tokens") / F.col("n_tokens"), 9)).otherwise(F.lit(1.0))
    return (
        powered.withColumn("exponent", F.lit(alpha))
        .withColumn("weight", F.col("power") / F.lit(z) if z > 0 else F.lit(0.0))
        .withColumn("target_tokens", F.col("weight") * budget)
        .withColumn("epochs", epochs)
        .withColumn("whole", F.floor("epochs").cast("int"))
        .withColumn("rest", (F.col("epochs") - F.col("whole")) * F.col("n_tokens"))
        .select("source", "n_docs", "n_tokens", "share", "exponent", "weight", "target_tokens", "epochs", "whole", "rest")
    )


def _place(turn: Column, seed: int) -> Column:
    """A document's place in a pass's permutation: a hash."""
    return F.xxhash64(F.col("doc_id"), turn, F.lit(seed))


def _fraction(place: Column) -> Column:
    """A place as a number from 0 to below 1."""
    return F.shiftrightunsigned(place, 11) / F.lit(float(1 << 53))


def _ordered(place: Column) -> Column:
    """The place in an order that agrees with its fraction."""
    return F.shiftrightunsigned(place, 11)


def last_pass_cuts(docs: DataFrame, weights: DataFrame, seed: int) -> DataFrame:
    """(source, cut): the last document that a source's unfinished pass takes."""
    open_passes = weights.where("rest > 0").select(F.col("source").alias("s"), "n_docs", "whole", "rest")
    blocks_of = F.ceil(F.col("n_docs") / BLOCK_DOCS)
    placed = (
        docs.join(open_passes, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("place", _place(F.col("whole"), seed))
        .withColumn("block", F.floor(_fraction(F.col("place")) * blocks_of))
        .select("source", "doc_id", "n_tokens", "rest", "block", _ordered(F.col("place")).alias("place"))
    )
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.max("rest").alias("rest"))
    sums = sums.withColumn("chunk", F.floor(F.col("block") / BLOCKS_AT_ONCE))
    chunks = sums.groupBy("source", "chunk").agg(F.sum("tokens").alias("chunk_tokens"))
    so_far = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("chunk_tokens").over(so_far), F.lit(0)).alias("chunk_start"))
    within = Window.partitionBy("source", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    started = (
        sums.withColumn("block_start", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .join(chunks, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
        .withColumn("start", F.col("block_start") + F.col("chunk_start"))
    )
    cut_block = started.where("start < rest and start + tokens >= rest").select(F.col("source").alias("cs"), F.col("block").alias("cb"), "start")
    last = placed.join(cut_block, F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb")))
    order = Window.partitionBy("source", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = last.withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("before < rest")
    return taken.groupBy("source").agg(F.max(F.struct("place", "doc_id")).alias("cut"))


def _with_plan(docs: DataFrame, weights: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """``docs`` (with source and doc_id) and a column ``copies``."""
    both = weights.select(F.col("source").alias("s"), "n_docs", "weight", "epochs", "whole").join(
        cuts.select(F.col("source").alias("cs"), "cut"), F.col("s").eqNullSafe(F.col("cs")), "left"
    )
    # as a table its size is known, so while sources are few the planner sends it to the documents
    plan = kept(both.drop("cs"), "plan")
    here = F.struct(_ordered(_place(F.col("whole"), seed)).alias("place"), F.col("doc_id"))
    return (
        docs.join(plan, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", F.col("whole") + F.coalesce((here <= F.col("cut")).cast("int"), F.lit(0)))
        .where("copies > 0")
    )


def mix_report(docs: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """One row for each time that a document of ``docs`` (doc_id, source, text) is
    read: (doc_id, source, pass, block, n_tokens, weight, mix_order).  In the order
    of ``mix_order`` the sources stand in the target proportions all along."""
    counted = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("n_tokens")), "counted")
    weights = kept(source_weights(source_totals(counted), target), "weights")
    cuts = kept(last_pass_cuts(counted, weights, target.seed), "cuts")
    planned = _with_plan(counted, weights, cuts, target.seed)
    read = planned.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("fraction", _fraction(_place(F.col("pass"), target.seed)))
    return read.select(
        "doc_id", "source", "pass", F.floor(F.col("fraction") * F.ceil(F.col("n_docs") / BLOCK_DOCS)).alias("block"), "n_tokens", "weight",
        ((F.col("pass") + F.col("fraction")) / F.col("epochs")).alias("mix_order"),
    )


def mixed(docs: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """The rows of ``docs``, each as often as the mix reads it, with its columns
    (names may repeat).  Texts are not shuffled: a document's copies follow from
    its id and its source's numbers."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    of = {c: names[docs.columns.index(c)] for c in ("doc_id", "source", "text")}
    held = plain.select(F.struct(*names).alias("row"), F.col(of["doc_id"]).cast("long").alias("doc_id"), F.col(of["source"]).cast("string").alias("source"), F.col(of["text"]).alias("text"))
    counted = kept(held.select("doc_id", "source", word_count().alias("n_tokens")), "counted")
    weights = kept(source_weights(source_totals(counted), target), "weights")
    cuts = kept(last_pass_cuts(counted, weights, target.seed), "cuts")
    planned = _with_plan(held.drop("text"), weights, cuts, target.seed)
    read = planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return read.select(*[F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])
