"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's natural share is its share of all tokens (words). Weights are the
shares raised to an exponent and normalised: 1 keeps the shares, 0 makes all
sources equal. The exponent is the largest whose entropy reaches
``entropy_share`` of the most that the sources allow; if some source would
then be read more than ``max_repeat`` times, it is the smallest larger one
that keeps the limit. A budget of over ``max_repeat`` times all tokens is an
error, as no exponent keeps the limit. Both are found by bisection on a grid of 2^16 steps,
five halvings in one aggregation.

Realisation: every source has a budget of tokens, its weight times
``budget_tokens`` (all tokens by default). Its documents are permuted anew in
every epoch by a hash of seed, epoch and id. Whole epochs take every document;
the last one takes the beginning of its permutation, as many documents as fit.
That beginning is found by blocks of the hash range: token sums by block,
prefix sums over stretches of blocks and over the blocks of one stretch, and a
running sum inside the one block where the budget ends. So a hot source is many
blocks, and a task holds about the square root of their number.
``place`` orders the mix: sorted by it, any stretch has the target weights.

Edge cases: a null source is a source; null and empty texts have no tokens and
never use budget; sources without tokens are read once; ties of the hash go
by id; repeated rows are taken or left together; documents without an id are
permuted by the hash of an empty id; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import write_scratch

GRID = 1 << 16


@dataclass(frozen=True)
class MixParams:
    entropy_share: float = 0.9
    max_repeat: float = 4.0
    budget_tokens: int | None = None
    block_rows: int = 4096
    seed: int = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash32(epoch: Column, doc_id: Column, seed: int) -> Column:
    """32 bits of the md5 of seed, epoch and id."""
    key = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def _bisect(shares: DataFrame, holds, low: int, high: int, want_low: bool) -> int:
    """The largest step of the grid at which ``holds(measures)`` is true
    (``want_low``: the smallest); true at ``low`` (``want_low``: at ``high``).
    One aggregation tests the 31 steps of five halvings."""
    while high - low > 1 if want_low else high > low:
        step = max(1, (high - low + 31) // 32)
        steps = [k for k in range(low + step, high, step)] + ([] if want_low else [high])
        if not steps:
            break
        z = F.pow("p", F.col("k") / F.lit(float(GRID)))
        rows = (shares.withColumn("k", F.explode(F.array(*[F.lit(k) for k in steps]))).groupBy("k")
                .agg(F.sum(z).alias("z"), F.sum(z * F.log("p")).alias("zl"), F.max(z / F.col("p")).alias("top")).collect())  # a row for each step
        good = {r["k"]: holds(r) for r in rows}
        if want_low:
            yes = [k for k in steps if good[k]]
            high = min(yes, default=high)
            low = max([low, *(k for k in steps if not good[k])])
        else:
            yes = [k for k in steps if good[k]]
            new = max(yes, default=low)
            high = min([high, *(k - 1 for k in steps if not good[k])])
            low = new
    return high if want_low else low


def find_exponent(sources: DataFrame, total: int, budget: int, p: MixParams) -> int:
    """Step of the exponent on the grid; ``sources``: tokens of each."""
    import math

    if budget > p.max_repeat * total:  # exponent 1 reads all sources alike; every other reads one more often
        raise ValueError(f"{budget} tokens from {total} are more than {p.max_repeat} readings of some source")
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))
    count = shares.count()
    if count < 2:
        return GRID
    target = p.entropy_share * math.log(count)
    at = _bisect(shares, lambda r: math.log(r["z"]) - r["k"] / GRID * r["zl"] / r["z"] >= target, 0, GRID, False)
    fits = lambda r: r["top"] / r["z"] * budget / total <= p.max_repeat
    now = shares.select(F.pow("p", F.lit(at / GRID)).alias("z"), "p").agg(F.sum("z").alias("z"), F.max(F.col("z") / F.col("p")).alias("top")).first()
    return at if fits(now) else _bisect(shares, fits, at, GRID, True)


def _ending(sums: DataFrame, group: list[str], by: str) -> DataFrame:
    """The row of each group, in the order of ``by``, in which ``rest`` ends,
    and the tokens ``before`` it, starting at ``from``."""
    upto = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return (sums.withColumn("before", F.col("from") + F.coalesce(F.sum("t").over(upto), F.lit(0)))
            .where("before <= rest and before + t > rest").groupBy("source").agg(F.min_by(by, by).alias(by), F.min_by("before", by).alias("before")))


def plan_mix(thin: DataFrame, p: MixParams) -> DataFrame:
    """For each source of ``thin`` (source, doc_id, n_tokens): tokens, budget,
    whole epochs and the place (cut, cut_id) where the last epoch ends."""
    sources = write_scratch(thin.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if p.budget_tokens is None else p.budget_tokens
    k = find_exponent(sources, total, budget, p) if total else GRID
    z = F.pow(F.col("tokens") / F.lit(float(max(1, total))), F.lit(k / GRID))
    norm = sources.where("tokens > 0").agg(F.sum(z)).first()[0] or 1.0
    planned = (sources.withColumn("budget", F.when(F.col("tokens") > 0, F.round(z / F.lit(norm) * F.lit(float(budget))).cast("long")).otherwise(0))
               .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int"))
               .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0))
               .withColumn("blocks", F.ceil(F.col("rows") / p.block_rows).cast("long")))
    h = (thin.join(planned.select(F.col("source").alias("s"), "epochs", "rest", "blocks"), thin["source"].eqNullSafe(F.col("s"))).drop("s")
         .where("rest > 0").withColumn("h", hash32(F.col("epochs"), F.col("doc_id"), p.seed))
         .withColumn("block", F.floor(F.col("h") * F.col("blocks") / F.lit(float(1 << 32))).cast("long")))
    h = write_scratch(h.select("source", "doc_id", "n_tokens", "rest", "blocks", "block", "h"), "mix-places")
    # prefix sums in two levels: the stretch of blocks where the budget ends, then the block in it
    sums = h.groupBy("source", "rest", "blocks", "block").agg(F.sum("n_tokens").alias("t")).withColumn("stretch", F.floor(F.col("block") / F.ceil(F.sqrt("blocks"))))
    sums = write_scratch(sums, "mix-sums")
    wide = _ending(sums.groupBy("source", "rest", "stretch").agg(F.sum("t").alias("t")).withColumn("from", F.lit(0).cast("long")), ["source"], "stretch")
    wide = wide.select(F.col("source").alias("s"), F.col("stretch").alias("x"), F.col("before").alias("from"))
    edge = _ending(sums.join(wide, sums["source"].eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("x"))), ["source", "stretch"], "block")
    inside = Window.partitionBy("source", "block").orderBy("h", "doc_id")  # rows with equal keys share a sum
    cut = (h.join(edge.select(F.col("source").alias("s"), F.col("block").alias("b"), "before"), h["source"].eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
           .withColumn("t", F.col("before") + F.sum("n_tokens").over(inside))
           .where("t > rest").groupBy("source").agg(F.min(F.struct("h", "doc_id")).alias("cut")))
    cut = cut.select(F.col("source").alias("s"), "cut")
    return (planned.join(cut, planned["source"].eqNullSafe(F.col("s")), "left").drop("s")
            .select("source", "tokens", "budget", "epochs", "rest", "cut"))


def mix_sources(docs: DataFrame, params: MixParams | None = None, text: str = "text", mix: str = "mix") -> DataFrame:
    """Every reading of a document: the columns of ``docs`` and, in a struct
    named ``mix``, epoch, n_tokens and place."""
    p = params or MixParams()
    thin = write_scratch(docs.select("source", "doc_id", n_words(docs[text]).alias("n_tokens")), "mix-thin")
    plan = write_scratch(plan_mix(thin, p), "mix-plan").select(F.struct("*").alias("plan"))
    all_ = docs.select(F.struct(*docs.columns).alias("doc")).join(plan, F.col("doc.source").eqNullSafe(F.col("plan.source")))
    last = hash32(F.col("plan.epochs"), F.col("doc.doc_id"), p.seed)
    before = F.struct(last.alias("h"), F.col("doc.doc_id").alias("doc_id")) < F.col("plan.cut")
    partial = (F.col("plan.rest") > 0) & F.coalesce(before, F.lit(True))  # without a cut all of the last epoch fits
    whole = F.when(F.col("plan.epochs") > 0, F.sequence(F.lit(0), F.col("plan.epochs") - 1)).otherwise(F.array().cast("array<int>"))
    epochs = F.when(partial, F.concat(whole, F.array(F.col("plan.epochs")))).otherwise(whole)
    read = all_.withColumn("epoch", F.explode(epochs))
    h = hash32(F.col("epoch"), F.col("doc.doc_id"), p.seed)
    place = F.when(F.col("plan.budget") > 0, (F.col("epoch") + h / F.lit(float(1 << 32))) * F.col("plan.tokens") / F.col("plan.budget")).otherwise(h / F.lit(float(1 << 32)))
    return read.select("doc.*", F.struct(F.col("epoch"), n_words(F.col(f"doc.{text}")).alias("n_tokens"), F.round(place, 9).alias("place")).alias(mix))
