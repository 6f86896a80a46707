"""Operator 9, mixing sources to target weights by entropy balancing.

Among all non-negative document rates w that give every source its token target, the one nearest (in relative entropy)
to taking each document once is w = exp(lambda[source] * tokens). The multipliers minimise a smooth convex dual, found
by Newton steps. Each step is one aggregation over (source, tokens, count), which is all that the dual needs to know
of the corpus; one pass over the documents makes that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import BROADCAST_BYTES, discard, est_tokens, free, join_hot, maybe_broadcast, written

#: The natural token share of a source is raised to this power and scaled to 1 for its target weight.
TEMPERATURE = 0.8


def source_key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("?"))


def goals(totals: DataFrame, weights: DataFrame | None, temperature: float) -> DataFrame:
    """totals (src, full tokens, ...) with goal, the tokens to take of each source. weights (src, weight): sources not
    named get 0; by default tempered shares. The budget is the least at which no source with a weight has to shrink,
    so every document is taken once at least; a source of weight 0 is left out and one without tokens is taken as
    it is."""
    some = F.col("full") > 0
    if weights is None:
        whole = totals.agg(F.sum("full")).first()[0] or 1
        t = totals.withColumn("raw", F.when(some, F.pow(F.col("full") / F.lit(whole), F.lit(temperature))).otherwise(0.0))
    else:
        t = totals.join(weights, "src", "left").withColumn("raw", F.when(some, F.coalesce("weight", F.lit(0.0))).otherwise(0.0)).drop("weight")
    parts = t.agg(F.sum("raw")).first()[0] or 1.0
    t = t.withColumn("share", F.col("raw") / F.lit(parts))
    budget = t.where("share > 0").agg(F.max(F.col("full") / F.col("share"))).first()[0] or 0.0
    return t.withColumn("goal", F.col("share") * F.lit(budget)).drop("raw", "share")


def solve(hist: DataFrame, totals: DataFrame, steps: int = 100, tolerance: float = 1e-12) -> DataFrame:
    """totals (src, docs, full, longest, goal) with lam, the multiplier of each source, per token. hist: src, tokens, n.

    Newton from 0 on sum(n * tokens * exp(lam * tokens)) = goal. That is convex and rising in lam, so a step
    from the right of the root stays right of it; a first step from the left may overshoot and is cut to where the
    longest document alone would meet the goal. Sources are independent: the Hessian of the dual is diagonal. Each step
    is one aggregation; the multipliers stay in a table, however many sources there are. An error if some source is
    not within tolerance after so many steps.
    """
    top = F.greatest(F.lit(0.0), F.log(F.col("goal") / F.col("longest"))) / F.col("longest")
    state = totals.withColumn("lam", F.lit(0.0)).withColumn("off", F.when(F.col("goal") > 0, F.abs(F.col("full") / F.col("goal") - 1)).otherwise(0.0))
    state = written(state, "multipliers")
    n = state.count()
    for step in range(steps + 1):
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            return state.drop("off")
        if step == steps:
            raise RuntimeError(f"no multipliers after {steps} steps: some source is off its goal by a share of {worst:.3g}")
        left = state.where(F.col("off") > tolerance).select("src", "lam")
        e = F.col("n") * F.exp(F.col("lam") * F.col("tokens")) * F.col("tokens")
        now = hist.join(maybe_broadcast(left, n, 96), "src").groupBy("src").agg(F.sum(e).alias("g"), F.sum(e * F.col("tokens")).alias("h"))
        # Newton on the logarithm, which is nearly straight, halves the number of steps
        by = F.log(F.col("goal") / F.col("g")) * F.col("g") / F.col("h")
        moved = F.when(by > 0, F.least(F.col("lam") + by, top)).otherwise(F.col("lam") + by)
        after = state.join(now, "src", "left")
        after = after.withColumns({"lam": F.when(F.col("g").isNotNull(), moved).otherwise(F.col("lam")), "off": F.when(F.col("g").isNotNull(), F.abs(F.col("g") / F.col("goal") - 1)).otherwise(F.col("off"))})
        before, state = state, written(after.drop("g", "h"), "multipliers")
        discard(before)


def _rated(docs: DataFrame, weights: dict[str, float] | None, temperature: float, rate: str) -> DataFrame:
    """docs with the column rate, and the tokens that it is based on in a last column."""
    hist = docs.select(source_key(F.col("source")).alias("src"), est_tokens(F.col("text")).alias("tokens")).groupBy("src", "tokens").agg(F.count("*").alias("n"))
    hist = written(hist, "length-histogram")
    totals = written(hist.groupBy("src").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("tokens")).alias("full"), F.max("tokens").alias("longest")), "source-totals")
    given = None if weights is None else docs.sparkSession.createDataFrame([("=" + s, float(w)) for s, w in weights.items()], "src string, weight double")
    src, lam, tokens = free(docs, "src", "lam", "rated_tokens")
    found = solve(hist, goals(totals, given, temperature))
    found = written(found.select(F.col("src").alias(src), F.when((F.col("goal") > 0) | (F.col("full") == 0), F.col("lam")).alias(lam), "docs"), "source-multipliers")
    rows = docs.select("*", source_key(F.col("source")).alias(src), est_tokens(F.col("text")).alias(tokens))
    n = found.count()
    # sources too many to be sent about are joined by shuffle, but for those of many documents
    joined = rows.join(F.broadcast(found.drop("docs")), src, "left") if n * 128 <= BROADCAST_BYTES else join_hot(rows, found, src, "docs")
    value = F.when(F.col(tokens) == 0, F.lit(1.0)).otherwise(F.coalesce(F.exp(F.col(lam) * F.col(tokens)), F.lit(0.0)))
    return joined.select(*(joined[c] for c in docs.columns), value.alias(rate), F.col(tokens))


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the document alone: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """Operator 9 as a report. One row for each row of docs: doc_id, source, n_tokens, rate (to 6 digits), copies.

    copies is the rate rounded down, and one more with the odds of the rest, drawn from a hash of doc_id (of the text where
    that is null): repeated rows get equal copies. Null and empty texts have 0 tokens and rate 1. An empty table gives
    no rows.
    """
    d = docs.select("doc_id", "source", "text")
    d = _rated(d, weights, temperature, "rate")
    copies = F.floor(F.col("rate") + draw(F.col("doc_id"), F.col("text"))).cast("long")
    return d.select("doc_id", "source", F.col("rated_tokens").alias("n_tokens"), F.round("rate", 6).alias("rate"), copies.alias("copies"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """docs, all columns, each row as often as mix_rates() has copies of it. A narrow step, without a shuffle of texts,
    unless there are more sources than may be broadcast."""
    rate, i = free(docs, "rate", "i")
    d = _rated(docs, weights, temperature, rate)
    copies = F.floor(F.col(rate) + draw(d["doc_id"], d["text"])).cast("int")
    return d.select(*(d[c] for c in docs.columns), F.explode(F.array_repeat(F.lit(1), copies)).alias(i)).drop(i)
