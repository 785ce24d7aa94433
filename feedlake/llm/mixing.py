"""Operator 9 [native]: mixing sources to target weights by temperature.

Source weights are token shares raised to an exponent and normalised. The exponent
lies on a grid of 1/1024 in [0, 1] (1: the shares themselves, 0: uniform) and is
found by bisection: the largest one whose weights reach ``target_entropy`` (a part of
the entropy of uniform weights), but no smaller than ``max_repeats`` allows, the most
passes over any source. Each probe is one small aggregation over the table of sources.

A source's budget is its weight times the token budget, in whole tokens. It is
realised as full passes over the source plus one partial pass; every pass orders the
source's blocks, and the documents in a block, by a digest of (pass, block or document),
and the partial pass ends before the first document that would exceed the budget. Only
block totals are summed along a source, and documents only inside the one block where
the budget ends, so a hot source is never sorted or collected in one task.

Defined results: tokens are words; null text has none. A null source is a source of
its own. A source without tokens has weight 0 and none of its documents are emitted.
Documents without tokens of other sources follow their place in the pass. Repeated
rows are documents of their own (ties of equal rows are interchangeable). An empty
table gives an empty result. Extra columns pass through, unless they carry an
output's name (epoch, block, n_tokens).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.llm.common import WORD, materialize, small

GRID = 1024


def _hex(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def block_of(doc_id: Column, blocks: int) -> Column:
    """Block number from the document's id: three hex digits of its digest."""
    return (F.conv(F.substring(_hex(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int") % blocks)


def probe(sources: DataFrame, step: int, total: float) -> tuple[float, float, float]:
    """(entropy, entropy of uniform weights, most passes per token-budget ratio) at exponent step / GRID."""
    share = F.col("tokens") / F.lit(float(total))
    power = F.pow(share, F.lit(step / GRID))
    z, zl, n, low = sources.where("tokens > 0").agg(F.sum(power), F.sum(power * F.ln(share)), F.count("*"), F.min(share)).first()
    a = step / GRID
    return math.log(z) - a * zl / z, math.log(n), low ** (a - 1) / z


def find_exponent(sources: DataFrame, total: int, budget: int, target_entropy: float | None, max_repeats: float | None) -> int:
    """Grid step of the exponent."""
    def largest(good) -> int:  # good holds from 0 up to some step
        low, high = 0, GRID
        if good(*probe(sources, high, total)):
            return high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if good(*probe(sources, mid, total)) else (low, mid)
        return low

    step = GRID
    if target_entropy is not None:
        step = largest(lambda h, top, _: h >= target_entropy * top - 1e-9)
    if max_repeats is not None:
        fits = lambda _, __, passes: passes * budget / total <= max_repeats + 1e-9
        if not fits(*probe(sources, step, total)):
            step = min(GRID, largest(lambda *x: not fits(*x)) + 1)
    return step


def mixture(docs: DataFrame, target_entropy: float | None = 0.97, max_repeats: float | None = 4.0,
            budget_ratio: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, tokens, weight, budget): one row per source, written to the shared folder."""
    counted = docs.select(F.col(source).alias("source"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("n"))
    sources = materialize(counted.groupBy("source").agg(F.sum("n").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return sources.withColumns({"weight": F.lit(0.0), "budget": F.lit(0).cast("long")})
    budget = math.floor(total * budget_ratio)
    step = find_exponent(sources, total, budget, target_entropy, max_repeats)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(step / GRID))).otherwise(0.0)
    z = sources.agg(F.sum(power)).first()[0]
    weight = power / F.lit(z)
    return sources.withColumns({"weight": weight, "budget": F.floor(weight * F.lit(budget) + F.lit(1e-6)).cast("long")})


def realise(docs: DataFrame, budgets: DataFrame, blocks: int = 1024, doc_id: str = "doc_id",
            source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, once per pass that takes them, with epoch, block and n_tokens."""
    keep = [c for c in docs.columns if c not in ("epoch", "block", "n_tokens")]
    marked = docs.select(  # given columns stay in one struct, so that no name of theirs meets one of ours
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(source).alias("of"), F.col(doc_id).alias("id"),
        block_of(F.col(doc_id), blocks).alias("block"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))
    plan = budgets.where("tokens > 0").select(
        F.col("source").alias("_s"), F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("_full"),
        (F.col("budget") % F.col("tokens")).alias("_rest"))
    plan = small(materialize(plan, "mix-plan"), 100_000)
    narrow = marked.select(F.col("of").alias("_s"), "block", "n_tokens")
    totals = narrow.groupBy("_s", "block").agg(F.sum("n_tokens").alias("_n"))
    order = _hex(F.concat_ws(":", F.col("_full").cast("string"), F.lit("block"), F.col("block").cast("string")))
    along = Window.partitionBy("_s").orderBy("_order", "block")
    edges = (_null_safe(totals, plan, "_s").withColumn("_order", order)
             .withColumn("_upto", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0))))
    # room: what is left of the partial pass when the block begins; whole: the block fits
    edges = edges.select("_s", "block", "_full", (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_room"),
                         (F.col("_upto") <= F.col("_rest")).alias("_whole"))
    edges = small(materialize(edges, "mix-blocks"), 200_000).withColumnRenamed("block", "_b")
    wide = marked.join(edges, F.col("of").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    key = _hex(F.concat_ws(":", F.col("_full").cast("string"), F.lit("doc"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    passes = wide.where("_full > 0 or _whole").withColumn("epoch", F.explode(F.expr(
        "sequence(0, _full - 1 + cast(_whole as int))"))).select("row.*", "epoch", "block", "n_tokens")
    inside = Window.partitionBy("_s", "_b").orderBy("_key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    partial = (wide.where("not _whole and _room > 0").withColumn("_key", key)
               .withColumn("_upto", F.sum("n_tokens").over(inside)).where("_upto <= _room")
               .select("row.*", F.col("_full").alias("epoch"), "block", "n_tokens"))
    return passes.unionByName(partial)


def _null_safe(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    right = b.withColumnRenamed(key, "_k")
    return a.join(right, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


def mix(docs: DataFrame, target_entropy: float | None = 0.97, max_repeats: float | None = 4.0,
        budget_ratio: float = 1.0, blocks: int = 1024) -> DataFrame:
    return realise(docs, mixture(docs, target_entropy, max_repeats, budget_ratio), blocks)
