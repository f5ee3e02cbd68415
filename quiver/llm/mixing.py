"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of levels (here domain, language, source).  At each node the
children share the parent's budget by weight; a child whose subtree can't supply its share gives
the rest to its siblings.  As a subtree's capacity counts all its leaves, a shortage is met by
siblings first and reaches an ancestor's siblings only when the whole subtree is used up.  The
shares are integers and found in closed form with window functions over the (small) tree.

Each leaf then takes whole epochs, and of the last epoch the longest prefix of its documents,
in an order seeded by (seed, epoch, id), whose tokens fit.  Prefix sums run over a histogram of
4,096 key ranges for each leaf; only the one range where the budget ends is sorted.

Null level values form a child of their own, named "".  Null texts have 0 tokens.  Repeated rows
are rows of their own.  A leaf without tokens is taken whole, once.  Empty input: empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.llm.common import checkpoint, small_join

#: Hexadecimal digits of the order key that make a range of the histogram.
DIGITS = 3


def weight_of(level: str, weights: Mapping[str, int]) -> Column:
    """A child's weight: an integer from 0 to 10,000, 1 where none is given."""
    if any(not 0 <= w <= 10_000 for w in weights.values()):
        raise ValueError("weights are integers from 0 to 10,000")
    out = F.lit(1)
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
    return out.cast("bigint")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column) -> DataFrame:
    """leaves: (levels, tokens, capacity).  Adds each leaf's share of the budget, at most its capacity.

    Children in order of capacity per weight are used up until the first whose share is smaller
    than its capacity; the others share what is left.
    """
    nodes = leaves.select(*levels, "tokens", "capacity", budget.cast("bigint").alias("given"))
    for depth, level in enumerate(levels):
        above = list(levels[:depth])
        family = nodes.groupBy(*above, level).agg(F.sum("capacity").alias("c"), F.first("given").alias("b"))
        family = family.withColumn("w", weight_of(level, weights.get(level, {})))
        inside = Window.partitionBy(*(above or [F.lit(0)]))
        order = inside.orderBy(F.when(F.col("w") == 0, F.lit(float("inf"))).otherwise(F.col("c") / F.col("w")), level)
        family = family.withColumns({
            "c_before": F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c"),
            "w_from": F.sum("w").over(inside) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("w"),
        })
        used_up = (F.col("w") > 0) & (F.col("c") * F.col("w_from") <= (F.col("b") - F.col("c_before")) * F.col("w"))
        family = family.withColumn("full", used_up.cast("int"))
        family = family.withColumns({
            "c_full": F.sum(F.col("c") * F.col("full")).over(inside),
            "w_open": F.sum(F.col("w") * (1 - F.col("full"))).over(inside),
        })
        share = F.when(F.col("full") == 1, F.col("c")).when(F.col("w") == 0, F.lit(0)).otherwise(F.expr("((b - c_full) * w) div greatest(w_open, 1)"))
        family = family.select(*above, level, share.cast("bigint").alias("given"))
        nodes = nodes.drop("given").join(family, [*above, level])
    return nodes


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], tokens: Column, share: float = 0.5, max_epochs: int = 2, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """The selected rows of docs with all their columns, then mix_<level>, mix_tokens and mix_epoch, one row per copy.

    levels: name -> expression over docs, outermost first.  The budget is share (in thousandths)
    of all tokens, or all that max_epochs can supply.  Columns of docs that begin with mix_ are replaced.
    """
    names = [f"mix_{x}" for x in levels]
    rows = docs.drop(*[c for c in docs.columns if c.startswith("mix_")]).withColumns(
        {f"mix_{x}": F.coalesce(e.cast("string"), F.lit("")) for x, e in levels.items()} | {"mix_tokens": F.coalesce(tokens, F.lit(0)).cast("bigint")}
    )
    leaves = checkpoint(rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    everything = Window.partitionBy(F.lit(0))
    total = leaves.withColumn("total", F.sum("tokens").over(everything))
    wanted = F.expr(f"(total * {round(share * 1000)}) div 1000")
    total = total.withColumn("wanted", F.least(wanted, F.sum("capacity").over(everything)))
    given = budgets(total, names, {f"mix_{x}": w for x, w in weights.items()}, F.col("wanted"))
    given = given.withColumns({"epochs": F.expr("if(tokens = 0, 0, given div tokens)").cast("int")})
    given = checkpoint(given.withColumn("rest", F.col("given") - F.col("epochs") * F.col("tokens")).select(*names, "epochs", "rest"))
    n = given.count()

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    keyed = small_join(rows, given, names, size=200 * n).withColumn("mix_key", key).withColumn("mix_bin", F.substring("mix_key", 1, DIGITS))
    histogram = keyed.groupBy(*names, "rest", "mix_bin").agg(F.sum("mix_tokens").alias("t"))
    running = histogram.withColumn("end", F.sum("t").over(Window.partitionBy(*names).orderBy("mix_bin")))
    # The first range that doesn't fit, and what the ranges before it hold: one row per leaf.
    ends = running.where("end > rest").groupBy(*names).agg(F.min(F.struct("mix_bin", (F.col("end") - F.col("t")).alias("start"))).alias("last"))
    ends = checkpoint(ends.select(*names, F.col("last.mix_bin").alias("last_bin"), F.col("last.start").alias("start")))
    keyed = small_join(keyed, ends, names, "left", size=200 * n)
    before = F.coalesce(F.col("mix_bin") < F.col("last_bin"), F.lit(True))
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>"))
    drop = ["epochs", "rest", "mix_key", "mix_bin", "last_bin", "start"]
    most = keyed.withColumn("mix_epoch", F.explode(F.concat(whole, F.when(before, F.array("epochs")).otherwise(F.array().cast("array<int>")))))
    edge = keyed.where(F.col("mix_bin") == F.col("last_bin"))
    order = Window.partitionBy(*names).orderBy("mix_key", "mix_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("mix_end", F.col("start") + F.sum("mix_tokens").over(order)).where("mix_end <= rest").drop("mix_end").withColumn("mix_epoch", F.col("epochs"))
    return most.drop(*drop).unionByName(edge.drop(*drop))

