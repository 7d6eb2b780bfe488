"""Mixing sources to target weights by exact token lengths.

A source whose target is r times its size and a rest takes every document r times. The rest is filled by documents
once more: for each length the same share of its documents, rounded down; then a few more documents by bounded
knapsack over the length counts, so that the sum comes as near the target as lengths allow without passing it.
Which documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import use_workers, written
from plumbline.tables import in_order

#: Largest budget that dynamic programming fills; a greedy descent through the lengths leaves less than that.
STATES = 1 << 16
#: Parts of each length's documents that are counted apart, so that no window spans a whole length.
PARTS = 256
#: Sources whose sizes the driver lists; rows that nothing tells apart in a run.
MOST_SOURCES, RUN = 1 << 17, 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], share: float, most: float) -> dict[str | None, float]:
    """Each source's target: its weight's part of share times all sizes, at most most times its own, excess reshared.

    Sources come in code point order, null last; weights repeat.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left, found = dict(order), share * sum(n for _, n in order), {}
    open_ = [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not over:
            found |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            found[s] = most * size[s]
        left -= sum(found[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return found


def target_table(per_source: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, total): the same targets for any number of sources.

    Whose target stops is told by one number, what a unit of weight gets; each round works it out anew from two sums, and it
    only rises, so the driver holds nothing but that.
    """
    ordered = in_order(per_source.withColumn("is_null", F.col("source").isNull()), ["is_null", "source"], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = written(ordered.select("source", F.col("total").alias("source_size"), weight.alias("weight")), "sources")
    top = F.lit(float(most)) * F.col("source_size")
    all_words = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    over, left, total, before = F.lit(False), all_words, 0, -1
    while True:
        sums = rows.agg(F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.sum(F.when(over, top)).alias("held"), F.count_if(over).alias("n")).first()
        left, total = all_words - (sums["held"] or 0.0), sums["weight"] or 0
        if sums["n"] == before or not total:
            break
        before = sums["n"]
        over = F.lit(left) * F.col("weight") / F.lit(total) > top
    open_target = F.lit(left) * F.col("weight") / F.lit(total) if total else top
    return rows.select("source", "source_size", F.when(over, top).otherwise(open_target).alias("target"))


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum as near to budget as possible, not above."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = counts * budget // total if total < 1 << 31 else np.array([int(c) * budget // total for c in counts])
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left < STATES:
            break
        more = min(int(counts[i] - take[i]), (left - STATES // 2) // int(lengths[i]))
        if more > 0:
            take[i] += more
            left -= more * int(lengths[i])
    if left >= STATES:  # single documents longer than what may be left over: the largest that still fit
        for i in np.argsort(-lengths, kind="stable"):
            more = min(int(counts[i] - take[i]), left // int(lengths[i]))
            take[i] += more
            left -= more * int(lengths[i])
    left = min(left, STATES)
    # bounded knapsack: reach is a bit set of sums; a length's copies are split into powers of two
    items, reach, before = [], 1, []
    mask = (1 << (left + 1)) - 1
    for i in np.argsort(lengths, kind="stable"):
        n, c, power = int(lengths[i]), int(counts[i] - take[i]), 1
        c = min(c, left // n if n <= left else 0)
        while c > 0:
            k = min(power, c)
            before.append(reach)
            items.append((i, k, n * k))
            reach |= (reach << n * k) & mask
            c -= k
            power *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for (i, k, w), old in zip(reversed(items), reversed(before)):
        if not old >> at & 1:
            take[i] += k
            at -= w
    return take


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 8, carry: list[str] | None = None) -> DataFrame:
    """Every row with its size in words, its source's size and target, and how often the mix takes it (copies).

    Sizes count runs of characters other than space and \\t to \\r; a null text has size 0. A row without words is taken
    as often as its source's whole copies say, which adds nothing. Null sources form one source. Rows of equal keys
    and lengths are told apart by the columns in carry, or by nothing: then any of them may be taken, always as many. An
    empty table gives none. carry names further columns to keep, short ones, as they are shuffled; they must not be called
    size, source_size, target, taken or copies. Up to MOST_SOURCES sources are listed on the driver and broadcast; the targets
    of more are worked out where their sizes lie.
    """
    use_workers(docs.sparkSession)
    carry = list(carry or [])
    if {"size", "source_size", "target", "taken", "copies"} & {*carry, key}:
        raise ValueError("size, source_size, target, taken and copies are reserved")
    named = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    part = F.pmod(F.xxhash64(F.lit(seed), "key", "size"), F.lit(PARTS)).cast("int")
    rows = written(named.withColumn("part", part), "sizes")
    counts = written(rows.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "lengths")
    sums = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    per_source = [(r["source"], r["total"]) for r in sums.limit(MOST_SOURCES + 1).collect()]
    spark = docs.sparkSession
    if len(per_source) <= MOST_SOURCES:
        goal = targets(per_source, weights, share, most)
        known = spark.createDataFrame([(s, n, float(goal[s])) for s, n in per_source], "source string, source_size long, target double")
    else:
        known = written(target_table(sums, weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    budget = F.when(F.col("source_size") > 0, F.bround("target").cast("long") - whole * F.col("source_size")).otherwise(0).cast("long")
    known = known.withColumns({"whole": whole, "budget": budget})
    known = F.broadcast(known) if len(per_source) <= MOST_SOURCES else known

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("size")
        own["extra"] = fill(own["size"].to_numpy(), own["n"].to_numpy(), int(own["budget"].iloc[0]))
        return own[["source", "size", "extra"]]

    by_length = counts.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n"))
    same = F.col("l.source").eqNullSafe(F.col("s.source"))
    budgeted = by_length.alias("l").join(known.alias("s"), same).select("l.source", "l.size", "l.n", "s.budget").where("budget > 0")
    extra = budgeted.groupBy("source").applyInPandas(choose, "source string, size long, extra long")
    # within a length, parts are taken in order until its number is reached; one part is taken in part
    reach = F.sum("n").over(Window.partitionBy("source", "size").orderBy("part"))
    cut = counts.withColumn("upto", reach).alias("c").join(extra.alias("e"), F.col("c.source").eqNullSafe(F.col("e.source")) & (F.col("c.size") == F.col("e.size")))
    quota = cut.select(F.col("c.source").alias("source"), F.col("c.size").alias("size"), "part", "n", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("upto") + F.col("n"))).alias("quota"))
    on = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size")) & (F.col(f"{a}.part") == F.col(f"{b}.part"))
    joined = rows.alias("r").join(quota.alias("q"), on("r", "q"), "left")
    picked = joined.select("r.*", F.coalesce("q.quota", F.lit(0)).alias("quota"), F.coalesce("q.n", F.lit(0)).alias("n"))
    full = picked.where("quota = 0 or quota = n").withColumn("more", (F.col("quota") > 0).cast("int"))
    # rows that nothing tells apart count as one of so many, and are dealt out again in runs of bounded length
    alike = picked.where("quota > 0 and quota < n").groupBy(*picked.columns).agg(F.count("*").alias("alike"))
    order = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key", *(f"c{i}" for i in range(len(carry)))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = alike.withColumn("take", F.greatest(F.lit(0), F.least("alike", F.col("quota") - F.sum("alike").over(order) + F.col("alike"))))
    runs = some.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / RUN)))).repartition("source", "size", "key", "run")
    each = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("alike"), (F.col("run") + 1) * RUN) - 1))
    split = runs.withColumn("i", each).withColumn("more", (F.col("i") < F.col("take")).cast("int")).select(*full.columns)
    done = full.unionByName(split).alias("d").join(known.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    copies = (F.col("s.whole") + F.col("d.more")).cast("int")
    kept = [F.col(f"d.c{i}").alias(c) for i, c in enumerate(carry)]
    return done.select(F.col("d.key").alias(key), *kept, F.col("d.size").alias("size"), F.col("s.source_size").alias("source_size"), F.col("s.target").alias("target"), (F.col("d.size") * copies).cast("long").alias("taken"), copies.alias("copies"))
