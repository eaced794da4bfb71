"""Splits without leaks: group features, scores of assignments, the search for the best, frozen splits, oversampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SPLITS = ("train", "val", "test")


def group_features(df: DataFrame, group: str, features: dict[str, Column]) -> DataFrame:
    """One row a group: samples, and for each feature the rows in which it holds."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("samples"), *[F.count_if(c).alias(name) for name, c in features.items()])


def long_features(wide: DataFrame, group: str) -> DataFrame:
    names = [c for c in wide.columns if c != group]
    return wide.unpivot(group, names, "feature", "n")


def assignment_scores(features: DataFrame, assignments: DataFrame, ratios: dict[str, float], group: str) -> DataFrame:
    """score of each attempt of assignments (attempt, group, split), from features (group, feature, n) in long form.

    Sum over splits and features of weight (count - target)^2 / max(1, target), 8 for samples and 1 otherwise, and 100 for each
    other feature that three groups or more have and a split hasn't. Attempts may be many: each is the sum for empty splits,
    which is one number for all, corrected by the cells that it fills. An attempt must name every group.
    """
    totals = features.groupBy("feature").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("groups"))
    ratio = F.element_at(F.create_map(*[F.lit(x) for s in SPLITS for x in (s, float(ratios[s]))]), F.col("split"))
    target = F.col("total") * ratio
    weight = F.when(F.col("feature") == "samples", 8.0).otherwise(1.0)

    def cost(n: Column) -> Column:
        empty = F.when((F.col("feature") != "samples") & (F.col("groups") >= len(SPLITS)) & (n == 0), 100.0).otherwise(0.0)
        return weight * (n - target) * (n - target) / F.greatest(F.lit(1.0), target) + empty

    base = totals.withColumn("split", F.explode(F.array(*[F.lit(s) for s in SPLITS]))).agg(F.sum(cost(F.lit(0)))).first()[0] or 0.0
    cells = assignments.join(features, group).groupBy("attempt", "feature", "split").agg(F.sum("n").alias("n")).join(totals, "feature")
    return cells.groupBy("attempt").agg((F.lit(base) + F.sum(cost(F.col("n")) - cost(F.lit(0)))).alias("score"))


def random_search(features: DataFrame, group: str, ratios: dict[str, float], seed: int, attempts: int = 6000) -> DataFrame:
    """(group, split) of the best of seeded random assignments that use every split; ties go to the least names in group order.

    A draw is a hash of seed, attempt and group, so each row of groups makes its own draws and reruns agree; nothing of it is
    on the driver. Scores count to six decimals.
    """
    groups = features.select(group).distinct()
    if groups.limit(len(SPLITS)).count() < len(SPLITS):
        raise ValueError("three groups at least are needed for three splits")
    tried = groups.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(max(1, attempts) - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "attempt", group)), 1, 13), 16, 10).cast("double") / float(1 << 52)
    split, upto = F.lit(SPLITS[-1]), 1.0
    for name in reversed(SPLITS[:-1]):
        upto -= ratios[SPLITS[SPLITS.index(name) + 1]]
        split = F.when(u < round(upto, 9), name).otherwise(split)
    drawn = tried.withColumn("split", split)
    names = drawn.groupBy("attempt").agg(F.transform(F.array_sort(F.collect_list(F.struct(group, "split"))), lambda s: s["split"]).alias("names")).where(F.size(F.array_distinct("names")) == len(SPLITS))
    scores = assignment_scores(features, drawn.join(names.select("attempt"), "attempt", "left_semi"), ratios, group)
    best = scores.join(names, "attempt").agg(F.min_by("attempt", F.struct(F.bround("score", 6), "names")).alias("attempt"))
    return drawn.join(F.broadcast(best), "attempt").select(group, "split")


def split_quotas(counts: DataFrame, groups: str, val: float, test: float) -> DataFrame:
    """counts with train, val and test: how many of so many groups each split gets. Validation and test get their rounded share,
    one at least; if nothing would be left for training, the larger of them (validation if equal) gives way. Fewer than three
    groups stop the query."""
    n = F.col(groups)
    enough = F.when(n >= len(SPLITS), n).otherwise(F.raise_error(F.lit("three groups at least are needed for three splits")).cast("long"))
    share = lambda r: F.greatest(F.lit(1), F.bround(enough * r, 0)).cast("long")
    out = counts.withColumn("_v", share(val)).withColumn("_t", share(test)).withColumn("_over", F.greatest(F.lit(0), F.col("_v") + F.col("_t") - n + 1))
    first = F.col("_v") >= F.col("_t")
    out = out.withColumn("val", F.col("_v") - F.when(first, F.col("_over")).otherwise(0)).withColumn("test", F.col("_t") - F.when(first, 0).otherwise(F.col("_over")))
    return out.withColumn("train", n - F.col("val") - F.col("test")).drop("_v", "_t", "_over")


def frozen(groups: DataFrame, before: DataFrame, group: str) -> DataFrame:
    """Groups keep the split they had; new ones go to train."""
    return groups.join(before.select(group, F.col("split").alias("_was")), group, "left").withColumn("split", F.coalesce("_was", F.lit("train"))).drop("_was")


def frozen_errors(groups: DataFrame, before: DataFrame, group: str) -> DataFrame:
    """Frozen groups that are gone or are listed twice or under an unknown split."""
    gone = before.join(groups, group, "left_anti").select(group, F.lit("missing").alias("error"))
    twice = before.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(group, F.lit("duplicate").alias("error"))
    unknown = before.where(~F.col("split").isin(*SPLITS)).select(group, F.lit("unknown split").alias("error"))
    return gone.unionByName(twice).unionByName(unknown)


def incremental_plan(old: DataFrame, new: DataFrame, group: str, ratios: dict[str, float], seed: int = 0, attempts: int = 20_000) -> DataFrame:
    """(group, split) of new groups (group, n images) beside fixed ones (group, split, n): the least squared deviation of the
    splits' shares from the ratios (to twelve decimals), then the least choice.

    All choices are tried if they are no more than attempts, in the order of the groups' names, else hashed ones. Each new
    group makes its own rows of all choices, which are summed by choice; a plan adds few groups, and one row each is numbered.
    """
    numbered = new.withColumn("_i", F.row_number().over(W.orderBy(group)) - 1)
    k, n_splits = new.count(), len(SPLITS)
    fixed = {r["split"]: r["n"] for r in old.groupBy("split").agg(F.sum("n").alias("n")).collect() if r["split"] in SPLITS}
    every = n_splits**k <= attempts
    tried = numbered.withColumn("_choice", F.explode(F.sequence(F.lit(0), F.lit((n_splits**k if every else attempts) - 1))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "_choice", group)), 1, 13), 16, 10).cast("long") % n_splits
    digit = F.floor(F.col("_choice") / F.pow(F.lit(float(n_splits)), F.lit(k - 1) - F.col("_i"))).cast("long") % n_splits if every else drawn
    tried = tried.withColumn("_split", digit)
    sums = tried.groupBy("_choice").agg(F.sum("n").alias("_all"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_split"))), lambda d: d["_split"]).alias("_digits"), *[F.coalesce(F.sum(F.when(F.col("_split") == s, F.col("n"))), F.lit(0)).alias(f"_{s}") for s in range(n_splits)])
    total = F.greatest(F.lit(1), F.col("_all") + sum(fixed.values()))
    cost = sum(((F.lit(fixed.get(name, 0)) + F.col(f"_{s}")) / total - ratios[name]) * ((F.lit(fixed.get(name, 0)) + F.col(f"_{s}")) / total - ratios[name]) for s, name in enumerate(SPLITS))
    best = sums.agg(F.min_by("_choice", F.struct(F.bround(cost, 12), "_digits")).alias("_choice"))
    return tried.join(F.broadcast(best), "_choice").select(group, F.element_at(F.array(*map(F.lit, SPLITS)), (F.col("_split") + 1).cast("int")).alias("split"))


def oversample(df: DataFrame, label: str, order: str) -> DataFrame:
    """Rows of each class repeated in order, round after round, up to the size of the largest; copy counts a row's repeats.

    How often a row is repeated follows from its number in the class and the class's size, so nothing is joined but one
    row a class.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most"))
    numbered = df.withColumn("_i", F.row_number().over(W.partitionBy(label).orderBy(order)) - 1).join(F.broadcast(sizes.join(most)), label)
    copies = F.floor(F.col("_most") / F.col("_n")) + F.when(F.col("_i") < F.col("_most") % F.col("_n"), 1).otherwise(0)
    return numbered.withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int")))).drop("_i", "_n", "_most")


def frames_per_source(df: DataFrame, index: Column, total: int, sources: int) -> DataFrame:
    """How many of total frames each of the numbered sources gets: the first ones get the remainder."""
    return df.withColumn("frames", F.lit(total // sources) + F.when(index < total % sources, 1).otherwise(0))


def negative_weight(negative: Column, weight: float) -> Column:
    """weight for rows without a target, 1 for the others."""
    return F.when(negative, weight).otherwise(1.0)


def weighted_draw(df: DataFrame, key: str, weight: str, seed: int) -> DataFrame:
    """key and times: as many draws as rows, with replacement, by weight.

    Row i of the draw falls on a point of the total weight, and the row whose share of it holds the point is drawn. Shares are
    running sums over runs of rows, 4096 runs by a hash of the key, and the points that fall into a run are counted there, so
    no task holds more than a run. Reruns with one seed agree.
    """
    runs = 4096
    rows = df.withColumn("_run", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(runs)))
    sums = rows.groupBy("_run").agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    # one row a run: 4096 at most
    edges = sums.select("_run", (F.sum("_w").over(W.orderBy("_run")) - F.col("_w")).alias("_start"), F.sum("_w").over(W.partitionBy()).alias("_total"), F.sum("_n").over(W.partitionBy()).alias("_draws"))
    inside = W.partitionBy("_run").orderBy(F.xxhash64(F.lit(seed + 1), key), key)
    placed = rows.join(F.broadcast(edges), "_run").withColumn("_end", F.col("_start") + F.sum(weight).over(inside)).withColumn("_begin", F.col("_end") - F.col(weight))
    # point i of the draw is (i + u) / draws of the total, u one number from the seed: a systematic sample
    u = random.Random(seed).random()
    before = lambda c: F.ceil(F.col(c) / F.col("_total") * F.col("_draws") - u)
    return placed.select(key, (before("_end") - before("_begin")).cast("long").alias("times")).where("times > 0")
