"""Cross-validated ensembles of configurations.

Selection needs only training sums, and those are the totals over all folds minus the fold's own sums,
so one aggregation per repeat feeds every fold. Many entries of the grid share a member set: each
distinct set is averaged once per unit, and the held-out errors are summed per set.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evalpanel.functions.hashing import uniform
from evalpanel.functions.levels import attach_totals, join_bounded, running, spread
from evalpanel.session import cut_lineage

# The two selection metrics.
METRICS = ("overall", "balanced")


def stratified_folds(units: DataFrame, folds: int, repeats: int, seed: int, unit: str = "unit", hasher: str = "xx", slots: int = 256) -> DataFrame:
    """(rep, unit, bin, fold): units of a bin in hash order, dealt to folds in turn.

    Written out once: selection and scoring must see the same folds.
    """
    keyed = spread(units.select(unit, "bin"), unit).select(unit, "bin", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep")).withColumn(
        "_u", uniform(seed, ["rep", unit], hasher)
    )
    pos = running(keyed.withColumn("_n", F.lit(1).cast("bigint")), ["rep", "bin"], "_u", ["_n"], 1.0 / slots)
    return cut_lineage(pos.select("rep", unit, "bin", (F.col("below__n") % folds).cast("int").alias("fold")))


def fold_sums(panel: DataFrame, folds: DataFrame, rater: str = "rater", cond: str = "cond", unit: str = "unit") -> DataFrame:
    """Sums per (rep, fold, rater, cond, bin), and the training sums of each fold beside them."""
    own = (
        panel.select(unit, rater, cond, "e", "abs_e")
        .join(folds, unit)
        .groupBy("rep", "fold", rater, cond, "bin")
        .agg(F.count("*").alias("n"), F.sum("abs_e").alias("a"), F.sum("e").alias("b"))
    )
    whole = W.partitionBy("rep", rater, cond, "bin")
    sums = own.select(
        "rep",
        "fold",
        rater,
        cond,
        "bin",
        *[(F.sum(c).over(whole) - F.col(c)).alias(f"train_{c}") for c in ("n", "a", "b")],
    )
    # repeats x folds x cells x bins rows; three rankings read them.
    return cut_lineage(sums)


def rank_levels(train: DataFrame, level: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Order the levels on the training folds, once per selection metric.

    Ties go to the other metric, then |bias|, then the name; ``tied`` says whether the selection metric
    itself had a tie. ``within`` ranks inside each value of another axis.
    """
    keys = ["rep", "fold", *within]
    lv = [*keys, *level]
    per_bin = train.groupBy(*lv, "bin").agg(F.sum("train_n").alias("n"), F.sum("train_a").alias("a"), F.sum("train_b").alias("b"))
    per = per_bin.groupBy(*lv).agg(
        F.avg(F.col("a") / F.col("n")).alias("balanced"),
        (F.sum("a") / F.sum("n")).alias("overall"),
        F.abs(F.sum("b") / F.sum("n")).alias("bias"),
    )
    arms = per.select("*", F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("arm"))
    main = F.when(F.col("arm") == "overall", F.col("overall")).otherwise(F.col("balanced"))
    other = F.when(F.col("arm") == "overall", F.col("balanced")).otherwise(F.col("overall"))
    arms = arms.withColumns({"_main": F.round(main, 12), "_other": F.round(other, 12)})
    w = W.partitionBy(*keys, "arm")
    ordered = arms.withColumns(
        {
            "place": F.row_number().over(w.orderBy("_main", "_other", F.round("bias", 12), *level)),
            "tied": F.size(F.collect_set("_main").over(w)) < F.count("*").over(w),
        }
    )
    return ordered.select(*keys, "arm", *level, "place", "tied")


def selections(train: DataFrame, rater: str = "rater", cond: str = "cond") -> DataFrame:
    """Per (rep, fold, arm): raters and conditions in order, each rater's own best condition, tie flags."""

    def listed(ranked: DataFrame, level: str, name: str) -> DataFrame:
        entry = F.array_sort(F.collect_list(F.struct("place", level)))
        return ranked.groupBy("rep", "fold", "arm").agg(
            F.transform(entry, lambda x: x[level]).alias(name), F.bool_or("tied").alias(f"{name}_tied")
        )

    raters = listed(rank_levels(train, [rater]), rater, "rater_rank")
    conds = listed(rank_levels(train, [cond]), cond, "cond_rank")
    own = rank_levels(train, [cond], [rater])
    best = own.filter(F.col("place") == 1).groupBy("rep", "fold", "arm").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(rater, cond)))).alias("own"),
        F.count_if("tied").alias("own_ties"),
    )
    return cut_lineage(raters.join(conds, ["rep", "fold", "arm"]).join(best, ["rep", "fold", "arm"]))


def _levels(names: Sequence[str], tops: Sequence[int], ranked: str, suffix: str) -> list[tuple[str, Column, bool]]:
    """(level name, member array, is a single level) for singles, top-k tiers and the full set."""
    out = [(n, F.array(F.lit(n)), True) for n in names]
    out += [(f"top{k}{suffix}", F.slice(F.col(ranked), 1, k), False) for k in tops if k < len(names)]
    return out + [(f"all{len(names)}{suffix}", F.array_sort(F.array(*[F.lit(n) for n in names])), False)]


def membership(picks: DataFrame, raters: Sequence[str], conds: Sequence[str], tops_r: Sequence[int] = (2, 3), tops_c: Sequence[int] = (2, 3)) -> DataFrame:
    """(rep, fold, entry, members): the rater-level x condition-level grid plus the own-condition arms.

    Single configurations involve no selection and appear once; every other entry once per arm.
    """
    entries = []
    for rn, rm, r1 in _levels(raters, tops_r, "rater_rank", "R"):
        for cn, cm, c1 in _levels(conds, tops_c, "cond_rank", "C"):
            members = F.flatten(F.transform(rm, lambda r: F.transform(cm, lambda c: F.concat_ws("|", r, c))))
            single = r1 and c1
            arm = F.lit("none") if single else F.col("arm")
            entries.append((f"{rn} x {cn}", arm, members, single))
    for rn, rm, r1 in _levels(raters, tops_r, "rater_rank", "R"):
        if not r1:
            members = F.transform(rm, lambda r: F.concat_ws("|", r, F.element_at(F.col("own"), r)))
            entries.append((f"{rn}@own", F.col("arm"), members, False))
    packed = F.array(
        *[F.struct(F.lit(n).alias("name"), a.alias("selection"), F.array_sort(m).alias("members"), F.lit(s).alias("single")) for n, a, m, s in entries]
    )
    long = picks.select("rep", "fold", "arm", F.explode(packed).alias("_e"))
    once = ~F.col("_e.single") | (F.col("arm") == F.lit(METRICS[0]))
    return long.filter(once).select("rep", "fold", "_e.name", "_e.selection", "_e.members", "_e.single")


def _numbered(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with the number of their set, and the distinct sets as one row.

    Repeats x folds x entries bound the sets, and most entries choose the same few.
    """
    sets = cut_lineage(members.select("members").distinct().agg(F.array_sort(F.collect_set("members")).alias("_sets")))
    ids = attach_totals(members, sets).withColumn("_id", F.array_position("_sets", F.col("members")).cast("int"))
    return ids.drop("_sets", "members"), sets


def _per_unit_means(panel: DataFrame, sets: DataFrame, config: str, unit: str) -> DataFrame:
    """Per unit: its reference and an array with the mean prediction of every distinct member set."""
    packed = panel.groupBy(unit).agg(
        F.min("reference").alias("reference"),
        F.map_from_entries(F.collect_list(F.struct(config, "pred"))).alias("_p"),
    )
    mean = lambda s: F.aggregate(
        s, F.lit(0.0), lambda acc, c: acc + F.element_at(F.col("_p"), c), lambda acc: acc / F.size(s)
    )
    return attach_totals(packed, sets).select(unit, "reference", F.transform("_sets", mean).alias("_means"))


def out_of_fold(panel: DataFrame, folds: DataFrame, members: DataFrame, config: str = "config", unit: str = "unit") -> DataFrame:
    """Held-out prediction of every entry for every unit and repeat."""
    numbered, sets = _numbered(members)
    per_unit = _per_unit_means(panel, sets, config, unit)
    placed = folds.join(per_unit, unit).join(numbered, ["rep", "fold"])
    return placed.select(
        "rep", unit, "bin", "name", "selection", "reference", F.element_at(F.col("_means"), F.col("_id")).alias("pred")
    )


def ensemble_metrics(panel: DataFrame, folds: DataFrame, members: DataFrame, config: str = "config", unit: str = "unit") -> DataFrame:
    """Per repeat and entry: overall, balanced and mean error of the assembled held-out predictions.

    Errors are summed per (rep, fold, bin, member set) and only then spread to the entries using the set.
    """
    numbered, sets = _numbered(members)
    per_unit = _per_unit_means(panel, sets, config, unit)
    used = numbered.groupBy("rep", "fold").agg(F.array_sort(F.collect_set("_id")).alias("_used"))
    held = (
        join_bounded(folds.join(per_unit, unit), used, ["rep", "fold"])
        .select("rep", "fold", "bin", "reference", "_means", F.explode("_used").alias("_id"))
        .withColumn("_e", F.element_at(F.col("_means"), F.col("_id")) - F.col("reference"))
        .groupBy("rep", "fold", "bin", "_id")
        .agg(F.count("*").alias("n"), F.sum(F.abs("_e")).alias("a"), F.sum("_e").alias("b"))
    )
    per = numbered.join(held, ["rep", "fold", "_id"]).groupBy("rep", "name", "selection", "bin").agg(
        F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    return per.groupBy("rep", "name", "selection").agg(
        F.sum("n").alias("n"),
        (F.sum("a") / F.sum("n")).alias("overall"),
        F.avg(F.col("a") / F.col("n")).alias("balanced"),
        (F.sum("b") / F.sum("n")).alias("bias"),
    )


def over_repeats(metrics: DataFrame) -> DataFrame:
    """Mean, median and range over repeats of per-repeat metrics (repeats are a fixed number)."""
    return metrics.groupBy("name", "selection").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("overall", "balanced") for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))],
        F.avg("bias").alias("mean_bias"),
        F.count("*").alias("repeats"),
    )


def rank_distribution(metrics: DataFrame) -> DataFrame:
    """Average rank within each repeat, per selection arm on its own metric; singles compete in both arms."""
    arms = metrics.select("*", F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("arm")).filter(
        (F.col("selection") == "none") | (F.col("selection") == F.col("arm"))
    )
    v = F.round(F.when(F.col("arm") == "overall", F.col("overall")).otherwise(F.col("balanced")), 9)
    w = W.partitionBy("rep", "arm")
    ranked = arms.withColumn("_v", v).withColumn(
        "_r", F.rank().over(w.orderBy("_v")) + (F.count("*").over(W.partitionBy("rep", "arm", "_v")) - 1) / F.lit(2.0)
    )
    return ranked.groupBy("arm", "name").agg(
        F.median("_r").alias("median_rank"),
        F.min("_r").alias("best_rank"),
        F.max("_r").alias("worst_rank"),
        F.avg((F.col("_r") == 1).cast("double")).alias("share_first"),
    )


def selection_stability(picks: DataFrame, tops: Sequence[int] = (2, 3)) -> DataFrame:
    """How often each rater and condition is in the top tiers, how often each own condition is chosen."""
    parts = []
    for axis, col in (("rater", "rater_rank"), ("cond", "cond_rank")):
        pos = picks.select("arm", F.posexplode(col).alias("place", "level"))
        parts.append(
            pos.groupBy("arm", F.lit(axis).alias("axis"), "level").agg(
                F.count("*").alias("n_folds"), *[F.avg((F.col("place") < k).cast("double")).alias(f"in_top{k}") for k in tops]
            )
        )
    own = picks.select("arm", F.explode("own").alias("r", "c")).groupBy("arm", F.lit("own").alias("axis"), F.concat_ws(" -> ", "r", "c").alias("level"))
    sizes = picks.groupBy("arm").agg(F.count("*").alias("_k"))
    chosen = own.agg(F.count("*").alias("_n")).join(sizes, "arm")
    parts.append(
        chosen.select("arm", "axis", "level", F.col("_k").alias("n_folds"), *[(F.col("_n") / F.col("_k")).alias(f"in_top{k}") for k in tops])
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def selection_ties(picks: DataFrame) -> DataFrame:
    return picks.groupBy("arm").agg(
        F.count_if("rater_rank_tied").alias("rater_ties"),
        F.count_if("cond_rank_tied").alias("cond_ties"),
        F.sum("own_ties").alias("own_ties"),
    )


def training_bin_sizes(folds: DataFrame) -> DataFrame:
    """Units per bin left for training in each fold."""
    own = folds.groupBy("rep", "fold", "bin").agg(F.count("*").alias("_n"))
    whole = W.partitionBy("rep", "bin")
    return own.select("rep", "fold", "bin", (F.sum("_n").over(whole) - F.col("_n")).alias("n_train"))


def confounded_share(members: DataFrame, family_of: Column) -> DataFrame:
    """Share of folds in which an entry mixes raters of different families.

    ``family_of`` maps a member's rater name, available as column ``rater``, to its family.
    """
    long = members.select("rep", "fold", "name", "selection", F.explode("members").alias("_m"))
    fam = long.withColumn("rater", F.split("_m", "[|]")[0]).withColumn("_f", family_of)
    per = fam.groupBy("rep", "fold", "name", "selection").agg((F.min("_f") != F.max("_f")).alias("_c"))
    return per.groupBy("name", "selection").agg(F.avg(F.col("_c").cast("double")).alias("confounded_share"))


def fixed_ensemble(panel: DataFrame, k: int, rater: str = "rater", unit: str = "unit") -> DataFrame:
    """Top-k raters by overall error, all their conditions, averaged per unit."""
    from evalpanel.operators.metrics import top_k_average

    return top_k_average(panel, k, 20.0, rater, unit)
