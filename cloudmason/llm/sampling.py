"""Samples that match target category proportions, by systematic sampling with unequal probabilities.

Within a plan the points stand in order of category and, inside a category, in random order. Each has an inclusion
probability; the running sum of these, carried over buckets by prefix sums of bucket counts, is cut at the integers from
one random start. Because the probability is constant inside a category, the running sum at a rank is arithmetic, so no
single task ever orders a whole category. Floors are repaired from the same ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudmason.functions.frames import plain
from cloudmason.session import cut, partitions

#: Guards floor() against the last bit of a running sum.
EPS = 1e-9


def waterfill(shares: np.ndarray, floors: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """Amounts in proportion to shares, no less than floors and no more than most, that sum to total as far as that goes."""
    floors = np.minimum(floors, most)
    if floors.sum() >= total or not shares.sum():
        return floors.astype(float)
    low, high = 0.0, 1.0
    amount = lambda level: np.clip(level * shares, floors, most)
    while amount(high).sum() < total and high < 1e12:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if amount(mid).sum() < total else (low, mid)
    return amount(high)


def settle(own: pd.DataFrame, start: float) -> pd.DataFrame:
    """One plan's categories, sorted: probability, running sum before, whole crossings, rows added and removed by repair."""
    own = own.sort_values("category")
    share = own["target_pct"].to_numpy(float) * own["sample_size"].to_numpy(float) / 100
    most, floors = own["available"].to_numpy(float), np.minimum(own["min_rows"].to_numpy(float), own["available"].to_numpy(float))
    total = float(min(own["sample_size"].max(), most.sum()))
    amount = waterfill(share, floors, most, total)
    p = np.divide(amount, most, out=np.zeros(len(own)), where=most > 0)
    before = np.cumsum(amount) - amount
    crossed = (np.floor(start + before + most * p + EPS) - np.floor(start + before + EPS)).astype(np.int64)
    added = np.maximum(0, floors.astype(np.int64) - crossed)
    removed = np.zeros(len(own), np.int64)
    for _ in range(int(max(0, min((crossed + added).sum() - max(total, floors.sum()), added.sum())))):  # the rows added come off the largest surplus
        spare = crossed - removed - np.maximum(floors, np.floor(amount))
        k = int(np.argmax(np.where(crossed - removed > floors, spare, -np.inf)))
        if crossed[k] - removed[k] <= floors[k]:
            break
        removed[k] += 1
    return own.assign(p=p, before=before, start=start, kept=crossed - removed, added=added, drawn=crossed - removed + added)


SETTLED = "plan_id long, grp string, category int, target_pct int, sample_size long, min_rows int, available long, wanted double, unmet boolean, p double, before double, start double, kept long, added long, drawn long"


def _settle_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [b for b in batches if len(b)]
    if rows:
        for _, own in pd.concat(rows, ignore_index=True).groupby("plan_id"):
            yield plain(settle(own, float(own["start"].iloc[0]))[[c.split()[0] for c in SETTLED.split(", ")]])


def allocate(plan: DataFrame, available: DataFrame, seed: int) -> DataFrame:
    """Per planned category SETTLED: wanted is the larger of target_pct x sample_size / 100 and min_rows; unmet says that
    there are fewer points than that. Amounts follow the target shares, at least min_rows and at most what there is; what
    a short category leaves goes to the others in proportion, so that the sample keeps its size where the scene allows."""
    share = F.col("target_pct") * F.col("sample_size") / F.lit(100.0)
    d = plan.join(available, ["grp", "category"], "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    d = d.withColumn("wanted", F.greatest(share, F.col("min_rows").cast("double"))).withColumn("unmet", F.col("available") < F.col("wanted"))
    start = F.pmod(F.xxhash64("plan_id", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    typed = [F.col(c.split()[0]).cast(c.split()[1]) for c in SETTLED.split(", ")[:9]]
    return d.select(*typed, start.alias("start")).repartition(partitions(plan.sparkSession), "plan_id").mapInPandas(_settle_all, SETTLED)


def _crossings(start: Column, before: Column, rank: Column, p: Column) -> Column:
    """Integers that the running sum has passed at a rank, counted from the category's beginning."""
    return F.floor(start + before + rank * p + F.lit(EPS)) - F.floor(start + before + F.lit(EPS))


def unit_points(points: DataFrame) -> DataFrame:
    """One row per (grp, unit): the reading with the smallest id counts."""
    return points.filter(F.col("grp").isNotNull()).groupBy("grp", "unit").agg(F.min(F.struct("id", "category")).alias("first")).select("grp", "unit", "first.id", "first.category").filter(F.col("category").isNotNull())


def draw(points: DataFrame, plan: DataFrame, seed: int = 20240501) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for every plan.

    points: grp, unit, id, category; the rows of one unit are readings of the same point and count once. plan: plan_id,
    grp, category, target_pct, sample_size, min_rows. sample: plan_id, grp, unit, id, category, one row per drawn point. report: the plan's columns,
    wanted, available, unmet, drawn, short_rows (how far drawn stays below wanted). Defined cases: points without a group or category are never drawn;
    a null unit is one unit of its group; a plan of a group without points draws nothing and reports all categories
    unmet; target shares of 0 draw only the floor; repeated plan rows are read once; empty tables give empty results.
    """
    plan = plan.select("plan_id", "grp", "category", "target_pct", "sample_size", "min_rows").dropDuplicates(["plan_id", "category"])
    units = unit_points(points)
    salted = units.withColumn("salt", F.pmod(F.xxhash64("unit", F.lit(seed)), F.lit(1 << 20)))
    fine = salted.groupBy("grp", "category", F.shiftright("salt", 10).alias("part")).count()
    available = fine.groupBy("grp", "category").agg(F.sum("count").alias("available"))
    # Read twice, by the report and by the sample; a few rows per plan.
    classes = cut(allocate(plan, available, seed))
    report = classes.select("plan_id", "grp", "category", "target_pct", "sample_size", "min_rows", "wanted", "available", "unmet", "drawn", F.greatest(F.lit(0), F.ceil("wanted") - F.col("drawn")).alias("short_rows"))

    # Ranks: 1024 hash parts per category; offsets by prefix sums of the part counts, a bounded window per category.
    offsets = fine.withColumn("offset", F.sum("count").over(Window.partitionBy("grp", "category").orderBy("part")) - F.col("count")).drop("count")
    asked = classes.filter(F.col("drawn") > 0).select("plan_id", "grp", "category", "p", "before", "start", "kept", "added").join(offsets, ["grp", "category"])
    within = Window.partitionBy("grp", "category", "part").orderBy("salt", F.xxhash64("unit"), "unit")
    ranked = salted.withColumn("part", F.shiftright("salt", 10)).withColumn("k", F.row_number().over(within))
    both = ranked.join(asked, ["grp", "category", "part"]).withColumn("rank", F.col("offset") + F.col("k"))
    upto = _crossings(F.col("start"), F.col("before"), F.col("rank"), F.col("p"))
    hit = upto > _crossings(F.col("start"), F.col("before"), F.col("rank") - 1, F.col("p"))
    sample = both.filter((hit & (upto <= F.col("kept"))) | (~hit & (F.col("rank") - upto <= F.col("added")))).select("plan_id", "grp", "unit", "id", "category")
    return sample, report
