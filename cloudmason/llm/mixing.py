"""Sources mixed to target weights under a cap on repetition.

Temperature: source token shares are raised to an exponent, which is bisected until the weights have the entropy asked
for or the repetition limit binds. Weights become token budgets; each source's budget is met by whole permutations of its
documents and one partial one, cut by prefix sums over hash blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 1024
STEPS = 80


def tempered(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares proportional to size ** exponent; sources without tokens get 0."""
    top = max(sizes.values(), default=0) or 1.0
    raised = {s: (n / top) ** exponent if n > 0 else 0.0 for s, n in sizes.items()}
    total = sum(raised.values()) or 1.0
    return {s: r / total for s, r in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def exponent_for(sizes: dict[str, float], target_entropy: float, max_repeats: dict[str, float]) -> tuple[float, str]:
    """(exponent, binding): the exponent in [0, 1] whose weights have the target entropy, or, where a source would then be
    used more often than allowed, the smallest exponent that keeps the limit. Entropy and repeats fall as it grows."""
    total = sum(sizes.values())

    def bisect(ok) -> float:
        low, high = 0.0, 1.0  # ok(high) holds, ok(low) does not
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    def limited(a: float) -> bool:
        return all(w * total <= sizes[s] * max_repeats.get(s, math.inf) * (1 + 1e-12) for s, w in tempered(sizes, a).items() if sizes[s] > 0)

    def calm(a: float) -> bool:
        return entropy(tempered(sizes, a)) <= target_entropy

    wanted = 0.0 if calm(0.0) else 1.0 if not calm(1.0) else bisect(calm)
    if limited(wanted):
        return wanted, "entropy"
    return (0.0 if limited(0.0) else bisect(limited)), "repeats"


def budgets(sizes: dict[str, int], weights: dict[str, float], max_repeats: dict[str, int], total: int) -> list[dict]:
    """Per source: tokens, target_share, budget, and the budget the cap allows. A capped source falls short; its rest goes
    to no other source, whose own target it would break."""
    rows = []
    for s in sorted(weights):
        most = sizes.get(s, 0) * max_repeats[s]
        rows.append({"source": s, "source_tokens": sizes.get(s, 0), "target_share": weights[s], "budget": min(round(weights[s] * total), most), "capped": round(weights[s] * total) > most, "max_repeats": max_repeats[s]})
    return rows


def realise(documents: DataFrame, plan: list[dict], seed: int = 17) -> DataFrame:
    """doc_id, source, tokens, uses: each used document with the number of its uses.

    documents: doc_id, source, tokens. The budget is met by whole rounds and a partial one in the order of a hash
    permutation: a document is in the partial round while the running sum before it plus half its size stays within the
    rest, so that the realised total is the closest that a cut of the permutation allows, and only if that keeps its
    repeats within the cap. Defined cases: documents of other or null sources, or without tokens, are not used; repeated
    doc_ids count as documents of their own; an empty plan or table gives no row.
    """
    spark = documents.sparkSession
    schema = "source string, source_tokens long, target_share double, budget long, capped boolean, max_repeats int"
    wanted = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in plan], schema)  # one row per planned source
    usable = documents.select("doc_id", "source", F.col("tokens").cast("long").alias("tokens")).filter("tokens > 0")
    usable = usable.join(F.broadcast(wanted) if len(plan) <= 10_000 else wanted, "source").filter("source_tokens > 0")
    usable = usable.withColumn("rounds", F.floor(F.col("budget") / F.col("source_tokens"))).withColumn("rest", F.col("budget") - F.col("rounds") * F.col("source_tokens"))
    usable = usable.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("block", F.pmod("h", F.lit(BLOCKS)))
    sums = usable.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    offsets = sums.withColumn("offset", F.sum("block_tokens").over(Window.partitionBy("source").orderBy("block")) - F.col("block_tokens")).drop("block_tokens")
    within = Window.partitionBy("source", "block").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = usable.withColumn("upto", F.sum("tokens").over(within)).join(offsets, ["source", "block"])
    before = F.col("offset") + F.col("upto") - F.col("tokens")
    extra = F.when((before + F.col("tokens") / 2 <= F.col("rest")) & (F.col("rest") > 0) & (F.col("rounds") < F.col("max_repeats")), 1).otherwise(0)
    return at.select("doc_id", "source", "tokens", (F.col("rounds") + extra).cast("int").alias("uses")).filter("uses > 0")


def source_sizes(documents: DataFrame, sources: list[str]) -> dict[str, int]:
    """Tokens of each planned source; no other source reaches the driver."""
    planned = documents.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return {r["source"]: r["tokens"] for r in documents.join(planned, "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}


def mix(documents: DataFrame, targets: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(uses, report) for explicit target shares of all tokens of documents.

    targets: source, target_share, max_repeats. report: source, source_tokens, target_share, max_repeats, budget,
    used_tokens, actual_share (of all tokens), capped, most_uses.
    """
    sizes = source_sizes(documents, [t["source"] for t in targets])
    total = documents.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(sizes, {t["source"]: t["target_share"] for t in targets}, {t["source"]: t["max_repeats"] for t in targets}, total)
    uses = realise(documents, plan)
    rows = documents.sparkSession.createDataFrame([(r["source"], r["source_tokens"], r["target_share"], r["max_repeats"], r["budget"], r["capped"]) for r in plan], "source string, source_tokens long, target_share double, max_repeats int, budget long, capped boolean")
    got = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    report = rows.join(got, "source", "left").fillna(0, ["used_tokens", "most_uses"]).withColumn("actual_share", F.col("used_tokens") / F.lit(max(total, 1)))
    return uses, report
