"""Containers of fixed capacity filled with items, mixture-controlled.

Items of each source wait in a queue. Deficit round-robin credits every source with its target share of each container;
the source with the largest credit gives the largest item that still fits. What a source could not give, or gave beyond
its share, is carried to the next container. A last look for the largest item of any source that fits keeps unused space
low. Containers that stay open at a partition's end are dissolved and their items packed again, in fewer partitions,
among which the credits of all partitions are divided by their tokens.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudmason.session import cut

CAPACITY = 2048
#: Tokens packed by one task.
PART_TOKENS = 4_000_000
#: Containers filled less than this are dissolved and packed again in the next round, while that leaves fewer partitions.
OPEN_BELOW = 0.97

#: Sources with a share of their own; these many numbers are held by the driver and every task.
MOST_SOURCES = 10_000

PLACED = "part long, seq int, item_id long, piece int, source string, size int, open boolean"


class Queues:
    """Waiting items by source and size; sizes present are bits of an integer, so the best fit is one mask away."""

    def __init__(self, items: list[tuple]):
        self.by: dict[str, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        self.bits: dict[str, int] = defaultdict(int)
        for source, size, *rest in sorted(items, reverse=True):
            self.by[source][size].append(rest)
            self.bits[source] |= 1 << size

    def take(self, source: str, room: int) -> tuple[int, list] | None:
        """The largest item of the source not above room, of several the one with the lowest id."""
        fit = self.bits[source] & ((1 << (room + 1)) - 1)
        if not fit:
            return None
        size = fit.bit_length() - 1
        waiting = self.by[source][size]
        item = waiting.pop()
        if not waiting:
            self.bits[source] &= ~(1 << size)
        return size, item

    def largest(self, room: int) -> str | None:
        """The source whose best fit is largest; ties by name."""
        mask = (1 << (room + 1)) - 1
        best = max(((bits & mask).bit_length() for bits in self.bits.values()), default=0)
        return min((s for s, bits in self.bits.items() if (bits & mask).bit_length() == best), default=None) if best else None

    def __bool__(self) -> bool:
        return any(self.bits.values())


def pack(items: list[tuple], credit: dict[str, float], capacity: int, share: dict[str, float]) -> tuple[list[list[tuple]], dict[str, float]]:
    """(containers, credits left). items: (source, size, id, piece), sizes 1..capacity; a container: (source, size, id, piece).

    share: each source's target share; a source without one is only used to fill up and when nothing else is left."""
    queues, containers = Queues(items), []
    credit = defaultdict(float, credit)
    while queues:
        room, own = capacity, []
        for s, part in share.items():
            credit[s] += capacity * part
        while room:
            got = None
            for s in sorted((s for s, bits in queues.bits.items() if bits), key=lambda s: (-credit[s], s)):
                if got := queues.take(s, room if own or credit[s] >= room else max(room // 2, 1)) or queues.take(s, room):
                    break
            if not got:
                break
            size, item = got
            own.append((s, size, *item))
            credit[s] -= size
            room -= size
        if room and (source := queues.largest(room)):  # never reached unless a queue was passed over
            size, item = queues.take(source, room)
            own.append((source, size, *item))
            credit[source] -= size
        containers.append(own)
    return containers, dict(credit)


def _packer(capacity: int, credits: dict[str, float], share: dict[str, float], last: bool):
    """credits: of all partitions together; each takes the part that its tokens are of the whole ("of_all")."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        batch = pd.concat(rows, ignore_index=True)
        for part, own in batch.groupby("part"):
            items = list(zip(own["source"].fillna(""), own["size"].astype(int), own["item_id"], own["piece"], strict=True))
            mine = float(own["size"].sum()) / float(own["of_all"].iloc[0])
            containers, left = pack(items, {s: c * mine for s, c in credits.items()}, capacity, share)
            out = [(part, k, i, piece, s, size, not last and sum(x[1] for x in c) < OPEN_BELOW * capacity) for k, c in enumerate(containers) for s, size, i, piece in c]
            out += [(part, -1, None, None, s, round(v), False) for s, v in left.items()]  # the credits that are carried on
            yield pd.DataFrame(out, columns=["part", "seq", "item_id", "piece", "source", "size", "open"]).astype({"item_id": "Int64", "piece": "Int32", "seq": "int32", "size": "int32", "part": "int64", "source": object})

    return run


def source_shares(items: DataFrame) -> dict[str, float]:
    """Each source's share of all tokens; a null source is "". Of more than MOST_SOURCES sources the smallest get none."""
    sums = items.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.sum("size").alias("size"))
    rows = sums.orderBy(F.desc("size"), "source").limit(MOST_SOURCES).collect()
    total = sum(r["size"] for r in rows) or 1
    return {r["source"]: r["size"] / total for r in rows}


def pack_items(items: DataFrame, capacity: int = CAPACITY, part_tokens: int = PART_TOKENS, targets: dict[str, float] | None = None) -> DataFrame:
    """container_id, item_id, piece, source, size: the container of each item or piece.

    items: item_id, source, size. targets: each source's share of every container's tokens, by default its share of all
    tokens; since every item is packed, other targets hold until a source runs out. Only an item above the capacity is
    cut: into pieces of the whole capacity and a rest, numbered from 0. Defined cases: items of size 0 or null take no
    space and get no row; a null source is the source ""; equal items are told apart by item_id; repeated item_ids are
    separate items; an empty table gives no row; further columns are ignored. Container numbers are unique, not
    consecutive; within the upper 32 bits of a number, containers follow each other as they were filled.
    """
    whole = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("size").cast("int").alias("size")).filter("size > 0")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1)))
    pieces = cut(pieces.withColumn("size", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity)))
    share = source_shares(pieces) if targets is None else {s: t / (sum(targets.values()) or 1) for s, t in targets.items()}
    rest = pieces.agg(F.sum("size")).first()[0] or 0
    done, credits, offset, rnd = None, {}, 0, 0
    n = max(1, -(-rest // part_tokens))
    while True:
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item_id", "piece", F.lit(rnd)), F.lit(n)) + F.lit(offset)).withColumn("of_all", F.lit(max(rest, 1)))
        placed = cut(dealt.repartition(min(n, 4 * 1024), "part").mapInPandas(_packer(capacity, credits, share, n == 1), PLACED))
        closed = placed.filter((F.col("seq") >= 0) & ~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        if n == 1:
            break
        # one row per source; what dissolved containers had been given goes back to the credits
        moves = placed.filter((F.col("seq") < 0) | F.col("open")).groupBy("source", (F.col("seq") < 0).alias("left")).agg(F.sum("size").alias("size"))
        seen = moves.orderBy(F.desc("size"), "source").limit(2 * MOST_SOURCES).collect()
        opened = placed.filter("open").select("part", "seq").distinct().count()
        credits = {s: -capacity * opened * part for s, part in share.items()}
        for r in seen:
            credits[r["source"]] = credits.get(r["source"], 0.0) + float(r["size"])
        pieces = placed.filter("seq >= 0 and open").select("item_id", "source", "size", "piece")
        rest = pieces.agg(F.sum("size")).first()[0] or 0
        if not rest:
            break
        n, offset, rnd = min(-(-rest // part_tokens), max(1, n // 2)), offset + n, rnd + 1
    return done.select((F.shiftleft("part", 32) + F.col("seq")).alias("container_id"), "item_id", "piece", F.nullif("source", F.lit("")).alias("source"), "size")


def mixture(packed: DataFrame, targets: dict[str, float], capacity: int = CAPACITY) -> DataFrame:
    """source, target_share, actual_share, mean_off, running_off: how the containers keep the targets.

    mean_off: mean over all containers of the distance between a source's share of the container and its target (their
    sum over the sources, halved, is a container's mean distance from the targets). running_off: the largest distance, in
    containers, between what a source has given and its target of all tokens so far, along the containers of one partition.
    """
    spark = packed.sparkSession
    of = packed.withColumn("source", F.coalesce("source", F.lit(""))).groupBy("container_id", "source").agg(F.sum("size").alias("size"))
    total = of.groupBy("container_id").agg(F.sum("size").alias("used"))
    order = Window.partitionBy("part").orderBy("container_id")
    runs = total.withColumn("part", F.shiftright("container_id", 32)).withColumn("upto", F.sum("used").over(order))
    listed = spark.createDataFrame([(s, float(t)) for s, t in targets.items()] or [("", 0.0)], "source string, target_share double")
    d = of.join(runs, "container_id").join(listed, "source", "left").fillna(0.0, ["target_share"])
    given = F.sum("size").over(Window.partitionBy("part", "source").orderBy("container_id"))
    d = d.withColumn("given", given)
    after = F.abs(F.col("given") - F.col("target_share") * F.col("upto")) / F.lit(capacity)
    before = F.abs(F.col("given") - F.col("size") - F.col("target_share") * (F.col("upto") - F.col("used"))) / F.lit(capacity)
    d = d.withColumn("off", F.abs(F.col("size") / F.col("used") - F.col("target_share"))).withColumn("running", F.greatest(after, before))
    n, tokens = total.agg(F.count("*"), F.coalesce(F.sum("used"), F.lit(0))).first()
    got = d.groupBy("source").agg(F.first("target_share").alias("target_share"), (F.sum("size") / F.lit(max(tokens, 1))).alias("actual_share"), F.sum("off").alias("off"), F.count("*").alias("seen"), F.max("running").alias("running_off"))
    return got.select("source", "target_share", "actual_share", ((F.col("off") + F.col("target_share") * (F.lit(n) - F.col("seen"))) / F.lit(max(n, 1))).alias("mean_off"), "running_off")


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container_id, n_items, used, fill."""
    return packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("size").alias("used")).withColumn("fill", F.col("used") / capacity)
