"""Records of two sources that describe the same real-world element, matched without a shared key.

Candidates share a scene, a compatible class and a neighbourhood (after units and the scene's shift between the sources
are settled), or, where a centre is missing, class, material and typology. Which wordings of material and typology mean
the same is learned from how often they stand together at near places. Each candidate pair is a soft truth value.
Weighted rules on similarity (squared), exclusivity and transitivity (hinges) make a convex problem, solved by the
alternating direction method: every rule moves its own copies of the values, then the copies are averaged. Connected
groups of candidates are independent of each other and are dealt out over the cluster. The value is the confidence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudmason.functions.frames import plain
from cloudmason.llm.canonical import NONE
from cloudmason.operators.components import join_labels
from cloudmason.operators.point_grid import components
from cloudmason.session import cut, partitions, uncut

RADIUS = 3.0
#: Factors between metres and other units that centres are found in: millimetres, centimetres, feet.
UNITS = [1.0, 1000.0, 100.0, 3.280839895]
BIN = 0.25
#: How far a scene's shift between the sources is looked for.
SHIFT_RADIUS = 20.0
#: Pairs that a shift must explain before it is believed, no shift being the rule.
LEAST_VOTES = 4
#: Two wordings mean the same if they stand together at least so often, so many times as often as by chance, and so many
#: standard deviations more.
TOGETHER, LIFT, DEVIATIONS = 4, 2.0, 6.0
RHO, TOLERANCE, WIDE_TOLERANCE = 4.0, 1e-6, 1e-5
#: Candidate pairs of one connected group that one task solves at once; a larger group is solved in alternating rounds,
#: to the same values.
TASK_PAIRS = 300_000
W_EXCLUSIVE, W_TRANSITIVE, SLACK = 6.0, 2.0, 0.1
MATCH = 0.5
#: Rows of one source that lie at most so far apart, in plan and in height, can be the same element: centres are inexact.
APART, APART_Z = 2.5, 2.0
#: Standard deviation of the distance between two rows of one element.
NEAR = 0.5
#: Weights for agreement in class, material, typology and function where there is no place.
PLUS = {"class": 2.3, "mat": 2.5, "typ": 2.5, "fn": 1.2}


def wording(text: Column) -> Column:
    """The text before its first comma, lower-case and without accents; null where that is blank."""
    plain = F.lower(F.trim(F.substring_index(text, ",", 1)))
    for a, b in (("àáâã", "a"), ("èéêë", "e"), ("ìíîï", "i"), ("òóôõö", "o"), ("ùúûü", "u"), ("ç", "c"), ("ñ", "n"), ("ä", "a")):
        plain = F.translate(plain, a, b * len(a))
    plain = F.regexp_replace(F.replace(plain, F.lit("ß"), F.lit("ss")), "\\s+", " ")
    return F.when(plain != "", plain)


def prepared(rows: DataFrame, label: str, meaning: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """id, grp, k (class, null if unknown), x, y, z, mat, typ, fns of rows with id, grp, label, x, y, z, material, typology, function.

    meaning: adds canon_id to distinct labels, as canonical.map_to_list() does."""
    num = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    d = rows.select("id", "grp", F.col(label).alias("label"), num("x").alias("x"), num("y").alias("y"), num("z").alias("z"), wording(F.col("material")).alias("mat"), wording(F.col("typology")).alias("typ"), F.coalesce(F.array_sort(F.array_distinct(F.expr("filter(transform(split(lower(function), '[;|,]'), s -> trim(s)), s -> s <> '')"))), F.expr("cast(array() as array<string>)")).alias("fns"))
    labels = d.select("label").filter("label is not null").distinct().repartition(partitions(rows.sparkSession))  # few bytes, much work
    meant = meaning(labels, "label").select("label", F.when(F.col("canon_id") != NONE, F.col("canon_id").cast("int")).alias("k"))
    d = d.join(meant, "label", "left")
    unplaced = F.col("x").isNull() | F.col("y").isNull() | ((F.col("x") == 0) & (F.col("y") == 0))  # a centre of zeros stands for none
    return d.select("id", "grp", "k", *(F.when(~unplaced, F.col(c)).alias(c) for c in "xyz"), "mat", "typ", "fns")


def in_metres(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with its centres in the unit in which they fall among its scene's right centres."""
    box = right.groupBy("grp").agg(*(F.percentile_approx(c, F.lit(q), F.lit(1000)).alias(f"{c}{n}") for c in "xy" for q, n in ((0.02, "lo"), (0.98, "hi"))), F.count("*").alias("n_right"))
    d = left.join(box, "grp", "left")
    unit = F.lit(UNITS[0])
    for f in reversed(UNITS[1:]):
        near = lambda c, f=f: (F.col(c) / f).between(F.col(f"{c}lo") - 40, F.col(f"{c}hi") + 40)
        far = ~(F.col("x").between(F.col("xlo") - 200, F.col("xhi") + 200) & F.col("y").between(F.col("ylo") - 200, F.col("yhi") + 200))
        unit = F.when(far & near("x") & near("y"), F.lit(f)).otherwise(unit)
    return d.withColumn("unit", unit).select("id", "grp", "k", *((F.col(c) / F.col("unit")).alias(c) for c in "xyz"), "mat", "typ", "fns", F.coalesce("n_right", F.lit(0)).alias("n_right"))


def near_candidates(left: DataFrame, right: DataFrame, radius: float, same: Sequence[str] = (), any_class: bool = False) -> DataFrame:
    """Pairs of one scene whose centres lie within the radius in x and y and whose columns `same` are equal, on a grid.

    any_class: classes must be equal or one of them unknown; a row asks for its class and for unknown ones by a key each.
    Cells and equal columns meet as one number, which the columns themselves then confirm. Every column is carried along:
    give only those that are needed."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("int")
    ring = F.array(F.lit(-1), F.lit(0), F.lit(1))
    placed = lambda d: d.filter(" and ".join(f"{c} is not null" for c in ("grp", "x", "y", *same)))
    a, b = placed(left), placed(right).withColumn("ox", F.explode(ring)).withColumn("oy", F.explode(ring))
    keys = []
    if any_class:
        keyed = lambda d, unknown, known: d.withColumn("kk", F.explode(F.when(F.col("k").isNull(), F.array(*map(F.lit, unknown))).otherwise(F.array(F.col("k"), F.lit(known)))))
        a, b, keys = keyed(a, [-11], -12), keyed(b, [-11, -12], -11), ["kk"]
    a = a.withColumn("meet", F.xxhash64("grp", cell("x"), cell("y"), *same, *keys)).drop(*keys)
    b = b.withColumn("meet", F.xxhash64("grp", cell("x") + F.col("ox"), cell("y") + F.col("oy"), *same, *keys)).drop("ox", "oy", *keys)
    b = b.select("meet", *(F.col(c).alias(f"r_{c}") for c in b.columns if c != "meet"))
    d = a.join(b, "meet").drop("meet").filter((F.col("x") - F.col("r_x")) ** 2 + (F.col("y") - F.col("r_y")) ** 2 <= radius * radius)
    for c in ("grp", *same):
        d = d.filter(F.col(c) == F.col(f"r_{c}"))
    return d.drop("r_grp")


def same_wordings(pairs: DataFrame, known: Sequence[Sequence[str]] = ()) -> DataFrame:
    """node, head: wordings (by spoken_of) that mean the same share a head, learned from near pairs of equal class.

    Two wordings are linked if they stand together in these pairs far more often than by chance; linked ones mean the
    same throughout. known: groups of wordings that are given to mean the same, in either column."""
    spark, found = pairs.sparkSession, None
    for c in ("mat", "typ"):
        both = pairs.filter(F.col(c).isNotNull() & F.col(f"r_{c}").isNotNull()).groupBy(F.lit(c).alias("c"), F.col(c).alias("a"), F.col(f"r_{c}").alias("b")).agg(F.count("*").alias("n"))
        found = both if found is None else found.unionByName(both)
    found = cut(found)
    total = found.groupBy("c").agg(F.sum("n").alias("total"))
    by = lambda side: found.groupBy("c", side).agg(F.sum("n").alias(f"n_{side}"))
    d = found.join(by("a"), ["c", "a"]).join(by("b"), ["c", "b"]).join(total, "c").withColumn("chance", F.col("n_a") * F.col("n_b") / F.col("total"))
    good = d.filter((F.col("n") >= TOGETHER) & (F.col("n") >= LIFT * F.col("chance")) & (F.col("n") - F.col("chance") >= DEVIATIONS * F.sqrt("chance")))
    links = good.select(spoken_of("c", "a").alias("a"), spoken_of("c", "b").alias("b"))
    if known:
        given = spark.createDataFrame([(c, g[0], w) for g in known for w in g for c in ("mat", "typ")], "c string, a string, b string").withColumn("a", wording(F.col("a"))).withColumn("b", wording(F.col("b")))
        links = links.unionByName(given.select(spoken_of("c", "a").alias("a"), spoken_of("c", "b").alias("b")))
    single = links.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("head"))
    heads = cut(join_labels(links))
    own = heads.select(F.col("head").alias("node"), "head")  # a head is no node of its own component
    return heads.unionByName(own).unionByName(single).groupBy("node").agg(F.min("head").alias("head"))


def spoken_of(column: str, word: str) -> Column:
    return F.xxhash64(F.col(column), F.col(word))


def with_meaning(rows: DataFrame, meanings: DataFrame) -> DataFrame:
    """rows with mat and typ replaced by what the wording means (itself if nothing is known), and known_mat, known_typ."""
    for c in ("mat", "typ"):
        m = meanings.select(F.col("node").alias("node_"), F.col("head").alias("head_"))
        rows = rows.withColumn("c_", F.lit(c)).join(m, spoken_of("c_", c) == m["node_"], "left")
        rows = rows.withColumn(f"known_{c}", F.col("head_").isNotNull()).withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce(F.col("head_").cast("string"), F.col(c)))).drop("c_", "node_", "head_")
    return rows


def scene_shift(left: DataFrame, right: DataFrame) -> DataFrame:
    """grp, sx, sy, sz: by how much a scene's right centres are shifted, from the displacement most pairs of equal class,
    material and typology agree on; 0 where fewer than LEAST_VOTES do."""
    key = [F.xxhash64("k", "mat", "typ").alias("kind")]
    slim = lambda d: d.filter("k is not null and mat is not null and typ is not null").select("grp", "x", "y", "z", *key)
    pairs = near_candidates(slim(left), slim(right), SHIFT_RADIUS, ["kind"]).select("grp", *((F.col(f"r_{c}") - F.col(c)).alias(f"d{c}") for c in "xyz"))
    votes = pairs.withColumn("bx", F.explode(F.array(*(F.floor(F.col("dx") / BIN) + k for k in (-1, 0, 1))))).withColumn("by", F.explode(F.array(*(F.floor(F.col("dy") / BIN) + k for k in (-1, 0, 1)))))
    bins = votes.groupBy("grp", "bx", "by").agg(F.count("*").alias("n"), F.avg("dx").alias("sx"), F.avg("dy").alias("sy"), F.percentile_approx("dz", 0.5).alias("sz"))
    best = bins.groupBy("grp").agg(F.max_by(F.struct("n", "sx", "sy", "sz"), F.struct("n", -F.abs("bx") - F.abs("by"), "bx", "by")).alias("b"))
    sure = best.filter(F.col("b.n") >= LEAST_VOTES)
    return sure.select("grp", "b.sx", "b.sy", F.coalesce("b.sz", F.lit(0.0)).alias("sz"))


def evidence(pairs: DataFrame) -> DataFrame:
    """pairs with pro and con: the weights for and against a match, in natural-log odds."""
    agree = lambda same, known, plus, minus: F.when(~known, 0.0).when(same, plus).otherwise(-minus)
    # two wordings differ only if both are known; the same wording is the same whatever is known of it
    words = lambda c: F.col(c).isNotNull() & F.col(f"r_{c}").isNotNull() & ((F.col(c) == F.col(f"r_{c}")) | (F.col(f"known_{c}") & F.col(f"r_known_{c}")))
    r2 = (F.col("x") - F.col("r_x")) ** 2 + (F.col("y") - F.col("r_y")) ** 2
    dz = F.abs(F.col("z") - F.col("r_z"))
    placed = F.col("x").isNotNull() & F.col("r_x").isNotNull()
    terms = {
        "w_place": F.when(placed, F.greatest(F.lit(-2.0), 3.0 - r2 / (2 * 0.35**2))).otherwise(0.0),
        "w_height": F.when(~placed | dz.isNull(), 0.0).when(dz < 0.6, 0.7).when(dz < 2.0, -0.3).when(dz < 4.0, -3.0).otherwise(-6.0),
        "w_mat": agree(F.col("mat") == F.col("r_mat"), words("mat"), PLUS["mat"], 3.0),
        "w_typ": agree(F.col("typ") == F.col("r_typ"), words("typ"), PLUS["typ"], 3.0),
        "w_fn": agree(F.arrays_overlap("fns", "r_fns"), (F.size("fns") > 0) & (F.size("r_fns") > 0), PLUS["fn"], 2.0),
        "w_class": F.when(F.col("k").isNull() | F.col("r_k").isNull(), -0.5).when(placed, 0.0).otherwise(PLUS["class"]),
        "w_prior": F.when(placed, -2.0).otherwise(-F.log(F.greatest(F.col("n_right"), F.lit(2)).cast("double"))),
    }
    pos = sum(F.greatest(F.lit(0.0), t) for t in terms.values())
    neg = sum(F.greatest(F.lit(0.0), -t) for t in terms.values())
    return pairs.select("*", pos.alias("pro"), neg.alias("con"))


class Hinges:
    """Rules w * max(0, sum of c * y[v] - b); entries v, c belong to the rule of the same place in rule (ascending)."""

    def __init__(self, rule: np.ndarray, v: np.ndarray, c: np.ndarray, b: np.ndarray, w: np.ndarray):
        self.rule, self.v, self.c, self.b, self.w = rule, v, c, b, w

    @staticmethod
    def joined(parts: list[Hinges]) -> Hinges:
        shift = np.cumsum([0, *(len(p.b) for p in parts)])
        several = lambda name: np.concatenate([getattr(p, name) for p in parts]) if parts else np.zeros(0)
        rule = np.concatenate([p.rule + n for p, n in zip(parts, shift, strict=False)]) if parts else np.zeros(0, int)
        return Hinges(rule, several("v").astype(int), several("c"), several("b"), several("w"))

    def of(self, live: np.ndarray) -> tuple[Hinges, np.ndarray]:
        """The rules whose variables are live (all or none of a rule's are), and which entries those are."""
        kept = live[self.v]
        names, rule = np.unique(self.rule[kept], return_inverse=True)
        return Hinges(rule, self.v[kept], self.c[kept], self.b[names], self.w[names]), kept

    def cost(self, y: np.ndarray) -> float:
        return float((self.w * np.maximum(0, np.bincount(self.rule, self.c * y[self.v], len(self.b)) - self.b)).sum())


def solve(pro: np.ndarray, con: np.ndarray, hinges: Hinges, tolerance: float = TOLERANCE) -> np.ndarray:
    """argmin over y in [0,1] of sum pro(1-y)^2 + con y^2 and the hinges, by consensus ADMM.

    Every hinge has its own copies of its variables. Connected groups of variables that no longer move, and whose copies
    agree with them, leave the rounds."""
    n = len(pro)
    y = pro / np.maximum(pro + con, 1e-12)
    if not len(hinges.b):
        return y
    first = np.r_[0, np.flatnonzero(np.diff(hinges.rule)) + 1]
    part = components(n, hinges.v, hinges.v[first][hinges.rule])
    live = np.zeros(n, bool)
    live[hinges.v] = True
    h, _ = hinges.of(live)
    u = np.zeros(len(h.v))
    step = 0
    while len(h.b):
        copies, norm = np.bincount(h.v, minlength=n), np.bincount(h.rule, h.c * h.c, len(h.b))
        for _ in range(25):
            at = y[h.v] - u
            over = np.bincount(h.rule, h.c * at, len(h.b)) - h.b
            x = at - np.clip(over / norm, 0, h.w / RHO)[h.rule] * h.c
            # the squared similarity rules are solved exactly together with the average of the copies
            pull = np.bincount(h.v, x + u, n)
            new = np.where(copies > 0, np.clip((RHO * pull + 2 * pro) / (RHO * copies + 2 * pro + 2 * con + 1e-12), 0, 1), y)
            u += x - new[h.v]
            moved, y = np.abs(new - y), new
        np.maximum.at(moved, h.v, np.abs(x - y[h.v]))
        most = np.zeros(n)
        np.maximum.at(most, part, moved)
        h, kept = h.of(most[part] > tolerance)
        u = u[kept]
        step += 25
        if step > 100_000:
            raise ArithmeticError("the alternating method does not settle")
    return y


def leaders(own: np.ndarray, odds: np.ndarray, tie: np.ndarray, alike) -> np.ndarray:
    """For each candidate of a row (own), the candidate that stands for the same element: the best one is first to lead,
    those alike to it follow it, of the rest the best one leads, and so on."""
    lead, todo = np.empty(len(own), int), np.lexsort((tie, -odds, own))
    while len(todo):
        first = np.r_[True, own[todo][1:] != own[todo][:-1]]
        head = todo[first][np.cumsum(first) - 1]
        near = (todo == head) | alike(todo, head)
        lead[todo[near]] = head[near]
        todo = todo[~near]
    return lead


def rules(p: pd.DataFrame, of_left: bool = True, of_right: bool = True) -> Hinges:
    """Hinges over the candidate pairs p, among those of one left row and among those of one right row.

    Exclusivity: a row describes one element, so its candidates' values, averaged over those that stand for the same
    element, sum to 1 at most. Transitivity: what holds for the candidate that stands for an element holds for the
    others of that element and the reverse, up to the slack and to the doubt, by distance, that they are the same."""
    code = lambda s: pd.factorize(s)[0]
    odds = (p["pro"] - p["con"]).to_numpy()
    found = []
    for own, tie, s in (("id", "r_id", "r_"),) * of_left + (("r_id", "id", ""),) * of_right:
        row, place, height = code(p[own]), p[[f"{s}x", f"{s}y"]].to_numpy(float), p[f"{s}z"].to_numpy(float)
        kinds = [code(p[f"{s}{c}"]) for c in ("mat", "typ")]

        def alike(i: np.ndarray, j: np.ndarray, place=place, height=height, kinds=kinds) -> np.ndarray:
            """Rows of one source that can be the same element: near each other, no conflict in material and typology."""
            far = (np.hypot(*(place[i] - place[j]).T) > APART) | (np.abs(height[i] - height[j]) > APART_Z)
            return ~far & ~np.logical_or.reduce([(m[i] != m[j]) & (m[i] >= 0) & (m[j] >= 0) for m in kinds])

        lead = leaders(row, odds, p[tie].to_numpy(), alike)
        n, every = len(row), np.arange(len(row))
        follows = np.flatnonzero(lead != every)
        doubt = np.clip(1 - np.exp(-((place[follows] - place[lead[follows]]) ** 2).sum(1) / (2 * NEAR**2)), 0, 1)
        doubt = np.where(np.isnan(doubt), 0.5, doubt)  # a place is missing
        for a, b in ((follows, lead[follows]), (lead[follows], follows)):
            found.append(Hinges(np.repeat(np.arange(len(a)), 2), np.column_stack([a, b]).ravel(), np.tile([1.0, -1.0], len(a)), SLACK + doubt, np.full(len(a), W_TRANSITIVE)))
        several = np.bincount(row, lead == every)[row] > 1 if n else np.zeros(0, bool)
        order = np.flatnonzero(several)[np.argsort(row[several], kind="stable")]
        share = 1 / np.bincount(lead, minlength=n)[lead]
        names, rule = np.unique(row[order], return_inverse=True)
        found.append(Hinges(rule, order, share[order], np.ones(len(names)), np.full(len(names), W_EXCLUSIVE)))
    return Hinges.joined(found)


def _solve_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    p = pd.concat(parts, ignore_index=True)
    yield pd.DataFrame({"id": p["id"], "r_id": p["r_id"], "confidence": solve(p["pro"].to_numpy(), p["con"].to_numpy(), rules(p))})


PLACES = "x double, y double, z double, r_x double, r_y double, r_z double, mat string, typ string, r_mat string, r_typ string"
WIDE = f"head long, id long, r_id long, pro double, con double, {PLACES}, v double, u_left double, u_right double, x_left double, moved double"
PAIR = [c.split()[0] for c in f"id long, r_id long, pro double, con double, {PLACES}".split(", ")]


def _half_step(left_side: bool):
    """One direction of the alternating method over a partition by left or by right row: the rules of that side are solved
    against the common values; after the right side the common values and both multipliers are renewed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        p = pd.concat(parts, ignore_index=True)
        t = (p["v"] - p["u_left" if left_side else "u_right"]).to_numpy()
        x = solve(RHO / 2 * t, RHO / 2 * (1 - t), rules(p, left_side, not left_side), WIDE_TOLERANCE / 10)  # RHO / 2 (x - t)^2 in the form of the similarity rules
        if left_side:
            p["x_left"] = x
        else:
            pull = RHO * (p["x_left"] + p["u_left"] + x + p["u_right"])
            z = np.clip((pull + 2 * p["pro"]) / (2 * RHO + 2 * p["pro"] + 2 * p["con"]), 0, 1)
            p["u_left"] += p["x_left"] - z
            p["u_right"] += x - z
            p["moved"] = np.maximum(np.abs(z - p["v"]), np.maximum(np.abs(p["x_left"] - z), np.abs(x - z)))
            p["v"] = z
        yield plain(p)

    return run


def solve_wide(pairs: DataFrame) -> DataFrame:
    """id, r_id, confidence for connected groups too large for one task: each round is two shuffles, by left and by right
    row, and a checkpoint; a rule never needs more than the candidates of one row. Rounds end as solve() ends."""
    n = partitions(pairs.sparkSession, pairs.count())
    start = F.col("pro") / F.greatest(F.col("pro") + F.col("con"), F.lit(1e-12))
    zero = [F.lit(0.0).alias(c) for c in ("u_left", "u_right", "x_left", "moved")]
    state = cut(pairs.select("head", *PAIR, start.alias("v"), *zero))
    while True:
        after = cut(state.repartition(n, "id").mapInPandas(_half_step(True), WIDE).repartition(n, "r_id").mapInPandas(_half_step(False), WIDE))
        uncut(state)
        state = after
        if (state.agg(F.max("moved")).first()[0] or 0.0) <= WIDE_TOLERANCE:
            return state.select("id", "r_id", F.col("v").alias("confidence"))


def candidates(a: DataFrame, b: DataFrame, known: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Candidate pairs of two sides with unique ids, with their evidence and the columns that rules() needs."""
    a, b = cut(in_metres(a, b)), cut(b)
    worded = lambda d: d.select("grp", "k", "x", "y", "mat", "typ")
    meanings = cut(same_wordings(near_candidates(worded(a), worded(b), RADIUS, ["k"]), known))
    a, b = cut(with_meaning(a, meanings)), with_meaning(b, meanings)
    shift = scene_shift(a, b)
    b = cut(b.join(shift, "grp", "left").select("id", "grp", "k", *((F.col(c) - F.coalesce(f"s{c}", F.lit(0.0))).alias(c) for c in "xyz"), "mat", "typ", "fns", "known_mat", "known_typ"))
    slim = lambda d: d.select("id", "grp", "k", "x", "y")
    attributes = [c for c in a.columns if c != "n_right"]
    other = b.select(*(F.col(c).alias(f"r_{c}") for c in attributes))
    near = near_candidates(slim(a), slim(b), RADIUS, any_class=True).select("id", "r_id").join(a, "id").join(other, "r_id")
    lost_b = b.select(*(F.col(c).alias(c if c in ("grp", "k", "mat", "typ") else f"r_{c}") for c in b.columns))
    full = ["grp", "k", "mat", "typ"]
    copy = lambda d: d.select("*", *(F.col(c).alias(f"r_{c}") for c in full[1:]))
    # All that can speak for a row without a centre is weaker than the number of a large scene's records against it.
    told = a.filter(F.log(F.greatest(F.col("n_right"), F.lit(2)).cast("double")) <= sum(PLUS.values()))
    lost = copy(told.filter("x is null").join(lost_b, full)).unionByName(copy(told.filter("x is not null").join(lost_b.filter("r_x is null"), full)))
    lost = lost.filter((F.size("fns") == 0) | (F.size("r_fns") == 0) | F.arrays_overlap("fns", "r_fns"))
    columns = ["id", "grp", "k", "x", "y", "z", "mat", "typ", "fns", "known_mat", "known_typ", "n_right", *(f"r_{c}" for c in ("id", "k", "x", "y", "z", "mat", "typ", "fns", "known_mat", "known_typ"))]
    pairs = evidence(near.select(columns).unionByName(lost.select(columns)))
    sure = [F.when(F.col(f"{s}known_{c}"), F.col(f"{s}{c}")).alias(f"{s}{c}") for s in ("", "r_") for c in ("mat", "typ")]  # only known wordings can clash
    return pairs.select("id", "r_id", "pro", "con", "x", "y", "z", "r_x", "r_y", "r_z", *sure)


def link(left: DataFrame, right: DataFrame, known: Sequence[Sequence[str]] = ()) -> DataFrame:
    """left_id, right_id, confidence of the pairs that match (confidence of at least MATCH).

    left, right: results of prepared(). known: groups of wordings given to mean the same, beside those that are learned.
    Rows that agree in everything are linked once and their pairs expanded at the end, so repeated rows each get their
    pairs. Defined cases: rows without a scene match nothing; rows without a centre match only by class, material and
    typology together, and only in scenes whose size leaves this evidence the stronger side; rows with neither match
    nothing; a null class matches any class at a lower weight; ties have equal confidence; empty tables give no row.
    """
    spark = left.sparkSession
    attrs = ["grp", "k", "x", "y", "z", "mat", "typ", "fns"]
    folded = []
    for side in (left, right):
        keyed = cut(side.filter(F.col("grp").isNotNull()).withColumn("key", F.xxhash64(*attrs)))
        folded.append((keyed.select(F.col("key").alias("id"), *attrs).distinct(), keyed.select("id", "key")))
    (a, a_rows), (b, b_rows) = folded
    pairs = cut(candidates(a, b, known))
    node = lambda c, salt: F.xxhash64(F.col(c), F.lit(salt))
    # a pair whose rows have no other candidate is a group by itself and needs no search for its group
    alone = lambda c: pairs.groupBy(c).agg(F.count("*").alias(f"n_{c}"))
    counted = cut(pairs.join(alone("id"), "id").join(alone("r_id"), "r_id").withColumn("node", node("id", 1)))
    linked = counted.filter("n_id > 1 or n_r_id > 1")
    heads = join_labels(linked.select(F.col("node").alias("a"), node("r_id", 2).alias("b")))
    labelled = linked.join(heads, "node", "left").unionByName(counted.filter("n_id = 1 and n_r_id = 1").withColumn("head", F.lit(None).cast("long")))
    labelled = cut(labelled.withColumn("head", F.coalesce("head", "node")).drop("node", "n_id", "n_r_id"))
    wide = cut(labelled.groupBy("head").count().filter(F.col("count") > TASK_PAIRS).select("head"))
    solved = labelled.join(wide, "head", "left_anti").repartition(partitions(spark, labelled.count()), "head").select("head", *PAIR).mapInPandas(_solve_parts, "id long, r_id long, confidence double")
    if wide.take(1):
        solved = solved.unionByName(solve_wide(labelled.join(wide, "head", "left_semi")))
    matched = solved.filter(F.col("confidence") >= MATCH)
    out = matched.join(a_rows.select(F.col("id").alias("left_id"), F.col("key").alias("id")), "id").join(b_rows.select(F.col("id").alias("right_id"), F.col("key").alias("r_id")), "r_id")
    return out.select("left_id", "right_id", F.round("confidence", 6).alias("confidence"))
