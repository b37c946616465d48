"""Queries of the llm problems over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmason.llm import canonical, clusters, language, linkage, mixing, mojibake, packing, sampling
from cloudmason.llm.tokens import n_tokens, vocabulary
from cloudmason.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- p2


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    meaning = _meaning(spark, sf_dir)
    a = table(spark, sf_dir, "annotations").select(F.col("annotation_id").alias("id"), F.col("scene_id").alias("grp"), F.col("semantic_label").alias("label"), *(F.col(f"global_box_center_{c}").alias(c) for c in "xyz"), F.col("material_description").alias("material"), "typology", "function")
    label = F.coalesce(F.expr("nullif(trim(class_semantic_label), '')"), "semantic_label")
    c = table(spark, sf_dir, "catalogue").select(F.col("record_id").alias("id"), F.col("scene_id").alias("grp"), label.alias("label"), "x", "y", "z", "material", "typology", "function")
    return linkage.link(linkage.prepared(a, "label", meaning), linkage.prepared(c, "label", meaning))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select(F.col("left_id").alias("annotation_id"), F.col("right_id").alias("record_id"))


def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select(F.col("left_id").alias("annotation_id"), F.col("right_id").alias("record_id"), "confidence")


# ---- p3


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    code = F.coalesce("semantic_label", "classification")
    points = table(spark, sf_dir, "points").select(F.col("scene_id").alias("grp"), F.col("row_idx").alias("unit"), F.col("point_id").alias("id"), F.when(code.between(0, 9), code).alias("category"))
    plan = table(spark, sf_dir, "sample_plan").select("plan_id", F.col("scene_id").alias("grp"), F.col("class_id").alias("category"), "target_pct", "sample_size", "min_rows")
    return sampling.draw(points, plan)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[1].filter("unmet").select("plan_id", F.col("category").alias("class_id"))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[0].select("plan_id", F.col("grp").alias("scene_id"), F.col("id").alias("point_id"), F.col("category").alias("class_id"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _sampled(spark, sf_dir)[1]
    return r.select("plan_id", F.col("grp").alias("scene_id"), F.col("category").alias("class_id"), "target_pct", "sample_size", "min_rows", "available", "drawn", "short_rows", "unmet")


# ---- p4


def _meaning(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame, str], DataFrame]:
    """Maps a column to the class list: its names and glosses, and the wordings that catalogue records use beside a class name."""
    listed = table(spark, sf_dir, "class_list")
    learned = canonical.learned_entries(table(spark, sf_dir, "catalogue"), "class_semantic_label", "semantic_label")
    named = learned.join(listed.select(F.col("semantic_label").alias("name"), F.col("class_id").cast("long").alias("entry_id")), "name").select("word", "entry_id")
    entries = cut(canonical.list_entries(listed).unionByName(named).distinct())
    other = [r["class_id"] for r in listed.filter("semantic_label = 'other'").select("class_id").distinct().collect()]
    return lambda values, column: canonical.map_to_list(values, column, entries, codes=True, catch_all=other)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "class_list").select("semantic_label")
    typed = table(spark, sf_dir, "annotations").select("annotation_id", "semantic_label").filter(F.col("semantic_label").isNotNull()).join(names, "semantic_label", "left_anti")
    return _meaning(spark, sf_dir)(typed, "semantic_label").filter(F.col("canon_id").isNotNull()).select("annotation_id", F.col("canon_id").cast("int").alias("class_id"))


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct value with the entry it means, its distance and how often it was typed."""
    counts = table(spark, sf_dir, "annotations").groupBy("semantic_label").agg(F.count("*").alias("n"))
    return _meaning(spark, sf_dir)(counts, "semantic_label").select("semantic_label", "n", F.col("canon_id").cast("int").alias("class_id"), F.col("canon_entry").alias("entry"), F.col("canon_distance").alias("distance"))


def p4_catalogue_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's distinct class wordings mapped to a list that is too long to ship, as far as the operator is told:
    every shard of the list reads every value."""
    listed = canonical.list_entries(table(spark, sf_dir, "class_list"))
    counts = table(spark, sf_dir, "catalogue").groupBy("class_semantic_label").agg(F.count("*").alias("n"))
    mapped = canonical.map_to_list(counts, "class_semantic_label", listed, codes=True, most_broadcast=0, shard_entries=50)
    return mapped.select("class_semantic_label", "n", F.col("canon_id").cast("int").alias("class_id"), F.col("canon_entry").alias("entry"), F.col("canon_distance").alias("distance"))


# ---- p6


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.coalesce("semantic_label", "classification")
    return clusters.find_bodies(table(spark, sf_dir, "points").select(F.col("scene_id").alias("grp"), code.alias("code"), F.col("point_id").alias("id"), "x", "y", "z").filter(F.col("code").between(0, 9)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select(F.col("head").alias("head_id"), F.col("id").alias("point_id"))


def p6_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.describe_bodies(_bodies(spark, sf_dir)).withColumnRenamed("head", "head_id")


# ---- p7

GARBLED_FIELDS = ["description", "historical_description"]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, sf_dir, "annotations"), "annotation_id", GARBLED_FIELDS).select(F.col("row_id").alias("annotation_id"), "field_name")


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, sf_dir, "annotations"), "annotation_id", GARBLED_FIELDS).withColumnRenamed("row_id", "annotation_id")


# ---- p8, p9


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, counted once and kept in the checkpoint folder."""
    return cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_tokens(F.col("text"), vocabulary(spark)).alias("tokens")))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_items(_counted(spark, sf_dir).select(F.col("doc_id").alias("item_id"), "source", F.col("tokens").alias("size")))
    fill = packing.container_fill(packed)
    return packed.join(fill.select("container_id", "fill"), "container_id").select("container_id", F.col("item_id").alias("doc_id"), "piece", "size", "fill")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are, in steps of a hundredth."""
    packed = packing.pack_items(_counted(spark, sf_dir).select(F.col("doc_id").alias("item_id"), "source", F.col("tokens").alias("size")))
    return packing.container_fill(packed).groupBy(F.floor(F.col("fill") * 100).alias("fill_pct")).agg(F.count("*").alias("n_containers"), F.sum("used").alias("used_tokens"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers keep the sources' shares of all tokens, container by container and over the run."""
    items = _counted(spark, sf_dir).select(F.col("doc_id").alias("item_id"), "source", F.col("tokens").alias("size"))
    shares = packing.source_shares(items)
    report = packing.mixture(packing.pack_items(items, targets=shares), shares)
    return report.select("source", *(F.round(c, 6).alias(c) for c in ("target_share", "actual_share", "mean_off", "running_off")))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = [r.asDict() for r in table(spark, sf_dir, "source_target").collect()]  # one row per source
    return mixing.mix(_counted(spark, sf_dir), targets)


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].withColumn("actual_share", F.round("actual_share", 6))


def p9_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponent on natural shares that gives the targets' entropy, or that the repetition limit forces, and its weights realised."""
    targets = {r["source"]: r for r in table(spark, sf_dir, "source_target").collect()}
    docs = _counted(spark, sf_dir).filter(F.col("source").isin(list(targets)))
    sizes = mixing.source_sizes(docs, list(targets))
    repeats = {s: t["max_repeats"] for s, t in targets.items()}
    exponent, binding = mixing.exponent_for(sizes, mixing.entropy({s: t["target_share"] for s, t in targets.items()}), repeats)
    weights = mixing.tempered(sizes, exponent)
    report = mixing.mix(docs, [{"source": s, "target_share": w, "max_repeats": repeats[s]} for s, w in weights.items()])[1]
    return report.select("source", F.round("target_share", 9).alias("weight"), F.lit(round(exponent, 9)).alias("exponent"), F.lit(binding).alias("binding"), "used_tokens", "most_uses")


# ---- p10


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.unnamed_languages(language.find_languages(table(spark, sf_dir, "documents")))


def p10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(language.find_languages(table(spark, sf_dir, "documents")))


def p10_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.find_languages(table(spark, sf_dir, "documents")).select("doc_id", "span_start", "span_end", "n_sentences", "language", F.round("confidence", 6).alias("confidence"))


QUERIES = {name: f for name, f in list(globals().items()) if name[:1] == "p" and name[1:2].isdigit()}
