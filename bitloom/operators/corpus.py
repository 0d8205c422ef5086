"""Cleaning, merging, comparing and profiling corpora. Units have a unique, ordered column ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import text as X
from bitloom.plans.lineage import kept as written

KEY = "_key"


def _blank(c: str) -> Column:
    return X.py_strip(F.coalesce(F.col(c), F.lit("")))


def _judged(units: DataFrame, normalize: bool, remove_empty: bool, remove_identical: bool) -> DataFrame:
    """units with normalised texts, changed, removed, and two hashes of the pair for those that may be repeats."""
    d = units
    for c in ("src_text", "tgt_text"):
        d = d.withColumn(f"_{c}", X.nfc_squeezed(c) if normalize else F.col(c))
    d = d.withColumn("changed", ~F.col("_src_text").eqNullSafe(F.col("src_text")) | ~F.col("_tgt_text").eqNullSafe(F.col("tgt_text")))
    d = d.drop("src_text", "tgt_text").withColumnsRenamed({"_src_text": "src_text", "_tgt_text": "tgt_text"})
    s, t = F.col("_s"), F.col("_t")
    why = F.lit(None).cast("string")
    if remove_identical:
        why = F.when((s == t) & (s != ""), "identical").otherwise(why)
    if remove_empty:
        why = F.when((s == "") | (t == ""), "empty").otherwise(why)
    d = d.withColumn("_s", _blank("src_text")).withColumn("_t", _blank("tgt_text")).withColumn("removed", why)
    pair = {"_a": F.xxhash64(s, t), "_b": F.xxhash64(t, F.lit(1), s)}
    return d.withColumns({k: F.when(F.col("removed").isNull(), h) for k, h in pair.items()}).drop("_s", "_t")


def clean(units: DataFrame, normalize: bool = True, dedupe: bool = True, remove_empty: bool = True, remove_identical: bool = False) -> DataFrame:
    """Adds changed and removed (empty, identical, duplicate or null for units that stay).

    In this order: texts are normalised, empty and then identical units go, then repeats of a kept pair."""
    d = _judged(units, normalize, remove_empty, remove_identical)
    if not dedupe:
        return d.drop("_a", "_b")
    # keys of all units, else a filter for null would work each text out once more; a unit that goes has its own
    d = d.withColumns({k: F.coalesce(F.col(k), F.xxhash64("ord", F.lit(i))) for i, k in enumerate(("_a", "_b"))})
    # the first of equal pairs by an aggregate that is joined back: a very common pair is one row of it
    first = d.groupBy("_a", "_b").agg(F.min("ord").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    d = d.join(first, ["_a", "_b"], "left")
    repeat = F.col("removed").isNull() & (F.col("ord") != F.col("_first"))
    return d.withColumn("removed", F.when(repeat, "duplicate").otherwise(F.col("removed"))).drop("_first", "_a", "_b")


def clean_counts(units: DataFrame, normalize: bool = True, dedupe: bool = True, remove_empty: bool = True, remove_identical: bool = False) -> DataFrame:
    """The report of clean() without its units: of each pair but one is a duplicate, so pairs are counted, not looked up."""
    pairs = _judged(units, normalize, remove_empty, remove_identical).groupBy("removed", "_a", "_b").agg(F.count("*").alias("n"), F.count_if("changed").alias("c"))
    some = lambda c: F.coalesce(c, F.lit(0))
    n = lambda why: some(F.sum(F.when(F.col("removed") == why, F.col("n"))))
    stays = some(F.sum(F.when(F.col("removed").isNull(), F.col("n"))))
    repeats = some(F.sum(F.when(F.col("removed").isNull(), F.col("n") - 1))) if dedupe else F.lit(0).cast("long")
    return pairs.agg(some(F.sum("n")).alias("input"), some(F.sum("c")).alias("normalized"), n("empty").alias("removed_empty"), n("identical").alias("removed_identical"), repeats.alias("removed_duplicate"), (stays - repeats).alias("output"))


def kept(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter("removed is null").drop("removed", "changed")


def clean_report(cleaned: DataFrame) -> DataFrame:
    n = lambda why: F.count_if(F.col("removed") == why)
    return cleaned.agg(F.count("*").alias("input"), F.count_if("changed").alias("normalized"), n("empty").alias("removed_empty"), n("identical").alias("removed_identical"), n("duplicate").alias("removed_duplicate"), F.count_if(F.col("removed").isNull()).alias("output"))


def _walk(strategy: str) -> list[Column]:
    """What a later unit has more of."""
    if strategy == "prefer-last":
        return [F.col("ord")]
    if strategy == "prefer-first":
        return [-F.col("ord")]
    if strategy == "prefer-newer":
        return [F.coalesce(F.col("modified_at"), F.lit("")), F.col("ord")]
    raise ValueError(strategy)


def merge(units: DataFrame, strategy: str = "keep-all") -> DataFrame:
    """The unit that wins for each stripped source, with merged_ord, the rank order of its source's first
    appearance in walking order. keep-all keeps every unit."""
    if strategy == "keep-all":
        return units.withColumn("merged_ord", F.struct(F.col("ord")))
    walk = F.struct(*(c.alias(f"w{i}") for i, c in enumerate(_walk(strategy))))
    cols = [c for c in units.columns]
    got = units.withColumn(KEY, _blank("src_text")).withColumn("_w", walk).groupBy(KEY).agg(F.max_by(F.struct(*cols), "_w").alias("u"), F.min("_w").alias("merged_ord"))
    return got.select("u.*", "merged_ord")


def conflicts_resolved(units: DataFrame, strategy: str) -> DataFrame:
    """How often a source's target changes on the way (n)."""
    if strategy == "keep-all":
        return units.agg(F.lit(0).cast("long").alias("conflicts_resolved"))
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = _blank("tgt_text")
    walk = F.struct(*(c.alias(f"w{i}") for i, c in enumerate(_walk(strategy))))
    d = units.select(_blank("src_text").alias(KEY), F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b")).alias("_t"), walk.alias("_w"))
    # ranges of (source, way): a very common source takes many of them, and no range is larger for it
    d = written(d.repartitionByRange(n, KEY, "_w").withColumn("_part", F.spark_partition_id()))
    d = d.withColumn("_p", F.lag("_t").over(Window.partitionBy("_part", KEY).orderBy("_w")))
    ranges = d.groupBy("_part", KEY).agg(F.count_if(F.col("_p") != F.col("_t")).alias("n"), F.min_by("_t", "_w").alias("first"), F.max_by("_t", "_w").alias("last"))
    ranges = ranges.withColumn("before", F.lag("last").over(Window.partitionBy(KEY).orderBy("_part")))  # a row a range at most
    return ranges.agg(F.coalesce(F.sum(F.col("n") + F.when(F.col("before") != F.col("first"), 1).otherwise(0)), F.lit(0)).alias("conflicts_resolved"))


def compare(units: DataFrame, label: str = "label") -> DataFrame:
    """One row a stripped source: kind (unique, shared, conflict), owners, number of targets, first ord.

    One aggregation over the union of all corpora, no join: targets are counted apart by source and target
    before their counts meet by source, so that a source keeps its owners' labels and three numbers, however
    many targets and units it has."""
    d = units.select(_blank("src_text").alias("src"), _blank("tgt_text").alias("tgt"), F.col(label).alias("label"), "ord")
    d = d.groupBy("src").agg(F.array_sort(F.collect_set("label")).alias("owners"), F.count_distinct("tgt").alias("targets"), F.min("ord").alias("first"))
    kind = F.when(F.size("owners") == 1, "unique").when(F.col("targets") <= 1, "shared").otherwise("conflict")
    return d.withColumn("kind", kind)


def conflict_table(units: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """source and a column of ;-joined targets for each label, conflicts only."""
    if len(labels) < 2 or len(set(labels)) != len(labels):
        raise ValueError("two or more different labels are needed")
    d = units.select(_blank("src_text").alias("src"), _blank("tgt_text").alias("tgt"), F.col(label).alias("label"))
    one = lambda l: F.array_join(F.array_sort(F.collect_set(F.when(F.col("label") == l, F.col("tgt")))), ";").alias(l)
    got = d.groupBy("src").agg(F.count_distinct("label").alias("_o"), F.count_distinct("tgt").alias("_t"), *map(one, labels))
    return got.filter("_o > 1 and _t > 1").drop("_o", "_t").withColumnRenamed("src", "source")


def stats(units: DataFrame) -> DataFrame:
    s, t = F.col("_s"), F.col("_t")
    d = units.select(_blank("src_text").alias("_s"), _blank("tgt_text").alias("_t")).agg(
        F.count("*").alias("total"), F.count_distinct(s, t).alias("unique"), F.count_if(s == "").alias("empty_source"), F.count_if(t == "").alias("empty_target"),
        F.coalesce(F.sum(F.length(s)), F.lit(0)).cast("long").alias("src_chars"), F.coalesce(F.sum(F.length(t)), F.lit(0)).cast("long").alias("tgt_chars"),
    )
    return d.withColumn("duplicate", F.col("total") - F.col("unique"))


def aging(units: DataFrame) -> DataFrame:
    return units.groupBy(X.year_of(F.col("modified_at")).alias("year")).agg(F.count("*").alias("units"))


def by_domain(units: DataFrame) -> DataFrame:
    """Units by language pair and domain (else file name, else unknown)."""
    pair = F.concat_ws("->", F.coalesce("src_lang", F.lit("")), F.coalesce("tgt_lang", F.lit("")))
    domain = F.coalesce(F.nullif("domain", F.lit("")), X.base_name(F.nullif("source_file", F.lit(""))), F.lit("unknown"))
    return units.groupBy(pair.alias("pair"), domain.alias("domain")).agg(F.count("*").alias("units"))


def keep_one(members: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Units of clusters (cluster_id, ord) to delete: all but the one to keep, by default the first."""
    chosen = keep if keep is not None else members.groupBy("cluster_id").agg(F.min("ord").alias("ord"))
    return members.join(chosen, ["cluster_id", "ord"], "left_anti")
