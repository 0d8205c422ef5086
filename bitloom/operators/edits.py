"""Edits of a corpus by hand: units added, changed and deleted, as one join with the edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions import text as X

NODES = "array<struct<kind:string,content:string>>"


def stripped(nodes: Column) -> Column:
    """Nodes without white space at the two ends, as far as text is there; a tag at an end is left alone.
    Empty nodes go."""
    left, right = rf"(?U)\A{X.WS}+", rf"(?U){X.WS}+\z"
    cut = lambda x, i: F.struct(
        x["kind"].alias("kind"),
        F.when((x["kind"] == "text") & (i == 0) & (F.size(nodes) == 1), X.py_strip(x["content"]))
        .when((x["kind"] == "text") & (i == 0), F.regexp_replace(x["content"], left, ""))
        .when((x["kind"] == "text") & (i == F.size(nodes) - 1), F.regexp_replace(x["content"], right, ""))
        .otherwise(x["content"])
        .alias("content"),
    )
    return F.filter(F.transform(nodes, cut), lambda x: x["content"] != "")


def visible(nodes: Column) -> Column:
    """The text of nodes, without their tags."""
    return F.array_join(F.transform(F.filter(nodes, lambda x: x["kind"] == "text"), lambda x: x["content"]), "")


def apply(units: DataFrame, edits: DataFrame) -> DataFrame:
    """units (ord, src_lang, tgt_lang, src_text, tgt_text, ...) after edits (op, ord, seq, src_lang,
    tgt_lang, src_nodes, tgt_nodes), with place, struct (ord, seq): the order of what comes out.

    add: a unit behind ord, several in order of seq; change: the unit's texts and markup, its languages
    stay and what else it had goes, as it is another unit now; delete. Nodes are stripped; markup without a
    tag is no markup. Of several changes of a unit the last by seq counts, and a deletion over all. An
    added or changed unit needs both texts, else this fails. Edits of units that aren't there do nothing."""
    e = edits
    for side in ("src", "tgt"):
        nodes = stripped(F.coalesce(F.col(f"{side}_nodes"), F.array().cast(NODES)))
        e = e.withColumn(f"{side}_new", nodes).withColumn(f"{side}_text", visible(F.col(f"{side}_new")))
        e = e.withColumn(f"{side}_markup", F.when(F.exists(f"{side}_new", lambda x: x["kind"] == "tag"), F.col(f"{side}_new")))
    blank = (F.col("op") != "delete") & ((X.py_strip(F.col("src_text")) == "") | (X.py_strip(F.col("tgt_text")) == ""))
    e = e.withColumn("src_text", F.when(blank, F.raise_error(F.concat(F.lit("an edit without both texts at "), F.col("ord").cast("string")))).otherwise(F.col("src_text")))
    values = ("src_text", "tgt_text", "src_markup", "tgt_markup")
    gone = e.filter("op = 'delete'").select("ord").distinct()
    last = e.filter("op = 'change'").groupBy("ord").agg(F.max_by(F.struct(*values), "seq").alias("new"))
    d = units.join(gone, "ord", "left_anti").join(last, "ord", "left").withColumn("place", F.struct(F.col("ord"), F.lit(0).cast("long").alias("seq")))
    has = F.col("new").isNotNull()
    own = {"ord", "src_lang", "tgt_lang", *values}
    out = []
    for c in units.columns:
        if c in values:
            out.append(F.when(has, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c) if c in own else F.when(~has, F.col(c)).alias(c))
    d = d.select(*out, "place")
    new = e.filter("op = 'add'").withColumn("place", F.struct("ord", (F.col("seq") + 1).cast("long").alias("seq")))
    new = new.select(*(c for c in units.columns if c in own), "place")
    return d.unionByName(new, allowMissingColumns=True)
