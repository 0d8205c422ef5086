"""Order MinHash fingerprints, with DataFrame functions only.

A text's k-mers are ``k`` consecutive tokens (a shorter text is one k-mer), numbered by occurrence so
that each (k-mer, number) is there once. A token is a word of up to ``WORD`` characters; longer runs
without white space are cut by their content, behind the first of the ``CUT`` characters from the third
on, or after ``PART`` characters without one, so that a change in a run moves the cuts next to it alone.
Under each of ``m`` random orders the two extreme k-mers are selected: the minimal one under the order and
the minimal one under its reverse, which are as likely to be any pair as the two smallest of one order
are. They're put back in text order and hashed together. Two texts agree in an entry of the
fingerprint if they share both k-mers in the same order, so the share of equal entries falls with the
edit distance, moves of text included.

Null texts count as empty and have the fingerprint ''. Two empty texts are alike (1), an empty and
another one aren't (0). Equal texts have equal fingerprints. Equal rows give one row; null ids come
after all others and are given back as null. An empty table gives no rows. Other columns are not looked
at, whatever their names. k-mers and their order have ``64 - BITS`` bits of a hash each, so that a position
fits beside them; of k-mers alike in these the earlier one goes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.lineage import kept


WORD, PART = 16, 12
#: Frequent characters of scripts, about a fourth of a run's; one in four parts of Han.
CUT = "aeioAEIO0-3аеиоαειο\u0E30-\u0E3A\u0EB0-\u0EBC\u102B-\u1032\u17B4-\u17C5\u306E-\u3093" + "".join(f"{chr(b)}-{chr(b + 0x1FF)}" for b in range(0x4E00, 0xA000, 0x800))
_IN = r"[^ \t\n\x0B\f\r]"
#: A word that ends in time, the part of a run up to a cut, or one without.
TOKENS = rf"(?<!{_IN}){_IN}{{1,{WORD}}}+(?!{_IN})|{_IN}{{2,{PART - 1}}}?[{CUT}]|{_IN}{{1,{PART}}}"
BITS = 30  # of a position: a text of 2 GB, the longest that Spark holds, has no more tokens
LAST = (1 << 63) - 1
_KEY = ["doc_id", "text_hash"]


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text", k: int = 2, m: int = 24) -> DataFrame:
    """(*keys, omh array<long>): the entries of each row's fingerprint, empty without k-mers. keys must
    tell rows apart; where rows are dealt by some of keys already, nothing is shuffled."""
    tokens = texts.select(*keys, F.regexp_extract_all(text_col, F.lit(TOKENS), F.lit(0)).alias("tok"))
    gram = ", ".join(f"get(tok, i + {j})" for j in range(k))
    packed = tokens.select(*keys, F.expr(f"""sort_array(if(size(tok) = 0, cast(array() as array<bigint>),
        transform(sequence(0, greatest(size(tok) - {k}, 0)), i -> shiftleft(xxhash64({gram}), {BITS}) | cast(i as bigint))))""").alias("s"))
    # s: k-mers by hash, then position; a k-mer's number is its distance from the first equal one
    numbered = packed.select(*keys, F.expr(f"""if(size(s) = 0, array(struct(0L as e, -1L as pos)), transform(s, (x, i) -> struct(
        xxhash64(shiftright(x, {BITS}), if(i > 0 and shiftright(x, {BITS}) = shiftright(s[greatest(i - 1, 0)], {BITS}),
            aggregate(sequence(1, {BITS}), struct(0 as lo, i as hi),
                (a, step) -> if(a.lo >= a.hi, a, if(shiftright(s[(a.lo + a.hi) div 2], {BITS}) < shiftright(x, {BITS}),
                    struct(cast((a.lo + a.hi) div 2 + 1 as int) as lo, a.hi as hi), struct(a.lo as lo, cast((a.lo + a.hi) div 2 as int) as hi))),
                a -> i - a.lo), 0)) as e, x & {(1 << BITS) - 1}L as pos)))""").alias("e"))  # fmt: skip
    # explode would add a filter on the array, and with it compute the array twice
    rows = numbered.select(*keys, F.explode_outer("e").alias("e")).select(*keys, F.coalesce("e.e", F.lit(0)).alias("e"), F.coalesce("e.pos", F.lit(-1)).alias("pos"))
    # each order's value has the position in its low bits and so is there once; orders are columns, not
    # expressions inside the aggregates, which keeps the generated code small
    orders = rows.select(*keys, "pos", *(F.expr(f"(xxhash64(e, {j}) & {-(1 << BITS)}L) | pos").alias(f"o{j}") for j in range(m)))
    ends = orders.groupBy(*keys).agg(F.max("pos").alias("top"), *(x for j in range(m) for x in (F.min(f"o{j}").alias(f"a{j}"), F.max(f"o{j}").alias(f"b{j}"))))

    def entry(j: int) -> Column:
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        first = a.bitwiseAND((1 << BITS) - 1) <= b.bitwiseAND((1 << BITS) - 1)
        x, y = F.shiftright(a, BITS), F.shiftright(b, BITS)
        return F.when(first, F.xxhash64(x, y)).otherwise(F.xxhash64(y, x))

    return ends.select(*keys, F.when(F.col("top") < 0, F.array().cast("array<long>")).otherwise(F.array(*map(entry, range(m)))).alias("omh"))


def likeness(a: str, b: str) -> Column:
    """The share of equal entries of two fingerprint columns."""
    return F.expr(f"""case when size({a}) = 0 and size({b}) = 0 then 1.0D when size({a}) = 0 or size({b}) = 0 then 0.0D
        else aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x) / cast(size({a}) as double) end""")


def printed(c: str) -> Column:
    return F.expr(f"array_join(transform({c}, x -> lpad(lower(hex(x)), 16, '0')), '')")


def _neighbours(ids: DataFrame) -> DataFrame:
    """Adds the keys of the next and the previous row in key order (the last one's next is the first).

    Ranges of rows are sorted apart; what is looked at across them is one row a range."""
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = kept(ids.repartitionByRange(n, *_KEY).withColumn("part", F.spark_partition_id()))
    me = F.struct(*_KEY, "n_chars")
    ends = d.groupBy("part").agg(F.min(me).alias("low"), F.max(me).alias("high"))
    w = Window.orderBy("part")  # as many rows as there are ranges
    ends = ends.withColumn("after", F.lead("low").over(w)).withColumn("before", F.lag("high").over(w)).withColumn("first", F.min("low").over(Window.partitionBy())).withColumn("last", F.max("high").over(Window.partitionBy()))
    ends = ends.select("part", F.coalesce("after", "first").alias("after"), F.coalesce("before", "last").alias("before"))
    own = Window.partitionBy("part").orderBy(*_KEY)
    d = d.withColumn("next", F.lead(me).over(own)).withColumn("prev", F.lag(me).over(own)).join(ends, "part")
    return d.select(*_KEY, "n_chars", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, m: int = 24) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each
    distinct (id, text), with the last quarter of the text replaced by the next document's beginning."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("text_hash", F.xxhash64("text"))
    order = _neighbours(d.select(*_KEY, F.length("text").cast("long").alias("n_chars")).distinct())
    whole = d.groupBy(*_KEY).agg(F.first("text").alias("text"))
    row = whole.join(order, _KEY)
    quarter = lambda n: F.floor(n / 4).cast("int")
    heads = row.select(F.col("prev.doc_id").alias("doc_id"), F.col("prev.text_hash").alias("text_hash"), F.substring("text", F.lit(1), quarter(F.col("prev.n_chars"))).alias("head"))
    row = row.join(heads, _KEY)
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter(F.col("n_chars"))), F.col("head"))
    row = row.select(*_KEY, "n_chars", "next", "text", edited.alias("edited"))
    both = row.select(*_KEY, "n_chars", "next", F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("v"))
    both = both.select(*_KEY, "n_chars", "next", F.when(F.col("v.side") == 1, F.col("edited_sha256")).alias("edited_sha256"), F.col("v.side").alias("side"), F.col("v.t").alias("t"))
    marks = fingerprints(both, [*_KEY, "side", "n_chars", "next", "edited_sha256"], "t", k, m)
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    got = kept(marks.groupBy(*_KEY).agg(side(0, "omh").alias("a"), side(1, "omh").alias("b"), F.max("n_chars").alias("n_chars"), F.max("next").alias("next"), F.max("edited_sha256").alias("edited_sha256")))
    other = got.select(F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"), F.col("a").alias("c"))
    out = got.join(other, (F.col("next.doc_id") == other.next_id) & (F.col("next.text_hash") == other.next_hash))
    return out.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", printed("a").alias("fingerprint"), printed("b").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"))
