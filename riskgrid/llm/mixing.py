"""Mixing sources to target weights (operator 9).

Each source gets a token target: a share of ``share`` times all tokens by its
weight, at most ``cap`` times its own tokens (what it cannot take is shared
again by weight among the others). A source's target is met by complete
epochs over all its documents and then a weighted sample without
replacement for the rest: every document draws an exponential key divided by
its quality weight (Efraimidis-Spirakis), the keys are sorted within the
source, and documents are taken in that order while the prefix sum of their
tokens stays within the rest of the budget.

A source may hold a third of all rows, so its keys are never sorted in one
task: keys are cut into ``BUCKETS`` equal parts of their distribution, the
prefix sum runs over the buckets' totals (at most that many rows a source), and
only the one bucket of a source in which the budget ends is ordered row by row.

Defined results: a null text has size 0; a null source is a source of its
own, after all others; null or non-positive quality weights count as 1;
repeated rows draw the same key and are ordered arbitrarily among
themselves; a source without words has target 0; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import fresh, numbered, q, settle, text_key

SHARE, CAP = 1.5, 2.0
WEIGHTS = (3, 1, 2)
BUCKETS = 1 << 14
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in (0, 1), the same in every run, from the digits of an MD5."""
    salted = F.concat_ws("|", F.lit(SEED), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(salted), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights=WEIGHTS) -> DataFrame:
    """source, source_size, weight, target: one row per source.

    min(cap * size, level * weight) with the level at which all targets add up
    to the whole budget: sources sorted by cap * size / weight fill up first.
    The two windows run over one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("nth", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (ranked.withColumn("weight", weight)
              .withColumn("most", F.col("source_size") * F.lit(float(cap)))
              .withColumn("ratio", F.col("most") / F.col("weight")))
    fill = Window.orderBy("ratio", "nth")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = (ranked
                .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                .withColumn("open_weight", F.sum("weight").over(after))
                .withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
                .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open_weight")))
    # The first source that its share does not fill sets the level of all behind it.
    open_level = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))
    levelled = levelled.withColumn("cut", F.min(open_level).over(whole))
    target = F.when(F.col("cut").isNull() | (F.struct("ratio", "nth") < F.struct(F.col("cut.ratio").alias("ratio"), F.col("cut.nth").alias("nth"))),
                    F.col("most")).otherwise(F.least("most", F.col("cut.level") * F.col("weight")))
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, share: float = SHARE, cap: float = CAP,
        weights=WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, text_key, size, source, source_size, target, copies, taken per row of ``docs``.

    ``quality``: (doc_id, quality_weight), at most one row per doc_id. ``cap``, the most
    copies of a document, is a whole number (else ValueError)."""
    if cap != int(cap):
        raise ValueError("cap counts copies of whole documents: a whole number")
    text = q(text_col)
    rows = docs.select(q(id_col).alias("doc_id"), text_key(id_col, text_col).alias("text_key"),
                       q(source_col).alias("source"), word_count(text).alias("size"),
                       uniform(q(id_col), text).alias("u"))
    if quality is None:
        rows = rows.withColumn("w", F.lit(1.0))
    else:
        w = F.col("quality_weight").cast("double")
        good = quality.select(F.col("doc_id").alias("_qid"), F.when(w > 0, w).alias("w"))
        rows = rows.join(good, F.col("doc_id") == F.col("_qid"), "left").drop("_qid").withColumn(
            "w", F.coalesce("w", F.lit(1.0)))
    # Exponential key over quality; its bucket follows the key's own order.
    rows = rows.withColumn("key", -F.log(F.col("u")) / F.col("w"))
    rows = rows.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(
        (F.lit(1.0) - F.exp(-F.col("key"))) * F.lit(BUCKETS))).cast("int"))

    # Small rows without texts; written once, so the texts are read and counted once.
    rows = settle(rows)
    cells = rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell"))
    sized = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    goal = targets(sized, share, cap, weights)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = goal.select(F.col("source").alias("s2"), "source_size", "target", "epochs", "rest")
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("ahead", F.coalesce(F.sum("cell").over(along), F.lit(0)))
    plan = (starts.join(goal, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
            .select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "cell", "ahead", "source_size", "target", "epochs", "rest"))
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    placed = placed.withColumn("edge", (F.col("ahead") <= F.col("rest")) & (F.col("ahead") + F.col("cell") > F.col("rest")))
    whole = placed.where(~F.col("edge")).withColumn(
        "extra", (F.col("ahead") + F.col("cell") <= F.col("rest")).cast("long"))
    inside = (Window.partitionBy("s2", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "text_key")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = placed.where("edge").withColumn("upto", F.col("ahead") + F.sum("size").over(inside))
    # The document on which the budget ends is taken if that comes nearer to it.
    edge = edge.withColumn("extra", (F.col("upto") - F.col("size") / F.lit(2.0) <= F.col("rest")).cast("long")).drop("upto")
    both = whole.unionByName(edge).withColumn("copies", F.col("epochs") + F.col("extra"))
    # A source at its cap has no rest; nothing is taken more often than the cap allows.
    both = both.withColumn("copies", F.least("copies", F.lit(int(cap)).cast("long")))
    return both.select("doc_id", "text_key", "size", "source", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, quality: DataFrame | None = None, share: float = SHARE, cap: float = CAP, weights=WEIGHTS,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents, all columns: each row as often as the mix takes it.

    Rows that repeat an id and a text share the copies that the mix gives to all of them:
    each is taken as often as any other of them, or once more."""
    tid, tkey, rows, total, again, nth = (fresh(docs, c) for c in ("tid", "tkey", "rows", "total", "again", "nth"))
    plan = settle(mix(docs, quality, share, cap, weights, id_col, text_col, source_col)
                  .groupBy(F.col("doc_id").alias(tid), F.col("text_key").alias(tkey))
                  .agg(F.count(F.lit(1)).alias(rows), F.sum("copies").alias(total)).where(q(total) > 0))

    def taken(which: DataFrame) -> DataFrame:
        return docs.join(which, q(id_col).eqNullSafe(q(tid)) & (text_key(id_col, text_col) == q(tkey)))

    def repeated(joined: DataFrame, copies: Column) -> DataFrame:
        times = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))
        return joined.withColumn(again, F.explode(times)).select(*[q(c) for c in docs.columns])

    out = repeated(taken(plan.where(q(rows) == 1)), q(total))
    several = plan.where(q(rows) > 1)
    if several.isEmpty():
        return out
    numbers = numbered(taken(several), [tid, tkey], nth)
    share_of = F.expr(f"`{total}` div `{rows}`") + (q(nth) <= F.pmod(q(total), q(rows))).cast("long")
    return out.unionByName(repeated(numbers, share_of))
