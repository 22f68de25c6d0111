"""Mixing sources to target weights by capped water-filling.

A target is a source's share of the mix, by weight, at most ``max_epochs``
times its size; what a cap cuts off is dealt to the others by weight. Rows are
then taken by whole repetitions, and one more for a systematic sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.runtime import numbered, stored
from folio.operators.paging import ranked_keys

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Rows of a source of one size are dealt over so many buckets, which bounds what one task ranks.
BUCKETS = 256
#: Starts of the systematic sample that are tried for each source.
STARTS = 64


def word_count(text: Column) -> Column:
    """The number of runs of characters other than space and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(``_null``, ``_source``, source_size, target) from a table with ``source_size`` by source.

    Sources in order of code point, null last, take the weights in turn. What
    is left of the share is dealt by weight, sources that this takes above
    their cap are clamped, and so on until none is. Sources are ranked in
    ranges and summed, so that no task has all of them; the sums are exact, so
    that reruns agree.
    """
    name = F.concat(F.col("_null").cast("string"), F.lit(":"), "_source")  # false before true
    turn = F.pmod(F.col("_turn"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    ranked = ranked_keys(sizes.withColumn("_name", name), "_name", "_turn")
    held = stored(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs)).drop("_name", "_turn"), "targets")

    def exact(value: Column) -> Column:
        return F.sum(value.cast("decimal(38,6)")).cast("double")

    whole = held.agg(exact(F.col("source_size")).alias("size"), exact(F.col("weight")).alias("weight")).first()
    level = (whole["size"] or 0.0) * float(share) / (whole["weight"] or 1.0)
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        row = held.agg(exact(F.when(over, F.col("cap"))).alias("clamped"), exact(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not row["weight"]:  # all are clamped
            break
        before, level = level, ((whole["size"] or 0.0) * float(share) - (row["clamped"] or 0.0)) / row["weight"]
        if level <= before:
            break
    return held.select("_null", "_source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    Every row is returned, also those that the mix takes no copy of. A source's
    rows are ranked by size, from the largest, those of equal size by a seeded
    hash; row i gets a copy more where i times the fraction, plus a start,
    passes a whole number. Of 64 starts, which the seed shifts, each source has
    the one whose words come nearest to its target. All of it depends only on
    the rows and the seed, so reruns agree.

    Null and empty texts have size 0, very long ones are counted whole, null
    sources are a source, null ids are hashed as empty ones. Rows that repeat
    are rows of their own, and an empty table gives an empty result. Columns of
    the names above are replaced; any others, of whatever name, are returned as
    they are.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    names = docs.columns
    docs, known = numbered(docs)
    id_col, text_col, source_col = known[id_col], known[text_col], known[source_col]
    # the text too, so that rows without an id are dealt over the buckets
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.withColumns({"size": word_count(F.col(text_col)), "_digest": digest, "_has_text": F.col(text_col).isNotNull(), "_null": F.col(source_col).isNull(), "_source": F.coalesce(F.col(source_col).cast("string"), F.lit(""))})
    rows = rows.withColumn("_bucket", F.conv(F.substring("_digest", 1, 2), 16, 10).cast("int"))
    source, cell = ["_null", "_source"], ["_null", "_source", "size"]

    cells = stored(rows.groupBy(*cell, "_bucket").agg(F.count("*").alias("n")), "cells")
    in_cell = F.coalesce(F.sum("n").over(W.partitionBy(*cell).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = cells.groupBy(*cell).agg(F.sum("n").alias("n"))
    targets = source_targets(classes.groupBy(*source).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, max_epochs)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("_whole", F.floor(times)).withColumn("_part", times - F.floor(times))

    above = F.coalesce(F.sum("n").over(W.partitionBy(*source).orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = classes.withColumn("_above", above).join(targets, source)
    shift = F.conv(F.substring(F.md5(F.concat("_source", F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(STARTS - 1)), lambda i: (i + shift) / float(STARTS))).alias("_start")
    tried = ranked.select(*source, "size", "n", "_above", "_part", "source_size", start)

    def passed(rank: Column) -> Column:
        return F.floor(rank * F.col("_part") + F.col("_start"))

    words = F.sum(F.col("size") * (passed(F.col("_above") + F.col("n")) - passed(F.col("_above"))))
    miss = F.abs(words - F.first("_part") * F.first("source_size"))
    best = tried.groupBy(*source, "_start").agg(miss.alias("miss")).groupBy(*source).agg(F.min(F.struct("miss", "_start")).getField("_start").alias("_start"))
    plan = ranked.join(best, source).select(*cell, "_above", "source_size", "target", "_whole", "_part", "_start")
    plan = cells.withColumn("_in_cell", in_cell).drop("n").join(plan, cell)

    keys = [*cell, "_bucket"]
    # of rows of one id the digest tells all texts but null and empty ones: texts that the caller does not read are not shuffled
    order = W.partitionBy(*keys).orderBy("_digest", F.col(id_col), "_has_text")
    placed = rows.join(plan, keys).withColumn("_rank", F.col("_above") + F.col("_in_cell") + F.row_number().over(order))
    extra = passed(F.col("_rank")) - passed(F.col("_rank") - 1)
    return placed.withColumn("copies", (F.col("_whole") + extra).cast("int")).select(*docs.columns, "size", "source_size", "target", "copies").toDF(*names, "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns as they are."""
    plain, known = numbered(docs)
    taken = mix_sources(plain, known[id_col], known[text_col], known[source_col], **kw).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*plain.columns).toDF(*docs.columns)
