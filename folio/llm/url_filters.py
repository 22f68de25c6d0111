"""URL filters by a temporal join with dated lists.

A list is a log of entries: a pattern (a host, with all below it, and perhaps
the start of a path) is added or removed at a time. Entries become intervals
in which they hold, and each capture is judged by those that held when it was
fetched: what decides for a pattern is a table of instants from which it does,
and an as-of join takes a capture to the last one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.runtime import numbered, stored

ENTRY_SCHEMA = "list string, effect string, pattern string, action string, at timestamp"

#: Captures of a pattern that one task orders by time at most, on average; more are dealt out with a copy of the pattern's instants each.
CAPTURES_A_PART = 1_000_000


def url_host(url: Column) -> Column:
    """The host in lower case, without user, port and closing dot; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]*)", 1))
    return F.coalesce(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def url_path(url: Column) -> Column:
    """The path, without query and fragment; '/' if it is empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, effect, host, path, since, until): when each added pattern held; until is open or exclusive.

    An entry holds until the next one of its list and pattern. Of entries of
    one instant the addition counts. Entries without a pattern, time or list
    are left out; an effect other than 'allow' blocks.
    """
    known = entries.where("pattern is not null and pattern != '' and at is not null and list is not null")
    pattern = F.col("pattern")
    cut = F.instr(pattern, "/")
    host = F.lower(F.when(cut > 0, F.substring(pattern, F.lit(1), cut - 1)).otherwise(pattern))
    path = F.when(cut > 0, F.substring(pattern, cut, F.length(pattern))).otherwise("/")
    effect = F.when(F.max(F.when(F.col("effect") == "allow", 0).otherwise(1)) == 0, "allow").otherwise("block")
    once = known.groupBy("list", host.alias("host"), path.alias("path"), "at").agg(effect.alias("effect"), F.max(F.col("action") == "add").alias("added"))
    until = F.lead("at").over(W.partitionBy("list", "host", "path").orderBy("at"))
    return once.withColumn("until", until).where("added").select("list", "effect", "host", "path", F.col("at").alias("since"), "until")


def pattern_states(intervals: DataFrame) -> DataFrame:
    """(suffix, path, at, best): what decides for a pattern from an instant on, until its next one.

    ``best`` is (blocks, list): of the lists whose interval covers the instant
    one that blocks, then the last by name; null if none holds. The instants of
    a pattern are numbered, an interval is cut into runs of 2^level of them
    that begin at multiples of that, and an instant looks up the runs that it
    is in, one a level. So rows grow with the entries times a logarithm, however
    many lists name one pattern.
    """
    pattern = ["suffix", "path"]
    spans = intervals.withColumnRenamed("host", "suffix").withColumn("best", F.struct((F.col("effect") == "block").alias("blocks"), "list"))
    ends = F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(True).alias("opens")), F.struct(F.col("until").alias("at"), F.lit(False).alias("opens"))))
    events = spans.select(*pattern, "best", "since", ends.alias("end")).select(*pattern, "best", "since", "end.*").where("at is not null")
    numbers = events.withColumn("number", F.dense_rank().over(W.partitionBy(*pattern).orderBy("at")).cast("long") - 1)
    numbers = numbers.withColumn("n", F.max("number").over(W.partitionBy(*pattern)) + 1)
    levels = F.explode(F.expr("sequence(0, int(floor(log2(n))))")).alias("level")

    covered = numbers.groupBy(*pattern, "best", "since", "n").agg(F.min("number").alias("a"), F.max(F.when(~F.col("opens"), F.col("number"))).alias("b"))
    covered = covered.select(*pattern, "best", "a", F.coalesce("b", "n").alias("b"), levels)
    covered = covered.withColumn("low", F.expr("shiftright(a + shiftleft(1L, level) - 1, level)")).withColumn("high", F.expr("shiftright(b, level)")).where("low < high")
    runs = F.explode(F.array(F.when(F.col("low") % 2 == 1, F.col("low")), F.when(F.col("high") % 2 == 1, F.col("high") - 1)))
    covered = covered.select(*pattern, "level", runs.alias("run"), "best").where("run is not null").groupBy(*pattern, "level", "run").agg(F.max("best").alias("best"))

    instants = numbers.select(*pattern, "at", "number", "n").distinct().select(*pattern, "at", "number", levels)
    instants = instants.withColumn("run", F.expr("shiftright(number, level)"))
    return instants.join(covered, [*pattern, "level", "run"], "left").groupBy(*pattern, "at").agg(F.max("best").alias("best"))


def judged(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at", captures_a_part: int = CAPTURES_A_PART) -> DataFrame:
    """``captures`` with ``host``, ``matched_list``, ``matched_pattern`` and ``kept``.

    Of the patterns that held when a capture was fetched, the longest decides;
    of those of equal length one that blocks, then the last by list and
    pattern. Without one the capture is kept, and so are those without a host
    or a time. Every capture is returned once, repeated rows and nulls
    included, URLs however long. An empty table of captures gives an empty
    result, one of entries keeps all. Columns of the names above are replaced;
    any others, of whatever name, are returned as they are.

    Captures of hosts that a list reaches are made distinct by host, path and
    time, and each is looked up for the starts of its path that have the length
    of some pattern's: instants and captures of a pattern are united and
    ordered by time, and the last instant before a capture tells. The captures
    of a pattern that has many are dealt out, with a copy of its instants for
    each part. What was found is joined back by host, path and time, so that no
    host is a hot key of that join.
    """
    names = [c for c in captures.columns if c not in ("host", "matched_list", "matched_pattern", "kept")]
    plain, known = numbered(captures.drop("host", "matched_list", "matched_pattern", "kept"))
    plain = plain.withColumn("host", url_host(F.col(known[url_col])))
    where = [F.col("host"), url_path(F.col(known[url_col])).alias("whole"), F.col(known[time_col]).alias("at")]
    seen = plain.select(*where).where("host != '' and at is not null")
    states = stored(pattern_states(validity_intervals(entries)), "states")

    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n")).select("host", "n", F.explode(suffix).alias("suffix"))
    # no more lengths than the longest path has characters
    reach = stored(hosts.join(states.groupBy("suffix").agg(F.collect_set(F.length("path")).alias("lengths")), "suffix"), "reach")
    parts = reach.groupBy("suffix").agg(F.ceil(F.sum("n") / captures_a_part).cast("int").alias("parts"))
    nothing = F.struct(F.lit(None).cast("boolean").alias("blocks"), F.lit(None).cast("string").alias("list"))
    dealt = states.join(parts, "suffix").select("suffix", "path", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "at", F.coalesce("best", nothing).alias("state"))

    asked = seen.join(reach.select("host"), "host", "left_semi").distinct().join(reach.join(parts, "suffix").drop("n"), "host")
    part = F.pmod(F.xxhash64("host", "whole", "at"), F.col("parts")).cast("int").alias("part")
    asked = asked.select("host", "whole", "at", "suffix", part, F.explode(F.filter("lengths", lambda n: n <= F.length("whole"))).alias("length"))
    asked = asked.select("host", "whole", "at", "suffix", "part", F.substring("whole", F.lit(1), F.col("length")).alias("path"))
    of_pattern = W.partitionBy("suffix", "path", "part").orderBy("at", F.col("host").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    judged_at = asked.unionByName(dealt, allowMissingColumns=True).withColumn("state", F.last("state", ignorenulls=True).over(of_pattern))
    judged_at = judged_at.where("host is not null and state.list is not null")
    pattern = F.concat("suffix", F.when(F.col("path") == "/", "").otherwise(F.col("path")))
    best = F.max(F.struct((F.length("suffix") + F.length("path")).alias("length"), "state.blocks", "state.list", pattern.alias("pattern"))).alias("best")
    found = stored(judged_at.groupBy("host", "whole", "at").agg(best), "found").toDF("_host", "_whole", "_at", "best")

    same = (F.col("host") == F.col("_host")) & (url_path(F.col(known[url_col])) == F.col("_whole")) & (F.col(known[time_col]) == F.col("_at"))
    told = ["host", F.col("best.list"), F.col("best.pattern"), ~F.coalesce(F.col("best.blocks"), F.lit(False))]
    return plain.join(found, same, "left").select(*known.values(), *told).toDF(*names, "host", "matched_list", "matched_pattern", "kept")
