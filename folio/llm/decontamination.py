"""Benchmark decontamination by spaced seeds.

A seed is a window of nine words of which a fixed mask reads five. The four
masks are chosen so that every alignment that the comparison accepts has a
seed. Seeds of documents and of benchmark items are joined, and around each
hit the aligned words are compared: as every accepted run of words has a hit
within, the words that a run of it can hold are all that is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import bounded, numbered, stored

SPAN = 9
#: Positions that each mask reads. Wherever AGREE of 9 to WINDOW words agree, a window of these has one
#: mask all of whose words agree; fewer masks of five words do not do it.
MASKS = ((0, 1, 5, 7, 8), (2, 3, 4, 5, 8), (0, 2, 5, 6, 7), (1, 2, 3, 6, 8))
#: Words that are compared around a hit, or the item if it is shorter, and the share of them that must agree.
WINDOW = 16
AGREE = 0.8
#: Words beside a seed's window that a compared run can reach.
BESIDE = WINDOW - SPAN
#: Words of a window with its surroundings.
WIDE = SPAN + 2 * BESIDE
#: Windows of the pieces that a text is cut to, and of those that these are cut to, which rows carry.
PIECES = (16_384, 64)
#: Items' seeds that are broadcast at once: of about 300 bytes each, so 150 MB; more items take more passes.
BLOCK_SEEDS = 500_000


def token_hashes(text: Column) -> Column:
    """Hashes of the text's words: runs of letters and digits, in lower case; null has none."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(spaced, " "), lambda w: F.xxhash64(w)))


def _cut(rows: DataFrame, words: str, windows: int) -> DataFrame:
    """``rows`` with their words cut to pieces that have so many windows each; pieces overlap by a window less a word.

    A text that is too short for a window has one null piece: the outer form
    keeps Spark from making the words twice to filter.
    """
    rest = [c for c in rows.columns if c != words]
    here = F.size(words) - WIDE + 1
    starts = F.when(here > 0, F.sequence(F.lit(1), here, F.lit(windows)))
    return rows.select(*rest, words, F.explode_outer(starts).alias("_from")).select(*rest, F.slice(words, F.col("_from"), windows + WIDE - 1).alias(words))


def _around(rows: DataFrame, words: str, at: str, beyond: int) -> DataFrame:
    """``rows`` with every window of their words: ``at`` is where in ``words``, by then a small piece, its surroundings begin.

    Words outside the text are null; ``beyond`` windows stand outside by a word
    at either end. Each row that is made carries a piece only, and pieces are
    made of larger ones, so that time and memory grow with the text and not
    with its square.
    """
    nothing = F.array_repeat(F.lit(None).cast("bigint"), BESIDE + beyond)
    pieces = rows.withColumn(words, F.concat(nothing, words, nothing))
    for windows in PIECES:
        pieces = _cut(pieces, words, windows)
    return pieces.select("*", F.explode_outer(F.sequence(F.lit(0), F.size(words) - WIDE)).alias(at))


def _seeds(words: str, at: str) -> Column:
    """The seeds of a window amid its surroundings; null for a mask that reads a word outside the text."""
    word = [F.get(F.col(words), F.col(at) + BESIDE + j) for j in range(SPAN)]
    return F.array(*[F.when(word[mask[0]].isNotNull() & word[mask[-1]].isNotNull(), F.xxhash64(F.lit(m), *[word[j] for j in mask])) for m, mask in enumerate(MASKS)])


def _agreement(words: str, at: str, own: str) -> Column:
    """A bit for each word of a hit's surroundings: whether it agrees."""
    same = [F.get(F.col(words), F.col(at) + j) == F.get(F.col(own), j) for j in range(WIDE)]
    return reduce(Column.bitwiseOR, [F.when(x, 1 << j).otherwise(0) for j, x in enumerate(same)])


def _best_run(bits: str) -> Column:
    """How many words agree in the best run of ``WINDOW`` words that holds the seed's."""
    return F.greatest(*[F.bit_count(F.col(bits).bitwiseAND(F.lit(((1 << WINDOW) - 1) << i))) for i in range(BESIDE + 1)])


def benchmark_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_seeds: int = BLOCK_SEEDS, item_text_col: str | None = None) -> DataFrame:
    """(doc_id, item_id, agreeing, compared) of every document that repeats a passage of an item.

    ``compared`` is the number of words compared, ``WINDOW`` or the item's
    length; ``agreeing`` how many of them agree at the best place. A pair is
    returned if that is ``AGREE`` of them at least, words that a document ends
    before counting as others; none of these pairs is missed. Items of fewer
    than ``SPAN`` words match nothing; null and empty texts likewise, and an
    empty table of documents or items gives no pairs. Very long texts are read
    whole, in time that grows with their length. Rows that share an id share
    their pairs; a null id is returned as such. Repeated items give one row,
    and other columns are ignored; items' texts are
    in ``item_text_col``, by default of the same name.

    Items are few: their seeds are counted and broadcast in blocks of bounded
    size, so that documents are never shuffled by words.
    """
    every = items.select(F.col(item_col).alias("item_id"), token_hashes(F.col(item_text_col or text_col)).alias("_item")).where(F.size("_item") > 0).distinct()
    held = every.where(F.size("_item") >= SPAN)
    n_seeds = held.agg(F.sum((F.size("_item") - SPAN + 1) * len(MASKS))).first()[0] or 0
    blocks = max(1, -(-n_seeds // block_seeds))
    rows = docs.select(F.col(id_col).alias("doc_id"), token_hashes(F.col(text_col)).alias("_doc"))
    # of a nine-word item eight words can stand at a document's edge
    found = _around(rows, "_doc", "_at", 1)
    found = found.select("doc_id", "_doc", "_at", F.explode_outer(_seeds("_doc", "_at")).alias("seed"))
    seeds = _around(held.select("item_id", F.least(F.size("_item"), F.lit(WINDOW)).alias("compared"), "_item"), "_item", "_at", 0)
    seeds = seeds.select("item_id", "compared", F.slice("_item", F.col("_at") + 1, WIDE).alias("_own"), F.explode_outer(_seeds("_item", "_at")).alias("seed"))
    seeds = seeds.where("seed is not null").distinct()
    hits = None
    for b in range(blocks):
        part = seeds.where(F.pmod(F.xxhash64("_own", "seed"), F.lit(blocks)) == b) if blocks > 1 else seeds
        # exploded, as Spark would take a condition on them into the join, whose code would grow too long to compile
        met = found.join(F.broadcast(part), "seed").select("doc_id", "item_id", "compared", F.explode(F.array(_agreement("_doc", "_at", "_own"))).alias("_bits"))
        hits = met if hits is None else hits.unionByName(met)
    short = _short_matches(rows, every.where(F.size("_item") < SPAN))
    best = hits.withColumn("agreeing", _best_run("_bits")).where(F.col("agreeing") >= F.ceil(F.col("compared") * AGREE)).groupBy("doc_id", "item_id")
    best = best.agg(F.max("agreeing").cast("long").alias("agreeing"), F.max("compared").cast("long").alias("compared"))
    if short is None:
        return best
    # rows of one item id may have texts of either kind
    whole = best.unionByName(short).groupBy("doc_id", "item_id")
    return whole.agg(F.max("agreeing").alias("agreeing"), F.max("compared").alias("compared"))


def _short_matches(rows: DataFrame, short: DataFrame) -> DataFrame | None:
    """(doc_id, item_id, agreeing, compared) of documents that hold all words of a short item, None if there are no such items.

    Documents are read once for all lengths; every run of such a length is
    looked up among the items, which are broadcast in the place of a join by a
    shuffle only as far as Spark knows their size to allow it.
    """
    lengths = sorted(r["n"] for r in short.select(F.size("_item").alias("n")).distinct().collect())  # eight at most
    if not lengths:
        return None

    def runs_of(n: int) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size("_doc") - n + 1), lambda i: F.xxhash64(F.lit(n), F.slice("_doc", i, n)))
        return F.when(F.size("_doc") >= n, hashes).otherwise(F.array().cast("array<bigint>"))

    runs = [runs_of(n) for n in lengths]
    found = rows.select("doc_id", F.explode(F.array_distinct(F.concat(*runs))).alias("run"))
    wanted = short.select("item_id", F.size("_item").cast("long").alias("agreeing"), F.xxhash64(F.size("_item"), "_item").alias("run"))
    return found.join(wanted, "run").select("doc_id", "item_id", "agreeing", F.col("agreeing").alias("compared")).distinct()


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` without the rows that repeat a passage of an item, each judged by itself whatever its id.

    Rows of null or empty texts are kept, repeated rows go or stay together,
    and an empty table stays empty.
    """
    plain, known = numbered(docs)
    rows = stored(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    hit = benchmark_overlaps(rows, items, "row", known[text_col], item_col, item_text_col=text_col).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(bounded(stored(hit, "hit")), "row", "left_anti").drop("row").toDF(*docs.columns)
