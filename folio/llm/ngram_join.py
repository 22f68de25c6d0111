"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Documents are sets of five-word shingles, held as 64-bit hashes, and two are
linked when 100 * intersection >= 75 * union. The join runs in steps, each of
which is exact or only leaves out work that cannot matter:

1. *Possible rows.* Over inverted lists of all shingles, a document stays only
   if it shares with other texts the overlap T that any link needs.
2. *Classes.* Of each set one representative goes on.
3. *Contraction.* In bounded blocks DivideSkip links each set to a set before
   it. Linked sets need no search among each other, so a large group of near
   copies costs no more than its rows.
4. *Possible rows again*, now counting only what other groups share.
5. *Search.* The groups that are left meet by the tokens of their sets'
   prefixes, and DivideSkip finds which of them links join. Between groups
   that are joined already no link is looked for.
6. *Components* of what was joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.components import component_labels
from folio.llm.occurrence import THRESHOLD, DivideSkip, joined_clusters, possible_rows
from folio.llm.runtime import bounded, column, discard, giving_back, numbered, partitions, small_batches, stored
from folio.llm.spans import whole_number
from folio.llm.words import mix, shingle_sets

SHINGLE = 5
#: Rows whose tokens a task holds at once.
SLICE_ROWS = 1_500
#: Tokens of a block of the contraction, which bounds a task's memory.
BLOCK_TOKENS = 250_000
#: Tokens that are searched in one task; of more, the sets meet part by part.
UNIT_TOKENS = 500_000
_SETS = "digest binary, n long, tokens binary"
_SETS_ARROW = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary())])


def _digests(sizes: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """128 bits of each set, which tell the sets of any corpus apart; the first 64 are never zero."""
    whole = (xxhash.xxh3_128_digest(tokens[e - s : e]) for s, e in zip(sizes, np.cumsum(sizes), strict=True))
    return [bytes([d[0] | 1]) + d[1:] for d in whole]


def _heads(digests: list[bytes]) -> np.ndarray:
    """The first 64 bits of digests: where two share them, too much is taken for possible, never too little."""
    return np.frombuffer(b"".join(digests), np.int64)[::2].copy()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, known, text): rows without an id have the key 0, and are not known."""
    id_ = whole_number(docs, id_col)
    return small_batches(docs).select(F.coalesce(id_, F.lit(0).cast("long")).alias("key"), id_.isNotNull().alias("known"), column(text_col).cast("string").alias("text"))


def _sets_of(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.Array, list[bytes], np.ndarray, np.ndarray]]:
    """(keys, digests, sizes, tokens) of the texts of a batch, some rows at a time."""
    for at in range(0, batch.num_rows, SLICE_ROWS):
        rows = batch.slice(at, SLICE_ROWS)
        parts = list(shingle_sets(rows["text"], k))
        sizes, tokens = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
        yield rows["key"], _digests(sizes, tokens), sizes, tokens


def _text_sets(k: int):
    """Reads batches of (key, text) for ``possible_rows``: of equal sets of a slice the first, by its digest's head."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for _, digests, sizes, tokens in _sets_of(batch, k):
            first = dict(zip(reversed(digests), range(len(digests) - 1, -1, -1), strict=True))
            keep = np.zeros(len(sizes), bool)
            keep[list(first.values())] = True
            keep &= sizes > 0
            keys = _heads(digests)[keep]
            yield keys, keys.view(np.uint64), sizes[keep], tokens[np.repeat(keep, sizes)]

    return read


def document_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(key, known, n, digest, head) of every row: whether it has an id, its set's size, a digest that equal sets share, and the digest's first 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for keys, digests, sizes, _ in _sets_of(batch, k):
                known = batch["known"].slice(at, len(keys))
                at += len(keys)
                yield pa.RecordBatch.from_arrays([keys, known, pa.array(sizes.astype(np.int64)), pa.array(digests, pa.binary()), pa.array(_heads(digests))], names=["key", "known", "n", "digest", "head"])

    return _keyed(docs, id_col, text_col).mapInArrow(giving_back(run), "key long, known boolean, n long, digest binary, head long")


def _stored_sets(whole: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Reads batches of (key, group, n, tokens) for ``possible_rows``."""
    for at in range(0, whole.num_rows, SLICE_ROWS):
        batch = whole.slice(at, SLICE_ROWS)
        tokens = np.frombuffer(b"".join(batch["tokens"].to_pylist()), np.uint64)
        yield np.asarray(batch["key"], np.int64), np.asarray(batch["group"], np.int64).view(np.uint64), np.asarray(batch["n"], np.int64), tokens


def _as_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, digests, sizes, tokens in _sets_of(batch, k):
            bodies = [tokens[e - s : e].tobytes() for s, e in zip(sizes, np.cumsum(sizes), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes.astype(np.int64)), pa.array(bodies, pa.binary())], schema=_SETS_ARROW)


def contracted(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(key, leader) for every set: the first set of its block that it reaches by links found there, or itself.

    Only sets that are linked with none before them are indexed, so that a
    block of near copies costs little more than its rows; a set that is linked
    with several of these joins them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, leaders, parent, held = DivideSkip(threshold), [], [], []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([leaders[root(i)] for _, i in held], pa.int64())], names=["key", "leader"])

        for batch in batches:
            for key, body in zip(batch["key"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
                if index.postings >= BLOCK_TOKENS:
                    yield block()
                    index, leaders, parent, held = DivideSkip(threshold), [], [], []
                tokens = np.frombuffer(body, np.uint64).tolist()
                found = index.search(tokens)
                if not found:
                    parent.append(index.add(tokens))
                    leaders.append(key)
                    found = [len(leaders) - 1]
                held.append((key, found[0]))
                for other in found[1:]:  # a set that is linked with two joins them
                    parent[max(root(other), root(found[0]))] = min(root(other), root(found[0]))
        if held:
            yield block()

    return sets.select("key", "tokens").mapInArrow(giving_back(run), "key long, leader long")


def _least_tokens(sets: DataFrame, seed: int) -> DataFrame:
    """Sets with the least token under a permutation, in that order within a partition: near copies meet."""
    salt = np.uint64((2 * seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [int(mix(np.frombuffer(x, np.uint64) ^ salt).min().view(np.int64)) for x in batch["tokens"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["tokens"], pa.array(least, pa.int64())], names=["key", "tokens", "least"])

    met = sets.select("key", "tokens").mapInArrow(giving_back(run), "key long, tokens binary, least long")
    return met.repartition(partitions(sets.sparkSession), "least").sortWithinPartitions("least", "key")


def _postings(sets: DataFrame) -> DataFrame:
    """(token, key, group, n): every token of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                tokens = np.frombuffer(b"".join(batch["tokens"].to_pylist()), np.int64)
                of = pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(batch["n"], np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(tokens), *(batch[c].take(of) for c in ("key", "group", "n"))], names=["token", "key", "group", "n"])

    return sets.mapInArrow(giving_back(run), "token long, key long, group long, n long")


def _prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """(token, key, group, n): tokens of each set of which any two linked sets of different groups share one.

    Such sets share T tokens, all of which several groups have. Without the
    T - 1 of these that have the longest lists, a set still shares one with
    every set that it is linked with: the lists that are merged are the short
    ones.
    """
    posts = _postings(sets)
    lists = posts.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("k")).where("lo != hi")
    shared = posts.select("token", "key").join(lists.select("token", "k"), "token").join(sets.select("key", "group", "n"), "key")
    of_set = W.partitionBy("key")
    need = F.ceil(F.col("n") * threshold / 100)
    ranked = shared.withColumn("rank", F.row_number().over(of_set.orderBy("k", "token"))).withColumn("all", F.count("*").over(of_set))
    return ranked.where(F.col("rank") <= F.col("all") - need + 1).select("token", "key", "group", "n")


def _parted_units(posts: DataFrame, large: DataFrame, bound: int) -> tuple[DataFrame, list[DataFrame]]:
    """(unit, key): the sets of large units, which meet in tasks of about ``bound`` tokens; and the stored tables that it reads.

    ``posts`` and ``large`` are (unit, key, n, token) and (unit, weight). The sets
    meet list by list, or all of a unit do, whichever reads fewer tokens: near
    copies have many long lists of almost the same sets, a frequent token joins
    sets with short ones. Of more than ``bound`` tokens each two parts meet.
    Lists of the same sets are searched once: they are told by their number and
    by sums of hashes of the sets.
    """
    parts = F.ceil(2 * F.col("weight") / bound)
    parts = F.when(parts > 2, parts).otherwise(1).cast("int").alias("parts")
    lists = posts.groupBy("unit", "token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "key"), 16)).alias("s"), F.sum("n").alias("weight"))
    once = lists.groupBy("unit", "c", "x", "s").agg(F.min("token").alias("token"), F.first("weight").alias("weight")).select("unit", "token", parts, "weight")
    once = stored(once, "lists")
    read = once.groupBy("unit").agg(F.sum(F.col("weight") * F.col("parts")).alias("by_list"))
    plan = stored(large.select("unit", "weight", parts).join(read, "unit").select("unit", "parts", (F.col("by_list") < F.col("weight") * F.col("parts")).alias("listed")), "plan")
    by_list = posts.select("token", "key").join(once.join(plan.where("listed").select("unit"), "unit", "left_semi").select("token", "parts"), "token")
    whole = posts.select("unit", "key").distinct().join(plan.where("not listed").select("unit", "parts"), "unit")
    met = by_list.unionByName(whole.withColumnRenamed("unit", "token")).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = met.select("key", "token", "part", other).select(F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other")).alias("unit"), "key")
    return met.distinct(), [once, plan]


def joined_groups(sets: DataFrame, threshold: int = THRESHOLD, bound: int = UNIT_TOKENS) -> DataFrame:
    """(group, label): the groups that links between their sets join to others, with what they are joined to.

    Groups that reach each other by prefix tokens are searched in one task,
    once. Where their sets have more than ``bound`` tokens, they meet in parts
    (``_parted_units``). A search gives a row for each group at most, whatever
    the number of links.
    """
    posts = stored(_prefixes(sets, threshold), "prefixes")
    # written, so that the join has an exchange on either side and a token that very many sets have can be split
    least = stored(posts.groupBy("token").agg(F.min("group").alias("least")), "least")
    met = component_labels(posts.join(least, "token").select(F.col("group").alias("a"), F.col("least").alias("b")))
    placed = sets.join(met.select(F.col("node").alias("group"), F.col("label").alias("unit")), "group")
    large = stored(placed.groupBy("unit").agg(F.sum("n").alias("weight")).where(F.col("weight") > bound), "large")
    split = not large.isEmpty()
    whole, made = (placed.join(large, "unit", "left_anti") if split else placed).select("unit", "group", "n", "tokens"), []
    if split:
        parts = placed.join(large, "unit", "left_semi").select("key", "group", "n", "tokens")
        of_unit = placed.join(large, "unit", "left_semi").select("unit", "key")
        units, made = _parted_units(posts.select("token", "key", "n").join(of_unit, "key"), large, bound)
        whole = whole.unionByName(units.join(parts, "key").select("unit", "group", "n", "tokens"))

    def run(table: pa.Table) -> pa.Table:
        names, groups = np.unique(np.asarray(table["group"]), return_inverse=True)
        tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint64)
        root = joined_clusters(groups, np.asarray(table["n"], np.int64), tokens, threshold)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(names[moved], pa.int64()), "b": pa.array(names[root[moved]], pa.int64())})

    # a search costs more than its bytes tell: as many tasks as there are partitions
    found = whole.repartition(partitions(sets.sparkSession), "unit").groupBy("unit").applyInArrow(run, "a long, b long")
    found = stored(found, "joined")
    discard(posts, least, met, large, *made)
    if not split:  # each group was in one task, which knows all it is joined to
        return found.withColumnsRenamed({"a": "group", "b": "label"})
    return component_labels(found).withColumnRenamed("node", "group")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the least id reachable by links, the row's own
    included. Rows of the same set share it. Null and empty texts have no
    shingles and are linked with nothing: their component is their own id, and
    a null id without a partner keeps a null component. A null id is never a
    component's least id; ids are of an integer type, any of its values, else a
    TypeError is raised. Repeated rows are returned as often as given, very
    long texts are read whole, an empty table gives an empty result, and other
    columns are ignored.
    """
    keyed = _keyed(docs, id_col, text_col).select("key", "text")
    classes = stored(document_classes(docs, id_col, text_col, k), "classes")
    possible = stored(possible_rows(keyed, _text_sets(k), threshold), "possible")
    # one row of each class that is possible
    chosen = classes.join(possible.withColumnRenamed("key", "head"), "head", "left_semi").groupBy("digest").agg(F.min("key").alias("key"))
    chosen = stored(chosen.select("key"), "chosen")
    texts = keyed.join(bounded(chosen), "key", "left_semi")  # texts are not shuffled while the keys are few
    # equal sets have equal tokens: any of the rows stands for the class; its number is fixed as it is written
    made = texts.mapInArrow(giving_back(lambda b: _as_sets(b, k)), _SETS).where("n > 0").dropDuplicates(["digest"])
    sets = stored(made.withColumn("key", F.monotonically_increasing_id() + 1), "sets")
    discard(possible, chosen)

    leader = stored(contracted(sets, threshold), "leaders")
    for seed in (1, 2):
        heads = sets.join(leader.where("key = leader").select("key"), "key", "left_semi")
        step = contracted(_least_tokens(heads, seed), threshold).select(F.col("key").alias("leader"), F.col("leader").alias("next"))
        last, leader = leader, stored(leader.join(step, "leader").select("key", F.col("next").alias("leader")), "leaders")
        discard(last)

    grouped = stored(sets.join(leader.withColumnRenamed("leader", "group"), "key").select("key", "group", "n", "tokens"), "grouped")
    label = stored(sets.select("digest", "key"), "names")
    discard(sets)
    open_keys = stored(possible_rows(grouped, _stored_sets, threshold), "open")
    joined = joined_groups(grouped.join(open_keys, "key", "left_semi"), threshold, UNIT_TOKENS)
    discard(grouped, open_keys)
    label = label.join(leader, "key").join(joined.withColumnRenamed("group", "leader"), "leader", "left").select("digest", F.coalesce("label", "leader").alias("label"))

    # a hot class is added up before it is dealt out; one that is linked with no other has its own least id
    least = classes.where("n > 0").groupBy("digest").agg(F.min(F.when(F.col("known"), F.col("key"))).alias("least"))
    labelled = least.join(label, "digest")
    of_label = labelled.groupBy("label").agg(F.min("least").alias("joined_id"))
    by_label = labelled.join(of_label, "label").select("digest", "joined_id", F.lit(True).alias("found"))
    by_class = least.join(by_label, "digest", "left").select("digest", F.when(F.col("found"), F.col("joined_id")).otherwise(F.col("least")).alias("component_id"))
    by_class = stored(by_class, "components")  # so that Spark can split the rows of a hot class
    own = F.when(F.col("known"), F.col("key")).alias("doc_id")
    return classes.join(by_class, "digest", "left").select(own, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"))


def least_of_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of each component of ``docs``: of each group of near copies that with the least id.

    Rows are judged by themselves, whatever ids they share. A row with a null
    id is kept only if no row with an id is in its component; rows whose set is
    empty are all kept.
    """
    plain, known = numbered(docs)
    own = known[id_col]
    rows = stored(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = ngram_components(rows, id_col="row", text_col=known[text_col], **kw).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col(own).isNull(), F.col(own), F.col("row"))
    placed = stored(found.join(rows.select("row", own), "row").select("component_id", "row", order.alias("_order")), "placed")
    least = placed.groupBy("component_id").agg(F.min("_order").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    others = placed.join(least, "component_id").where(F.col("row") != F.col("_least.row")).select("row")
    return rows.join(bounded(stored(others, "others")), "row", "left_anti").drop("row").toDF(*docs.columns)
