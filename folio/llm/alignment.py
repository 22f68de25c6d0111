"""Alignment of two tokenizers' tokens by an event sweep.

Tokens of either side become end events: a token's end is an offset in the
bytes of the text. Events of both sides are united, dealt out by document and
sorted by offset within partitions; a machine reads them as a stream. Where
both sides end, what came since the last such place is a group; between any
two ends lies a link of the token of A and the token of B that reach over it.
A row holds events that follow each other, as ids from a first offset on, whose
ends are told by the tokens' widths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import giving_back, partitions, stored
from folio.llm.spans import by_row, runs_of
from folio.llm.vocabularies import Memory, Shared, encoded

#: Events of a row at most.
EVENTS = 1 << 16
#: Distinct links whose counts are broadcast at most, some 20 MB; more are joined.
MAX_PAIRS = 1_000_000
_PLACE = "key long, doc_id long, copies long, side byte, first long, ids binary"
_MADE = "key long, doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_ZSTD = pa.Codec("zstd", 1)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes if all fit, compressed; the first byte tells which."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    raw = ids.astype(np.uint16 if small else np.uint32).tobytes()
    return bytes([2 if small else 4]) + len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _wide(body: bytes) -> np.ndarray:
    size = int.from_bytes(body[1:9], "little")
    return np.frombuffer(_ZSTD.decompress(body[9:], size, asbytes=True) if size else b"", np.uint16 if body[0] == 2 else np.uint32).astype(np.int64)


def end_events(docs: DataFrame, shared: Shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, copies, side, first, ids) of all tokens of both sides: side 0 is A, 1 is B.

    Rows of one id and text in a batch are sent once, with their number. A
    document without tokens has one row of no ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.encoders()
        memory, widths = Memory(a, b), (a.widths, b.widths)
        for batch in batches:
            once = batch.append_column("n", pa.array(np.ones(batch.num_rows, np.int64)))
            keys = np.asarray(batch["key"], np.int64)
            distinct, at, copies = np.unique(keys, return_index=True, return_counts=True)
            if len(distinct) < len(keys):
                once = once.take(pa.array(at))
                keys = distinct
            else:
                copies = np.ones(len(keys), np.int64)
            for first, sides, _ in encoded(once["text"], memory):
                n = len(sides[0][1]) - 1
                ids_of = once["id"].slice(first, n).to_pylist()
                out = []
                for side, (ids, bounds) in enumerate(sides):
                    offsets = np.concatenate([[0], np.cumsum(widths[side][ids])])
                    for i in range(n):
                        lo, hi = int(bounds[i]), int(bounds[i + 1])
                        if lo == hi and side:
                            continue
                        for at in range(lo, max(hi, lo + 1), EVENTS):
                            to = min(hi, at + EVENTS)
                            out.append((int(keys[first + i]), ids_of[i], int(copies[first + i]), side, int(offsets[at] - offsets[lo]), _narrow(ids[at:to])))
                names = ["key", "doc_id", "copies", "side", "first", "ids"]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return by_row(docs, id_col, text_col).mapInArrow(giving_back(run), _PLACE)


_TOP = 100_000
_DIGITS = np.zeros((_TOP, 6), np.uint8)
for _k in range(5):
    _n = np.arange(_TOP)
    _has = _n >= 10**_k if _k else np.ones(_TOP, bool)
    _DIGITS[_has, 4 - _k] = 48 + _n[_has] // 10**_k % 10


def _decimals(ids: np.ndarray, marks: np.ndarray) -> bytes:
    """The ids in decimals, each with its mark behind it."""
    if int(ids.max(initial=0)) >= _TOP:
        return b"".join(b"%d%c" % (i, m) for i, m in zip(ids.tolist(), marks.tolist(), strict=True))
    out = _DIGITS[ids]
    out[:, 5] = marks
    flat = out.ravel()
    return flat[flat != 0].tobytes()


@dataclass
class Stretch:
    """Groups that follow each other: links as tokens of A and B, and the groups' text."""

    n_groups: int
    link_a: np.ndarray
    link_b: np.ndarray
    text: bytes


def swept(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, start: int) -> tuple[Stretch | None, int, int]:
    """The whole groups of events that begin at ``start``, and how many tokens of A and B they hold."""
    reach = min(int(ends_a[-1]), int(ends_b[-1])) - start
    side = np.zeros(reach + 1, np.uint8)
    for mark, ends in ((1, ends_a), (2, ends_b)):
        side[ends[: np.searchsorted(ends, start + reach, "right")] - start] |= mark
    cuts = np.flatnonzero(side)
    kinds = side[cuts]
    shut = np.flatnonzero(kinds == 3)
    if not len(shut):
        return None, 0, 0
    kinds = kinds[: shut[-1] + 1]
    in_a, in_b, both = (kinds & 1).astype(np.int64), (kinds >> 1).astype(np.int64), kinds == 3
    at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    n_a, n_b = int(at_a[-1]) + 1, int(at_b[-1]) + 1
    group = np.cumsum(both) - both
    of_a, of_b = group[in_a > 0], group[in_b > 0]
    count_a, count_b = np.bincount(of_a), np.bincount(of_b)
    place_a = np.arange(n_a) + (np.cumsum(count_b) - count_b)[of_a]
    place_b = np.arange(n_b) + np.cumsum(count_a)[of_b]
    ids, marks = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
    ids[place_a], ids[place_b] = a[:n_a], b[:n_b]
    marks[place_a[np.cumsum(count_a) - 1]] = ord("|")
    marks[place_b[np.cumsum(count_b) - 1]] = ord(";")
    return Stretch(len(shut), a[at_a], b[at_b], _decimals(ids, marks)), n_a, n_b


@dataclass
class _Document:
    """What the machine knows of a document: pending events of either side, and sums."""

    place: tuple
    copies: int = 0
    at: int = 0
    next: list = field(default_factory=lambda: [0, 0])
    ids: list = field(default_factory=lambda: [np.zeros(0, np.int64)] * 2)
    ends: list = field(default_factory=lambda: [np.zeros(0, np.int64)] * 2)
    tokens: list = field(default_factory=lambda: [0, 0])
    groups: int = 0
    links: int = 0
    parts: int = 0


class Sweep:
    """The machine: takes rows of events in order, gives stretches of whole groups. It keeps events only since the last place where both sides end."""

    def __init__(self, widths: tuple[np.ndarray, np.ndarray]):
        self.widths, self.doc = widths, None

    def add(self, side: int, first: int, ids: np.ndarray, copies: int) -> Stretch | None:
        d = self.doc
        if side == 0 and first == 0:
            d.copies += copies
        if first < d.next[side] or not len(ids):  # events of a copy, or of none
            return None
        ends = first + np.cumsum(self.widths[side][ids])
        d.next[side] = int(ends[-1])
        d.ids[side], d.ends[side] = (np.concatenate(x) if len(x[0]) else x[1] for x in ((d.ids[side], ids), (d.ends[side], ends)))
        d.tokens[side] += len(ids)
        if not (len(d.ids[0]) and len(d.ids[1])):
            return None
        found, *n = swept(d.ids[0], d.ends[0], d.ids[1], d.ends[1], d.at)
        if found:
            d.at = int(d.ends[0][n[0] - 1])
            for s in range(2):
                d.ids[s], d.ends[s] = d.ids[s][n[s] :], d.ends[s][n[s] :]
            d.groups += found.n_groups
            d.links += len(found.link_a)
        return found

    def documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Document, Stretch | None]]:
        """(document, stretch) for every stretch, and at a document's end with None."""
        for batch in batches:
            for key, doc_id, copies, side, first, body in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "copies", "side", "first", "ids")), strict=True):
                if self.doc is None or self.doc.place != (key, doc_id):
                    if self.doc is not None:
                        yield self.doc, None
                    self.doc = _Document((key, doc_id))
                found = self.add(side, first, _wide(body), copies)
                if found:
                    yield self.doc, found
        if self.doc is not None:
            yield self.doc, None


def in_order(events: DataFrame) -> DataFrame:
    """Events dealt out by document and sorted by offset within."""
    return events.repartition(partitions(events.sparkSession), "key").sortWithinPartitions("key", "doc_id", "first", "side")


def _codes(link_a: np.ndarray, link_b: np.ndarray) -> np.ndarray:
    return (link_a.astype(np.uint64) << np.uint64(32)) | link_b.astype(np.uint64)


def aligned_documents(docs: DataFrame, shared: Shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct document: its numbers, the digest of its groups, and its distinct links with their times.

    A document's distinct links are kept until its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.encoders()
        digest, pairs, times, out, size = hashlib.sha256(), [], [], [], 0
        names = [x.split()[0] for x in _MADE.split(", ")]
        types = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary()]

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            if not pairs:
                return np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if len(pairs) == 1:
                return pairs[0], times[0]
            all_pairs, n = np.concatenate(pairs), np.concatenate(times)
            order = np.argsort(all_pairs, kind="stable")
            all_pairs, n = all_pairs[order], n[order]
            begins = runs_of(all_pairs)
            return all_pairs[begins], np.add.reduceat(n, begins)

        for doc, found in Sweep((a.widths, b.widths)).documents(batches):
            if found:
                # a group's mark goes before the next one, so that none is behind the last
                digest.update((b";" if doc.parts else b"") + found.text[:-1])
                doc.parts += 1
                distinct, n = np.unique(_codes(found.link_a, found.link_b), return_counts=True)
                pairs.append(distinct)
                times.append(n)
                if len(pairs) > 16:
                    pairs[:], times[:] = ([x] for x in merged())
                continue
            links, n = merged()
            bodies = _narrow(np.concatenate([links >> np.uint64(32), links & np.uint64(0xFFFFFFFF)])), _narrow(n)
            out.append((*doc.place, doc.copies, *doc.tokens, doc.groups, doc.links, digest.hexdigest() if doc.parts else "", *bodies))
            size += sum(map(len, bodies))
            digest, pairs, times = hashlib.sha256(), [], []
            if size > 4 << 20:
                yield batch_of()
                out, size = [], 0
        if out:
            yield batch_of()

    return in_order(end_events(docs, shared, id_col, text_col)).mapInArrow(giving_back(run), _MADE)


def token_groups(docs: DataFrame, shared: Shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copies, part, groups, link_a, link_b): the groups of each distinct document as text, and its links, stretch by stretch.

    The texts of a document's stretches, joined by ``;``, are its groups; the
    i-th elements of ``link_a`` and ``link_b`` are two tokens that overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.encoders()
        for doc, found in Sweep((a.widths, b.widths)).documents(batches):
            if found:
                row = [[doc.place[1]], [doc.copies], [doc.parts], [found.text[:-1].decode()], [found.link_a], [found.link_b]]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["doc_id", "copies", "part", "groups", "link_a", "link_b"])
                doc.parts += 1

    return in_order(end_events(docs, shared, id_col, text_col)).mapInArrow(giving_back(run), "doc_id long, copies long, part int, groups string, link_a array<int>, link_b array<int>")


def _links(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for body, times in zip(batch["pairs"].to_pylist(), batch["times"].to_pylist(), strict=True):
        both = _wide(body)
        yield _codes(both[: len(both) // 2], both[len(both) // 2 :]), _wide(times)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, documents, best): how many documents hold each link, and whether no link of its token of A is held by more.

    Counts are added up in every task before they are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            distinct, at = np.unique(np.concatenate(held), return_inverse=True)
            return distinct, np.bincount(at, weights=np.concatenate(n), minlength=len(distinct)).astype(np.int64)

        for batch in batches:
            for copies, (pairs, _) in zip(batch["copies"].to_pylist(), _links(batch), strict=True):
                held.append(pairs)
                n.append(np.full(len(pairs), copies))
                size += len(pairs)
                if size > MAX_PAIRS:
                    pairs, count = total()
                    if len(pairs) > MAX_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(count)], names=["pair", "documents"])
                        pairs, count = pairs[:0], count[:0]
                    held, n, size = [pairs], [count], len(pairs)
        if size:
            pairs, count = total()
            yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(count)], names=["pair", "documents"])

    counts = made.select("copies", "pairs", "times").mapInArrow(giving_back(run), "pair long, documents long").groupBy("pair").agg(F.sum("documents").alias("documents"))
    counts = stored(counts, "pairs")
    of_a = F.shiftrightunsigned("pair", 32).alias("a")
    most = counts.groupBy(of_a).agg(F.max("documents").alias("most"))
    return counts.select("*", of_a).join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


_NUMBERS = ["key", "doc_id", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _with_counts(made: DataFrame, counts: DataFrame, max_pairs: int) -> DataFrame:
    """``made`` with n_best and count_sum."""
    if counts.count() <= max_pairs:
        found = counts.orderBy("pair").toPandas()
        shared = made.sparkSession.sparkContext.broadcast((found["pair"].to_numpy(np.int64), found["documents"].to_numpy(np.int64), found["best"].to_numpy(bool)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, documents, best = shared.value
            for batch in batches:
                sums = []
                for links, times in _links(batch):
                    at = np.searchsorted(pair, links.view(np.int64))
                    sums.append((int(times[best[at]].sum()), int((times * documents[at]).sum())))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in _NUMBERS), *(pa.array(x, pa.int64()) for x in zip(*sums, strict=True))], names=[*_NUMBERS, "n_best", "count_sum"])

        return made.mapInArrow(giving_back(run), ", ".join(_MADE.split(", ")[:-2]) + ", n_best long, count_sum long")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_links(batch))
            size = np.array([len(x) for x, _ in rows], np.int64)
            of = pa.array(np.repeat(np.arange(len(rows)), size))
            yield pa.RecordBatch.from_arrays([batch["key"].take(of), batch["doc_id"].take(of), pa.array(np.concatenate([x for x, _ in rows]).view(np.int64)), pa.array(np.concatenate([n for _, n in rows]))], names=["key", "doc_id", "pair", "times"])

    links = made.select("key", "doc_id", "pairs", "times").mapInArrow(giving_back(flat), "key long, doc_id long, pair long, times long").join(counts, "pair")
    sums = links.groupBy("key", "doc_id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    sums = sums.withColumnsRenamed({"key": "k", "doc_id": "d"})
    joined = made.select(*_NUMBERS).join(sums, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return joined.select(*_NUMBERS, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))


def alignments(docs: DataFrame, shared: Shared, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    Links are all pairs of a token of A and one of B whose bytes overlap.
    ``count_sum`` adds up, over a document's links, how many documents hold the
    link's pair of ids; ``n_best`` counts the links whose pair no other one of
    its id of A exceeds, ties included. Null and empty texts, and those whose
    joined tokens are other bytes than a space and the text, have no tokens:
    all numbers are 0 and the digest is empty. Each row is a document of its
    own, also a repeated one; a null id is returned as such. Ids are of an
    integer type, else a TypeError is raised. Very long texts are read whole;
    an empty table gives an empty result, and other columns, of whatever name,
    are ignored.
    """
    made = stored(aligned_documents(docs, shared, id_col, text_col), "aligned")
    counts = stored(pair_counts(made), "counts")
    whole = _with_counts(made, counts, max_pairs)
    # copies in two steps, so that no array is as long as very many copies
    some = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(10_000))).alias("_from"))
    rows = some.select("*", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + 9_999, F.col("copies") - 1))).alias("_copy"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
