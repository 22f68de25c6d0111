"""Removal of passages that stand in an earlier document already, by difference-cover anchors.

Of each text only the runs of ``ANCHOR`` words that begin at positions of a
difference cover modulo ``PERIOD`` are hashed and exchanged. Whatever the
distance of two equal passages of ``WINDOW`` words, some position is of the
cover in both, so that they share an anchor at the same place within. Anchors
that several documents share are extended to the windows that hold them; these
alone are compared by hash, and of equal ones the document of the least id
keeps its words.

Two packed exchanges do this, each with an answer by document. What a slice of
documents can tell by itself (a run that two of its documents hold) goes no
further than one entry a slice, so that a passage that very many documents
share makes no long list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import BROADCAST_KEYS, discard, giving_back, partitions, stored
from folio.llm.spans import Runs, bodies, by_row, dealt, exchanged, hashed_words, packed, runs_of, unpacked
from folio.llm.words import mix, words

WINDOW = 13
#: A perfect difference cover: every difference modulo the period is one of two of its members.
PERIOD, COVER = 7, (0, 1, 3)
#: Entries that a slice of documents sends at once, which bounds a task's memory.
SLICE = 1 << 20
#: Kinds of bodies: entries to compare, and answers that only pass through.
_ENTRIES, _KNOWN = 0, 1


class _Slice:
    """Documents of a task, until they have ``SLICE`` entries: their runs, and by document key, id and whether it has one."""

    def __init__(self):
        self.docs, self.runs, self.size, self.seen = [], [], 0, set()

    def fresh(self, keys: np.ndarray) -> np.ndarray:
        """Which rows are the first with their key: others have the same text and id, and so the same answer."""
        out = np.zeros(len(keys), bool)
        for i, k in enumerate(keys.tolist()):
            if k not in self.seen:
                self.seen.add(k)
                out[i] = True
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, known: np.ndarray, doc: np.ndarray, *entries: np.ndarray) -> None:
        """``doc`` numbers the rows of ``keys`` for each entry."""
        base = sum(len(k) for k, _, _ in self.docs)
        self.docs.append((keys, ids, known))
        self.runs.append((doc.astype(np.int32) + np.int32(base), *entries))
        self.size += len(doc)

    def taken(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        docs, runs = ([np.concatenate(x) for x in zip(*held, strict=True)] for held in (self.docs, self.runs))
        self.__init__()
        return docs, runs


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    known = np.asarray(batch["id"].is_valid())
    return np.asarray(batch["key"], np.int64), np.asarray(batch["id"].fill_null(0), np.int64), known


def _ranks(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Documents' places in the order of their ids; those without an id share the last."""
    distinct, place = np.unique(ids[known], return_inverse=True)
    out = np.full(len(ids), len(distinct), np.int64)
    out[known] = place
    return out


def _answers(keys: np.ndarray, doc: np.ndarray, at: np.ndarray, buckets: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Positions ``at`` of documents, dealt by key: a body has keys, their numbers of positions and the positions."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    begins = runs_of(doc)
    whose, n = keys[doc[begins]], np.diff(np.concatenate([begins, [len(doc)]]))
    by, bounds = dealt((mix(whose.view(np.uint64).copy()) % np.uint64(buckets)).astype(np.int64), buckets)
    for b in range(buckets):
        mine = by[bounds[b] : bounds[b + 1]]
        if len(mine):
            size = n[mine]
            take = np.repeat(begins[mine] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            yield b, kind, packed(whose[mine], size.astype(np.int32), at[take].astype(np.uint32))


def _gathered(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """(key, positions ascending) of a bucket's answers."""
    found = [unpacked(x, np.int64, np.int32, np.uint32) for xs in bodies(batches).values() for x in xs]
    if not found:
        return
    keys, n, at = (np.concatenate(x) for x in zip(*found, strict=True))
    distinct, row = np.unique(keys, return_inverse=True)
    both = np.unique((np.repeat(row, n).astype(np.uint64) << np.uint64(32)) | at)  # so many rows stand in no bucket
    bounds = np.searchsorted(both >> np.uint64(32), np.arange(len(distinct) + 1, dtype=np.uint64))
    at = both.astype(np.uint32)
    for i in range(0, len(distinct), 10_000):
        j = min(len(distinct), i + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(distinct[i:j]), pa.array([at[a:b].tobytes() for a, b in zip(bounds[i:j], bounds[i + 1 : j + 1], strict=True)], pa.binary())], names=["key", name])


def _answered(entries: DataFrame, judge, buckets: int, name: str) -> DataFrame:
    """(key, positions) by what ``judge`` makes of each shard's entries, and of the answers that are known."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        got = bodies(batches)
        for body in got.get(_KNOWN, []):
            raw = unpacked(body, np.int64, np.int32, np.uint32)
            yield from _answers(raw[0], np.repeat(np.arange(len(raw[0])), raw[1]), raw[2], buckets, _KNOWN)
        if _ENTRIES in got:
            yield from _answers(*judge(got[_ENTRIES]), buckets, _KNOWN)

    return exchanged(entries, settle, buckets).mapInArrow(giving_back(lambda b: _gathered(b, name)), f"key long, {name} binary")


def shared_anchors(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, anchors) of the documents that share an anchor with another one: where their shared anchors begin.

    In a shard anchors are told apart by 32 bits: a few too many may be
    returned, which no window bears out; none is missed.
    """
    shards, length = partitions(rows.sparkSession), window - PERIOD + 1

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        held = _Slice()
        for batch in batches:
            keys, ids, known = _columns(batch)
            for w in hashed_words(batch["text"]):
                mine = slice(w.first, w.first + len(w.counts))
                fresh = held.fresh(keys[mine])
                begins = np.concatenate([[0], np.cumsum(w.counts)])
                doc = w.doc
                place = np.arange(len(doc)) - begins[doc]
                at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + length <= w.counts[doc]) & fresh[doc])
                held.add(keys[mine], ids[mine], known[mine], doc[at], place[at].astype(np.uint32), Runs(w).hashes(at, length))
                if held.size >= SLICE:
                    yield from flush(held)
        if held.size:
            yield from flush(held)

    def flush(held: _Slice) -> Iterator[tuple[int, int, bytes]]:
        (keys, _, _), (doc, at, run) = held.taken()
        order = np.argsort(run)
        run, doc, at = run[order], doc[order], at[order]
        begins = runs_of(run)
        several = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins)
        here = np.repeat(several, np.diff(np.concatenate([begins, [len(run)]])))
        # anchors that documents of this slice share are known to be shared: one of each goes on, for the other slices
        yield from _answers(keys, doc[here], at[here], shards, _KNOWN)
        goes = ~here
        goes[begins[several]] = True
        run, doc, at = run[goes], doc[goes], at[goes]
        order = np.lexsort((at, doc))
        run, doc, at = run[order], doc[order], at[order]
        by, bounds = dealt((run >> np.uint64(32)).astype(np.int64) % shards, shards)
        for s in range(shards):
            mine = by[bounds[s] : bounds[s + 1]]
            if len(mine):
                begins = runs_of(doc[mine])
                yield s, _ENTRIES, packed(keys[doc[mine][begins]], np.diff(np.concatenate([begins, [len(mine)]])).astype(np.int32), at[mine], run[mine].astype(np.uint32))

    def shared(entries: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, at, run = (np.concatenate(x) for x in zip(*(unpacked(e, np.int64, np.int32, np.uint32, np.uint32) for e in entries), strict=True))
        order = np.argsort(run, kind="stable")
        doc = np.repeat(np.arange(len(keys), dtype=np.int32), n)[order]
        begins = runs_of(run[order])
        several = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins)
        here = np.repeat(several, np.diff(np.concatenate([begins, [len(order)]])))
        return keys, doc[here], at[order][here]

    return _answered(exchanged(rows, posted, shards), shared, max(4, shards // 4), "anchors")


def repeated_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, windows) of the documents that repeat a window of a document with a smaller id: where those windows begin.

    ``rows`` are (key, id, text, anchors). Windows are told apart by 64 bits
    and by those that deal them to shards.
    """
    shards, length = partitions(rows.sparkSession), window - PERIOD + 1

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        held = _Slice()
        for batch in batches:
            keys, ids, known = _columns(batch)
            marks = batch["anchors"].to_pylist()
            for w in hashed_words(batch["text"]):
                mine = slice(w.first, w.first + len(w.counts))
                fresh = held.fresh(keys[mine])
                begins = np.concatenate([[0], np.cumsum(w.counts)])
                # extension: the windows that hold a shared anchor are those that begin up to a period before it
                reach = np.zeros(len(w.hashes) + 1, np.int32)
                for i in np.flatnonzero(fresh).tolist():
                    at = np.frombuffer(marks[w.first + i], np.uint32).astype(np.int64)
                    np.add.at(reach, begins[i] + np.maximum(at - (window - length), 0), 1)
                    np.add.at(reach, begins[i] + at + 1, -1)
                doc = w.doc
                place = np.arange(len(doc)) - begins[doc]
                at = np.flatnonzero((np.cumsum(reach)[:-1] > 0) & (place + window <= w.counts[doc]))
                runs = Runs(w)
                held.add(keys[mine], ids[mine], known[mine], doc[at], place[at].astype(np.uint32), runs.hashes(at, window), (runs.deal(at, window) % np.uint64(shards)).astype(np.int32))
                if held.size >= SLICE:
                    yield from flush(held)
        if held.size:
            yield from flush(held)

    def flush(held: _Slice) -> Iterator[tuple[int, int, bytes]]:
        (keys, ids, known), (doc, at, run, shard) = held.taken()
        order = np.argsort(run, kind="stable")
        run, doc, at, shard = run[order], doc[order], at[order], shard[order]
        rank = _ranks(ids, known)[doc]
        begins = runs_of(run)
        least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.concatenate([begins, [len(run)]])))
        later = rank > least
        # what a smaller id of this slice holds is settled here: only the least one's windows go on
        yield from _answers(keys, doc[later], at[later], shards, _KNOWN)
        run, doc, at, shard = run[~later], doc[~later], at[~later], shard[~later]
        order = np.lexsort((at, doc))
        run, doc, at, shard = run[order], doc[order], at[order], shard[order]
        by, bounds = dealt(shard.astype(np.int64), shards)
        for s in range(shards):
            mine = by[bounds[s] : bounds[s + 1]]
            if len(mine):
                begins = runs_of(doc[mine])
                who = doc[mine][begins]
                yield s, _ENTRIES, packed(keys[who], ids[who], known[who], np.diff(np.concatenate([begins, [len(mine)]])).astype(np.int32), at[mine], run[mine])

    def repeated(entries: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, ids, known, n, at, run = (np.concatenate(x) for x in zip(*(unpacked(e, np.int64, np.int64, np.bool_, np.int32, np.uint32, np.uint64) for e in entries), strict=True))
        order = np.argsort(run, kind="stable")
        doc = np.repeat(np.arange(len(keys), dtype=np.int32), n)[order]
        rank = _ranks(ids, known)[doc]
        begins = runs_of(run[order])
        least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.concatenate([begins, [len(order)]])))
        later = rank > least
        return keys, doc[later], at[order][later]

    return _answered(exchanged(rows, posted, shards), repeated, max(4, shards // 4), "windows")


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept) of rows of (id, text, windows), which may be null."""
    for batch in batches:
        marks = batch["windows"].to_pylist()
        for w in words(batch["text"], hashed=False):
            begins = np.concatenate([[0], np.cumsum(w.counts)])
            reach = np.zeros(len(w.starts) + 1, np.int32)
            for i, mark in enumerate(marks[w.first : w.first + len(w.counts)]):
                if mark:
                    at = begins[i] + np.frombuffer(mark, np.uint32).astype(np.int64)
                    reach[at] += 1  # positions are distinct
                    reach[at + window] -= 1
            stays = np.cumsum(reach)[:-1] == 0
            doc = w.doc
            left = np.bincount(doc[stays], minlength=len(w.counts))
            starts, size = w.starts[stays], (w.ends - w.starts)[stays] + 1
            # every word with a blank behind it, but for the last of a document
            ends = np.cumsum(size)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - size), size)
            text = np.concatenate([w.data, [np.uint8(32)]])[take]
            text[ends - 1] = 32
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(left)])]
            keep = np.ones(len(text), bool)
            keep[bounds[1:][left > 0] - 1] = False
            offsets = bounds - np.concatenate([[0], np.cumsum(left > 0)])
            kept = pa.Array.from_buffers(pa.large_string(), len(left), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text[keep])])
            yield pa.RecordBatch.from_arrays([batch["id"].slice(w.first, len(left)), pa.array(w.counts.astype(np.int64)), pa.array((w.counts - left).astype(np.int64)), kept.cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs``: its text's words without those of repeated passages.

    A word goes if a run of ``window`` words that covers it begins in a document
    of a smaller id too; runs are judged on the texts as given, and within one
    document nothing repeats. ``kept`` has the words that stay, with a space
    between. Null and empty texts have no words and an empty ``kept``. Ids are
    of an integer type, else a TypeError is raised; a null id is larger than
    any other, and rows of the same id, or without one, take nothing from each
    other. Repeated rows are returned as often as given, very long texts are
    read whole, an empty table gives an empty result, and other columns, of
    whatever name, are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    rows = by_row(docs, id_col, text_col)

    def joined(found: DataFrame) -> DataFrame:
        """Rows with what was found in them; texts are shuffled only as far as something was, while the keys are few."""
        few = found.select("key")
        part = rows.join(F.broadcast(few), "key", "left_semi") if found.count() <= BROADCAST_KEYS else rows
        return part.join(found, "key")

    anchors = stored(shared_anchors(rows, window), "anchors")
    found = stored(repeated_windows(joined(anchors).select("key", "id", "text", "anchors"), window), "windows")
    discard(anchors)
    if found.count() <= BROADCAST_KEYS:
        others = rows.join(F.broadcast(found.select("key")), "key", "left_anti").select("id", "text", F.lit(None).cast("binary").alias("windows"))
        whole = joined(found).select("id", "text", "windows").unionByName(others)
    else:
        whole = rows.join(found, "key", "left").select("id", "text", "windows")
    return whole.mapInArrow(giving_back(lambda b: _kept(b, window)), "doc_id long, n_words long, n_removed long, kept string")
