"""T-occurrence search over inverted lists.

``DivideSkip`` is the search itself, in one block. ``possible_rows`` is its
first step over a whole table: it keeps the rows that have the T tokens which
any partner would have to share, counted over all inverted lists of two groups
or more.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.runtime import giving_back, partitions
from folio.llm.words import mix

#: A row's similarity to a partner, in hundredths, from which they are linked.
THRESHOLD = 75
#: Weight of the binary probes in the choice of the number of long lists.
PROBE_WEIGHT = 0.01
#: Entries of a long list that are counted in the time of one binary probe.
PROBES = 20
#: How much larger the largest size of a class of sizes is than its least.
SIZE_CLASS = 1.02


def least_overlap(n: int, threshold: int = THRESHOLD) -> int:
    """The overlap that a set of n tokens has with any set it is linked to."""
    return -(-threshold * n // 100)


def linked(overlap: int, n: int, m: int, threshold: int = THRESHOLD) -> bool:
    """Whether sets of n and m tokens with this overlap reach the Jaccard threshold."""
    return 100 * overlap >= threshold * (n + m - overlap)


def occurring(lists: list[list[int]], need: int, size: int, sizes: list[int], threshold: int = THRESHOLD) -> Iterator[int]:
    """DivideSkip: the ids of the sets that are linked with one of ``size`` tokens, given the lists of its tokens.

    The longest lists are set aside; the short ones are merged by a heap, and
    what occurs in enough of them is looked up in the long ones by binary
    search. Lists are ascending; what they miss of the tokens has no list.
    """
    if len(lists) < need or not need:
        return
    lists.sort(key=len)
    n_long = min(need - 1, int(need / (PROBE_WEIGHT * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    last, count = -1, 0
    for at in chain(merge(*short), (-1,)):
        if at == last:
            count += 1
            continue
        if count >= need - n_long and 100 * sizes[last] >= threshold * need and linked(_probed(last, count, need, long), size, sizes[last], threshold):
            yield last
        last, count = at, 1


def _probed(at: int, count: int, need: int, long: list[list[int]]) -> int:
    """The overlap with the long lists' part; negative once it can't reach the need."""
    for k, ids in enumerate(long):
        if count + len(long) - k < need:
            return -1
        i = bisect_left(ids, at)
        count += i < len(ids) and ids[i] == at
    return count


class DivideSkip:
    """Inverted lists of sets, searched by DivideSkip; they are ascending because ids are given in order."""

    def __init__(self, threshold: int = THRESHOLD) -> None:
        self.threshold = threshold
        self.lists: dict[int, list[int]] = {}
        self.sizes: list[int] = []
        self.postings = 0

    def add(self, tokens: list[int]) -> int:
        """Indexes a set and returns its id."""
        at = len(self.sizes)
        for t in tokens:
            self.lists.setdefault(t, []).append(at)
        self.sizes.append(len(tokens))
        self.postings += len(tokens)
        return at

    def search(self, tokens: list[int]) -> list[int]:
        """The ids of the indexed sets that are linked with this one."""
        lists = [x for x in map(self.lists.get, tokens) if x is not None]
        return list(occurring(lists, least_overlap(len(tokens), self.threshold), len(tokens), self.sizes, self.threshold))


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n numbers from each begin on, one range after the other."""
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


class _Clusters:
    """Inverted lists of sets that are numbered in order of size, as arrays; sets know their cluster, and joined clusters are one."""

    def __init__(self, n_clusters: int, sizes: np.ndarray, owner: np.ndarray, names: np.ndarray, threshold: int) -> None:
        self.of = np.arange(n_clusters)
        self.cluster = np.zeros(len(sizes), np.int64)
        self.sizes, self.threshold = sizes, threshold
        order = np.argsort(names * len(sizes) + owner)
        self.ids, self.codes = owner[order], (names * len(sizes) + owner)[order]
        # a list holds the sets that were added, up to its top; a search begins at those large enough for a link
        self.top = np.searchsorted(self.codes, np.arange(names.max(initial=-1) + 1) * len(sizes))
        self.first = np.searchsorted(sizes, -(-threshold * sizes // 100))
        self.begin = np.searchsorted(self.codes, names * len(sizes) + self.first[owner])
        self.names, self.bounds = names, np.searchsorted(owner, np.arange(len(sizes) + 1))

    def tokens(self, at: int) -> np.ndarray:
        return self.names[self.bounds[at] : self.bounds[at + 1]]

    def add(self, at: int, c: int, tokens: np.ndarray) -> None:
        """Puts the next set, of cluster c, at the end of its tokens' lists."""
        self.cluster[at] = c
        self.top[tokens] += 1

    def search(self, at: int, c: int) -> np.ndarray:
        """DivideSkip, on arrays: the clusters but for that of c that hold a set before ``at`` which is linked with it.

        The short lists are counted in one pass. What occurs in enough of them
        is looked up in the long ones, or these are counted too where so many
        sets are left that this reads less.
        """
        names, begin = self.tokens(at), self.begin[self.bounds[at] : self.bounds[at + 1]]
        length = self.top[names] - begin
        has = np.flatnonzero(length > 0)
        need, lo = least_overlap(int(self.sizes[at]), self.threshold), int(self.first[at])
        if len(has) < need:
            return has[:0]
        has = has[np.argsort(length[has], kind="stable")]
        n_long = min(need - 1, int(need / (PROBE_WEIGHT * math.log2(int(length[has[-1]]) + 1) + 1)))
        short, long = has[: len(has) - n_long], has[len(has) - n_long :]

        def counted(of: np.ndarray) -> np.ndarray:
            return np.bincount(self.ids[_ranges(begin[of], length[of])] - lo, minlength=at - lo)

        lacks = -(-self.threshold * (self.sizes[lo:at] + self.sizes[at]) // (100 + self.threshold)) - counted(short)
        left = np.flatnonzero((lacks <= n_long) & (self.of[self.cluster[lo:at]] != self.of[c]))
        if len(left) and n_long:
            if PROBES * len(left) * n_long < length[long].sum():
                probes = (names[long] * len(self.sizes))[:, None] + (left + lo)
                more = (self.codes[np.minimum(np.searchsorted(self.codes, probes), len(self.codes) - 1)] == probes).sum(0)
            else:
                more = counted(long)[left]
            left = left[lacks[left] <= more]
        return np.unique(self.of[self.cluster[left + lo]])

    def join(self, other: int, c: int) -> None:
        self.of[self.of == other] = self.of[c]


def partnered(cluster: np.ndarray, sizes: np.ndarray, owner: np.ndarray, names: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Which sets may be linked with one of another cluster; ``owner`` and ``names`` are of the tokens that may be shared.

    A set stays if some class of sizes has enough of its tokens in sets of other
    clusters for a link with the least size of the class. As that is T for the
    two sizes and not for the smallest partner, sets that are like others by
    0.6 to 0.75 mostly go. What goes is no partner either, so the rest is
    counted again while much goes.
    """
    starts = [1]
    while starts[-1] <= sizes.max(initial=0):
        starts.append(max(starts[-1] + 1, int(starts[-1] * SIZE_CLASS)))
    starts = np.array(starts)
    rank = np.searchsorted(starts, sizes, "right") - 1
    order = np.argsort(rank[owner], kind="stable")
    owner, names = owner[order], names[order]
    smallest = -(-threshold * sizes // 100)
    none = len(cluster) + int(cluster.max(initial=0))
    lo, hi = np.full(names.max(initial=-1) + 1, none), np.full(names.max(initial=-1) + 1, -1)
    stays = np.ones(len(sizes), bool)
    while True:
        bounds = np.searchsorted(rank[owner], np.arange(len(starts) + 1))
        found = np.zeros(len(sizes), bool)
        for k in np.unique(rank[owner]):
            mine, of = names[bounds[k] : bounds[k + 1]], cluster[owner[bounds[k] : bounds[k + 1]]]
            np.minimum.at(lo, mine, of)
            np.maximum.at(hi, mine, of)
            least, most = int(starts[k]), int(starts[k + 1]) - 1
            a, b = np.searchsorted(starts, [-(-threshold * least // 100), 100 * most // threshold], "right") - 1
            near = slice(bounds[a], bounds[min(b, len(starts) - 1) + 1])
            t, o = names[near], owner[near]
            other = (hi[t] >= 0) & ((lo[t] != hi[t]) | (lo[t] != cluster[o]))
            size = np.maximum(least, smallest)
            found |= (size <= np.minimum(most, 100 * sizes // threshold)) & ((100 + threshold) * np.bincount(o[other], minlength=len(sizes)) >= threshold * (sizes + size))
            lo[mine], hi[mine] = none, -1
        found &= stays
        before, left = stays.sum(), found.sum()
        stays = found
        if 8 * (before - left) <= before or not left:
            return stays
        still = stays[owner]
        owner, names = owner[still], names[still]


def joined_clusters(cluster: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The cluster (0 to n - 1) that each cluster belongs to once every link between sets has joined two of them.

    ``cluster`` and ``sizes`` are by set, ``tokens`` those of all sets in turn.
    DivideSkip searches the lists of the sets before each, in order of size.
    Only links between clusters that are still apart are looked for, by sets
    that are ``partnered``. Tokens of a single cluster take no part, and once
    one cluster is left, all is known.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(tokens, kind="stable")
    t, c = tokens[order], cluster[owner[order]]
    begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(c, begins) != np.maximum.reduceat(c, begins) if len(t) else np.zeros(0, bool)
    names = np.where(several, np.cumsum(several) - 1, -1)
    named = np.empty(len(t), np.int64)
    named[order] = np.repeat(names, np.diff(np.concatenate([begins, [len(t)]])))
    shared = named >= 0
    stays = partnered(cluster, sizes, owner[shared], named[shared], threshold)
    # short ones first; a set that lacks the tokens is linked with no other cluster
    ranked = np.flatnonzero(stays)
    ranked = ranked[np.argsort(sizes[ranked], kind="stable")]
    entries = _ranges((np.cumsum(sizes) - sizes)[ranked], sizes[ranked])
    names, mine = named[entries], np.repeat(np.arange(len(ranked)), sizes[ranked])
    held = _Clusters(int(cluster.max(initial=-1)) + 1, sizes[ranked], mine[names >= 0], names[names >= 0], threshold)
    alive = len(np.unique(cluster[ranked]))
    for at, own in enumerate(cluster[ranked].tolist()):
        if alive < 2:
            break
        for other in held.search(at, own).tolist():
            held.join(other, own)
            alive -= 1
        held.add(at, own, held.tokens(at))
    return held.of


# One exchange for each step; a row holds many postings as packed arrays.
_POSTED = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
_COUNTED = pa.schema([("bucket", pa.int32()), ("body", pa.binary())])
_POST_DDL, _COUNT_DDL = "shard int, bucket int, body binary", "bucket int, body binary"
_NOBODY = np.uint64(0)

Sets = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _split(parts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds) that bring the entries of each part together."""
    order = np.argsort(parts.astype(np.uint16) if n <= 1 << 16 else parts, kind="stable")  # of 16 bits numpy's is a radix sort
    return order, np.concatenate([[0], np.cumsum(np.bincount(parts, minlength=n))])


def _post(sets: Sets, shards: int, buckets: int, threshold: int) -> Iterator[tuple[int, int, bytes]]:
    keys, groups, sizes, tokens = sets
    order = np.argsort(tokens)
    t, o = tokens[order], np.repeat(np.arange(len(keys), dtype=np.int32), sizes)[order]
    del order
    g = groups[o]
    begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([begins, [len(t)]]))
    several = np.minimum.reduceat(g, begins) != np.maximum.reduceat(g, begins) if len(t) else np.zeros(0, bool)
    here = np.repeat(several, lengths)
    local = np.bincount(o[here], minlength=len(keys))
    # a token that groups share within this batch is counted here, and goes on once, for nobody
    t, o = np.concatenate([t[~here], t[begins[several]]]), np.concatenate([o[~here], np.full(several.sum(), len(keys), np.int32)])
    del g, here
    order, _ = _split(o, len(keys) + 1)
    t, o = t[order], o[order]
    keys_, groups_ = np.concatenate([keys, [0]]), np.concatenate([groups, [_NOBODY]])
    same = bool((keys.view(np.uint64) == groups).all())  # each row is a group: one number tells both
    by, bounds = _split((t >> np.uint64(40)).astype(np.int64) % shards, shards)
    for s in range(shards):
        mine = by[bounds[s] : bounds[s + 1]]
        if len(mine):
            row = o[mine]
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            who, n = row[at], np.diff(np.concatenate([at, [len(row)]]))
            own = b"" if same else groups_[who].tobytes()
            yield s, -1, b"".join((np.int64(-len(who) if same else len(who)).tobytes(), keys_[who].tobytes(), own, n.astype(np.int32).tobytes(), t[mine].astype(np.uint32).tobytes()))
    by, bounds = _split((mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets)
    lacks = -(-threshold * sizes // 100) - local
    for b in range(buckets):
        mine = by[bounds[b] : bounds[b + 1]]
        if len(mine):
            yield b % shards, b, b"".join((keys[mine].tobytes(), (-lacks[mine]).astype(np.int32).tobytes(), np.ones(len(mine), np.int8).tobytes()))


def _count(table: pa.Table, buckets: int) -> Iterator[tuple[int, bytes]]:
    parts = []
    for bucket, body in zip(table["bucket"].to_pylist(), table["body"], strict=True):
        raw = body.as_buffer()
        if bucket >= 0:
            yield bucket, raw.to_pybytes()
            continue
        m = int(np.frombuffer(raw, np.int64, 1)[0])
        at, m = (8 + 8 * m, m) if m > 0 else (8, -m)
        keys, groups, at = np.frombuffer(raw, np.int64, m, 8), np.frombuffer(raw, np.uint64, m, at), at + 8 * m
        parts.append((keys, groups, np.frombuffer(raw, np.int32, m, at), np.frombuffer(raw, np.uint32, -1, at + 4 * m)))
    if not parts:
        return
    keys, groups, n, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(tokens)
    t, o = tokens[order], np.repeat(np.arange(len(keys), dtype=np.int32), n)[order]
    del order, tokens
    begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    g = groups[o]
    several = np.minimum.reduceat(g, begins) != np.maximum.reduceat(g, begins)
    del g
    shared = np.flatnonzero(np.repeat(several, np.diff(np.concatenate([begins, [len(t)]]))))
    t, o = t[shared], o[shared]
    if len(np.unique(keys)) < len(keys):  # a row that several batches posted has each token once
        again = np.lexsort((o, keys[o], t))
        t, o = t[again], o[again]
        k = keys[o]
        # of one posting two tokens of the same 32 bits are two: the count can be too high, never too low
        o = o[np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (o[1:] == o[:-1])])] if len(o) else o
    count = np.bincount(o, minlength=len(keys))
    has = np.flatnonzero((count > 0) & (groups != _NOBODY))
    keys, count = keys[has], count[has]
    by, bounds = _split((mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), buckets)
    for b in range(buckets):
        mine = by[bounds[b] : bounds[b + 1]]
        if len(mine):
            yield b, b"".join((keys[mine].tobytes(), count[mine].astype(np.int32).tobytes(), np.zeros(len(mine), np.int8).tobytes()))


def _settle(table: pa.Table) -> pa.RecordBatch:
    parts = []
    for body in table["body"]:
        raw = body.as_buffer()
        m = raw.size // 13
        parts.append((np.frombuffer(raw, np.int64, m), np.frombuffer(raw, np.int32, m, 8 * m), np.frombuffer(raw, np.int8, m, 12 * m)))
    keys, count, own = (np.concatenate(x) for x in zip(*parts, strict=True))
    # of the same key's own entries (a set that several batches hold) the largest start counts: too many rows may pass, never too few
    uniq, at = np.unique(keys, return_inverse=True)
    start = np.full(len(uniq), np.iinfo(np.int64).min // 2)
    np.maximum.at(start, at[own == 1], count[own == 1])
    gain = np.bincount(at[own == 0], weights=count[own == 0], minlength=len(uniq)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(uniq[start + gain >= 0], pa.int64())], names=["key"])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[-1])
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def possible_rows(df: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Sets]], threshold: int = THRESHOLD) -> DataFrame:
    """The keys of the rows that may be linked with a row of another group.

    ``read`` gives (keys int64, groups uint64, set sizes, tokens uint64 in the
    rows' order) for a batch of ``df``. A row is kept if at least
    ``least_overlap`` of its tokens occur in another group too. In a shard
    tokens are told apart by 32 bits, so that a few rows too many may be kept;
    none is lost. A token that several groups of one batch share goes on once
    for that batch, so a very frequent token makes no long list.
    """
    p = partitions(df.sparkSession)
    shards, buckets = p, max(4, p // 4)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in read(batch):
                yield from _batches(_post(sets, shards, buckets, threshold), _POSTED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield from _batches(_count(pa.Table.from_batches(held), buckets), _COUNTED)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            yield _settle(pa.Table.from_batches(held))

    # placed by number, not by hash: a task has one shard, none has several
    posted = df.mapInArrow(giving_back(post), _POST_DDL).repartitionById(shards, "shard")
    counted = posted.mapInArrow(giving_back(count), _COUNT_DDL).repartitionById(buckets, "bucket")
    return counted.mapInArrow(giving_back(settle), "key long")
