"""A byte-level convolutional network for document quality, in numpy.

A document is cut into overlapping chunks that cover all its bytes. Learned
filters slide over each chunk, their responses are max-pooled, and the chunks'
pooled responses are averaged over the document by their bytes and combined
into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folio.llm.runtime import giving_back, numbered, small_batches
from folio.llm.words import byte_blocks, texts_of

CHUNK = 256
OVERLAP = 32
WIDTH = 8
STRIDE = 2
EMBED = 8
FILTERS = 32
#: The labelled rows that are learned from: so many at most, taken by a hash of the id, and of them as many as have
#: so many bytes of text together. Their texts are learned from whole.
MAX_ROWS = 1500
MAX_BYTES = 32 << 20
EPOCHS = 14
#: Share of the rows of a step that are cut short.
SHORTENED = 0.3
SEED = 11
FEATURE_BLOCK = 1 << 18


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        scale = 1 / np.sqrt(WIDTH * EMBED)
        return Network(rng.normal(0, 1, (256, EMBED)).astype(np.float32), rng.normal(0, scale, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)


def chunk_starts(length: int) -> np.ndarray:
    """Where the chunks of a text begin: one every CHUNK - OVERLAP bytes, until all bytes are covered."""
    return np.arange(max(1, -(-(length - OVERLAP) // (CHUNK - OVERLAP)))) * (CHUNK - OVERLAP)


def chunks_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x CHUNK bytes, document of each); what lies past a text's end is zero."""
    length = np.diff(bounds)
    count = np.maximum(1, -(-(length - OVERLAP) // (CHUNK - OVERLAP)))
    doc = np.repeat(np.arange(len(length)), count)
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * (CHUNK - OVERLAP)
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    chunks = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[bounds[doc] + begin]
    left = length[doc] - begin
    if len(left) and left.min() < CHUNK:
        chunks = np.where(np.arange(CHUNK) < left[:, None], chunks, 0)
    return chunks, doc


def _patches(chunks: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """chunks x positions x WIDTH * EMBED."""
    x = embed[chunks].reshape(len(chunks), -1)
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]


def pooled(net: Network, chunks: np.ndarray) -> np.ndarray:
    """chunks x FILTERS: the greatest response of each filter, zero at least."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    for a in range(0, len(chunks), 256):
        p = _patches(chunks[a : a + 256], net.embed)
        r = p.reshape(-1, WIDTH * EMBED) @ net.filters
        out[a : a + 256] = r.reshape(p.shape[0], p.shape[1], FILTERS).max(axis=1)
    return np.maximum(out + net.bias, 0)


def _weights(chunks: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Each chunk's part of its document's bytes; those of a document add up to 1."""
    size = np.maximum((chunks != 0).sum(axis=1), 1).astype(np.float32)
    return size / np.bincount(doc, weights=size, minlength=n)[doc].astype(np.float32)


def _mean_of(values: np.ndarray, part: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.add.reduceat(values * part[:, None], np.searchsorted(doc, np.arange(n)), axis=0)


def scores(net: Network, column: pa.Array) -> np.ndarray:
    """The probability of good quality of every text; a null one counts as empty."""
    parts = []
    for _, data, bounds in byte_blocks(column, FEATURE_BLOCK):
        chunks, doc = chunks_of(data, bounds)
        logit = _mean_of(pooled(net, chunks), _weights(chunks, doc, len(bounds) - 1), doc, len(bounds) - 1) @ net.out + net.shift
        parts.append(1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))))
    return np.concatenate(parts) if parts else np.zeros(0)


def _shortened(chunks: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One chunk, cut short: so that few bytes are not taken for bad ones."""
    one = chunks[rng.integers(len(chunks))].copy()
    one[int(rng.integers(12, CHUNK)) :] = 0
    return one[None]


class _Step:
    """One batch of documents: responses of all their chunks, and the gradient by the chosen patches only.

    Patches are made for ``BLOCK`` chunks at a time, so that memory does not
    grow with a text's length but by 64 numbers for each of its chunks.
    """

    BLOCK = 256

    def __init__(self, params: dict[str, np.ndarray], chunks: np.ndarray) -> None:
        self.params, self.chunks = params, chunks
        m = len(chunks)
        self.best, self.top = np.empty((m, FILTERS), np.int64), np.empty((m, FILTERS), np.float32)
        for a in range(0, m, self.BLOCK):
            p = _patches(chunks[a : a + self.BLOCK], params["embed"])
            response = (p.reshape(-1, WIDTH * EMBED) @ params["filters"]).reshape(p.shape[0], p.shape[1], FILTERS)
            self.best[a : a + self.BLOCK] = best = response.argmax(axis=1)
            self.top[a : a + self.BLOCK] = np.take_along_axis(response, best[:, None], 1)[:, 0]
        self.top += params["bias"]
        self.pooled = np.maximum(self.top, 0)

    def gradient(self, back: np.ndarray) -> dict[str, np.ndarray]:
        """Of bias, filters and embedding, from that of the pooled responses."""
        back = back * (self.top > 0)
        filters, embed = np.zeros_like(self.params["filters"]), np.zeros((256, EMBED), np.float64)
        for a in range(0, len(back), self.BLOCK):
            part, b = self.chunks[a : a + self.BLOCK], back[a : a + self.BLOCK]
            where = self.best[a : a + self.BLOCK, :, None] * STRIDE + np.arange(WIDTH)
            codes = np.take_along_axis(part, where.reshape(len(part), -1), 1)
            chosen = self.params["embed"][codes].reshape(len(part), FILTERS, WIDTH * EMBED)
            filters += np.einsum("mfk,mf->kf", chosen, b)
            to_patch = (b[:, :, None] * self.params["filters"].T[None]).reshape(-1, EMBED)
            embed += np.stack([np.bincount(codes.ravel(), weights=to_patch[:, j], minlength=256) for j in range(EMBED)], 1)
        return {"bias": back.sum(0), "filters": filters, "embed": embed.astype(np.float32)}


def train(texts: list[str], labels: list[int], seed: int = SEED, epochs: int = EPOCHS) -> Network:
    """Learns a network by Adam on the balanced logistic loss; the same rows in the same order give the same network.

    Every chunk of every text is learned from in each epoch, but for the share
    of the rows of a step that are cut short.
    """
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.shift = 0.0 if not len(y) else float(4 * y[0] - 2)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    sets = []
    for _, data, bounds in byte_blocks(texts_of(pa.array(texts, pa.string()))):
        chunks, doc = chunks_of(data, bounds)
        at = np.searchsorted(doc, np.arange(len(bounds)))
        sets += [chunks[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    params = {k: getattr(net, k) for k in ("embed", "filters", "bias", "out")} | {"shift": np.zeros(1, np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(sets))
        for a in range(0, len(order), 32):
            rows = order[a : a + 32]
            used = [_shortened(sets[i], rng) if rng.random() < SHORTENED else sets[i] for i in rows]
            chunks = np.concatenate(used)
            doc = np.repeat(np.arange(len(rows)), [len(x) for x in used])
            part = _weights(chunks, doc, len(rows))
            seen = _Step(params, chunks)
            feature = _mean_of(seen.pooled, part, doc, len(rows))
            logit = feature @ params["out"] + params["shift"]
            error = ((1 / (1 + np.exp(-logit)) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grad = {"out": feature.T @ error + 1e-4 * params["out"], "shift": error.sum(keepdims=True)}
            grad |= seen.gradient((error[doc] * part)[:, None] * params["out"])
            step += 1
            for name, g in grad.items():
                m1, m2 = moments[name]
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                params[name] -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Network(params["embed"], params["filters"], params["bias"], params["out"], float(params["shift"][0]))


def fold(id_col: Column) -> Column:
    """The row's fold: crc32 of the id as text, modulo 3; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)), F.lit(0)).cast("int")


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """A network from the labelled rows outside fold 1, of which ``MAX_ROWS`` at most are taken.

    The sample is the labelled ids with the least hashes, one row for each, as
    far as their texts have ``MAX_BYTES`` together; only these are read.
    Labels that are null or not 0 or 1 are left out.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 1))
    order = F.xxhash64(F.lit(SEED), id_col)
    rows = known.groupBy(id_col).agg(F.max(label_col).alias("y")).orderBy(order, id_col).limit(MAX_ROWS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(id_col, text.alias("text")).where(F.octet_length("text") <= MAX_BYTES).join(F.broadcast(rows), id_col)
    sample = found.groupBy(id_col, "y").agg(F.min("text").alias("text")).orderBy(order, id_col).select("text", "y")
    texts, ys, total = [], [], 0
    for r in sample.toLocalIterator():  # a partition at a time, until the sample is full
        total += len(r["text"].encode())
        if total > MAX_BYTES:
            break
        texts.append(r["text"])
        ys.append(r["y"])
    return train(texts, ys)


def scored(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``: no row is shuffled, and every text is read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = scores(net, batch.column(batch.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "score"])

    docs = small_batches(docs).drop("score")
    plain, known = numbered(docs)
    text = known[text_col]
    return plain.mapInArrow(giving_back(run), StructType([*plain.schema.fields, StructField("score", DoubleType())])).toDF(*docs.columns, "score")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null texts score as empty ones, very long ones by all their chunks; null
    ids are returned as such, repeated rows as often as given; without labels
    of both kinds every row scores alike, and an empty table gives an empty
    result. Other columns are ignored.
    """
    net = learned(docs, labels, id_col, text_col)
    rows = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), net)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
