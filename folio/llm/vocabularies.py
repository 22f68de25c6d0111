"""Two kinds of public tokenizers as encoders of chunks, that give ids of whole texts in little time and memory.

A text is cut before spaces that follow a visible character: no token of either
kind reaches over such a place, and what stands on either side is encoded
without regard to the other. Chunks repeat, so each distinct one is encoded
once for a batch and remembered for the next ones.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from folio.llm.words import byte_blocks

#: Chunks that a task remembers at most; more only start the memory anew.
REMEMBERED = 200_000
#: How byte-level vocabularies part texts before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these, libraries may know other characters as letters, so that the vocabulary's own one is asked.
_COMMON = re.compile("[^\0-ɏ‐-‧]")


@dataclass
class Encoder:
    """``encode`` gives the ids of chunks, each of which begins with a space; ``tokens`` the bytes of each id, None for those that stand for none."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes | None]

    @functools.cached_property
    def widths(self) -> np.ndarray:
        return np.array([len(t) if t is not None else 0 for t in self.tokens], np.int64)


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes: themselves if visible, else those from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level(file: bytes) -> Encoder:
    """The encoder of a byte-level vocabulary in the JSON form of ``tokenizers``, without special tokens."""
    from tokenizers import Tokenizer

    spec = json.loads(file)
    letters = _byte_letters()
    vocabulary = spec["model"]["vocab"]
    tokens: list[bytes | None] = [None] * (max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    special = {t["content"] for t in spec["added_tokens"]}
    for token, i in vocabulary.items():
        if token not in special:
            tokens[i] = bytes(letters[c] for c in token)

    @functools.cache
    def own() -> Tokenizer:
        found = Tokenizer.from_str(file.decode())
        found.encode_special_tokens = True
        return found

    def slowly(chunks: list[str]) -> list[list[int]]:
        return [x.ids for x in own().encode_batch(chunks, add_special_tokens=False)]

    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    pre = spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
    if not plain or merged != sorted(merged):
        return Encoder(slowly, tokens)
    import tiktoken

    ranks = {t: i for i, t in enumerate(tokens) if t is not None}
    fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(chunks: list[str]) -> list[list[int]]:
        if _COMMON.search("".join(chunks)) is None:
            return [fast.encode_ordinary(c) for c in chunks]
        out = [fast.encode_ordinary(c) if _COMMON.search(c) is None else None for c in chunks]
        odd = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(odd, slowly([chunks[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        return out

    return Encoder(encode, tokens)


def pieces(file: bytes) -> Encoder:
    """The encoder of a sentencepiece model, which puts a space before each text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    tokens: list[bytes | None] = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        tokens.append(None if model.is_control(i) or model.is_unknown(i) else bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    if any(t and b" " in t.lstrip(b" ") for t in tokens):
        raise ValueError("a piece reaches over a space")
    blank = [model.piece_to_id("▁")]

    def encode(chunks: list[str]) -> list[list[int]]:
        found = model.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if len(c) > 1 else blank for c, ids in zip(chunks, found, strict=True)]

    return Encoder(encode, tokens)


class Shared:
    """The files of two vocabularies, read by the driver and broadcast (some MB); a task's worker makes their encoders once."""

    def __init__(self, spark: SparkSession, byte_level_file: str, pieces_file: str):
        with open(byte_level_file, "rb") as a, open(pieces_file, "rb") as b:
            self.files = spark.sparkContext.broadcast((a.read(), b.read()))

    def encoders(self) -> tuple[Encoder, Encoder]:
        return _made(*self.files.value)


@functools.lru_cache(maxsize=1)
def _made(a: bytes, b: bytes) -> tuple[Encoder, Encoder]:
    return byte_level(a), pieces(b)


def _chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks begin: at documents, and at spaces behind a visible ASCII character or one of U+00C0 to U+07FF."""
    before = np.concatenate([[0, 0], data])
    last, lead = before[1:-1], before[:-2]
    seen = ((last > 32) & (last < 127)) | ((last >= 0x80) & (last < 0xC0) & (lead >= 0xC3) & (lead < 0xE0))
    begin = (data == 32) & seen
    begin[bounds[:-1]] = True
    return np.flatnonzero(begin)


class Memory:
    """Chunks that were encoded, by number: their ids of both encoders, and whether joined tokens are the chunk's bytes."""

    def __init__(self, a: Encoder, b: Encoder):
        self.both = (a, b)
        self.texts = [(np.frombuffer(b"".join(t or b"" for t in e.tokens), np.uint8), np.cumsum(e.widths) - e.widths) for e in self.both]
        self._start()

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.right = np.zeros(0, bool)

    def of(self, chunks: pa.Array) -> np.ndarray:
        """The numbers of distinct chunks."""
        texts = chunks.to_pylist()
        found = np.array([self.known.get(c, -1) for c in texts], np.int64)
        fresh = np.flatnonzero(found < 0)
        if len(self.known) + len(fresh) > REMEMBERED:
            self._start()
            fresh = np.arange(len(texts))
        if len(fresh):
            found[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
            self._learn(chunks.take(pa.array(fresh)), [texts[i] for i in fresh.tolist()])
        return found

    def _learn(self, chunks: pa.Array, texts: list[str]) -> None:
        _, offsets, data = chunks.buffers()
        bounds = np.frombuffer(offsets, np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
        right = np.ones(len(texts), bool)
        for side, e in enumerate(self.both):
            lists = e.encode(texts)
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(size.sum()))
            widths, ends = e.widths[ids], np.cumsum(size)
            total = np.concatenate([[0], np.cumsum(widths)])
            same = total[ends] - total[ends - size] == np.diff(bounds)
            right &= same
            if same.all():  # byte by byte, which is all but the rarest texts
                text, at = self.texts[side]
                joined = text[np.arange(total[-1]) + np.repeat(at[ids] - total[:-1], widths)]
                right[np.searchsorted(bounds - bounds[0], np.flatnonzero(joined != raw), "right") - 1] = False
            else:
                for i in np.flatnonzero(same).tolist():
                    right[i] &= b"".join(e.tokens[t] or b"" for t in lists[i]) == texts[i].encode()
            self.ids[side] = np.concatenate([self.ids[side], ids])
            self.ends[side] = np.concatenate([self.ends[side], ends + self.ends[side][-1]])
        self.right = np.concatenate([self.right, right])
        for c in texts:
            self.known[c] = len(self.known)


def encoded(column: pa.Array, memory: Memory) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """(first document, (ids, bounds by document) of either encoder, whether a document has tokens), block by block.

    What is encoded is a space and the text. An empty text, and one whose
    joined tokens are other bytes, has no tokens.
    """
    for first, data, bounds in byte_blocks(column):
        n = len(bounds) - 1
        data = np.insert(data, bounds[:-1], 32)
        sizes, bounds = np.diff(bounds), bounds + np.arange(n + 1)
        starts = _chunk_starts(data, bounds)
        texts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = texts.dictionary_encode()
        which = np.asarray(coded.indices)
        which = memory.of(coded.dictionary)[which]
        doc = np.searchsorted(bounds, starts, "right") - 1
        has = (sizes > 0) & (np.bincount(doc[~memory.right[which]], minlength=n) == 0)
        which, doc = which[has[doc]], doc[has[doc]]
        sides = []
        for ids, stops in zip(memory.ids, memory.ends, strict=True):
            at, size = stops[which], stops[which + 1] - stops[which]
            ends = np.cumsum(size)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)
            per_doc = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
            sides.append((ids[take], np.concatenate([[0], np.cumsum(per_doc)])))
        yield first, sides, has
