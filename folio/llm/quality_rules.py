"""Quality rules combined by weak supervision.

Each rule votes that a document is good or bad, or abstains. The rules'
accuracies are estimated without labels by expectation-maximisation over the
counts of vote patterns, and a document is kept by its posterior probability
instead of having to pass every rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import small_batches, stored
from folio.llm.words import Words, mix, prefix_sums, span_hashes, windows, words

BAD, ABSTAIN, GOOD = -1, 0, 1
MIN_WORDS = 50
MAX_REPEATED = 50  # hundredths of the words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_shouts", "n_symbol_words", "n_upper_words", "n_long_words")
#: Characters above which a word counts as long.
LONG_WORD = 20


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The rules by name, as columns of votes over the measures.

    Each kind of junk (symbols, repetition, shouting, words of odd length) has
    two rules or three that look at it in different ways: what several of them
    call bad together is how their accuracies are estimated.
    """
    length, long_words = _ratio("word_chars", "n_words"), _ratio("n_long_words", "n_words")
    symbols, symbol_chars, symbol_words = _ratio("n_symbols", "n_words"), _ratio("n_symbols", "word_chars"), _ratio("n_symbol_words", "n_words")
    repeated, lines = _ratio("n_repeat_words", "n_words"), _ratio("n_dup_lines", "n_lines")
    upper, shouts, upper_words = _ratio("n_upper", "n_letters"), _ratio("n_shouts", "n_words"), _ratio("n_upper_words", "n_words")
    n = F.col("n_words")
    # the number of different words grows about with the root of the length
    rich = F.coalesce(F.col("n_distinct") / F.sqrt(F.nullif(n.cast("double"), F.lit(0.0))), F.lit(0.0))
    return {
        "enough_words": _vote(n, n >= 2 * MIN_WORDS, n < MIN_WORDS),
        "word_length": _vote(length, length.between(3, 10), (length < 2) | (length > 15)),
        "few_long_words": _vote(long_words, long_words < 0.05, long_words > 0.2),
        "few_symbols": _vote(symbols, symbols < 0.05, symbols > 0.15),
        "few_symbol_chars": _vote(symbol_chars, symbol_chars < 0.01, symbol_chars > 0.03),
        "few_symbol_words": _vote(symbol_words, symbol_words < 0.05, symbol_words > 0.15),
        "distinct_lines": _vote(lines, lines < 0.35, (lines > 0.5) & (F.col("n_dup_lines") > 3)),
        "little_repeated": _vote(repeated, repeated < 0.3, repeated > 0.4),
        "rich_words": _vote(rich, rich > 3, rich < 1),
        "lower_case": _vote(upper, upper < 0.25, upper > 0.5),
        "few_upper_words": _vote(upper_words, upper_words < 0.15, upper_words > 0.4),
        "calm": _vote(shouts, shouts < 0.05, shouts > 0.2),
    }


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _per_span(flags: np.ndarray, w: Words) -> np.ndarray:
    """The number of flagged bytes of each word."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[w.ends] - total[w.starts]


def _again(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(per document: entries whose key an earlier one has, per entry: whether its key is there more than once)."""
    mixed = mix(keys ^ mix(doc.astype(np.uint64)))
    order = np.argsort(mixed, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = mixed[order][1:] == mixed[order][:-1]
    later = order[same]
    several = np.zeros(len(keys), bool)
    several[later] = True
    several[order[:-1][same[1:]]] = True
    return np.bincount(doc[later], minlength=n), several


def measures(column: pa.Array) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(first document, measures of each) of a string column, block by block."""
    for w in words(column):
        n, doc = len(w.counts), w.doc
        in_word = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(in_word, w.starts, 1)
        np.add.at(in_word, w.ends, -1)
        in_word = np.cumsum(in_word[:-1]).astype(bool)
        out = {"n_words": w.counts, "word_chars": _per_doc(in_word & ((w.data & 0xC0) != 0x80), w.bounds)}
        for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER)):
            out[name] = _per_doc(table[w.data], w.bounds)
        shout = np.zeros(len(w.data), bool)
        shout[w.ends - 1] = w.data[w.ends - 1] == 33 if len(w.ends) else False
        out["n_shouts"] = _per_doc(shout, w.bounds)
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
        # by word: long ones, those with a symbol, and those of capitals only, two at least
        flags = {"n_long_words": chars[w.ends] - chars[w.starts] > LONG_WORD, "n_symbol_words": _per_span(_SYMBOL[w.data], w) > 0}
        capitals = _per_span(_UPPER[w.data], w)
        flags["n_upper_words"] = (capitals > 1) & (capitals == _per_span(_LETTER[w.data], w))
        for name, flag in flags.items():
            out[name] = np.bincount(doc[flag], minlength=n)
        # lines: from after a break or a document's start to the next break or its end
        edge = np.zeros(len(w.data) + 1, bool)
        edge[np.flatnonzero(w.data == 10) + 1] = True
        edge[w.bounds[:-1]] = True
        edge[len(w.data) :] = False
        starts = np.flatnonzero(edge)
        ends = np.concatenate([starts[1:], [len(w.data)]]).astype(np.int64) if len(starts) else starts
        held = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
        has = held[ends] > held[starts]
        starts, ends = starts[has], ends[has]
        if len(starts):
            ends = ends - (w.data[ends - 1] == 10)
            of = np.searchsorted(w.bounds, starts, "right") - 1
            out["n_dup_lines"], _ = _again(span_hashes(prefix_sums(w.data), starts, ends), of, n)
            out["n_lines"] = np.bincount(of, minlength=n)
        else:
            out["n_dup_lines"] = out["n_lines"] = np.zeros(n, np.int64)
        at, keys = windows(w, 3)
        _, several = _again(keys, doc[at], n)
        covered = np.zeros(len(doc), bool)
        for j in range(3):
            covered[at[several] + j] = True
        out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
        again, _ = _again(w.hashes, doc, n)
        out["n_distinct"] = w.counts - again
        yield w.first, out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measures) of every row; a null text measures as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [m for _, m in measures(batch["text"])]
            if parts:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in MEASURES]], names=["doc_id", *MEASURES])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in MEASURES))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray]:
    """(log odds of good, weights[rule, vote + 1]) by expectation-maximisation.

    ``patterns`` are the distinct rows of votes, so that its size is bounded by
    3 to the number of rules, whatever the number of documents. The posterior
    log odds are the first plus the weights of a row's votes.
    """
    m = patterns.shape[1]
    posterior = np.where((patterns == BAD).any(axis=1), 0.2, 0.9)
    hot = np.stack([patterns == v for v in (BAD, ABSTAIN, GOOD)], axis=2).astype(float)
    odds, weights = 0.0, np.zeros((m, 3))
    for _ in range(rounds):
        good, bad = counts * posterior, counts * (1 - posterior)
        # one vote of each kind is added, and good is taken to be no rarer than one in a hundred
        share = [(np.einsum("p,prv->rv", c, hot) + 1) / (c.sum() + 3) for c in (good, bad)]
        weights = np.log(share[0]) - np.log(share[1])
        # a vote counts in its own direction only
        weights[:, 0], weights[:, 2] = np.minimum(weights[:, 0], 0), np.maximum(weights[:, 2], 0)
        rate = np.clip((good.sum() + 1) / (counts.sum() + 2), 0.01, 0.99)
        odds = float(np.log(rate) - np.log1p(-rate))
        fresh = 1 / (1 + np.exp(-np.clip(odds + np.einsum("rv,prv->p", weights, hot), -500, 500)))
        if np.abs(fresh - posterior).max(initial=0) < 1e-9:
            break
        posterior = fresh
    return odds, weights


def quality_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measures, votes, base_failed, posterior, kept) of every row.

    Null and empty texts have no words and so fail the base rules; very long
    ones are measured whole. A null id is returned as such, repeated rows as
    often as given; other columns are ignored. Equal rows get equal results,
    and an empty table an empty one.
    """
    rule = rules()
    held = stored(measured(docs, id_col, text_col).withColumns({f"vote_{k}": v for k, v in rule.items()}), "votes")
    votes = [f"vote_{k}" for k in rule]
    seen = held.groupBy(*votes).count().collect()  # 3 to the number of rules at most
    odds, weights = fit_votes(np.array([list(r)[:-1] for r in seen]).reshape(len(seen), len(votes)), np.array([r["count"] for r in seen], float))
    terms = [F.when(F.col(v) == BAD, float(w[0])).when(F.col(v) == GOOD, float(w[2])).otherwise(float(w[1])) for v, w in zip(votes, weights, strict=True)]
    posterior = 1 / (1 + F.exp(-reduce(Column.__add__, terms, F.lit(odds))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return held.withColumn("base_failed", failed).withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
