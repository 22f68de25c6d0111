"""Names and ids of any kind in all operators; passages that repeat and ranked search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_pairs_and_native import brute_components

from folio.llm import byte_cnn, lexical_search, mixing, sharding, spans, substring_dedup, url_filters
from folio.llm.decontamination import decontaminated
from folio.llm.lexical_search import ranked_documents
from folio.llm.ngram_join import least_of_component, ngram_components
from folio.llm.pii import pii_spans
from folio.llm.quality_rules import quality_votes
from folio.llm.spans import Runs, hashed_words
from folio.llm.substring_dedup import COVER, PERIOD, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# names


ODD_NAMES = ["a.b", "_part", "_source", "_folio_row", "row", "c0", "key", "x`y", "n", "least", "size_", "_copy", "slot.k"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, prose(i, 60), "en", f"s{i % 3}", 1, *range(len(ODD_NAMES))) for i in range(6)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *ODD_NAMES])


def test_columns_of_any_name_are_returned_unchanged(spark, odd_docs):
    names, want = odd_docs.columns, Counter(map(tuple, odd_docs.collect()))
    items = spark.createDataFrame([(1, "no such words here at all in any document of these")], "item_id long, text string")
    net = byte_cnn.train(["good text"], [1])
    assert Counter(map(tuple, decontaminated(odd_docs, items).select(*[f"`{n.replace('`', '``')}`" for n in names]).collect())) == want
    assert least_of_component(odd_docs).columns == names and Counter(map(tuple, least_of_component(odd_docs).collect())) == want
    for made, more in ((sharding.with_shard(odd_docs, F.col("doc_id")), 2), (mixing.mix_sources(odd_docs), 4), (byte_cnn.scored(odd_docs, net), 1)):
        assert made.columns[: len(names)] == names and len(made.columns) == len(names) + more
        assert Counter(tuple(r)[: len(names)] for r in made.collect()) == want
    assert mixing.mixed(odd_docs).columns == names and set(map(tuple, mixing.mixed(odd_docs).collect())) <= set(want)
    pages = odd_docs.select("*", F.lit("http://a.net/").alias("url"), F.lit(None).cast("timestamp").alias("fetched_at"))
    entries = spark.createDataFrame([], url_filters.ENTRY_SCHEMA)
    assert url_filters.judged(pages, entries).columns[: len(pages.columns)] == pages.columns
    for made in (ngram_components(odd_docs), quality_votes(odd_docs), pii_spans(odd_docs), without_repeats(odd_docs), ranked_documents(odd_docs, items)):
        made.collect()


def test_components_of_the_least_and_greatest_ids(spark):
    text, other = prose(1, 50), prose(2, 50)
    rows = [(LEAST, text), (LEAST + 7, other), (-(1 << 62), text), (-(1 << 62) - 5, other), (MOST, text), (None, text), (0, other), (None, prose(3, 40)), (-1, None)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(d, n, c) for d, n, c in brute_components([r for r in rows if r[0] is not None])}
    assert got == want | {(None, 46, LEAST), (None, 36, None)}


def test_text_ids_are_refused(spark):
    docs = spark.createDataFrame([("x", "a b")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for run in (ngram_components, without_repeats, lambda d: ranked_documents(d, items)):
        with pytest.raises(TypeError, match="integer type"):
            run(docs)


# passages that repeat


def test_cover_meets_every_distance():
    for shift in range(PERIOD):
        assert any((c + shift) % PERIOD in COVER for c in COVER)


@given(st.lists(st.text(alphabet="aé\U0001f600 \nB", max_size=30) | st.sampled_from(["x" * 7, "x" * 8, "x" * 9, "y" * 64, "y" * 65, "z" * 200, None]), max_size=8))
@settings(max_examples=60, deadline=None)
def test_hashes_tell_words_and_runs(texts):
    words = [w for t in texts for w in WORD.findall(t or "")]
    got, runs, at = [], {}, 0
    for w in hashed_words(pa.array(texts, pa.string())):
        got += w.hashes.tolist()
        r = Runs(w)
        for i in range(len(w.hashes) - 2):
            runs[tuple(words[at + i : at + i + 3])] = (int(r.hashes(np.array([i]), 3)[0]), int(r.deal(np.array([i]), 3)[0]))
        at += len(w.hashes)
    assert len(got) == len(words) and len(set(got)) == len(set(words)) == len(set(zip(got, words, strict=True)))
    assert len(set(runs.values())) == len(runs)


def brute_kept(rows, window=13):
    least = {}
    split = [(doc, WORD.findall(text or "")) for doc, text in rows]
    place = lambda doc: (doc is None, doc or 0)
    for doc, w in split:
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            least[run] = min(least.get(run, (True, 1)), place(doc))
    out = []
    for doc, w in split:
        gone = {p for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < place(doc) for p in range(i, i + window)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def passages(seed=3):
    """Texts that share passages at every alignment, near and exact copies, hot passages, odd ids and texts."""
    rng = random.Random(seed)
    shared = [prose(100 + k, rng.choice((12, 13, 14, 20, 50))) for k in range(6)]
    hot = prose(99, 15)
    rows = []
    for i in range(120):
        parts = [prose(1000 + i, rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), prose(rng.random(), rng.randrange(0, 9))]
        parts += [hot] * (i % 3 == 0)
        rng.shuffle(parts)
        rows.append((i * 7 % 120, " \n".join(parts)))
    rows += [(None, rows[5][1]), (None, rows[5][1]), (None, hot), (LEAST, shared[0]), (MOST, shared[1]), (4, rows[8][1]), (4, rows[8][1]), (200, None), (201, ""), (202, " \n\t"), (203, "same " * 500), (204, "same " * 400), (205, "ünï " * 30)]
    return rows


def test_kept_words_equal_brute_force(spark, monkeypatch):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    take = lambda df: Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())
    assert take(without_repeats(docs)) == brute_kept(rows)
    monkeypatch.setattr(substring_dedup, "SLICE", 50)  # many slices, so that most is told by the shards
    assert take(without_repeats(docs)) == brute_kept(rows)
    monkeypatch.setattr(spans, "FAN", 2)  # by groups of parts, a few rows at a time
    monkeypatch.setattr(spans, "HELD", 500)
    assert take(without_repeats(docs)) == brute_kept(rows)
    monkeypatch.setattr(substring_dedup, "BROADCAST_KEYS", 1)
    assert take(without_repeats(docs, window=9)) == brute_kept(rows, 9)


def test_kept_words_of_a_very_long_text_and_of_nothing(spark):
    long = prose(5, 200_000, 1 << 30)
    rows = [(1, long), (2, "x " + long), (3, "y" * 2_000_000)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (200_000, 0), 2: (200_001, 200_000), 3: (1, 0)}
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ranked search


def brute_ranking(docs, items, top=20):
    fold = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(doc, fold(text)) for doc, text in docs]
    n_docs, n_words = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        wanted, found = Counter(fold(text)), []
        for doc, t in terms:
            tf = Counter(t)
            m = 75 + 25 * len(t) * n_docs // max(1, n_words)
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * m)) for x, r in wanted.items() if tf[x])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


def ranking(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_ranks_equal_brute_force(spark):
    rng = random.Random(4)
    docs = [(i * 1_000_003 % 997, prose(i, rng.randrange(1, 80), 60)) for i in range(400)]
    docs += [(None, "w1 w2"), (None, "w1 w2"), (LEAST, "W1, w2"), (MOST, "w1-w2"), (3, None), (4, ""), (5, "!!! ..."), (6, "Zürich ZÜRICH zürich w1"), (7, "w1 " * 50_000), (8, "same words"), (9, "same words"), (9, "same words")]
    items = [(i, prose(1000 + i, 12, 60)) for i in range(9)] + [(50, "w1 w1 w1 same"), (51, None), (52, ""), (53, "?!"), (54, "zürich"), (55, "unknown"), (50, "other text w2"), (56, "w3 w4"), (56, "w3 w4")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    want = brute_ranking(docs, sorted({(i, t) for i, t in items if t}))
    assert ranking(ranked_documents(frame, wanted)) == want
    # small windows, several passes
    assert ranking(ranked_documents(frame, wanted, window=8, block_terms=20)) == want
    assert ranking(ranked_documents(frame, wanted, top=3)) == Counter({k: n for k, n in want.items() if k[1] <= 3})


def test_ranks_of_nothing_and_of_named_items(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x.y", "B")], "`item.id` string, text string")
    assert ranked_documents(docs, items, item_col="item.id").collect()[0]["item_id"] == "x.y"
    assert ranked_documents(docs.limit(0), items, item_col="item.id").count() == ranked_documents(docs, items.limit(0), item_col="item.id").count() == 0


def test_occupied_cells_are_those_with_postings():
    rng = random.Random(7)
    rows = [(i, 10, np.array(sorted(rng.sample(range(5), k)), np.uint32).tobytes(), np.ones(k, np.uint32).tobytes()) for i, k in enumerate(rng.randrange(6) for _ in range(40))]
    window = lexical_search._Window(rows, np.arange(1, 6), 40, 400)
    scores, occupied = np.zeros(40, np.int64), np.zeros(5, np.uint8)
    window.add(2, 1, scores, occupied)
    window.add(4, 2, scores, occupied)
    has = defaultdict(int)
    for i, (_, _, terms, _) in enumerate(rows):
        if {2, 4} & set(np.frombuffer(terms, np.uint32).tolist()):
            has[i] = 1
    assert np.flatnonzero(np.unpackbits(occupied, bitorder="little")).tolist() == np.flatnonzero(scores).tolist() == sorted(has)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_every_query_of_single_rows(spark, tmp_path):
    """Tables of one row each, of the odd kinds, through every operator that reads documents or pages."""
    from folio.llm.queries import QUERIES

    source = "/root/testdata/sf0.001"
    for k, text in enumerate((None, "ab")):
        folder = tmp_path / str(k)
        docs = spark.createDataFrame([(5, text, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
        docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(5, None, text)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
        for t in ("benchmark", "labels"):
            spark.read.parquet(f"{source}/{t}.parquet").limit(3).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        for name, query in QUERIES.items():
            if name not in ("op9_license_scan", "op10_decontamination", "op13_lexical_search"):  # these return what they find
                assert query(spark, str(folder)).count() == 1, (name, text)
            else:
                query(spark, str(folder)).collect()
