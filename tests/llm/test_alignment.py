"""Token alignment against the vocabularies' own libraries and a plain walk over offsets."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from folio.llm import alignment
from folio.llm.alignment import alignments, token_groups
from folio.llm.queries import QUERIES, TOKENIZERS
from folio.llm.vocabularies import Shared, _byte_letters

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not Path(A).exists(), reason="no vocabularies")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(libraries, text):
    a, b = libraries
    letters = _byte_letters()
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    parts = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
    if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
        return [], [], [], []
    return ids[0], ids[1], [len(p) for p in parts[0]], [len(p) for p in parts[1]]


def brute(libraries, rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of every row, by a walk over two lists."""
    seen = []
    for doc, text in rows:
        a, b, wa, wb = plain_tokens(libraries, text or "")
        spans = [[], []]
        for side, widths in enumerate((wa, wb)):
            at = 0
            for w in widths:
                spans[side].append((at, at + w))
                at += w
        links, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while j and spans[1][j][0] > s:
                j -= 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                if spans[1][k][1] > s:
                    links.append((a[i], b[k]))
                k += 1
            j = max(0, k - 1)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for cut in cuts:
            left, right = [], []
            while i < len(a) and spans[0][i][1] <= cut:
                left.append(a[i])
                i += 1
            while j < len(b) and spans[1][j][1] <= cut:
                right.append(b[j])
                j += 1
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
        seen.append((doc, len(a), len(b), groups, links))
    count = Counter(p for *_, links in seen for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [
        (doc, na, nb, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, na, nb, groups, links in seen
    ]


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "a \n\n  b c", "don't I'LL we've", "x  y  z", "x   y", "x　 y", "  a", "über straße naïve", "日本語 の テキスト です", "emoji 👩‍👩‍👧 ok 🎉🎉",
    "<|endoftext|> and <s> </s> <unk> <0x0A>", "under▁score", "▁", "tab\tand\r\nlines", "Ωmega αβγ", "x" * 3000, "ab " * 2000, " " * 500 + "z", "\x00null \x1f", "é" * 400, "á combining", "１２３ full", "١٢٣ ab", "﻿bom", "no​width", "12345678901234567890", "!!!???...---===",
]


def rows_of(found):
    return Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in found.collect())


def test_alignment_equals_a_plain_walk(spark, libraries):
    rows = list(enumerate(ODD)) + [(None, "no id here"), (-(1 << 63), "least id"), ((1 << 63) - 1, "greatest id"), (5, "a "), (7, "repeated row"), (7, "repeated row"), (7, "same id, other text")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(alignments(docs, Shared(spark, A, B))) == Counter(brute(libraries, rows))


def test_counts_joined_and_small_blocks(spark, libraries, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "the same text in many rows " * 3) for i in range(40)] + [(1, "a")] * 5
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(alignment, "EVENTS", 7)
    shared, want = Shared(spark, A, B), Counter(brute(libraries, rows))
    assert rows_of(alignments(docs, shared, max_pairs=0)) == want
    assert rows_of(alignments(docs, shared)) == want


def test_query_over_the_table(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = Counter(brute(libraries, [(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert rows_of(QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001")) == want


def test_groups_and_links(spark, libraries):
    text = "Tokenizers disagree about unusual words: antidisestablishmentarianism, naïveté.\nTwice."
    found = token_groups(spark.createDataFrame([(1, text), (2, None)], SCHEMA), Shared(spark, A, B)).orderBy("doc_id", "part").collect()
    assert {r["doc_id"] for r in found} == {1}
    groups = ";".join(r["groups"] for r in found)
    assert hashlib.sha256(groups.encode()).hexdigest() == brute(libraries, [(1, text)])[0][-1]
    assert sum(len(r["link_a"]) for r in found) == brute(libraries, [(1, text)])[0][4]


def test_empty_table_other_columns_and_refused_ids(spark):
    shared = Shared(spark, A, B)
    assert alignments(spark.createDataFrame([], SCHEMA), shared).count() == 0
    odd = spark.createDataFrame([(1, "a b", 2, 3, 4)], "`doc_id` long, `text` string, `key` long, `ids.x` long, `copies` long")
    assert alignments(odd, shared).collect()[0]["n_a"] == 2
    with pytest.raises(TypeError, match="integer type"):
        alignments(spark.createDataFrame([("x", "a")], "doc_id string, text string"), shared)
