"""The operators on single documents against brute force, round trips and held-out rows."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import byte_cnn, language_id, licenses, pii, quality_rules
from folio.llm.words import PUNCTUATION, shingle_sets, words

DATA = Path("/root/testdata/sf0.01")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet="ab é\n\t\x0b Zß#|", max_size=40)


@given(st.lists(st.none() | TEXT, max_size=8))
def test_words_are_those_of_the_pattern(texts):
    got = [bytes(w.data[a:b]).decode() for w in words(pa.array(texts, pa.string())) for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for t in texts for x in WORD.findall(t or "")]
    parts = [bytes(w.data[a:b]).decode() for w in words(pa.array(texts, pa.string()), space=PUNCTUATION) for a, b in zip(w.starts, w.ends, strict=True)]
    assert parts == [x for t in texts for x in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", t or "")]


@given(st.lists(TEXT, max_size=8))
def test_shingle_sets_tell_sequences_apart(texts):
    found = [(s, t) for _, s, t in shingle_sets(pa.array(texts, pa.string()), 2)]
    sizes, tokens = (np.concatenate([x[i] for x in found]) if found else np.zeros(0) for i in (0, 1))
    held = [frozenset(tokens[e - s : e].tolist()) for s, e in zip(sizes, np.cumsum(sizes), strict=True)]

    def brute(t):
        w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t)]
        return frozenset(tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))) if w else frozenset()

    want = list(map(brute, texts))
    assert [len(x) for x in held] == [len(x) for x in want]
    for i in range(len(want)):
        for j in range(i):
            assert (held[i] == held[j]) == (want[i] == want[j]) and len(held[i] & held[j]) == len(want[i] & want[j])


def brute_measures(text):
    w = WORD.findall(text)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200)
@given(st.lists(st.none() | st.text(alphabet="ab é\n#!", max_size=60), max_size=6))
def test_measures_equal_brute_force(texts):
    got = [tuple(int(m[c][i]) for c in quality_rules.MEASURES[:5]) for _, m in quality_rules.measures(pa.array(texts, pa.string())) for i in range(len(m["n_words"]))]
    assert got == [brute_measures(t or "") for t in texts]


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioust") for _ in range(rng.randrange(3, 8))) for _ in range(n)).capitalize() + "."


def test_votes_keep_clean_texts_and_drop_bad_ones(spark):
    rng = random.Random(4)
    clean = [(i, prose(rng, 120)) for i in range(200)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(rng, 120).split())) for i in range(20)] + [(2000 + i, " ".join(w.upper() + "!!" for w in prose(rng, 120).split())) for i in range(20)]
    odd = [(3000, None), (3001, ""), (None, prose(rng, 100)), (3002, "few words"), (3003, "same words here " * 60), (3004, prose(rng, 30_000))]
    rows = spark.createDataFrame([(*r, "z") for r in [*clean, *bad, *odd, clean[0]]], "doc_id long, text string, posterior string")
    got = quality_rules.quality_votes(rows).collect()
    kept = Counter(r["doc_id"] for r in got if r["kept"])
    assert len(got) == 247 and kept == Counter([*(i for i, _ in clean), 0, None, 3004])
    assert {r["doc_id"] for r in got if r["base_failed"]} == {3000, 3001, 3002, 3003}
    assert quality_rules.quality_votes(rows.limit(0)).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        luhn = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, text) if holds(k, m.group())] for k, p in PLAIN.items()}


@settings(max_examples=400)
@given(st.text(alphabet="a.@-1+ 25(", max_size=50))
def test_plain_spans_equal_the_patterns(text):
    assert pii.plain_spans(text) == brute_spans(text)


DISGUISED = {
    "john [at] example [dot] com": "email", "j.doe at mail dot example dot com": "email", "pаul@exаmple.com": "email", "john@exa​mple.com": "email", "a(at)b.com": "email",
    "10 dot 20 dot 3 dot 4": "ip", "plus one four one five five five five two six seven one": "phone", "+1 (four one five) 555 0199": "phone", "＋１ 202 555 0143": "phone",
    "four one one one one one one one one one one one one one one one": "card",
    "john at gmail.com": "email", "john @ gmail . com": "email", "john_at_gmail_dot_com": "email", "john&#64;gmail.com": "email", "john&commat;gmail&period;com": "email", "john&#x40;gmail&#46;com": "email",
    "j.doe at firm.co.uk": "email", "lee7 at firm.org": "email", "juan arroba correo punto es": "email", "luc [arobase] poste [point] fr": "email", "max [at] firma punkt de": "email", "ana@correo . es": "email",
    "four double one triple one one one one one one one double one one one": "card", "plus vier neun eins fünf zwo drei vier sechs sieben": "phone",
    "plus trois trois six un deux quatre huit cinq sept neuf zéro": "phone", "+34 seis uno dos tres cuatro cinco ocho nueve cero": "phone",
}


@pytest.mark.parametrize("text", DISGUISED)
def test_disguises_are_found_at_their_place(text):
    around = f"Say hello: {text} ; bye"
    base, every = pii.all_spans(around)
    kind = DISGUISED[text]
    assert not base[kind] and [around[a:b] for a, b in every[kind]] == [text]
    plain, hidden = (np.concatenate(x) for x in zip(*pii.cues(pa.array([around, "no such thing here", ""])), strict=True))
    assert hidden.tolist() == [True, False, False]
    assert pii.masked(around) == f"Say hello: [{kind}] ; bye"


@pytest.mark.parametrize("text", ["j\u043ehn.doe@example.com", "jo\u200bhn@example.com", "john dot doe@example.com", "john@mail.ex\u0430mple.com", "+49 151 2345 six seven eight"])
def test_disguises_around_a_plain_span_are_found_whole(text):
    around = f"Say hello: {text} ; bye"
    base, every = pii.all_spans(around)
    (kind,) = (k for k, v in base.items() if v)
    assert set(base[kind]) < set(every[kind]) and text in [around[a:b] for a, b in every[kind]]
    assert pii.masked(around) == f"Say hello: [{kind}] ; bye"


def disguises():
    """(kind, disguised identifier) of many ways to hide one."""
    rng = random.Random(5)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alike = {v: k for k, v in pii._LOOKALIKES.items() if v.isalpha()}
    words = {v: k for k, v in pii._NUMBER.items()} | {"+": "plus"}
    wide = lambda s: "".join(chr(0xFEE0 + ord(c)) if 0x21 <= ord(c) < 0x7F else c for c in s)
    spelled = lambda s, gap: gap.join(words[c] for c in s if c in words)
    for _ in range(40):
        mail = f"{pick('bdfgjklmnq', 4)}ao.lee@{pick('bdfg', 5)}.co.uk"
        card = next(c for c in iter(lambda: pick("0123456789", 16), "") if pii.luhn(c))
        phone = f"+{rng.randrange(1, 99)} {pick('0123456789', 9)}"
        address = ".".join(str(rng.randrange(256)) for _ in range(4))
        yield from (("email", x) for x in (mail.replace("a", alike["a"], 1), mail.replace("o", alike["o"], 2), wide(mail), f"{mail[:2]}\u200b{mail[2:]}"))
        yield from (("email", mail.replace("@", at).replace(".", dot)) for at, dot in ((" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" AT ", " DOT "), (" {at} ", ".")))
        yield from (("card", x) for x in (spelled(card, " "), spelled(card, ""), spelled(card, ", "), " ".join(words[c] if rng.random() < 0.5 else c for c in card[:-1]) + f" {words[card[-1]]}"))
        yield from (("phone", x) for x in (spelled(phone, " "), wide(phone)))
        yield from (("ip", x) for x in (address.replace(".", " dot "), "".join(chr(0x660 + int(c)) if c.isdigit() else c for c in address)))


def test_recall_of_disguised_identifiers():
    cases = list(disguises())
    for kind, hidden in cases:
        text = f"please write to {hidden}; or never mind"
        assert (16, 16 + len(hidden)) in pii.all_spans(text)[1][kind], text
    assert len(cases) == 40 * 17


@given(st.lists(st.lists(st.sampled_from(["plus ", "four", "nine", "6", "dot", "\u2026", "\u201d", " ", "-", "a", "(", "at", "@", ")", "\u0430", "\u017fix", "s\u0131x", "F\u0130ve", "\u2003", "\x1f", "\x85", "DOT", "<", "\u3000", "oh", "S", "double", "dos", "fünf", "\u0130", "_", "_at_", " . ", ".", "&#64;", "&commat;", " arroba ", "punto", " at ", "com", "\u212a"]), max_size=8).map("".join), max_size=5))
def test_cues_are_those_of_the_trigger(texts):
    texts += ["plus 66", "plus fourninesixoneeightthreetwo", "four9six1", "a\u201ddot\u2026b", "dot", "_dot_", "\u0301four6"]
    hidden = np.concatenate([h for _, h in pii.cues(pa.array(texts))])
    assert hidden.tolist() == [bool(pii._TRIGGER.search(t)) for t in texts] and hidden[-7:].all()
    assert all(pii._TRIGGER.search(t) or pii.rewrite(t).text == t for t in texts) and not pii._TRIGGER.search("this is written plainly")


def test_plain_prose_has_no_spans():
    for text in (
        "Look at example.com, or write to us at firm.com.", "Find me at gmail.com", "sale @ noon . It was", "I was at home.Then I left", "x_at_y = dot_at(3)", "Log in at outlook.com",
        "un dos tres, ein zwei drei; deux ou trois", "AT&amp;T &#8364; 5 &#64; once", "double one", "The point is at www.site.org", "see version 2 at site.com",
    ):
        assert not any(pii.all_spans(text)[1].values()), text
    for text in ("+1 (621) 555-4974 ein Haus", "+1 (848) 555-1373 Un an", "plus un 15 avril"):
        base, every = pii.all_spans(text)
        assert base == every
    for text in ("We met at noon, on the dot.", "one two three, go!", "version 1.2.3", "at [at] home", "café at work"):
        assert not any(pii.all_spans(text)[1].values())


@given(st.text(alphabet="aа @.​one1dt[]", max_size=40))
def test_rewriting_keeps_places(text):
    r = pii.rewrite(text)
    places = [r.source((i, i + 1)) for i in range(len(r.text))]
    assert all(a < b for a, b in places) and places == sorted(places)
    assert all(text[a:b] in (c, {"a": "\u0430", "1": "one"}.get(c)) or c in "@." for c, (a, b) in zip(r.text, places, strict=True))
    assert all(r.source((i, j)) == (places[i][0], places[j - 1][1]) for i in range(len(places)) for j in range(i + 1, len(places) + 1))


def test_disguised_identifiers_are_found_whole_however_long():
    text = "see " + "a" * 500 + " [at] exa.com, " + "b@" + "c" * 700 + " dot com" + " x" * 1000
    assert [text[a:b] for a, b in pii.all_spans(text)[1]["email"]] == ["a" * 500 + " [at] exa.com", "b@" + "c" * 700 + " dot com"]


def test_pii_table(spark):
    rows = [(1, "x a@b.co 1.2.3.4 \U0001f600 4111 1111 1111 1111 +1 (212) 555-0100"), (2, None), (3, ""), (None, "a@b.co"), (1, "x a@b.co"), (4, "z" * 200_000 + "@"), (5, "1." * 100_000)]
    got = pii.pii_spans(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")).collect()
    assert len(got) == 7 and got[0]["spans"] == "email:2:8,ip:9:16,card:19:38,phone:39:56" and (got[0]["n_email"], got[0]["n_card"], got[0]["n_added"]) == (1, 1, 0)
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert got[5]["spans"] == ""


def test_network_on_held_out_rows(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = byte_cnn.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got["predicted"] == got["quality"]).mean()) > 0.9 and got["score"].between(0, 1).all()


def brute_score(net, text):
    """The network byte by byte: filters over every second place of every chunk, greatest responses, mean by bytes."""
    data = (text or "").encode()
    chunks, at = [], 0
    while True:
        chunks.append(data[at : at + byte_cnn.CHUNK])
        if at + byte_cnn.CHUNK >= len(data):
            break
        at += byte_cnn.CHUNK - byte_cnn.OVERLAP
    total, size = np.zeros(byte_cnn.FILTERS), 0
    for chunk in chunks:
        padded = chunk + bytes(byte_cnn.CHUNK - len(chunk))
        best = np.zeros(byte_cnn.FILTERS)
        for p in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STRIDE):
            patch = np.concatenate([net.embed[b] for b in padded[p : p + byte_cnn.WIDTH]]).astype(float)
            best = np.maximum(best, patch @ net.filters + net.bias)
        weight = max(1, len(chunk.replace(b"\0", b"")))
        total, size = total + best * weight, size + weight
    return 1 / (1 + math.exp(-(total / size @ net.out + net.shift)))


def test_scores_equal_brute_force():
    rng = random.Random(2)
    good = [prose(rng, rng.randrange(5, 200)) for _ in range(40)]
    net = byte_cnn.train([*good, *("#$% " + x.upper() for x in good)], [1] * 40 + [0] * 40, epochs=3)
    texts = ["", None, "x", good[0], "#$% " + good[1].upper(), "é" * 400, "a" * 256, "b" * 257, "c" * 1000, "\0d" * 10]
    assert byte_cnn.scores(net, pa.array(texts, pa.string())) == pytest.approx([brute_score(net, t) for t in texts], rel=1e-4)


def test_gradient_of_the_network():
    """The slope by every kind of parameter equals what small steps show."""
    rng = np.random.default_rng(3)
    net = byte_cnn.Network.fresh(rng)
    params = {"embed": net.embed.astype(np.float64), "filters": net.filters.astype(np.float64), "bias": net.bias.astype(np.float64)}
    chunks, back = rng.integers(1, 256, (3, byte_cnn.CHUNK)).astype(np.uint8), rng.normal(size=(3, byte_cnn.FILTERS))
    loss = lambda: float((byte_cnn._Step(params, chunks).pooled.astype(np.float64) * back).sum())
    grad = byte_cnn._Step(params, chunks).gradient(back)
    code = int(chunks[0, 10])
    for name, at in (("bias", (4,)), ("filters", (5, 7)), ("embed", (code, 2))):
        params[name][at] += 1e-3
        up = loss()
        params[name][at] -= 2e-3
        slope = (up - loss()) / 2e-3
        params[name][at] += 1e-3
        assert slope == pytest.approx(grad[name][at], rel=0.05, abs=0.02)


def test_chunks_cover_every_byte():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 255, 256, 257, 480, 481, 5000]
    data = rng.integers(1, 255, sum(sizes)).astype(np.uint8)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    chunks, doc = byte_cnn.chunks_of(data, bounds)
    for d, n in enumerate(sizes):
        own, at = chunks[doc == d], byte_cnn.chunk_starts(n)
        assert len(own) == len(at)
        text = np.zeros(at[-1] + byte_cnn.CHUNK, np.uint8)
        for s, c in zip(at, own, strict=True):
            text[s : s + byte_cnn.CHUNK] = c
        assert (text[:n] == data[bounds[d] : bounds[d + 1]]).all() and not text[n:].any()


def test_scores_of_odd_rows(spark):
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(30)] + ["### " * 60] * 30
    net = byte_cnn.train(texts, [1] * 30 + [0] * 30, epochs=4)
    again = byte_cnn.train(texts, [1] * 30 + [0] * 30, epochs=4)
    column = pa.array([None, "", texts[0], texts[-1], texts[0] * 500])
    assert (byte_cnn.scores(net, column) == byte_cnn.scores(again, column)).all()
    s = byte_cnn.scores(net, column)
    assert s[0] == s[1] and s[2] > 0.5 > s[3] and abs(s[4] - s[2]) < 0.4
    docs = spark.createDataFrame([(None, None, 1.0), (1, "a", 2.0), (1, "a", 3.0)], "doc_id long, text string, score double")
    none = byte_cnn.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in none.collect()} == {0.5} and none.count() == 3
    assert byte_cnn.quality_scores(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_license_bands_and_containment(spark):
    assert licenses.hit_probability(0.6) > 0.99
    mit = licenses.TEMPLATES["mit-notice"]
    changed = mit.replace("merge", "mend").replace("sublicense", "relicense")
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    rng = random.Random(6)
    noise = lambda n: prose(rng, n)
    rows = [(1, f"{noise(90)} {mit.upper()} {noise(20)}"), (2, f"é {changed}"), (3, half), (4, noise(500)), (5, None), (6, ""), (None, "Released under the MIT License."), (7, f"{mit}\n{noise(9)}\n{mit}"), (7, "x"), (8, f"{noise(30_000)} {mit}")]
    got = licenses.license_matches(spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, license string")).collect()
    assert Counter((r["doc_id"], r["license"]) for r in got) == Counter([(1, "mit-notice"), (2, "mit-notice"), (None, "mit"), (7, "mit-notice"), (7, "mit-notice"), (8, "mit-notice")])
    text = dict(rows)
    for r in got:
        if r["doc_id"] in (1, 2):
            assert text[r["doc_id"]][r["start"] : r["end"]].lower().startswith("permission is hereby")


def test_license_hits_are_those_of_brute_force(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in licenses.license_matches(docs).collect()}

    def tokens(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    held = {k: tokens(v) for k, v in licenses.TEMPLATES.items()}
    # a superset: shingles anywhere in the text
    could = {(r["doc_id"], k) for r in docs.collect() for k, v in held.items() if len(v & tokens(r["text"])) >= 0.8 * len(v)}
    assert got <= could and len(got) >= 0.99 * len(could)


def test_licenses_of_short_and_no_documents(spark):
    notice = licenses.TEMPLATES["mit-notice"].split()
    rows = [(1, " ".join(notice[: int(len(notice) * 0.84)])), (2, "under CC BY-NC 4.0"), (3, " ".join(notice[:20])), (4, None), (5, ""), (1, "Released under the MIT License."), (6, "x " * 100_000 + "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, license string")
    got = sorted((r["doc_id"], r["license"]) for r in licenses.license_matches(docs).collect())
    assert got == [(1, "mit"), (1, "mit-notice"), (2, "cc-by-nc-4.0"), (6, "mit")]
    assert licenses.license_matches(docs.limit(0)).count() == 0


def brute_languages(rows, langs, smoothing):
    """The fusion from its meaning: rows of (id, host, declared, suffix, text log likelihoods)."""
    size = range(len(langs))
    shares = [[math.exp(x) / sum(map(math.exp, r[4])) for x in r[4]] for r in rows]
    domain = lambda h: ".".join(h.split(".")[-2:])
    top = lambda h: h.split(".")[-1]
    total = lambda keep: [sum(s[k] for r, s in zip(rows, shares, strict=True) if keep(r)) for k in size]
    smooth = lambda sums, wide: [(x + smoothing * w) / (sum(sums) + smoothing) for x, w in zip(sums, wide, strict=True)]
    out = []
    for i, (_, host, declared, suffix, log) in enumerate(rows):
        mine = lambda sums: [max(x - y, 0) for x, y in zip(sums, shares[i], strict=True)]  # noqa: E731, B023
        everyone = mine(total(lambda r: True))
        base = [(x + 1) / (sum(everyone) + len(langs)) for x in everyone]
        tops = smooth(mine(total(lambda r: top(r[1]) == top(host))), base)  # noqa: B023
        domains = smooth(mine(total(lambda r: domain(r[1]) == domain(host))), tops)  # noqa: B023
        prior = smooth(mine(total(lambda r: r[1] == host)), domains)  # noqa: B023
        score = [x + math.log(p) for x, p in zip(log, prior, strict=True)]
        for value, at in ((declared, 2), (suffix, 3)):
            if value:
                sums = mine(total(lambda r: r[at] == value))  # noqa: B023
                score = [x + math.log((n + b) / ((sum(sums) + 1) * b)) for x, n, b in zip(score, sums, base, strict=True)]
        p = [math.exp(x - max(score)) for x in score]
        out.append((max(p) / sum(p), langs[p.index(max(p))]))
    return out


def test_fusion_equals_brute_force(spark):
    rng = random.Random(12)
    langs = ["aa", "bb", "cc"]
    rows = [(i, rng.choice(["a.one.net", "b.one.net", "x.two.org", "two.org", ""]), rng.choice(["aa", "bb", ""]), [rng.uniform(-6, 0) for _ in langs]) for i in range(60)]
    seen = spark.createDataFrame([(i, f"http://{h}/" if h else "", d or None, log) for i, h, d, log in rows], "page_id long, url string, declared string, text_log array<double>")
    got = {r["page_id"]: (r["probability"], r["lang"]) for r in language_id.fused(seen, langs).collect()}
    want = brute_languages([(i, h, d, h.split(".")[-1], log) for i, h, d, log in rows], langs, language_id.SMOOTHING)
    for i, (p, lang) in enumerate(want):
        assert got[i][1] == lang and math.isclose(got[i][0], p, rel_tol=1e-9)


def test_text_evidence_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der Hund lief über die Straße", "de"), ("the dog", "en")])], "doc_id long, text string, lang string")
    langs, logs = language_id.learned(docs)
    texts = ["The CAT, the hund!", "", "straße 12 über", "x"]
    got = [r["text_log"] for r in language_id.text_evidence(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "page_id long, html string").coalesce(1), (langs, logs)).orderBy("page_id").collect()]
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    for text, log in zip(texts, got, strict=True):
        x = [fold(b) for b in text.encode()]
        sums = [0.0] * len(langs)
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            if (a, b) != (32, 32):
                h = ((a * 65_599 + b) * 65_599 + c) % 2**32 * 2_654_435_769 % 2**32 >> 18
                sums = [s + logs[h, k] * language_id.PER_TRIGRAM for k, s in enumerate(sums)]
        assert [round(s - max(sums), 3) for s in sums] == [round(v, 3) for v in log]


@pytest.mark.parametrize("html", [None, "", "ab", "<p></p>", "x" * 3_000_000])
def test_language_of_a_single_odd_page(spark, html):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der Hund lief", "de")], "doc_id long, text string, lang string")
    for url in (None, "", "http://a.net/"):
        found = language_id.page_languages(spark.createDataFrame([(1, url, html, 5, 6)], "page_id long, url string, html string, `own` long, `a.b` long"), docs).collect()
        assert len(found) == 1 and found[0]["lang"] in ("de", "en")


def test_votes_equal_brute_force():
    """Expectation-maximisation row by row instead of by pattern."""
    rng = random.Random(8)
    rows = [[rng.choice((1, 1, 1, 0)) for _ in range(4)] if rng.random() < 0.8 else [rng.choice((-1, -1, 0, 1)) for _ in range(4)] for _ in range(400)]
    patterns = sorted({tuple(r) for r in rows})
    odds, weights = quality_rules.fit_votes(np.array(patterns), np.array([rows.count(list(p)) for p in patterns], float))
    p, before = [0.2 if -1 in r else 0.9 for r in rows], None
    for _ in range(100):
        good, bad = sum(p), len(rows) - sum(p)
        rate = min(max((good + 1) / (len(rows) + 2), 0.01), 0.99)
        w = [[math.log((sum(x for x, r in zip(p, rows, strict=True) if r[k] == v) + 1) / (good + 3)) - math.log((sum(1 - x for x, r in zip(p, rows, strict=True) if r[k] == v) + 1) / (bad + 3)) for v in (-1, 0, 1)] for k in range(4)]
        w = [[min(a, 0), b, max(c, 0)] for a, b, c in w]
        o = math.log(rate / (1 - rate))
        p = [1 / (1 + math.exp(-(o + sum(w[k][v + 1] for k, v in enumerate(r))))) for r in rows]
        if before and max(abs(a - b) for a, b in zip(p, before, strict=True)) < 1e-9:
            break
        before = p
    assert math.isclose(o, odds, rel_tol=1e-6) and all(math.isclose(w[k][v], weights[k][v], rel_tol=1e-5, abs_tol=1e-5) for k in range(4) for v in range(3))


def test_visible_text_and_declaration():
    page = '<!DOCTYPE html><HTML class="x" lang="FR-ca"><script>var t="<p>no</p>";</script><p>Oui &amp; non<!-- no --></p><style>no'
    assert language_id.declared_language(page) == "fr" and language_id.visible_text(page).split() == ["Oui", "non", "no"]
    assert language_id.declared_language("<p lang='de'>") is None and language_id.visible_text("<nav>" * 3) .strip() == ""


def test_language_by_each_kind_of_evidence(spark):
    rng = random.Random(9)
    speak = {"aa": "abcde", "bb": "vwxyz"}
    say = lambda lang, n: " ".join("".join(rng.choice(speak[lang]) for _ in range(5)) for _ in range(n))
    docs = spark.createDataFrame([(i, say(lang, 50), lang) for i, lang in enumerate(["aa", "bb"] * 30)] + [(None, None, None)], "doc_id long, text string, lang string")
    rows = [(i, f"http://h{i % 3}.one.net/aa/{i}", f'<html lang="aa"><p>{say("aa", 60)}') for i in range(30)]
    rows += [(100 + i, f"http://g{i % 3}.two.org/bb/{i}", f'<html lang="bb"><p>{say("bb", 60)}') for i in range(30)]
    rows += [(200, "http://h0.one.net/", ""), (201, "http://g1.two.org/", None), (202, None, f"<p>{say('bb', 40)}"), (203, "http://new.two.org/", "<p>"), (204, None, '<html lang="aa">'), (None, "", f"<p>{say('aa', 40)}"), (205, "http://x.org/aa/", "<p>"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "l") for r in rows], "page_id long, url string, html string, lang string")
    got = language_id.page_languages(pages, docs).collect()
    lang = {r["page_id"]: r["lang"] for r in got}
    assert len(got) == len(rows) and all(lang[i] == "aa" and lang[100 + i] == "bb" for i in range(30))
    assert [lang[k] for k in (200, 201, 202, 203, 204, None, 205)] == ["aa", "bb", "bb", "bb", "aa", "aa", "bb"]
    assert all(0 < r["probability"] <= 1 for r in got)
    assert language_id.page_languages(pages.limit(0), docs).count() == 0 and {r["lang"] for r in language_id.page_languages(pages, docs.limit(0)).collect()} == {None}
