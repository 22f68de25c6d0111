"""The n-gram join and the native operators against brute force on small fixtures."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import decontamination as deco
from folio.llm import mixing, sharding
from folio.llm.ngram_join import least_of_component, ngram_components
from folio.llm.occurrence import DivideSkip, joined_clusters, least_overlap, linked
from folio.llm.runtime import giving_back, small_batches
from folio.llm.url_filters import ENTRY_SCHEMA, judged, url_host, url_path, validity_intervals

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        if doc is not None:
            least[x] = min(least.get(x, doc), doc)
    return Counter((doc, len(s), least.get(x) if s else doc) for (doc, _), s, x in zip(rows, sets, label, strict=True))


def near_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = " ".join(word() for _ in range(60))
    rows = []
    for base in range(12):
        words = [word() for _ in range(rng.choice((3, 5, 8, 40, 120)))]
        for _ in range(rng.choice((1, 3, 12))):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) + 100 * base, " ".join(copy)))
    rows += [(5000 + i, f"{passage} {' '.join(word() for _ in range(i))}") for i in range(25)]
    rows += [(6000, ""), (6001, None), (6002, " \n"), (6003, "One"), (6004, "one"), (6005, "a b\nc d"), (6006, "A  b c\td"), (6007, "a b c d e"), (None, "a b c d e"), (None, "only here of all rows"), (6007, "a b c d e"), (7000, "long " * 30_000)]
    rng.shuffle(rows)
    return rows


def test_ngram_components_equal_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, n long")  # names that the operator uses itself
    assert Counter(map(tuple, ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect())) == brute_components(rows)


def test_ngram_components_of_hot_groups(spark, monkeypatch):
    """A third of the rows are near copies of one text; and lists too long for one task."""
    import folio.llm.ngram_join as join

    monkeypatch.setattr(join, "UNIT_TOKENS", 300)
    monkeypatch.setattr("folio.llm.runtime.BROADCAST_KEYS", 3)
    monkeypatch.setattr(join, "BLOCK_TOKENS", 200)
    rows = near_copies(2)
    assert Counter(map(tuple, ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute_components(rows)


def test_ngram_components_of_nothing(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = least_of_component(spark.createDataFrame([(2, "a b c d e f"), (1, "A b c d e f"), (3, "")], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("seed", range(4))
def test_divide_skip_equals_all_pairs(seed):
    rng = random.Random(seed)
    sets = [set(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(60)]
    sets += [s | {99} for s in sets[:20]]
    index = DivideSkip()
    for i, s in enumerate(sets):
        want = [j for j, o in enumerate(sets[:i]) if linked(len(s & o), len(s), len(o))]
        assert sorted(index.search(sorted(s))) == want
        index.add(sorted(s))
    assert index.search([]) == [] and least_overlap(10) == 8


@pytest.mark.parametrize("seed", range(6))
def test_joined_clusters_equal_all_pairs(seed):
    rng = random.Random(seed)
    base = [set(rng.sample(range(60), rng.randrange(5, 30))) for _ in range(12)]
    sets = [(s | {rng.randrange(60) for _ in range(rng.randrange(4))}) - {rng.randrange(60)} for s in base for _ in range(rng.randrange(1, 9))]
    cluster = [rng.randrange(len(sets) // 2) for _ in sets]
    names = sorted(set(cluster))
    label = {c: c for c in names}
    for i, s in enumerate(sets):
        for j, o in enumerate(sets[:i]):
            if linked(len(s & o), len(s), len(o)):
                old, new = label[cluster[i]], label[cluster[j]]
                label = {c: new if x == old else x for c, x in label.items()}
    ids = np.array([names.index(c) for c in cluster])
    got = joined_clusters(ids, np.array([len(s) for s in sets]), np.array([t for s in sets for t in sorted(s)], np.uint64))
    pairs = lambda f: {(a, b) for a in range(len(names)) for b in range(a) if f(a) == f(b)}
    assert pairs(lambda k: int(got[k])) == pairs(lambda k: label[names[k]])


def family_texts(n, least, most, seed):
    """Copies of one text of 100 words, in which ``least`` to ``most`` words are others."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(100)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(100), rng.randrange(least, most + 1)):
            copy[at] = f"c{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def family(*of):
    return [sorted({xxhash.xxh3_64_intdigest(b" ".join(x)) >> 2 for x in shingles(text)}) for text in family_texts(*of)]


def test_sets_that_are_near_without_a_link_are_not_searched(monkeypatch):
    """each shares T of its tokens with others, but no two of a size have what a link between them needs."""
    import folio.llm.occurrence as occurrence

    added = []
    monkeypatch.setattr(occurrence._Clusters, "add", lambda self, at, c, tokens: added.append(at))
    sets = family(200, 4, 4, 1)
    times = Counter(t for s in sets for t in s)
    assert min(sum(times[t] > 1 for t in s) / len(s) for s in sets) >= 0.75
    got = joined_clusters(np.arange(200), np.array([len(s) for s in sets]), np.array([t for s in sets for t in s], np.uint64))
    assert len(added) <= 20 and not any(linked(len(set(a) & set(b)), len(a), len(b)) and got[i] != got[j] for i, a in enumerate(sets) for j, b in enumerate(sets[:i]))


@pytest.mark.parametrize("seed", range(4))
def test_joined_clusters_of_a_family_equal_all_pairs(seed):
    sets = family(80, 0, 9, seed) + [s[: len(s) - 5 * k] for k, s in enumerate(family(12, 1, 4, seed))]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if linked(len(set(a) & set(b)), len(a), len(b)):
                label = [label[j] if x == label[i] else x for x in label]
    got = joined_clusters(np.arange(len(sets)), np.array([len(s) for s in sets]), np.array([t for s in sets for t in s], np.uint64)).tolist()
    assert [[a == b for b in label] for a in label] == [[a == b for b in got] for a in got]


def test_many_near_sets_are_searched_on_arrays():
    """each two of 700 sets share about 156 tokens, 38 million in all; a count one by one of a fifth of these takes longer than the search."""
    texts = [f"{a} {b.replace('b', 'e')}" for a, b in zip(family_texts(700, 2, 2, 7), family_texts(700, 2, 2, 8), strict=True)]
    sets = [sorted({xxhash.xxh3_64_intdigest(b" ".join(x)) >> 2 for x in shingles(text)}) for text in texts]
    names = {t: i for i, t in enumerate(sorted({t for s in sets for t in s}))}
    has = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        has[i, [names[t] for t in s]] = 1
    both, sizes = has @ has.T, np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    for i, j in np.argwhere(np.tril(100 * both >= 75 * (sizes[:, None] + sizes - both), -1)):
        label[label == label[j]] = label[i]
    began = time.process_time()
    Counter(i % 1000 for i in range(7_600_000))
    one_by_one, began = time.process_time() - began, time.process_time()
    got = joined_clusters(np.arange(len(sets)), sizes, np.array([t for s in sets for t in s], np.uint64))
    assert time.process_time() - began < one_by_one
    assert len(np.unique(label)) > 20 and ((got[:, None] == got) == (label[:, None] == label)).all()


def test_a_large_unit_is_not_read_list_by_list(spark, monkeypatch):
    """sets of many long lists meet as often as the unit has parts, not as often as their lists have."""
    import folio.llm.ngram_join as join

    tokens = spark.sparkContext.accumulator(0)

    def counted(groups, n, body, threshold):
        tokens.add(len(body))
        return joined_clusters(groups, n, body, threshold)

    monkeypatch.setattr(join, "joined_clusters", counted)
    sets = family(90, 0, 4, 3)
    rows = [(i, i, len(s), bytearray(np.array(s, np.int64).tobytes())) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "key long, group long, n long, tokens binary").repartition(4)
    whole = sum(map(len, sets))
    found = {r["group"]: r["label"] for r in join.joined_groups(table, 75, whole // 2).collect()}
    assert whole < tokens.value <= 5 * whole
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if linked(len(set(a) & set(b)), len(a), len(b)):
                label = [label[j] if x == label[i] else x for x in label]
    got = [found.get(i, i) for i in range(len(sets))]
    assert [[a == b for b in label] for a in label] == [[a == b for b in got] for a in got]


def test_least_of_a_large_family(spark, monkeypatch):
    """F1, the pipeline's stage: a family that contraction leaves apart is read a few times, and one row of each component stays."""
    import folio.llm.ngram_join as join

    read = spark.sparkContext.accumulator(0)

    def counted(groups, n, body, threshold):
        read.add(len(body))
        return joined_clusters(groups, n, body, threshold)

    rows = list(enumerate(family_texts(80, 3, 5, 5) + family_texts(10, 0, 1, 5)))
    whole = sum(len(shingles(text)) for _, text in rows)
    monkeypatch.setattr(join, "joined_clusters", counted)
    monkeypatch.setattr(join, "UNIT_TOKENS", whole // 3)
    kept = least_of_component(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted({c for _, _, c in brute_components(rows)})
    assert whole / 4 < read.value <= 8 * whole


def test_five_thousand_near_copies(spark):
    """Each of them is linked with the first by construction, so all are one component; what is like them by 0.7 is not."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 5000):
        copy, at = list(base), rng.randrange(190)
        for j in range(rng.randrange(1, 11)):  # a run of words: at most 14 shingles of 196 differ
            copy[at + j] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    for i in range(40):  # 36 words less at one end and other words instead: 160 of 232 shingles
        rows.append((10_000 + i, " ".join(base[:164] + [f"d{i}x{j}" for j in range(36)])))
    got = {r["doc_id"]: r["component_id"] for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {got[i] for i in range(5000)} == {0} and all(got[10_000 + i] == 10_000 + i for i in range(40))


def test_tables_that_are_not_needed_go(spark):
    from folio.sources import scratch

    before = len(scratch._stored)
    kept = []
    with scratch.scratch(spark, kept):
        rows = ngram_components(spark.createDataFrame(near_copies(), "doc_id long, text string"))
        assert len(scratch._stored) - before <= 6
        kept.append(scratch.stored(rows, "kept"))
    assert len(scratch._stored) == before + 1 and kept[0].count()
    scratch.discard(*kept)
    assert len(scratch._stored) == before


def test_lookup_table_is_fair_and_steady():
    table = sharding.lookup_table()
    counts = Counter(table)
    assert len(table) == sharding.TABLE_SIZE and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    moved = sum(sharding.SHARDS[a] != sharding.SHARDS[b] for a, b in zip(table, fewer, strict=True))
    assert moved < 0.25 * len(table)  # a sixteenth must move
    for shards, size in (((), 7), (("a", "a"), 7), (("a",), 8), (("a", "b", "c"), 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, size)


def test_sharding(spark, tmp_path):
    rows = spark.createDataFrame([(i, "t", "old") for i in range(200)] + [(None, None, None)] * 2, "doc_id long, text string, shard string")
    got = sharding.with_shard(rows, F.col("doc_id")).collect()
    table = sharding.lookup_table()
    for r in got:
        slot = sharding.stable_hash("" if r["doc_id"] is None else str(r["doc_id"])) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[table[slot]])
    assert len(got) == 202 and sharding.with_shard(rows.limit(0), F.col("doc_id")).count() == 0
    sharding.write_shards(rows, str(tmp_path / "s"), 2, F.col("doc_id"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 202


def water_fill(sizes, weights, total, cap):
    """The fixpoint, by clamping until nothing changes."""
    held = {}
    while True:
        free = {s: w for s, w in weights.items() if s not in held}
        left = total - sum(held.values())
        over = [s for s, w in free.items() if left * w / sum(free.values()) > cap * sizes[s]]
        if not over:
            return held | {s: left * w / sum(free.values()) for s, w in free.items()}
        held |= {s: cap * sizes[s] for s in over}


def test_mixing(spark):
    rng = random.Random(3)
    sources = [None, "", "B", "a", "é", "z"]
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 3, 3, 3, 20, 90))), rng.choice([*sources, "a", "a", "a"])) for i in range(900)]
    rows += [(None, None, "a"), (7, "x y", "a"), (7, "x y", "a"), (1000, "big " * 50_000, "z")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size long")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = water_fill(sizes, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], rel_tol=1e-9) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= (0.01 if s != "z" else 1) * targets[s] + 100
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mix_sources(docs.where("text = ''")).agg(F.sum("copies")).first()[0] == 0


def test_mixing_by_seed_and_with_clashing_names(spark):
    rows = [(i, "w " * (3 * i + 1), "s", 7, 8, 9) for i in range(40)] + [(None, "x " * n, None, 7, 8, 9) for n in (2, 2, 3, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int, n int, miss int")
    copies = {}
    for seed in (1, 99, 1):
        got = mixing.mix_sources(docs, seed=seed)
        assert got.columns == [*docs.columns, "size", "source_size", "target", "copies"] and got.count() == len(rows)
        now = sorted((r["doc_id"], r["copies"]) for r in got.where("doc_id is not null").collect())
        assert copies.setdefault(seed, now) == now and all(r["k"] == 7 for r in got.collect())
    assert copies[1] != copies[99]
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_url_parts(spark):
    urls = ["https://U:p@Www.A.com:80/x/y?q#f", "http://a.com", "a.com/x", "", None, "ftp://a.com./?q"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(url_host(F.col("u")), url_path(F.col("u")))
    assert list(map(tuple, df.collect())) == [("www.a.com", "/x/y"), ("a.com", "/"), ("", "/"), ("", "/"), ("", "/"), ("a.com", "/")]


def test_url_filter_is_judged_at_the_time_of_fetch(spark):
    log = [("l", "block", "b.com", "add", 10), ("l", "block", "b.com", "remove", 20), ("l", "block", "b.com", "add", 30), ("l", "block", "b.com", "add", 30), ("m", "allow", "x.b.com/ok/", "add", 15), (None, "block", "c.com", "add", 1), ("l", "block", None, "add", 1), ("l", "block", "d.com", "add", None)]
    entries = spark.createDataFrame([(*r[:4], r[4]) for r in log], "list string, effect string, pattern string, action string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    assert [f.split()[0] for f in ENTRY_SCHEMA.split(", ")] == entries.columns and validity_intervals(entries).count() == 3
    cases = [("http://b.com/", 9, True), ("http://b.com/", 10, False), ("http://x.b.com/", 19, False), ("http://b.com/", 20, True), ("http://ab.com/", 12, True), ("http://x.b.com/ok/1", 16, True), ("http://x.b.com/ok/1", 31, True), ("http://x.b.com/no", 31, False), ("http://b.com/", None, True), (None, 12, True), ("", 12, True), ("http://c.com/", 12, True), ("http://b.com/", 10, False)]
    captures = spark.createDataFrame([(u, t, k, "h") for u, t, k in cases], "url string, s long, want boolean, host string").withColumn("fetched_at", F.timestamp_seconds("s"))
    got = judged(captures, entries)
    assert got.count() == len(cases) and got.where("kept != want").count() == 0
    assert judged(captures, entries.limit(0)).where("not kept").count() == 0 and judged(captures.limit(0), entries).count() == 0


def brute_judged(url, at, log):
    """By the entries as they are: what was last said of each list and pattern, then the longest."""
    host, path = url.split("/", 3)[2], "/" + url.split("/", 3)[3]
    best = None
    for name, pattern in {(r[0], r[2]) for r in log}:
        said = [r for r in log if (r[0], r[2]) == (name, pattern) and r[4] <= at]
        latest = [r for r in said if r[4] == max(x[4] for x in said)]
        if not any(r[3] == "add" for r in latest):
            continue
        of, _, start = pattern.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + start):
            blocks = any(r[1] != "allow" for r in latest)
            best = max(best or (0,), (len(of) + 1 + len(start), blocks, name, pattern if start else of))
    return best and best[1:]


@pytest.mark.parametrize("part", [7, 1_000_000])
def test_url_filter_equals_brute_force(spark, part):
    rng = random.Random(part)
    patterns = ["hot.com", "a.hot.com", "hot.com/", "hot.com/x", "hot.com/x/", "a.hot.com/x/y", "com", "other.net/ü", "other.net"]
    log = [(f"l{rng.randrange(5)}", rng.choice(("block", "block", "allow")), rng.choice(patterns), rng.choice(("add", "add", "remove")), rng.randrange(60)) for _ in range(300)]
    seen = [(f"http://{rng.choice(('hot.com', 'a.hot.com', 'b.a.hot.com', 'other.net', 'free.org', 'x.other.net'))}/{rng.choice(('', 'x', 'x/', 'x/y/z', 'xy', 'ü/1', 'y' * 3000))}", rng.randrange(70)) for _ in range(600)]
    timed = lambda df: df.withColumn("at", F.timestamp_seconds("s")).drop("s")
    captures = timed(spark.createDataFrame(seen + seen[:50], "url string, s long")).withColumn("host", F.lit(1)).withColumn("path", F.lit(2)).repartition(4)
    got = judged(captures, timed(spark.createDataFrame(log, "list string, effect string, pattern string, action string, s long")), "url", "at", part)
    assert got.columns == ["url", "at", "path", "host", "matched_list", "matched_pattern", "kept"]
    log = [(*r[:2], "hot.com" if r[2] == "hot.com/" else r[2], *r[3:]) for r in log]  # one and the same pattern
    want = Counter()
    for url, at in seen + seen[:50]:
        blocks, name, pattern = brute_judged(url, at, log) or (False, None, None)
        want[url, at, name, pattern, not blocks] += 1
    assert Counter(map(tuple, got.select("url", F.unix_seconds("at"), "matched_list", "matched_pattern", "kept").collect())) == want


def test_url_filter_of_a_host_with_very_many_entries(spark):
    """Half of the entries are of one pattern by as many lists, the others of a path each; every capture is of their host."""
    n = 50_000
    lists = spark.range(n).select(F.format_string("l%05d", "id").alias("list"), F.lit("block").alias("effect"), F.lit("hot.com").alias("pattern"), F.lit("add").alias("action"), F.timestamp_seconds("id").alias("at"))
    gone = lists.withColumn("action", F.lit("remove")).withColumn("at", F.col("at") + F.expr("interval 10 seconds"))
    paths = spark.range(n).select(F.lit("p").alias("list"), F.lit("allow").alias("effect"), F.format_string("hot.com/%d/", "id").alias("pattern"), F.lit("add").alias("action"), F.timestamp_seconds(F.lit(70_000)).alias("at"))
    captures = spark.range(2 * n).select(F.format_string("http://www.hot.com/%d/x", "id").alias("url"), F.timestamp_seconds("id").alias("fetched_at"), F.col("id").alias("t"))
    got = judged(captures, lists.union(gone).union(paths), captures_a_part=20_000)
    t = F.col("t")
    # lists are added a second apart and hold ten seconds: of those that hold the last decides
    want = F.when(t < n, F.format_string("l%05d", "t")).when(t < n + 9, f"l{n - 1:05d}")
    assert got.where(~F.col("matched_list").eqNullSafe(want) | (F.col("kept") != (t >= n + 9))).count() == 0 and got.count() == 2 * n


def test_decontamination_tolerates_substitutions(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    short = [word() for _ in range(10)]
    changed = [w if i % 13 else "other" for i, w in enumerate(passage)]
    noise = lambda n: [word() for _ in range(n)]
    rows = [(1, " ".join(noise(50) + passage + noise(30))), (2, "\n".join(noise(7) + changed)), (3, " ".join(noise(200))), (4, " ".join(passage[:6] + noise(40))), (5, ", ".join(noise(3) + passage[10:30]).upper()), (6, None), (7, ""), (None, " ".join(passage)), (8, " ".join(short)), (9, " ".join(noise(20_000) + passage)), (9, " ".join(passage))]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(short)), (3, "too short"), (4, None), (1, " ".join(passage))], "item_id long, text string")
    want = {(1, 1), (2, 1), (5, 1), (None, 1), (8, 2), (9, 1)}
    got = deco.benchmark_overlaps(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    # items in blocks, and texts in pieces, give the same
    assert {(r["doc_id"], r["item_id"]) for r in deco.benchmark_overlaps(docs, items, block_seeds=20).collect()} == want
    monkeypatch.setattr(deco, "PIECES", (7, 3))
    assert {(r["doc_id"], r["item_id"]) for r in deco.benchmark_overlaps(docs, items).collect()} == want
    assert sorted(r["doc_id"] for r in deco.decontaminated(docs, items).collect()) == [3, 4, 6, 7]
    assert deco.decontaminated(docs, items.limit(0)).count() == len(rows) and deco.benchmark_overlaps(docs.limit(0), items).count() == 0


def brute_overlaps(docs, items):
    """By every alignment of every item."""
    found = {}
    for doc, text in docs:
        d = text.split()
        for item, words in items:
            w = words.split()
            n = min(len(w), deco.WINDOW)
            for shift in range(-len(w), len(d)):
                same = [0 <= shift + j < len(d) and d[shift + j] == x for j, x in enumerate(w)]
                best = max(sum(same[i : i + n]) for i in range(len(w) - n + 1))
                if best >= (math.ceil(n * deco.AGREE) if len(w) >= deco.SPAN else n):
                    found[doc, item] = max(best, found.get((doc, item), 0))
    return {(*k, v) for k, v in found.items()}


def test_decontamination_finds_every_accepted_alignment(spark):
    rng = random.Random(11)
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    items = [(n, [f"i{n}.{j}".replace(".", "x") for j in range(n)]) for n in (1, 3, 8, 9, 10, 11, 12, 15, 16, 30)]
    docs = []
    for n, words in items:
        for offset in range(3):
            for subs in (0, 1, 2, 3, 3, 3, 3, 4):
                copy = list(words)
                for j in rng.sample(range(n), min(n, subs)):
                    copy[j] = noise(1)[0]
                docs.append((len(docs), " ".join(noise(30 + offset) + copy + noise(20))))
        for cut in (1, 2, 3):  # at the edges of a document
            docs += [(len(docs) + 1000, " ".join(words[cut:] + noise(9))), (len(docs) + 2000, " ".join(noise(9 + cut) + words[:-cut])), (len(docs) + 3000, " ".join(words[cut:]))]
    items = [(i, " ".join(w)) for i, w in items]
    got = deco.benchmark_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["item_id"], r["agreeing"]) for r in got) == Counter(brute_overlaps(docs, items))


def test_decontamination_of_a_very_long_text(spark):
    """Two hundred thousand words in one document, with a changed copy of an item at its very end."""
    rng = random.Random(4)
    item = [f"q{i}" for i in range(30)]
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000)) + " " + " ".join(["x", *item[1:9], "y", *item[10:16]])
    docs = spark.createDataFrame([(1, text), (2, text[:500_000])], "doc_id long, text string")
    got = deco.benchmark_overlaps(docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 5, 14, 16)]


def test_stages_judge_rows_without_or_with_shared_ids(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (None, "only this row"), (None, None), (5, "p q r s t u"), (None, "p q r s t u"), (6, "one text of it"), (6, "another text"), (4, "P q r s t u")]
    kept = Counter((r["doc_id"], (r["text"] or "").lower()) for r in least_of_component(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == Counter([(None, "a b c d e f"), (None, "only this row"), (None, ""), (6, "one text of it"), (6, "another text"), (4, "p q r s t u")])
    passage = "k l m n o p q r s t"
    docs = spark.createDataFrame([(None, passage), (None, "clean"), (1, passage), (1, "clean too")], "doc_id long, text string")
    clean = deco.decontaminated(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()
    assert sorted(r["text"] for r in clean) == ["clean", "clean too"]


def test_mixing_does_not_shuffle_unread_texts(spark):
    rows = [(i, "w " * (i % 5), "s") for i in range(60)] + [(9, None, "s"), (9, "", "s"), (9, "", "s"), (None, "w", None), (None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs)
    plan = mix.select("doc_id", "size", "copies")._jdf.queryExecution().optimizedPlan().toString()
    # above the projection that counts words and makes the digest nothing has the text's column
    text = next(w for w in plan.replace(",", " ").replace("[", " ").replace("]", " ").split() if w.startswith("text#"))
    assert all("md5" in x or "LogicalRDD" in x or "Relation" in x for x in plan.splitlines() if text in x)
    whole, pruned = (Counter(map(tuple, x.select("doc_id", "size", "copies").collect())) for x in (mix.cache(), mixing.mix_sources(docs)))
    assert whole == pruned and sum(whole.values()) == len(rows)


def test_workers_give_freed_memory_back():
    def held_mb():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Pss_Anon")) / 1024

    pins = []

    def run(batches):
        for batch in batches:
            arrays = [np.ones(12_000) for _ in range(1_000)]  # below the size that is mapped by itself
            pins.append(np.ones(12_000))  # what lies below it is not given back by itself
            del arrays
            yield batch

    before = held_mb()
    assert list(giving_back(run)(iter([1]))) == [1] and held_mb() < before + 45


def test_texts_go_to_python_in_small_batches(spark):
    docs = small_batches(spark.range(0, 40, 1, 1).select(F.col("id"), F.repeat(F.lit("text "), 100_000).alias("text")))

    def run(batches):
        yield from (b.from_arrays([[b.num_rows]], names=["n"]) for b in batches)

    rows = [r["n"] for r in docs.mapInArrow(run, "n long").collect()]
    assert sum(rows) == 40 and max(rows) <= 6
