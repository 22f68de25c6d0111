import json
import math
import random
import sys
import threading
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark import cloudpickle
from pyspark.sql import functions as F

from folio.errors import ModelError
from folio.operators import models
from folio.operators.boosted import Booster, saved_booster
from folio.operators.density import DensityClusters, core_distances
from folio.operators.paging import PageLimits, assign_pages, page_ends, paged_blocks, ranked_keys, row_bytes, row_limit
from folio.operators.sets import remaining_keys, rows_per_key, union_by_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test's module


def naive(rows, limit, every):
    ends, keys, total = [], 0, 0
    for i, n in enumerate(rows):
        keys, total = keys + 1, total + n
        if keys % every == 0 and total > limit:
            ends.append(i)
            keys = total = 0
    return ends


@given(st.lists(st.integers(0, 9), max_size=80), st.integers(0, 30), st.integers(1, 7), st.integers(1, 11))
def test_page_ends_equal_the_loop_in_any_batches(rows, limit, every, size):
    got, keys, total = [], 0, 0
    for at in range(0, len(rows), size):
        part = rows[at : at + size]
        ends = page_ends(pd.Series(part).to_numpy(), limit, every, keys, total)
        got += [at + e for e in ends]
        since = ends[-1] + 1 if ends else 0
        keys = len(part) - since + (0 if ends else keys)
        total = sum(part[since:]) + (0 if ends else total)
    assert got == naive(rows, limit, every)


def test_assign_pages(spark):
    counts = [(f"k{i:03d}", (i * 7) % 5) for i in range(100)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    got = assign_pages(spark.createDataFrame(counts, "key string, n_rows long"), PageLimits(max_rows=10, check_every=3)).orderBy("key_ord").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ends, page, want = set(naive([n for _, n in counts], 10, 3)), 0, []
    for i in range(100):
        want.append(page)
        page += i in ends
    assert [r["page"] for r in got] == want and [r["key"] for r in got] == [k for k, _ in counts]
    assert {r["page"] for r in assign_pages(spark.createDataFrame(counts, "key string, n_rows long"), PageLimits()).collect()} == {0}
    assert assign_pages(spark.createDataFrame([], "key string, n_rows long"), PageLimits(max_rows=1)).count() == 0


@pytest.mark.parametrize("every", [1, 3, 100])
def test_ranked_and_paged_in_ranges(spark, monkeypatch, every):
    monkeypatch.setattr("folio.operators.paging.SAMPLED", 50)
    monkeypatch.setattr("folio.operators.paging.KEYS_PER_RANGE", 30)
    counts = [(f"{i * 7919 % 1000:04d}", i % 4) for i in range(1000)]
    rows = spark.createDataFrame(counts, "key string, n_rows long")
    assert [r["at"] for r in ranked_keys(rows, name="at", ranges=7).orderBy("key").collect()] == list(range(1000))
    got = assign_pages(rows, PageLimits(max_rows=37, check_every=every)).orderBy("key").collect()
    ends, page, want = set(naive([n for _, n in sorted(counts)], 37, every)), 0, []
    for i in range(1000):
        want.append(page)
        page += i in ends
    assert [(r["key_ord"], r["page"]) for r in got] == list(enumerate(want))


@pytest.mark.parametrize(("limit", "followed", "seed"), [(37, 10**6, 1), (37, 0, 2), (0, 0, 3), (3000, 0, 4), (400, 10**6, 5)])
def test_pages_by_pointers_between_ranges(spark, monkeypatch, limit, followed, seed):
    """Pages shorter and longer than ranges, blocks without rows, pointers followed by the driver and by doubling."""
    monkeypatch.setattr("folio.operators.paging.BLOCKS_PER_RANGE", 40)
    monkeypatch.setattr("folio.operators.paging.FOLLOWED", followed)
    rng = random.Random(seed)
    rows = [rng.choice((0, 0, 1, 2, 3, 50 if i % 97 == 0 else 4)) for i in range(1000)]
    got = paged_blocks(spark.createDataFrame(list(enumerate(rows)), "_block long, n_rows long").repartition(5), limit).orderBy("_block").collect()
    ends, page, want = set(naive(rows, limit, 1)), 0, []
    for i in range(1000):
        want.append(page)
        page += i in ends
    assert [r["page"] for r in got] == want


def test_ten_million_keys_are_paged_without_a_task_of_all(spark, monkeypatch):
    monkeypatch.setattr("folio.operators.paging.RANGES", 32)
    monkeypatch.setattr("folio.operators.paging.BLOCKS_PER_RANGE", 20_000)
    n, every, limit = 10_000_000, 10, 12_345
    counts = spark.range(n).select(F.format_string("%08d", "id").alias("key"), (F.col("id") * 7919 % 5).alias("n_rows"), "id")
    got = assign_pages(counts, PageLimits(max_rows=limit, check_every=every), ord_col="id")
    summary = [tuple(r) for r in got.groupBy("page").agg(F.min("key_ord"), F.count("*"), F.sum("n_rows")).orderBy("page").collect()]
    rows = np.arange(n) * 7919 % 5
    ends = page_ends(rows.reshape(-1, every).sum(1), limit, 1)
    first = np.concatenate([[0], (np.array(ends) + 1) * every])
    total = np.concatenate([[0], np.cumsum(rows)])
    until = np.append(first[1:], n)
    assert summary == [(k, a, b - a, total[b] - total[a]) for k, (a, b) in enumerate(zip(first.tolist(), until.tolist(), strict=True))]


def test_limits(spark):
    schema = spark.createDataFrame([], "a long, b boolean, c string").schema
    assert row_bytes(schema) == 8 + 8 + 1 + 8
    assert row_limit(PageLimits(max_rows=5, max_mb=1), 100) == 5 and row_limit(PageLimits(max_mb=1), 128) == 8192
    with pytest.raises(ValueError):
        PageLimits(check_every=0)


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2.5, True)], "i double, t boolean")
    united = union_by_name([a, b])
    assert sorted(map(tuple, united.collect()), key=str) == sorted([(1.0, "x", None), (2.5, None, True)], key=str)
    with pytest.raises(TypeError):
        union_by_name([a, spark.createDataFrame([("y",)], "i string")])
    keys = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string")
    assert sorted(map(str, (r[0] for r in remaining_keys(keys, spark.createDataFrame([("b",)], "key string")).collect()))) == ["None", "a"]
    counted = rows_per_key(keys.where("key is not null"), spark.createDataFrame([("a",), ("a",)], "key string"))
    assert sorted(map(tuple, counted.collect())) == [("a", 2), ("b", 0)]


def test_find_model():
    entries = [{"key": 1, "map": "x"}, {"key": 2, "map": "y"}, {"key": 3, "map": "y"}]
    assert models.find_model(entries, {"map": "x"})["key"] == 1
    assert models.find_model(entries, {"map": "z"}) is None and models.find_model(entries, {}) is None
    with pytest.raises(ModelError, match="2 entries"):
        models.find_model(entries, {"map": "y"})


def test_registry_and_lookups(spark, tmp_path):
    spark.createDataFrame([(1, "one"), (2, "two")], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "t" / "a.parquet"))
    (tmp_path / "m.json").write_text(json.dumps({"1": "uno", "3": "tre", "4": 5, "5": [1, None], "6": None}))
    (tmp_path / "c.csv").write_text("k,v\n1,x\n")
    registry = models.Registry(spark, {
        "table": [{"type": "dataframe", "bucket": str(tmp_path), "key": "t/a.parquet"}, {"type": "other"}],
        "csv": [{"type": "dataframe", "bucket": str(tmp_path), "key": "c.csv", "res_type": "text/csv"}],
        "set": [{"type": "dataframe_set", "bucket": str(tmp_path), "prefix": "t", "models": [{"key": "a", "lang": "en"}]}],
        "map": [{"type": "hashmap", "bucket": str(tmp_path), "key": "m.json"}],
        "odd": [{"type": "odd"}], "none": [],
    })
    rows = spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(map(tuple, registry.get("table").join(rows, "k").collect())) == [(1, "one"), (3, None)]
    assert registry.get("csv").invoke().collect()[0]["v"] == "x"
    one = registry.get("set")
    with pytest.raises(ModelError):
        one.invoke()
    assert one.select({"lang": "en"})["key"] == "a" and one.invoke().count() == 2
    with pytest.raises(ModelError):
        one.select({"lang": "en"})
    other = registry.get("set")
    assert other.select({"lang": "de"}) is None and other.invoke() is None
    lookup = registry.get("map")
    assert lookup.invoke(1) == "uno" and lookup.invoke("2") is None and lookup.invoke(4) == 5 and lookup.invoke(5) == [1, None] and lookup.invoke(6) is None
    assert sorted(map(tuple, lookup.join(rows, rows["k"], "w").collect())) == [(1, "uno"), (3, "tre")]
    for name in ("odd", "none", "absent"):
        with pytest.raises(ModelError):
            registry.get(name)
    with pytest.raises(TypeError):
        models.Registry(spark, [1])
    assert models.Registry(spark, {})._models == {}


def test_scorers(spark):
    class Fitted:
        def predict(self, frame):
            return frame["a"] * 2, None

        def predict_proba(self, frame):
            return [[0.25, x] for x in frame["a"]]

    rows = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "a double, b string")
    assert [r["prediction"] for r in models.ScoringModel(Fitted, ["a"]).invoke(rows).orderBy("a").collect()] == [2.0, 4.0]
    assert models.ScoringModel(Fitted, ["a"], "predict_proba", "array<double>").invoke(rows).orderBy("a").first()["prediction"] == [0.25, 1.0]
    chosen = models.ScoringSetModel([{"key": "k", "m": 1}], lambda entry: Fitted(), ["a"])
    assert chosen.select({"m": 1}) and chosen.invoke(rows).count() == 2

    def client():
        return lambda text: {"out": [{"y": float(line.split(",")[0]) + 1} for line in text.strip().split("\n")]}

    assert sorted(r["y"] for r in models.EndpointModel(client, ["a"], "out", "y double", batch_rows=1).invoke(rows).collect()) == [2.0, 3.0]


class Halves:
    """A fitted model as its loader gives it."""

    def __init__(self, body):
        self.by = int(body)

    def predict(self, frame):
        return frame["a"] // self.by

    def predict_proba(self, frame):
        return [[x, 1 - x] for x in frame["a"] / self.by]


def test_fitted_kinds(spark, tmp_path):
    (tmp_path / "m.pkl").write_bytes(b"2")
    entry = {"bucket": str(tmp_path), "key": "m.pkl", "parameters": {"columns": ["a"]}}
    models_ = {
        "means": [{"type": "s3_scikit", "model_type": "MiniBatchKMeans", **entry}],
        "linear": [{"type": "fitted", "model_type": "SGDClassifier", **entry}],
        "set": [{"type": "s3_scikit_set", "model_type": "hdbscan", "extension": "pkl", "scikits": [{"key": "m", "map": "x"}], **entry}],
        "boosted": [{"type": "s3_xgboost", "model_type": "Booster", **entry}],
        "far": [{"type": "sagemaker_endpoint", "endpoint_name": "e", "req_type": "text/csv", "res_type": "application/json", "parameters": {"columns": ["a"], "schema": "y double"}}],
        "odd": [{"type": "s3_scikit", "model_type": "Odd", **entry}],
    }

    class Booster:
        def __init__(self, body):
            pass

        def predict(self, frame):
            assert list(frame["c"].cat.categories) == ["u", "v"]
            return frame["c"].cat.codes + frame["a"]

    models_["boosted"][0]["parameters"] = {"columns": ["a", "c"], "categories": {"c": ["u", "v"]}}
    load = dict.fromkeys(("MiniBatchKMeans", "SGDClassifier", "hdbscan"), Halves)
    ask = lambda entry: lambda text: {"data": [{"y": float(x) + len(entry["endpoint_name"])} for x in text.split()]}
    registry = models.Registry(spark, models_, loaders=load | {"Booster": Booster}, make_endpoint=ask)
    rows = spark.createDataFrame([(1.0, "v"), (4.0, "u")], "a double, c string")
    got = lambda name, **kw: [r["prediction"] for r in registry.get(name, **kw).invoke(rows).orderBy("a").collect()]
    assert got("means") == [0, 2] and got("linear") == [[0.5, 0.5], [2.0, -1.0]] and got("boosted") == [2.0, 4.0]
    one = registry.get("set")
    assert one.select({"map": "x"}) and [r["prediction"] for r in one.invoke(rows).orderBy("a").collect()] == [0, 2]
    other = registry.get("set")
    assert other.select({"map": "y"}) is None and other.invoke(rows) is None
    assert sorted(r["y"] for r in registry.get("far").invoke(rows).collect()) == [2.0, 5.0]
    for name, kw in (("odd", {}), ("means", {}), ("far", {})):
        with pytest.raises(ModelError):
            models.Registry(spark, models_, **kw).get(name)


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return round(rng.uniform(-1, 1), 3)
    node = {"feature": rng.randrange(3), "missing": rng.choice(("yes", "no")), "yes": random_tree(rng, depth - 1), "no": random_tree(rng, depth - 1)}
    return node | ({"right_if": rng.sample(range(5), 2)} if node["feature"] == 2 else {"below": round(rng.uniform(-1, 1), 2)})


def walked(node, x):
    while isinstance(node, dict):
        v = x[node["feature"]]
        if v is None or v != v:
            side = node["missing"]
        elif "right_if" in node:
            side = "no" if v in node["right_if"] else "yes"
        else:
            side = "yes" if np.float32(v) < np.float32(node["below"]) else "no"
        node = node[side]
    return np.float32(node)


def test_boosters_equal_a_walk_of_each_row(spark):
    rng = random.Random(5)
    rows = [(rng.choice((None, rng.uniform(-1.2, 1.2))), rng.uniform(-1.2, 1.2), rng.choice((None, 0.0, 1.0, 2.0, 3.0, 4.0))) for _ in range(300)]
    trees = [random_tree(rng, 5) for _ in range(9)]
    sums = [sum((walked(t, x) for t in trees), np.float32(np.log(0.3 / 0.7))) for x in rows]
    frame = pd.DataFrame(rows, columns=["a", "b", "c"]).astype("float64")
    model = Booster(saved_booster(trees, 3, base_score=0.3, names=["a", "b", "c"]))
    want = [1 / (1 + math.exp(-m)) for m in sums]
    assert model.predict(frame).tolist() == pytest.approx(want, rel=1e-5) and model.predict(frame[["c", "a", "b"]]).tolist() == pytest.approx(want, rel=1e-5)
    assert model.predict_proba(frame)[:, 0].tolist() == pytest.approx([1 - p for p in want], rel=1e-4)
    docs = spark.createDataFrame(rows, "a double, b double, c double")
    assert [r[0] for r in docs.select(model.column([F.col(x) for x in "abc"])).collect()] == pytest.approx(want, rel=1e-5)
    as_categories = frame.assign(c=pd.Categorical(frame["c"], categories=[0.0, 1.0, 2.0, 3.0, 4.0]))
    assert model.predict(as_categories).tolist() == model.predict(frame).tolist()
    plain = Booster(saved_booster(trees, 3, "reg:squarederror", 0.25, weights=[0.5] * 9))
    assert plain.predict(frame).tolist() == pytest.approx([0.25 + sum(0.5 * float(walked(t, x)) for t in trees) for x in rows], rel=1e-4, abs=1e-5)
    several = Booster(saved_booster(trees, 3, "multi:softprob", 0.5, 3, [0, 1, 2] * 3))
    by_class = [[0.5 + sum(float(walked(t, x)) for t in trees[k::3]) for k in range(3)] for x in rows]
    assert np.allclose(several.predict(frame), [[math.exp(m) / sum(map(math.exp, r)) for m in r] for r in by_class], rtol=1e-4)
    assert Booster(saved_booster(trees, 3, "multi:softmax", 0.5, 3, [0, 1, 2] * 3)).predict(frame).tolist() == [float(np.argmax(r)) for r in by_class]
    assert Booster(saved_booster([0.5], 3, "count:poisson", 2.0)).predict(frame.head(1)).tolist() == pytest.approx([2 * math.exp(0.5)], rel=1e-5)
    assert len(model.predict(frame.head(0))) == 0
    for odd in (b"{}", b"no json", saved_booster(trees, 3, "odd:objective")):
        with pytest.raises(ModelError):
            Booster(odd)
    with pytest.raises(ModelError, match="3 features"):
        model.predict(frame[["a"]])


def test_boosters_of_the_registry(spark, tmp_path):
    tree = {"feature": 1, "right_if": [1], "missing": "no", "yes": 0.25, "no": {"feature": 0, "below": 2.0, "yes": -0.5, "no": 0.75}}
    (tmp_path / "b.json").write_bytes(saved_booster([tree, tree], 2, names=["a", "m"]))
    entry = {"type": "s3_xgboost", "bucket": str(tmp_path), "key": "b.json", "parameters": {"columns": ["a", "m"], "categories": {"m": ["u", "v"]}}}
    rows = spark.createDataFrame([(1.0, "u"), (1.0, "v"), (3.0, "v"), (3.0, "other"), (None, None)], "a double, m string")
    registry = models.Registry(spark, {"b": [entry | {"model_type": "Booster"}], "c": [entry | {"model_type": "XGBClassifier"}]})
    p = [1 / (1 + math.exp(-2 * x)) for x in (0.25, -0.5, 0.75, 0.75, -0.5)]
    got = registry.get("b").invoke(rows).collect()
    assert [r["prediction"] for r in got] == pytest.approx(p, rel=1e-6)
    assert [r["prediction"][1] for r in registry.get("c").invoke(rows).collect()] == pytest.approx(p, rel=1e-6)


def test_endpoint_calls_are_under_way_together_and_answered_in_order(spark, tmp_path):
    log = tmp_path / "log"

    def client():
        lock, state = threading.Lock(), {"now": 0, "most": 0, "failed": set()}

        def ask(text):
            n = int(text.split()[0])
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                log.write_text(str(state["most"]))
            try:
                time.sleep(0.05 * (3 - n % 3))  # later requests end earlier
                if n % 5 == 0 and n not in state["failed"]:
                    state["failed"].add(n)
                    raise OSError("busy")
                return {"data": [{"y": n * 2}]}
            finally:
                with lock:
                    state["now"] -= 1

        return ask

    rows = spark.range(20).coalesce(1)
    model = models.EndpointModel(client, ["id"], "data", "y long", batch_rows=1, in_flight=4, retries=1, backoff_seconds=0.01)
    assert [r["y"] for r in model.invoke(rows).collect()] == [2 * i for i in range(20)]
    assert int(log.read_text()) == 4
    with pytest.raises(Exception, match="busy"):
        models.EndpointModel(client, ["id"], "data", "y long", 1, retries=0).invoke(rows).collect()
    began = time.monotonic()
    models.EndpointModel(client, ["id"], "data", "y long", 1, in_flight=8, backoff_seconds=0.01, per_second=10).invoke(rows).collect()
    assert time.monotonic() - began >= 1.8
    with pytest.raises(ValueError):
        models.EndpointModel(client, ["id"], "data", "y long", in_flight=0)


def brute_density(model, row):
    """(label, strength) of one row, from the meaning."""
    n = len(model.points)
    if any(x != x for x in row):
        return -1, 0.0
    apart = sorted((math.dist(row, p), i) for i, p in enumerate(model.points.tolist()))[: 2 * model.min_samples]
    own = apart[model.min_samples][0]
    reach, _, near = min((max(d, own, model.core[i]), k, i) for k, (d, i) in enumerate(apart))
    density = 1 / reach if reach else float("inf")
    cluster = model.parent[near]
    while model.birth[near] > density and cluster != model.root and model.birth[cluster] >= density:
        cluster = model.parent[cluster]
    label = int(model.label[cluster])
    most = max([model.birth[i] for i in range(n) if model.label[model.parent[i]] == label], default=0)
    return label, 0.0 if label < 0 else min(density, most) / most if most else 1.0


def test_density_clusters_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 2, 4)] + [rng.uniform(-3, 7, (20, 3))])
    n = len(points)
    edges = [[n, n + 1, 0.5], [n, n + 2, 0.5], [n + 1, n + 3, 0.9], [n + 1, n + 4, 0.9]] + [[n + (3, 4, 2)[i // 40] if i < 120 else n, i, rng.uniform(1, 4)] for i in range(n)]
    model = DensityClusters(points, core_distances(points, 4), edges, {n + 3: 0, n + 4: 1, n + 2: 2}, 4)
    rows = np.concatenate([points[::7], rng.uniform(-4, 8, (200, 3)), [[np.nan, 0, 0]]])
    want = [brute_density(model, r.tolist()) for r in rows]
    for size in (2048, 5):
        monkeypatch.setattr("folio.operators.density.BLOCK", size)
        labels, strengths = model.assigned(rows)
        assert labels.tolist() == [x for x, _ in want] and np.allclose(strengths, [x for _, x in want])
    assert set(labels) == {-1, 0, 1, 2} and model.assigned(rows[:0])[0].tolist() == []
    same = DensityClusters.of_json(json.dumps({"points": points.tolist(), "core_distances": model.core.tolist(), "edges": edges, "labels": {n + 3: 0, n + 4: 1, n + 2: 2}, "min_samples": 4}).encode())
    assert same.predict(pd.DataFrame(rows))[0].tolist() == labels.tolist()
    for odd in (b"{}", b"\x80pickle"):
        with pytest.raises(ModelError):
            DensityClusters.of_json(odd)
    with pytest.raises(ModelError):
        model.assigned(rows[:, :2])
