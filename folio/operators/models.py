"""Models as joins and vectorised functions, and the registry that names them.

Loaders of serialised models are passed in by the caller: reading a pickle runs
code, so nothing here does it by itself.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.errors import ModelError
from folio.functions.keys import join_key
from folio.operators.boosted import Booster
from folio.operators.density import DensityClusters


def find_model(models: Sequence[Mapping], wanted: Mapping) -> Mapping | None:
    """The one entry that equals ``wanted`` but for its key; None if there is none."""
    found = [m for m in models if {k: v for k, v in m.items() if k != "key"} == dict(wanted)]
    if len(found) > 1:
        raise ModelError(f"{len(found)} entries match {dict(wanted)}")
    return found[0] if found else None


def matching_rows(models: DataFrame, wanted: Mapping[str, Any]) -> DataFrame:
    """The rows whose columns equal ``wanted``, null equal to null: ``find_model`` over a table."""
    for name, value in wanted.items():
        models = models.where(F.col(name).eqNullSafe(F.lit(value)))
    return models


class Model(Protocol):
    """What a registry entry becomes."""

    def invoke(self, *args: Any, **kw: Any) -> Any: ...


def artifact_path(entry: Mapping) -> str:
    """The address of an entry's artifact: its bucket as a path or URL, and its key."""
    return join_key(str(entry.get("bucket", "")).rstrip("/"), entry["key"])


class TableModel:
    """A lookup table, read once; ``join`` adds its columns to rows."""

    def __init__(self, spark: SparkSession, entry: Mapping) -> None:
        self._spark, self.entry, self._table = spark, entry, None

    def invoke(self) -> DataFrame:
        if self._table is None:
            kind = self.entry.get("res_type", "application/x-parquet")
            path = artifact_path(self.entry)
            if kind == "text/csv":
                self._table = self._spark.read.csv(path, header=True, inferSchema=self.entry.get("schema") is None, schema=self.entry.get("schema"))
            elif kind == "application/x-parquet":
                self._table = self._spark.read.parquet(path)
            else:
                raise ModelError(f"a table of type {kind} cannot be read")
        return self._table

    def join(self, rows: DataFrame, on: str | list[str]) -> DataFrame:
        """Left join; Spark broadcasts the table if its size allows."""
        return rows.join(self.invoke(), on, "left")


class TableSetModel:
    """Lookup tables of which one is selected by its attributes."""

    def __init__(self, spark: SparkSession, entry: Mapping) -> None:
        self._spark, self.entry, self._chosen = spark, entry, None

    @property
    def tables(self) -> Sequence[Mapping]:
        return self.entry["models"]

    def select(self, wanted: Mapping) -> Mapping | None:
        """Chooses the table; may be called once."""
        if self._chosen is not None:
            raise ModelError("a table is selected already")
        self._chosen = (find_model(self.tables, wanted),)
        return self._chosen[0]

    def invoke(self) -> DataFrame | None:
        """The selected table, or None if none matched."""
        if self._chosen is None:
            raise ModelError("select a table first")
        one = self._chosen[0]
        if one is None:
            return None
        path = join_key(str(self.entry.get("bucket", "")).rstrip("/"), self.entry.get("prefix"), f"{one['key']}.{self.entry.get('ext', 'parquet')}")
        return self._spark.read.parquet(path)


class MapModel:
    """A JSON object as a lookup from text keys; what is absent is null. Values keep their type."""

    def __init__(self, spark: SparkSession, entry: Mapping) -> None:
        if entry.get("res_type", "application/json") != "application/json":
            raise ModelError("a map is read from JSON only")
        self._spark, self.entry, self._pairs = spark, entry, None

    def pairs(self) -> DataFrame:
        """(k, v), with values as variants."""
        if self._pairs is None:
            whole = self._spark.read.text(artifact_path(self.entry), wholetext=True)
            self._pairs = whole.select(F.explode(F.from_json("value", "map<string,variant>")).alias("k", "v"))
        return self._pairs

    def invoke(self, key: Any) -> Any:
        row = self.pairs().where(F.col("k") == str(key)).select(F.to_json("v").alias("v")).first()
        return json.loads(row["v"]) if row and row["v"] is not None else None

    def join(self, rows: DataFrame, key: Column, name: str, kind: str = "string") -> DataFrame:
        """``rows`` with the looked-up value as column ``name`` of the type ``kind``; null where it has another type."""
        pairs = self.pairs().select(F.col("k").alias("_map_key"), F.try_variant_get("v", "$", kind).alias(name))
        return rows.join(pairs, key.cast("string") == pairs["_map_key"], "left").drop("_map_key")


class ScoringModel:
    """A fitted model applied to batches of rows: ``load`` runs once in each task.

    ``categories`` has the values of the columns that the model takes as
    categorical, in the order it knows them by.
    """

    def __init__(self, load: Callable[[], Any], columns: Sequence[str], method: str = "predict", result: str = "double", categories: Mapping[str, Sequence] | None = None) -> None:
        self._load, self.columns, self.method, self.result, self.categories = load, list(columns), method, result, dict(categories or {})

    def invoke(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """``rows`` with the prediction; ``result`` is 'double', 'int' or, for rows of probabilities, 'array<double>'."""
        load, columns, method, nested, categories = self._load, self.columns, self.method, self.result.startswith("array"), self.categories

        @F.pandas_udf(self.result)
        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                frame = batch[columns].assign(**{c: pd.Categorical(batch[c], categories=list(v)) for c, v in categories.items()})
                out = getattr(model, method)(frame)
                out = out[0] if isinstance(out, tuple) else out  # labels without their strengths
                yield pd.Series([list(x) for x in out]) if nested else pd.Series(out)

        return rows.withColumn(name, predict(F.struct(*columns)))


class ScoringSetModel:
    """Fitted models of which one is selected by its attributes."""

    def __init__(self, models: Sequence[Mapping], load: Callable[[Mapping], Any], columns: Sequence[str], method: str = "predict", result: str = "double", categories: Mapping[str, Sequence] | None = None) -> None:
        self.models, self._load, self._rest, self._chosen = models, load, (columns, method, result, categories), None

    def select(self, wanted: Mapping) -> Mapping | None:
        if self._chosen is not None:
            raise ModelError("a model is selected already")
        self._chosen = (find_model(self.models, wanted),)
        return self._chosen[0]

    def invoke(self, rows: DataFrame, name: str = "prediction") -> DataFrame | None:
        if self._chosen is None:
            raise ModelError("select a model first")
        if self._chosen[0] is None:
            return None
        load, entry = self._load, self._chosen[0]
        return ScoringModel(lambda: load(entry), *self._rest).invoke(rows, name)


class EndpointModel:
    """A remote scorer: rows go as CSV without a header, the answer is JSON.

    ``make_client`` is called once in each task and gives a function from the
    CSV text to the decoded answer, which is called from several threads;
    ``answer_key`` names the list of records in it. A task has up to
    ``in_flight`` requests under way, begins at most ``per_second`` a second,
    and yields answers in the order of the rows, so that it holds so many
    batches of rows and no more. A request that raises is tried again
    ``retries`` times, after ``backoff_seconds``, twice as long each time.
    """

    def __init__(
        self,
        make_client: Callable[[], Callable[[str], Mapping]],
        columns: Sequence[str],
        answer_key: str,
        schema: str,
        batch_rows: int = 1000,
        in_flight: int = 4,
        retries: int = 2,
        backoff_seconds: float = 0.5,
        per_second: float | None = None,
    ) -> None:
        if in_flight < 1 or retries < 0 or batch_rows < 1:
            raise ValueError("in_flight and batch_rows must be 1 or more, retries 0 or more")
        self.make_client, self.columns, self.answer_key, self.schema, self.batch_rows = make_client, list(columns), answer_key, schema, batch_rows
        self.in_flight, self.retries, self.backoff_seconds, self.per_second = in_flight, retries, backoff_seconds, per_second

    def invoke(self, rows: DataFrame) -> DataFrame:
        make, key, size = self.make_client, self.answer_key, self.batch_rows
        in_flight, retries, backoff, gap = self.in_flight, self.retries, self.backoff_seconds, 1 / self.per_second if self.per_second else 0.0

        def asked(ask: Callable[[str], Mapping], text: str) -> pd.DataFrame:
            for left in range(retries, -1, -1):
                try:
                    return pd.DataFrame(ask(text)[key])
                except Exception:
                    if not left:
                        raise
                    time.sleep(backoff * 2 ** (retries - left))
            raise AssertionError

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask, next_at = make(), 0.0
            under_way: deque[Future] = deque()
            with ThreadPoolExecutor(in_flight) as pool:
                try:
                    for batch in batches:
                        for at in range(0, len(batch), size):
                            if len(under_way) == in_flight:
                                yield under_way.popleft().result()
                            time.sleep(max(0.0, next_at - time.monotonic()))
                            next_at = time.monotonic() + gap
                            under_way.append(pool.submit(asked, ask, batch.iloc[at : at + size].to_csv(header=False, index=False)))
                    while under_way:
                        yield under_way.popleft().result()
                finally:
                    for f in under_way:  # what has not begun does not begin
                        f.cancel()

        return rows.select(*self.columns).mapInPandas(call, self.schema)


#: Fitted models by their type, with the method that scores and the type of a score.
FITTED = {
    "MiniBatchKMeans": ("predict", "int"),
    "SGDClassifier": ("predict_proba", "array<double>"),
    "hdbscan": ("predict", "int"),
    "XGBClassifier": ("predict_proba", "array<double>"),
    "Booster": ("predict", "double"),
}
#: What can be loaded without running code from the artifact.
LOADERS = {"XGBClassifier": Booster, "Booster": Booster, "hdbscan": DensityClusters.of_json}


class Registry:
    """Models by name, each a list of versions of which the first counts.

    ``loaders`` turn an artifact's bytes into the fitted model, by its
    ``model_type``; types whose artifacts are pickles have none by themselves.
    ``make_endpoint`` turns an entry into what ``EndpointModel`` calls in each
    task to get its client. ``kinds`` adds kinds or replaces them.
    """

    def __init__(
        self,
        spark: SparkSession,
        models: Mapping[str, Sequence[Mapping]] | None = None,
        kinds: Mapping[str, Callable[[SparkSession, Mapping], Model]] | None = None,
        loaders: Mapping[str, Callable[[bytes], Any]] | None = None,
        make_endpoint: Callable[[Mapping], Callable[[str], Mapping]] | None = None,
    ) -> None:
        if models is not None and not isinstance(models, Mapping):
            raise TypeError("models must be a mapping from names to versions")
        self._spark, self._models, self._loaders, self._make_endpoint = spark, models or {}, LOADERS | dict(loaders or {}), make_endpoint
        # The kinds' names in registries that exist.
        self._kinds: dict[str, Callable] = {
            "s3_dataframe": TableModel,
            "s3_dataframe_set": TableSetModel,
            "s3_hashmap": MapModel,
            "s3_scikit": self._fitted,
            "s3_xgboost": self._fitted,
            "s3_scikit_set": self._fitted_set,
            "sagemaker_endpoint": self._endpoint,
        }
        self._kinds |= {"dataframe": TableModel, "dataframe_set": TableSetModel, "hashmap": MapModel, "fitted": self._fitted, "fitted_set": self._fitted_set, "endpoint": self._endpoint} | dict(kinds or {})

    def _loader(self, entry: Mapping) -> tuple[Callable[[bytes], Any], str, str]:
        kind = entry.get("model_type")
        if kind not in FITTED or kind not in self._loaders:
            raise ModelError(f"fitted models of the type {kind} need a loader" if kind in FITTED else f"unknown model type {kind}")
        return self._loaders[kind], *FITTED[kind]

    def _read(self, path: str) -> Any:
        """The artifact's bytes, sent to each executor once; fitted models fit in memory."""
        row = self._spark.read.format("binaryFile").load(path).select("content").first()
        return self._spark.sparkContext.broadcast(bytes(row["content"]))

    def _fitted(self, spark: SparkSession, entry: Mapping) -> ScoringModel:
        load, method, result = self._loader(entry)
        body, given = self._read(artifact_path(entry)), entry.get("parameters", {})
        return ScoringModel(lambda: load(body.value), given.get("columns", []), method, result, given.get("categories"))

    def _fitted_set(self, spark: SparkSession, entry: Mapping) -> ScoringSetModel:
        load, method, result = self._loader(entry)
        root, given = str(entry.get("bucket", "")).rstrip("/"), entry.get("parameters", {})
        # read when one is selected, and once for it
        bodies: dict[str, Any] = {}

        class Set(ScoringSetModel):
            def invoke(inner, rows: DataFrame, name: str = "prediction") -> DataFrame | None:  # noqa: N805
                if inner._chosen and inner._chosen[0] and not bodies:
                    key = inner._chosen[0]["key"]
                    bodies[key] = self._read(join_key(root, entry.get("prefix"), f"{key}.{entry.get('extension', 'pkl')}"))
                if not bodies:
                    return super().invoke(rows, name)
                (body,) = bodies.values()
                return ScoringModel(lambda: load(body.value), *inner._rest).invoke(rows, name)

        return Set(entry.get("scikits", entry.get("models", [])), load, given.get("columns", []), method, result, given.get("categories"))

    def _endpoint(self, spark: SparkSession, entry: Mapping) -> EndpointModel:
        if (entry.get("req_type"), entry.get("res_type")) != ("text/csv", "application/json"):
            raise ModelError("an endpoint takes CSV and answers in JSON")
        if self._make_endpoint is None:
            raise ModelError("endpoints need make_endpoint")
        make, given = self._make_endpoint, entry.get("parameters", {})
        return EndpointModel(lambda: make(entry), given.get("columns", []), entry.get("res_key", "data"), given["schema"], **{k: given[k] for k in ("batch_rows", "in_flight", "retries", "backoff_seconds", "per_second") if k in given})

    def version(self, name: str) -> Mapping:
        versions = self._models.get(name)
        if not versions:
            raise ModelError(f"no model {name}")
        return versions[0]

    def get(self, name: str) -> Model:
        """The model of that name, of its first version."""
        entry = self.version(name)
        if entry.get("type") not in self._kinds:
            raise ModelError(f"model {name} is of the unknown type {entry.get('type')}")
        return self._kinds[entry["type"]](self._spark, entry)


def first_versions(versions: DataFrame, name_col: str, order_col: str) -> DataFrame:
    """The first version of each name in a table of versions: one aggregation instead of a sort of each group."""
    first = F.min_by(F.struct(*versions.columns), order_col).alias("v")
    return versions.groupBy(F.col(name_col).alias("_name")).agg(first).select("v.*")
