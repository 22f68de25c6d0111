"""The library's own queries over the test tables, with their SQL twins.

Nations are the objects of a collection that is written from the tables: their
header, customers, orders and suppliers are its channels, and the queries of
catalogs and datasets run the library on it. Others take orders for objects,
with keys ``dataset/<year>/<orderkey>``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.errors import ForceAcknowledge
from folio.functions.columns import date_between, key_column, logistic, message_content, nearest, tree
from folio.operators.boosted import saved_booster
from folio.operators.density import core_distances
from folio.operators.models import Registry, ScoringModel, first_versions, matching_rows
from folio.operators.paging import PageLimits, assign_pages, page_summary
from folio.operators.sets import remaining_keys, rows_per_key, union_by_name
from folio.plans.format import NAME as DATASET
from folio.plans.format import write_dataset
from folio.plans.library import Library, header_of, selected
from folio.plans.manifest import UNITS, pages_frame, total_timings
from folio.sources.catalog import ObjectReader
from folio.sources.collection import write_collection
from folio.sources.files import Files
from folio.sources.revisions import latest_revision
from folio.sources.scratch import new_path, stored
from folio.streaming.queue import MESSAGE, QueueConsumer, handled, json_translator

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_key(orderkey: Column, date: Column) -> Column:
    return key_column(F.lit("dataset"), F.year(date).cast("string"), F.lpad(orderkey.cast("string"), 9, "0"))


_KEY = "'dataset/' || year(o_orderdate) || '/' || lpad(o_orderkey::VARCHAR, 9, '0')"


def _header(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return header_of(orders, _order_key(F.col("o_orderkey"), F.col("o_orderdate")), F.col("o_orderkey"))


KIND = "nation"
NAME = "orders.2024-01-01,2025-01-01"
_NATION = "'nation/' || n_regionkey || '/' || lpad(n_nationkey::VARCHAR, 2, '0') || '/nation'"
_BY_NATION = f"(SELECT {_NATION} AS key, * FROM nation)"
_ORDERS = f"{_BY_NATION} n JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"
_roots: dict[tuple[str, str], str] = {}


def _library(spark: SparkSession, sf_dir: str) -> Library:
    """A library over the collection of nations, which is written once a session, with its header."""
    at = (spark.sparkContext.applicationId, sf_dir)
    fresh = at not in _roots or not Files(spark).exists(_roots[at])
    if fresh:
        root = new_path(spark, "collection")
        nation = _read(spark, sf_dir, "nation")
        key = key_column(F.lit(KIND), F.col("n_regionkey").cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(KIND))
        objects = nation.select(key.alias("key"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), "n_nationkey")
        customers = _read(spark, sf_dir, "customer").join(objects, F.col("c_nationkey") == F.col("n_nationkey"))
        orders = _read(spark, sf_dir, "orders").join(customers.select("key", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        channels = {
            "header": nation.withColumn("key", key).select("key", "n_nationkey", "n_name", "n_regionkey"),
            "customer": customers.select("key", "c_custkey", "c_name", "c_acctbal", "c_mktsegment"),
            "order": orders.select("key", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"),
            "supplier": _read(spark, sf_dir, "supplier").join(objects, F.col("s_nationkey") == F.col("n_nationkey")).select("key", "s_suppkey", "s_acctbal"),
        }
        write_collection(spark, f"{root}/objects", KIND, objects, channels)
        _roots[at] = root
    library = Library(spark, f"{_roots[at]}/datasets", f"{_roots[at]}/objects", KIND)
    if fresh:
        library.create_header()
    return library


@query(f"""SELECT key, channel, key || '|' || channel AS place FROM (
  SELECT key, unnest(['header', 'customer', 'order', 'supplier']) AS channel, n_nationkey FROM {_BY_NATION} n)
  WHERE channel = 'header' OR channel = 'customer' AND n_nationkey IN (SELECT c_nationkey FROM customer) OR channel = 'supplier' AND n_nationkey IN (SELECT s_nationkey FROM supplier)
    OR channel = 'order' AND n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey)""")
def catalog_scan(spark, sf_dir):
    """Manifests of all objects, and the channels that each has."""
    channels = _library(spark, sf_dir).catalog.channels()
    return channels.select(F.col("object_key").alias("key"), "channel", F.concat_ws("|", "object_key", F.element_at(F.split("path_key", "/"), -1)).alias("place"))


@query(f"SELECT DISTINCT key, 'n' || n_nationkey AS id FROM {_BY_NATION} n")
def distinct_keys(spark, sf_dir):
    """Objects are discovered by their manifests, each once."""
    return _library(spark, sf_dir).catalog.manifests().select("key", "id")


@query(f"SELECT key, 'n' || n_nationkey AS object_id, c_custkey, c_acctbal FROM {_BY_NATION} n JOIN customer ON c_nationkey = n_nationkey")
def channel_scan_projected(spark, sf_dir):
    """A channel of all objects with the columns of an instruction only."""
    return _library(spark, sf_dir).catalog.channel({"channel": "customer", "columns": ["c_custkey", "c_acctbal"]})


@query(f"SELECT key, 'n' || n_nationkey AS object_id, o_orderkey, o_custkey, o_totalprice FROM {_ORDERS}")
def instructions_merged_projection(spark, sf_dir):
    """Two instructions for a channel read the union of their columns once."""
    asked = [{"channel": "order", "columns": ["o_orderkey", "o_custkey"]}, {"channel": "order", "columns": ["o_totalprice", "o_orderkey"]}]
    return _library(spark, sf_dir).catalog.read(asked)["order"]


@query(f"SELECT key, 'n' || n_nationkey AS object_id, s_suppkey, s_acctbal FROM {_BY_NATION} n JOIN supplier ON s_nationkey = n_nationkey")
def channel_scan_all_columns(spark, sf_dir):
    """An instruction without columns reads all; objects that lack the channel have no rows."""
    return _library(spark, sf_dir).catalog.read([{"channel": "supplier", "columns": ["s_suppkey"]}, "supplier"])["supplier"]


@query(f"SELECT key, 'n' || n_nationkey AS object_id, o_orderkey, o_orderstatus FROM {_ORDERS} WHERE n_regionkey IN (1, 3)")
def channel_scan_of_keys(spark, sf_dir):
    """A channel of some objects: only their files are scanned."""
    library = _library(spark, sf_dir)
    keys = library.dataframe("header").where("n_regionkey in (1, 3)").select("key")
    return library.catalog.channel({"channel": "order", "columns": ["o_orderkey", "o_orderstatus"]}, keys)


@query(f"SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM {_BY_NATION} n JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey = 7")
def object_channel(spark, sf_dir):
    """One object's channel, by its manifest."""
    library = _library(spark, sf_dir)
    key = library.dataframe("header").where("n_nationkey = 7").select("key").first()["key"]
    return ObjectReader(spark, library.object_root, key).channel("customer")


@query(f"SELECT n_nationkey, n_name, n_regionkey, key, 'n' || n_nationkey AS match_id FROM {_BY_NATION} n")
def header_dataset(spark, sf_dir):
    """The dataset of header rows of all objects, with key and id."""
    return _library(spark, sf_dir).header_reader().dataframe()


@query(f"SELECT key, n_name FROM {_BY_NATION} n WHERE n_regionkey > 1 AND n_name LIKE '%I%'")
def subheader_dataset(spark, sf_dir):
    """A dataset of the header rows that a selector takes."""
    library = _library(spark, sf_dir)
    made = library.create_subheader("some.2024-01-01,2025-01-01", lambda df: (df["n_regionkey"] > 1) & df["n_name"].like("%I%"))
    return made.dataframe().select("key", "n_name")


@query(f"SELECT {_KEY} AS key, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def subheader_filter(spark, sf_dir):
    """The rows that a selector takes; the condition reaches the scan."""
    return selected(_header(spark, sf_dir), lambda df: (df["o_totalprice"] > 300000) & (df["o_orderstatus"] == "F")).select("key", "o_totalprice")


def _large_orders(channels):
    """What the datasets below are made of; four in five objects are left without rows by the second condition."""
    return channels["order"].where("o_totalprice > 100000").select("key", "o_orderkey", (F.col("o_totalprice") / 2).alias("half"))


_LARGE = f"SELECT key, o_orderkey, o_totalprice / 2 AS half FROM {_ORDERS} WHERE o_totalprice > 100000"
LIMITS = PageLimits(max_rows=400, check_every=3)


def _built(spark: SparkSession, sf_dir: str, **options):
    library = _library(spark, sf_dir)
    builder = library.builder(NAME, instructions=[{"channel": "order", "columns": ["o_orderkey", "o_totalprice"]}], limits=LIMITS, **options)
    return library, builder


@query(_LARGE)
def data_dataset_build(spark, sf_dir):
    """A dataset of a transform over the channels of all objects, read back whole."""
    _, builder = _built(spark, sf_dir, if_complete="overwrite", if_partial="overwrite")
    return builder.build(_large_orders).dataframe()


@query("SELECT key, key_ord, page FROM (SELECT key, key_ord, page FROM assigned)")
def build_resume(spark, sf_dir):
    """A build in small chunks that breaks off and is taken up again: the keys of its pages are those of one build."""
    _, builder = _built(spark, sf_dir, if_complete="overwrite", if_partial="overwrite", chunk_keys=7)
    chunks = []

    def breaks(channels):
        chunks.append(1)
        if len(chunks) == 3:
            raise InterruptedError
        return _large_orders(channels)

    try:
        builder.build(breaks)
    except InterruptedError:
        pass
    library, again = _built(spark, sf_dir, if_complete="pass", chunk_keys=7)
    reader = again.build(_large_orders)
    pages = [keys.select("key", "key_ord", F.lit(n).cast("long").alias("page")) for n, (_, keys) in enumerate(reader.pages())]
    return union_by_name(pages)


@query("SELECT key, o_orderkey, half FROM large JOIN (SELECT key, page FROM assigned) USING (key) WHERE page = 1")
def iterate_page_n(spark, sf_dir):
    """The rows of one page of a dataset; only its files are read."""
    _, builder = _built(spark, sf_dir, if_complete="pass")
    rows, _ = builder.build(_large_orders).page(1)
    return rows


@query("SELECT key, key_ord FROM assigned")
def keyset_concat(spark, sf_dir):
    """The keys of all pages of a dataset, one after the other."""
    _, builder = _built(spark, sf_dir, if_complete="pass")
    return builder.build(_large_orders).keys()


@query("SELECT page, count(*) AS n_keys, sum(n_rows)::BIGINT AS n_rows FROM assigned GROUP BY page")
def manifest_pages(spark, sf_dir):
    """What the manifest has of each page."""
    _, builder = _built(spark, sf_dir, if_complete="pass")
    return pages_frame(spark, builder.build(_large_orders).manifest).drop("seconds")


@query("SELECT n_nationkey, n_name, n_regionkey, key, 'n' || n_nationkey AS match_id FROM (SELECT *, row_number() OVER (ORDER BY key) - 1 AS i FROM " + _BY_NATION + ") WHERE i = 11")
def match_by_index(spark, sf_dir):
    """The header row of the object at a position in key order."""
    library = _library(spark, sf_dir)
    key = library.object_at(11).manifest["key"]
    return library.dataframe("header").where(F.col("key") == key)


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::BIGINT AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def union_missing_columns(spark, sf_dir):
    """Frames of different columns united by name."""
    a = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))
    return union_by_name([a, b]).select("id", "name", "balance", "nation")


@query("SELECT o_orderkey AS key, count(l_orderkey) AS n_rows FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def keyset_with_empty_keys(spark, sf_dir):
    """Rows of every key, those without rows included."""
    keys = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return rows_per_key(keys, _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")))


@query("SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")
def resume_difference(spark, sf_dir):
    """The distinct keys that are still to be done."""
    done = _read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"))
    return remaining_keys(_read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), done)


_COUNTS = "SELECT lpad(o_orderkey::VARCHAR, 9, '0') AS key, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"


def _pages_sql(limit: float, every: int, out: str, counts: str = _COUNTS) -> str:
    """The fold as a recursive query, a page a step."""
    return f"""
WITH RECURSIVE large AS ({_LARGE}),
counts AS ({counts}),
k AS (SELECT key, n, row_number() OVER (ORDER BY key) - 1 AS i, sum(n) OVER (ORDER BY key) AS total FROM counts),
cut(page, first, base) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::HUGEINT
  UNION ALL
  SELECT c.page + 1, e.i + 1, e.total FROM cut c, LATERAL (SELECT k.i, k.total FROM k WHERE k.i >= c.first AND (k.i - c.first + 1) % {every} = 0 AND k.total - c.base > {limit} ORDER BY k.i LIMIT 1) e
),
pages AS (SELECT page, first, lead(first) OVER (ORDER BY page) AS until FROM cut),
assigned AS (SELECT k.key, k.n::BIGINT AS n_rows, k.i::BIGINT AS key_ord, p.page FROM k JOIN pages p ON k.i >= p.first AND (p.until IS NULL OR k.i < p.until))
{out}
"""


def _order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lpad(F.col("key").cast("string"), 9, "0").alias("key")
    return keyset_with_empty_keys(spark, sf_dir).select(key, "n_rows")


@query(_pages_sql(5000, 100, "SELECT key, n_rows, key_ord, page FROM assigned"))
def page_assignment_rows(spark, sf_dir):
    """Pages of more than 5000 rows are closed, looked at every 100 keys."""
    return assign_pages(_order_counts(spark, sf_dir), PageLimits(max_rows=5000))


for _name in ("build_resume", "iterate_page_n", "keyset_concat", "manifest_pages"):
    ORACLES[_name] = _pages_sql(LIMITS.max_rows, LIMITS.check_every, ORACLES[_name], f"SELECT n.key, count(o_orderkey) AS n FROM {_BY_NATION} n LEFT JOIN large USING (key) GROUP BY n.key")


@query(_pages_sql(0.4 * 1024 * 1024 / 96, 50, "SELECT key, n_rows, key_ord, page FROM assigned"))
def page_assignment_size(spark, sf_dir):
    """Pages of more than 0.4 MB are closed: rows of eleven eight-byte columns and a position."""
    return assign_pages(_order_counts(spark, sf_dir), PageLimits(max_mb=0.4, check_every=50), bytes_per_row=96)


@query(_pages_sql(2000, 7, "SELECT key, n_rows, key_ord, page FROM assigned"))
def page_assignment_freq(spark, sf_dir):
    """The limit is looked at after every seventh key of a page only."""
    return assign_pages(_order_counts(spark, sf_dir), PageLimits(max_rows=2000, check_every=7))


@query(_pages_sql(5000, 100, "SELECT page, count(*) AS n_keys, sum(n_rows)::BIGINT AS n_rows FROM assigned GROUP BY page"))
def page_summary_rows(spark, sf_dir):
    """Keys and rows of each page."""
    return page_summary(page_assignment_rows(spark, sf_dir))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def revision_date_range(spark, sf_dir):
    """Rows whose comment's day is in a half-open range."""
    events = _read(spark, sf_dir, "events").withColumn("comment", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return events.where(date_between(F.col("comment"), "2024-01-05", "2024-01-20")).select("event_id", "ts")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, lpad(event_id::VARCHAR, 12, '0') DESC LIMIT 1")
def latest_revision_row(spark, sf_dir):
    """The revision that was published last."""
    events = _read(spark, sf_dir, "events")
    number = F.lpad(F.col("event_id").cast("string"), 12, "0")
    last = latest_revision(events.select(number.alias("revision_id"), F.col("ts").alias("created_at")))
    return events.where(number == last).select("event_id", "ts")


@query("SELECT p_brand, p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1")
def model_version_pick(spark, sf_dir):
    """The first version of each model in a table of versions."""
    return first_versions(_read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey")


def _models(spark: SparkSession, sf_dir: str) -> Registry:
    """A registry of lookups whose artifacts are made of the tables."""
    root = new_path(spark, "models")
    _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type").write.parquet(f"{root}/part.parquet")
    regions = _read(spark, sf_dir, "region").where("r_regionkey != 2")
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), "r_name")))
    regions.agg(F.to_json(pairs).alias("value")).coalesce(1).write.text(f"{root}/regions.json")
    return Registry(spark, {
        "parts": [{"type": "dataframe", "bucket": root, "key": "part.parquet"}, {"type": "odd"}],
        "regions": [{"type": "hashmap", "bucket": root, "key": "regions.json"}],
    })


@query("SELECT n_nationkey, n_name, r_name AS looked_up FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2")
def lookup_hashmap(spark, sf_dir):
    """A value for each key of a JSON map, null where it has none."""
    nation = _read(spark, sf_dir, "nation")
    return _models(spark, sf_dir).get("regions").join(nation, F.col("n_regionkey"), "looked_up").select("n_nationkey", "n_name", "looked_up")


@query("SELECT l_orderkey, l_linenumber, p_brand, p_type FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def lookup_dataframe(spark, sf_dir):
    """A lookup table's columns on every row; its size decides how it is joined."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return _models(spark, sf_dir).get("parts").join(rows, "l_partkey").select("l_orderkey", "l_linenumber", "p_brand", "p_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand IS NOT DISTINCT FROM 'Brand#2' AND p_size IS NOT DISTINCT FROM 11")
def select_from_set(spark, sf_dir):
    """The entries that equal a filter."""
    return matching_rows(_read(spark, sf_dir, "part"), {"p_brand": "Brand#2", "p_size": 11}).select("p_partkey", "p_name")


#: Fixed points that stand for a fitted model's centroids, over the first four dimensions.
CENTROIDS = [[0.5, 0.5, 0.5, 0.5], [-0.5, 0.5, -0.5, 0.5], [0.0, -0.5, 0.5, -0.5], [0.25, 0.0, -0.25, 0.0]]
_DISTANCES = ", ".join("(" + " + ".join(f"(embedding[{j + 1}]::DOUBLE - ({x}))**2" for j, x in enumerate(c)) + ")" for c in CENTROIDS)


@query(f"SELECT vec_id, (list_position(d, list_min(d)) - 1)::INTEGER AS cluster FROM (SELECT vec_id, [{_DISTANCES}] AS d FROM embeddings)")
def kmeans_assign(spark, sf_dir):
    """The nearest centroid of each vector."""
    return _read(spark, sf_dir, "embeddings").select("vec_id", nearest(F.slice("embedding", 1, 4), CENTROIDS).alias("cluster"))


@query("SELECT o_orderkey, round(1 / (1 + exp(-(-1.5 + 0.00001 * o_totalprice - 0.0002 * o_custkey))), 6) AS score FROM orders")
def logistic_score(spark, sf_dir):
    """The probability of a linear model."""
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.round(logistic({"o_totalprice": 0.00001, "o_custkey": -0.0002}, -1.5), 6).alias("score"))


TREE = {"column": "l_quantity", "below": 24, "yes": {"column": "l_discount", "below": 0.05, "yes": 0.1, "no": 0.3}, "no": {"column": "l_tax", "below": 0.04, "yes": 0.6, "no": 0.9}}


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 24 THEN CASE WHEN l_discount < 0.05 THEN 0.1 ELSE 0.3 END ELSE CASE WHEN l_tax < 0.04 THEN 0.6 ELSE 0.9 END END::DOUBLE AS score FROM lineitem")
def tree_score(spark, sf_dir):
    """A decision tree as an expression."""
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tree(TREE).alias("score"))


class _Linear:
    """A fitted model as a library would give it."""

    def predict(self, frame):
        return 2.0 * frame["l_quantity"] + frame["l_tax"]


@query("SELECT l_orderkey, l_linenumber, 2 * l_quantity + l_tax AS prediction FROM lineitem")
def vectorised_scorer(spark, sf_dir):
    """A fitted model applied to Arrow batches."""
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return ScoringModel(_Linear, ["l_quantity", "l_tax"]).invoke(rows).select("l_orderkey", "l_linenumber", "prediction")


_BODY = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{broken' WHEN 2 THEN 'null' WHEN 3 THEN NULL ELSE '{}' END"


@query(f"SELECT event_id AS message_id, TRY_CAST(({_BODY}) AS JSON) IS NOT NULL AND ({_BODY}) <> 'null' AS has_content, TRY_CAST(json_extract_string(TRY_CAST(({_BODY}) AS JSON), '$.k') AS BIGINT) AS k FROM events")
def message_translate(spark, sf_dir):
    """JSON bodies, some malformed, absent or null, as contents."""
    body = F.expr(_BODY)
    content = message_content(body)
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), content.isNotNull().alias("has_content"), F.try_variant_get(content, "$.k", "bigint").alias("k"))


@query(f"""SELECT event_id::VARCHAR AS message_id, CASE WHEN NOT coalesce(TRY_CAST(({_BODY}) AS JSON) IS NOT NULL AND ({_BODY}) <> 'null', false) THEN CASE WHEN event_type = 'view' THEN 'ack' ELSE 'poison' END
  WHEN event_type = 'click' THEN 'forced_ack' WHEN event_type = 'view' THEN 'ack' WHEN value > 50 THEN 'ack' ELSE 'nack' END AS outcome FROM events""")
def message_routing(spark, sf_dir):
    """What becomes of each message that a handler gets: acknowledged, left, failed or poison."""
    attributes = F.map_from_arrays(F.array(F.lit("type"), F.lit("value")), F.array("event_type", F.col("value").cast("string")))
    events = _read(spark, sf_dir, "events")
    messages = events.select(F.col("event_id").cast("string").alias("MessageId"), F.lit("h").alias("ReceiptHandle"), F.expr(_BODY).alias("Body"), attributes.alias("attributes"))

    def handler(content, metadata):
        given = dict(metadata["attributes"])
        if given["type"] == "click":
            raise ForceAcknowledge
        if given["type"] == "view":
            raise RuntimeError("no")
        return float(given["value"]) > 50

    def on_error(err, raw):
        return dict(raw["attributes"])["type"] == "view"

    return handled(json_translator(messages), handler, on_error).select(F.col("MessageId").alias("message_id"), "outcome")


@query("SELECT sum(s) AS seconds, sum(s) / 60 AS minutes, sum(s) / 3600 AS hours, sum(s) / 86400 AS days FROM (SELECT (l_linenumber * 1.5)::DOUBLE AS s FROM lineitem)")
def timing_totals(spark, sf_dir):
    """Seconds of all pages in four units."""
    pages = _read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * F.lit(1.5)).cast("double").alias("seconds"))
    return total_timings(pages).select(*UNITS)


@query("SELECT c_custkey, concat_ws('/', 'dataset', nullif(c_mktsegment, ''), c_custkey::VARCHAR) AS key FROM customer")
def key_building(spark, sf_dir):
    """Keys of their non-empty parts."""
    return _read(spark, sf_dir, "customer").select("c_custkey", key_column(F.lit("dataset"), F.lit(""), F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("key"))


#: Subheaders that keys are drawn from as well as from the header: a region, and its last nation alone.
REGION, LAST = "region.2024-01-01,2025-01-01", "one.2024-01-01,2025-01-01"


@query(f"""WITH held AS (
  SELECT 'header' AS dataset, key FROM {_BY_NATION} n UNION ALL SELECT '{REGION}', key FROM {_BY_NATION} n WHERE n_regionkey = 4
  UNION ALL SELECT '{LAST}', key FROM {_BY_NATION} n WHERE key = (SELECT max(key) FROM {_BY_NATION} m WHERE m.n_regionkey = 4)),
placed AS (SELECT dataset, key, row_number() OVER (PARTITION BY dataset ORDER BY key) - 1 AS place FROM held),
drawn AS (SELECT dataset, o_orderkey AS seed, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 15))::BIGINT % n AS place FROM orders, (SELECT dataset, count(*) AS n FROM held GROUP BY dataset)),
o AS (SELECT n.key, count(*) AS orders FROM {_ORDERS} GROUP BY n.key)
SELECT dataset, seed, key, n_nationkey IS NOT NULL AS is_key, key IS NOT NULL AS found, 'n' || n_nationkey AS match_id, n_name, coalesce(customers, 0) AS customers, coalesce(orders, 0) AS orders, coalesce(suppliers, 0) AS suppliers
FROM drawn LEFT JOIN placed USING (dataset, place) LEFT JOIN {_BY_NATION} n USING (key) LEFT JOIN o USING (key)
  LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey) USING (n_nationkey)
  LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM supplier GROUP BY s_nationkey) USING (n_nationkey)""")
def random_match(spark, sf_dir):
    """Objects drawn by every order's key as a seed, from the header and from subheaders: the keys, and what each object's manifest and channels hold."""
    library = _library(spark, sf_dir)
    region = library.create_subheader(REGION, "n_regionkey = 4")
    library.create_subheader(LAST, F.col("key") == region.keyset()[-1])
    seeds = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seed"))
    drawn = union_by_name([library.random_objects(seeds, name).withColumn("dataset", F.lit(name)) for name in (library.default_header, REGION, LAST)])
    keys = stored(drawn.select("key").distinct(), "drawn")
    channels = library.catalog.read([{"channel": "header", "columns": ["n_name"]}, *({"channel": c, "columns": []} for c in ("customer", "order", "supplier"))], keys)
    held = channels["header"].select("key", "n_name")
    for name in ("customer", "order", "supplier"):
        held = held.join(channels[name].groupBy("key").agg(F.count("*").alias(f"{name}s")), "key", "left")
    known = _read(spark, sf_dir, "nation").select(key_column(F.lit(KIND), F.col("n_regionkey").cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(KIND)).alias("key"), F.lit(True).alias("known"))
    rows = drawn.join(known, "key", "left").join(held, "key", "left")
    counts = [F.coalesce(f"{name}s", F.lit(0).cast("long")).alias(f"{name}s") for name in ("customer", "order", "supplier")]
    return rows.select("dataset", "seed", "key", F.col("known").isNotNull().alias("is_key"), F.col("key").isNotNull().alias("found"), "match_id", "n_name", *counts)


def _nation_summary(channels):
    """What a user's function makes of all channels of a nation."""
    customers, orders, suppliers = channels["customer"], channels["order"], channels["supplier"]
    by_customer = orders.groupby("o_custkey").size().rename("n").reset_index().sort_values(["n", "o_custkey"], ascending=[False, True])
    known = by_customer.merge(customers, left_on="o_custkey", right_on="c_custkey")
    return pd.DataFrame(
        {
            "customers": [len(customers)],
            "orders": [len(orders)],
            "suppliers": [len(suppliers)],
            "busiest": [known["c_name"].iloc[0] if len(known) else None],
            "largest": [orders["o_totalprice"].max() if len(orders) else None],
            "poorest": [suppliers["s_acctbal"].min() if len(suppliers) else None],
        }
    )


@query(f"""WITH o AS (SELECT n.key, o_custkey, c_name, o_totalprice FROM {_ORDERS}),
ranked AS (SELECT key, o_custkey, any_value(c_name) AS c_name, count(*) AS n FROM o GROUP BY key, o_custkey),
first AS (SELECT key, c_name FROM ranked QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, o_custkey) = 1),
sums AS (SELECT key, count(*) AS orders, max(o_totalprice) AS largest FROM o GROUP BY key)
SELECT n.key, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, coalesce(orders, 0) AS orders,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, c_name AS busiest, largest, (SELECT min(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS poorest
FROM {_BY_NATION} n LEFT JOIN sums USING (key) LEFT JOIN first USING (key)""")
def all_channels_by_key(spark, sf_dir):
    """A dataset of a function of all channels of each object: customers, orders and suppliers of a nation."""
    library = _library(spark, sf_dir)
    builder = library.builder("nations.2024-01-01,2025-01-01", if_complete="overwrite", if_partial="overwrite")
    made = builder.build_by_key(_nation_summary, "customers long, orders long, suppliers long, busiest string, largest double, poorest double", ["customer", "order", "supplier"])
    return made.dataframe().select("key", "customers", "orders", "suppliers", "busiest", "largest", "poorest")


@query(_pages_sql(LIMITS.max_rows, LIMITS.check_every, "SELECT key, o_orderkey, half, page FROM large JOIN (SELECT key, page FROM assigned) USING (key) WHERE page BETWEEN 1 AND 2", f"SELECT n.key, count(o_orderkey) AS n FROM {_BY_NATION} n LEFT JOIN large USING (key) GROUP BY n.key"))
def dataset_format_pages(spark, sf_dir):
    """Some pages of a dataset that was written and is read as a data source; other pages' files are not opened."""
    library = _library(spark, sf_dir)
    keys = library.header_reader().keys().select("key")
    rows = _large_orders({"order": library.catalog.channel({"channel": "order", "columns": ["o_orderkey", "o_totalprice"]})})
    root = new_path(spark, "format")
    write_dataset(rows, keys, root, KIND, NAME, LIMITS)
    return spark.read.format(DATASET).options(root=root, kind=KIND, name=NAME, pages="1-2").load().select("key", "o_orderkey", "half", "page")


#: Trees of a booster over quantity, discount, tax and flag, whose thresholds are no values of the tables.
TREES = [
    {"feature": 0, "below": 24.5, "yes": {"feature": 3, "right_if": [1, 2], "missing": "no", "yes": -0.5, "no": 0.25}, "no": {"feature": 2, "below": 0.035, "missing": "no", "yes": 0.75, "no": -0.25}},
    {"feature": 1, "below": 0.055, "missing": "yes", "yes": 0.5, "no": {"feature": 3, "right_if": [0], "missing": "yes", "yes": 1.25, "no": -1.5}},
    0.125,
]
FLAGS = ["A", "N", "R"]


@query("""SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(
  CASE WHEN l_quantity < 24.5 THEN CASE WHEN l_returnflag IN ('N', 'R') THEN 0.25 ELSE -0.5 END ELSE CASE WHEN l_tax = 0.02 OR l_tax >= 0.035 THEN -0.25 ELSE 0.75 END END
  + CASE WHEN l_discount < 0.055 THEN 0.5 ELSE CASE WHEN l_returnflag = 'A' THEN -1.5 ELSE 1.25 END END + 0.125))), 5) AS prediction FROM lineitem""")
def boosted_score(spark, sf_dir):
    """A booster of numeric and categorical splits, from its JSON, without the library that trains such: a tax of 0.02 counts as missing."""
    root = new_path(spark, "booster")
    Files(spark).publish(f"{root}/b.json", saved_booster(TREES, 4, names=["l_quantity", "l_discount", "l_tax", "l_returnflag"]).decode())
    entry = {"type": "s3_xgboost", "model_type": "Booster", "bucket": root, "key": "b.json", "parameters": {"columns": ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "categories": {"l_returnflag": FLAGS}}}
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount")), F.when(F.col("l_tax") != 0.02, F.col("l_tax")).cast("double").alias("l_tax"), "l_returnflag")
    scored = Registry(spark, {"b": [entry]}).get("b").invoke(rows)
    return scored.select("l_orderkey", "l_linenumber", F.round(F.col("prediction").cast("double"), 5).alias("prediction"))


#: Fixed points that stand for a fitted density model: core points of two dimensions, the tree that they hang in, and the labels of chosen clusters.
CORE_POINTS = [[0.1, 0.1], [0.15, 0.05], [0.05, 0.2], [0.2, 0.2], [0.5, 0.1], [0.55, 0.2], [0.45, 0.15], [0.3, -0.1], [-0.4, -0.3], [-0.45, -0.2], [-0.3, -0.35], [-0.9, 0.9]]
CORE_EDGES = [[12, 13, 1.2], [12, 14, 1.2], [13, 15, 3.0], [13, 16, 3.0], *([15, i, 8.0] for i in range(4)), *([16, i, 7.0] for i in range(4, 7)), [13, 7, 2.0], *([14, i, 5.0] for i in range(8, 11)), [12, 11, 0.9]]
CORE_LABELS = {15: 0, 16: 1, 14: 2}
MIN_SAMPLES = 2
_CORES = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(CORE_POINTS))
_EDGES = ", ".join(f"({p}, {c}, {v}::DOUBLE)" for p, c, v in CORE_EDGES)
_UP = "CASE WHEN climbs AND {c} <> 12 AND (SELECT birth FROM edge WHERE child = {c}) >= density THEN (SELECT parent FROM edge WHERE child = {c}) ELSE {c} END"


@query(f"""WITH core(i, x, y) AS (VALUES {_CORES}), edge(parent, child, birth) AS (VALUES {_EDGES}),
apart AS (SELECT a.i, b.i AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM core a, core b),
cored AS (SELECT i, d AS core FROM apart QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = {MIN_SAMPLES + 1}),
near AS (
  SELECT vec_id, i, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, i) AS r FROM (
    SELECT vec_id, i, sqrt((embedding[1]::DOUBLE - x) ** 2 + (embedding[2]::DOUBLE - y) ** 2) AS d FROM embeddings, core) QUALIFY r <= {2 * MIN_SAMPLES}),
reached AS (SELECT vec_id, i, r, greatest(d, core, max(d) FILTER (r = {MIN_SAMPLES + 1}) OVER (PARTITION BY vec_id)) AS reach FROM near JOIN cored USING (i)),
placed AS (SELECT vec_id, parent AS c0, 1 / reach AS density, birth > 1 / reach AS climbs FROM (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY reach, r) = 1) JOIN edge ON child = i),
one AS (SELECT *, {_UP.format(c="c0")} AS c1 FROM placed), two AS (SELECT *, {_UP.format(c="c1")} AS c2 FROM one), three AS (SELECT *, {_UP.format(c="c2")} AS c3 FROM two)
SELECT vec_id, (CASE c3 WHEN 15 THEN 0 WHEN 16 THEN 1 WHEN 14 THEN 2 ELSE -1 END)::INTEGER AS cluster FROM three""")
def density_assign(spark, sf_dir):
    """The density-based cluster of each vector, by its neighbour of mutual reachability and the condensed tree."""
    root = new_path(spark, "density")
    model = {"points": CORE_POINTS, "core_distances": core_distances(np.array(CORE_POINTS), MIN_SAMPLES).tolist(), "edges": CORE_EDGES, "labels": CORE_LABELS, "min_samples": MIN_SAMPLES}
    Files(spark).publish(f"{root}/m.json", json.dumps(model))
    entry = {"type": "s3_scikit_set", "model_type": "hdbscan", "bucket": root, "extension": "json", "scikits": [{"key": "m", "map": "a"}], "parameters": {"columns": ["x", "y"]}}
    chosen = Registry(spark, {"clusters": [entry]}).get("clusters")
    chosen.select({"map": "a"})
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xy")))
    return chosen.invoke(vectors, "cluster").select("vec_id", "cluster")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 3")
def lookup_csv(spark, sf_dir):
    """A lookup table that is kept as CSV, with types told from its values."""
    root = new_path(spark, "csv")
    _read(spark, sf_dir, "region").where("r_regionkey != 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name").coalesce(1).write.option("header", True).csv(f"{root}/regions.csv")
    table = Registry(spark, {"regions": [{"type": "s3_dataframe", "res_type": "text/csv", "bucket": root, "key": "regions.csv"}]}).get("regions")
    return table.join(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def lookup_table_set(spark, sf_dir):
    """The table of a set that is selected by its attributes."""
    root = new_path(spark, "set")
    customers = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    for region in (1, 2):
        customers.where(F.col("n_regionkey") == region).select("c_custkey", "c_name").write.parquet(f"{root}/regions/r{region}.parquet")
    entry = {"type": "s3_dataframe_set", "bucket": root, "prefix": "regions", "models": [{"key": f"r{r}", "region": r} for r in (1, 2)]}
    chosen = Registry(spark, {"customers": [entry]}).get("customers")
    chosen.select({"region": 2})
    return chosen.invoke()


@query("""SELECT message_id, delivery, outcome FROM (SELECT event_id::VARCHAR AS message_id,
  CASE WHEN event_type = 'click' THEN 'ack' WHEN event_type = 'view' THEN 'forced_ack' WHEN value > 50 THEN 'nack' ELSE 'failed' END AS outcome FROM events), (VALUES (1::BIGINT), (2), (3)) d(delivery)
  WHERE delivery = 1 OR outcome IN ('nack', 'failed')""")
def queue_consumption(spark, sf_dir):
    """Every delivery of a bounded consumption of a stream: what is not acknowledged comes again until it is dead, after three."""
    root = new_path(spark, "queue")
    events = _read(spark, sf_dir, "events")
    body = F.to_json(F.struct("event_type", "value")).alias("Body")
    messages = events.select(F.col("event_id").cast("string").alias("MessageId"), F.lit("h").alias("ReceiptHandle"), body, F.create_map().cast("map<string,string>").alias("attributes"))
    messages.write.parquet(f"{root}/in")

    def handler(content, metadata):
        if content["event_type"] == "view":
            raise ForceAcknowledge
        if content["event_type"] != "click" and not content["value"] > 50:
            raise RuntimeError("no")
        return content["event_type"] == "click"

    stream = spark.readStream.schema(MESSAGE).parquet(f"{root}/in")
    consumer = QueueConsumer(spark, stream, handler, f"{root}/queue", max_deliveries=3, backoff_seconds=0.1)
    consumer.run(available_now=True)
    return spark.read.parquet(f"{root}/queue/outcomes").select(F.col("MessageId").alias("message_id"), (F.col("deliveries") + 1).cast("long").alias("delivery"), "outcome")


FLAGSHIP = "data_dataset_build"
