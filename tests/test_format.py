"""The data source of datasets: what it prunes, and what a reader sees of writes that fail."""

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folio.operators.paging import PageLimits
from folio.plans import format as form
from folio.plans.reader import DatasetReader

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test's module
LIMITS = PageLimits(max_rows=20, check_every=2)


@pytest.fixture(autouse=True)
def registered(spark):
    form.register(spark)


def rows_of(spark, n=100):
    keys = spark.range(n).select(F.format_string("k%03d", "id").alias("key"))
    rows = spark.range(n).where("id % 3 > 0").select(F.format_string("k%03d", "id").alias("key"), F.explode(F.sequence(F.lit(1), F.col("id") % 3 * 4)).alias("at"), F.lit("x").alias("a.b"), F.lit(2.5).alias("row"))
    return rows, keys


def loaded(spark, root, **options):
    return spark.read.format(form.NAME).options(root=root, kind="k", name="d", **options).load()


def test_written_dataset_is_read_by_both_readers(spark, tmp_path):
    rows, keys = rows_of(spark)
    form.write_dataset(rows, keys, str(tmp_path), "k", "d", LIMITS)
    reader = DatasetReader(spark, str(tmp_path), "k", "d")
    assert reader.is_complete and reader.keyset() == sorted(r["key"] for r in keys.collect())
    pages = reader.manifest.pages
    assert len(pages) > 5 and sum(p["rowCount"] for p in pages) == rows.count() and sum(p["keyCount"] for p in pages) == 100
    got = loaded(spark, str(tmp_path))
    want = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, got.select("key", "at", "`a.b`", "row").collect())) == want == sorted(map(tuple, reader.dataframe().select("key", "at", "`a.b`", "row").collect()))
    assert {r["page"]: r["n"] for r in got.groupBy("page").agg(F.count("*").alias("n")).collect()} == {p["number"]: p["rowCount"] for p in pages if p["rowCount"]}
    form.write_dataset(rows.where("at > 99"), keys, str(tmp_path), "k", "d", LIMITS, mode="append")  # keys without rows only
    assert len(DatasetReader(spark, str(tmp_path), "k", "d").manifest.pages) == len(pages) + 1
    assert loaded(spark, str(tmp_path)).count() == len(want)


def test_other_pages_are_named_to_no_task(spark, tmp_path):
    rows, keys = rows_of(spark)
    place = form.to_write(rows, keys, LIMITS).repartition(1).sortWithinPartitions("page", "key_ord")  # a file a page
    place.write.format(form.NAME).options(root=str(tmp_path), kind="k", name="d").mode("overwrite").save()
    form.write_dataset(rows.withColumn("key", F.concat(F.lit("z"), "key")), keys.select(F.concat(F.lit("z"), "key").alias("key")), str(tmp_path), "k", "d", LIMITS, mode="append")
    whole, some = loaded(spark, str(tmp_path)), loaded(spark, str(tmp_path), pages="0,2-3")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.where("page in (0, 2, 3)").collect()))
    assert some._jdf.queryExecution().executedPlan().execute().getNumPartitions() == 3
    # the reader prunes by filters, of pages of several runs
    paged = DatasetReader(spark, str(tmp_path), "k", "d").paged()
    last = len(DatasetReader(spark, str(tmp_path), "k", "d").manifest.pages) - 1
    assert sorted(map(tuple, paged.select(*[f"`{c}`" for c in whole.columns]).collect())) == sorted(map(tuple, whole.collect()))
    for condition in ("page = 2", f"page in (1, {last})", "page >= 1 and page < 4 and at > 2"):
        pruned = paged.where(condition)
        assert sorted(map(tuple, pruned.select(*[f"`{c}`" for c in whole.columns]).collect())) == sorted(map(tuple, whole.where(condition).collect()))
        plan = pruned._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: []" not in plan and "PartitionFilters" in plan and ("at" not in condition or "PushedFilters: [IsNotNull(at), GreaterThan(at,2" in plan)
    assert {f.split("page=")[1].split("/")[0] for f in paged.where("page = 2").inputFiles()}


def files(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file()}


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows, keys = rows_of(spark)

    @F.udf("long")
    def broken(x):
        raise ValueError("broken row")

    failing = form.to_write(rows, keys, LIMITS)
    failing = failing.withColumn("key_ord", F.when(F.col("key") == "k098", broken("key_ord")).otherwise(F.col("key_ord")))
    writer = lambda: failing.write.format(form.NAME).options(root=str(tmp_path), kind="k", name="d").mode("append")
    with pytest.raises(Exception, match="broken row"):
        writer().save()
    assert not files(tmp_path) and not DatasetReader(spark, str(tmp_path), "k", "d").exists
    form.write_dataset(rows, keys, str(tmp_path), "k", "d", LIMITS)
    before = files(tmp_path)
    with pytest.raises(Exception, match="broken row"):
        writer().save()
    assert files(tmp_path) == before
    with pytest.raises(Exception, match="columns key, page, key_ord and row"):
        rows.write.format(form.NAME).options(root=str(tmp_path), kind="k", name="d").mode("append").save()
    with pytest.raises(Exception, match="no dataset"):
        spark.read.format(form.NAME).options(root=str(tmp_path), kind="k", name="other").load()
