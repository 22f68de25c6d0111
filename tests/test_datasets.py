import json
import shutil
import sys

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, StringType, StructType

from folio.errors import ChannelError, DatasetExists, EmptyDataset, MissingOption
from folio.operators.paging import PageLimits
from folio.plans.library import Library
from folio.plans.manifest import pages_frame, total_timings
from folio.sources.catalog import Catalog, Changes, ObjectReader
from folio.sources.schemas import folded, footers, wider

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test's module
NAME = "ticks.2022-05-01,2022-06-01"


@pytest.fixture
def library(spark, objects, tmp_path):
    lib = Library(spark, str(tmp_path / "datasets"), str(objects), "match")
    lib.create_header()
    return lib


def test_catalog(spark, objects, monkeypatch):
    catalog = Catalog(spark, str(objects), "match")
    assert sorted(r["id"] for r in catalog.manifests().collect()) == [f"id{i}" for i in range(5)]
    ticks = catalog.channel({"channel": "tick", "columns": ["tick"]})
    assert ticks.columns == ["key", "object_id", "tick"] and ticks.count() == 30
    assert catalog.channel("hit").select("key").distinct().count() == 4
    assert sorted(catalog.read()) == ["header", "hit", "tick"] and catalog.read([]) == {}
    header = catalog.header().orderBy("key").collect()
    assert [r["match_id"] for r in header] == [f"id{i}" for i in range(5)] and header[0]["key"] == "match/2022/05/10/m0/match"
    with pytest.raises(ChannelError):
        catalog.channel("absent")
    with pytest.raises(ChannelError):
        catalog.channel({"channel": "tick", "columns": ["absent"]})
    keys = catalog.manifests().where("id = 'id3'").select("key")
    few = catalog.read(["tick"], keys)["tick"]
    assert few.count() == 9 and [f.rsplit("/", 2)[1:] for f in few.inputFiles() if "manifests" not in f] == [["m3", "tick"]]
    monkeypatch.setattr("folio.sources.catalog.NAMED_FILES", 2)  # by folders, and then all
    more = catalog.read(["tick"], catalog.manifests().where("id > 'id1'").select("key"))["tick"]
    assert more.count() == 27 and catalog.channel("tick", catalog.manifests().where("id in ('id1', 'id3')").select("key")).count() == 12
    assert catalog.channel("hit", keys.where("key = ''")).count() == 0


def test_object_reader(spark, objects):
    one = ObjectReader(spark, str(objects), "match/2022/05/13/m3/match")
    assert one.manifest["id"] == "id3" and one.metadata["key"].endswith("m3/match")
    assert list(one.channels()) == ["header", "tick", "hit"] and one.channels([]) == {}
    assert one.channel({"channel": "tick", "columns": ["player"]}).columns == ["player"]
    with pytest.raises(ChannelError):
        one.channel("absent")


def test_header_and_subheader(library):
    assert library.header_reader().is_complete and library.dataframe("header").count() == 5
    sub = library.create_subheader(NAME, lambda df: df["map"] == "map0")
    assert sub.keyset() == [f"match/2022/05/{10 + i}/m{i}/match" for i in (0, 2, 4)]
    assert library.create_subheader(NAME, "rounds > 23").dataframe().count() == 1
    with pytest.raises(EmptyDataset):
        library.create_subheader("none.2022-05-01,2022-06-01", "rounds > 99")
    assert not library.reader("none.2022-05-01,2022-06-01").exists
    assert library.object_at(1).manifest["id"] == "id1" and library.random_object(seed=3).manifest["id"].startswith("id")
    with pytest.raises(IndexError):
        library.object_at(5)


def test_drawn_keys_spread_over_all(library):
    reader = library.header_reader()
    drawn = reader.random_keys(range(200))
    assert set(drawn) == set(reader.keyset()) and all(20 <= drawn.count(k) <= 65 for k in reader.keyset())
    assert [reader.random_key(7), reader.random_key(9)] == [drawn[7], drawn[9]]


def test_objects_drawn_for_a_frame_of_seeds(spark, library):
    sub = library.create_subheader(NAME, "map = 'map0'")
    seeds = spark.range(-100, 200).select(F.col("id").alias("seed"), (F.col("id") % 7).alias("n")).unionAll(spark.sql("select cast(null as bigint), 0L"))
    for name, reader in ((None, library.header_reader()), (NAME, sub)):
        rows = library.random_objects(seeds, name).collect()
        assert len(rows) == 301 and rows[0].asDict().keys() == {"seed", "n", "key", "match_id"}
        drawn = {r["seed"]: (r["key"], r["match_id"]) for r in rows}
        assert drawn.pop(None) == (None, None)
        assert [drawn[i][0] for i in range(-100, 200)] == reader.random_keys(range(-100, 200)) and {k for k, _ in drawn.values()} == set(reader.keyset())
        assert all(k.split("/")[-2] == "m" + i.removeprefix("id") for k, i in drawn.values())
    one = library.random_object(seed=11).manifest
    assert library.random_objects(seeds.where("seed = 11")).select("key", "match_id").collect() == [(one["key"], one["id"])]
    assert library.header_reader().random_key() in library.keyset("header")


def ticks(channels):
    return channels["tick"].select("key", "tick")


def test_build_and_read(library):
    built = library.builder(NAME, instructions=[{"channel": "tick", "columns": ["tick"]}], limits=PageLimits(max_rows=5, check_every=1)).build(ticks)
    manifest = built.manifest
    assert manifest.isComplete and [(p["keyCount"], p["rowCount"]) for p in manifest.pages] == [(3, 9), (1, 9), (1, 12)]
    assert built.dataframe().count() == 30 and len(built.keyset()) == 5
    rows, keys = built.page(1)
    assert rows.count() == 9 and [r["key"] for r in keys.collect()] == ["match/2022/05/13/m3/match"]
    assert sum(r.count() for r, _ in built.pages()) == 30
    assert built.header.exists and built.header.dataframe().count() == 5 and manifest.sourceId == library.header_reader().manifest.id
    assert total_timings(pages_frame(library._spark, manifest)).first()["seconds"] > 0
    # complete: passed over by default, or a failure, or built anew
    assert library.builder(NAME).build(ticks).manifest.id == manifest.id
    with pytest.raises(DatasetExists):
        library.builder(NAME, if_complete="fail").build(ticks)
    assert library.builder(NAME, if_complete="overwrite").build(ticks).manifest.id != manifest.id
    with pytest.raises(ValueError):
        library.builder(NAME, if_partial="odd")


def pages_of(reader):
    return [(p["number"], p["keyCount"], p["rowCount"]) for p in reader.manifest.pages]


@pytest.mark.parametrize("chunk", [1, 2, 3])
def test_interrupted_build_goes_on(library, chunk):
    limits = PageLimits(max_rows=5, check_every=1)
    whole = library.builder("whole.2022-05-01,2022-06-01", limits=limits).build(ticks)

    calls = []

    def breaks(channels):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("interrupted")
        return ticks(channels)

    builder = library.builder(NAME, limits=limits, chunk_keys=chunk)
    try:
        builder.build(breaks)
    except RuntimeError:
        assert not builder.reader.is_complete
        held = library.reader(NAME).manifest
        assert library.builder(NAME, if_partial="pass").build(ticks).manifest.pages == held.pages
        with pytest.raises(DatasetExists):
            library.builder(NAME, if_partial="fail").build(ticks)
        library.create_subheader("header", "rounds < 0 or rounds = 20")  # continuing goes by the header as it was
        library.builder(NAME, limits=limits, chunk_keys=chunk).build(ticks)
    got = library.reader(NAME)
    assert got.is_complete and pages_of(got) == pages_of(whole) and got.keyset() == whole.keyset()
    assert sorted(map(tuple, got.dataframe().collect())) == sorted(map(tuple, whole.dataframe().collect()))


def test_progress_is_told_after_each_chunk(library):
    told = []
    library.builder(NAME, limits=PageLimits(max_rows=5, check_every=1), chunk_keys=2, on_progress=told.append).build(ticks)
    assert [p.keys_done for p in told] == sorted(p.keys_done for p in told) and told[-1].keys_done == told[-1].keys == 5
    assert told[-1].rows == sum(p.rows_of_chunk for p in told) == 30 and told[-1].percent == 100 and told[-1].seconds_left == 0


def test_keys_without_rows_are_recorded(library):
    built = library.builder(NAME).build(lambda c: c["tick"].where("tick > 8").select("key", "tick"))
    assert len(built.keyset()) == 5 and built.dataframe().select("key").distinct().count() == 1
    none = library.builder("none.2022-05-01,2022-06-01").build(lambda c: c["tick"].where(F.lit(False)).select("key", "tick"))
    assert len(none.keyset()) == 5 and none.dataframe().count() == 0


def test_build_by_key(library):
    calls = library._spark.sparkContext.accumulator(0)

    def summary(channels):
        calls.add(1)
        ticks, hits = channels["tick"], channels["hit"]
        assert list(channels) == ["header", "hit", "tick"] and ticks["tick"].tolist() == sorted(ticks["tick"])
        assert set(ticks["key"]) | set(hits["key"]) <= set(channels["header"]["key"])
        if not len(ticks):
            return None
        return pd.DataFrame({"map": channels["header"]["map"], "total": [ticks["tick"].sum()], "damage": [hits["damage"].sum()], "hits": [len(hits)]})

    built = library.builder(NAME).build_by_key(summary, "map string, total long, damage long, hits int", ["header", "hit", "tick"], {"tick": ["tick"]})
    want = [(f"match/2022/05/{10 + i}/m{i}/match", f"map{i % 2}", sum(range(3 * i)), 0 if i == 2 else 10 * i + 5, 0 if i == 2 else 2) for i in range(1, 5)]
    assert sorted((r["key"], r["map"], r["total"], r["damage"], r["hits"]) for r in built.dataframe().collect()) == want
    assert calls.value >= 5 and len(built.keyset()) == 5
    with pytest.raises(ChannelError, match="absent"):
        library.builder("other.2022-05-01,2022-06-01").build_by_key(summary, "a int", ["absent"])


def test_streamed_build_of_a_large_key(spark, library):
    """Pieces come channel by channel and in order; what is not read is skipped."""

    def first_and_count(key, pieces):
        seen, n = [], 0
        for name, rows in pieces:
            seen.append(name)
            n += len(rows)
            if key.endswith("m3/match"):
                break  # the rest of this key is skipped
        yield pd.DataFrame({"channels": [",".join(dict.fromkeys(seen))], "pieces": [len(seen)], "n": [n]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        built = library.builder(NAME).build_streamed(first_and_count, "channels string, pieces int, n long", ["tick", "hit"]).dataframe()
        got = {r["key"][-8:-6]: (r["channels"], r["n"]) for r in built.collect()}
        pieces = {r["key"][-8:-6]: r["pieces"] for r in built.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.pop("m3")[0] == "tick"
    assert got == {"m0": ("hit", 2), "m1": ("tick,hit", 5), "m2": ("tick", 6), "m4": ("tick,hit", 14)} and pieces["m4"] >= 4


def test_columns_named_as_a_pages_own(library):
    def odd(channels):
        return channels["tick"].select("key", F.col("tick").alias("page"), F.lit(1).alias("_files"), F.lit("x").alias("a.b"), F.lit(2).alias("page_0"), F.lit(3).alias("key_ord"))

    built = library.builder(NAME, limits=PageLimits(max_rows=5, check_every=1)).build(odd)
    assert sorted(built.dataframe().columns) == sorted(["key", "page", "_files", "a.b", "page_0", "key_ord"])
    assert sorted(r["page"] for r in built.dataframe().collect()) == sorted(t for i in range(5) for t in range(3 * i))
    assert sorted(r["page"] for r in built.page(1)[0].collect()) == list(range(9))


def test_options(spark, monkeypatch):
    with pytest.raises(MissingOption):
        Library(spark)
    monkeypatch.setenv("FOLIO_DATASET_ROOT", "/tmp/a")
    monkeypatch.setenv("FOLIO_OBJECT_ROOT", "/tmp/b")
    with pytest.raises(MissingOption, match="kind"):
        Library(spark)
    monkeypatch.setenv("FOLIO_KIND", "match")
    assert (Library(spark).root, Library(spark).kind, Library(spark, "/tmp/c").root) == ("/tmp/a", "match", "/tmp/c")


def put_object(root, key, rounds):
    folder = root / key
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"map": ["m"], "rounds": [rounds]}), folder / "header")
    body = {"id": key[-2:], "key": f"{key}/match", "channels": [{"channel": "header", "key": f"{key}/header", "contentType": "application/x-parquet", "columns": [{"name": "map"}]}]}
    (folder / "match").write_text(json.dumps(body) + " " * rounds)


def test_catalog_reads_new_and_changed_manifests_only(spark, tmp_path, monkeypatch):
    root, log = tmp_path / "objects", str(tmp_path / "log")
    for i in range(4):
        put_object(root, f"match/o{i}", i)
    catalog = Catalog(spark, str(root), "match", log=log)
    assert catalog.refresh() == Changes(4, 0, 0, 4, 1) and catalog.refresh() == Changes(0, 0, 0, 0, 1)
    put_object(root, "match/o4", 4)
    put_object(root, "match/o1", 11)
    shutil.rmtree(root / "match/o3")
    later = Catalog(spark, str(root), "match", log=log)  # another session
    assert later.manifests().count() == 4 and later.version() == 1
    scans = []
    monkeypatch.setattr(Catalog, "_scan", lambda self, *paths, real=Catalog._scan: scans.append(paths) or real(self, *paths))
    assert later.refresh() == Changes(1, 1, 1, 2, 2)
    assert [sorted(p.rsplit("/", 2)[1] for p in s) for s in scans[1:]] == [["o1", "o4"]]  # the first lists, without contents
    assert {(r["key"], r["gone"]) for r in later.changed_since(1).collect()} == {("match/o1/match", False), ("match/o4/match", False), ("match/o3/match", True)}
    assert {r["id"] for r in later.manifests().collect()} == {"o0", "o1", "o2", "o4"}
    monkeypatch.setattr("folio.sources.catalog.NAMED_FILES", 1)
    put_object(root, "match/o5", 5)
    put_object(root, "match/o6", 6)
    assert later.refresh() == Changes(2, 0, 0, 2, 3) and later.manifests().count() == 6


def test_header_is_brought_up_to_date_from_what_changed(spark, tmp_path, monkeypatch):
    root = tmp_path / "objects"
    for i in range(4):
        put_object(root, f"match/o{i}", i)
    new = lambda: Library(spark, str(tmp_path / "datasets"), str(root), "match", catalog_log=str(tmp_path / "log"))
    first = new().refresh_header()
    assert sorted(r["rounds"] for r in first.dataframe().collect()) == [0, 1, 2, 3]
    put_object(root, "match/o4", 4)
    put_object(root, "match/o1", 11)
    shutil.rmtree(root / "match/o3")
    asked = []
    monkeypatch.setattr(Catalog, "header", lambda self, keys=None, real=Catalog.header: asked.append(None if keys is None else sorted(r["key"] for r in keys.collect())) or real(self, keys))
    made = new().refresh_header()
    assert asked == [["match/o1/match", "match/o4/match"]]
    assert sorted((r["match_id"], r["rounds"]) for r in made.dataframe().collect()) == [("o0", 0), ("o1", 11), ("o2", 2), ("o4", 4)]
    assert new().refresh_header().manifest.id == made.manifest.id and len(asked) == 1
    shutil.rmtree(root / "match/o0")
    assert new().refresh_header().keyset() == ["match/o1/match", "match/o2/match", "match/o4/match"] and len(asked) == 1


def test_files_of_one_channel_with_other_types_are_read_as_one(spark, tmp_path, monkeypatch):
    root = tmp_path / "objects"
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.int16(), pa.float32()]
    for i, kind in enumerate(kinds):
        put_object(root, f"match/o{i}", i)
        columns = {"map": ["m"], "rounds": pa.array([i + 1], kind)} | ({"more": ["x"]} if i % 2 else {})
        pq.write_table(pa.table(columns), root / f"match/o{i}/header")
    catalog = Catalog(spark, str(root), "match", log=str(tmp_path / "log"))
    rows = catalog.channel("header")
    assert rows.schema["rounds"].dataType.simpleString() == "double" and sorted(r["rounds"] for r in rows.collect()) == [1, 2, 3, 4, 5]
    assert sorted((r["object_id"], r["more"]) for r in rows.select("object_id", "more").collect()) == [(f"o{i}", "x" if i % 2 else None) for i in range(5)]
    some = catalog.channel({"channel": "header", "columns": ["rounds"]}, catalog.manifests().where("id in ('o0', 'o3')").select("key"))
    assert some.schema["rounds"].dataType.simpleString() == "int" and sorted(r["rounds"] for r in some.collect()) == [1, 4]
    monkeypatch.setattr("folio.sources.catalog.NAMED_FILES", 1)
    assert sorted(r["rounds"] for r in catalog.channel("header").collect()) == [1, 2, 3, 4, 5]
    # footers are read once: of a changed object again, of others not
    read = []
    monkeypatch.setattr("folio.sources.catalog.footers", lambda files, base, real=footers: read.append(sorted(r["path_key"] for r in files.collect())) or real(files, base))
    put_object(root, "match/o1", 12)
    later = Catalog(spark, str(root), "match", log=str(tmp_path / "log"))
    later.refresh()
    assert sorted(r["rounds"] for r in later.channel("header").collect()) == [1, 3, 4, 5, 12] and read == [["match/o1/header"]]
    put_object(root, "match/o2", 2)
    pq.write_table(pa.table({"map": ["m"], "rounds": ["text"]}), root / "match/o2/header")
    later.refresh()
    with pytest.raises(ChannelError, match="rounds is"):
        later.channel("header")


def test_types_widen():
    assert wider(IntegerType(), DecimalType(5, 2)) == DecimalType(12, 2) and wider(LongType(), FloatType()) == DoubleType() and wider(NullType(), StringType()) == StringType()
    a, b = StructType().add("x", IntegerType()).add("y", StringType()), StructType().add("x", LongType()).add("z", ArrayType(IntegerType()))
    assert folded([a, b]).simpleString() == "struct<x:bigint,y:string,z:array<int>>" == wider(a, b).simpleString()
    assert wider(ArrayType(IntegerType()), ArrayType(DoubleType())).simpleString() == "array<double>" and wider(MapType(StringType(), IntegerType()), MapType(StringType(), LongType())).simpleString() == "map<string,bigint>"
    for other in (StringType(), BooleanType(), DecimalType(38, 30)):
        with pytest.raises(ChannelError):
            wider(LongType(), other, "x")
