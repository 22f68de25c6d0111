"""Queries with an SQL twin against DuckDB, and the pipeline against its stages' meaning."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from test_pairs_and_native import brute_components

from folio.llm.oracles import ORACLES
from folio.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda f: Counter(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "decontamination", "source_mix", "sharding"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(DATA)).cache())
        if len(seen) <= len(corpus_pipeline.STAGES):
            assert seen[-1].columns == docs.columns
    raw, good, single, clean, mix, shards = ({r["doc_id"] for r in df.select("doc_id").collect()} for df in seen)
    assert raw >= good >= single >= clean >= mix == shards
    predicted = {r["doc_id"] for r in QUERIES["op8_quality_classifier"](spark, str(DATA)).where("predicted = 1").collect()}
    assert good == predicted
    from folio.llm.ngram_join import ngram_components

    assert single == {r["doc_id"] for r in ngram_components(seen[1]).where("doc_id = component_id").collect()}
    leaked = {r["doc_id"] for r in QUERIES["op10_decontamination"](spark, str(DATA)).collect()}
    assert clean == single - leaked
    assert Counter(r["doc_id"] for r in seen[4].collect()) == Counter(r["doc_id"] for r in seen[5].collect())
    assert corpus_pipeline.run(spark, str(DATA)).count() == seen[5].count()


def test_pipeline_equals_a_plain_version(spark):
    """The classifier's own verdicts, then brute force for near copies and SQL written from the meaning for the rest."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    predicted = {r["doc_id"] for r in QUERIES["op8_quality_classifier"](spark, str(DATA)).where("predicted = 1").collect()}
    good = docs.toPandas()
    good = good[good["doc_id"].isin(predicted)]
    component = {doc: (n, least) for doc, n, least in brute_components(list(zip(good["doc_id"], good["text"], strict=True)))}
    single = good[[component[d][0] == 0 or component[d][1] == d for d in good["doc_id"]]]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    con.register("documents", single)
    leaked = {r[0] for r in con.execute(ORACLES["op10_decontamination"]).fetchall()}
    clean = single[~single["doc_id"].isin(leaked)]
    con.unregister("documents")
    con.register("documents", clean)
    shard = dict(con.execute(f"SELECT doc_id, shard FROM ({ORACLES['op2_sharding']})").fetchall())
    want = Counter({(doc, shard[doc]): copies for doc, copies in con.execute(f"SELECT doc_id, copies FROM ({ORACLES['op6_source_mix']}) WHERE copies > 0").fetchall()})
    assert len(leaked) and want == Counter((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, str(DATA)).collect())


def test_pipeline_stages_of_odd_rows(spark):
    prose = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(3).collect()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, r["text"], r["lang"], None, r["n_chars"]) for r in prose] + [(1, None, None, None, None), (1, "", "", "", 0), (2, "", None, "s", 0), (2, prose[0]["text"], "en", "s", 1), (2, prose[0]["text"], "en", "s", 1), (3, "word " * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(DATA)).count() == 0, name
    by_name = dict(corpus_pipeline.STAGES)
    assert by_name["quality_classifier"](spark, docs, str(DATA)).columns == docs.columns
    single = by_name["ngram_jaccard_join"](spark, docs, str(DATA)).collect()
    # of the first text the row with an id stays, of the others that without, and every row without words
    assert sorted(map(str, (r["doc_id"] for r in single))) == ["1", "1", "2", "2", "3", "None", "None"]
    assert by_name["decontamination"](spark, docs, str(DATA)).count() == len(rows)
    assert by_name["sharding"](spark, docs, str(DATA)).where("shard is null").count() == 0
