"""Every query with an SQL twin gives the rows that DuckDB gives."""

import numbers
from pathlib import Path

import duckdb
import pytest

from folio.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(frame):
    """Rows as text; numbers by value, as pandas makes floats of integers where some are null."""

    def of(v):
        return round(float(v), 6) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted(repr([of(v) for v in row]) for row in frame.itertuples(index=False, name=None))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), sql.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_random_match_gives_every_draw_with_its_object(spark, sql):
    rows = QUERIES["random_match"](spark, str(DATA)).toPandas()
    seeds, nations = (sql.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("orders", "nation"))
    keys = rows.groupby("dataset")["key"].agg(["size", "nunique"])
    assert set(keys["size"]) == {seeds} and keys.loc["header", "nunique"] == nations and sorted(keys["nunique"])[:2] == [1, 5]
    objects = rows[rows["dataset"] == "header"].drop_duplicates("key")
    assert rows["is_key"].all() and objects["match_id"].nunique() == nations and objects["orders"].sum() == seeds
    assert objects["customers"].sum() == sql.execute("SELECT count(*) FROM customer").fetchone()[0] and objects["suppliers"].sum() == sql.execute("SELECT count(*) FROM supplier").fetchone()[0]
