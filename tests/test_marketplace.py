"""A marketplace's listings, export jobs and event actions, with a client that keeps what it is told in a folder."""

import json

import pytest

from folio.errors import FolioError
from folio.sources.marketplace import Marketplace, key_pattern


def market_in(folder: str, revisions: dict[str, list[str]]):
    """``connect`` of a market whose jobs take three looks; job of a revision named bad* fails."""

    def connect():
        import json
        import uuid
        from datetime import UTC, datetime
        from pathlib import Path

        at = Path(folder)

        class Pages:
            def __init__(self, key, rows):
                self._key, self._rows = key, rows

            def paginate(self, **by):
                rows = self._rows(**by)
                for i in range(0, max(1, len(rows)), 2):
                    yield {self._key: rows[i : i + 2]}

        class Client:
            def get_paginator(self, name):
                if name == "list_data_set_revisions":
                    return Pages("Revisions", lambda DataSetId: [{"Id": r, "Comment": f"2022-01-0{i + 1}", "CreatedAt": datetime(2022, 1, 1 + i, tzinfo=UTC)} for i, r in enumerate(revisions)])
                if name == "list_revision_assets":
                    return Pages("Assets", lambda DataSetId, RevisionId: [{"Name": a, "Id": f"id-{a}"} for a in revisions[RevisionId]])
                return Pages("EventActions", lambda: [json.loads(p.read_text()) for p in sorted(at.glob("action-*"))])

            def create_job(self, Type, Details):
                job = uuid.uuid4().hex
                (at / f"job-{job}").write_text(json.dumps({"Type": Type, "Details": Details, "looks": -1}))
                return {"Id": job}

            def start_job(self, JobId):
                held = json.loads((at / f"job-{JobId}").read_text())
                (at / f"job-{JobId}").write_text(json.dumps(held | {"looks": 0}))

            def get_job(self, JobId):
                held = json.loads((at / f"job-{JobId}").read_text())
                assert held["looks"] >= 0, "not started"
                (at / f"job-{JobId}").write_text(json.dumps(held | {"looks": held["looks"] + 1}))
                bad = held["Details"]["ExportRevisionsToS3"]["RevisionDestinations"][0]["RevisionId"].startswith("bad")
                state = "IN_PROGRESS" if held["looks"] < 2 else "ERROR" if bad else "COMPLETED"
                return {"Id": JobId, "State": state, "Errors": [{"Message": "no room"}] if bad else []}

            def create_event_action(self, Action, Event):
                action = uuid.uuid4().hex
                (at / f"action-{action}").write_text(json.dumps({"Id": action, "Action": Action, "Event": Event}))
                return {"Id": action}

            def delete_event_action(self, EventActionId):
                (at / f"action-{EventActionId}").unlink()

        return Client()

    return connect


def jobs_in(folder):
    return [json.loads(p.read_text())["Details"]["ExportRevisionsToS3"] for p in folder.glob("job-*")]


def test_listings_are_frames(spark, tmp_path):
    market = Marketplace(spark, market_in(str(tmp_path), {"r1": ["a", "b", "c"], "r2": [], "r3": ["a"]}), "d")
    revisions = market.revisions()
    assert [tuple(r) for r in revisions.selectExpr("dataset_id", "revision_id", "comment", "cast(created_at as string)").orderBy("revision_id").collect()] == [("d", f"r{i}", f"2022-01-0{i}", f"2022-01-0{i} 00:00:00") for i in (1, 2, 3)]
    assert sorted(map(tuple, market.assets(revisions).collect())) == [("r1", n, f"d/r1/id-{n}") for n in "abc"] + [("r3", "a", "d/r3/id-a")]
    empty = Marketplace(spark, market_in(str(tmp_path), {}), "d")
    assert empty.revisions().count() == 0 and empty.assets(empty.revisions()).count() == 0
    with pytest.raises(FolioError, match="no revisions"):
        empty.export("bucket")


def test_revisions_are_exported_by_jobs(spark, tmp_path):
    market = Marketplace(spark, market_in(str(tmp_path), {"r1": ["a"], "bad2": ["b"], "r3": ["c"]}), "d", poll_seconds=0)
    assert market.export("bucket", "p/") == 1
    assert jobs_in(tmp_path) == [{"DataSetId": "d", "RevisionDestinations": [{"Bucket": "bucket", "KeyPattern": "p/${Asset.Name}", "RevisionId": "r3"}]}]
    with pytest.raises(FolioError, match="1 of 3 exports failed, one of them as job .* failed: no room"):
        market.export("bucket", revisions=market.revisions(), at_once=2)
    assert sorted(j["RevisionDestinations"][0]["RevisionId"] for j in jobs_in(tmp_path)) == ["bad2", "r1", "r3", "r3"]
    assert market.export("bucket", revisions=market.revisions().limit(0)) == 0 and key_pattern(None) == "${Asset.Name}"


def test_exports_on_publication_start_and_stop_for_one_dataset(spark, tmp_path):
    connect = market_in(str(tmp_path), {})
    market, other = Marketplace(spark, connect, "d"), Marketplace(spark, connect, "e")
    assert market.stop_auto_exports() == 0
    made = {market.auto_export("bucket", "p/") for _ in range(5)}
    kept = other.auto_export("bucket")
    assert len(made) == 5 and market.stop_auto_exports() == 5
    left = [json.loads(p.read_text()) for p in tmp_path.glob("action-*")]
    assert [a["Id"] for a in left] == [kept] and left[0]["Event"] == {"RevisionPublished": {"DataSetId": "e"}}
    assert left[0]["Action"] == {"ExportRevisionToS3": {"RevisionDestination": {"Bucket": "bucket", "KeyPattern": "${Asset.Name}"}}}
