from __future__ import annotations

import json
import subprocess
import urllib.request
from threading import Thread

import pytest

from loamline import cli
from loamline.plans import api
from loamline.sources import numstat
from loamline.sources.git import Repository
from loamline.sources.runs import CHILDREN, RunStore

LOG = ["1\t1\tlost.py", "COMMIT:h1 2024-01-02T03:04:05+02:00 Ann van Berg ann@x.org", "3\t1\ta.py", "-\t-\tb.png", "2\t2\tREADME.md", "broken", "", "COMMIT:h2 2024-01-03T00:00:00+00:00 Bo bo@x.org", "COMMIT:h3 2024-01-04T00:00:00+00:00 Bo bo@x.org", "1\t0\td/{x.py => y.py}"]


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_log_text(spark, stretch):
    lines = spark.createDataFrame([("log", i, x) for i, x in enumerate(LOG)], "log string, place int, line string")
    got = sorted(tuple(r) for r in numstat.parse(lines, stretch).select("commit_hash", "author_name", "author_email", "file_path", "lines_added", "lines_deleted").collect())
    assert got == [("h1", "Ann van Berg", "ann@x.org", "a.py", 3, 1), ("h3", "Bo", "bo@x.org", "d/{x.py => y.py}", 1, 0)]


def test_log_files(spark, tmp_path):
    (tmp_path / "one.log").write_text("\n".join(LOG))
    assert numstat.parse(numstat.lines_of(spark, str(tmp_path))).count() == 2


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@x.org", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(3):
        (tmp_path / "a.py").write_text(f"def f(x):\n    if x > {i}:\n        return {i}\n" * (i + 1))
        (tmp_path / "b.py").write_text(f"import a\nx = {i}\n")
        run("add", "-A")
        run("commit", "-qm", f"change {i}")
    run("tag", "v1")
    return tmp_path


def test_repository(spark, repo):
    r = Repository(str(repo))
    assert r.commit_count() == 3 and r.changes(spark).count() == 6
    assert {x[0] for x in r.sizes(spark).collect()} == {"a.py", "b.py"} and r.paths(".py") == ["a.py", "b.py"]
    assert r.resolve("v1") == r.commit_dates()[1] and r.resolve("2024-01-01").year == 2024
    with pytest.raises(ValueError):
        r.resolve("nothing")
    with pytest.raises(ValueError):
        Repository(str(repo / "none"))


def test_command_line_keeps_a_run(spark, repo, tmp_path_factory, capsys):
    db = str(tmp_path_factory.mktemp("runs"))
    assert cli.main([str(repo), "--all", "--db", db]) == 0
    assert "Hotspots" in capsys.readouterr().out
    store = RunStore(spark, f"file://{db}")
    (run,) = store.committed()
    assert store.get_run(run)["total_commits"] == 3 and store.child("hotspot_files", run).count() == 2
    assert cli.main([str(repo), "--from", "2020-01-01", "--to", "v1"]) == 0
    assert cli.main([str(repo), "--at", "nothing"]) == 1


@pytest.mark.parametrize("argv", [["r", "--at", "a", "--from", "b", "--to", "c"], ["r", "--from", "b"], ["r", "--all", "--from", "a", "--to", "b"], [], ["r", "--window", "9"]])
def test_arguments_that_clash(argv):
    with pytest.raises(SystemExit):
        cli.arguments(argv)


def test_store(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("a", 1)], "file_path string, n int")
    assert store.committed() == [] and store.runs().count() == 0 and store.get_run("x") is None
    store.save("r1", {"repo_path": "p", "dx_score": 0.25}, {"hotspot_files": rows})
    store.save("r2", {"repo_path": "p", "dx_score": 0.75, "effort_coefficients": [1.0, 2.0]}, {})
    with pytest.raises(ValueError):
        store.save("r1", {}, {})
    with pytest.raises(ValueError):
        store.save("r3", {}, {"nothing": rows})
    bad = rows.selectExpr("file_path", "raise_error('no') AS n")
    with pytest.raises(Exception):  # noqa: B017
        store.save("r4", {"repo_path": "q"}, {"hotspot_files": bad})
    assert store.committed() == ["r1", "r2"] and [r[0] for r in store.list_repos().collect()] == ["p"]
    assert store.child("hotspot_files", "r1").count() == 1 and store.child("file_pain", "r2").count() == 0
    with pytest.raises(KeyError):
        store.child("file_pain", "none")
    assert store.compare("r1", "r2").first()["deltas"]["dx_score"] == 0.5
    assert set(api.TABLES.values()) == set(CHILDREN)
    server = api.serve(store, 0)
    Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}"))  # noqa: E731, S310
    assert get("/api/repos") == ["p"] and len(get("/api/runs?repo=p")) == 2 and get("/api/runs/r1/hotspots")[0]["file_path"] == "a"
    assert get("/api/compare?a=r1&b=r2")["deltas"]["dx_score"] == 0.5
    assert api.answer(store, "/api/runs/none")[0] == api.answer(store, "/api/runs/none/pain")[0] == api.answer(store, "/x")[0] == 404
    server.shutdown()


def test_stream(spark, tmp_path):
    from loamline.streaming.activity import daily_activity

    schema = "commit_hash string, date timestamp, file_path string, lines_added long, lines_deleted long"
    rows = spark.sql("SELECT 'c' commit_hash, timestamp'2024-01-01' date, 'a' file_path, 1L lines_added, 2L lines_deleted FROM range(3)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = daily_activity(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r["rows"], r["churn"]) for r in spark.table("daily").collect()] == [(3, 9)] == [(r["rows"], r["churn"]) for r in daily_activity(rows).collect()]
