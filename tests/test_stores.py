import http.server
import json
import threading
from pathlib import Path

import pytest

from corpusflow.__main__ import main
from corpusflow.operators.relational import saved
from corpusflow.sources import files, http as web


def text_of(folder):
    (part,) = Path(folder).glob("part-*")
    return part.read_text(encoding="utf-8")


def test_array_is_one_list_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i == 3 else f"é{i}") for i in range(40)], "n int, t string").repartition(7)
    files.write_array(rows, str(tmp_path / "a"), ["n"])
    assert json.loads(text_of(tmp_path / "a")) == [{"n": i, "t": None if i == 3 else f"é{i}"} for i in range(40)]
    assert "é5" in text_of(tmp_path / "a") and [r["n"] for r in files.read_records(spark, str(tmp_path / "a"), "n int").orderBy("pos").collect()] == list(range(40))
    files.write_array(rows.where("n < 0"), str(tmp_path / "none"), ["n"])
    assert json.loads(text_of(tmp_path / "none")) == []


def test_prior_results(spark, tmp_path):
    record = "mission_name string, n int"
    (tmp_path / "good").write_text(json.dumps([{"mission_name": "a", "n": 1}, {"mission_name": "b"}, {"mission_name": "a"}]))
    results, done = files.prior_results(spark, str(tmp_path / "good"), record)
    assert results.count() == 3 and sorted(r[0] for r in done.collect()) == ["a", "b"]
    (tmp_path / "broken").write_text('[{"mission_name": ')
    for name in ("broken", "missing"):
        results, done = files.prior_results(spark, str(tmp_path / name), record)
        assert results.where("mission_name is not null").isEmpty() and done.isEmpty()


def test_saved_records(spark):
    status = spark.createDataFrame([("a", "c", "ok"), ("a", "c", "ok"), ("b", "c", "failed"), ("z", "c", "ok")], "name string, category string, status string")
    store = spark.createDataFrame([("a", 1), ("b", 2), ("c::a", 3)], "key string, n int")
    assert [r["n"] for r in saved(status, store).collect()] == [1]
    assert [r["n"] for r in saved(status, store, category="category").collect()] == [3]


def test_completer_tries_errors_again_but_not_empty_replies():
    calls = []

    def post(url, payload, timeout):
        calls.append((payload["prompt"], timeout))
        if payload["prompt"] == "bad" or (payload["prompt"] == "late" and len([c for c in calls if c[0] == "late"]) < 3):
            raise OSError
        return {"response": " hi " if payload["prompt"] != "empty" else ""}

    assert web.completer("u", "m", pause=0, post=post)(["ok", "empty", "late", "bad"]) == ["hi", "", "hi", ""]
    assert [sum(c[0] == p for c in calls) for p in ("ok", "empty", "late", "bad")] == [1, 1, 3, 3] and calls[0][1] == 240


def test_open_store():
    class Client:
        def __init__(self, up):
            self.up, self.keys = up, []

        def ping(self):
            if not self.up:
                raise OSError

        def unique_index(self, key):
            self.keys.append(key)

    assert web.open_store("", lambda u: Client(True), "k") is None and web.open_store("u", lambda u: Client(False), "k") is None
    assert web.open_store("u", lambda u: Client(True), "k").keys == ["k"]


@pytest.fixture
def served():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = b"x" * 100_000
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            try:
                self.wfile.write(body)
            except OSError:
                pass

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()
    server.server_close()


def test_limits_of_size(served):
    assert len(web.get(served)[2]) == 100_000 and len(web.peek(served)[2]) == 80_000
    with pytest.raises(ValueError):
        web.get(served, most=99_999)


def test_command_line(spark, tmp_path):
    chain = {"aspect": "A", **{f"level_{i}": {"question": f"q{i}", "answer": f"a{i}"} for i in (1, 2, 3)}}
    data = [{"organisation": "O", "mission_name": f"m{i}", "source_url": "", "qa_chains": [chain]} for i in range(6)]
    (tmp_path / "in.json").write_text(json.dumps({"data": data}))
    out = tmp_path / "out"
    assert main(["dataset", "--input", str(tmp_path / "in.json"), "--output", str(out), "--skip", "1", "--limit", "4", "--array"], spark) == 0
    rows = json.loads(text_of(out / "array"))
    assert len(rows) == 12 and {r["mission_name"] for r in rows} == {"m1", "m2", "m3", "m4"} and [m["role"] for m in rows[0]["messages"]] == ["developer", "user", "assistant"]
    assert spark.read.json(str(out / "samples")).count() == 12 and json.loads(text_of(out / "metrics"))["samples"] == 12
    assert main(["dataset", "--input", str(tmp_path / "no.json"), "--output", str(out)], spark) == 1
