"""Pacing, sessions and second tries against a local server, and the schedule by itself."""

import http.server
import threading
import time
from collections import defaultdict
from email.utils import formatdate

import pytest
from pyspark.sql import functions as F

from corpusflow.sources import http as web
from corpusflow.sources.polite import Answer, Bucket, Politeness, fetch_politely, host_of, paced, retry_after


class Handler(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def log_message(self, *a):
        pass

    def setup(self):
        super().setup()
        with self.server.lock:
            self.server.connections += 1

    def do_GET(self):
        server, path = self.server, self.path
        with server.lock:
            server.seen[path].append(time.monotonic())
            server.all.append((time.monotonic(), path))
            n = len(server.seen[path])
        status, headers, body = 200, {}, path.encode()
        if path == "/late" and n < 3:
            status, headers = 503, {"Retry-After": "1"}
        elif path == "/busy":
            status = 503
        elif path in ("/401", "/403", "/404"):
            status = int(path[1:])
        elif path == "/":
            headers = {"Set-Cookie": "pass=yes; Path=/"}
        elif path == "/inner":
            status = 200 if "pass=yes" in (self.headers.get("Cookie") or "") else 403
        elif path == "/moved":
            status, headers = 302, {"Location": "/there"}
        elif path == "/large":
            body = b"x" * 5000
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.daemon_threads, s.lock, s.seen, s.all, s.connections = True, threading.Lock(), defaultdict(list), [], 0
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def rows_of(spark, server, paths, limits, host="127.0.0.1", parallel=4):
    base = f"http://{host}:{server.server_port}"
    urls = spark.createDataFrame([(base + p, i) for i, p in enumerate(paths)], "url string, status_of int").repartition(4)
    return {r["url"].removeprefix(base): r for r in fetch_politely(urls, limits=limits, parallel=parallel).collect()}


def test_no_host_sees_more_than_its_rate(spark, server):
    paths = [f"/p{i}" for i in range(24)]
    got = rows_of(spark, server, paths, Politeness(rate=20, burst=2))
    assert sorted(got) == sorted(paths) and all(r["status"] == 200 and r["body"] == p.encode() and r["attempts"] == 1 for p, r in got.items())
    times = [t for t, _ in sorted(server.all)]
    # of any requests in a row, those beyond the burst took their time
    assert all(times[j] - times[i] > (j - i - 2) / 20 - 0.02 for i in range(len(times)) for j in range(i + 2, len(times)))
    assert server.connections <= 2  # kept alive


def test_what_failed_for_now_is_asked_again_and_what_is_final_is_not(spark, server):
    limits = Politeness(rate=100, burst=10, attempts=3, pause=0.1, most=4000)
    got = rows_of(spark, server, ["/late", "/busy", "/401", "/403", "/404", "/moved", "/large", "/ok"], limits)
    late = server.seen["/late"]
    assert got["/late"]["status"] == 200 and got["/late"]["attempts"] == 3 and all(b - a >= 0.99 for a, b in zip(late, late[1:]))
    busy = server.seen["/busy"]
    assert got["/busy"]["status"] == 503 and got["/busy"]["body"] == b"" and len(busy) == 3 and busy[1] - busy[0] >= 0.09 and busy[2] - busy[1] >= 0.19
    for p in ("/401", "/403", "/404"):
        assert got[p]["status"] == int(p[1:]) and len(server.seen[p]) == 1
    assert got["/moved"]["body"] == b"/there" and got["/ok"]["body"] == b"/ok"
    assert got["/large"]["status"] is None and got["/large"]["error"] == "too large" and got["/large"]["body"] is None and len(server.seen["/large"]) == 1


def test_a_session_brings_its_cookies(spark, server):
    assert rows_of(spark, server, ["/inner"], Politeness(rate=100))["/inner"]["status"] == 403
    got = rows_of(spark, server, ["/inner", "/x"], Politeness(rate=100, warm="/"), host="localhost")
    assert got["/inner"]["status"] == 200 and len(server.seen["/"]) == 1


def test_addresses_that_are_none(spark):
    urls = spark.createDataFrame([(None,), ("",), ("nonsense",), ("http://127.0.0.1:1/closed",), ("ftp://a/b",)], "url string")
    got = fetch_politely(urls, limits=Politeness(rate=1000, attempts=2, pause=0.01)).collect()
    assert len(got) == 5 and all(r["body"] is None and r["status"] is None and r["error"] for r in got)
    assert {r["url"]: r["attempts"] for r in got}["http://127.0.0.1:1/closed"] == 2
    assert fetch_politely(urls.limit(0)).collect() == []


def test_hosts(spark):
    urls = ["http://A.org/x", "https://u:p@a.org:8080/x?q", "nonsense", None, "HTTP://b.org"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h")).collect()
    assert [r["h"] for r in rows] == ["a.org", "a.org:8080", "", "", "b.org"]


def test_retry_after_header():
    assert retry_after("7") == 7 and retry_after(None) is None and retry_after("soon") is None
    assert retry_after(formatdate(1000, usegmt=True), now=990) == 10 and retry_after(formatdate(1000, usegmt=True), now=2000) == 0


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def run(requests, answers, limits, full=True):
    clock, asked = Clock(), []

    def ask(url):
        asked.append((round(clock.now, 6), url))
        return answers(url, sum(u == url for _, u in asked))

    return list(paced(requests, ask, limits, full, clock, clock.sleep)), asked


def test_a_slow_host_holds_up_no_other():
    requests = [("a", "a1", 1), ("b", "b1", 2), ("a", "a2", 3), ("b", "b2", 4), ("a", "a3", 5)]

    def answers(url, n):
        return Answer(503, "", b"", None, 50.0) if url == "a1" and n == 1 else Answer(200, "", b"", None)

    out, asked = run(requests, answers, Politeness(rate=1))
    assert asked == [(0, "a1"), (0, "b1"), (1, "a2"), (1, "b2"), (2, "a3"), (50, "a1")]
    assert [(i, a.status, n) for i, a, n in out] == [(2, 200, 1), (3, 200, 1), (4, 200, 1), (5, 200, 1), (1, 200, 2)]


def test_pauses_grow_and_end():
    out, asked = run([("a", "u", 0)], lambda *_: Answer(None, None, None, "no network"), Politeness(rate=100, attempts=4, pause=1))
    assert [t for t, _ in asked] == [0, 1, 3, 7] and out[0][2] == 4 and out[0][1].error == "no network"
    _, asked = run([("a", "u", 0)], lambda *_: Answer(429, "", b"", None, 9999.0), Politeness(rate=100, attempts=2, longest=30))
    assert [t for t, _ in asked] == [0, 30]
    _, asked = run([("a", str(i), i) for i in range(3)], lambda *_: Answer(200, "", b"", None), Politeness(rate=0.5), full=False)
    assert [t for t, _ in asked] == [2, 4, 6]


def test_bursts():
    b = Bucket(2.0, 3, 0.0)
    assert [b.take(0.0) for _ in range(3)] == [0, 0, 0] and b.take(0.0) == pytest.approx(0.5) and b.take(0.5) == 0


def test_many_requests_are_not_held_at_once():
    taken = [0]

    def source():
        for i in range(5000):
            taken[0] += 1
            yield f"h{i}", f"u{i}", i

    most, done = 0, 0
    for _ in paced(source(), lambda u: Answer(200, "", b"", None), Politeness(rate=1), True, clock := Clock(), clock.sleep):
        done += 1
        most = max(most, taken[0] - done)
    assert done == 5000 and most <= 1000


def test_searches_are_spaced(spark):
    names = spark.createDataFrame([(f"n{i}",) for i in range(6)], "name string")
    began = time.monotonic()
    rows = web.search(names, "name", lambda n: [{"href": f"http://x/{n}"}], pause=0.2, parallel=2).collect()
    assert len(rows) == 6 and time.monotonic() - began >= 0.8


def test_page_source_groups_addresses(spark, server):
    spark.dataSource.register(web.PageSource)
    base = f"http://127.0.0.1:{server.server_port}"
    df = spark.read.format("pages").option("urls", "\n".join([f"{base}/a", f"{base}/b", f"{base}/403"])).option("rate", "50").option("tasks", "3").load()
    assert df.rdd.getNumPartitions() == 1
    assert {r["url"].removeprefix(base): (r["status"], bytes(r["body"])) for r in df.collect()} == {"/a": (200, b"/a"), "/b": (200, b"/b"), "/403": (403, b"")}
