import json

from pyspark.sql import functions as F

from corpusflow.operators import generate, relational
from corpusflow.plans import runs

PAGE = "<p>" + "A long text block of the page of this entry. " * 2 + "</p>"
SITE = {
    "http://s/a.pdf": ("application/pdf", b"%PDF" + b"Launch date: 5 May 2001\x0c" + b"p" * 60),
    "http://s/sniff": ("text/html", b"<a href='x'>x</a><a href='/b.PDF'>doc</a>"),
    "http://s/b.PDF": ("application/pdf", b"%PDFAgency: ours.\x0c"),
    "http://e/c": ("text/html", b"<a href='c.pdf'>c</a>" + PAGE.encode()),
    "http://e/c.pdf": ("text/html", b"%PDF no"),
    "http://e/d": ("text/html", PAGE.encode()),
}
RESULTS = {"a": [{"href": "http://s/none.pdf"}, {"href": "http://s/a.pdf"}], "b": [{"url": "http://s/sniff"}]}


def tools():
    def fetch(url):
        if url not in SITE:
            return 404, "", b""
        return 200, *SITE[url]

    return runs.Tools(ask=lambda q: RESULTS.get(q.rsplit(" ", 1)[1], []), fetch=fetch, read=lambda b: b[4:].decode().split("\x0c"))


def test_scrape_by_tiers(spark):
    refs = spark.createDataFrame([("a", "http://e/a"), ("b", ""), ("c", "http://e/c"), ("d", "http://e/d"), ("e", "http://e/none"), ("f", None)], "name string, source_url string")
    records, status = runs.scrape(refs, "Org", "list", tools(), clock=F.timestamp_seconds(F.lit(0)))
    got = {r["mission_name"]: r for r in records.collect()}
    assert {k: (v["data_source"], v["extraction"]["method"]) for k, v in got.items()} == {"a": ("pdf", "text"), "b": ("pdf", "text"), "c": ("webpage", "webpage"), "d": ("webpage", "webpage")}
    assert got["a"]["structured"]["launch_date"] == "5 May 2001" and got["b"]["structured"]["agency"] == "ours" and got["a"]["scraped_at"] == "1970-01-01T00:00:00.000000+00:00"
    assert list(relational.run_summary(status).first()) == [6, 2, 2, 2]
    assert [tuple(r) for r in relational.failures(status).orderBy("n").collect()] == [(1, "e"), (2, "f")]


def test_tables_always_give_a_record(spark):
    refs = spark.createDataFrame([("e", "", "2001", "R")], "name string, source_url string, launch_date string, launch_vehicle string")
    records, _ = runs.scrape(refs, "Org", "tables", tools())
    row = records.first()
    assert row["extraction"]["method"] == "table_only" and row["structured"]["launch_date"] == "2001"


def test_from_records_to_batches(spark):
    text = lambda n: {"full_text": f"{n} " + "t" * 60}
    rows = [(i, f"m{i}", text(i), {"objective": "o"}) for i in range(9)]
    records = spark.createDataFrame([(i, m, json.dumps(e), json.dumps(s)) for i, m, e, s in rows], "pos int, mission_name string, e string, s string")
    fields = ",".join(f"{k}:string" for k in ("objective", "summary", "launch_date", "end_date", "agency", "spacecraft", "orbit", "instruments"))
    records = records.select("pos", "mission_name", F.from_json("e", "struct<full_text:string>").alias("extraction"), F.from_json("s", f"struct<{fields}>").alias("structured"), F.lit("").alias("source_url"), F.lit("").alias("scraped_at"))
    done = spark.createDataFrame([("m0",)], "mission_name string")
    results = runs.generate_chains([("A", records.where("pos < 6")), ("B", records.where("pos > 3"))], done, generate.stub)
    assert {(r["organisation"], r["mission_name"], r["total_chains"]) for r in results.collect()} == {("A" if i < 6 else "B", f"m{i}", 10) for i in range(1, 9)}
    numbered = results.withColumn("pos", F.substring("mission_name", 2, 1).cast("int"))
    flat, assigned, counts = runs.dataset(numbered)
    assert flat.count() == 8 * 30 and assigned.count() == 80 and flat.groupBy("chain_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert assigned.where("split = 'train'").select("mission_name").distinct().count() == 8 and list(counts.first()) == [8, 0, 0, 240]
    batches = runs.training(flat)
    assert batches.count() == 240 and batches.where(F.size("input_ids") % 8 != 0).isEmpty() and batches.groupBy("batch").agg(F.count_distinct(F.size("labels")).alias("n")).where("n > 1").isEmpty()
    sizes = [r["count"] for r in runs.training(flat, batch=32).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [32] * 7 + [16]


INDEX = "<p><a href='/e/a'>Alpha</a></p><p><a href='/e/d'>Delta</a> <a href='/e/x'>no</a></p><p><a href='/e/d2'>delta</a></p><p><a href='/other'>Other</a></p>"
TABLES = "<table><tr><td>1</td><td><a href='/e/d'>Delta</a></td><td>2001</td></tr><tr><td>2</td><td>Nothing</td><td>2002</td></tr></table>"
POSTED = []


def _answer(url, payload, timeout):
    POSTED.append(payload)
    return {"response": json.dumps({k: {"question": "q", "answer": "a"} for k in generate.LEVELS})}


def _index_tools():
    site = {"http://i/list": INDEX, "http://i/tables": TABLES, "http://i/e/d": "<p>" + "A text block of over thirty characters. " * 3 + "</p>"}
    return runs.Tools(ask=lambda q: [], fetch=lambda u: (200, "text/html", site[u].encode()) if u in site else (404, "", b""), read=lambda b: [])


TOOLS = _index_tools()


def test_command_line_of_a_whole_run(spark, tmp_path, monkeypatch):
    from corpusflow import __main__ as command
    from corpusflow.sources.keyed import KeyedStore

    (tmp_path / "pages").write_text("http://i/list\n\nhttp://i/none\n")
    out = str(tmp_path / "out")
    call = ["scrape", "--pages", str(tmp_path / "pages"), "--org", "Org", "--style", "list", "--match", "^/e/", "--tools", "test_runs:TOOLS", "--output", out]
    assert command.main(call, spark) == 0
    assert [r["mission_name"] for r in KeyedStore(spark, f"{out}/store", ["mission_name"]).read().collect()] == ["Delta"]
    read = lambda name: [json.loads(line) for f in sorted((tmp_path / "out" / name).glob("part-*")) for line in f.read_text().splitlines()]
    assert {r["name"]: r["status"] for r in read("status")} == {"Alpha": "failed", "Delta": "ok"} and read("failures") == [{"n": 1, "name": "Alpha"}]
    assert read("metrics") == [{"failed": 1, "ok_document": 0, "ok_other": 1, "total": 2}]
    assert command.main([*call, "--filter", "DELT"], spark) == 0 and read("status") == []  # done already
    assert command.main([*call, "--again", "--limit", "1", "--skip", "1"], spark) == 0 and [r["name"] for r in read("status")] == ["Delta"]

    (tmp_path / "tables").write_text("Launched\thttp://i/tables\nPlanned\thttp://i/list\n")
    call = ["scrape", "--pages", str(tmp_path / "tables"), "--org", "Org", "--style", "tables", "--category", "launch", "--tools", "test_runs:TOOLS", "--output", str(tmp_path / "t")]
    assert command.main(call, spark) == 0
    store = {r["mission_name"]: r["data_source"] for r in KeyedStore(spark, str(tmp_path / "t" / "store"), ["mission_name"]).read().collect()}
    assert set(store) == {"Delta", "Nothing"}

    monkeypatch.setattr(command, "completer", lambda url, model: generate.stub)
    made = ["generate", "--records", f"{out}/store", "--org", "Org", "--url", "http://x", "--model", "m", "--output", str(tmp_path / "g")]
    assert command.main(made, spark) == 0
    results = KeyedStore(spark, str(tmp_path / "g" / "store"), ["mission_name"])
    assert [(r["mission_name"], r["total_chains"]) for r in results.read().collect()] == [("Delta", 10)]
    assert command.main(made, spark) == 0 and results.version() == 1  # nothing new
    assert command.main(["generate", *made[1:2], str(tmp_path / "nowhere"), *made[3:]], spark) == 1
