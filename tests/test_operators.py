import json

import pandas as pd
from pyspark.sql import functions as F

from corpusflow.operators import acquire, discover, generate, prepare, relational, samples, split, structure
from corpusflow.operators.numbering import number
from corpusflow.sources import files, html, http


def test_html_rules(spark):
    page = '<nav><p>menu menu menu menu menu menu menu</p></nav><p>one <a href="/1">First one</a><a href="/2">two</a><br><p>in <b>ner</b> text &amp; more of it, long enough</p><!-- c --><script>var x</script><li><p>' + "x" * 31 + "</p></li>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, html string")
    assert [tuple(r)[2:] for r in html.html_links(df, "k", within="p").where("pos = 0").collect()] == [("/1", "First one")]
    blocks = [r["text"] for r in html.html_blocks(df, "k").where(F.length("text") > 30).orderBy("pos").collect()]
    assert blocks[-1] == "x" * 31 and blocks[-2] == "x" * 31 and not any("menu" in b or "var" in b for b in blocks)


def test_tables(spark):
    page = """<table><thead><tr><th>a</th></tr></thead><tbody>
    <tr><td class="SNo">1</td><td class="x MissionName">Alpha <b>1</b></td><td class="Orbit">-</td><td class="Remarks">a</td><td class="Remark">b</td></tr>
    <tr><td class="Launch_Vehicle">only a rocket</td></tr></tbody></table>
    <table><tr><td>1</td><td>Beta</td><td>2001</td><td>N/A</td></tr><tr><td>1</td><td>Gamma</td><td>x</td><td>2</td><td>3</td><td>4</td><td>5</td><td>six</td></tr><tr><td>9</td></tr></table>"""
    got = {r["fields"]["name"]: r["fields"] for r in discover.tabled(spark.createDataFrame([(1, page)], "k int, html string"), "k").collect()}
    assert got["Alpha 1"] == {"name": "Alpha 1", "remarks": "b"}
    assert got["Beta"] == {"name": "Beta", "launch_date": "2001"}
    assert got["Gamma"] == {"name": "Gamma", "country": "x", "launch_date": "2", "mass_kg": "3", "launch_vehicle": "4", "col_6": "5", "col_7": "six"}
    assert len(got) == 3


def test_categories_fall_back_by_page(spark):
    pages = [
        (1, "A", "http://h/a/", "<table><tr><td>1</td><td>x</td></tr></table><a href='/mission/1'>Linked</a>"),
        (2, "B", "http://h/b/", "<a href='mission/2'>Two</a><a href='mission/3'>TWO</a><h2>Heading</h2>"),
        (3, "C", "http://h/c/", "<h2>Abcd</h2><b>abc</b><h3>Abcd</h3>"),
    ]
    rows = discover.in_categories(spark.createDataFrame(pages, "k int, category string, url string, html string"), "k", "category", "url").collect()
    assert sorted((r["category"], r["name"], r["source_url"]) for r in rows) == [("B", "Two", "http://h/b/mission/2"), ("C", "Abcd", "")]


def test_cards(spark):
    pages = [(1, "<div class='grid mission'><a href='/x'></a><h3 class='heading'>Card</h3><span class='pillar'>P</span></div><div class='mission'><a href='/y'></a></div><a href='/Applications/z'>Zed</a>"), (2, "<a href='/applications/z'>Zed</a><a href='/other'>Other</a>")]
    rows = discover.carded(spark.createDataFrame(pages, "k int, html string"), "k", "http://b").collect()
    assert sorted((r["k"], r["name"], r["source_url"], r["pillar"]) for r in rows) == [(1, "Card", "http://b/x", "P"), (2, "Zed", "http://b/applications/z", "")]


def test_candidates(spark):
    results = spark.createDataFrame([("m", 0, "http://a/p"), ("m", 1, "http://a/1.pdf"), ("m", 2, "http://a/2.pdf"), ("m", 99, "http://a/9.pdf")], "k string, rank int, url string")
    sniffed = spark.createDataFrame([("m", 0, "http://a/2.pdf"), ("m", 0, "http://a/3.pdf"), ("m", 5, "http://a/3.pdf")], "k string, rank int, url string")
    assert acquire.candidates(results, sniffed, "k").first()["urls"] == ["http://a/1.pdf", "http://a/2.pdf", "http://a/3.pdf", "http://a/3.pdf"]
    assert acquire.to_sniff(results, "k").count() == 1
    got = acquire.fetched(acquire.candidates(results, sniffed, "k"), "k", "urls", lambda u: b"%PDF" if u.endswith("2.pdf") else 1 / 0).first()
    assert got["url"] == "http://a/2.pdf"


def test_structure(spark):
    rows = spark.createDataFrame([("m", "u", ["Launch date: 5 May 2001", "p" * 120 + "\nAgency: ours.", "x"], "text", "now"), ("n", None, [], "none", "now")], "mission_name string, pdf_url string, pages array<string>, method string, scraped_at string")
    one, two = structure.records(rows, "list").orderBy("mission_name").collect()
    assert one["data_source"] == "pdf" and one["structured"]["launch_date"] == "5 May 2001" and one["structured"]["agency"] == "ours" and one["structured"]["summary"].startswith("p" * 120)
    assert two["data_source"] == "webpage" and two["extraction"]["page_count"] == 0 and set(two["structured"]) == {""}


def test_context(spark):
    c = structure.context(F.lit("M"), {"end_date": F.lit(""), "launch_date": F.lit("d")}, F.lit("t" * 51))
    assert spark.range(1).select(c).first()[0] == "Mission: M\nLaunch Date: d\nDetails:\n" + "t" * 51


def test_samples(spark):
    qa = lambda q, a: {"question": q, "answer": a}
    rows = [
        (0, " Org ", "A-B", [{"aspect": " x ", "level_1": qa("q1 ", "a1"), "level_2": qa(" ", "a"), "level_3": None}, {"aspect": None, "level_1": qa("q", None), "level_2": None, "level_3": None}, {"aspect": "y", "level_1": qa("q2", "a2"), "level_2": qa("q3", "a3"), "level_3": qa("q4", "a4")}]),
        (1, "", "skipped", []),
        (2, "Org", "C", [{"aspect": "z", "level_1": qa("q5", "a5"), "level_2": None, "level_3": None}]),
    ]
    from corpusflow.schemas import CHAIN

    df = spark.createDataFrame([(i, o, m, json.dumps(c)) for i, o, m, c in rows], "pos int, organisation string, mission_name string, c string").withColumn("qa_chains", F.from_json("c", f"array<{CHAIN}>"))
    got = samples.flatten(df, "pos").orderBy("sample_id").collect()
    assert [(r["sample_id"], r["chain_id"], r["difficulty"], r["messages"][1]["content"]) for r in got] == [
        ("SPC_000001", "Org_AB_001", "basic", "q1"), ("SPC_000002", "Org_AB_003", "basic", "q2"), ("SPC_000003", "Org_AB_003", "intermediate", "q3"), ("SPC_000004", "Org_AB_003", "advanced", "q4"), ("SPC_000005", "Org_C_001", "basic", "q5"),
    ]
    assert list(samples.accounting(df, "pos").first()) == [3, 1, 7, 5]


def test_split_sizes_and_invariants(spark):
    for n, want in ((0, (0, 0, 0)), (1, (1, 0, 0)), (4, (3, 0, 1)), (6, (5, 1, 0)), (10, (8, 1, 1)), (15, (13, 2, 0)), (20, (17, 2, 1))):
        df = spark.range(n + 1).select(F.format_string("c%03d", "id").alias("chain_id"), F.lit("o").alias("org"), F.lit("m").alias("mission_name"))
        got = dict(split.assign(df).groupBy("split").count().collect())
        assert (got.get("train", 0) - 1, got.get("validation", 0), got.get("test", 0)) == want


def test_split_any_partitioning(spark):
    df = spark.range(300).select(F.format_string("c%03d", "id").alias("chain_id"), F.when(F.col("id") % 3 > 0, "big").alias("org"), (F.col("id") % 40).cast("string").alias("mission_name"))
    a, b = (sorted(split.assign(df.repartition(n)).select("chain_id", "split").collect()) for n in (1, 9))
    assert a == b and len(a) == 300


def test_numbering(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("x"), F.when(F.col("id") % 2 == 0, "k").alias("k"))
    assert sorted(r["n"] for r in number(df, ["x"]).collect()) == list(range(1, 101))
    assert all(r["n"] == sum(1 for s in df.collect() if s["k"] == r["k"] and s["x"] <= r["x"]) for r in number(df, ["x"], ["k"]).collect())


def test_lenient_json():
    assert json.loads(generate.lenient('x {"a": 1} y')) == {"a": 1}
    assert json.loads(generate.lenient('[{"a": 1}]')) == {"a": 1}
    assert json.loads(generate.lenient('[{"a": 1}, {"b": 2}]')) == [{"a": 1}, {"b": 2}]
    assert generate.lenient('{"a":1} x }') is None and generate.lenient("") is None and generate.lenient("}{") is None
    assert json.loads(generate.lenient('```json\n{"a": 1, "a": 2}\n```')) == {"a": 2}


def test_generation_retries_and_drops(spark):
    calls = []

    def complete(prompts: pd.Series):
        return ["<think>{</think>" + json.dumps({k: {"question": "q", "answer": "a"} for k in generate.LEVELS}) if '"a"' in p else "no" for p in prompts]

    rows = spark.createDataFrame([("o", "m", "", "", "c" * 60), ("o", "short", "", "", "c")], "organisation string, mission_name string, source_url string, scraped_at string, context string")
    got = generate.chains(rows, complete, aspects=("b", "a")).collect()
    assert [(r["mission_name"], r["total_chains"], r["qa_chains"][0]["aspect"]) for r in got] == [("m", 1, "a")] and not calls


def test_prepare(spark):
    m = [{"role": "developer", "content": "s"}, {"role": "user", "content": " "}, {"role": "assistant", "content": "yes it is"}]
    df = spark.createDataFrame([(1, m), (2, [{"role": "user", "content": "q"}]), (3, [])], "id int, messages array<struct<role:string,content:string>>")
    got = prepare.examples(df, "id").collect()
    assert [r["id"] for r in got] == [1] and got[0]["labels"][:4] == [-100] * 4 and len(got[0]["labels"]) == len(got[0]["input_ids"]) == 8
    short = spark.createDataFrame([(0, [1] * n, [1] * n, [1] * n) for n in (7, 9)], "b int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    assert {len(r["input_ids"]) for r in prepare.padded(short, "b").collect()} == {16}
    lines = spark.createDataFrame([('{"sample_id":null}',), (json.dumps(dict.fromkeys(prepare.REQUIRED)),), ("x",)], "l string")
    assert [r[0] for r in lines.select(prepare.missing_field(F.col("l"))).collect()] == [True, False, True]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 5, "x"), ("b", 1, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("a", 1, None)], "k string, seq int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"], ["seq"]).collect())) == [("a", 1, None), ("b", 1, "y")]
    both = old.withColumn("s", F.lit(0)).union(new.withColumn("s", F.lit(1)))
    assert dict(relational.merge_fields(both, ["k"], ["s", "seq"], ["v"]).collect()) == {"a": "x", "b": "y"}


def test_files(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"a": {"x": 1}, "b": {"x": 2}}')
    (tmp_path / "bad.json").write_text("{")
    assert sorted(map(tuple, files.read_keyed(spark, str(tmp_path / "k.json"), "x int").collect())) == [("a", 1), ("b", 2)]
    assert files.read_keyed(spark, str(tmp_path / "bad.json"), "x int").count() == files.read_keyed(spark, str(tmp_path / "none.json"), "x int").count() == 0
    for text, n in (('[{"x": 1}, {"x": 2}]', 2), ('{"data": [{"x": 1}]}', 1), ('{"results": 5, "records": [{"x": 1}, {"x": 3}, {"x": 4}]}', 3), ('{"x": 9}', 1)):
        (tmp_path / "r.json").write_text(text)
        assert files.read_results(spark, str(tmp_path / "r.json"), "x int").count() == n
        spark.catalog.clearCache()
    (tmp_path / "l.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": null}\n')
    good, rejects = files.read_lines(spark, str(tmp_path / "l.jsonl"), "x int")
    assert [r["x"] for r in good.collect()] == [1, None] and [r["line"] for r in rejects.collect()] == ["{bad"]
    files.write_lines(good, str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"x":1}', '{"x":null}']


def test_fetching_without_a_network(spark):
    urls = spark.createDataFrame([("a",), ("b",)], "url string")
    rows = http.fetch_pages(urls, fetch=lambda u: (200, "text/html", b"x") if u == "a" else 1 / 0).orderBy("url").collect()
    assert rows[0]["body"] == b"x" and rows[1]["body"] is None and "zero" in rows[1]["error"]
    assert [tuple(r) for r in http.search(urls.withColumnRenamed("url", "n"), "n", lambda n: [{"href": n}, {"url": "u"}, {}] if n == "a" else 1 / 0).collect()] == [("a", 0, "a"), ("a", 1, "u"), ("a", 2, "")]


def test_a_tokenizer_gets_few_texts_at_a_time(spark):
    def tokenizer(texts):
        assert len(texts) <= 64
        return prepare.word_tokens(texts)

    turns = [F.struct(F.lit(r).alias("role"), F.concat(F.lit(f"{r} "), F.col("id").cast("string"), F.lit(" words")).alias("content")) for r in ("user", "assistant")]
    rows = spark.range(0, 5000, 1, 1).select("id", F.array(*turns).alias("messages"))
    found = prepare.examples(rows, "id", tokenizer=tokenizer)
    assert sorted(map(str, found.collect())) == sorted(map(str, prepare.examples(rows, "id").collect())) and found.count() == 5000
    assert str(found._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1 and "ArrowEvalPython" not in str(found._jdf.queryExecution().executedPlan())


def test_padding_tokenises_few_texts_at_a_time(spark):
    def tokenizer(texts):
        assert len(texts) <= 64
        return prepare.word_tokens(texts)

    rows = spark.range(0, 1000, 1, 1).select("id", F.array(*[F.struct(F.lit(r).alias("role"), F.repeat(F.lit("word "), (F.col("id") % 9 + 3).cast("int")).alias("content")) for r in ("user", "assistant")]).alias("messages"))
    found = prepare.padded(prepare.batched(prepare.examples(rows, "id", tokenizer=tokenizer), "id"), "batch")
    assert found.count() == 1000 and found.select("batch").distinct().count() == 63 and found.where("size(input_ids) % 8 <> 0 or size(input_ids) <> size(labels)").isEmpty()


def test_a_tokenizer_gets_few_long_texts_at_a_time(spark):
    def tokenizer(texts):
        assert len(texts) == 1 or sum(len(t or "") for t in texts) <= 1 << 19
        return prepare.word_tokens(texts)

    content = lambda role: F.when(F.col("id") % 50 == 7, F.repeat(F.lit(f"{role} "), 200_000)).otherwise(F.repeat(F.concat(F.lit(f"{role} "), F.col("id").cast("string"), F.lit(" ")), (F.col("id") % 5 * 1000 + 1).cast("int")))
    rows = spark.range(0, 300, 1, 1).select("id", F.array(*[F.struct(F.lit(r).alias("role"), content(r).alias("content")) for r in ("assistant", "user")]).alias("messages"))
    found = prepare.tokenised(rows.select("id", prepare.rendered(F.col("messages")).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("a b c")).alias("shown")), tokenizer).collect()
    assert [r["id"] for r in found] == list(range(300)) and all(r["prefix"] == (3 if r["id"] % 3 else 0) for r in found)
    size = lambda i: 400_006 if i % 50 == 7 else 4 * (i % 5 * 1000 + 1) + 6
    assert all(abs(len(r["input_ids"]) - min(size(r["id"]), 2048)) <= 4 for r in found) and {len(r["input_ids"]) for r in found} >= {2048}
