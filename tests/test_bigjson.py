"""One JSON value read by ranges, cut everywhere, against the standard library's parser."""

import json
import random

import pytest

from corpusflow.sources import bigjson, files


@pytest.fixture
def ranged(spark):
    """Sets the size of the ranges."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def of(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield of
    for n, v in zip(names, before):
        spark.conf.set(n, v)


NASTY = ['}', '{"', '\\', '\\\\', '\\"', '"', '","', '[{]}', 'é}🙂', '\n}\t', '\\u007d', '} , {', '', 'a' * 70 + '}']


def texts(spark, path, depth=1):
    return [(r["pos"], r["text"]) for r in bigjson.values(spark, str(path), depth).orderBy("pos").collect() if r["text"] is not None]


@pytest.mark.parametrize("size", [3, 7, 16, 40, 1000])
def test_lists_cut_anywhere(spark, tmp_path, ranged, size):
    rng = random.Random(size)
    rows = [{"k": NASTY[i % len(NASTY)], "n": [i, {"x": rng.choice(NASTY)}], "m": {rng.choice(NASTY): i}} for i in range(size % 14, 14 if size > 9 else size % 14 + 4)] + [1, "s}", None, [], {}, [[{"a": "]"}]]]
    path = tmp_path / "list.json"
    path.write_text(json.dumps(rows, ensure_ascii=size % 2 == 0, indent=size % 3 or None), encoding="utf-8")
    ranged(size)
    got = texts(spark, path)
    assert [json.loads(t) for _, t in got] == rows and [p for p, _ in got] == list(range(len(rows)))


@pytest.mark.parametrize("size", [9, 33])
def test_objects_cut_anywhere(spark, tmp_path, ranged, size):
    rows = {f"{k}{i}": {"a": NASTY[i], "b": i} for i, k in enumerate(NASTY)}
    path = tmp_path / "keyed.json"
    path.write_text(json.dumps(rows, indent=2 if size == 9 else None))
    ranged(size)
    assert [json.loads("{" + t + "}") for _, t in texts(spark, path)] == [{k: v} for k, v in rows.items()]
    got = {r["key"]: (r["a"], r["b"]) for r in files.read_keyed(spark, str(path), "a string, b int").collect()}
    assert got == {k: (v["a"], v["b"]) for k, v in rows.items()}
    assert [r["b"] for r in files.read_records(spark, str(path), "b int").orderBy("pos").collect()] == list(range(len(NASTY)))


def test_several_tasks_read_one_file(spark, tmp_path, ranged):
    path = tmp_path / "large.json"
    path.write_text(json.dumps([{"i": i, "t": "x" * (i % 50)} for i in range(5000)]))
    ranged(20_000)
    rows = bigjson.pieces(spark, str(path))
    assert rows.rdd.getNumPartitions() > 5 and rows.select("range").distinct().count() > 5
    got = files.read_records(spark, str(path), "i int, t string").orderBy("pos").collect()
    assert [(r["i"], len(r["t"])) for r in got] == [(i, i % 50) for i in range(5000)]


def test_a_value_over_many_ranges(spark, tmp_path, ranged):
    rows = [{"a": 1}, {"t": "} {" * 300, "u": [{"v": i} for i in range(20)]}, {"a": 2}]
    path = tmp_path / "long.json"
    path.write_text(json.dumps(rows))
    ranged(64)
    assert [json.loads(t) for _, t in texts(spark, path)] == rows


@pytest.mark.parametrize("text", ["", " \n", '[{"a": 1}', '[{"a": 1}, {"a"', '{"k": {"a": 1}', '[{"a": "x}]', '[{"a": 1}]}', "}", "]"])
def test_broken_files_are_empty(spark, tmp_path, text):
    path = tmp_path / "broken.json"
    path.write_text(text)
    assert texts(spark, path) == []
    assert files.read_keyed(spark, str(path), "a int").collect() == [] and files.read_records(spark, str(path), "a int").collect() == []


@pytest.mark.parametrize("text,values", [("[]", []), ("{}", []), ("[ ]\n", []), ("[1]", [1]), ('[{"a":1}]\n\n', [{"a": 1}]), ("[[],{}]", [[], {}]), ('["}"]', ["}"])])
def test_small_files(spark, tmp_path, text, values):
    path = tmp_path / "small.json"
    path.write_text(text)
    assert [json.loads(t) for _, t in texts(spark, path)] == values


def test_missing_files_and_folders_of_several(spark, tmp_path):
    assert files.read_records(spark, str(tmp_path / "none"), "a int").collect() == []
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps([{"a": i}, {"a": 10 + i}]) if i else "[broken")
    assert sorted(r["a"] for r in files.read_records(spark, str(tmp_path), "a int").collect()) == [1, 2, 11, 12]


def test_repeated_keys(spark, tmp_path):
    path = tmp_path / "twice.json"
    path.write_text('{"a": {"n": 1}, "b": {"n": 2}, "a": {"n": 3}}')
    assert {r["key"]: r["n"] for r in files.read_keyed(spark, str(path), "n int").collect()} == {"a": 3, "b": 2}
    assert [r["n"] for r in files.read_records(spark, str(path), "n int").orderBy("pos").collect()] == [3, 2]


@pytest.mark.parametrize("size", [30, 10_000])
def test_results_under_wrappers(spark, tmp_path, ranged, size):
    path = tmp_path / "results.json"
    ranged(size)

    def read(value):
        path.write_text(value if isinstance(value, str) else json.dumps(value))
        return [r["n"] for r in files.read_results(spark, str(path), "n int").orderBy("pos").collect()]

    many = [{"n": i, "x": {"}": "]"}} for i in range(20)]
    assert read(many) == list(range(20))
    assert read({"note": {"n": 9, "l": [{"n": 8}]}, "data": many}) == list(range(20))
    assert read({"records": [{"n": 1}], "data": [{"n": 2}], "missions": 3}) == [2]
    assert read({"records": [{"n": 1}], "data": []}) == []
    assert read({"n": 5, "other": [{"n": 1}]}) == [5] and read([]) == []
    assert read("") == []
    for bad in ("3", '{"data": [{"n": 1}', "[1"):
        with pytest.raises(Exception):
            read(bad)
