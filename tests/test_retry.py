"""Failed work, timers and dead letters."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import generate
from corpusflow.streaming import retry

SCHEMA = "mission string, aspect string, at timestamp, n long, ok boolean"
START = datetime(2024, 1, 1)


def log(spark, *rows):
    return spark.createDataFrame([(m, a, START + timedelta(seconds=t) if t is not None else None, i, ok) for i, (m, a, t, ok) in enumerate(rows)], SCHEMA)


def after(spark, base, parts, **limits):
    """What each of several runs gives, over a log that grows."""
    out = []
    for part in parts:
        part.repartition(2).write.mode("append").parquet(f"{base}/in")
        retry.follow(spark, f"{base}/in", SCHEMA, f"{base}/state", lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), ["mission", "aspect"], order="n", **limits)
        rows = spark.read.parquet(f"{base}/out").collect()
        out.append(sorted((r["mission"] or "", r["aspect"] or "", r["kind"], (r["at"] - START).total_seconds(), r["failures"]) for r in rows))
    return out


def test_three_runs(spark, tmp_path):
    parts = [
        log(spark, ("a", "x", 0, False), ("b", "x", 1, False), ("b", "x", 2, True), ("c", None, 3, False), (None, "x", 3, True), ("d", "x", None, False), ("d", "x", 4, None)),
        log(spark, ("a", "x", 12, False), ("z", "z", 14, True)),
        log(spark, ("a", "x", 50, False), ("c", None, 51, True), ("z", "z", 200, True)),
    ]
    one, two, three = after(spark, str(tmp_path), parts, wait=10)
    assert one == []  # the timers run on: the log ends at 3
    assert two == [("a", "x", "retry", 10.0, 1), ("c", "", "retry", 13.0, 1)]
    assert three == [("a", "x", "dead", 50.0, 3), ("a", "x", "retry", 10.0, 1), ("a", "x", "retry", 32.0, 2), ("c", "", "retry", 13.0, 1)]


@pytest.mark.parametrize("cuts", [(3,), (1, 2, 5), (2, 4, 6)])
def test_runs_may_be_cut_anywhere(spark, tmp_path, cuts):
    rows = [("a", "x", t, ok) for t, ok in ((0, False), (5, False), (40, False), (41, False), (60, True), (61, False), (300, True))]
    whole = log(spark, *rows).orderBy("at")
    parts = [whole.where(F.col("n").between(low, high - 1)) for low, high in zip((0, *cuts), (*cuts, len(rows)))]
    assert after(spark, str(tmp_path), parts, wait=10)[-1] == [
        ("a", "x", "dead", 40.0, 3), ("a", "x", "retry", 25.0, 2), ("a", "x", "retry", 51.0, 1), ("a", "x", "retry", 71.0, 1),
    ]


def test_a_repeated_run_changes_nothing(spark, tmp_path):
    part = log(spark, ("a", "x", 0, False), ("z", "z", 100, True))
    first, second = after(spark, str(tmp_path), [part, part.limit(0)], wait=10)
    assert first == second == [("a", "x", "retry", 10.0, 1)]


def test_chains_that_fail_are_due_again_and_then_dead(spark, tmp_path):
    requests = spark.createDataFrame([("m1", "x", "good"), ("m1", "y", "late"), ("m2", "x", "never")], "mission string, aspect string, prompt string")
    base, now, calls, wanted = str(tmp_path), START, [], requests

    for turn in range(3):
        def complete(prompts: pd.Series, turn=turn) -> list[str]:
            return [json.dumps({k: {} for k in generate.LEVELS}) if p == "good" or (p == "late" and turn == 1) else "no" for p in prompts]

        made = generate.attempted(wanted, complete, F.lit(now)).withColumn("n", F.lit(turn).cast("long"))
        made.write.parquet(f"{base}/made/{turn}")
        made = spark.read.parquet(f"{base}/made/{turn}")
        calls.append(sorted(r["prompt"] for r in made.collect()))
        tick = log(spark, ("clock", "", 0, True)).withColumn("at", F.lit(now + timedelta(seconds=1000)))  # time goes on, whoever tries
        (result,) = after(spark, base, [made.select("mission", "aspect", "at", "n", "ok"), tick], wait=60)[-1:]
        seen = spark.read.parquet(f"{base}/out")
        due, dead = retry.split_dead(seen.where(F.col("failures") == turn + 1))
        wanted, now = requests.join(due, ["mission", "aspect"], "left_semi"), now + timedelta(seconds=2000)
    assert calls == [["good", "late", "never"], ["late", "never"], ["never"]]
    assert [(r["mission"], r["aspect"]) for r in dead.collect()] == [("m2", "x")] and wanted.isEmpty()
