import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.functions.patterns import FIELDS

SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def values(spark, xs, f):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=SPACES + "ab .éİ", max_size=12), min_size=30, max_size=60))
def test_strip_and_squeeze_like_python(spark, xs):
    assert values(spark, xs, T.strip) == [x.strip() for x in xs]
    assert values(spark, xs, T.squeeze) == [" ".join(x.split()) for x in xs]


def test_ids(spark):
    row = spark.range(1).select(T.slug(F.lit("A-B"), F.lit("é 1")), T.chain_id(F.lit("s"), F.lit(999)), T.sample_id(F.lit(1234567)), T.sample_id(F.lit(7))).first()
    assert list(row) == ["AB_1", "s_1000", "SPC_1234567", "SPC_000007"]


def test_first_match_stops_at_an_empty_match(spark):
    assert values(spark, ["launched:  . launch: May 5, 1990", "Launch  date: 5 May", "launch: May 5, 1990", "none", None], lambda x: T.first_match(x, FIELDS["list"]["launch_date"])) == ["", "5 May", "May 5, 1990", "", ""]


@pytest.mark.parametrize("style", sorted(FIELDS))
def test_patterns_like_python(spark, style):
    texts = ["Objective: go far\n\nx", "goals:\t a\nb", "AGENCY: one. two", "relaunched: 5 May 1999\n", "Orbit type:  polar\n", "payloads: p", "end of mission: 2001", "rocket: r.", "Ariane 5 ok.", "vehicle:", "objective:"]
    for field, patterns in FIELDS[style].items():
        want = []
        for t in texts:
            found = next((m for p in patterns if (m := re.search(p.replace("(?isdU)", "").replace(r"\z", r"\Z"), t, re.I | re.S))), None)
            want.append(" ".join(found[1].split())[:300] if found else "")
        assert values(spark, texts, lambda x, p=patterns: T.first_match(x, p)) == want, field


def test_document_urls(spark):
    urls = {"http://a/x.PDF": True, "http://a/pdf/": True, "http://a/pdf": False, "http://a/?format=pdf": True, "http://a/?b&type=PDF": True, "http://a/a.pdf#x": True, "http://a b/c.pdf": True, "": False, "http://a/x.pdf;v=1": True}
    assert values(spark, list(urls), T.is_document_url) == list(urls.values())


def test_documents(spark):
    df = spark.createDataFrame([(b"%PDF1",), (b"PDF",), (b"",), (None,)], "c binary")
    assert [r[0] for r in df.select(T.is_document(F.col("c"))).collect()] == [True, False, False, False]
    assert not spark.range(1).select(T.is_document(F.lit(b"%PDF"), F.lit("text/html"))).first()[0]


def test_reasoning(spark):
    assert values(spark, ["<think>a</think> b ", "</think> x", "<think>a", "<think></think>p</think>q"], T.after_reasoning) == ["b", "</think> x", "<think>a", "p</think>q"]


def test_half_even():
    assert [round(n * 0.85) for n in (10, 30)] == [8, 26] and math.floor(0.5) == 0
