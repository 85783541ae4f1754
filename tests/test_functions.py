"""Golden rows for the scalar expressions (FIXTURES §3)."""

import pytest
from pyspark.sql import functions as F

from headline_engine.config import EngineConfig
from headline_engine.functions import score, similarity as S, text as X

REF = EngineConfig()


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} {_t(cols[n])}" for n in names))
    return df.select(expr.alias("v")).first()["v"]


def _t(v):
    if isinstance(v, list):
        return "array<int>"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "int"
    return "string"


@pytest.mark.parametrize("ranks,expected", [
    ([1], 1.0), ([5], 0.52), ([1, 3], 1.0), ([2, 15], 0.720588), ([11], 0.354545), ([1, 12, 30], 0.975194),
])
def test_weight(spark, ranks, expected):
    assert one(spark, score.weight_of_ranks("r"), r=ranks) == pytest.approx(expected, abs=1e-6)


def test_clean_title_js_whitespace(spark):
    assert one(spark, X.clean_title("t"), t="　  A ﻿\n") == "A"
    assert one(spark, X.clean_title("t"), t="\u0085A") == "\u0085A"  # NEL is not JS whitespace


@pytest.mark.parametrize("a,b,j,d,sim", [
    ("比亚迪发布新款电动车", "比亚迪发布新款电动汽车", 0.909091, 1, 0.909091),
    ("央行宣布降息", "央行宣布降准降息", 0.857143, 2, 0.814286),
    ("OpenAI发布新模型", "OpenAI发布了新模型", 0.857143, 1, 0.880952),
    ("甲乙丙丁戊", "甲乙丙丁己", 0.666667, 1, 0.72),
    ("甲乙丙丁", "丁丙乙甲", 1.0, 4, 0.6),
])
def test_similarity_reference_mode(spark, a, b, j, d, sim):
    ka, kb = X.title_key("a"), X.title_key("b")
    ta, tb = X.tokens("a", ka, "reference"), X.tokens("b", kb, "reference")
    assert one(spark, S.jaccard(ta, tb), a=a, b=b) == pytest.approx(j, abs=1e-6)
    assert one(spark, F.levenshtein(ka, kb), a=a, b=b) == d
    for budget in (True, False):
        h = S.hybrid_sim(ka, kb, ta, tb, F.length(ka), F.length(kb), REF, budget=budget)
        got = one(spark, h, a=a, b=b)
        if sim > 0.8:
            assert got == pytest.approx(sim, abs=1e-6)
        else:
            assert got <= 0.8
    full = S.hybrid_sim(ka, kb, ta, tb, F.length(ka), F.length(kb), REF, budget=False)
    assert one(spark, full, a=a, b=b) == pytest.approx(sim, abs=1e-6)


@pytest.mark.parametrize("a,b,expected", [
    ("Tesla Q3 report", "Tesla Q3 reports", 0.0),
    ("Tesla Q3 report!", "tesla q3 REPORT", 1.0),
    ("für", "fr", 1.0),
    ("Привет", "😀", 1.0),
])
def test_equal_keys_and_latin_single_token(spark, a, b, expected):
    ka, kb = X.title_key("a"), X.title_key("b")
    ta, tb = X.tokens("a", ka, "reference"), X.tokens("b", kb, "reference")
    h = S.hybrid_sim(ka, kb, ta, tb, F.length(ka), F.length(kb), REF, budget=False)
    assert one(spark, h, a=a, b=b) == pytest.approx(expected, abs=1e-9)


def test_word_mode_tokens(spark):
    assert sorted(one(spark, X.tokens("t", None, "word"), t="Tesla Q3 report, Tesla!")) == ["q3", "report", "tesla"]


@pytest.mark.parametrize("t,expected", [("GPU news", True), ("GPU 新闻", False), ("123", False), ("für", True)])
def test_is_english(spark, t, expected):
    assert one(spark, X.is_english("t"), t=t) is expected


@pytest.mark.parametrize("t,expected", [('"x"', "x"), ('"', ""), ("x", "x"), ('"a', '"a')])
def test_unwrap(spark, t, expected):
    assert one(spark, X.unwrap_quotes("t"), t=t) == expected


def test_escape_html(spark):
    assert one(spark, X.escape_html("t"), t="<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, X.escape_html("t"), t='"q"') == "&quot;q&quot;"


def test_strip_markdown(spark):
    assert one(spark, X.strip_markdown("t"), t="**b** [t](u) C# x") == "b t Cx"
    assert one(spark, X.strip_markdown("t"), t="`code` *i* ## h") == "code i h"


def test_report_line(spark):
    assert one(spark, X.report_line(F.lit(1), "t", "u", "s"), t="T", u="http://x", s="S") == "1. [T](http://x) - S"
    assert one(spark, X.report_line(F.lit(2), "t", "u", "s"), t="T", u="", s="S") == "2. T - S"


def test_badges_labels_and_agents(spark):
    assert one(spark, X.rank_badge("n"), n=3) == "top"
    assert one(spark, X.rank_badge("n"), n=10) == "high"
    assert one(spark, X.rank_badge("n"), n=11) == ""
    assert one(spark, X.heat_badge("n"), n=20) == "hot"
    assert one(spark, X.heat_badge("n"), n=10) == "warm"
    assert one(spark, X.heat_badge("n"), n=9) == ""
    assert one(spark, X.mode_label("m"), m="incremental") == "增量监控"
    assert one(spark, X.mode_label("m"), m="other") == "other"
    assert one(spark, X.ua_allowed("u"), u="Mozilla/5.0 Chrome/120") is True
    assert one(spark, X.ua_allowed("u"), u="curl/8 chrome") is False
    assert one(spark, X.ua_allowed("u"), u="Mozi") is False
    assert one(spark, X.ua_allowed("u"), u="Mozilla/5.0 Lynx") is False


def test_prefix_bound_matches_python():
    for n in range(1, 60):
        p = n - S.ceil_eps(n * (2 / 3)) + 1
        assert 1 <= p <= n
