"""Pairs inside crawls (F9): crawls are sized without shuffling texts, and titles are sorted without their tokens."""

import re
import tempfile

from headline_engine.config import EngineConfig
from headline_engine.operators import simjoin
from headline_engine.plans import queries as Q


def test_crawls_are_sized_on_the_scan(spark):
    rows = [(i, "a b\nc d\na b" if i % 3 else f"x{i} y\n\n z", f"s{i % 4}") for i in range(40)] + [(40, None, "s1"), (41, "q", None), (None, "n n", "s2"), (3, "again", "s3")]
    path = tempfile.mkdtemp(prefix="hl-sizes-")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    Q.reset_memo()
    sizes = Q.crawl_sizes(spark, path)
    want = {r["crawl_id"]: r["count"] for r in Q.headlines(spark, path).groupBy("crawl_id").count().collect()}
    assert {r["crawl_id"]: r["_n"] for r in sizes.collect()} == want and len(want) > 5
    Q.reset_memo()


def test_titles_are_sorted_without_tokens(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a c"), (1, "!!"), (2, "a b")], "crawl_id long, title string")
    p = simjoin.jaccard_pairs(df, ["crawl_id"], 0.1, EngineConfig(token_mode="word"), spark.createDataFrame([(1, 3)], "crawl_id long, _n long"))
    plan = p._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    group = next(i for i, x in enumerate(lines) if "FlatMapGroupsInArrow" in x)
    sort = next(i for i, x in enumerate(lines) if re.search(r"\bSort \[", x))
    assert any("toks" in x for x in lines[group + 1 : sort]) and not any("toks" in x for x in lines[sort:])
    assert [tuple(r)[:3] for r in p.collect()] == [(1, "a b", "a c")]
