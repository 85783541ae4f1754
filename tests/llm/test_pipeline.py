"""The corpus pipeline against its stages' brute-force versions, on odd documents written as the driver's tables."""

import random
import tempfile
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from test_operators import alnum, brute_chunks, brute_decontamination, brute_groups, key

from headline_engine.llm import linechunks, tokens


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "packing"]
    rnd = random.Random(11)
    say = lambda n: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    block = "\n".join(f"{i * i} shared line of text" for i in range(12))
    passage = say(14)
    texts = [say(rnd.choice([3, 30, 200])) + "\n" + say(9) for _ in range(30)]
    texts += [say(20) + "\n" + block + "\n" + say(20) for _ in range(6)] + [block, block, block + "\nlast"]
    base = say(150)
    texts += ["a twin of two lines\nand nothing more of it"] * 2  # two lines are one chunk
    texts += [base, base, base + " end", "begin " + base, base.upper()]
    texts += [say(40) + " " + passage.upper() + " " + say(40), passage, "", None, "123 456", "!!!"]
    docs = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    items = [(1, passage), (2, say(12))]
    sf = tempfile.mkdtemp(prefix="hl-pipe-")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    th = {r["doc_id"]: r["t"] for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "xxhash64(text) t").collect()}

    rows = [(i, t) for i, t, *_ in docs if t and any(c.isalpha() for c in t)]
    first = {}
    for i, t in sorted(rows, key=lambda r: (key(r[0]), th[r[0]])):
        for a, n, c in brute_chunks(t):
            if n >= linechunks.MIN_LINES:
                first.setdefault(c, (i, a))
    lined = []
    for i, t in rows:
        ch = brute_chunks(t)
        keep = [c for a, n, c in ch if n < linechunks.MIN_LINES or first[c] == (i, a)]
        new = "\n".join(keep)
        if len(keep) == len(ch) or new.strip():
            lined.append((i, new))
    assert any(t != dict(rows)[i] for i, t in lined) and len(lined) < len(rows)
    kept = {r[1] for r in brute_groups(lined)}
    unique = [r for r in lined if r[0] in kept]
    assert len(unique) < len(lined)
    clean = [r[0] for r in brute_decontamination(unique, items) if not r[5]]
    assert len(clean) == len(unique) - 2
    tok = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in unique if i in clean}

    got = defaultdict(dict)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]][r["start"]] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in got.items()} == want
    assert all(alnum(t) for i, t in unique if i in clean)


def test_stages_pass_an_empty_table(spark, none):
    import corpus_pipeline

    sf = tempfile.mkdtemp(prefix="hl-pipe-")
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_own_columns_pass_and_unlearned_texts_go(spark):
    """Columns named like those that operators add are untouched; another script and random letters are in no learned language."""
    import random

    from pyspark.sql import functions as F

    from headline_engine.llm import pipeline

    rnd = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    own = {"score": F.lit(99.0), "lang_pred": F.lit("mine"), "bits_per_byte": F.lit("b"), "n_lines": F.lit(777), "n_removed": F.lit(-1)}
    odd = ["".join(rnd.choice("qxzjkwv") for _ in range(600)), "привет как дела сегодня хорошая погода " * 20, "今日は天気がとても良いですね" * 30]
    extra = spark.createDataFrame([(10_000 + i, t, None, "s", len(t)) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra).withColumns(own)
    kept = pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert max(r["doc_id"] for r in rows) < 10_000 and len(rows) >= 140
    out = pipeline.lines(spark, kept, "")
    assert out.columns == docs.columns
    assert {tuple(r[c] for c in own) for r in out.collect()} == {(99.0, "mine", "b", 777, -1)}
