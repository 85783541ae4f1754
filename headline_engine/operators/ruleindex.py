"""Substring matching against very many rules (J1, J2, P6, P7) by a gram index, without testing every rule on every title.

Each rule word is filed under one of its grams: the GRAM-character piece (or the whole word, if it is shorter) that the
fewest titles hold. A title that contains the word contains that gram, so titles meet words by an equi-join on grams, and
the substring test verifies the pairs. Gram counts come from one aggregate over all titles; a word none of whose grams
occurs cannot match and drops out early. Grams that very many titles and words share are joined in blocks
(simjoin.token_join), so no gram is a hot task.

A group matches when all its required words do and, if it has normal words, at least one of them: counts per title and
group, combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headline_engine.operators import simjoin
from headline_engine.session import written

#: Characters of a gram.
GRAM = 3


def _grams(text, size) -> F.Column:
    """Distinct `size`-character pieces of a text."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def rule_words(rules: DataFrame) -> DataFrame:
    """(word): the distinct required and normal words of the groups."""
    return rules.select(F.explode(F.concat("required", "normal")).alias("word")).distinct()


def contained_words(titles: DataFrame, words: DataFrame, gram: int = GRAM, rows: int = simjoin.BLOCK_ROWS) -> DataFrame:
    """(title, word): every word that occurs in the lower-cased title. titles: (title), words: (word), both distinct."""
    t = written(titles.select("title", F.lower("title").alias("lt"), F.md5("title").alias("uid_a")))
    w = written(words.where(F.col("word") != "").select("word", F.md5("word").alias("uid_b")))
    sizes = [r[0] for r in w.select(F.least(F.length("word"), F.lit(gram))).distinct().collect()]  # at most `gram` numbers
    if not sizes:
        return titles.select("title", F.lit("").alias("word")).limit(0)
    pieces = F.flatten(F.array(*[_grams(F.col("lt"), s) for s in sorted(sizes)]))
    grams = t.select("uid_a", F.explode(pieces).alias("tok"))
    mine = F.when(F.length("word") <= gram, F.array("word")).otherwise(_grams(F.col("word"), gram))
    offered = written(w.select("uid_b", F.explode(mine).alias("tok")))
    # Only the grams of words are counted; the rarest files the word.
    used = written(grams.join(offered.select("tok").distinct(), "tok", "left_semi"))
    df = used.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    filed = offered.join(df, "tok").groupBy("uid_b").agg(F.min(F.struct("df", "tok")).alias("f")).select("uid_b", F.col("f.tok").alias("tok"))
    met = simjoin.token_join(used, written(filed), ["tok"], F.lit(True), self_join=False, rows=rows).select("uid_a", "uid_b")
    met = met.join(t.drop("lt"), "uid_a").join(w, "uid_b")
    return met.where(F.contains(F.lower("title"), F.col("word"))).select("title", "word")


def excluded_titles(headlines: DataFrame, filters: DataFrame, **how) -> DataFrame:
    """The distinct titles that hold an exclude word."""
    return contained_words(headlines.select("title").distinct(), filters.select("word").distinct(), **how).select("title").distinct()


def matching_groups(headlines: DataFrame, rules: DataFrame, **how) -> DataFrame:
    """(title, group_ord, group_key) for every group that matches a title."""
    hits = contained_words(headlines.select("title").distinct(), rule_words(rules), **how)
    terms = rules.select("group_ord", F.explode(F.array_distinct("required")).alias("word"), F.lit(True).alias("req")).unionByName(
        rules.select("group_ord", F.explode(F.array_distinct("normal")).alias("word"), F.lit(False).alias("req")))
    per = hits.join(terms, "word").groupBy("title", "group_ord").agg(F.count_if("req").alias("n_req"), F.count_if(~F.col("req")).alias("n_norm"))
    need = rules.select("group_ord", "group_key", F.size(F.array_distinct("required")).alias("need"), F.size("normal").alias("normals"))
    ok = (F.col("n_req") == F.col("need")) & ((F.col("normals") == 0) | (F.col("n_norm") > 0))
    return per.join(need, "group_ord").where(ok).select("title", "group_ord", "group_key")
