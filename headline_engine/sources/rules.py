"""Rule source (S4) and rule-line classifier (P5).

Rule text: groups separated by exactly one blank line ("\\n\\n"); inside a group one
word per line. '@n' sets the group cap (leading integer > 0, last one wins), '!w'
adds a global exclude word, '+w' a required word, anything else a normal word.
Lines are trimmed and lowercased; a group with neither required nor normal words
is dropped but its exclude words still apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headline_engine.config import DEFAULT_RULES
from headline_engine.functions.text import JS_SPACE, clean_title
from headline_engine.session import written

#: Largest rule text whose rules are broadcast and tested one by one; beyond it matching goes by the gram index.
MAX_RULE_BYTES = 1 << 20


def rule_lines(text_df: DataFrame) -> DataFrame:
    """(group_ord, line_ord, kind, word, cap) per non-blank line of a one-column `text` frame, or of a frame of its groups
    (g, gtext)."""
    groups = text_df.select(F.posexplode(F.split("text", "\n\n")).alias("g", "gtext")) if text_df.columns == ["text"] else text_df
    groups = groups.where(clean_title("gtext") != "")
    lines = groups.select(
        (F.col("g") + 1).cast("int").alias("group_ord"),
        F.posexplode(F.split("gtext", "\n")).alias("line_ord", "line"),
    ).where(clean_title("line") != "")
    w = F.lower(clean_title("line"))
    # parseInt semantics: optional leading space and sign, then the leading digits
    cap = F.nullif(F.regexp_extract(F.col("w"), rf"^@{JS_SPACE}*([+-]?[0-9]+)", 1), F.lit("")).try_cast("int")
    return lines.select("group_ord", "line_ord", w.alias("w")).select(
        "group_ord",
        "line_ord",
        F.when(F.col("w").startswith("@"), "cap")
        .when(F.col("w").startswith("!"), "exclude")
        .when(F.col("w").startswith("+"), "required")
        .otherwise("normal")
        .alias("kind"),
        F.when(F.col("w").startswith("!") | F.col("w").startswith("+"), F.substring("w", 2, 1 << 30))
        .otherwise(F.col("w"))
        .alias("word"),
        F.when(F.col("w").startswith("@"), cap).alias("cap"),
    )


def parse_rules(text_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P5: (rules, filters). rules = (group_ord, group_key, required, normal, max_count)."""
    lines = rule_lines(text_df)
    words = lines.where((F.col("kind").isin("required", "normal")) & (F.col("word") != ""))
    by_group = words.groupBy("group_ord").agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "required", F.struct("line_ord", "word")))),
            lambda s: s["word"],
        ).alias("required"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "normal", F.struct("line_ord", "word")))),
            lambda s: s["word"],
        ).alias("normal"),
    )
    caps = (
        lines.where((F.col("kind") == "cap") & (F.col("cap") > 0))
        .groupBy("group_ord")
        .agg(F.max_by("cap", "line_ord").alias("max_count"))
    )
    rules = by_group.join(caps, "group_ord", "left").select(
        "group_ord",
        F.when(F.size("normal") > 0, F.array_join("normal", " ")).otherwise(F.array_join("required", " ")).alias("group_key"),
        "required",
        "normal",
        F.coalesce(F.col("max_count"), F.lit(0)).alias("max_count"),
    )
    filters = lines.where((F.col("kind") == "exclude") & (F.col("word") != "")).select("word").distinct()
    return rules, filters


def is_large(text: str | None) -> bool:
    """Too large to broadcast and to test rule by rule: match.matched(..., indexed=True)."""
    return len((text or "").encode()) > MAX_RULE_BYTES


def load_rules(spark: SparkSession, text: str, indexed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rule text -> rules and exclude words (see effective_rules() for an empty one).

    Without `indexed` the rules are joined by substring tests and broadcast, so the text's size is checked here. A large
    text is split into its groups on the driver (it came from there) and parsed by Spark, group by group."""
    text = text or ""
    if not indexed:
        if is_large(text):
            raise ValueError(f"rule text of more than {MAX_RULE_BYTES} bytes: match it with indexed=True")
        return parse_rules(spark.createDataFrame([(text,)], "text string"))
    groups = [(i, g) for i, g in enumerate(text.split("\n\n"))]
    rules, filters = parse_rules(spark.createDataFrame(groups, "g int, gtext string"))
    return written(rules), written(filters)


def effective_rules(text: str | None) -> str:
    """The stored text, or the default rules where none is stored."""
    return text or DEFAULT_RULES


def save_rules(spark: SparkSession, text: str, path: str) -> None:
    """S4 sink: the stored rule text (one row)."""
    spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").parquet(path)


def stored_rules(spark: SparkSession, path: str) -> str:
    """The stored rule text, or an empty one (see effective_rules())."""
    row = spark.read.parquet(path).first()
    return row["text"] if row else ""


def group_caps(rules: DataFrame, default_cap: int) -> DataFrame:
    """Cap per group key: the first-declared group's max_count, else the default.
    Groups sharing a key share one list (SURVEY §2.13 #12)."""
    return rules.groupBy("group_key").agg(
        F.min("group_ord").alias("key_ord"),
        F.min_by("max_count", "group_ord").alias("_mc"),
    ).select(
        "group_key",
        "key_ord",
        F.when(F.col("_mc") > 0, F.col("_mc")).otherwise(F.lit(default_cap)).alias("cap"),
    )
