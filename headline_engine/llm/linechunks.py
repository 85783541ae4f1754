"""Line dedup by content-defined chunks of lines (DataFrame operations only).

A document's lines (cut at line feeds) are hashed, and a rolling hash over the hashes of SPAN consecutive lines ends a
chunk after a line where it is 0 modulo DIVISOR: boundaries depend on the lines around them alone, so they survive lines
put in elsewhere. A chunk of two or more lines that occurs more than once in all documents is kept where it comes first
(smallest doc_id, then chunk number) and removed everywhere else. Hashes only select candidates; chunks are removed when
their bytes are equal (candidates are grouped by hash and text).

The line hash is the first 8 hex digits of MD5 and the rolling hash their sum weighted by powers of ROLL, so any SQL
engine gets the same chunks. Small rows (hash, document, chunk) find the repeated chunks; texts then move twice: once
for the candidates' bytes, once for the removal.

Defined cases: a null text has no lines and stays null; an empty text is one empty line, which as a single line is never
a chunk to remove; repeated ids with different texts are different documents (their order is by id and text hash);
repeated rows are one document, each row gets its result; an empty table gives no row. Extra columns stay in clean() and
are ignored by report().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headline_engine.llm.common import NULL_ID, durable, keyed

SPAN = 2
DIVISOR = 3
ROLL = 31
MIN_LINES = 2


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _weigh(w: int):
    return lambda a, b: a + b * w


def _shifted(a: Column, by: int) -> Column:
    """The array moved `by` places to the right, zeros first."""
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), by), F.slice(a, 1, F.greatest(F.size(a) - by, F.lit(0))))


def _spans(docs: DataFrame) -> DataFrame:
    """Adds `lines` and `spans` (array of at: first line from 0, n: lines) to rows that have a non-null text."""
    keep = [c for c in docs.columns if c != "text"]
    # Generators over one-element arrays keep Spark from inlining the split into the lambdas.
    docs = docs.select(*keep, F.explode(F.array(F.split("text", "\n", -1))).alias("lines"))
    docs = docs.select(*keep, "lines", F.explode(F.array(F.transform("lines", _line_hash))).alias("h"))
    rolled = F.col("h")
    for i in range(1, SPAN):
        rolled = F.zip_with(rolled, _shifted(F.col("h"), i), _weigh(ROLL**i))
    size = F.size("lines")
    # Last line of each chunk; the rolling hash needs SPAN lines, and the document's last line ends the last chunk.
    ends = F.filter(F.transform(rolled, lambda r, i: F.when(((i >= SPAN - 1) & (r % DIVISOR == 0)) | (i == size - 1), i)), lambda i: i.isNotNull())
    docs = docs.select(*keep, "lines", F.explode(F.array(ends)).alias("ends"))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: e + 1))
    spans = F.zip_with(starts, F.col("ends"), lambda s, e: F.struct(s.alias("at"), (e - s + 1).alias("n")))
    return docs.select(*keep, "lines", spans.alias("spans"))


def _chunk(at: Column, n: Column) -> Column:
    return F.array_join(F.slice("lines", at + 1, n), "\n")


def repeated(documents: DataFrame) -> DataFrame:
    """(_id, _th, at, n): the chunks to remove (first line from 0, number of lines)."""
    texts = keyed(documents).where("text is not null")
    multi = _spans(texts)
    multi = multi.select("_id", "_th", F.explode(F.transform(
        F.filter("spans", lambda s: s["n"] >= MIN_LINES),
        lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.xxhash64(_chunk(s["at"], s["n"])).alias("h")))).alias("c"))
    multi = multi.select("_id", "_th", "c.at", "c.n", "c.h")
    # Equal (_id, _th, at) are one occurrence: a repeated row of a document is not a repeat of its chunks.
    place = F.struct("_id", "_th", "at")
    twice = multi.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h")
    # A written table: the join then has a side of its own for AQE to split where a chunk is hot.
    listed = multi.join(durable(twice), "h").groupBy("_id", "_th").agg(F.collect_set(F.struct("at", "n", "h")).alias("spans"))
    # Byte comparison: the candidates are cut out of their documents, and one group holds one text.
    docs = texts.join(listed, ["_id", "_th"])
    docs = docs.select("_id", "_th", F.explode(F.array(F.split("text", "\n", -1))).alias("lines"), "spans")
    occ = docs.select("_id", "_th", F.explode(F.transform("spans", lambda s: F.struct(
        s["at"].alias("at"), s["n"].alias("n"), s["h"].alias("h"), _chunk(s["at"], s["n"]).alias("chunk")))).alias("c"))
    occ = occ.select("_id", "_th", "c.at", "c.n", "c.h", "c.chunk")
    first = occ.groupBy("h", "chunk").agg(F.min(place).alias("lo"))
    return occ.join(first, ["h", "chunk"]).where(place != F.col("lo")).select("_id", "_th", "at", "n").distinct()


def _cut_lists(documents: DataFrame) -> DataFrame:
    return repeated(documents).groupBy("_id", "_th").agg(
        F.sort_array(F.collect_list(F.struct("at", "n"))).alias("cut"), F.sum("n").cast("bigint").alias("n_removed"))


def _kept(cut: Column) -> Column:
    """The text without the cut lines: a walk over the sorted cuts joins the stretches between them."""
    n = F.size(F.col("_lines"))
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda c: c["at"] + c["n"]))
    ends = F.concat(F.transform(cut, lambda c: c["at"]), F.array(n))
    parts = F.zip_with(starts, ends, lambda s, e: F.slice("_lines", s + 1, e - s))
    return F.array_join(F.flatten(parts), "\n")


def clean(documents: DataFrame) -> DataFrame:
    """All columns of the documents with the repeated chunks taken out of `text`, and `n_lines`, `n_removed` added."""
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    docs = documents.select(
        F.struct(*names).alias("_row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_th"))
    docs = docs.join(_cut_lists(documents), ["_id", "_th"], "left")
    docs = docs.select("_row", "cut", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
                       F.explode(F.array(F.split("_row.text", "\n", -1))).alias("_lines"))
    text = F.when(F.col("cut").isNull(), F.col("_row.text")).otherwise(_kept(F.col("cut")))
    n_lines = F.when(F.col("_row.text").isNull(), 0).otherwise(F.size("_lines")).cast("bigint")
    return docs.select(*[text.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in names], n_lines.alias("n_lines"), "n_removed")


def report(documents: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_lines, n_removed, kept_sha256 of the text that stays; a null text counts as empty)."""
    return clean(documents.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
