"""Translation cache as a bucketed table (S9): co-partitioned by text_hash with the lookups that join it.

The external translator's rows are appended to an inbox; compact() folds the inbox into a new bucketed and sorted version,
so a lookup reads the cache without a shuffle or sort of it, however large it grows: only the looked-up titles move.

Compaction at a time keeps what any crawl from that time on can see: of each text the latest row written up to then, if it
is still live, and all later rows. A version becomes current by a rename of its folder, and the one before is deleted.

Defined cases: no row yet reads as an empty table; equal rows count once; a row without text_hash or written_ts is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headline_engine import schemas
from headline_engine.config import EngineConfig

_COLUMNS = "text_hash string, translated string, written_ts timestamp"


class TranslationCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, prefix: str) -> list[str]:
        fs, p = self._fs("")
        return sorted(n for s in (fs.listStatus(p) if fs.exists(p) else []) if (n := s.getPath().getName()).startswith(prefix))

    def append(self, rows: DataFrame) -> None:
        """The translator's output (text_hash, translated, written_ts)."""
        rows.select(*schemas.TRANSLATIONS.names).write.mode("append").parquet(f"{self.path}/inbox")

    def _table(self, version: str) -> str:
        """The catalog name of a version's folder, in this session (bucketing is a property of the table)."""
        import hashlib

        name = f"translations_{hashlib.sha256(f'{self.path}/{version}'.encode()).hexdigest()[:16]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_COLUMNS}) USING parquet CLUSTERED BY (text_hash) SORTED BY (text_hash) "
                       f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{version}'")
        return name

    def read(self) -> DataFrame:
        """The compacted cache: bucketed by text_hash (appended rows count from the next compaction on)."""
        versions = self._names("v")
        return self.spark.table(self._table(versions[-1])) if versions else self.spark.createDataFrame([], schemas.TRANSLATIONS)

    def compact(self, as_of, cfg: EngineConfig = EngineConfig()) -> None:
        """Fold the inbox in and drop what no crawl from `as_of` (a timestamp expression) on can see."""
        ttl = cfg.retention_days["translations"]
        rows = self.read().select(*schemas.TRANSLATIONS.names)
        fs, inbox = self._fs("inbox")
        if fs.exists(inbox):
            rows = rows.unionByName(self.spark.read.schema(schemas.TRANSLATIONS).parquet(f"{self.path}/inbox"))
        rows = rows.where(F.col("text_hash").isNotNull() & F.col("written_ts").isNotNull())
        newer = F.col("written_ts") > as_of
        # One of equal times stays: lookups could take either.
        one = rows.groupBy("text_hash", F.when(newer, F.col("written_ts")).alias("_at")).agg(F.max_by(F.struct("translated", "written_ts"), F.struct("written_ts", "translated")).alias("r"))
        keep = one.select("text_hash", "r.*").where(F.col("written_ts") > as_of - F.make_interval(days=F.lit(ttl)))
        old = self._names("v")
        version = f"v{int(old[-1][1:]) + 1 if old else 1:09d}"
        name = f"{self._table('tmp-' + version)}"
        self.spark.sql(f"DROP TABLE {name}")
        (keep.repartition(self.buckets, "text_hash").write.bucketBy(self.buckets, "text_hash").sortBy("text_hash").mode("overwrite")
         .option("path", f"{self.path}/tmp-{version}").saveAsTable(name))
        self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
        fs.rename(self._fs(f"tmp-{version}")[1], self._fs(version)[1])
        for n in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(n)}")
            fs.delete(self._fs(n)[1], True)
        fs.delete(inbox, True)
