"""Scans of a stream with a rule pack that may change while the stream runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewarden.operators import scan
from tidewarden.sources import rules


class LivePack:
    """The rules of a pack, a Parquet table, read anew when its newest file's modification time changes.

    ``version`` is that time. A pack of which no rule is valid, or that is just being
    replaced and can't be read, leaves the rules as they were.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.version, self.rules = None, []

    def refresh(self) -> LivePack:
        try:
            self.spark.catalog.refreshByPath(self.path)
            table = self.spark.read.schema(rules.SCHEMA).parquet(self.path)
            version = table.agg(F.date_format(F.max("_metadata.file_modification_time"), "yyyy-MM-dd HH:mm:ss.SSS")).first()[0]
            found = rules.load_rules(table)[0] if version not in (None, self.version) else []
        except Exception:  # a pack between two versions; the next micro-batch looks again
            if self.version is None:
                raise
            return self
        if found:
            self.version, self.rules = version, found
        return self


def scan_live(stream: DataFrame, text_col: str, id_cols: Sequence[str], pack_path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Findings of each micro-batch by the pack as it is then, with ``pack_version``, as Parquet below ``out``.

    A micro-batch owns the folder of its number, so one that is run again after a
    failure replaces its own rows only.
    """
    pack = LivePack(stream.sparkSession, pack_path)

    def one(batch: DataFrame, number: int) -> None:
        now = pack.refresh()
        found = scan.findings(batch, text_col, now.rules, id_cols).withColumn("pack_version", F.lit(now.version))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
