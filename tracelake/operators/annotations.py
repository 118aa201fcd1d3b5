"""Small tables that people edit: annotations, highlights, local names.  Upserts replace by key."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATIONS = "artifact string, timeline bigint, record_ordinal bigint, source_offset bigint, sequence bigint, tid bigint, text string, revision bigint"
HIGHLIGHTS = "artifact string, timeline bigint, record_ordinal bigint, source_offset bigint, sequence bigint, tid bigint, color string, revision bigint"
LOCAL_NAMES = "module string, address bigint, name string, revision bigint"
EVENT = ("artifact", "timeline", "record_ordinal", "source_offset", "sequence", "tid")


class SideTable:
    """A table of versions: a folder for each revision and the newest complete one is current."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str]) -> None:
        self._spark, self._path, self._schema, self._key = spark, path.rstrip("/"), schema, list(key)

    def _folders(self) -> list[str]:
        jvm = self._spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self._path)
        fs = place.getFileSystem(self._spark._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self._path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        folders = self._folders()
        if not folders:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(f"{self._path}/{folders[-1]}")

    def _write(self, rows: DataFrame) -> None:
        number = int(self._folders()[-1][1:9]) + 1 if self._folders() else 0
        rows.select(*[f.name for f in self.read().schema]).coalesce(1).write.parquet(f"{self._path}/v{number:08d}-{uuid.uuid4().hex[:8]}")

    def _match(self, left: DataFrame, right: DataFrame):  # noqa: ANN202
        condition = F.lit(True)
        for k in self._key:
            condition = condition & left[k].eqNullSafe(right[k])
        return condition

    def upsert(self, rows: DataFrame) -> None:
        """Rows of the same key are replaced; their revision grows by one."""
        old = self.read()
        fresh = rows.dropDuplicates(self._key)
        kept = old.join(fresh, self._match(old, fresh), "left_anti")
        before = old.select(*[F.col(k).alias(f"__{k}") for k in self._key], F.col("revision").alias("__revision"))
        match = F.lit(True)
        for k in self._key:
            match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
        numbered = fresh.drop("revision").join(before, match, "left").withColumn("revision", F.coalesce(F.col("__revision") + 1, F.lit(0).cast("bigint")))
        self._write(kept.unionByName(numbered.select(*kept.columns)))

    def delete(self, keys: DataFrame) -> None:
        old = self.read()
        self._write(old.join(keys, self._match(old, keys), "left_anti"))

    def get(self, keys: DataFrame) -> DataFrame:
        rows = self.read()
        return rows.join(keys, self._match(rows, keys), "left_semi")

