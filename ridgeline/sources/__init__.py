"""Sources and sinks: tables, JSON lines, CSV with a byte-order mark, reports, versioned directories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.storage import written


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines are skipped; a malformed line or a missing file raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, headers without a byte-order mark, with the row's position from 0.

    Text manifests are small files edited by hand, so one task reads each.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("mode", "FAILFAST").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    return rows.select("*", F.monotonically_increasing_id().alias("position"))


def write_csv(df: DataFrame, path: str) -> None:
    """Nulls as empty cells, truth values as true and false."""
    flat = df.select([F.col(c).cast("string").alias(c) if t == "boolean" else F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def reports(documents: DataFrame, export_type: str) -> DataFrame:
    """One row per report of an export whose four privacy flags are as they must be; others raise."""
    p = F.col("privacy")
    fine = (F.col("exportType") == export_type) & ~p["rawImagesIncluded"] & ~p["originalFilenamesIncluded"] & p["queryCodesHashed"] & p["annotatorCodesHashed"]
    checked = documents.withColumn("_ok", F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(F.lit("not an export of this kind, or its privacy flags are wrong")).cast("boolean")))
    return checked.where("_ok").select(F.explode("reports").alias("report"))


class VersionedTable:
    """A keyed table without a transactional format: each write is a new directory, and a pointer file names the current one.

    One writer at a time. A reader sees the old version until the pointer has been replaced.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        at = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(at):
            return None
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0]

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.root}/{v}")

    def replace(self, df: DataFrame, partition_by: str | None = None) -> str:
        name = f"v-{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.root}/{name}")
        tmp = self._path(f"{self.root}/_CURRENT.{name}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(name.encode()))
        out.close()
        sc = self.spark.sparkContext
        options = sc._jvm.org.apache.hadoop.fs.Options.Rename
        over = sc._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        files.rename(files.makeQualified(tmp), files.makeQualified(self._path(f"{self.root}/CURRENT")), over)
        return name

    def vacuum(self) -> int:
        """Deletes all versions but the current one; returns how many. No reader of an older one may be at work."""
        now, gone = self.version(), 0
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("v-") and name != now:
                gone += bool(self._fs.delete(status.getPath(), True))
        return gone

    def upsert(self, source: DataFrame, key: str, order: list[str]) -> int:
        """Rows of the source by key, the last one each; returns how many keys it has."""
        from ridgeline.operators.feedback import latest
        from ridgeline.operators.tables import upsert

        now, last = self.read(), written(latest(source, [key], order).select(source.columns))
        self.replace(upsert(now, last, key, order) if now is not None else last)
        return last.count()

    def clear(self) -> None:
        now = self.read()
        if now is not None:
            self.replace(now.limit(0))


def snapshot(fetch, page_size: int, most: int, retries: int = 2) -> list[dict]:
    """All pages of a keyset-paged endpoint as one consistent list.

    fetch(cursor, page_size) gives a dict of candidateCount, nextCursor and candidates. A repeated cursor, a repeated id,
    an oversize page or a count that differs from the declared one fails the snapshot, which is then tried again.
    """
    for attempt in range(1 + max(0, min(retries, 2))):
        try:
            rows, cursors, ids, cursor = [], set(), set(), None
            while True:
                page = fetch(cursor, page_size)
                some = page["candidates"]
                if len(some) > page_size or len(rows) + len(some) > most:
                    raise ValueError("a page is larger than it may be")
                for r in some:
                    if r["id"] in ids:
                        raise ValueError(f"id {r['id']} came twice")
                    ids.add(r["id"])
                rows += some
                cursor = page.get("nextCursor")
                if cursor is None:
                    break
                if cursor in cursors:
                    raise ValueError("a cursor came twice")
                cursors.add(cursor)
            if len(rows) != page["candidateCount"]:
                raise ValueError(f"{len(rows)} rows, declared {page['candidateCount']}")
            return rows
        except ValueError:
            if attempt == max(0, min(retries, 2)):
                raise
    return []


def snapshot_table(spark: SparkSession, fetch, schema: T.StructType | str, path: str, page_size: int, most: int, retries: int = 1) -> DataFrame:
    """`snapshot` for more rows than a driver holds: every page is written as it comes, and the rows are checked as a table.

    The driver holds one page and the cursors. A try that fails leaves its own directory, which nothing reads.
    """
    for attempt in range(1 + max(0, retries)):
        at, cursors, cursor, number = f"{path.rstrip('/')}/try-{uuid.uuid4().hex}", set(), None, 0
        try:
            while True:
                page = fetch(cursor, page_size)
                if len(page["candidates"]) > page_size:
                    raise ValueError("a page is larger than it may be")
                spark.createDataFrame(page["candidates"], schema).coalesce(1).write.parquet(f"{at}/page={number}")
                cursor, number = page.get("nextCursor"), number + 1
                if cursor is None:
                    break
                if cursor in cursors or number * page_size > most + page_size:
                    raise ValueError("a cursor came twice, or there are more pages than there may be")
                cursors.add(cursor)
            rows = spark.read.parquet(at).drop("page")
            n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
            if not n == ids == page["candidateCount"] <= most:
                raise ValueError(f"{n} rows of {ids} ids, declared {page['candidateCount']}")
            return rows
        except ValueError:
            if attempt == max(0, retries):
                raise
    raise ValueError("no try was made")


def write_feedback(ratings: DataFrame, pairs: DataFrame, summary: DataFrame, path: str) -> None:
    """Ratings and pairs as JSON lines, split over files as they come, and the summary as one document."""
    for rows, name in ((ratings, "ratings"), (pairs, "pairs")):
        rows.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
    write_report(summary, f"{path}/summary")
