"""Browser history from SQLite databases: a partition for each profile, newest first, icons joined by address."""

from __future__ import annotations

import datetime as dt
import glob
import json
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quaero.functions import dates, text

#: Tables and columns of the browsers' own databases.
SQL = {
    "chrome": "SELECT url, title, last_visit_time, visit_count FROM urls WHERE last_visit_time > 0",
    "firefox": "SELECT url, title, last_visit_date, visit_count FROM moz_places WHERE last_visit_date IS NOT NULL AND hidden = 0",
    "icons": "SELECT m.page_url, b.image_data FROM icon_mapping m JOIN favicon_bitmaps b ON b.icon_id = m.icon_id WHERE b.image_data IS NOT NULL",
}


def profiles(home: str) -> list[tuple[str, str]]:
    """(browser, database) of the profiles below a user folder."""
    chrome = glob.glob(f"{home}/**/User Data/*/History", recursive=True)
    firefox = glob.glob(f"{home}/**/Profiles/*/places.sqlite", recursive=True)
    return [("chrome", p) for p in sorted(chrome)] + [("firefox", p) for p in sorted(firefox)]


class Database(InputPartition):
    def __init__(self, kind: str, path: str):
        super().__init__(path)
        self.kind, self.path = kind, path


class HistoryReader(DataSourceReader):
    def __init__(self, found: list[tuple[str, str]]):
        self.found = found

    def partitions(self) -> list[Database]:
        return [Database(k, p) for k, p in self.found]

    def read(self, partition: Database) -> Iterator[tuple]:
        """A running browser locks its database, so a copy with its journal is read, in the task's own temporary folder."""
        with tempfile.TemporaryDirectory() as folder:
            copy = os.path.join(folder, "copy")
            try:
                for tail in ("", "-wal", "-shm"):
                    if os.path.exists(partition.path + tail):
                        shutil.copyfile(partition.path + tail, copy + tail)
                con = sqlite3.connect(copy)
                rows = con.execute(SQL[partition.kind]).fetchall()
                con.close()
            except (OSError, sqlite3.Error):
                return
        for row in rows:
            yield (partition.kind, partition.path, *((row[0], None, None, None, row[1]) if partition.kind == "icons" else (*row, None)))


class HistorySource(DataSource):
    """Option ``databases``: a JSON list of (kind, path), kinds chrome, firefox, icons."""

    @classmethod
    def name(cls) -> str:
        return "quaero_history"

    def schema(self) -> str:
        return "browser string, profile string, url string, title string, time long, visits long, image binary"

    def reader(self, schema) -> HistoryReader:
        return HistoryReader([tuple(x) for x in json.loads(self.options["databases"])])


def _load(spark: SparkSession, found: list[tuple[str, str]]) -> DataFrame:
    spark.dataSource.register(HistorySource)
    return spark.read.format("quaero_history").option("databases", json.dumps(found)).load()


def visits(spark: SparkSession, found: list[tuple[str, str]], newest: int = 4000) -> DataFrame:
    """``url, title, host, moment, browser, profile, visits, image``: the newest of each profile, one row per address."""
    rows = _load(spark, found).drop("image")
    rows = rows.withColumn("nth", F.expr("row_number() OVER (PARTITION BY profile ORDER BY time DESC, url)")).filter(F.col("nth") <= newest)
    last = rows.groupBy("browser", "profile", "url").agg(F.max_by("title", "time").alias("title"), F.max("time").alias("time"), F.max("visits").alias("visits"))
    moment = F.when(F.col("browser") == "chrome", dates.chrome_time(F.col("time"))).otherwise(dates.firefox_time(F.col("time"))).cast("timestamp_ntz")
    stores = [("icons", os.path.join(os.path.dirname(p), "Favicons")) for k, p in found if k == "chrome" and os.path.exists(os.path.join(os.path.dirname(p), "Favicons"))]
    out = last.select("url", "title", text.host_of(F.col("url")).alias("host"), moment.alias("moment"), "browser", "profile", "visits")
    if not stores:
        return out.withColumn("image", F.lit(b""))
    images = _load(spark, stores).groupBy(F.col("url").alias("page")).agg(F.min("image").alias("image"))
    return out.join(images, out.url == images.page, "left").drop("page").withColumn("image", F.coalesce("image", F.lit(b"")))


def newest_first(sources: list[DataFrame], now: dt.datetime, most: int = 4000) -> DataFrame:
    """All histories in one, newest first; a visit without a date counts as today's. Of each source only its ``most`` newest are taken, so what
    is put in order is no more than that for each source. Ties by browser and address."""
    today = F.lit(dt.datetime.combine(now.date(), dt.time()))
    order = [F.coalesce("moment", today).desc(), "browser", "url"]
    heads = [s.orderBy(*order).limit(most) for s in sources]
    return reduce(DataFrame.unionByName, heads).orderBy(*order)


def history(spark: SparkSession, found: list[tuple[str, str]], now: dt.datetime, most: int = 4000) -> DataFrame:
    """``newest_first`` over the profiles."""
    return newest_first([visits(spark, [profile], most) for profile in found], now, most)


def visit_documents(rows: DataFrame) -> DataFrame:
    """Visits as documents of kind ``browser``."""
    body = F.concat_ws("\n", "url", F.nullif("title", F.lit("")), F.date_format("moment", "dd-MM-yyyy HH:mm"), "browser")
    extra = F.create_map(F.lit("url"), F.col("url"), F.lit("host"), F.col("host"), F.lit("browser"), F.col("browser"), F.lit("bezoeken"), F.col("visits").cast("string"))
    return rows.select(F.concat(F.lit("browser:"), "browser").alias("source"), F.col("url").alias("path"), F.coalesce(F.nullif("title", F.lit("")), F.col("url")).alias("title"), F.lit("browser").alias("kind"), F.col("moment").alias("mtime"), F.lit(0).cast("long").alias("size"), body.alias("text"), extra.alias("extra"), F.lit("").alias("error"), F.col("moment").alias("file_mtime"))
