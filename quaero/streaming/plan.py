"""What a round covers: registered folders and chosen sources, worked off item by item, resumable."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.sources import browser
from quaero.sources.files import files
from quaero.streaming.queue import Item, Queue
from quaero.streaming.rounds import Snapshots, run_round


class Settings:
    """Keys and values as an appended table: the last value of a key stands."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/meta"
        self.queue = Queue(spark, f"{path.rstrip('/')}/queue")

    def all(self) -> DataFrame:
        schema = "key string, value string, at long"
        try:
            rows = self.spark.read.schema(schema).json(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))

    def get(self, key: str, default: str = "") -> str:
        row = self.all().filter(F.col("key") == key).first()
        return default if row is None or row.value is None else row.value

    def put(self, key: str, value: str) -> None:
        self.spark.createDataFrame([(key, value, time.time_ns())], "key string, value string, at long").coalesce(1).write.mode("append").json(self.path)

    def folders(self) -> list[str]:
        try:
            return list(json.loads(self.get("mappen", "[]")))
        except ValueError:
            return []

    def add_folder(self, path: str) -> None:
        self.put("mappen", json.dumps([*dict.fromkeys([*self.folders(), path.rstrip("/")])]))

    def remove_folder(self, path: str, snapshots: Snapshots) -> None:
        """The folder leaves the list, and with it the documents that came by it. Those of other sources below it stay."""
        path = path.rstrip("/")
        self.put("mappen", json.dumps([p for p in self.folders() if p != path]))
        stored = snapshots.documents()
        snapshots.commit(snapshots.number() + 1, stored.filter(F.lit(False)), stored.filter(F.col("source") == f"map:{path}"))


def plan(folders: list[str], mail: list[str] = (), pictures: list[str] = (), browsers: list[str] = ()) -> list[Item]:
    """One item per folder; with mail folders chosen, other folders leave mail out. ``browsers``: user folders whose histories are read."""
    kind = "bestanden-zonder-mail" if mail else "bestanden"
    own = [Item(f"map:{p}", kind, p) for p in folders] + [Item("mail:bestanden", "mail", p) for p in mail] + [Item("screenshots:bestanden", "beeld", p) for p in pictures]
    return own + [Item("browser:geschiedenis", "browser", p) for p in browsers]


def stop(settings: Settings) -> None:
    """End the run that is going on, from any thread or driver: it stops before its next item. On this driver its Spark jobs are cancelled as well; the
    round they were in leaves no trace, and the item stays queued."""
    run = settings.get("run")
    if run:
        settings.put("stop", run)
        settings.spark.sparkContext.cancelJobsWithTag(f"quaero-{run}")


def _round(snapshots: Snapshots, walked: list[Item], item: Item, completed: list[str]) -> dict[str, int]:
    if item.kind == "browser":
        found = [p for i in walked for p in browser.profiles(i.path)]
        if not found:
            return run_round(snapshots, snapshots.documents().select("source", "path", "size", "mtime").limit(0), completed)
        visits = browser.visit_documents(browser.visits(snapshots.spark, found)).withColumn("source", F.lit(item.source))
        # an address that several profiles have visited is one document
        newest = F.expr("row_number() OVER (PARTITION BY path ORDER BY mtime DESC)")
        return run_round(snapshots, visits.withColumn("nth", newest).filter("nth = 1").drop("nth"), completed, made=lambda rows: rows)
    found = files(snapshots.spark, [i.path for i in walked], item.kind, own=snapshots.path.removeprefix("file://"))
    return run_round(snapshots, found.withColumn("source", F.lit(item.source)), completed)


def run_plan(settings: Settings, snapshots: Snapshots, chosen: list[Item], again: bool = False, stop_after: int | None = None) -> dict[str, int | str]:
    """Work off the items; those left by a stopped run come first and keep its choice, unless ``again``. Several workers may call this for one
    queue: each item is done by one of them.

    Each item is read in a round of its own and leaves the queue only when that round is committed, so a run that dies
    repeats that item. The round of a source's last item walks all items of that source in the plan, also those that an earlier run has done:
    only against all of them are documents gone. ``stop_after`` ends the run after so many items, ``stop`` at once.
    """
    queue, context = settings.queue, settings.spark.sparkContext
    resumed = not again and queue.count() > 0
    if not resumed:
        queue.fill(list(chosen))
    whole = [Item(r["source"], r["kind"], r["path"]) for r in queue.items().orderBy("id").collect()]
    run = settings.get("run") if resumed and settings.get("status") == "bezig" else ""
    if not run:
        settings.put("run", run := uuid.uuid4().hex)
    settings.put("status", "bezig")
    tag, stopped = f"quaero-{run}", lambda: settings.get("stop") == run
    total = {"added": 0, "updated": 0, "skipped": 0, "removed": 0, "errors": 0}
    done = 0
    context.addJobTag(tag)
    try:
        while (stop_after is None or done < stop_after) and not stopped():
            claim = queue.claim()
            if claim is None:
                if not queue.count():
                    break
                time.sleep(0.5)  # another worker has the queue
                continue
            finished = False
            try:
                item = claim.item
                last = queue.count(item.source) == 1
                walked = [i for i in whole if i.source == item.source] if last else [item]
                got = _round(snapshots, walked, item, [item.source] if last else [])
                total = {k: v + got[k] if k != "errors" else got[k] for k, v in total.items()}
                finished, done = True, done + 1
            except Exception:
                context.removeJobTag(tag)  # the cancelling goes for the jobs of the round
                if not stopped():
                    raise
                break
            finally:
                queue.finish(claim, finished)
    finally:
        context.removeJobTag(tag)
    left = queue.count()
    status = "onderbroken" if left else "klaar"
    settings.put("status", status)
    if not left:
        settings.put("laatst-bijgewerkt", dt.datetime.now(dt.UTC).isoformat(timespec="seconds"))
    return total | {"pending": left, "resumed": int(resumed), "status": status}


def status(settings: Settings, snapshots: Snapshots) -> DataFrame:
    """One row of where things stand: status, when last finished, queued items, documents, sources and errors."""
    documents = snapshots.documents().agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources"), F.count_if(F.col("error") != "").alias("errors"))
    return documents.withColumns({"status": F.lit(settings.get("status")), "updated": F.lit(settings.get("laatst-bijgewerkt")), "pending": F.lit(settings.queue.count())})
