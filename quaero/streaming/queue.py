"""The items of a run as a queue in a shared folder, which workers on any number of drivers drain one after the other.

Items are a table (``items/fill=N``; the latest fill counts), done items are rows of another (``done``). A worker takes the first item that is
not done under a *lease*: a numbered file that only one of them can create. While a lease is held nobody else gets one, so rounds are
committed in order; it ends when it is given back, or after ``seconds`` if its worker has died, and then the item is still there.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.Lock()
ITEMS = "id long, source string, kind string, path string"


@dataclass(frozen=True)
class Item:
    source: str
    kind: str
    path: str


@dataclass(frozen=True)
class Claim:
    item: Item
    id: int
    fill: int
    lease: int


class Queue:
    def __init__(self, spark: SparkSession, path: str, seconds: float = 3600.0):
        self.spark, self.path, self.seconds = spark, path.rstrip("/"), seconds

    # ------------------------------------------------------------ files

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _create(self, name: str) -> bool:
        """Make an empty file; false if it is there."""
        fs, path = self._file(name)
        with _LOCK:  # not every local file system tells two threads apart
            return bool(fs.createNewFile(path))

    def _names(self, folder: str) -> dict[str, float]:
        """Names in a folder and when they were made."""
        fs, path = self._file(folder)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(path)} if fs.exists(path) else {}

    # ------------------------------------------------------------ items

    def fill_number(self) -> int:
        return max((int(n.partition("=")[2]) for n in self._names("items") if n.startswith("fill=")), default=0)

    def fill(self, items: list[Item]) -> None:
        """These items replace what was queued."""
        fill = self.fill_number() + 1
        rows = [(i, x.source, x.kind, x.path) for i, x in enumerate(items)]
        self.spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("error").parquet(f"{self.path}/items/fill={fill}")

    def clear(self) -> None:
        self.fill([])

    def items(self) -> DataFrame:
        """All items of the latest fill, done or not."""
        fill = self.fill_number()
        return self.spark.read.schema(ITEMS).parquet(f"{self.path}/items/fill={fill}") if fill else self.spark.createDataFrame([], ITEMS)

    def pending(self, source: str | None = None) -> DataFrame:
        """Items that are not done, in order."""
        done = [(int(n.split("-")[1]),) for n in self._names("done") if n.startswith(f"{self.fill_number()}-")]
        rows = self.items().join(F.broadcast(self.spark.createDataFrame(done, "id long")), "id", "left_anti")
        return (rows if source is None else rows.filter(F.col("source") == source)).orderBy("id")

    def count(self, source: str | None = None) -> int:
        return self.pending(source).count()

    def claim(self) -> Claim | None:
        """The first item, under a lease; None if there is none or another worker holds a lease."""
        fill, held, back = self.fill_number(), self._names("leases"), self._names("returned")
        last = max((int(n.split("-")[1]) for n in held if n.startswith(f"{fill}-")), default=0)
        name = f"{fill}-{last}"
        if last and name not in back and time.time() - held[name] < self.seconds:
            return None
        if not self._create(f"leases/{fill}-{last + 1}"):
            return None
        head = self.pending().first()  # looked up under the lease
        if head is None:
            self._create(f"returned/{fill}-{last + 1}")
            return None
        return Claim(Item(head["source"], head["kind"], head["path"]), head["id"], fill, last + 1)

    def finish(self, claim: Claim, done: bool = True) -> None:
        """Give a lease back; with ``done`` the item leaves the queue."""
        if done:
            self._create(f"done/{claim.fill}-{claim.id}")
        self._create(f"returned/{claim.fill}-{claim.lease}")
