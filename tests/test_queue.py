import threading
import time

from quaero.streaming import plan as planned
from quaero.streaming.plan import Settings, plan, run_plan
from quaero.streaming.queue import Item, Queue
from quaero.streaming.rounds import Snapshots


def made(tmp_path, names):
    for n in names:
        (tmp_path / n).mkdir()
        (tmp_path / n / "x.txt").write_text(f"tekst van {n}")
    return [str(tmp_path / n) for n in names]


def test_leases_and_counts(spark, tmp_path):
    queue = Queue(spark, f"file://{tmp_path}/q")
    assert queue.claim() is None and queue.count() == 0
    queue.fill([Item("a", "k", "1"), Item("b", "k", "2"), Item("a", "k", "3")])
    assert (queue.count(), queue.count("a")) == (3, 2)
    first = queue.claim()
    assert first.item == Item("a", "k", "1") and queue.claim() is None
    queue.finish(first, done=False)  # given back undone
    again = queue.claim()
    assert again.item == first.item
    queue.finish(again)
    assert [r.path for r in queue.pending().collect()] == ["2", "3"]
    assert Queue(spark, f"file://{tmp_path}/q", seconds=0.0).claim().item.path == "2"
    late = Queue(spark, f"file://{tmp_path}/q", seconds=0.0).claim()  # the lease before has run out
    assert late.item.path == "2"
    queue.clear()
    assert queue.count() == 0


def test_two_workers_drain_one_queue(spark, tmp_path, monkeypatch):
    folders = made(tmp_path, "abcd")
    seen, real = [], planned._round

    def noted(snapshots, walked, item, completed):
        seen.append((threading.get_ident(), item.path))
        return real(snapshots, walked, item, completed)

    monkeypatch.setattr(planned, "_round", noted)
    at = f"file://{tmp_path}/index"
    Settings(spark, at).queue.fill(plan(folders))
    found, threads = [], []
    for _ in range(2):
        threads.append(threading.Thread(target=lambda: found.append(run_plan(Settings(spark, at), Snapshots(spark, at), []))))
        threads[-1].start()
    for t in threads:
        t.join()
    assert sorted(p for _, p in seen) == folders and sum(f["added"] for f in found) == 4
    assert {f["status"] for f in found} == {"klaar"} and Snapshots(spark, at).documents().count() == 4
    state = planned.status(Settings(spark, at), Snapshots(spark, at)).first()
    assert (state.status, state.pending, state.documents, state.sources) == ("klaar", 0, 4, 4)


def test_stopped_from_another_thread(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    folders = made(tmp_path, "ab")
    settings, snapshots = Settings(spark, f"file://{tmp_path}/index"), Snapshots(spark, f"file://{tmp_path}/index")
    real, started = planned.run_round, threading.Event()

    @F.udf("string")
    def slow(text):
        time.sleep(60)
        return text

    def hangs(snapshots, files, completed=None, **more):
        if files.filter(F.col("path").contains("/b/")).isEmpty():
            return real(snapshots, files, completed)
        started.set()
        return real(snapshots, files.withColumn("path", slow("path")), completed)

    with monkeypatch.context() as m:
        m.setattr(planned, "run_round", hangs)
        got = []
        worker = threading.Thread(target=lambda: got.append(run_plan(settings, snapshots, plan(folders))))
        worker.start()
        assert started.wait(120)
        time.sleep(2)
        began = time.time()
        planned.stop(settings)
        worker.join()
        assert time.time() - began < 40
    assert (got[0]["added"], got[0]["pending"], got[0]["status"]) == (1, 1, "onderbroken")
    assert snapshots.documents().count() == 1
    got = run_plan(settings, snapshots, [])
    assert (got["resumed"], got["added"], got["status"]) == (1, 1, "klaar")
