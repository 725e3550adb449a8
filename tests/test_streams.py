"""Streams against their batch twins: merged state, replays, timers and evicted state."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from outfall.operators import correlate as C
from outfall.operators import match
from outfall.plans import scan as PS
from outfall.rules.pack import builtin_pack
from outfall.sources.policies import Policy
from outfall.streaming import progress as PR
from outfall.streaming.scan import Layers, merge_batch, read_evidence, read_findings, read_verdicts

DAY = "DATE '2024-02-15'"


def files(spark, rows):
    return spark.createDataFrame([(r, p, t.encode()) for r, p, t in rows], "run_id string, path_in_tree string, content binary")


def secret(i: int) -> str:
    return f"token ghp_{'a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6'}{i:04}"


def batches():
    one = [("r1", f"a{i}", secret(i)) for i in range(18)] + [("r2", "x", "nothing here"), ("r3", "k", "-----BEGIN RSA PRIVATE KEY-----")]
    two = [("r1", f"b{i}", secret(i + 16)) for i in range(6)] + [("r1", "0first", secret(3)), ("r2", "y", "-----BEGIN EC PRIVATE KEY-----")]
    three = [("r1", "c", secret(2) + "\n" + secret(900)), ("r4", "z", "clean")]
    return [one, two, three]


def key(rows):
    return sorted((r["run_id"], r["rule_id"], r["id"], r["title"], r["confidence"], r["value_masked"]) for r in rows.collect())


def test_merged_state_equals_all_evidence_at_once(spark, tmp_path):
    pack, day = builtin_pack(), F.expr(DAY)
    for every in (32, 1):
        base = str(tmp_path / f"s{every}")
        seen = []
        for n, rows in enumerate(batches()):
            merge_batch(files(spark, rows), n, pack, base, [Policy()], day, every)
            seen += rows
            if n < (1 if every > 1 else 2):
                continue
            evidence = match.scan(files(spark, seen), pack, ["run_id", "path_in_tree"])
            whole = C.correlate(evidence, PS.rule_dimension(pack, spark))
            assert key(read_findings(spark, base)) == key(whole.findings), (every, n)
            runs = files(spark, seen).select("run_id").distinct().withColumn("status", F.lit("completed"))
            want = PS.gate_new(whole.findings, whole.locations, [Policy()], day, runs).verdicts
            got = read_verdicts(spark, base)
            assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect())), (every, n)
        assert Layers(spark, base).first == (2 if every == 1 else 0)
        # a batch that is replayed, after a try that got as far as its state, changes nothing
        before = key(read_findings(spark, base))
        merge_batch(files(spark, batches()[2]), 2, pack, base, [Policy()], day, every)
        assert key(read_findings(spark, base)) == before and read_evidence(spark, base).count() == evidence.count()


def test_a_batch_reads_only_what_it_touches(spark, tmp_path):
    pack, base = builtin_pack(), str(tmp_path / "s")
    for n, rows in enumerate(batches()):
        merge_batch(files(spark, rows), n, pack, base, [Policy()], F.expr(DAY))
    layer = spark.read.parquet(f"{base}/groups/batch_id=2").select("run_id", "rule_id").distinct().collect()
    assert {(r["run_id"], r["rule_id"]) for r in layer} == {("r1", "github-token")}  # r3 and the key of r2 were not written again


UPDATES = "run_id string, ts timestamp, event_id bigint, status string, analyzer string, stage_status string"


class Feed:
    """A stream fed file by file; each ``push`` is one micro-batch, run to its end."""

    def __init__(self, spark, folder, make, schema=UPDATES):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        (folder / "in").mkdir()
        self.stream = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))

    def push(self, *rows) -> int:
        """Rows in the state after the batch."""
        frame = self.spark.createDataFrame([(r, datetime(2024, 1, 1) + timedelta(minutes=m), e, s, "static", "x") for r, m, e, s in rows], self.schema)
        frame.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        run = self.stream.writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/ck").option("path", f"{self.folder}/out").trigger(availableNow=True).start()
        run.awaitTermination()
        return run.lastProgress.stateOperators[0].numRowsTotal

    def rows(self):
        return sorted(tuple(r) for r in self.spark.read.schema(self.stream.schema).parquet(f"{self.folder}/out").drop("ts", "last_ts").collect())


def test_progress_forgets_finished_runs(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda u: PR.progress_stream(u, "10 minutes", 600))
    feed.push(("a", 2, 2, "running"), ("a", 1, 1, "queued"), ("b", 1, 3, "queued"), ("a", 3, 4, "running"))
    feed.push(("a", 4, 5, "completed"), ("a", 5, 6, "running"), ("b", 6, 7, "queued"))
    feed.push(("a", 7, 8, "running"), ("b", 8, 9, "failed"))  # a lingers, so its row is ignored
    left = feed.push(("c", 200, 10, "completed"))  # the watermark passes a and b
    left = feed.push(("d", 400, 11, "completed")) and feed.push(("d", 600, 12, "completed"))
    text = lambda s: f"{s}|static|x"
    assert feed.rows()[:5] == [("a", 1, text("queued")), ("a", 2, text("running")), ("a", 5, text("completed")), ("b", 3, text("queued")), ("b", 9, text("failed"))]
    assert left <= 3  # d alone: its value and its timer
    feed.push(("a", 100, 13, "running"))  # later than the watermark allows: dropped
    feed.push(("a", 700, 14, "queued"))  # in time, and nothing is known of a any more: begins anew
    assert [r for r in feed.rows() if r[0] == "a"][3:] == [("a", 14, text("queued"))]


def test_overdue_runs_are_told_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda u: PR.overdue_stream(u, 1800, "5 minutes"))
    feed.push(("a", 1, 1, "running"), ("b", 1, 2, "queued"), ("c", 2, 3, "running"))
    feed.push(("b", 20, 4, "running"), ("c", 21, 5, "completed"))
    assert feed.rows() == []
    feed.push(("x", 40, 6, "completed"))
    assert feed.rows() == [("a", "running")]
    left = feed.push(("x", 90, 7, "completed"))
    assert feed.rows() == [("a", "running"), ("b", "running")] and left == 0
    feed.push(("a", 95, 8, "running"))
    feed.push(("x", 200, 9, "completed"))
    assert feed.rows() == [("a", "running"), ("a", "running"), ("b", "running")]


def test_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"r{rng.randint(0, 5)}", rng.randint(0, 500), i, rng.choice(["queued", "running", "running", "completed"])) for i in range(200)]
    feed = Feed(spark, tmp_path, lambda u: PR.progress_stream(u))
    feed.push(*rows)
    batch = spark.read.schema(UPDATES).parquet(f"{tmp_path}/in")
    assert feed.rows() == sorted((r["run_id"], r["event_id"], r["payload"]) for r in PR.progress_changes(batch).collect())
