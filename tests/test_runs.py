"""Order, state, quotas and bad items against plain versions; streams against the batch rule."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import quotas, runs, tables
from ridgeline.streaming import stateful

HOUR = 3_600


def folded(rows):
    """(who, order, action) rows: what each finds and makes of its key's status."""
    status, out = {}, []
    for who, order, action in sorted(rows, key=lambda r: (r[0], r[1])):
        before = status.get(who, "none")
        status[who], answer = runs.step(before, action)
        out.append((who, order, before, status[who], answer))
    return sorted(out)


def some_actions(seed, n=400):
    r = random.Random(seed)
    return [(0 if r.random() < 0.5 else r.randrange(6), i, r.choice(["submit", "submit", "delete", "reset", "purge", "odd", None])) for i in r.sample(range(5 * n), n)]


def test_steps():
    assert [runs.step(s, a) for s, a in (("none", "delete"), ("resetting", "submit"), ("deleted", "delete"), ("active", None))] == [(s, "refused") for s in ("none", "resetting", "deleted", "active")]


@pytest.mark.parametrize("seed", [1, 2])
def test_lifecycle_equals_a_fold(spark, seed):
    """One key with half of all actions lies in several ranges."""
    rows = some_actions(seed)
    df = spark.createDataFrame(rows + [(None, 1, "submit")], "who long, at long, action string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(tuple(r) for r in runs.lifecycle(df, "who", ["at"], "action").select("who", "at", "before", "after", "answer").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == folded(rows)
    assert {a for *_, a in got} == {"created", "deduplicated", "restored", "deleted", "resetting", "purged", "refused"}


def test_running(spark):
    r = random.Random(3)
    rows = [(None if i % 9 == 0 else i % 2, i, r.randrange(100) if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i int, x int").repartition(4)
    for how, fold in (("max", max), ("sum", sum)):
        seen, want = defaultdict(list), {}
        for g, i, x in rows:
            want[i] = fold(seen[g]) if seen[g] else None
            seen[g] += [] if x is None else [x]
        assert {y.i: y.p for y in runs.running(df, ["g"], ["i"], "x", how, "p").collect()} == want
    with pytest.raises(ValueError):
        runs.running(df, ["g"], ["i"], "x", "min", "p")


def test_reading_order(spark):
    """The second box reaches below the first, so the third, which the first doesn't touch, is in its row; the fourth is not."""
    boxes = [(1, 1, 50.0, 0.0, 60.0, 10.0), (1, 2, 0.0, 5.0, 40.0, 30.0), (1, 3, 20.0, 25.0, 30.0, 28.0), (1, 4, 0.0, 30.0, 9.0, 40.0), (2, 1, 5.0, 5.0, 6.0, 6.0), (2, 2, 5.0, 5.0, 6.0, 6.0)]
    df = spark.createDataFrame(boxes, "page int, box int, left double, top double, right double, bottom double")
    got = sorted((x.page, x.place, x.box, x.row, x.on_page) for x in runs.reading_order(df, "page", "box").collect())
    assert got == [(1, 1, 2, 1, 4), (1, 2, 3, 1, 4), (1, 3, 1, 1, 4), (1, 4, 4, 2, 4), (2, 1, 1, 1, 2), (2, 2, 2, 1, 2)]


def test_quotas(spark):
    r = random.Random(4)
    rows = [(i, g, r.random() < (0.02 if g == 1 else 0.5), r.random() < 0.3, r.random() < 0.5) for g, n in ((0, 300), (1, 300), (2, 12), (None, 40)) for i in range(1000 * (g or 0), 1000 * (g or 0) + n) for g in (g,)]
    df = spark.createDataFrame(rows, "id long, g int, a boolean, b boolean, c boolean")
    strata = [(F.col("a"), 0.75), (F.col("b"), 0.55), (F.col("c"), 0.85)]
    got = [tuple(x) for x in quotas.by_quota(df.repartition(7), "g", "id", strata, 40, 5).select("g", "stratum", "id").collect()]
    again = [tuple(x) for x in quotas.by_quota(df.repartition(2), "g", "id", strata, 40, 5).select("g", "stratum", "id").collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))
    count = defaultdict(lambda: [0] * 4)
    for g, s, _ in got:
        count[g][s] += 1
    assert count[0] == [30, 6, 3, 1] and sum(count[1]) == 40 and sum(count[2]) == 12
    here = [sum(1 for _, g, a, b, c in rows if g == 1 and s == (0 if a else 1 if b else 2 if c else 3)) for s in range(4)]
    assert count[1][0] == here[0] < 30 and count[1][1] == min(here[1], 36 - here[0])


def test_compatible_counts_with_a_hot_group(spark):
    r = random.Random(5)
    rows = [(i, "hot" if i % 3 else r.choice(["", None, " ", "b", " hot "]), r.choice(["x", "y", "", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, s string").repartition(4)
    clean = lambda v: (v or "").strip()
    want = {}
    for i, g, s in rows:
        some = [(t, h) for j, h, t in rows if j != i and (not clean(g) or not clean(h) or clean(g) == clean(h))]
        want[i] = (len(some), sum(clean(t) == clean(s) != "" for t, _ in some))
    assert {x.id: (x.candidates, x.relevant_candidates) for x in quotas.compatible_counts(df, "id", "g", "s").collect()} == want
    assert quotas.compatible_counts(df.limit(0), "id", "g", "s").count() == 0


def halves(row):
    if row["x"] is None:
        raise TypeError("nothing")
    return 10 // row["x"]


def test_bad_items_fail_alone(spark, tmp_path):
    """Results and dead letters from one pass, a stream's sink, and another try at the dead letters alone."""
    df = spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, 5)], "id int, x int").repartition(2)
    good, dead = quotas.parted(quotas.attempted(df, halves, "half", "long").cache(), "half")
    assert sorted(map(tuple, good.collect())) == [(1, 2, 5), (4, 5, 2)]
    assert sorted((d.id, d.error.split(":")[0]) for d in dead.collect()) == [(2, "ZeroDivisionError"), (3, "TypeError")]
    again = quotas.retried(dead.withColumn("x", F.when(F.col("id") == 2, 1).otherwise(F.col("x"))), halves, "half", "long")
    assert sorted((a.id, a.half, a.error is None, a.tries) for a in again.collect()) == [(2, 10, True, 2), (3, None, False, 2)]
    third = quotas.retried(quotas.parted(again, "half")[1], halves, "half", "long")
    assert [(a.id, a.tries) for a in third.collect()] == [(3, 3)]
    df.write.parquet(f"{tmp_path}/in")
    stream = quotas.attempted(spark.readStream.schema("id int, x int").parquet(f"{tmp_path}/in"), halves, "half", "long")

    def sink(batch, number):
        batch.persist()
        for rows, name in zip(quotas.parted(batch, "half"), ("good", "dead")):
            rows.write.mode("overwrite").parquet(f"{tmp_path}/{name}/batch={number}")
        batch.unpersist()

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == spark.read.parquet(f"{tmp_path}/dead").count() == 2


def streamed(spark, tmp_path, rows, make, name):
    """rows (who, seconds, id, action) in three files, the query stopped and started again after the first; all answers."""
    spark.conf.set(*stateful.STATE_STORE)
    schema = "who long, ts timestamp, id long, action string"
    end = max(r[1] for r in rows)
    rows = sorted(rows, key=lambda r: r[1])
    parts = [rows[:60], rows[60:], [(99, end + 10 * HOUR, 10**6, None)], [(99, end + 20 * HOUR, 10**6 + 1, None)]]
    for n, part in enumerate(parts):
        df = spark.createDataFrame([(w, s, i, a) for w, s, i, a in part], "who long, s long, id long, action string").select("who", F.timestamp_seconds("s").alias("ts"), "id", "action")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
        query = make(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-cp").trigger(availableNow=True).start(f"{tmp_path}/{name}-out")
        query.awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}-out").where("who <> 99").collect()]


def test_streams_equal_the_batch_rule(spark, tmp_path):
    """Counts of 24 hours that don't lag, and the life cycle, over restarts from the checkpoint."""
    r = random.Random(6)
    rows = [(r.randrange(3), 10**9 + r.randrange(60) * HOUR, i, r.choice(["submit", "delete", "reset", "purge"])) for i in range(150)]
    df = spark.createDataFrame(rows, "who long, s long, id long, action string").withColumn("ts", F.timestamp_seconds("s"))
    got = streamed(spark, tmp_path, rows, lambda s: stateful.exact_caps(s, "who", "ts", "id", cap=4), "caps")
    want = {x.id: x.in_window for x in tables.rolling_count(df, "who", "ts").collect()}
    assert {i: n for _, i, n, _ in got} == want and len(got) == len(rows)
    taken, accepted = defaultdict(list), {}
    for who, s, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        accepted[i] = sum(t >= s - 24 * HOUR for t in taken[who]) < 4
        taken[who] += [s] if accepted[i] else []
    assert {i: a for _, i, _, a in got} == accepted and not all(accepted.values())
    lives = streamed(spark, tmp_path, rows, lambda s: stateful.lifecycle(s, "who", "ts", "id", "action"), "lives")
    table = runs.lifecycle(df, "who", ["ts", "id"], "action").select("who", "id", "before", "after", "answer")
    assert sorted(lives) == sorted(tuple(x) for x in table.collect())


def test_small_pages_are_dealt_once(spark, monkeypatch):
    """Pages of any size read alike, a null page too; where none is large, nothing goes over ranges."""
    r = random.Random(8)
    rows = [(p, i, *(float(r.randrange(40)) for _ in range(2))) for p, n in ((1, 90), (2, 7), (None, 12), (3, 1), (None, 30)) for i in range(n)]
    rows = [(p, n, x, y, x + 5, y + 1 + n % 4) for n, (p, _, x, y) in enumerate(rows)]
    df = spark.createDataFrame(rows, "page long, box long, left double, top double, right double, bottom double").repartition(3)
    used, plain = [], runs.running
    monkeypatch.setattr(runs, "running", lambda *a: used.append(a) or plain(*a))
    read = lambda: sorted((tuple(x) for x in runs.reading_order(df, "page", "box").collect()), key=str)
    at_once = read()
    assert not used and len(at_once) == len(rows)
    for most in (0, 20):
        monkeypatch.setattr(runs, "PAGE", most)
        assert read() == at_once and used
