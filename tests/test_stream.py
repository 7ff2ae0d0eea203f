"""The ledger's stream against the replay, and its state."""

import random
from datetime import date, timedelta

import pytest

from tidewindow.operators.ledger import replay
from tidewindow.streaming.ledger import STATE_STORE, ledger_stream

SCHEMA = "id string, day date, pct double, endDate date"
START = date(2026, 1, 1)
DAY = lambda k: START + timedelta(days=k)


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs batches of sightings through the stream: the last row of each entry, and the state rows at the end."""
    before = {k: spark.conf.get(k, None) for k in (STATE_STORE[0], "spark.sql.shuffle.partitions")}
    spark.conf.set(*STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(batches, name, **how):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name / str(k)))
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        found, rows = {}, []

        def take(df, _):
            for r in df.collect():
                found[r["id"], r["firstSeen"]] = tuple(r)

        q = ledger_stream(source, **how).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
        try:
            q.processAllAvailable()
            rows = [o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]
        finally:
            q.stop()
        return found, rows

    yield run
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_shuffled_days_fold_as_the_replay(spark, streamed):
    r = random.Random(5)
    rows = []
    for route in range(6):
        day = r.randrange(5)
        while day < 40:
            for _ in range(r.choice((1, 1, 2))):
                rows.append((f"r{route}", DAY(day), float(r.randrange(20, 60)), DAY(day + r.randrange(9)) if r.random() < 0.4 else None))
            day += r.choice((1, 1, 2, 3, 4, 9))
    # within the lateness of five days any order will do
    late = sorted(rows, key=lambda x: (x[1] - START).days + r.random() * 4.5)
    size = len(late) // 6 + 1
    batches = [late[k : k + size] for k in range(0, len(late), size)] + [[("last", DAY(90), 1.0, None)], [("last", DAY(91), 1.0, None)]]
    found, state = streamed(batches, "shuffled", gap=3, lateness=5)
    want = {(x["id"], x["firstSeen"]): tuple(x) for x in replay(spark.createDataFrame(rows, SCHEMA), gap=3).collect()}
    assert {k: v for k, v in found.items() if k[0] != "last"} == want and len(want) > 12
    assert max(state) >= 10 and state[-1] <= 6  # what the six routes had is gone: only the last one is open


def test_what_is_too_late_is_left_out(streamed):
    batches = [[("a", DAY(0), 10.0, None)], [("a", DAY(30), 20.0, None)], [("a", DAY(1), 99.0, None), (None, DAY(31), 1.0, None), ("b", None, 1.0, None)], [("z", DAY(60), 1.0, None)], [("z", DAY(61), 1.0, None)]]
    found, _ = streamed(batches, "late", lateness=2)
    assert {k: v for k, v in found.items() if k[0] != "z"} == {("a", DAY(0)): ("a", DAY(0), DAY(0), 10.0, None), ("a", DAY(30)): ("a", DAY(30), DAY(30), 20.0, None)}
