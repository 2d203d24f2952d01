"""Price history as a stream with state, stopped and started again, against the runs one after the other."""

import random
from datetime import date, timedelta

import pytest

from tentpole.operators import state
from tentpole.streaming import states

SCHEMA = "key string, price string, seq int, stamp date"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, states.STORE)
    yield
    spark.conf.set(name, before)


def runs() -> list[tuple[date, list[tuple]]]:
    """Runs some days apart, once more than sixty; keys come, change, stay away, and come again after they were forgotten."""
    rng, day, out = random.Random(6), date(2026, 1, 1), []
    for gap in (0, 10, 25, 30, 70, 5, 40, 21):
        day += timedelta(gap)
        rows = [(f"k{k}", rng.choice(["10 €", "12 €", "", None]), rng.randrange(3), day) for k in range(30) for _ in range(rng.choice([0, 0, 1, 2]))]
        out.append((day, [*dict(((r[0], r[2]), r) for r in rows).values()]))
    return out


def test_state_over_a_stop_equals_the_runs(spark, store, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("runs", "out", "check"))

    def go() -> None:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        states.price_updates(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    history = spark.createDataFrame([], "key string, first string, since date, current string, stamp date")
    for n, (day, rows) in enumerate(runs()):
        run = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        run.write.mode("append").parquet(source)
        history = spark.createDataFrame(state.price_history(history, run, day).collect(), history.schema)
        if n in (2, 7):  # three runs, a stop, and the other five
            go()
            got = states.history_of(spark.read.parquet(out), day)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, history.collect()))
    every = spark.read.parquet(out).collect()
    assert any(r.gone for r in every) and len({r.since for r in every}) > 3
