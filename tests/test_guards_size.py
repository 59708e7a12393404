"""Guards at size: events that wait are few elements of the state, and none is lost between them."""

from datetime import timedelta

from tests.test_streams import START, event, log  # noqa: F401
from worklog.streaming import streams


def test_waiting_events_are_packed(spark, log, tmp_path):  # noqa: F811
    rows = [(f"e{n:05d}", *event(n, "task.created" if n == 0 else ("task.claimed", "task.released")[n % 2 == 0])[1:]) for n in range(5000)]
    rows = [(*r[:6], START + timedelta(seconds=n), *r[7:]) for n, r in enumerate(rows)][::-1]
    path, state = log(rows, [event(0, "task.created", 3 * 24 * 60, task="end")]), str(tmp_path / "cp")
    for files, waiting in ((1, 2), (None, 1)):
        stream = streams.read_events(spark, path if files is None else f"{path}/000.parquet*")
        with streams.keyed_state(spark):
            q = streams.guard_transitions(stream, "1 day").writeStream.format("memory").queryName(f"packed{waiting}").option("checkpointLocation", f"{state}{waiting}").trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert spark.read.format("statestore").option("stateVarName", "waiting").load(f"{state}{waiting}").count() == waiting
        got = sorted(spark.table(f"packed{waiting}").collect(), key=lambda r: r.id)
        assert [r.id for r in got] == ([] if files else [f"e{n:05d}" for n in range(5000)])
        assert all(r.verdict == "allowed" and r.after == ("ready", "in_progress")[n % 2] for n, r in enumerate(got))
