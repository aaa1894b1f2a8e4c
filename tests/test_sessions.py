"""Sessions in batch and on a stream: brute force, late rows, restart after a failure."""

import datetime as dt
import random

import pytest

from vigil.streaming import sessions as SS

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp_ntz"


def _events(seed, n, first=0, span=3000):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "a", "b", None]), START + dt.timedelta(minutes=first + rng.randint(0, span))) for i in range(n)]


def _brute(rows, gap):
    out = []
    for k in {r[1] for r in rows}:
        times = sorted(t for _, x, t in rows if x == k and t is not None)
        run = []
        for t in times:
            if run and t >= run[-1] + gap:
                out.append((k, run[0], run[-1] + gap, len(run)))
                run = []
            run.append(t)
        if run:
            out.append((k, run[0], run[-1] + gap, len(run)))
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


def test_batch_sessions(spark):
    rows = _events(1, 400) + [(900, "a", None), (901, "a", START), (902, "a", START)]
    got = SS.sessions(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", 1800).collect()
    assert _sorted(got) == _sorted(_brute(rows, dt.timedelta(minutes=30)))


def _arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path, monkeypatch):
    gap, delay = dt.timedelta(minutes=30), dt.timedelta(hours=2)
    slices = [_events(2, 80, 0, 900), _events(3, 80, 850, 900), _events(4, 80, 1700, 900), [(7, "a", START + dt.timedelta(days=9))]]
    slices[2] += [(500, "hot", START + dt.timedelta(minutes=3)), (501, None, START), (502, "a", None)]  # late, and without a time
    taken, late, mark = [], [], None
    for part in slices:  # what the watermark of the batch before lets in
        on_time = [r for r in part if r[2] is not None and (mark is None or r[2] >= mark)]
        taken += on_time
        late += [r for r in part if r not in on_time]
        newest = max(r[2] for r in part if r[2] is not None) - delay
        mark = newest if mark is None else max(mark, newest)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        SS.sessions_stream(stream, ["k"], "ts", 1800, 7200, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    for n, part in enumerate(slices):
        _arrive(spark, f"{tmp_path}/in", part)
        if n == 2:  # the batch dies after its sessions are written, before its state is
            with monkeypatch.context() as m:
                m.setattr(SS, "drop_folder", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
                with pytest.raises(Exception, match="driver lost"):
                    run()
        run()
    closed = [s for s in _brute(taken, gap) if s[2] <= mark]
    got = spark.read.parquet(f"{tmp_path}/out/sessions").select("k", "session_start", "session_end", "n").collect()
    assert _sorted(got) == _sorted(closed) and len(closed) > 20
    assert _sorted(r[:3] for r in spark.read.parquet(f"{tmp_path}/out/late").select("id", "k", "ts").collect()) == _sorted(late) and len(late) >= 3
