import json
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import research
from loomline.streaming import leases

KIND = "run_id long, pos long, kind string, at_ms long, token string, lease_ms long, result string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, folder, batches, **how):
    """What a stream tells after each batch of events, and the batches' own number."""
    landing = folder / "in"
    landing.mkdir()
    told = []
    for k, rows in enumerate(batches):
        (landing / f"{k:03d}.json").write_text("\n".join(json.dumps(dict(zip(("run_id", "pos", "kind", "at_ms", "token", "lease_ms", "result"), r, strict=True))) for r in rows))
        stream = spark.readStream.schema(KIND).json(str(landing)).withColumn("at", F.timestamp_millis("at_ms"))
        out = []
        leases.lease_steps(stream, **how).writeStream.outputMode("update").foreachBatch(lambda df, _, out=out: out.extend(df.collect())).option("checkpointLocation", str(folder / "ckpt")).trigger(availableNow=True).start().awaitTermination()
        told.append(out)
    return told


def events(seed, runs=4, n=60):
    rng = random.Random(seed)
    rows, at, pos = [], 1_000_000, dict.fromkeys(range(runs), 0)
    for _ in range(n):
        key, at = rng.randrange(runs), at + rng.randrange(1, 2000)
        kind = rng.choice(["create", "claim", "claim", "complete", "fail"])
        rows.append((key, pos[key], kind, at, f"w{rng.randrange(2)}", at + 3000 if kind == "claim" else None, "r" if kind == "create" else rng.choice("xy")))
        pos[key] += 1
    return rows


def test_every_prefix_is_as_the_batch_fold_has_it(rocks, tmp_path):
    rows = events(7)
    cuts = [0, 17, 18, 40, 60]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    state, heard = {}, 0
    for end, out in zip(cuts[1:], run(rocks, tmp_path, batches), strict=True):
        last = {}
        for r in out:
            if r.pos is not None and r.pos >= last.get(r.run_id, (-1,))[0]:
                last[r.run_id] = (r.pos, (r.status, r.token, r.lease_ms, r.started_ms, r.ended_ms, r.result))
        state |= {k: v for k, (_, v) in last.items()}
        heard += sum(r.pos is not None for r in out)
        want = research.lease_states(rocks.createDataFrame(rows[:end], KIND)).collect()
        assert state == {r.run_id: (r.status, r.token, r.lease_ms, r.started_ms, r.ended_ms, r.result) for r in want} and heard == end


def test_leases_end_and_ended_runs_are_forgotten_by_timers(rocks, tmp_path):
    new, far = ("create", 1000, None, None, "r"), 10_000_000
    batches = [
        [(1, 0, *new), (1, 1, "claim", 2000, "w", 5000, None), (2, 0, *new), (2, 1, "claim", 2000, "w", 900_000, None), (2, 2, "complete", 3000, "w", None, "x")],
        [(9, 0, "create", 6000, None, None, "r")],  # only moves the time on
        [(9, 1, "claim", 7000, "w", far, None)],
        [(9, 2, "claim", 60_000, "v", far, None)],
        [(2, 3, "create", 61_000, None, None, "r"), (1, 2, "claim", 61_000, "v", far, None)],
    ]
    told = [[(r.run_id, r.pos, r.what) for r in out] for out in run(rocks, tmp_path, batches, retention_ms=20_000)]
    flat = [x for out in told for x in out]
    assert (1, None, "lease-expired") in flat and (2, None, "forgotten") in flat and (2, None, "lease-expired") not in flat
    assert flat.index((1, None, "lease-expired")) < flat.index((9, 2, "held")) < flat.index((2, 3, "created"))
    assert (1, 2, "claimed") in told[4] and (2, 3, "created") in told[4]
