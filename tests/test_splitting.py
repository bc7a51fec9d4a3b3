import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattika.streaming import sessions
from lattika.streaming.splitting import PROVIDER, ROCKS, split, split_stream

SCHEMA = "session string, id long, text string, ts timestamp, final boolean"
T0 = dt.datetime(2024, 5, 1)
TEXTS = ["plain", "a<think>b</think>c", "<think>x<think>y</think></think>z\n", "<<think>think>q</</think>", "open <think>never closed \n", "almost <thin", "a</think>b<think></think>", ""]


def test_any_cut_gives_the_whole(spark):
    whole = {r.session: (r.visible, r.inner) for r in sessions.visible_and_inner(spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(TEXTS)], "session string, id long, text string")).collect()}
    for i, t in enumerate(TEXTS):
        for cuts in itertools.combinations(range(len(t) + 1), 2):
            parts, pending, inside, got = [t[: cuts[0]], t[cuts[0] : cuts[1]], t[cuts[1] :]], "", False, ["", ""]
            for n, part in enumerate(parts):
                visible, inner, pending, inside = split(pending, inside, part, n == 2)
                got[0] += visible
                got[1] += inner
            assert tuple(got) == whole[str(i)] and pending == ""


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    yield spark
    spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def drain(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = split_stream(stream, quiet_seconds=60).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").groupBy("session").agg(F.array_sort(F.collect_list(F.struct("id", "visible", "inner"))).alias("r"))
    return {r.session: ("".join(x.visible for x in r.r), "".join(x.inner for x in r.r)) for r in out.collect()}


def test_stream_over_batches_restart_repeats_and_expiry(rocks, tmp_path):
    """Texts cut at random over four batches; the query is started anew between them; a silent session is ended by its timer."""
    spark, rnd = rocks, random.Random(4)
    batches = [[] for _ in range(4)]
    for i, t in enumerate(TEXTS):
        cuts = sorted(rnd.sample(range(len(t) + 1), min(6, len(t) + 1)))
        parts = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]
        for n, part in enumerate(parts):
            row = (str(i), n, part, T0 + dt.timedelta(seconds=n), n == len(parts) - 1)
            at = n * 4 // len(parts)
            batches[at].append(row)
            if n % 3 == 1 and at < 3:
                batches[at + 1].append(row)  # comes twice
    batches[0] += [("quiet", 0, "left <th", T0, False), ("quiet", 1, None, T0, False)]
    late = T0 + dt.timedelta(hours=1)
    for k, rows in enumerate([*batches, [("clock", 0, "x", late, True)], [("clock2", 0, "y", late, True)]]):
        rnd.shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        if k in (1, 2):
            drain(spark, tmp_path)
    found = drain(spark, tmp_path)
    for i, t in enumerate(TEXTS):
        assert found[str(i)] == split("", False, t, True)[:2]
    assert found["quiet"] == ("left <th", "") and found["clock2"] == ("y", "")


def test_other_state_stores_are_refused(spark):
    with pytest.raises(ValueError):
        split_stream(spark.createDataFrame([], SCHEMA))
