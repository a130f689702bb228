from __future__ import annotations

import random

import pytest
from conftest import plan_text
from packets import frame, random_packets
from pyspark.sql import functions as F

import checks.fixtures as fx
from checks.compare import difference
from checks.oracles import ORACLES
from checks.queries import QUERIES
from wireloom.operators import decode, features, keywords, tcp
from wireloom.plans import jobs, staging
from wireloom.plans.skew import join_by_size, running
from wireloom.plans.staging import shared_folder, stage


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert difference(df, sf, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_sessions_to_features_shuffle_packets_once(spark):
    stored = stage(frame(spark, random_packets(1, 200, 1000)), "test")
    tagged = tcp.tag_sessions(stored, None)
    plan = plan_text(features.session_features(tagged))
    # Packets by 5-tuple; handshake rows by handshake; start markers.
    assert plan.count("Exchange hashpartitioning") == 3
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_handshakes_have_no_cartesian_product(spark):
    df = frame(spark, random_packets(2, 100, 1000))
    for plan in map(plan_text, (tcp.handshakes_any(df), tcp.handshakes_latest(df))):
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_handshakes_read_only_their_columns(spark):
    stored = stage(frame(spark, random_packets(3, 50, 1000)), "test")
    schema = plan_text(tcp.handshakes_latest(stored)).split("ReadSchema: ")[1].split(">")[0]
    assert "pld_len" not in schema and "si:" not in schema


def test_packets_are_built_behind_a_shuffle(spark, sf):
    """Tables of one file are one task's, so they are dealt before anything is made of their rows or counted."""
    branches = plan_text(fx.packets(spark, sf)).split("FileScan")[:-1]
    assert len(branches) == 3
    assert all("Exchange hashpartitioning" in b for b in branches)
    assert not any("HashAggregate" in b.rpartition("Exchange hashpartitioning")[2] for b in branches)


def test_join_by_size_equals_join(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaabc"), i) for i in range(200)] + [("d", 1)]
    left = spark.createDataFrame(rows, "k string, i int")
    sides = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    plain = sorted(left.join(sides, "k").collect())
    for limit in (0, 20, 1000):
        both = join_by_size(left, sides, ["k"], "n", limit).select("k", "i", "n", "top")
        assert sorted(both.collect()) == plain


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_with_chunks_equals_running_without(spark, inclusive):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), rng.randrange(60), i, rng.randrange(99)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, i int, x int")
    values = {"top": ("max", F.col("x")), "low": ("min", F.struct("x", "i"))}
    cut = df.withColumn("chunk", F.when(F.col("k") == "a", F.floor(F.col("t") / 7).cast("int")))
    plain = running(df, ["k"], ["t", "i"], values, inclusive)
    split = running(cut, ["k"], ["t", "i"], values, inclusive).drop("chunk")
    assert sorted(plain.select(*split.columns).collect(), key=str) == sorted(
        split.collect(), key=str
    )


def test_stage_uses_the_shared_folder(spark):
    df = stage(spark.range(10), "numbers")
    assert df.count() == 10
    assert all(shared_folder(spark) in f for f in df.inputFiles())


def test_preprocess_with_hot_flows_equals_without(spark, sf):
    frames = fx.frame_table(spark, sf)
    plain, hot = jobs.preprocess(frames), jobs.preprocess(frames, rows_per_chunk=20)
    columns = ["rowkey", "sid", "direction", "m", "fm", "pld_len"]
    a, b = (p.packets.select(*columns) for p in (plain, hot))
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()
    a, b = plain.sessions, hot.sessions.select(*plain.sessions.columns)
    assert a.exceptAll(b).isEmpty() and a.count() == b.count()


def test_preprocess_moves_packets_once(spark, sf):
    """One exchange of whole packets from tagging to directions and gaps; raw frames in none."""
    packets = fx.with_flow_key(decode.decoded_packets(fx.frame_table(spark, sf)))
    plan = plan_text(tcp_branch := jobs.tag_all(packets.where("pr = 6").drop("r"), rows_per_chunk=None))
    steps = [x for x in plan.split("\n") if "Window [" in x or "Exchange " in x]
    before = next(i for i, x in enumerate(steps) if "Exchange " in x)
    # Gaps, direction and session tag stand on the same exchange.
    assert before >= 3 and all("Window [" in x for x in steps[:before])
    assert "r" not in tcp_branch.columns


def test_mixed_tcp_and_udp_preprocess(spark):
    rows = random_packets(4, 200, 2000)
    udp = [(r[0] + 1000, r[1], 17, *r[3:7], None, None, None, None, 60) for r in rows]
    tagged = jobs.tag_all(frame(spark, rows + udp))
    assert tagged.where("pr = 17").count() == 200
    table = features.session_features(jobs.tcp_sessions(tagged))
    assert table.where("pr <> 6").isEmpty() and table.count() > 0


def test_keyword_job(spark, sf):
    words = jobs.mine_keywords(fx.payloads(spark, sf), fraction=1.0)
    assert words.count() == keywords.endpoint_directions(fx.payloads(spark, sf)).count()


def test_jobs_update_their_tables_in_place(spark, sf, tmp_path):
    from wireloom.__main__ import main

    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    frames = fx.frame_table(spark, sf)
    counts = []
    # The second half of the flows comes later, with the first brought once more.
    for part in ("rowkey % 2000 < 1000", "true"):
        frames.where(part).write.mode("overwrite").parquet(raw)
        main(["preprocess", raw, f"{out}/packets", f"{out}/sessions", "--update", "--prefixes", "4"])
        main(["train", f"{out}/sessions", f"{out}/profiles", f"{out}/models", "--update", "--prefixes", "4"])
        counts.append([spark.read.parquet(f"{out}/{t}/rows").count() for t in ("packets", "sessions", "profiles", "models")])
    whole = jobs.preprocess(frames)
    assert 0 < counts[0][0] < counts[1][0] == whole.packets.count()
    assert 0 < counts[0][1] < counts[1][1] == whole.sessions.count()
    assert counts[1][2] == 21 and 0 < counts[0][3] <= counts[1][3]


def test_a_session_without_settings_has_a_folder_of_its_own(tmp_path):
    """Another Python, as this one's session names a folder."""
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from wireloom.operators import reports
from wireloom.plans.staging import shared_folder, stage
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = stage(stage(spark.range(7), "a"), "b")
assert df.count() == 7 and all(shared_folder(spark) in f for f in df.inputFiles())
import checks.fixtures as fx
from wireloom.plans import jobs
print("sessions", jobs.preprocess(fx.frames(fx.packets(spark, "/root/testdata/sf0.001"))).sessions.count())
"""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=300)
    assert "sessions 1258" in done.stdout, done.stderr[-2000:]


def test_jobs_from_the_command_line(spark, sf, tmp_path):
    from wireloom.__main__ import main

    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    captures = str(tmp_path / "captures")
    fx.write_captures(fx.frame_table(spark, sf), captures)
    main(["ingest", captures, raw])
    main(["preprocess", raw, f"{out}/packets", f"{out}/sessions"])
    main(["train", f"{out}/sessions", f"{out}/profiles", f"{out}/models", "--old", "none"])
    main(["identify", f"{out}/sessions", f"{out}/models", f"{out}/identified"])
    main(["cluster", f"{out}/profiles", f"{out}/clusters"])
    main(["keywords", f"{out}/packets", f"{out}/keywords", "--fraction", "1.0"])
    main(["report", f"{out}/sessions"])
    for name in ("latest-sessions", "tcp-report", "udp-report", "counters"):
        main([name, f"{out}/packets", f"{out}/{name}"])
    read = spark.read.parquet
    report, counted = read(f"{out}/tcp-report").first(), read(f"{out}/counters").first()
    assert report["packets"] == counted["packets"] == 12102 and report["sessions"] == 1258
    assert report["tagged_packets"] == counted["tagged_packets"]
    assert read(f"{out}/udp-report").first()["sessions"] == 0
    assert read(f"{out}/latest-sessions").count() > counted["tagged_packets"] / 2
    assert read(f"{out}/packets").count() == 12102
    assert read(f"{out}/sessions").count() == read(f"{out}/identified").count() == 1258
    assert read(f"{out}/profiles").count() == read(f"{out}/clusters").count() == 21
    assert read(f"{out}/models").count() == 21


@pytest.mark.parametrize("few", [1, 2, 3, 4, 50])
def test_join_by_size_sends_the_largest_keys(spark, few):
    sizes = {1: 40, 2: 3, 3: 3, None: 2, 4: 1}
    rows = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "k int, i int")
    sides = spark.createDataFrame([(k, n, -n) for k, n in sizes.items()] + [(9, 7, 0)], "k int, n int, top int")
    both = join_by_size(rows, sides, ["k"], "n", few=few)
    got = sorted((r["k"], r["i"], r["n"], r["top"]) for r in both.collect())
    assert got == sorted((k, i, n, -n) for k, n in sizes.items() if k for i in range(n))


def test_sessions_of_few_endpoints_do_not_move(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(60)], "k int, i int")
    sides = spark.createDataFrame([(k, 20) for k in range(3)], "k int, n int")
    plan = plan_text(join_by_size(rows, sides, ["k"], "n"))
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("rows_per_chunk", [10**6, 20])
def test_preprocess_in_rounds_equals_one(spark, sf, monkeypatch, rows_per_chunk):
    """Decoded packets and the shuffle of all of them lay beside the tagged ones until the job ended."""
    frames = fx.frame_table(spark, sf)
    whole = jobs.preprocess(frames, rows_per_chunk=rows_per_chunk)
    monkeypatch.setattr(staging, "ROUND_BYTES", 1)
    monkeypatch.setattr(jobs, "ROUNDS", 4)
    rounds, real = [], jobs.tag_all

    def watched(packets, *rest):
        left = spark.read.schema(packets.schema).parquet(*{f.rsplit("/flow_group", 1)[0] for f in packets.inputFiles()})
        rounds.append((packets.count(), left.where("rowkey is not null").count()))
        return real(packets, *rest)

    monkeypatch.setattr(jobs, "tag_all", watched)
    cut = jobs.preprocess(frames, rows_per_chunk=rows_per_chunk)
    assert cut.counters == whole.counters and list(cut.counters) == list(whole.counters)
    assert len(rounds) == 4 and sum(n for n, _ in rounds) == frames.count()
    # A round finds what no round before it has read.
    assert [left for _, left in rounds] == [sum(n for n, _ in rounds[i:]) for i in range(4)]
    for a, b in ((cut.packets.drop("chunk"), whole.packets.drop("chunk")), (cut.sessions, whole.sessions)):
        assert a.columns == b.columns and a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_rounds_without_packets(spark, sf, tmp_path, monkeypatch):
    """A job, or a round, without TCP packets failed: its counts are left out of the plan."""
    fx.frame_table(spark, sf).limit(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    monkeypatch.setattr(jobs, "ROUNDS", 4)
    for size in (1 << 30, 1):
        monkeypatch.setattr(staging, "ROUND_BYTES", size)
        done, none = jobs.preprocess(one), jobs.preprocess(one.where("t < 0"))
        assert done.packets.count() == 1 and done.counters["packets"] == 1
        assert none.packets.count() == 0 and set(none.counters.values()) == {0}
        assert list(none.counters) == list(done.counters)
