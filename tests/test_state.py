"""Versioned state: replays, lost races, left-overs, rewriting; streams in several batches equal those in one."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelwise.sources.state_table import StateTable
from parcelwise.streaming import jobs as J


def total(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def values(df):
    return {r["k"]: r["n"] for r in df.collect()}


def delta(spark, **kn):
    return spark.createDataFrame(list(kn.items()), "k string, n long")


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    t = StateTable(spark, str(tmp_path), total)
    assert t.read() is None and t.head()["version"] == 0
    assert t.commit(delta(spark, a=1, b=2), "x", 0) == 1
    assert t.commit(delta(spark, a=10), "x", 1) == 2
    assert t.commit(delta(spark, a=10), "x", 1) == 2 and t.commit(delta(spark, a=99), "x", 0) == 2
    assert t.commit(delta(spark, a=100), "y", 0) == 3
    assert values(t.read()) == {"a": 111, "b": 2}


def test_the_loser_of_a_race_adds_to_the_winners_version(spark, tmp_path):
    one, two = StateTable(spark, str(tmp_path), total), StateTable(spark, str(tmp_path), total)
    stale = one.head()
    two.commit(delta(spark, a=1), "two", 0)
    found, one_head = [], one.head
    one.head = lambda: found.append(1) or (stale if len(found) == 1 else one_head())
    assert one.commit(delta(spark, a=2), "one", 0) == 2 and len(found) == 2
    assert values(two.read()) == {"a": 3}


def test_parts_are_rewritten_and_left_overs_never_read(spark, tmp_path):
    t = StateTable(spark, str(tmp_path), total, max_parts=3)
    for i in range(8):
        t.commit(delta(spark, a=1, **{f"k{i}": i}), "x", i)
    assert len(t.head()["parts"]) <= 3 and values(t.read())["a"] == 8
    old = t.read({"version": 0, "parts": t._manifest(2)["parts"], "applied": {}})
    assert values(old)["a"] == 2  # an older version stays readable
    t._write(delta(spark, a=1000))
    (tmp_path / "versions" / f"{99:012d}.json").write_text('{"version": 99, "par')
    assert values(t.read())["a"] == 8



def sample(n):
    ts = [pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=17 * i) for i in range(n)]
    return [(f"o{i}", i, int(i % 3 == 2), ts[i].to_pydatetime(), f"p{i % 4}" if i % 5 else None, f"d{i % 6}", f"a{i % 3}", "110001", float(i), bool(i % 2)) for i in range(n)]


@pytest.mark.parametrize("cuts", [[60], [7, 30, 60], [1, 2, 3, 60]])
def test_entity_deltas_add_up(spark, tmp_path, cuts):
    rows, state = sample(60), StateTable(spark, str(tmp_path / "state"), J.merge_entity_rows, max_parts=2)
    schema = "order_id string, seq long, kind int, ts timestamp, phone string, device string, addr string, delivery_pin string, cart_gmv double, rto boolean"
    for i, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
        state.commit(J.entity_delta(spark.createDataFrame(rows[a:b], schema)), "s", i)
    got = {(r["entity"], r["key"]): r for r in J.entity_states(state.read()).collect()}
    assert len(got) == 5 + 6 + 3 + 1
    for (entity, key), r in got.items():
        col = {"phone": 4, "device": 5, "addr": 6, "pin": 7}[entity]
        mine = [x for x in rows if (x[col] or "") == key]
        placed = [x for x in mine if x[2] == 0]
        others = {x[5] if entity == "phone" else x[4] for x in placed} - {None} if entity != "pin" else set()
        assert (r["orders"], r["rto"], r["delivered"]) == (len(placed), sum(x[9] for x in mine if x[2]), sum(not x[9] for x in mine if x[2]))
        assert r["gmv"] == sum(x[8] for x in placed) and r["distinct_others"] == len(others)
        assert len(r["recent"]) == min(40, len(placed)) and (not placed or r["recent"][0] == placed[-1][3].timestamp())


def reads(spark, tmp_path, name, parts, **how):
    """Entity reads of a stream over `parts`, one micro-batch each."""
    src = tmp_path / f"{name}-in"
    schema = "order_id string, seq long, ts timestamp, phone string, device string, addr string, delivery_pin string, cart_gmv double, rto boolean, kind int"
    for i, part in enumerate(parts):
        rows = [(r[0], r[1], r[3], r[4], r[5], r[6], r[7], r[8], r[9], r[2]) for r in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    with J.state_in_rocksdb(spark):
        made = J.entity_reads_stream(J.read_events(stream.filter("kind = 0"), stream.filter("kind = 1"), ["order_id"]), **how)
        J.start(made, J.batch_folder_sink(str(tmp_path / f"{name}-out")), str(tmp_path / f"{name}-ckpt")).awaitTermination()
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_reads_see_what_came_before(spark, tmp_path):
    rows = sample(45)
    got = {(r["seq"], r["entity"]): r for r in reads(spark, tmp_path, "one", [rows]).collect()}
    assert len(got) == 4 * sum(r[2] == 0 for r in rows)
    for (seq, entity), r in got.items():
        col = {"phone": 4, "device": 5, "addr": 6, "pin": 7}[entity]
        me = rows[seq]
        past = [x for x in rows[:seq] if (x[col] or "") == (me[col] or "")]
        placed = [x for x in past if x[2] == 0]
        others = {(x[5] if entity == "phone" else x[4]) or "" for x in placed} if entity != "pin" else set()
        assert (r["n"], r["rto"], r["delivered"]) == (len(placed), sum(x[9] for x in past if x[2]), sum(not x[9] for x in past if x[2]))
        assert r["links"] == len(others) and r["gmv"] == sum(x[8] for x in placed)
        back = {"phone": 30 * 86400, "device": 86400}.get(entity)
        assert r["recent"] == (min(40, sum((me[3] - x[3]).total_seconds() <= back for x in placed)) if back else 0)
        assert (r["first_at"] is None) == (not placed) and (not placed or r["first_at"] == int(placed[0][3].timestamp() * 1e6))

def test_a_group_of_keys_keeps_them_apart(spark, tmp_path, monkeypatch):
    """All keys in one group of state, related ids beyond those in a key's row: the same reads in one batch as in many."""
    monkeypatch.setattr(J, "KEY_GROUPS", 1)
    rows = sample(60)
    want = sorted(map(repr, reads(spark, tmp_path, "whole", [rows]).drop("batch_id").collect()))
    cut = reads(spark, tmp_path, "cut", [rows[:20], rows[20:21], rows[21:]], in_row=1)
    assert sorted(map(repr, cut.drop("batch_id").collect())) == want


def test_rows_in_small_packs_and_ranges_read_the_same(spark, tmp_path, monkeypatch):
    """Packs of a few rows and ranges of a few moments, moments that many rows share, a missing time, a missing amount."""
    rows = [list(r) for r in sample(60)]
    for i in range(20, 32):
        rows[i][3] = rows[20][3]
    rows[40][3], rows[41][8] = None, None
    want = sorted(map(repr, reads(spark, tmp_path, "whole", [rows]).drop("batch_id").collect()))
    for name, n in (("PACK_EVENTS", 9), ("PACK_ROWS", 2), ("RANGE_ROWS", 5), ("KEY_GROUPS", 2)):
        monkeypatch.setattr(J, name, n)
    assert sorted(map(repr, reads(spark, tmp_path, "cut", [rows]).drop("batch_id").collect())) == want


def test_events_go_to_the_state_in_packs(spark):
    """Rows that are shuffled and sorted for the state: a few packs of numbers, without the order's own columns."""
    rows = spark.range(2000).select(
        F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), *[F.concat(F.lit(c), F.col("id") % 5).alias(c) for c in ("phone", "device", "addr")],
        F.lit("110001").alias("delivery_pin"), F.lit(1.5).alias("cart_gmv"), F.lit(True).alias("rto"), F.lit("x" * 1000).alias("shipping_address")).coalesce(1)
    events = J.read_events(rows, rows, ["shipping_address"])
    table = events.drop("payload").toArrow()
    packs = list(J.packed(iter(table.to_batches()), J.KEY_GROUPS))
    assert table.num_rows == 4000 and sum(p.num_rows for p in packs) <= 3 * 5 * (4000 // J.PACK_ROWS + 1) + 4000 // J.PACK_ROWS + 1
    assert sum(p.nbytes for p in packs) < 40 * 4 * 4000
    at = [pd.Series(memoryview(b["at"][i].as_py()).cast("q")) for b in packs for i in range(b.num_rows)]
    assert sum(map(len, at)) == 4 * 4000 and all(x.is_monotonic_increasing for x in at)
    assert J.with_orders(events.select("seq", F.lit("phone").alias("entity")), events).filter("payload is not null").count() == 2000


def fates(spark, tmp_path, name, rows, limit):
    schema = "range long, order_id string, kind int, at long, seq long, rto boolean, payload string"
    src = str(tmp_path / f"{name}-in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    with J.state_in_rocksdb(spark):
        J.start(J.pending_stream(stream, limit), J.batch_folder_sink(str(tmp_path / f"{name}-out")), str(tmp_path / f"{name}-ckpt")).awaitTermination()
    return sorted((r["order_id"], r["fate"], r["rto"]) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect())


def test_the_oldest_unclaimed_order_goes_first(spark, tmp_path):
    order = lambda o, at: (0, o, 0, at, at, None, "x")
    done = lambda o, at, rto: (0, o, 1, at, at, rto, None)
    rows = [order("a", 1), order("b", 2), done("a", 3, True), order("c", 4), order("d", 5), order("b", 6), order("e", 7), done("b", 8, False), done("c", 9, True)]
    # a is claimed; d makes three open (b, c, d), b comes again, e pushes c out
    assert fates(spark, tmp_path, "few", [rows], 3) == [("a", "outcome", True), ("b", "outcome", False), ("c", "evicted", None), ("c", "unknown", True)]
    assert fates(spark, tmp_path, "none", [[order("a", 1), done("a", 2, None)]], 3) == [("a", "outcome", None)]
