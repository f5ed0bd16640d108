"""Structured Streaming jobs. Each has a batch twin in `operators`, and every sink is idempotent per batch.

Policies: event time is the order's or outcome's own timestamp; windows expire
after 70 minutes, pending orders after 30 days; rows behind the watermark go to a side table; a repeated
order id counts once.
"""
from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import PREPAID, STEP_UP
from ..operators.drift import EXPIRE_WINDOWS, KEEP_WINDOWS, WINDOW_SECONDS, window_aggregates

# the state processor travels with the job, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW_WATERMARK = f"{EXPIRE_WINDOWS * WINDOW_SECONDS // 60} minutes"
PENDING_DAYS = 30
RECENT_CAP = 40


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the shared checkpoints; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="parcelwise-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet stream over a table folder, or over a table that is one single file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append",
          available_now: bool = True, every: str = "30 seconds") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, off the heap; each remembers its provider."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    former = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if former is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, former)


def state_rows(query: StreamingQuery) -> int:
    """Rows that a query's state holds, over its operators, as of its last progress."""
    return sum(op.numRowsTotal for op in query.lastProgress.stateOperators) if query.lastProgress else 0


def batch_folder_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch owns one partition folder, so a replayed batch overwrites itself."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def latest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode sink."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, [*keys, "batch_id"]).drop("batch_id")


# ------------------------------------------------------------------ drift
def drift_window_stream(scored: DataFrame, ts: str = "ts") -> DataFrame:
    """Five-minute drift windows with expiry."""
    return (scored.withWatermark(ts, WINDOW_WATERMARK).groupBy(F.window(ts, f"{WINDOW_SECONDS} seconds").alias("w"))
            .agg(*window_aggregates()).select(F.floor(F.unix_seconds("w.start") / WINDOW_SECONDS).cast("bigint").alias("bucket"), "*")
            .drop("w"))


def rolling_hour_stream(scored: DataFrame, ts: str = "ts") -> DataFrame:
    """The last hour, every five minutes; `bucket` is the last five-minute bucket of the hour."""
    hour = WINDOW_SECONDS * KEEP_WINDOWS
    return (scored.withWatermark(ts, WINDOW_WATERMARK)
            .groupBy(F.window(ts, f"{hour} seconds", f"{WINDOW_SECONDS} seconds").alias("w")).agg(*window_aggregates())
            .select((F.floor(F.unix_seconds("w.end") / WINDOW_SECONDS) - 1).cast("bigint").alias("bucket"), "*").drop("w"))


# ------------------------------------------------------------------ orders and outcomes
def unique_orders(orders: DataFrame, ts: str = "ts", horizon: str = "1 day") -> DataFrame:
    """Orders with repeats of an order id inside the horizon removed."""
    return orders.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["order_id"])


def scoring_sink(gather: Callable[[DataFrame], DataFrame], decide: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Gather a micro-batch's orders, score and decide them with batch transforms and append them to the ledger."""
    write = batch_folder_sink(path)

    def score(df: DataFrame, batch_id: int) -> None:
        orders = gather(df).persist()  # several joins read these rows; without a copy each of them would run the stateful step again
        try:
            write(decide(orders), batch_id)
        finally:
            orders.unpersist()
    return score


def decisions_with_outcomes(decisions: DataFrame, outcomes: DataFrame, days: int = PENDING_DAYS) -> DataFrame:
    """Left outer stream join on order id; an order still open after `days` leaves with a NULL outcome.

    decisions(order_id, ts, ...), outcomes(order_id, outcome_ts, rto, stepup_result, prepaid_result).
    """
    d = decisions.withWatermark("ts", "1 day").alias("d")
    o = outcomes.withColumnRenamed("order_id", "o_order_id").withWatermark("outcome_ts", "1 day").alias("o")
    within = F.expr(f"o_order_id = order_id AND outcome_ts >= ts AND outcome_ts <= ts + INTERVAL {days} DAYS")
    return d.join(o, within, "leftOuter").drop("o_order_id")


def shipped(stepup_result: Column, prepaid_result: Column) -> Column:
    """An abandoned order never shipped, so it has no delivery outcome."""
    gone = lambda c: F.coalesce(c == "abandoned", F.lit(False))
    return ~gone(stepup_result) & ~gone(prepaid_result)


def response_observations(joined: DataFrame) -> DataFrame:
    """What the buyer-response sums learn from: the result of the intervention that was actually served."""
    result = (F.when(F.col("served_action") == STEP_UP, F.col("stepup_result"))
              .when(F.col("served_action") == PREPAID, F.col("prepaid_result")))
    paid_rto = F.when((F.col("served_action") == STEP_UP) & (F.col("stepup_result") == "paid"), F.col("rto"))
    attr = F.when(F.col("served_action") == STEP_UP, F.col("addr_attribution")).otherwise(0.0)
    return joined.withColumn("_r", result).filter(F.col("_r").isin("paid", "abandoned")).select(
        "segment", "served_action", "p", (F.col("_r") == "abandoned").alias("abandoned"), paid_rto.alias("rto"),
        attr.alias("addr_attribution"))


def outcome_router(deliveries: str, observations: str) -> Callable[[DataFrame, int], None]:
    """Deliveries go to the velocity and graph log, intervention results to the response log."""
    to_deliveries, to_observations = batch_folder_sink(deliveries), batch_folder_sink(observations)

    def route(df: DataFrame, batch_id: int) -> None:
        known = df.filter(F.col("rto").isNotNull())
        to_deliveries(known.filter(shipped(F.col("stepup_result"), F.col("prepaid_result"))), batch_id)
        to_observations(response_observations(known), batch_id)
    return route


def late_splitter(on_time: str, late: str, clock: str, delay_seconds: int, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """Rows older than the newest event of earlier batches minus the delay go to the side table.

    The newest event time per batch is kept in `clock`, keyed by batch, so a replay decides the same.
    """
    to_time, to_late, to_clock = batch_folder_sink(on_time), batch_folder_sink(late), batch_folder_sink(clock)

    def route(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        limit = None
        if batch_id > 0:
            limit = (spark.read.parquet(clock).filter(F.col("batch_id") < batch_id)
                     .agg((F.max("newest") - F.make_dt_interval(secs=F.lit(delay_seconds))).alias("l")).first()["l"])
        is_late = F.lit(False) if limit is None else F.col(ts) < F.lit(limit)
        df.persist()  # three writes, one read of the source
        try:
            to_time(df.filter(~is_late), batch_id)
            to_late(df.filter(is_late), batch_id)
            to_clock(df.agg(F.max(ts).cast("timestamp").alias("newest")), batch_id)
        finally:
            df.unpersist()
    return route


# ------------------------------------------------------------------ orders scored with what their entities did before
#: Look-back of the recent count by entity, in microseconds.
LOOK_BACK = {"phone": 30 * 86_400_000_000, "device": 86_400_000_000}
READ_SCHEMA = "seq long, entity string, n long, recent long, rto long, delivered long, gmv double, first_at long, links long"
#: Entity, column of its key, column of the related ids that it counts.
ENTITIES = (("phone", "phone", "device"), ("device", "device", "phone"), ("addr", "addr", "phone"), ("pin", "delivery_pin", None))

#: Groups that the keys of an entity are dealt into, and related ids that a key keeps in its own row of state.
KEY_GROUPS = 1024
OTHERS_IN_ROW = 1000

#: Events at hand when rows are packed, most rows of a pack, and rows of a group that are put in order at a time.
PACK_EVENTS = 400_000
PACK_ROWS = 512
RANGE_ROWS = 1_000_000
_PACKED = {"seq": np.int64, "at": np.int64, "kind": np.int8, "gmv": np.float64, "rto": np.int8, "key": np.int32, "other": np.int32}
PACK_SCHEMA = "entity string, group long, keys array<string>, others array<string>, " + ", ".join(f"{c} binary" for c in _PACKED)
# a missing time comes after all others; as a value it is the lowest
_LAST, _LOWEST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's text, texts by number)."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)


def _renumbered(codes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """As `_coded`, for a few of the rows."""
    there, codes = np.unique(codes, return_inverse=True)
    return codes.astype(np.int32), texts[there].tolist()


def _packs(events: pa.Table, groups: int) -> Iterator[pa.RecordBatch]:
    """Every event once for each entity, those of a group of keys together, in order of time and by columns."""
    at = events["at"].fill_null(_LAST).to_numpy()
    own = {"seq": events["seq"].to_numpy(), "at": at, "kind": events["kind"].to_numpy().astype(np.int8), "gmv": events["gmv"].fill_null(np.nan).to_numpy(),
           "rto": events["rto"].cast(pa.int8()).fill_null(-1).to_numpy()}
    coded = {c: _coded(events[c]) for _, c, _ in ENTITIES}
    texts = pa.list_(pa.string())
    types = {"entity": pa.string(), "group": pa.int64(), "keys": texts, "others": texts, **dict.fromkeys(_PACKED, pa.binary())}
    for entity, column, related in ENTITIES:
        codes, names = coded[column]
        group = (pd.util.hash_array(names) % np.uint64(groups)).astype(np.int64)[codes]
        order = np.lexsort((at, group))
        group, codes, rows = group[order], codes[order], {c: x[order] for c, x in own.items()}
        made = {c: [] for c in types}
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            for lo in range(start, end, PACK_ROWS):
                hi = min(lo + PACK_ROWS, end)
                key, keys = _renumbered(codes[lo:hi], names)
                other, others = _renumbered(coded[related][0][order[lo:hi]], coded[related][1]) if related else (np.zeros(0, np.int32), [])
                pack = {"entity": entity, "group": int(group[lo]), "keys": keys, "others": others, **{c: x[lo:hi].tobytes() for c, x in rows.items()},
                        "key": key.tobytes(), "other": other.tobytes()}
                for c, x in pack.items():
                    made[c].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(made[c], t) for c, t in types.items()], list(types))


def packed(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Packs of a task's events, made of `PACK_EVENTS` at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PACK_EVENTS:
            yield from _packs(pa.Table.from_batches(held), groups)
            held, rows = [], 0
    if rows:
        yield from _packs(pa.Table.from_batches(held), groups)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in _PACKED}


def _blocks(packs: Iterator[pd.DataFrame], names: dict[str, int], ids: dict[str, int]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of packs in blocks that are in order of time. Keys are numbered in `names`, related ids in `ids`."""
    def block(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        rows = _joined(parts)
        order = np.argsort(rows["at"], kind="stable")
        return {c: x[order] if len(x) else x for c, x in rows.items()}

    held, n = [], 0
    for pdf in packs:
        for p in pdf.itertuples(index=False):
            rows = {c: np.frombuffer(getattr(p, c), t) for c, t in _PACKED.items()}
            for c, texts, numbers in (("key", p.keys, names), ("other", p.others, ids)):
                if len(texts):
                    rows[c] = np.array([numbers.setdefault(x, len(numbers)) for x in texts], np.int32)[rows[c]]
            held.append(rows)
            n += len(rows["seq"])
            if n >= RANGE_ROWS:
                yield block(held)
                held, n = [], 0
    if held:
        yield block(held)


def _ranges(blocks: list[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of all blocks by ranges of time, each of about `RANGE_ROWS`; rows of one moment stay together."""
    if len(blocks) == 1:
        yield blocks[0]
        return
    step = max(1, RANGE_ROWS // 64)
    times = np.sort(np.concatenate([b["at"][::step] for b in blocks]))
    each = max(1, RANGE_ROWS // step)
    begun = [0] * len(blocks)
    for cut in [*np.unique(times[each::each]).tolist(), None]:
        ends = [len(b["at"]) if cut is None else int(np.searchsorted(b["at"], cut)) for b in blocks]
        if ends != begun:
            yield _joined([{c: x[lo:hi] for c, x in b.items()} for b, lo, hi in zip(blocks, begun, ends, strict=True)])
        begun = ends


class _Known:
    """What a key has done so far."""

    def __init__(self, row: tuple | None):
        self.orders, self.rto, self.delivered, self.gmv, self.first, self.links, recent, others = row or (0, 0, 0, 0.0, None, 0, b"", [])
        self.recent, self.others, self.met, self.added = np.frombuffer(recent, np.int64), list(others), set(others), 0.0

    def row(self) -> tuple:
        return (self.orders, self.rto, self.delivered, self.gmv + self.added, self.first, self.links, self.recent.tobytes(), self.others)


class EntityReads(StatefulProcessor):
    """For each order of one (entity, key): what the entity had done just before it. Then the order and its outcome are taken in.

    Rows of a micro-batch are taken in event order, batches as they come. Keys come in groups and their rows in packs, so that
    frames, reads and writes are not paid for by every row and short key. A micro-batch's rows of one group are held at once, as
    plain numbers, so the trigger's size bounds them; they are put in order by ranges of time. Between batches a key has one row,
    off the heap: its counts, the 40 latest times and the first related ids. Further ids have rows of their own and are looked up
    one by one.
    """

    def __init__(self, in_row: int = OTHERS_IN_ROW):
        self.in_row = in_row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "key string", "orders long, rto long, delivered long, gmv double, first_at long, links long, "
                                                              "recent binary, others array<string>")
        self.more = handle.getMapState("more", "key string, other string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, ids = {}, {}
        blocks = list(_blocks(rows, names, ids))
        any_known, texts = self.known.exists(), list(ids)
        known = [(name, _Known(self.known.getValue((name,)) if any_known else None)) for name in names]
        for part in _ranges(blocks):
            reads = self._taken_in(key[0], part, known, texts)
            if len(reads):
                yield reads
        for name, now in known:
            self.known.updateValue((name,), now.row())

    def _taken_in(self, entity: str, part: dict[str, np.ndarray], known: list[tuple[str, _Known]], texts: list[str]) -> pd.DataFrame:
        order = np.lexsort((part["seq"], part["kind"], part["at"], part["key"]))
        keys, at, kind, rto, gmv = (part[c][order] for c in ("key", "at", "kind", "rto", "gmv"))
        at = np.where(at == _LAST, _LOWEST, at)
        placed = kind == 0
        bad, good = ((kind == 1) & (rto == 1), (kind == 1) & (rto == 0))
        gmv = np.where(placed, gmv, 0.0)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        fresh = self._new_links(part, order, keys, placed, known, texts)
        recent, sums = np.zeros(len(keys), np.int64), np.zeros(len(keys))
        here = [known[k][1] for k in keys[starts]]
        orders, returned, delivered, links = (np.array([getattr(now, c) for now in here], np.int64) for c in ("orders", "rto", "delivered", "links"))
        for lo, hi, now in zip(starts.tolist(), ends.tolist(), here, strict=True):
            mine = placed[lo:hi]
            new = at[lo:hi][mine]
            times = np.concatenate([now.recent, new])
            if entity in LOOK_BACK:
                index = len(now.recent) + np.arange(len(new))
                recent[lo:hi][mine] = np.minimum(RECENT_CAP, index - np.searchsorted(times, new - LOOK_BACK[entity], "left"))
            if now.first is None and len(new):
                now.first = int(new[0])
            own = gmv[lo:hi]
            added = np.cumsum(np.concatenate([[now.added], own]))[1:]
            sums[lo:hi] = now.gmv + (added - own)
            now.added = float(added[-1])
            times.sort()
            now.recent = times[-RECENT_CAP:]

        def before(x: np.ndarray, had: np.ndarray) -> np.ndarray:
            """Running counts within each key, from what it had."""
            total = np.cumsum(x)
            first = total[starts] - x[starts]
            return (total - x + np.repeat(had - first, ends - starts))[placed]

        counted = {"orders": (placed, orders), "rto": (bad, returned), "delivered": (good, delivered), "links": (fresh, links)}
        counted = {c: (x.astype(np.int64), had) for c, (x, had) in counted.items()}
        n = before(*counted["orders"])
        first = np.repeat(np.array([now.first or 0 for now in here], np.int64), ends - starts)[placed]
        reads = pd.DataFrame({"seq": part["seq"][order][placed], "entity": entity, "n": n, "recent": recent[placed], "rto": before(*counted["rto"]),
                              "delivered": before(*counted["delivered"]), "gmv": sums[placed], "first_at": pd.arrays.IntegerArray(first, n == 0), "links": before(*counted["links"])})
        for c, (x, had) in counted.items():
            for now, total in zip(here, (had + np.add.reduceat(x, starts)).tolist(), strict=True):
                setattr(now, c, total)
        return reads

    def _new_links(self, part: dict[str, np.ndarray], order: np.ndarray, keys: np.ndarray, placed: np.ndarray, known: list[tuple[str, _Known]],
                   texts: list[str]) -> np.ndarray:
        """Which of the sorted rows bring their key a related id for the first time."""
        fresh = np.zeros(len(keys), bool)
        if not texts:
            return fresh
        other, named = part["other"][order], np.flatnonzero(placed)
        # only the first row of each pair can be a new link
        pairs = keys[named].astype(np.int64) * len(texts) + other[named]
        for i in named[np.sort(np.unique(pairs, return_index=True)[1])].tolist():
            (name, now), o = known[keys[i]], texts[other[i]]
            if o in now.met:
                continue
            now.met.add(o)
            if len(now.others) < self.in_row:
                now.others.append(o)
            elif self.more.containsKey((name, o)):
                continue
            else:
                self.more.updateValue((name, o), (True,))
            fresh[i] = True
        return fresh

    def close(self) -> None:
        pass


def read_events(placed: DataFrame, resolved: DataFrame, payload: list[str]) -> DataFrame:
    """Events for `entity_reads_stream` and `with_orders` from a stream of orders and one of outcomes.

    Both carry seq, phone, device, addr and delivery_pin; orders (ts, cart_gmv), outcomes (ts, rto). Orders take their columns in
    `payload` along.
    """
    body = F.struct(*payload)

    def rows(df: DataFrame, kind: int, gmv: Column, rto: Column, own: Column) -> DataFrame:
        keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for _, c, _ in ENTITIES]
        return df.select("seq", F.lit(kind).alias("kind"), F.unix_micros("ts").alias("at"), gmv.cast("double").alias("gmv"), rto.cast("boolean").alias("rto"), *keys,
                         own.alias("payload"))

    none = F.lit(None)
    return rows(placed, 0, F.col("cart_gmv"), none, body).unionByName(rows(resolved, 1, none, F.col("rto"), none.cast(placed.select(body.alias("p")).schema["p"].dataType)))


def entity_reads_stream(events: DataFrame, *, in_row: int = OTHERS_IN_ROW) -> DataFrame:
    """A row for each order and entity with what was known before. Needs the RocksDB state store."""
    groups = KEY_GROUPS
    packs = events.drop("payload").mapInArrow(lambda batches: packed(batches, groups), PACK_SCHEMA)
    return packs.groupBy("entity", "group").transformWithStateInPandas(
        statefulProcessor=EntityReads(in_row), outputStructType=READ_SCHEMA, outputMode="Append", timeMode="None")


def with_orders(reads: DataFrame, events: DataFrame) -> DataFrame:
    """Reads, and the orders' payloads as rows of their own: those pass by the state."""
    return reads.unionByName(events.filter("kind = 0").select("seq", F.lit("order").alias("entity"), "payload"), allowMissingColumns=True)


#: Columns that `pit.velocity_columns` takes, by the read column they come from.
_COUNTS = {"n": {"phone": "phone_orders_total", "pin": "pin_orders"}, "recent": {"phone": "_phone_recent", "device": "_device_recent"},
           "rto": {e: f"_{e}_rto" for e, _, _ in ENTITIES}, "delivered": {e: f"_{e}_del" for e, _, _ in ENTITIES}, "gmv": {"pin": "_pin_gmv"},
           "first_at": {"phone": "_phone_first"},
           "links": {"phone": "phone_distinct_devices", "device": "device_distinct_phones", "addr": "addr_distinct_phones"}}


def order_rows(reads: DataFrame) -> DataFrame:
    """One row for each order of a micro-batch of `with_orders`: its payload and the counts of its entities, by seq."""
    # an order's reads come from several tasks, so they go to it as they are; a number that no count takes is not sent
    narrow = reads.select("seq", "entity", "payload", *[F.when(F.col("entity").isin(*of), F.col(c)).alias(c) for c, of in _COUNTS.items()]).repartition("seq")
    counts = [F.max(F.when(F.col("entity") == e, F.col(c))).alias(name) for c, of in _COUNTS.items() for e, name in of.items()]
    wide = narrow.groupBy("seq").agg(F.max("payload").alias("_o"), *counts)
    return wide.select("seq", "_o.*", *[F.timestamp_micros(n).alias(n) if n == "_phone_first" else F.col(n) for of in _COUNTS.values() for n in of.values()])


def order_reads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(orders, counts per order as `pit.velocity_columns` takes them) of `order_rows`."""
    counts = [n for of in _COUNTS.values() for n in of.values()]
    return rows.drop(*counts), rows.select("order_id", "seq", "ts", "delivery_pin", *counts)


# ------------------------------------------------------------------ pending orders, bounded by count
PENDING_SCHEMA = "range long, order_id string, fate string, rto boolean, payload string"
MAX_PENDING = 50_000


class PendingOrders(StatefulProcessor):
    """Orders of one key range that wait for their outcome, at most `limit` of them: the oldest still unclaimed goes first.

    Emits an order with its outcome, an order that is evicted, and an outcome whose order is not (or no longer) known. An order that
    comes again moves to the end. The state of a range is at most `limit` rows, read and written once for each micro-batch.
    """

    def __init__(self, limit: int = MAX_PENDING):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "order_id string, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = dict(self.open.get()) if self.open.exists() else {}  # a dict keeps the order of arrival
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "kind", "seq"], kind="stable").itertuples(index=False):
            if r.kind == 0:
                waiting.pop(r.order_id, None)
                waiting[r.order_id] = r.payload
                if len(waiting) > self.limit:
                    oldest = next(iter(waiting))
                    out.append((oldest, "evicted", None, waiting.pop(oldest)))
            elif r.order_id in waiting:
                out.append((r.order_id, "outcome", r.rto, waiting.pop(r.order_id)))
            else:
                out.append((r.order_id, "unknown", r.rto, None))
        if waiting:
            self.open.put(list(waiting.items()))
        else:
            self.open.clear()
        if out:
            pdf = pd.DataFrame(out, columns=["order_id", "fate", "rto", "payload"])
            pdf.insert(0, "range", key[0])
            pdf["rto"] = pdf["rto"].astype("boolean")
            yield pdf

    def close(self) -> None:
        pass


def pending_stream(events: DataFrame, limit: int = MAX_PENDING) -> DataFrame:
    """Fates of orders, from a stream of (range, order_id, kind 0 order or 1 outcome, at micros, seq, rto, payload)."""
    return events.groupBy("range").transformWithStateInPandas(
        statefulProcessor=PendingOrders(limit), outputStructType=PENDING_SCHEMA, outputMode="Append", timeMode="None")


# ------------------------------------------------------------------ entity state
_SUMS = ("orders", "rto", "delivered", "gmv")


def entity_events(events: DataFrame) -> DataFrame:
    """Orders (kind 0) and outcomes (kind 1) per entity: entity, key, kind, ts seconds, gmv, rto, other.

    events: order_id, kind, ts, phone, device, addr, delivery_pin, cart_gmv, rto.
    """
    def of(entity: str, c: str, other: str | None) -> Column:
        return F.struct(F.lit(entity).alias("entity"), F.coalesce(F.col(c), F.lit("")).alias("key"),
                        (F.col(other) if other else F.lit(None)).cast("string").alias("other"))
    rows = F.inline(F.array(of("phone", "phone", "device"), of("device", "device", "phone"), of("addr", "addr", "phone"),
                            of("pin", "delivery_pin", None)))
    return events.select("kind", (F.unix_micros("ts") / 1e6).alias("ts"), F.col("cart_gmv").alias("gmv"), "rto", rows)


def entity_delta(events: DataFrame) -> DataFrame:
    """What a batch of events adds to the state of its entities.

    Counts are summed before the shuffle, times are limited to the 40 latest of a key before it, related ids made distinct before it:
    however many of a batch's events one key has, a task hands on one row, 40 times and its distinct ids.
    """
    rows = entity_events(events)
    placed, done = F.col("kind") == 0, F.col("kind") == 1
    sums = rows.groupBy("entity", "key").agg(
        F.count_if(placed).alias("orders"), F.count_if(done & F.col("rto")).alias("rto"), F.count_if(done & ~F.col("rto")).alias("delivered"),
        F.coalesce(F.sum(F.when(placed, F.col("gmv"))), F.lit(0.0)).alias("gmv"), F.min(F.when(placed, F.col("ts"))).alias("first_ts"),
        F.max(F.when(placed, F.col("ts"))).alias("last_ts"))
    latest = Window.partitionBy("entity", "key").orderBy(F.desc("ts"))
    recent = (rows.filter(placed).select("entity", "key", "ts").withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= RECENT_CAP)
              .groupBy("entity", "key").agg(F.sort_array(F.collect_list("ts"), asc=False).alias("recent")))
    links = rows.filter(placed & F.col("other").isNotNull()).select("entity", "key", "other").distinct()
    return sums.join(recent, ["entity", "key"], "left").unionByName(links, allowMissingColumns=True)


def merge_entity_rows(rows: DataFrame) -> DataFrame:
    """Rows of several deltas as one delta."""
    sums = rows.filter(F.col("other").isNull()).groupBy("entity", "key").agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        # 40 times from each part that is left
        F.slice(F.sort_array(F.flatten(F.collect_list("recent")), asc=False), 1, RECENT_CAP).alias("recent"))
    links = rows.filter(F.col("other").isNotNull()).select("entity", "key", "other").distinct()
    return sums.unionByName(links, allowMissingColumns=True)


def entity_states(rows: DataFrame) -> DataFrame:
    """One row for each entity of a merged state."""
    distinct = rows.filter(F.col("other").isNotNull()).groupBy("entity", "key").agg(F.count(F.lit(1)).alias("distinct_others"))
    own = rows.filter(F.col("other").isNull()).drop("other")
    own = own.withColumn("recent", F.coalesce("recent", F.array().cast("array<double>")))
    return own.join(distinct, ["entity", "key"], "left").na.fill(0, ["distinct_others"])
