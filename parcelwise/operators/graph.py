"""Entity graph: nodes, edges, guarded components, ring statistics and point-in-time ring features."""
from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HOT_KEY_ROWS
from ..functions.text import node_id
from ..session import cut_lineage, set_down
from .components import component_history, connected_components, first_k, named_labels
from .running import hot_keys, running_by_key

# Node kinds in the order an order lists them, merge rules and ring rules.
ALL_KINDS = ("phone", "device", "addr", "vpa", "card", "ip")
KINDS = ("phone", "device", "addr", "vpa", "ip")  # kinds of sources without cards
HARD_KINDS = ("phone", "device", "vpa", "card")
ADDR_MERGE_CEILING = 6
ADDR_PUBLIC_CEILING = 25
SHARED_DEGREE_CEILING = 50
RING_MIN_PHONES = 3
RING_PHONE_RATIO = 2.5
RING_ADDR_RTO_MIN = 0.45
RING_ADDR_MIN_OUTCOMES = 5


def hashed_orders(orders: DataFrame, kinds: tuple[str, ...] = KINDS, of: Column | None = None) -> DataFrame:
    """One row per order: its node id per kind (NULL where the identifier is empty), outcome and amount.

    `of` marks in a column `asked` the orders whose ring features are wanted; without it all are.
    """
    asked = [] if of is None else [F.coalesce(of, F.lit(False)).alias("asked")]
    return orders.select("order_id", "seq", "ts", "outcome_ts", "rto", "cart_gmv", *asked,
                         *[node_id(k, F.col(k)).alias(k) for k in kinds])


def kind_of(node: Column) -> Column:
    return F.substring_index(node, ":", 1)


def kinds_in(hashed: DataFrame) -> list[str]:
    return [k for k in ALL_KINDS if k in hashed.columns]


def order_entities(hashed: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(order_id, seq, ts, kind, node) rows; empty identifiers are dropped."""
    kinds = kinds or kinds_in(hashed)
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("node")) for k in kinds])
    return (hashed.select("order_id", "seq", "ts", F.inline(pairs)).filter(F.col("node").isNotNull()))


def _pair_rows(hashed: DataFrame, pairs: list[tuple[str, str]], a: str, b: str) -> DataFrame:
    """First moment each listed pair of nodes shared an order."""
    structs = F.array(*[F.struct(F.col(x).alias(a), F.col(y).alias(b)) for x, y in pairs])
    rows = hashed.select("ts", "seq", F.inline(structs)).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return (rows.groupBy(a, b).agg(F.min(F.struct("ts", "seq")).alias("_f"))
            .select(a, b, F.col("_f.ts").alias("ts"), F.col("_f.seq").alias("seq")))


def edge_list(hashed: DataFrame) -> DataFrame:
    """Undirected edges (a < b) with the first order that made them; at most fifteen pairs per order."""
    present = kinds_in(hashed)
    pairs = [(x, y) for i, x in enumerate(present) for y in present[i + 1:]]
    found = _pair_rows(hashed, pairs, "x", "y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ts", "seq")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), *[c for c in edges.columns if c not in "ab"]) \
        .unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"),
                                  *[c for c in edges.columns if c not in "ab"]))


def node_degrees(edges: DataFrame, kind: Callable[[Column], Column] = kind_of) -> DataFrame:
    """Distinct neighbours and distinct phone neighbours per node."""
    return both_ways(edges.select("a", "b")).groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"), F.count_if(kind(F.col("other")) == "phone").alias("phones"))


def non_bridging(degrees: DataFrame, ceiling: int = ADDR_MERGE_CEILING) -> DataFrame:
    return degrees.filter((kind_of(F.col("node")) == "addr") & (F.col("phones") >= ceiling))


def is_shared(node: Column, degree: Column, phones: Column) -> Column:
    kind = kind_of(node)
    public = (kind == "addr") & (phones >= ADDR_PUBLIC_CEILING)
    return ~kind.isin(*HARD_KINDS) & (public | (degree >= SHARED_DEGREE_CEILING))


def shared_entities(degrees: DataFrame) -> DataFrame:
    return degrees.filter(is_shared(F.col("node"), F.col("degree"), F.col("phones")))


def closed_addresses(hashed: DataFrame, ceiling: int = ADDR_MERGE_CEILING) -> DataFrame:
    """(addr, closed): the order, as (ts, seq), from which an address is not bridged: its `ceiling`-th distinct phone's first."""
    residents = _pair_rows(hashed, [("phone", "addr")], "a", "b")
    return (first_k(residents, ["b"], ["ts", "seq"], ceiling).groupBy(F.col("b").alias("addr"))
            .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("ts", "seq")).alias("closed")).filter(F.col("_n") == ceiling).drop("_n"))


def with_hub(hashed: DataFrame, *, guard: bool = True, ceiling: int = ADDR_MERGE_CEILING) -> DataFrame:
    """Add `hub`, the first of an order's nodes that may merge then (its first node if none may), `head`, its first node, and
    `bridge`, its address where that may merge.

    An order with a phone has it as hub. Only orders without one ask whether their address was still open at their moment.
    """
    kinds = kinds_in(hashed)
    head = F.coalesce(*[F.col(k) for k in kinds])
    known = hashed.filter(F.col("phone").isNotNull()).withColumns({"hub": F.col("phone"), "head": F.col("phone"), "bridge": F.lit(None).cast(hashed.schema["phone"].dataType)})
    rest = hashed.filter(F.col("phone").isNull())
    if guard:
        rest = rest.join(closed_addresses(hashed, ceiling), "addr", "left")
        rest = rest.withColumn("bridge", F.when(F.col("closed").isNull() | (F.struct("ts", "seq") < F.col("closed")), F.col("addr"))).drop("closed")
        may = [F.col("bridge") if k == "addr" else F.col(k) for k in kinds if k in HARD_KINDS or k == "addr"]
        rest = rest.withColumns({"hub": F.coalesce(*may, head), "head": head})
    else:
        rest = rest.withColumns({"hub": head, "head": head, "bridge": F.col("addr")})
    return known.unionByName(rest.select(*known.columns))


def merge_edges(hashed: DataFrame, *, guard: bool = True, ceiling: int = ADDR_MERGE_CEILING) -> DataFrame:
    """Star edges (a, b, ts, seq) from each order's hub to every node it may merge with.

    The hub is the phone, or the first node that may merge where there is none. An address merges with the first `ceiling - 1`
    distinct phones seen at it, and until then with orders without a phone: the phone that brings the count to the ceiling, and
    everyone after, is not bridged. Without the guard every node merges.
    """
    kinds = kinds_in(hashed)
    rest = with_hub(hashed, guard=guard, ceiling=ceiling).filter(F.col("phone").isNull()).filter(F.col("hub").isNotNull())
    if not guard:
        known = _pair_rows(hashed, [("phone", k) for k in kinds if k != "phone"], "a", "b")
        return known.unionByName(_stars(rest, [k for k in kinds if k != "phone"]))
    hard = _pair_rows(hashed, [("phone", k) for k in kinds if k in HARD_KINDS and k != "phone"], "a", "b")
    residents = _pair_rows(hashed, [("phone", "addr")], "a", "b")
    known = hard.unionByName(first_k(residents, ["b"], ["ts", "seq"], ceiling - 1))
    return known.unionByName(_stars(rest, ["bridge" if k == "addr" else k for k in kinds if (k in HARD_KINDS or k == "addr") and k != "phone"]))


def _stars(rows: DataFrame, ends: list[str]) -> DataFrame:
    return _pair_rows(rows, [("hub", c) for c in ends], "a", "b").filter("a <> b")


def node_table(hashed: DataFrame) -> DataFrame:
    """(node, ts, seq): every node and the order that first showed it."""
    return (order_entities(hashed).groupBy("node").agg(F.min(F.struct("ts", "seq")).alias("_f"))
            .select("node", "_f.ts", "_f.seq"))


def components(hashed: DataFrame, *, guard: bool = True, ceiling: int = ADDR_MERGE_CEILING) -> DataFrame:
    """(node, component) after the last order."""
    nodes = order_entities(hashed).select("node").distinct()
    return connected_components(nodes, merge_edges(hashed, guard=guard, ceiling=ceiling).select("a", "b"))


def ring_predicate(phones: Column, devices: Column, addrs: Column, rto: Column, delivered: Column) -> Column:
    one = F.lit(1)
    n = rto + delivered
    by_device = phones / F.greatest(one, devices) >= RING_PHONE_RATIO
    by_address = ((phones / F.greatest(one, addrs) >= RING_PHONE_RATIO) & (n >= RING_ADDR_MIN_OUTCOMES)
                  & (rto / F.greatest(one, n) >= RING_ADDR_RTO_MIN))
    return (phones >= RING_MIN_PHONES) & (by_device | by_address)


def rto_rate(rto: Column, delivered: Column) -> Column:
    return F.coalesce(F.try_divide(rto, rto + delivered), F.lit(0.0))


def ring_statistics(hashed: DataFrame, comps: DataFrame, *, guard: bool = True, ceiling: int = ADDR_MERGE_CEILING,
                    kind: Callable[[Column], Column] = kind_of) -> DataFrame:
    """One row per component. An order is booked to the component of its hub, its outcome to that of its first node."""
    kind = kind(F.col("node"))
    sizes = comps.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(kind == "phone").alias("phones"),
        F.count_if(kind == "device").alias("devices"), F.count_if(kind == "addr").alias("addrs"))
    # pre-aggregate per node, so the join carries one row per node
    zero, one = F.lit(0), F.lit(1)
    two = F.array(F.struct(F.col("hub").alias("node"), one.alias("orders"), F.col("cart_gmv").alias("gmv"), zero.alias("rto"), zero.alias("delivered")),
                  F.struct(F.col("head").alias("node"), zero.alias("orders"), F.lit(0.0).alias("gmv"),
                           F.when(F.col("rto"), 1).otherwise(0).alias("rto"), F.when(~F.col("rto"), 1).otherwise(0).alias("delivered")))
    by_node = with_hub(hashed, guard=guard, ceiling=ceiling).select(F.inline(two)).filter(F.col("node").isNotNull()).groupBy("node").agg(
        *[F.sum(c).alias(c) for c in ("orders", "rto", "delivered", "gmv")])
    booked = by_node.join(comps, "node").groupBy("component").agg(
        *[F.sum(c).alias(c) for c in ("orders", "rto", "delivered", "gmv")])
    out = sizes.join(booked, "component", "left").na.fill(0, ["orders", "rto", "delivered"]).na.fill(0.0, ["gmv"])
    return out.withColumns({
        "rto_rate": rto_rate(F.col("rto"), F.col("delivered")),
        "is_ring": ring_predicate(*[F.col(c) for c in ("phones", "devices", "addrs", "rto", "delivered")])})


def top_rings(stats: DataFrame, k: int = 50) -> DataFrame:
    """Worst rings by returned volume, then by phones."""
    return (stats.filter("is_ring").withColumn("weight", F.round("rto_rate", 4) * F.col("orders"))
            .orderBy(F.desc("weight"), F.desc("phones"), "component").limit(k))


def graph_summary(stats: DataFrame, degrees: DataFrame, *, ceiling: int = ADDR_MERGE_CEILING) -> DataFrame:
    shape = stats.agg(
        F.sum("size").alias("nodes"), F.count(F.lit(1)).alias("components"), F.count_if("is_ring").alias("rings"),
        F.coalesce(F.sum(F.when(F.col("is_ring"), F.col("phones"))), F.lit(0)).alias("ring_phones"),
        F.max("size").alias("largest_component"), F.sum("orders").alias("orders_ingested"))
    marks = degrees.agg(
        F.count_if(is_shared(F.col("node"), F.col("degree"), F.col("phones"))).alias("shared_entities"),
        F.count_if((kind_of(F.col("node")) == "addr") & (F.col("phones") >= ceiling)).alias("non_bridging_addresses"))
    return shape.withColumn("_k", F.lit(1)).join(marks.withColumn("_k", F.lit(1)), "_k").drop("_k")


def ring_lookup(comps: DataFrame, stats: DataFrame) -> DataFrame:
    return comps.join(stats, "component")


# ------------------------------------------------------------------ point in time
_STATS = ("size", "phones", "devices", "addrs", "orders", "rto", "delivered")


_POSITION = ["ts", "kind", "seq", "sub"]
# order of rows at one position: a node's name, readers before it, state changes, then bookings, then readers that include the position
_NAME, _BEFORE, _CHANGE, _BOOKING, _READER = -2, -1, 0, 1, 9
_KIND_BITS = 7


def _code(kind: str, node: Column, salt: int) -> Column:
    """A node as a number: a hash above, its kind in the lowest three bits. Order of codes is random."""
    hashed = F.xxhash64(F.lit(salt), node).bitwiseAND(F.lit(~_KIND_BITS).cast("bigint"))
    return F.when(node.isNotNull(), hashed.bitwiseOR(F.lit(ALL_KINDS.index(kind)).cast("bigint")))


def _code_kind(code: Column) -> Column:
    return code.bitwiseAND(F.lit(_KIND_BITS).cast("bigint"))


def _code_kind_name(code: Column) -> Column:
    return F.array(*[F.lit(k) for k in ALL_KINDS])[_code_kind(code).cast("int")]


def coded_orders(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The orders with numbers for nodes, and (node, name, ts, seq, count) of every node: its name, first order, number of orders.

    Numbers are short to sort, to shuffle and to compare. Should two of the names hash alike, all are hashed with another salt.
    """
    kinds = kinds_in(hashed)
    own = ["order_id", "seq", "ts", "outcome_ts", "rto", *[c for c in hashed.columns if c == "asked"]]
    hashed = set_down(hashed.select(*own, *kinds))
    for salt in count():
        pairs = F.array(*[F.struct(_code(k, F.col(k), salt).alias("node"), F.col(k).alias("name")) for k in kinds])
        nodes = cut_lineage(hashed.select("ts", "seq", F.inline(pairs)).filter(F.col("name").isNotNull()).groupBy("node", "name")
                            .agg(F.min(F.struct("ts", "seq")).alias("_f"), F.count(F.lit(1)).alias("count"))
                            .select("node", "name", "_f.ts", "_f.seq", "count"))
        if nodes.groupBy("node").count().filter("count > 1").isEmpty():
            return hashed.select(*own, *[_code(k, F.col(k), salt).alias(k) for k in kinds]), nodes


def components_over_time(hashed: DataFrame, *, guard: bool = True, ceiling: int = ADDR_MERGE_CEILING) -> DataFrame:
    """(node, component) after the last event, taken from the history of all labels."""
    orders, nodes = coded_orders(hashed)
    return named_labels(component_history(nodes, merge_edges(orders, guard=guard, ceiling=ceiling)), nodes)


def _log_rows(df: DataFrame, key: str, kind: int, sub: int, **cols: Column) -> DataFrame:
    """Rows of the nodes' log; the columns a row does not carry are NULL."""
    return df.select(F.col(key).alias("key"), "ts", F.lit(kind).alias("kind"), "seq", F.lit(sub).alias("sub"),
                     *[cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in _LOG.items()])


_LOG = {"label": "bigint", "name": "string", "link": "int", "phone_link": "int", "orders": "int", "rto": "int", "delivered": "int", "asked": "boolean"}


def _touches(orders: DataFrame, published: bool) -> DataFrame:
    """Log rows of orders (kind 0) and outcomes (kind 1). orders: nodes, `hub` that takes the order, `head` that takes its outcome.

    A published number changes whenever a node is touched, so every touch reads and a touch of the hub or head books as well. Live
    numbers are read before the order, by its nodes only.
    """
    def row(node: Column, ts: str, kind: int, sub: int, **cols: Column) -> Column:
        return F.struct(node.alias("key"), F.col(ts).alias("ts"), F.lit(kind).alias("kind"), F.lit(sub).alias("sub"),
                        *[cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in _LOG.items()])

    one, outcome = F.lit(1), {"rto": F.col("rto").cast("int"), "delivered": (~F.col("rto")).cast("int")}
    asked = F.col("asked") if "asked" in orders.columns else F.lit(True)
    rows = []
    for k in kinds_in(orders):
        node, only = F.col(k), lambda c, x: F.when(F.col(x) == F.col(k), c)
        if published:
            rows += [row(node, "ts", 0, _READER, orders=only(one, "hub"), asked=asked),
                     row(node, "outcome_ts", 1, _READER, **{c: only(x, "head") for c, x in outcome.items()})]
        else:
            rows.append(row(node, "ts", 0, _BEFORE, asked=asked))
    if not published:
        rows += [row(F.col("hub"), "ts", 0, _BOOKING, orders=one), row(F.col("head"), "outcome_ts", 1, _BOOKING, **outcome)]
    return orders.select("seq", F.inline(F.array(*rows).alias("r"))).filter(F.col("key").isNotNull())


def ring_features(hashed: DataFrame, *, published: bool = True, guard: bool = True,
                  ceiling: int = ADDR_MERGE_CEILING, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Ring features of every order (of those `asked`, where `hashed` has that column) as known just before it.

    published=True reads, for each of the order's nodes, the numbers written when that node was last touched
    by an order or outcome; published=False reads the node's component as it stands at the order's moment.
    Among the nodes the component with the largest (size, RTO rate) wins; the first kind wins a tie.
    """
    orders, nodes = coded_orders(hashed)
    kinds = kinds_in(orders)
    hot = hot_keys(nodes.select("node", "count"), hot_rows)
    history = component_history(nodes, merge_edges(orders, guard=guard, ceiling=ceiling))
    links = both_ways(edge_list(orders))

    # pass 1, keyed by node: which label a node carries at each booking and reading (labels only fall), its degree, and what had
    # been booked to it before each change of label
    rows = [_touches(with_hub(orders, guard=guard, ceiling=ceiling), published), _log_rows(nodes, "node", 0, _NAME, name=F.col("name")),
            _log_rows(history, "node", 0, _CHANGE, label=F.col("label")),
            _log_rows(links, "node", 0, _CHANGE, link=F.lit(1), phone_link=(_code_kind(F.col("other")) == ALL_KINDS.index("phone")).cast("int"))]
    now = F.struct("ts", "kind", "seq", F.lit(_READER).alias("sub"), F.col("_label").alias("label"), F.col("_degree").alias("degree"),
                   F.col("_phones").alias("phones"))
    by_node = running_by_key(
        reduce(DataFrame.unionByName, rows), ["key"], _POSITION,
        {"_label": ("min", F.col("label")), "_degree": ("sum", F.col("link")), "_phones": ("sum", F.col("phone_link")),
         "_orders": ("sum", F.col("orders")), "_rto": ("sum", F.col("rto")), "_del": ("sum", F.col("delivered")), "_name": ("min", F.col("name"))},
        then={"_read": ("max", F.when(F.col("sub") == _READER, now))} if published else None,  # the latest touch before
        hot=None if hot is None else hot.withColumnRenamed("node", "key"))

    # pass 2, keyed by label: a node that takes a label brings itself and its earlier bookings along. Written once: rows of nodes
    # that never merge (`comp` is NULL) know their ring, themselves
    log = set_down(_label_log(by_node, kinds, published, guard))
    met = log.filter(F.col("comp").isNotNull())
    member = lambda k: F.when(F.col("joins") == ALL_KINDS.index(k), 1)
    stats = {"size": F.when(F.col("joins").isNotNull(), 1), "phones": member("phone"), "devices": member("device"), "addrs": member("addr"),
             "orders": F.col("orders"), "rto": F.col("rto"), "delivered": F.col("delivered")}
    # a component's name is its smallest node so far
    by_label = running_by_key(met, ["comp"], _POSITION, {**{f"r_{c}": ("sum", x) for c, x in stats.items()}, "r_name": ("min", F.col("name"))},
                              hot=hot_keys(met.groupBy("comp").count(), hot_rows))
    reads = by_label.filter(F.col("reads").isNotNull())
    alone = log.filter(F.col("comp").isNull()).withColumns(
        {**{f"r_{c}": F.lit(1 if c == "size" else 0).cast("bigint") for c in _STATS}, "r_name": F.lit(None).cast("string")})
    reads = reads.unionByName(alone).select(
        F.col("seq_read").alias("read_seq"), (-F.col("reads")).alias("rank"), *[f"r_{c}" for c in _STATS], "r_name", F.col("degree").alias("_degree"),
        _code_is_shared(F.col("reads"), F.col("degree"), F.col("degree_phones")).alias("_shared"))
    return _best_ring(orders.filter("asked") if "asked" in orders.columns else orders, reads)


def _code_is_shared(kind: Column, degree: Column, phones: Column) -> Column:
    """`is_shared` by the number of a kind."""
    hard = [ALL_KINDS.index(k) for k in HARD_KINDS]
    return ~kind.isin(*hard) & (((kind == ALL_KINDS.index("addr")) & (phones >= ADDR_PUBLIC_CEILING)) | (degree >= SHARED_DEGREE_CEILING))


def _label_log(by_node: DataFrame, kinds: list[str], published: bool, guard: bool) -> DataFrame:
    """Rows of the labels' log: nodes that join a label, bookings, and readings."""
    seq = by_node.schema["seq"].dataType
    types = {"comp": "bigint", "ts": "timestamp", "kind": "int", "seq": seq, "sub": "int", "name": "string", "joins": "bigint", "orders": "bigint",
             "rto": "bigint", "delivered": "bigint", "seq_read": seq, "reads": "bigint", "degree": "bigint", "degree_phones": "bigint"}

    def row(**cols: Column) -> Column:
        return F.struct(*[cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])

    kind, label = _code_kind(F.col("key")), F.col("_label")
    never = [ALL_KINDS.index(k) for k in kinds if guard and k not in HARD_KINDS and k != "addr"]
    alone = kind.isin(*never) if never else F.lit(False)
    here = {c: F.col(c) for c in _POSITION}
    joins = row(**{**here, "comp": F.col("label"), "name": F.coalesce("name", "_name"), "joins": kind, "orders": F.col("_orders"),
                   "rto": F.col("_rto"), "delivered": F.col("_del")})
    books = row(**{**here, "comp": label, "sub": F.lit(_BOOKING), **{c: F.col(c) for c in ("orders", "rto", "delivered")}})
    at = {c: F.col(f"_read.{c}") for c in (*_POSITION, "label", "degree", "phones")} if published else {
        **here, "label": label, "degree": F.col("_degree"), "phones": F.col("_phones")}
    reads = row(comp=F.when(~alone, at["label"]), **{c: at[c] for c in _POSITION}, seq_read=F.col("seq"), reads=kind, degree=at["degree"],
                degree_phones=at["phones"])
    asks = (F.col("kind") == 0) & (F.col("sub") == (_READER if published else _BEFORE)) & F.col("asked") & F.col("seq").isNotNull() & at["label"].isNotNull()
    two = F.array(F.when(~alone & F.col("label").isNotNull(), joins).when(~alone & label.isNotNull() & F.coalesce("orders", "rto", "delivered").isNotNull(), books),
                  F.when(asks, reads))
    return by_node.select(F.inline(two)).filter(F.col("sub").isNotNull())  # an absent row is all NULL


def _best_ring(hashed: DataFrame, reads: DataFrame) -> DataFrame:
    ring = ring_predicate(*[F.col(f"r_{c}") for c in ("phones", "devices", "addrs", "rto", "delivered")])
    rate = rto_rate(F.col("r_rto"), F.col("r_delivered"))
    best = reads.groupBy(F.col("read_seq").alias("seq")).agg(
        F.max(F.struct(F.col("r_size").alias("size"), rate.alias("rate"), "rank",
                       F.col("r_phones").alias("phones"), F.col("r_devices").alias("devices"),
                       F.col("r_orders").alias("orders"), ring.alias("is_ring"), F.col("r_name").alias("ring_id"))).alias("b"),
        F.max("_degree").alias("entity_max_degree"), F.bool_or("_shared").alias("entity_shared"))
    real = F.coalesce(F.col("b.size") > 1, F.lit(False))
    pick = lambda c, other: F.when(real, F.col(f"b.{c}")).otherwise(other)
    return (hashed.select("order_id", "seq", "ts").join(best, "seq", "left").select(
        "order_id", "seq", "ts", pick("size", F.lit(0)).cast("bigint").alias("ring_size"),
        pick("phones", F.lit(0)).cast("bigint").alias("ring_phones"), pick("rate", F.lit(0.0)).alias("ring_rto_rate"),
        pick("is_ring", F.lit(False)).alias("is_ring"), pick("ring_id", F.lit(None)).alias("ring_id"),
        F.coalesce("entity_max_degree", F.lit(0)).cast("bigint").alias("entity_max_degree"),
        F.coalesce("entity_shared", F.lit(False)).alias("entity_shared")))


def published_rings(hashed: DataFrame, *, guard: bool = True, ceiling: int = ADDR_MERGE_CEILING) -> DataFrame:
    """What the graph publishes of each node after all of `hashed`: its ring's numbers and its own degree."""
    orders, nodes = coded_orders(hashed)
    comps = connected_components(nodes.select("node"), merge_edges(orders, guard=guard, ceiling=ceiling).select("a", "b"))
    # amounts are not published
    stats = ring_statistics(orders.withColumn("cart_gmv", F.lit(None).cast("double")), comps, guard=guard, ceiling=ceiling, kind=_code_kind_name)
    own = node_degrees(edge_list(orders), _code_kind_name)
    named = comps.join(nodes.select("node", "name"), "node")
    # a component's name is its smallest node
    numbers = (stats.join(named.groupBy("component").agg(F.min("name").alias("r_name")), "component")
               .select("component", "r_name", *[F.col(c).alias(f"r_{c}") for c in _STATS]))
    shared = _code_is_shared(_code_kind(F.col("node")), F.col("degree"), F.col("phones"))
    return (named.join(numbers, "component").join(own, "node", "left")
            .select(F.col("name").alias("node"), "r_name", *[f"r_{c}" for c in _STATS], F.coalesce("degree", F.lit(0)).alias("_degree"),
                    F.coalesce(shared, F.lit(False)).alias("_shared")))


def looked_up_rings(hashed: DataFrame, published: DataFrame) -> DataFrame:
    """Ring features of orders from numbers published before, as the serving side reads them."""
    rank = F.create_map(*[x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(-i))])
    reads = order_entities(hashed).select(F.col("seq").alias("read_seq"), rank[F.col("kind")].alias("rank"), "node").join(published, "node")
    return _best_ring(hashed, reads)


def degrees_over_time(hashed: DataFrame, *, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Degree of each of an order's nodes just before the order."""
    links = both_ways(edge_list(hashed)).select("node", "ts", "seq", F.lit(1).alias("sub"), F.lit(1).alias("link"))
    reads = order_entities(hashed).select("node", "ts", "seq", F.lit(0).alias("sub"), F.lit(0).alias("link"))
    seen = running_by_key(links.unionByName(reads), ["node"], ["ts", "seq", "sub"], {"degree": ("sum", F.col("link"))},
                          hot=hot_keys(order_entities(hashed).groupBy("node").count(), hot_rows))
    return seen.filter("sub = 0").select("seq", "node", F.col("degree").cast("bigint").alias("degree"))


# ------------------------------------------------------------------ exploration and evaluation
def neighbourhood(edges: DataFrame, seed: str, max_nodes: int = 120) -> DataFrame:
    """Nodes reached from `seed` in breadth-first order (hop, node), at most `max_nodes` of them.

    The frontier never exceeds `max_nodes` ids, so it travels as a literal filter that prunes the edge scan.
    """
    spark = edges.sparkSession
    reached, frontier, hop = {seed: 0}, [seed], 0
    adjacent = both_ways(edges.select("a", "b"))
    while frontier and len(reached) < max_nodes:
        hop += 1
        # at most max_nodes known ids can be among the answers, so this many rows always hold enough new ones
        found = (adjacent.filter(F.col("node").isin(frontier) & ~F.col("other").isin(list(reached)))
                 .select("other").distinct().orderBy("other").limit(max_nodes - len(reached)).collect())
        frontier = [r["other"] for r in found]
        reached.update((n, hop) for n in frontier)
    return spark.createDataFrame(list(reached.items()), "node string, hop int")


def subgraph(edges: DataFrame, seed: str, max_nodes: int = 120) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree and centrality, induced edges) of a neighbourhood."""
    nodes = F.broadcast(neighbourhood(edges, seed, max_nodes))
    e = edges.select("a", "b")
    inner = (e.join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
             .join(nodes.select(F.col("node").alias("b")), "b", "left_semi"))
    return degree_centrality(nodes, inner), inner


def degree_centrality(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    deg = both_ways(inner).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.agg(F.count(F.lit(1)).alias("_n"))
    out = nodes.join(deg, "node", "left").na.fill(0, ["degree"]).withColumn("_k", F.lit(1))
    out = out.join(F.broadcast(n.withColumn("_k", F.lit(1))), "_k")
    cent = F.coalesce(F.try_divide(F.col("degree").cast("double"), F.col("_n") - 1), F.lit(0.0))
    return out.withColumn("centrality", F.round(cent, 3)).drop("_k", "_n")


def detection_quality(flags: DataFrame) -> DataFrame:
    """Phone-level detection counts from (flagged, truth, resident) booleans."""
    flagged, truth, resident = F.col("flagged"), F.col("truth"), F.col("resident") & ~F.col("truth")
    out = flags.agg(
        F.count(F.lit(1)).alias("phones"), F.count_if(truth).alias("ring_phones_true"),
        F.count_if(flagged & truth).alias("tp"), F.count_if(flagged & ~truth).alias("fp"),
        F.count_if(~flagged & truth).alias("fn"), F.count_if(resident).alias("legit_residents"),
        F.count_if(flagged & resident).alias("residents_condemned"))
    one = F.lit(1)
    return out.withColumns({
        "precision": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp")),
        "recall": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn")),
        "residents_condemned_share": F.col("residents_condemned") / F.greatest(one, F.col("legit_residents"))})


def phone_flags(hashed: DataFrame, truth: DataFrame, *, guard: bool, ceiling: int = ADDR_MERGE_CEILING) -> tuple[DataFrame, DataFrame]:
    """(per-phone flags, ring statistics) of one guard setting. truth(phone node, truth, resident)."""
    comps = components(hashed, guard=guard, ceiling=ceiling)
    stats = ring_statistics(hashed, comps, guard=guard, ceiling=ceiling)
    flagged = comps.join(stats.select("component", F.col("is_ring").alias("flagged")), "component").select("node", "flagged")
    return truth.join(flagged, truth["phone"] == flagged["node"]).select("phone", "flagged", "truth", "resident"), stats


def guard_comparison(hashed: DataFrame, truth: DataFrame, ceilings: tuple[int, ...] = (ADDR_MERGE_CEILING,), naive: bool = True) -> DataFrame:
    """Detection quality and component shape of the naive graph, if wanted, and of each merge ceiling."""
    rows, hashed = [], cut_lineage(hashed)
    for name, guard, ceiling in [("naive", False, ADDR_MERGE_CEILING)] * naive + [(f"guarded@{c}", True, c) for c in ceilings]:
        flags, stats = phone_flags(hashed, truth, guard=guard, ceiling=ceiling)
        shape = stats.agg(F.count(F.lit(1)).alias("components"), F.count_if("is_ring").alias("rings"),
                          F.max("size").alias("largest_component"))
        rows.append(detection_quality(flags).withColumn("variant", F.lit(name))
                    .join(shape.withColumn("variant", F.lit(name)), "variant"))
    return reduce(DataFrame.unionByName, rows)


# ------------------------------------------------------------------ snapshots
RTO_SHRINK = 5.0
EMPTY_SNAPSHOT_RTO = 0.2
NODE_FEATURES = (*[f"kind_{k}" for k in KINDS], "degree_log", "orders_log", "resolved_log", "rto_rate_shrunk",
                 *[f"nbr_{k}_log" for k in KINDS])


def snapshot(hashed: DataFrame, order_cutoff: datetime | None = None, outcome_cutoff: datetime | None = None) -> DataFrame:
    """Orders up to one clock, with outcomes only if resolved by another (`rto` is NULL while pending)."""
    outcome_cutoff = outcome_cutoff or order_cutoff
    sub = hashed if order_cutoff is None else hashed.filter(F.col("ts") <= F.lit(order_cutoff))
    if outcome_cutoff is None:
        return sub
    return sub.withColumn("rto", F.when(F.col("outcome_ts") <= F.lit(outcome_cutoff), F.col("rto")))


def node_counts(snap: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Orders, resolved returns and deliveries, and distinct neighbours by kind of every node. `edges`: the snapshot's edge list, if at hand."""
    pairs = F.array(*[F.col(k) for k in KINDS])
    touched = snap.select(F.explode(pairs).alias("node"), "rto").filter(F.col("node").isNotNull())
    own = touched.groupBy("node").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("rto")).alias("rto"),
        F.count_if(~F.col("rto")).alias("delivered"))
    near = both_ways((edge_list(snap) if edges is None else edges).select("a", "b"))
    # one pass: a pivot would first be grouped by node and kind
    near = near.groupBy("node").agg(*[F.count_if(kind_of(F.col("other")) == k).alias(f"nbr_{k}") for k in KINDS])
    return own.join(near, "node", "left").na.fill(0, [f"nbr_{k}" for k in KINDS])


def node_features(snap: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The node feature table of a snapshot. `edges`: its edge list, if at hand."""
    prior = snap.agg(F.coalesce(F.avg(F.col("rto").cast("double")), F.lit(EMPTY_SNAPSHOT_RTO)).alias("_prior"))
    counts = node_counts(snap, edges).withColumn("_k", F.lit(1)).join(F.broadcast(prior.withColumn("_k", F.lit(1))), "_k")
    kind = kind_of(F.col("node"))
    resolved = F.col("rto") + F.col("delivered")
    degree = reduce(Column.__add__, [F.col(f"nbr_{k}") for k in KINDS])
    return counts.select(
        "node", *[(kind == k).cast("double").alias(f"kind_{k}") for k in KINDS],
        F.log1p(degree.cast("double")).alias("degree_log"), F.log1p(F.col("orders").cast("double")).alias("orders_log"),
        F.log1p(resolved.cast("double")).alias("resolved_log"),
        ((F.col("rto") + RTO_SHRINK * F.col("_prior")) / (resolved + RTO_SHRINK)).alias("rto_rate_shrunk"),
        *[F.log1p(F.col(f"nbr_{k}").cast("double")).alias(f"nbr_{k}_log") for k in KINDS])


MIN_STD = 1e-3


def standardiser(features: DataFrame) -> DataFrame:
    """One row of means and floored population deviations; the kind indicators stay as they are."""
    scaled = NODE_FEATURES[len(KINDS):]
    return features.agg(*[F.avg(c).alias(f"mean_{c}") for c in scaled],
                        *[F.greatest(F.stddev_pop(c), F.lit(MIN_STD)).alias(f"std_{c}") for c in scaled])


def standardise(features: DataFrame, scale: DataFrame) -> DataFrame:
    j = features.withColumn("_k", F.lit(1)).join(F.broadcast(scale.withColumn("_k", F.lit(1))), "_k")
    return j.select("node", *NODE_FEATURES[:len(KINDS)], *[
        ((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(c) for c in NODE_FEATURES[len(KINDS):]])


def neighbour_mean(edges: DataFrame, features: DataFrame, columns: list[str], suffix: str = "_n1") -> DataFrame:
    """Mean of each feature over a node's distinct neighbours; 0 without neighbours."""
    sums = (both_ways(edges.select("a", "b"))
            .join(features.select(F.col("node").alias("other"), *columns), "other")
            .groupBy("node").agg(*[F.avg(c).alias(c + suffix) for c in columns]))
    return features.join(sums, "node", "left").na.fill(0.0, [c + suffix for c in columns])


def phone_labels(orders: DataFrame, lo: datetime, hi: datetime | None) -> DataFrame:
    """Phones first seen in [lo, hi): label 1 if at least half of their orders before hi came back."""
    sub = orders if hi is None else orders.filter(F.col("ts") < F.lit(hi))
    agg = sub.groupBy("phone").agg(F.min("ts").alias("first_ts"), F.avg(F.col("rto").cast("double")).alias("rate"))
    # every row of `sub` is before hi, so a first order in it is as well
    return (agg.filter(F.col("first_ts") >= F.lit(lo))
            .select("phone", (F.col("rate") >= 0.5).cast("int").alias("label")))


def era_scores(orders: DataFrame, scores: DataFrame, edges: list[tuple[str, datetime | None]]) -> DataFrame:
    """Stamp each order with its era and its phone's score of that era (NULL if it has none).

    `edges` lists (era, end) in time order, the last end being None; scores(era, node, score).
    """
    era = F.lit(edges[-1][0])
    for name, end in reversed(edges[:-1]):
        era = F.when(F.col("ts") < F.lit(end), name).otherwise(era)
    s = scores.select(F.col("era").alias("_e"), F.col("node").alias("_n"), "score")
    o = orders.withColumn("era", era)
    return o.join(s, (o["era"] == s["_e"]) & (o["phone"] == s["_n"]), "left").drop("_e", "_n")
