"""Detectors of laundering shapes. All bounds are keyword arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltrace.session import stored
from siltrace.sources.ledger import cents

HOUR, DAY = 3600, 86400


def _moves(ledger: DataFrame) -> DataFrame:
    """Transfers between different accounts with seconds and cents."""
    rows = ledger.where("sender_id is not null and receiver_id is not null and sender_id <> receiver_id and amount is not null and timestamp is not null")
    return rows.select("txn_id", F.col("sender_id").alias("s"), F.col("receiver_id").alias("r"), F.unix_timestamp("timestamp").alias("ts"), cents().alias("c"))


def _next(left: DataFrame, moves: DataFrame, at: str, ts: str, c: str, low: int, high: int, ratio: tuple[float, float], extra=None) -> DataFrame:
    """Joins each row to transfers from account ``at`` after ``low`` to ``high`` seconds in the ratio.

    Time is cut into buckets of ``high``; a row looks into its own and the next, so a hub's
    transfers meet a bucket at a time.
    """
    b = left.withColumn("_b", F.explode(F.array(F.floor(F.col(ts) / high), F.floor(F.col(ts) / high) + 1)))
    m = moves.select(F.col("txn_id").alias("n_txn"), F.col("s").alias("n_s"), F.col("r").alias("n_r"), F.col("ts").alias("n_ts"), F.col("c").alias("n_c")).withColumn("_b", F.floor(F.col("n_ts") / high))
    gap = F.col("n_ts") - F.col(ts)
    lo, hi = (round(x * 1000) for x in ratio)
    met = (b._b == m._b) & (F.col(at) == F.col("n_s")) & gap.between(low, high) & (F.col("n_c") * 1000).between(F.col(c) * lo, F.col(c) * hi)
    return b.join(m, met if extra is None else met & extra).drop("_b")


def _running(events: DataFrame, key: str, span: int, sums: list[str]) -> DataFrame:
    """``events`` (``key, t`` and numbers) added up by time, with their running sums up to each time.

    Time is cut into buckets of ``span``: sums run within a bucket and start from the totals of those
    before, so a hub's events lie in as many tasks as it has buckets, and one task sees a row for each bucket.
    """
    others = [c for c in events.columns if c not in (key, "t", *sums)]
    per = events.groupBy(key, "t").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in others]).withColumn("_b", F.floor(F.col("t") / span))
    total = per.groupBy(key, "_b").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    base = total.select(key, "_b", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    run = W.partitionBy(key, "_b").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return per.join(base, [key, "_b"]).select(key, "t", *others, *[(F.sum(c).over(run) + F.col(f"_{c}")).alias(c) for c in sums])


def smurfing(ledger: DataFrame, low: float = 9000.0, high: float = 9900.0, min_mules: int = 8, days: int = 4, forward: tuple[float, float] = (0.85, 0.95), forward_days: tuple[int, int] = (1, 2)) -> DataFrame:
    """``collector, destination, n_mules, pool, forward_amount, last_payment_txn, forward_txn``.

    A sender counts from a payment until its next one to the same collector or until the payment leaves the frame
    of ``days``, a payment's cents until it leaves; running sums of what comes and goes are the frame's senders
    and pool at each payment.
    """
    m, span = _moves(ledger), days * DAY
    paid = m.where(F.col("c").between(round(low * 100), round(high * 100)))
    one = paid.groupBy("r", "s", "ts").agg(F.sum("c").alias("c"))
    again = F.lead("ts").over(W.partitionBy("r", "s").orderBy("ts"))
    event = lambda t, n, c, asked: F.struct(t.alias("t"), F.lit(n).cast("bigint").alias("n_mules"), c.cast("bigint").alias("pool"), F.lit(asked).alias("asked"))
    out_of_frame = F.col("ts") + span + 1
    gone = F.coalesce(F.least(again, out_of_frame), out_of_frame)
    events = one.withColumn("gone", gone).select("r", F.inline(F.array(event(F.col("ts"), 1, F.col("c"), True), event(F.col("gone"), -1, F.lit(0), False), event(out_of_frame, 0, -F.col("c"), False))))
    pools = _running(events, "r", span, ["n_mules", "pool"]).where(F.col("asked") & (F.col("n_mules") >= min_mules))
    last = paid.select("r", F.col("ts").alias("t"), "txn_id").join(pools, ["r", "t"])
    out = _next(last.select(F.col("r").alias("collector"), F.col("txn_id").alias("last_payment_txn"), F.col("t").alias("ts"), "pool", "n_mules"), m, "collector", "ts", "pool", forward_days[0] * DAY, forward_days[1] * DAY, forward)
    return out.select("collector", F.col("n_r").alias("destination"), "n_mules", (F.col("pool") / 100).alias("pool"), (F.col("n_c") / 100).alias("forward_amount"), "last_payment_txn", F.col("n_txn").alias("forward_txn"))


def hops(ledger: DataFrame, gap: tuple[int, int] = (HOUR, 48 * HOUR), ratio: tuple[float, float] = (0.90, 0.97)) -> DataFrame:
    """The graph of transfers, stored: each pair of one transfer and one that can pass its money on.

    ``t1, s, c1, ts1`` and ``mid`` of the first, ``t2, dst, c2, ts2`` of the second.
    """
    m = _moves(ledger)
    met = _next(m, m, "r", "ts", "c", gap[0], gap[1], ratio)
    return stored(met.select(F.col("txn_id").alias("t1"), "s", F.col("c").alias("c1"), F.col("ts").alias("ts1"), F.col("r").alias("mid"), F.col("n_txn").alias("t2"), F.col("n_r").alias("dst"), F.col("n_c").alias("c2"), F.col("n_ts").alias("ts2")), "hops")


def chains(ledger: DataFrame, most: int, graph: DataFrame) -> list[DataFrame]:
    """Chains of 1 to ``most`` transfers without repeated accounts, each level made once, from the one before.

    ``txns, accounts, head, tail, first_c, last_c, last_ts, at``: ``head`` and ``tail`` are the first and last transfer, by
    which chains meet the graph, so a busy account's chains spread over its transfers.
    """
    m = _moves(ledger)
    one = m.select(F.array("txn_id").alias("txns"), F.array("s", "r").alias("accounts"), F.col("txn_id").alias("head"), F.col("txn_id").alias("tail"), F.col("c").alias("first_c"), F.col("c").alias("last_c"), F.col("ts").alias("last_ts"), F.col("r").alias("at"))
    out = [one]
    if most > 1:
        two = graph.where("dst <> s").select(F.array("t1", "t2").alias("txns"), F.array("s", "mid", "dst").alias("accounts"), F.col("t1").alias("head"), F.col("t2").alias("tail"), F.col("c1").alias("first_c"), F.col("c2").alias("last_c"), F.col("ts2").alias("last_ts"), F.col("dst").alias("at"))
        out.append(two)
    step = graph.select(F.col("t1").alias("tail"), "t2", "dst", "c2", "ts2")
    while len(out) < most:
        grown = out[-1].join(step, "tail").where(~F.array_contains("accounts", F.col("dst")))
        out.append(stored(grown.select(F.concat("txns", F.array("t2")).alias("txns"), F.concat("accounts", F.array("dst")).alias("accounts"), "head", F.col("t2").alias("tail"), "first_c", F.col("c2").alias("last_c"), F.col("ts2").alias("last_ts"), F.col("dst").alias("at")), "chains"))
    return out


def layering(ledger: DataFrame, least: int = 3, most: int = 6, gap: tuple[int, int] = (HOUR, 48 * HOUR), ratio: tuple[float, float] = (0.90, 0.97), graph: DataFrame | None = None) -> DataFrame:
    """Maximal simple chains of ``least`` to ``most`` accounts: no hop to or from another account lengthens them.

    ``graph`` are the ``hops`` of the ledger, where they are known.
    """
    graph = hops(ledger, gap, ratio) if graph is None else graph
    by = chains(ledger, most - 1, graph)
    names = by[0].columns
    longest = by[most - 2].select(*names)
    short = None
    for rows in by[least - 2 : most - 2]:
        short = rows.select(*names) if short is None else short.unionByName(rows.select(*names))
    out = longest
    if short is not None:
        ahead = graph.select(F.col("t1").alias("tail"), F.col("dst").alias("_next"))
        back = graph.select(F.col("t2").alias("head"), F.col("s").alias("_before"))
        ended = short.alias("x").join(ahead.alias("y"), (F.col("x.tail") == F.col("y.tail")) & ~F.array_contains("x.accounts", F.col("y._next")), "left_anti")
        begun = ended.alias("x").join(back.alias("y"), (F.col("x.head") == F.col("y.head")) & ~F.array_contains("x.accounts", F.col("y._before")), "left_anti")
        out = begun.unionByName(longest)
    return out.select("txns", "accounts", F.size("accounts").alias("n_accounts"), (F.col("first_c") / 100).alias("first_amount"), (F.col("last_c") / 100).alias("last_amount"))


def _legs(graph: DataFrame) -> DataFrame:
    return graph.where("dst <> s").select(F.col("t1").alias("txn_id"), "s", "mid", F.col("ts1").alias("ts"), "dst", F.col("ts2").alias("n_ts"))


def fan_out_fan_in(ledger: DataFrame, min_intermediates: int = 5, max_destinations: int = 3, days: int = 4, gap: tuple[int, int] = (HOUR, 48 * HOUR), ratio: tuple[float, float] = (0.90, 0.97), graph: DataFrame | None = None) -> DataFrame:
    """``source, anchor_txn, n_intermediates, n_destinations, last_ts``: legs within ``days`` of an anchor leg.

    An account counts at an anchor if it has a leg in the ``days`` from there on. So each leg counts for the anchors
    since the account's last leg before it, and running sums give both counts at every anchor; anchors are never joined with
    legs. The last time is the larger of two running maxima: to the end of the anchor's bucket of
    ``days``, and from the start of the next one.
    """
    graph = hops(ledger, gap, ratio) if graph is None else graph
    legs, span = _legs(graph), days * DAY
    counts = None
    for name, column in (("n_intermediates", "mid"), ("n_destinations", "dst")):
        one = legs.select("s", column, "ts").distinct()
        before = F.lag("ts").over(W.partitionBy("s", column).orderBy("ts"))
        since = F.coalesce(F.greatest(F.col("ts") - span, before + 1), F.col("ts") - span)
        zero = {n: F.lit(0).cast("bigint").alias(n) for n in ("n_intermediates", "n_destinations")}
        put = lambda t, n, name=name, zero=zero: F.struct(t.alias("t"), *[F.lit(n).cast("bigint").alias(k) if k == name else v for k, v in zero.items()], F.lit(False).alias("asked"))
        events = one.withColumn("since", since).select("s", F.inline(F.array(put(F.col("since"), 1), put(F.col("ts") + 1, -1))))
        counts = events if counts is None else counts.unionByName(events)
    asked = legs.select("s", F.col("ts").alias("t"), *zero.values(), F.lit(True).alias("asked")).distinct()
    at = _running(counts.unionByName(asked), "s", span, list(zero)).where(F.col("asked") & (F.col("n_intermediates") >= min_intermediates) & (F.col("n_destinations") <= max_destinations)).drop("asked")
    found = legs.select("txn_id", "s", F.col("ts").alias("t")).distinct().join(at, ["s", "t"])

    bucket = lambda c: F.floor(F.col(c) / span)
    ends = legs.groupBy("s", "ts").agg(F.max("n_ts").alias("n_ts")).withColumn("_b", bucket("ts"))
    own = ends.select("s", F.col("ts").alias("t"), F.max("n_ts").over(W.partitionBy("s", "_b").orderBy("ts").rowsBetween(0, W.unboundedFollowing)).alias("own"))
    marks = found.select("s", "t", (F.col("t") + span).alias("ts"), F.lit(None).cast("bigint").alias("n_ts")).distinct().withColumn("_b", bucket("ts"))
    seen = ends.select("s", F.lit(None).cast("bigint").alias("t"), "ts", "n_ts", "_b").unionByName(marks)
    later = seen.withColumn("later", F.max("n_ts").over(W.partitionBy("s", "_b").orderBy("ts").rangeBetween(W.unboundedPreceding, 0))).where("t is not null").select("s", "t", "later")
    out = found.join(own, ["s", "t"]).join(later, ["s", "t"])
    return out.select(F.col("s").alias("source"), F.col("txn_id").alias("anchor_txn"), "n_intermediates", "n_destinations", F.greatest("own", "later").alias("last_ts"))


def fan_roles(ledger: DataFrame, fans: DataFrame, days: int = 4, gap: tuple[int, int] = (HOUR, 48 * HOUR), ratio: tuple[float, float] = (0.90, 0.97), graph: DataFrame | None = None) -> DataFrame:
    """``anchor_txn, account_id, role`` of the sources, intermediates and destinations of ``fans``: as many rows as they have legs."""
    legs, span = _legs(hops(ledger, gap, ratio) if graph is None else graph), days * DAY
    anchors = legs.select(F.col("txn_id").alias("anchor_txn"), "s", F.col("ts").alias("a_ts")).distinct().join(fans.select("anchor_txn"), "anchor_txn").withColumn("_b", F.floor(F.col("a_ts") / span))
    near = legs.withColumn("_b", F.explode(F.array(F.floor(F.col("ts") / span), F.floor(F.col("ts") / span) - 1)))
    mine = anchors.join(near, ["s", "_b"]).where((F.col("ts") - F.col("a_ts")).between(0, span))
    one = lambda c, role: F.struct(F.col(c).alias("account_id"), F.lit(role).alias("role"))
    return mine.select("anchor_txn", F.explode(F.array(one("s", "source"), one("mid", "intermediate"), one("dst", "destination"))).alias("x")).select("anchor_txn", "x.*").distinct()


def mules(ledger: DataFrame, smurfs: DataFrame, low: float = 9000.0, high: float = 9900.0, days: int = 4) -> DataFrame:
    """``last_payment_txn, forward_txn, account_id``: who paid the collector in the days up to the last payment."""
    paid = _moves(ledger).where(F.col("c").between(round(low * 100), round(high * 100)))
    last = smurfs.join(paid.select(F.col("txn_id").alias("last_payment_txn"), F.col("ts").alias("l_ts")), "last_payment_txn").select("last_payment_txn", "forward_txn", F.col("collector").alias("r"), "l_ts", F.floor(F.col("l_ts") / (days * DAY)).alias("_b"))
    spread = paid.withColumn("_b", F.explode(F.array(F.floor(F.col("ts") / (days * DAY)), F.floor(F.col("ts") / (days * DAY)) + 1)))
    return last.join(spread, ["r", "_b"]).where((F.col("l_ts") - F.col("ts")).between(0, days * DAY)).select("last_payment_txn", "forward_txn", F.col("s").alias("account_id")).distinct()


def round_trips(ledger: DataFrame, most: int = 4, gap: tuple[int, int] = (HOUR, 48 * HOUR), back_days: tuple[int, int] = (3, 21), ratio: tuple[float, float] = (0.90, 0.97), graph: DataFrame | None = None) -> DataFrame:
    """``txns, accounts, n_accounts, amount_out, amount_back`` of loops of 2 to ``most`` accounts.

    All chains look for the transfer that closes them in one join, by both accounts and a bucket of time.
    """
    graph = hops(ledger, gap, ratio) if graph is None else graph
    rows = None
    for level in chains(ledger, most - 1, graph):
        rows = level if rows is None else rows.unionByName(level)
    low, high = (d * DAY for d in back_days)
    lo, hi = (round(x * 1000) for x in ratio)
    m = _moves(ledger).select(F.col("s").alias("at"), F.col("r").alias("origin"), F.col("txn_id").alias("n_txn"), F.col("ts").alias("n_ts"), F.col("c").alias("n_c"), F.floor(F.col("ts") / high).alias("_b"))
    open_ = rows.withColumn("origin", F.col("accounts")[0]).withColumn("_b", F.explode(F.array(F.floor(F.col("last_ts") / high), F.floor(F.col("last_ts") / high) + 1)))
    closed = open_.join(m, ["at", "origin", "_b"]).where((F.col("n_ts") - F.col("last_ts")).between(low, high) & (F.col("n_c") * 1000).between(F.col("last_c") * lo, F.col("last_c") * hi))
    return closed.select(F.concat("txns", F.array("n_txn")).alias("txns"), "accounts", F.size("accounts").alias("n_accounts"), (F.col("first_c") / 100).alias("amount_out"), (F.col("n_c") / 100).alias("amount_back"))


def pattern_roles(smurfs: DataFrame, payers: DataFrame, layers: DataFrame, fans: DataFrame, trips: DataFrame) -> DataFrame:
    """``pattern_id, pattern_type, account_id, role`` of detected shapes.

    ``payers`` are the ``mules`` of ``smurfs``; ``fans`` are ``fan_roles``.
    """
    pid = lambda kind, txns: F.concat(F.lit(f"{kind}_"), F.md5(F.array_join(txns, "|").cast("binary")))
    ends = lambda a: F.transform(a, lambda x, k: F.struct(x.alias("account_id"), F.when(k == 0, "origin").when(k == F.size(a) - 1, "destination").otherwise("intermediate").alias("role")))
    loop = lambda a: F.transform(a, lambda x, k: F.struct(x.alias("account_id"), F.when(k == 0, "origin").otherwise("intermediate").alias("role")))
    s = smurfs.select(pid("smurfing", F.array("last_payment_txn", "forward_txn")).alias("pattern_id"), F.lit("smurfing").alias("pattern_type"), F.explode(F.array(F.struct(F.col("collector").alias("account_id"), F.lit("collector").alias("role")), F.struct(F.col("destination").alias("account_id"), F.lit("destination").alias("role")))).alias("x"))
    rows = s.union(layers.select(pid("layering", F.col("txns")), F.lit("layering"), F.explode(ends(F.col("accounts"))))).union(trips.select(pid("round_tripping", F.col("txns")), F.lit("round_tripping"), F.explode(loop(F.col("accounts")))))
    named = rows.select("pattern_id", "pattern_type", "x.account_id", "x.role")
    paid = payers.select(pid("smurfing", F.array("last_payment_txn", "forward_txn")), F.lit("smurfing"), "account_id", F.lit("mule"))
    fanned = fans.select(pid("fan_out_fan_in", F.array("anchor_txn")), F.lit("fan_out_fan_in"), "account_id", "role")
    return named.union(paid).union(fanned).distinct()
