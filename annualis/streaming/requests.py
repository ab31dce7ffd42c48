"""Request-log analytics (STR-2/3/4), batch and Structured Streaming forms.

The request log is (ts, user, key fields, latency, ok).  Window aggregates are plain
``groupBy(window)``; the TTL de-dup needs per-key order: in batch it runs as a
secondary sort by key and run streamed through ``mapInPandas`` with O(1) state, so no key's
rows are ever held in memory at once; in streaming it is ``transformWithStateInPandas``
with event-time timers that judge requests in order and end the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from annualis import config as C

TS_FMT = "yyyy-MM-dd HH:mm:ss"


def window_stats(log: DataFrame, ts: str = "ts", every: str = "1 hour", approx_pct: bool = False) -> DataFrame:
    """STR-2: per tumbling window: requests, errors, error rate, mean / max latency
    (and approximate p50 / p95 when asked: a mergeable sketch, safe for streams)."""
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum((~F.col("ok")).cast("long")).alias("n_err"),
            F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms")]
    if approx_pct:
        aggs += [F.percentile_approx("latency_ms", F.array(F.lit(0.5), F.lit(0.95)), 10000).alias("pcts")]
    g = log.groupBy(F.window(ts, every).alias("w")).agg(*aggs)
    out = g.select(F.date_format(F.col("w.start"), TS_FMT).alias("window_start"), "n", "n_err",
                   F.round(F.col("n_err") / F.col("n"), 6).alias("error_rate"),
                   F.round("mean_ms", 6).alias("mean_ms"), "max_ms", *(["pcts"] if approx_pct else []))
    return out


#: Size of a latency sketch; its rank error is about 0.7 % at 99 % confidence.
SKETCH_K = 400


def _path_windows(log: DataFrame, ts: str, path: str, every: str) -> DataFrame:
    """Counts, latencies and a KLL sketch of the latencies per path and tumbling window."""
    return log.groupBy(F.window(ts, every).alias("w"), path).agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("ok")).cast("long")).alias("n_err"),
        F.sum("latency_ms").alias("sum_ms"), F.max("latency_ms").alias("max_ms"),
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def window_sketches(log: DataFrame, ts: str = "ts", path: str = "path", every: str = "1 hour") -> DataFrame:
    """STR-2 per path: (window_start, path, n, n_err, sum_ms, max_ms, sketch), a table to keep: rows
    of shorter windows merge into longer ones (:func:`merge_windows`)."""
    g = _path_windows(log, ts, path, every)
    return g.select(F.col("w.start").alias("window_start"), path, "n", "n_err", "sum_ms", "max_ms", "sketch")


def merge_windows(sketches: DataFrame, path: str = "path", every: str = "1 day") -> DataFrame:
    """The rows of :func:`window_sketches` for longer windows, from those of shorter ones."""
    g = sketches.groupBy(F.window("window_start", every).alias("w"), path).agg(
        F.sum("n").alias("n"), F.sum("n_err").alias("n_err"), F.sum("sum_ms").alias("sum_ms"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_double("sketch").alias("sketch"))
    return g.select(F.col("w.start").alias("window_start"), path, "n", "n_err", "sum_ms", "max_ms", "sketch")


def sketch_stats(sketches: DataFrame, qs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Rates, means and quantiles (``p50``, ``p95``, ... by rank) of sketched windows; a window without any
    latency has null quantiles."""
    some = F.kll_sketch_get_n_double("sketch") > 0
    return sketches.select(
        *[c for c in sketches.columns if c not in ("sum_ms", "sketch")],
        F.round(F.col("n_err") / F.col("n"), 6).alias("error_rate"), F.round(F.col("sum_ms") / F.col("n"), 6).alias("mean_ms"),
        *[F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).alias(f"p{q * 100:g}") for q in qs])


def window_stats_stream(log: DataFrame, ts: str = "ts", every: str = "1 hour", watermark: str = "10 minutes",
                        path: str | None = None) -> DataFrame:
    """STR-2 for a stream: event-time tumbling windows with a watermark, so state for
    windows older than the watermark is dropped and append mode emits closed windows.  With ``path``
    the windows are per path.  Latencies are kept as KLL sketches, a few kB a window.
    TIMESTAMP_NTZ inputs are read as UTC timestamps (watermarks need TIMESTAMP)."""
    s = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    s = s.withColumn("path", F.col(path) if path else F.lit(""))
    g = _path_windows(s, ts, "path", every)
    out = sketch_stats(g.select(F.date_format("w.start", TS_FMT).alias("window_start"), "path", "n", "n_err", "sum_ms", "max_ms", "sketch"))
    return out if path else out.drop("path")


def rate_violations_stream(log: DataFrame, ts: str = "ts", user: str = "user_id", unit: str = "1 minute",
                           limit: int = C.RATE_PER_MINUTE, watermark: str = "2 minutes") -> DataFrame:
    """STR-3 for a stream: per client fixed windows over a watermark, rows over the limit."""
    s = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    g = s.groupBy(user, F.window(ts, unit).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") > limit).select(user, F.date_format("w.start", TS_FMT).alias("window_start"), "n")


def rate_violations(log: DataFrame, ts: str = "ts", user: str = "user_id",
                    per_minute: int = C.RATE_PER_MINUTE, per_second: int = C.RATE_PER_SECOND) -> DataFrame:
    """STR-3: clients over the limits in fixed windows (> per_minute / minute, > per_second / second)."""
    def over(unit: str, limit: int) -> DataFrame:
        g = log.groupBy(user, F.date_trunc(unit, F.col(ts)).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
        return g.filter(F.col("n") > limit).select(user, F.lit(unit).alias("unit"),
                                                    F.date_format("_w", TS_FMT).alias("window_start"), "n")
    return over("minute", per_minute).unionByName(over("second", per_second))


def request_key(fields: dict[str, Column], namespace: str = C.CACHE_NAMESPACE, app: str = "app") -> Column:
    """STR-4 key: ``app:namespace:sha1(canonical JSON)`` with keys sorted, no spaces."""
    payload = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    return F.concat(F.lit(f"{app}:{namespace}:"), F.sha1(payload))


def _keyed_rows(log: DataFrame, key_col: str, ts: str, id_col: str) -> DataFrame:
    """(id, key, t in microseconds) of the requests that have a key."""
    return log.select(F.col(id_col).cast("long").alias("id"), F.col(key_col).alias("key"),
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("key is not null")


def _keyless(log: DataFrame, key_col: str, id_col: str) -> DataFrame:
    """Requests without a key are never cached: all of them are misses."""
    return log.where(F.col(key_col).isNull()).select(
        F.col(id_col).cast("long").alias("event_id"), F.col(key_col).cast("string").alias("key"), F.lit(0).alias("hit"))


def with_runs(d: DataFrame, ttl_us: int) -> DataFrame:
    """``d`` (id, key, t) with ``b``, the time bucket of one TTL, and ``run``: a key's requests are
    cut wherever more than a TTL passes without one.  The request after such a gap is a miss
    whatever came before, so runs are independent.

    Gaps can only lie between buckets: the runs are numbered on one row per key and bucket."""
    d = d.withColumn("b", F.floor(F.col("t") / ttl_us))
    per = d.groupBy("key", "b").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    w = Window.partitionBy("key").orderBy("b")
    gap = F.coalesce(F.col("first") - F.lag("last").over(w) > ttl_us, F.lit(True))
    per = per.withColumn("_g", gap.cast("long")).select("key", "b", F.sum("_g").over(w).alias("run"))
    return d.join(per, ["key", "b"])


def _ttl_partition(ttl_us: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, expires = None, None  # state carried across Arrow batches of the sorted partition
        for pdf in batches:
            if pdf.empty:
                continue
            keys, runs = pdf["key"].to_numpy(), pdf["run"].to_numpy()
            ts = pdf["t"].to_numpy(dtype=np.int64)
            hit = np.zeros(len(pdf), dtype=np.int32)
            # stretches of one key and run inside the batch
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (runs[1:] != runs[:-1])])
            ends = np.r_[starts[1:], len(pdf)]
            for s, e in zip(starts, ends):
                if (keys[s], runs[s]) != cur:
                    cur, expires = (keys[s], runs[s]), None
                i = s
                while i < e:  # jump from miss to miss with a binary search
                    if expires is not None and ts[i] <= expires:
                        j = s + np.searchsorted(ts[s:e], expires, side="right")
                        hit[i:j] = 1
                        i = j
                        continue
                    expires = ts[i] + ttl_us  # a miss sets the entry
                    i += 1
            yield pd.DataFrame({"event_id": pdf["id"].to_numpy(), "key": keys, "hit": hit})
    return run


def ttl_dedupe(log: DataFrame, key_col: str = "key", ts: str = "ts", id_col: str = "event_id",
               ttl_s: int = C.CACHE_TTL_SECONDS, partitions: int | None = None) -> DataFrame:
    """STR-4 (batch): a request is a cache hit if it comes no later than ``last miss + ttl`` of
    its key; only a miss sets the entry, so expiry runs from the last miss.  Requests without a
    key are misses.  A key's runs (:func:`with_runs`) go to different tasks."""
    d = with_runs(_keyed_rows(log, key_col, ts, id_col), ttl_s * 1_000_000)
    d = d.repartition(partitions, "key", "run") if partitions else d.repartition("key", "run")
    d = d.select("id", "key", "run", "t").sortWithinPartitions("key", "run", "t", "id")
    scanned = d.mapInPandas(_ttl_partition(ttl_s * 1_000_000), "event_id long, key string, hit int")
    return scanned.unionAll(_keyless(log, key_col, id_col))


class CacheAudit(StatefulProcessor):
    """The cache entry of one key over event time.

    Requests wait until the watermark has passed them, so they are judged in time order whatever
    order they arrive in; rows later than the watermark never get here.  A timer at the earliest
    waiting request judges it; a timer at the entry's expiry removes the entry, so a key that is
    no longer asked for leaves nothing behind."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, id long")
        self.entry = handle.getValueState("entry", "expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(i)) for pdf in rows for t, i in zip(pdf["t"], pdf["id"], strict=True)]
        if key[0] is None:
            yield pd.DataFrame({"event_id": [i for _, i in new], "key": None, "hit": 0})
            return
        # Spark drops what is later than the watermark before; later than this one's is late as well
        now = timerValues.getCurrentWatermarkInMs() * 1000
        new = [r for r in new if r[0] > now or now <= 0]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(new)[0] // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(t), int(i)) for t, i in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= now]
        before = expires = int(self.entry.get()[0]) if self.entry.exists() else None
        hits = []
        for t, _ in due:
            hits.append(int(expires is not None and t <= expires))
            if not hits[-1]:
                expires = t + self.ttl_us
        if len(due) < len(rows):
            self.waiting.put(rows[len(due):])
            self.handle.registerTimer(-(-rows[len(due)][0] // 1000))
        elif due:
            self.waiting.clear()
        if expires is not None and expires <= now:
            self.entry.clear()
        elif expires != before:
            self.entry.update((expires,))
            self.handle.registerTimer(-(-expires // 1000))
        if due:
            yield pd.DataFrame({"event_id": [i for _, i in due], "key": key[0], "hit": hits})

    def close(self) -> None:
        pass


def ttl_dedupe_stream(log: DataFrame, key_col: str = "key", ts: str = "ts", id_col: str = "event_id",
                      ttl_s: int = C.CACHE_TTL_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """STR-4 (stream): the batch result of all rows that are not later than the watermark (those
    are dropped), each emitted once the watermark has passed it.  State per key: the requests of
    the last ``watermark`` and the current entry, both gone when their time is over.  Needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    d = log.select(F.col(id_col).cast("long").alias("id"), F.col(key_col).cast("string").alias("key"),
                   F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    d = d.withColumn("t", F.unix_micros("ts"))
    return d.groupBy("key").transformWithStateInPandas(
        CacheAudit(ttl_s * 1_000_000), outputStructType="event_id long, key string, hit int", outputMode="append",
        timeMode="EventTime")


def ttl_dedupe_parallel(log: DataFrame, key_col: str = "key", ts: str = "ts", id_col: str = "event_id",
                        ttl_s: int = C.CACHE_TTL_SECONDS) -> DataFrame:
    """STR-4 (batch) without putting a key's rows into one task.

    The misses of a key form the chain e0 -> next(e0) -> ..., where e0 is its first
    request and next(e) is its first request after ts(e) + ttl.  ``next`` is an
    as-of lookup done with running windows partitioned by (key, time bucket of width
    ttl), so a hot key is split by time; a request with no later request in its bucket
    falls back to the first request of the next non-empty bucket (one row per bucket).
    The chain is then enumerated by pointer doubling: J_0 = next, J_k = J_{k-1}(J_{k-1}),
    each round checkpointed into the shared checkpoint folder; positions 0..L-1 of every
    chain resolve through the bits of the position.  Everything else is a hit.  Every run of a key
    (:func:`with_runs`) starts a chain of its own, so chains are short and rounds few.  Requests
    without a key are misses.
    """
    import math

    from annualis.session import cut_lineage

    ttl_us = ttl_s * 1_000_000
    d = cut_lineage(with_runs(_keyed_rows(log, key_col, ts, id_col), ttl_us))
    ev = F.struct(F.col("t"), F.col("id"))
    # 1. next(e): probes at t + T meet the events of the same (key, bucket)
    events = d.select("key", "b", F.col("t").alias("x"), F.lit(1).alias("typ"),
                      F.col("id").alias("ord"), ev.alias("e"), F.lit(None).cast("long").alias("src"))
    probes = d.select("key", F.floor((F.col("t") + ttl_us) / ttl_us).alias("b"), (F.col("t") + ttl_us).alias("x"), F.lit(0).alias("typ"),
                      F.col("id").alias("ord"), F.lit(None).cast(events.schema["e"].dataType).alias("e"),
                      F.col("id").alias("src"))
    u = events.unionByName(probes)
    # descending scan, probes ahead of events: the running last non-null event is the first one after x
    w = (Window.partitionBy("key", "b").orderBy(F.col("x").desc(), F.col("typ"), F.col("ord").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    in_bucket = u.withColumn("_n", F.last("e", ignorenulls=True).over(w)).filter(F.col("typ") == 0) \
        .select("key", "b", "src", F.col("_n").alias("nb"))
    # first event of any later bucket (one row per (key, bucket): bounded by the time span)
    firsts = u.groupBy("key", "b").agg(F.min("e").alias("m"))
    wb = Window.partitionBy("key").orderBy(F.col("b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.withColumn("after", F.min("m").over(wb)).select("key", "b", "after")
    nxt = (in_bucket.join(after, ["key", "b"], "left")
           .select(F.col("src").alias("id"), F.coalesce("nb", "after")["id"].alias("nx")))
    # 2. chain length bound per run: min(requests, span / ttl + 1)
    per_key = d.groupBy("key", "run").agg(F.min(ev).alias("e0"), F.count(F.lit(1)).alias("n"),
                                   ((F.max("t") - F.min("t")) / ttl_us).cast("long").alias("span"))
    per_key = per_key.select("key", F.col("e0")["id"].alias("e0"), F.least("n", F.col("span") + 1).alias("L"))
    max_len = per_key.agg(F.max("L")).first()[0] or 0
    rounds = max(1, math.ceil(math.log2(max_len + 1)))
    jumps = [cut_lineage(nxt)]
    for _ in range(1, rounds):
        j = jumps[-1]
        jumps.append(cut_lineage(j.alias("a").join(j.alias("b"), F.col("a.nx") == F.col("b.id"), "left")
                                 .select(F.col("a.id").alias("id"), F.col("b.nx").alias("nx"))))
    # 3. position p of each run's chain = e0 moved by the set bits of p
    pos = per_key.select("key", F.col("e0").alias("cur"), F.explode(F.sequence(F.lit(0), F.col("L") - 1)).alias("p"))
    for k, j in enumerate(jumps):
        moved = pos.join(j, pos.cur == j.id, "left").select("key", "p", F.col("nx").alias("moved"), "cur")
        pos = moved.select("key", "p", F.when(F.col("p").bitwiseAND(1 << k) != 0, F.col("moved"))
                           .otherwise(F.col("cur")).alias("cur")).filter(F.col("cur").isNotNull())
        pos = cut_lineage(pos) if k % 4 == 3 else pos
    misses = pos.select(F.col("cur").alias("id")).distinct().withColumn("_miss", F.lit(1))
    out = d.join(misses, "id", "left")
    out = out.select(F.col("id").alias("event_id"), "key", F.when(F.col("_miss").isNull(), 1).otherwise(0).alias("hit"))
    return out.unionAll(_keyless(log, key_col, id_col))
