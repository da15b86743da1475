"""Running cases on a stream with timers: state per case, expiry, scores, an idempotent sink.

``case_states`` keeps one state per running case and updates it with every micro-batch; events go to Python, and
states come back, as one JSON text each.  Cases are dealt into ``GROUPS`` by a hash, and a call handles one group, so that a
small case costs little more than its events; the state store holds the states of a group's cases as one compressed text, of which
only those with events or a due timer are read.  A
case whose last event is ``idle`` older than the watermark is finished: its timer fires, its last state is
given out as ``expired``, and the state store forgets it, so the store holds running
cases only.  A group's timer is the first of its cases' timers.  Events older than the watermark are late and dropped.

A state holds counts, sums, a running mean and squared deviation, extremes, and first and last values by
``(ts, tiebreak)``, so an event out of order never overwrites a later one.
``state_features`` turns states into the encoder's columns of the static, last,
agg and bool encodings, on which a scoring bundle predicts.

``upsert`` writes each micro-batch into a folder of its own, replacing what an earlier attempt
of the same batch left, and ``current`` reads the newest row of each case; ``compact`` folds the
batches into one table, after which they go.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from procmon.operators import bundle as B
from procmon.operators import encode as E
from procmon.functions.time import epoch_micros
from procmon.spec import LogSpec, col

EVENT_TIME = "_event_time"
# Groups that cases are dealt into; a stream goes on from its checkpoint only with the same number.
GROUPS = 4096


# -- the state of a case ------------------------------------------------------------


def state_schema(spec: LogSpec, vocab: E.Vocab) -> T.StructType:
    """The columns of a given-out state."""
    text, number, time = T.StringType(), T.DoubleType(), T.TimestampNTZType()
    out = [(spec.case, text), ("status", text), ("n_events", T.LongType()), ("first_activity", text), ("last_activity", text), ("start_ts", time), ("last_ts", time)]
    for c in spec.dynamic_num:
        out += [(f"n_{c}", T.LongType()), *((f"{k}_{c}", number) for k in ("sum", "mean", "std", "min", "max", "last"))]
    for c in spec.dynamic_cat:
        out += [(f"last_{c}", text), *((f"count_{c}_{lv}", T.LongType()) for lv in vocab[c])]
    out += [(f"first_{c}", number) for c in spec.static_num] + [(f"first_{c}", text) for c in spec.static_cat]
    return T.StructType([T.StructField(n, t) for n, t in dict(out).items()])


def _number(v):
    """A number of an event, which JSON holds as text if it is not finite."""
    return None if v is None else float(v)


def _null(v) -> bool:
    return v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v)


def new_state() -> dict:
    return {"n": 0, "first": None, "last": None, "num": {}, "cat": {}, "static": {}}


def add_event(s: dict, event: dict, at: list, spec: LogSpec, vocab: E.Vocab) -> None:
    """Update a state with an event at ``at`` = [microseconds, tiebreak]; the order of calls does not matter but for rounding."""
    s["n"] += 1
    if s["first"] is None or at < s["first"][0]:
        s["first"] = [at, event[spec.activity]]
    if s["last"] is None or at >= s["last"][0]:
        s["last"] = [at, event[spec.activity]]
    for c in spec.dynamic_num:
        if _null(x := event[c]):
            continue
        x = float(x)
        m = s["num"].setdefault(c, {"n": 0, "sum": 0.0, "mean": 0.0, "m2": 0.0, "min": x, "max": x, "last": None})
        m["n"] += 1
        m["sum"] += x
        step = x - m["mean"]
        m["mean"] += step / m["n"]
        m["m2"] += step * (x - m["mean"])
        m["min"], m["max"] = min(m["min"], x), max(m["max"], x)
        if m["last"] is None or at >= m["last"][0]:
            m["last"] = [at, x]
    for c in spec.dynamic_cat:
        if _null(v := event[c]):
            continue
        k = s["cat"].setdefault(c, {"last": None, "count": {}})
        if k["last"] is None or at >= k["last"][0]:
            k["last"] = [at, v]
        if v in vocab[c]:
            k["count"][v] = k["count"].get(v, 0) + 1
    for c in (*spec.static_num, *spec.static_cat):
        if not _null(v := event[c]) and (c not in s["static"] or at < s["static"][c][0]):
            s["static"][c] = [at, v]


def state_row(s: dict, key: str, status: str, spec: LogSpec, vocab: E.Vocab) -> dict:
    time = lambda at: pd.Timestamp(at[0], unit="us")
    out = {spec.case: key, "status": status, "n_events": s["n"], "first_activity": s["first"][1], "last_activity": s["last"][1], "start_ts": time(s["first"][0]), "last_ts": time(s["last"][0])}
    for c in spec.dynamic_num:
        m = s["num"].get(c)
        out[f"n_{c}"] = m["n"] if m else 0
        out |= {f"{k}_{c}": m[k] if m else None for k in ("sum", "mean", "min", "max")}
        out[f"std_{c}"] = math.sqrt(max(m["m2"], 0.0) / (m["n"] - 1)) if m and m["n"] > 1 else 0.0
        out[f"last_{c}"] = m["last"][1] if m else None
    for c in spec.dynamic_cat:
        k = s["cat"].get(c) or {"last": [None, None], "count": {}}
        out[f"last_{c}"] = k["last"][1]
        out |= {f"count_{c}_{lv}": k["count"].get(lv, 0) for lv in vocab[c]}
    return out | {f"first_{c}": s["static"].get(c, [None, None])[1] for c in (*spec.static_num, *spec.static_cat)}


def _packed(held: dict) -> bytes:
    """The states of a group (key -> when its timer is due, state), one line each; all parts are JSON, which has no tabs or line ends."""
    return zlib.compress("\n".join(f"{due}\t{key}\t{s}" for key, (due, s) in held.items()).encode(), 1)


def _held(packed: bytes) -> dict:
    """The inverse of ``_packed``; states stay texts."""
    lines = (line.split("\t", 2) for line in zlib.decompress(packed).decode().split("\n"))
    return {key: (int(due), s) for due, key, s in lines}


def case_states(source: DataFrame, spec: LogSpec, vocab: E.Vocab, idle: int, delay: str) -> DataFrame:
    """R2: a stream of case states (``state_schema``), one row for each case that a micro-batch touches or whose timer fires.

    ``idle`` is the time in milliseconds after which a case without events is finished; events more
    than ``delay`` (an interval such as ``"2 hours"``) behind the newest one are late.
    """
    schema = state_schema(spec, vocab)
    texts, numbers = dict.fromkeys([spec.activity, *spec.cat_cols]), dict.fromkeys(spec.num_cols)
    event = {c: col(c).cast("string") for c in texts} | {c: col(c).cast("double") for c in numbers}
    at = F.struct(F.coalesce(epoch_micros(col(spec.ts)), F.lit(-(1 << 63))).alias("us"), col(spec.tiebreak).cast("long").alias("tie"))

    def update(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, rows, fed = state.getCurrentWatermarkMs(), [], {}
        held = _held(state.get[0]) if state.exists else {}

        def give(key: str, s: dict, status: str) -> None:
            row = {k: None if _null(v) else v for k, v in state_row(s, json.loads(key), status, spec, vocab).items()}
            rows.append(json.dumps(row, default=str))

        for part in () if state.hasTimedOut else parts:
            for text in part["e"]:
                e = json.loads(text)
                key = json.dumps(e.get("k"))
                if key not in fed:
                    fed[key] = json.loads(held[key][1]) if key in held else new_state()
                add_event(fed[key], {c: e["v"].get(c) for c in texts} | {c: _number(e["v"].get(c)) for c in numbers}, [e["at"]["us"], e["at"]["tie"]], spec, vocab)
        for key, s in fed.items():
            held[key] = (max(s["last"][0][0] // 1000 + idle, now + 1), json.dumps(s))
            give(key, s, "open")
        for key in [k for k, (due, _) in held.items() if due < now]:
            give(key, json.loads(held.pop(key)[1]), "expired")
        if held:
            state.update((_packed(held),))
            state.setTimeoutTimestamp(min(due for due, _ in held.values()))
        else:
            state.remove()
        yield pd.DataFrame({"row": rows})

    k = col(spec.case).cast("string")
    packed = F.to_json(F.struct(k.alias("k"), at.alias("at"), F.struct(*(c.alias(n) for n, c in event.items())).alias("v")))
    group = F.pmod(F.xxhash64(k), F.lit(GROUPS)).cast("int")
    timed = source.select(group.alias("g"), packed.alias("e"), col(spec.ts).cast("timestamp").alias(EVENT_TIME)).withWatermark(EVENT_TIME, delay)
    rows = timed.groupBy("g").applyInPandasWithState(update, "row string", "s binary", "update", GroupStateTimeout.EventTimeTimeout)
    # times are read by a cast, which takes all six digits of a second
    wire = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType) for f in schema])
    return rows.select(F.from_json("row", wire).alias("r")).select(*(F.col("r")[f.name].cast(f.dataType).alias(f.name) for f in schema))


def state_features(states: DataFrame, spec: LogSpec, vocab: E.Vocab, method: str) -> DataFrame:
    """States as encoded prefixes: (case, prefix_len, the columns of a static, last, agg or bool encoding or a union of them)."""
    zero = lambda c: F.coalesce(col(c), F.lit(0.0))
    out: dict = {}
    for part in E.METHODS[method]:
        if part == "static":
            out |= {f"static__{c}": zero(f"first_{c}") for c in spec.static_num}
            for c in spec.static_cat:
                out |= E.one_hot(col(f"first_{c}"), vocab[c], f"static__{c}")
        elif part == "last":
            out |= {f"last__{c}": zero(f"last_{c}") for c in spec.dynamic_num}
            for c in spec.dynamic_cat:
                out |= E.one_hot(col(f"last_{c}"), vocab[c], f"last__{c}")
        elif part in ("agg", "bool"):
            out |= {f"{part}__{k}_{c}": zero(f"{k}_{c}") for c in spec.dynamic_num for k in ("mean", "max", "min", "sum", "std")}
            for c in spec.dynamic_cat:
                for lv in vocab[c]:
                    n = col(f"count_{c}_{lv}").cast("double")
                    out[f"{part}__{c}_{lv}"] = n if part == "agg" else F.least(n, F.lit(1.0))
        else:
            raise ValueError(f"states hold no {part} encoding")
    return states.select(col(spec.case).alias(spec.case), F.col("n_events").cast("int").alias("prefix_len"), *(c.alias(n) for n, c in out.items()))


# -- the sink ---------------------------------------------------------------------------


def _folder(path: str, kind: str, number: int) -> str:
    return f"{path}/{kind}-{number:012d}"


def upsert(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch; a repeated attempt replaces the rows of the first."""
    batch.write.mode("overwrite").parquet(_folder(path, "batch", batch_id))


def _listed(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest complete snapshot (-1: none) and the complete batches after it."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = [n.rsplit("-", 1) for n in names if fs.exists(jvm.Path(f"{path}/{n}/_SUCCESS"))]
    snapshot = max((int(n) for kind, n in done if kind == "snapshot"), default=-1)
    return snapshot, sorted(int(n) for kind, n in done if kind == "batch" and int(n) > snapshot)


def current(spark: SparkSession, path: str, spec: LogSpec) -> DataFrame:
    """The newest row of every case."""
    snapshot, batches = _listed(spark, path)
    parts = [spark.read.parquet(_folder(path, kind, n)).withColumn("batch_id", F.lit(n)) for kind, n in [*([("snapshot", snapshot)] if snapshot >= 0 else []), *(("batch", n) for n in batches)]]
    if not parts:
        raise ValueError(f"{path} has no batch")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    names = [c for c in rows.columns if c not in (spec.case, "batch_id")]
    newest = rows.groupBy(col(spec.case).alias(spec.case)).agg(F.max_by(F.struct(*(col(c) for c in names)), "batch_id").alias("s"))
    return newest.select(col(spec.case), *(F.col(f"s.`{c}`").alias(c) for c in names))


def compact(spark: SparkSession, path: str, spec: LogSpec) -> None:
    """Fold snapshot and batches into a new snapshot, then delete them; a compaction that is lost on the way changes nothing."""
    snapshot, batches = _listed(spark, path)
    if not batches:
        return
    current(spark, path, spec).write.mode("overwrite").parquet(_folder(path, "snapshot", batches[-1]))
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, n in [*([("snapshot", snapshot)] if snapshot >= 0 else []), *(("batch", n) for n in batches)]:
        fs.delete(jvm.Path(_folder(path, kind, n)), True)


def run_cases(source: DataFrame, spec: LogSpec, vocab: E.Vocab, path: str, checkpoint: str, idle: int, delay: str, bundle: B.Bundle | None = None):
    """Start the stream: states of each micro-batch go to ``path``, with ``predicted`` if a bundle is given (NULL for expired cases)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        if bundle is not None:
            batch = kept = batch.persist()
            scores = B.score_prefixes(bundle, state_features(batch.where("status = 'open'"), spec, vocab, bundle.method))
            batch = batch.join(scores.select(F.col("case_id").alias(spec.case), "predicted"), spec.case, "left")
        upsert(batch, batch_id, path)
        if bundle is not None:
            kept.unpersist()

    stream = case_states(source, spec, vocab, idle, delay).writeStream.outputMode("update").foreachBatch(sink)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
