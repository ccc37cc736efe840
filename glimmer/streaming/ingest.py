"""Streaming ingest: landed export payloads to admitted, deduplicated, bounded resident tables.

A Structured Streaming query reads payload files; each micro-batch is decoded in parallel, admitted export by export
against what is resident, appended as Parquet and followed by retention. Duplicates and conflicts inside a batch and
against the resident set are one window over the natural key. The ceilings hold for all kinds together: what is
evicted is the oldest of any kind. A batch is committed by a manifest of its own, written aside and then renamed to a
name that did not exist, so a crash leaves the last committed batch whole, and a batch that is run again replaces what
it left. The resident tables, which the ceilings bound, are written anew by a batch that changes them; what only
batches before the last two needed is deleted after the commit.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glimmer.functions.columns import NO_SPAN, NO_TRACE
from glimmer.operators.retention import Ceilings, retention_tick_s, surviving
from glimmer.sources import otlp
from glimmer.sources.tables import KEY

PAYLOAD_SCHEMA = "export_id long, received_ns long, signal string, payload binary"
SIGNALS = ("traces", "logs", "metrics")


class AdmissionClock:
    """Strictly increasing nanoseconds; one reading stands for all records of an export."""

    def __init__(self, last: int = 0):
        self.last = last

    def reading(self) -> int:
        self.last = max(time.time_ns(), self.last + 1)
        return self.last


def _natural_key(signal: str) -> list:
    if signal == "traces":
        valid = (F.col("trace_id") != NO_TRACE) & (F.col("span_id") != NO_SPAN)
        return [F.when(valid, F.concat_ws("/", "trace_id", "span_id"))]
    if signal == "metrics":
        start = F.when(F.col("stream_kind") == "Gauge", F.lit("-")).otherwise(F.coalesce(F.col("start_ns").cast("string"), F.lit("-")))
        return [F.concat_ws("\x1f", "collapse_key", "attrs_key", start, F.col("time_ns").cast("string"), F.col("flags").cast("string"))]
    return [F.lit(None).cast("string")]


def _payload_key(signal: str):
    if signal == "traces":
        return F.to_json(F.struct("parent_span_id", "name", "kind", "start_ns", "end_ns", "flags", "status_code", "status_message", "detail", "attrs_key", "resource_key", "scope_key"))
    if signal == "metrics":
        return F.to_json(F.struct("identity_key", "payload_key", "value_int", "value_double"))
    return F.lit("")


@dataclass
class TelemetryStore:
    """Resident tables under one folder (a path that every executor reaches), opened again from their manifest."""

    spark: SparkSession
    path: str
    ceilings: Ceilings = field(default_factory=Ceilings)

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _committed(self) -> list[int]:
        """Committed batches, oldest first."""
        fs, at = self._fs(), self._p("manifest")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, batch: int | None = None) -> dict:
        """Of a committed batch, or of the last."""
        batches = self._committed()
        batch = batch if batch is not None else batches[-1] if batches else None
        if batch not in batches:
            return {"batch": -1, "serial": 0, "clock": 0, "tables": {}, "counters": {}, "evicted": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{batch:020d}.json", wholetext=True).first().value)

    def _commit(self, manifest: dict) -> None:
        fs = self._fs()
        fresh, kept = self._p(f"manifest/{manifest['batch']:020d}.writing"), self._p(f"manifest/{manifest['batch']:020d}.json")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(fresh, kept):
            raise RuntimeError(f"batch {manifest['batch']} could not be committed")

    def _clean(self, batch: int) -> None:
        """Delete what neither the last two manifests nor a batch to come needs."""
        fs = self._fs()
        for name in ("staged", "judged"):
            fs.delete(self._p(f"{name}/{batch}"), True)
        batches = self._committed()
        used = {at for b in batches[-2:] for at in self.manifest(b)["tables"].values()}
        for b in batches[:-2]:
            for at in set(self.manifest(b)["tables"].values()) - used:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(at), True)
            fs.delete(self._p(f"manifest/{b:020d}.json"), False)

    def resident(self, signal: str) -> DataFrame | None:
        at = self.manifest()["tables"].get(signal)
        return self.spark.read.parquet(at) if at else None

    def admit(self, payloads: DataFrame, batch: int) -> dict:
        """Admit one micro-batch; returns counts by signal and outcome. A batch that was committed is left alone."""
        state = self.manifest()
        if batch <= state["batch"]:
            return self.manifest(batch)["counters"].get(str(batch), {})
        clock = AdmissionClock(state["clock"])
        counters: dict[str, int] = {}
        tables = dict(state["tables"])
        serial = state["serial"]
        now = {signal: self.spark.read.parquet(at) for signal, at in tables.items()}
        fresh = set()
        for signal in SIGNALS:
            rows = otlp.decode(payloads, signal)
            staged = f"{self.path}/staged/{batch}/{signal}"
            rows.write.mode("overwrite").parquet(staged)
            rows = self.spark.read.parquet(staged)
            if not rows.limit(1).count():
                continue
            exports = [r.export_id for r in rows.select("export_id", "received_ns").distinct().orderBy("received_ns", "export_id").collect()]
            readings = self.spark.createDataFrame([(e, clock.reading(), i) for i, e in enumerate(exports)], "export_id long, admitted_at long, arrival long")
            good = rows.where("rejection is null").join(F.broadcast(readings), "export_id")
            good = good.withColumn("natural_key", *_natural_key(signal)).withColumn("equal_key", _payload_key(signal)).withColumn("old", F.lit(1))
            before = self.spark.read.parquet(tables[signal]) if signal in tables else None
            if before is not None:
                good = good.unionByName(before.where("natural_key is not null").select("natural_key", "equal_key", "resource_schema_url").withColumn("old", F.lit(0)), allowMissingColumns=True)
            w = Window.partitionBy("natural_key").orderBy("old", "arrival", "position")
            first = F.first("equal_key").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            url = F.first("resource_schema_url").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            alone = F.col("natural_key").isNull()
            # records without a natural key must not meet in one window group: they bypass it
            keyed = good.where(~alone)
            outcome = F.when(F.row_number().over(w) == 1, "admitted").when(F.col("equal_key") == first, "collapsed").otherwise("conflict")
            keyed = keyed.select("*", outcome.alias("outcome"), (~F.col("resource_schema_url").eqNullSafe(url)).alias("other_url"))
            judged = keyed.where("old = 1").unionByName(good.where(alone & (F.col("old") == 1)).select("*", F.lit("admitted").alias("outcome"), F.lit(False).alias("other_url")))
            at = f"{self.path}/judged/{batch}/{signal}"
            judged.write.mode("overwrite").parquet(at)
            judged = self.spark.read.parquet(at)
            for r in judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("other_url") & (F.col("outcome") == "collapsed"), 1)).alias("drift")).collect():
                counters[f"{signal}.{r.outcome}"] = r.n
                if r.drift:
                    counters[f"{signal}.provenance_drift"] = r.drift
            refused = rows.where("rejection is not null").count()
            if refused:
                counters[f"{signal}.rejected"] = refused
            admitted = judged.where("outcome = 'admitted'").drop("outcome", "other_url", "old")
            spans = signal == "traces"
            assigned = admitted.where("natural_key is null") if spans else admitted
            order = Window.partitionBy("export_id").orderBy("position")
            sizes = {r.export_id: r.n for r in assigned.groupBy("export_id").agg(F.count(F.lit(1)).alias("n")).collect()}
            begin, at_serial = [], serial
            for e in exports:
                begin.append((e, at_serial))
                at_serial += sizes.get(e, 0)
            serial = at_serial
            begins = self.spark.createDataFrame(begin, "export_id long, begin long")
            assigned = assigned.join(F.broadcast(begins), "export_id").withColumn("serial", F.col("begin") + F.row_number().over(order)).drop("begin")
            keyed_cols = [F.lit(1).alias("tag"), F.lit("").alias("trace_key"), F.lit("").alias("span_key")]
            out = assigned.select("*", *keyed_cols)
            if spans:
                natural = admitted.where("natural_key is not null").select("*", F.lit(0).cast("long").alias("serial"), F.lit(0).alias("tag"), F.col("trace_id").alias("trace_key"), F.col("span_id").alias("span_key"))
                out = out.unionByName(natural)
            if signal == "metrics":
                out = out.withColumn("stream_key", F.col("identity_key"))
            now[signal] = out if before is None else before.unionByName(out, allowMissingColumns=True)
            fresh.add(signal)
        evicted: dict[str, int] = {}
        if fresh:
            oldest = self._oldest_kept(now)
            for signal, whole in now.items():
                stays = F.lit(False) if oldest is None else F.struct(*KEY) >= F.struct(*(F.lit(oldest[c]).cast(whole.schema[c].dataType).alias(c) for c in KEY))
                gone = whole.where(~stays).count()
                if gone:
                    evicted[signal] = gone
                if gone or signal in fresh:
                    tables[signal] = f"{self.path}/resident/{signal}/{batch}"
                    whole.where(stays).write.mode("overwrite").parquet(tables[signal])
        self._commit({"batch": batch, "serial": serial, "clock": clock.last, "tables": tables, "counters": {str(batch): counters}, "evicted": evicted})
        self._clean(batch)
        return counters

    def _oldest_kept(self, now: dict[str, DataFrame]):
        """The first row, of any kind, that the ceilings let stay."""
        light = None
        for whole in now.values():
            extra = [F.col(c) if c in whole.columns else F.lit(None).cast(t).alias(c) for c, t in (("stream_key", "string"), ("identity_bytes", "long"))]
            own = whole.select(*KEY, "accounted_bytes", *extra).withColumn("stream_key", F.coalesce("stream_key", F.concat_ws("/", F.lit("record"), *KEY)))
            light = own if light is None else light.unionByName(own)
        return surviving(light, self.ceilings).orderBy(*KEY).first()

    def start(self, landing: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """The streaming query; with ``available_now`` it drains what has landed and ends."""
        source = self.spark.readStream.schema(PAYLOAD_SCHEMA).parquet(landing)
        writer = source.writeStream.foreachBatch(lambda df, batch: self.admit(df, batch) and None).option("checkpointLocation", checkpoint)
        if available_now:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=f"{int(retention_tick_s(self.ceilings.window_ns / 1e9))} seconds").start()
