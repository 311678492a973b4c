"""Change feeds: what a stream's results changed to, generation by generation, and the table that they add up to.

A generation is a trigger of the query. Its rows are those that changed, as they are now; `gone` marks a row that is no more.
They are written under the generation's number, over what an attempt that failed may have left there, so that each counts
once. Folding a feed up to a generation gives what a batch over the same input gives.
"""

from __future__ import annotations

import pickle
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import Limits, Machine, Row, detection_input
from ..operators.scan import hadoop

LIFECYCLES = "ecu binary, first_index long, nr_msgs long, nr_control_req_msgs long, start_time_us long, initial_start_time_us long, min_timestamp_us long, max_timestamp_us long, last_reception_time_us long, resume_from long, sw_version string, certain boolean, gone boolean"


def publish(changes: DataFrame, folder: str, checkpoint: str, seconds: float | None = None) -> StreamingQuery:
    """Writes a stream in update mode as a feed; all that is there and no more (seconds None), or a generation each so many seconds."""

    def write(batch: DataFrame, generation: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/generation={generation}")

    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The feed with its generations, behind a snapshot if there is one."""
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)


def fold(feed: DataFrame, keys: list[str], upto: int | None = None) -> DataFrame:
    """The latest row of each key, without those that are gone, as of a generation."""
    some = feed if upto is None else feed.where(F.col("generation") <= upto)
    value = F.struct(*[c for c in feed.columns if c not in keys and c != "generation"])
    latest = some.groupBy(*keys).agg(F.max_by(value, "generation").alias("_v")).select(*keys, "_v.*")
    return latest.where("not gone").drop("gone") if "gone" in feed.columns else latest


def compact(spark: SparkSession, folder: str, schema, keys: list[str], upto: int) -> int:
    """Replaces the generations up to one by their latest rows, under that one's number; returns how many folders went.

    The snapshot is complete before the first of the others goes; a reader sees rows twice at most, which fold() takes as one.
    """
    fs, at = hadoop(spark, folder)
    old = sorted(int(str(f.getPath().getName()).split("=")[1]) for f in fs.listStatus(at) if str(f.getPath().getName()).startswith("generation="))
    old = [g for g in old if g <= upto]
    if len(old) < 2:
        return 0
    feed = read(spark, folder, schema).where(F.col("generation") <= upto)
    value = F.struct(*[c for c in feed.columns if c not in keys and c != "generation"])
    latest = feed.groupBy(*keys).agg(F.max_by(value, "generation").alias("_v")).select(*keys, "_v.*")
    made = f"{folder}/_snapshot"
    latest.write.mode("overwrite").parquet(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.delete(path(f"{folder}/generation={old[-1]}"), True)
    fs.rename(path(made), path(f"{folder}/generation={old[-1]}"))
    for g in old[:-1]:
        fs.delete(path(f"{folder}/generation={g}"), True)
    return len(old) - 1


def lifecycle_changes(msgs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A stream of the lifecycles that a trigger's messages began, changed or merged away (gone); certain: it can't be merged any more."""
    import pandas as pd

    names = [c.split(" ")[0] for c in LIFECYCLES.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, sent = pickle.loads(state.get[0]) if state.exists else (Machine(limits), {})
        rows = pd.concat(list(parts)).sort_values("index")
        for x in rows[["index", "ecu", "reception", "uptime", "has_uptime", "request", "version"]].itertuples(index=False, name=None):
            r = Row(*x)
            r.ecu, r.version = bytes(r.ecu), r.version if isinstance(r.version, str) else None
            for _ in machine.add(r):
                pass
        lcs = machine.by_ecu.get(bytes(key[0]), [])
        first = {lc.id: lc.first_index for lc in lcs} | {k: v[1] for k, v in sent.items()}
        now = {}
        for lc in lcs:
            before = sent[lc.id][9] if lc.id in sent else None  # the one it resumes may have been let go
            resumed = first.get(lc.resume[0], before) if lc.resume else None
            now[lc.id] = (lc.ecu, lc.first_index, *lc.row()[2:9], resumed, lc.version, lc.id not in machine.open, False)
        gone = [(*v[:-1], True) for k, v in sent.items() if k not in now]
        changed = [v for k, v in now.items() if sent.get(k) != v]
        at = next((i for i, lc in enumerate(lcs) if lc.id in machine.open or not lc.given), len(lcs))
        keep = lcs[max(0, min(at - 1, len(lcs) - 2)) :]  # those before change no more
        machine.by_ecu[bytes(key[0])] = keep
        state.update((pickle.dumps((machine, {lc.id: now[lc.id] for lc in keep})),))
        if gone or changed:
            yield pd.DataFrame(gone + changed, columns=names).astype({"resume_from": "Int64"})

    rows = detection_input(msgs)
    return rows.groupBy("ecu").applyInPandasWithState(run, LIFECYCLES, "machine binary", "update", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """The latest progress of each running query by name: its batch, rows, rows a second and rows in state. add_to(spark) begins."""

    def __init__(self):
        self.latest: dict[str, dict] = {}
        self.ended: dict[str, str | None] = {}
        self._lock = threading.Lock()

    def add_to(self, spark: SparkSession) -> Progress:
        spark.streams.addListener(self)
        return self

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.latest[event.name or str(event.id)] = {"batch": -1, "rows": 0, "rows_per_second": 0.0, "state_rows": 0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            before = self.latest.get(p.name or str(p.id), {})
            self.latest[p.name or str(p.id)] = {"batch": p.batchId, "rows": before.get("rows", 0) + p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.ended[str(event.id)] = event.exception
