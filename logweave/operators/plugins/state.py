"""Plugins with a state that viewers see, and commands that act on it."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ...functions import columns as C
from ..filters import Filter
from . import export, file_transfer


@dataclass
class State:
    """What a plugin shows, as values that JSON has; generation counts its changes, so that a viewer asks only for what is new."""

    generation: int = 0
    value: dict = field(default_factory=dict)
    commands: dict[str, Callable[[dict], bool]] = field(default_factory=dict)

    def set(self, value: dict) -> None:
        if value != self.value:
            self.value = value
            self.generation += 1


class Export:
    """Writes the selected messages to a folder of binary traces, information about lifecycles' contexts first, and passes all on.

    Configuration: name, exportFileName (the folder), filters, lifecyclesToKeep (ecu, startTime, endTime, optional resumeTime, in us),
    recordedTimeFromMs, recordedTimeToMs, indexFrom, indexTo, enabled. The number of messages is counted in the pass that writes.
    """

    def __init__(self, config: dict):
        self.name, self.folder = config["name"], config["exportFileName"]
        self.filters = [f for f in (Filter.from_json(x) for x in config["filters"]) if f.enabled]
        self.keep = [(x["ecu"], x["startTime"], x["endTime"], x.get("resumeTime")) for x in config.get("lifecyclesToKeep", [])]
        ms = lambda k: None if config.get(k) is None else int(config[k]) * 1000
        self.span = (ms("recordedTimeFromMs"), ms("recordedTimeToMs"), config.get("indexFrom"), config.get("indexTo"))
        self.lifecycles: DataFrame | None = None
        self.state = State()
        self.state.set({"name": self.name, "exported": 0, "folder": self.folder})

    def use_lifecycles(self, lifecycles: DataFrame) -> None:
        self.lifecycles = lifecycles

    def __call__(self, msgs: DataFrame) -> DataFrame:
        from ...plans import sinks

        kept = None
        if self.keep:
            if self.lifecycles is None:
                raise ValueError("lifecyclesToKeep needs a session's lifecycles")
            wanted = msgs.sparkSession.createDataFrame([(bytearray(e.encode()[:4].ljust(4, b"\0")), s, t, r) for e, s, t, r in self.keep], "ecu binary, start_us long, end_us long, resume_us long")
            kept = export.same_lifecycles(self.lifecycles, wanted)
        some = export.select(msgs, self.filters, kept, *self.span).withColumn("_last", ~F.col("info_first"))
        counted = Observation(f"exported {self.folder}")
        n = int(msgs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        some = some.repartitionByRange(n, "_last", "index").observe(counted, F.count("*").alias("n"))  # behind the sort, which reads its input twice
        sinks.write_parts(some, self.folder, ["_last", "index"])
        self.state.set({"name": self.name, "exported": counted.get["n"], "folder": self.folder})
        return msgs


class Transfers:
    """File transfers in the messages; drops their data packages unless keepFLDA is set.

    Commands: save {ecu, lifecycle, serial, saveAs} writes one complete file, saveAll {folder, pattern} all that match, never over others.
    """

    def __init__(self, config: dict):
        self.name, self.keep_data = config["name"], config.get("keepFLDA", False)
        self.apid, self.ctid = config.get("apid"), config.get("ctid")
        self.found: DataFrame | None = None
        self.state = State(commands={"save": self._save, "saveAll": self._save_all})
        self.state.set({"name": self.name, "treeItems": []})

    def __call__(self, msgs: DataFrame) -> DataFrame:
        self.found = file_transfer.transfers(msgs, self.apid, self.ctid)
        return msgs if self.keep_data else file_transfer.without_data(msgs)

    def refresh(self, most: int = 1000) -> State:
        """The state with the first `most` transfers as tree items (a viewer's list) and the number of all."""
        if self.found is not None:
            rows = self.found.select(C.id_text(F.col("ecu")).alias("ecu"), "lifecycle", "serial", "name", "size", "state", "first_index")
            items = [{"label": f"{r['name']} ({r['state']})", "meta": r.asDict()} for r in rows.orderBy("first_index").limit(most).collect()]
            self.state.set({"name": self.name, "treeItems": items, "count": rows.count() if len(items) == most else len(items)})
        return self.state

    def _save(self, params: dict) -> bool:
        if self.found is None or os.path.exists(params["saveAs"]):
            return False
        one = self.found.where((C.id_text(F.col("ecu")) == params["ecu"]) & (F.col("lifecycle") == params["lifecycle"]) & (F.col("serial") == params["serial"]) & (F.col("state") == "Complete"))
        row = one.select("data").first()
        if row is None:
            return False
        with open(params["saveAs"], "wb") as f:
            f.write(row["data"])
        return True

    def _save_all(self, params: dict) -> bool:
        return self.found is not None and bool(file_transfer.save(self.found, params["folder"], params.get("pattern", "*")))
