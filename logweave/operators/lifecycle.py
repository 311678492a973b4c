"""Lifecycle detection: boot sessions of ECUs from reception times and uptimes.

One state machine serves batch and streaming. In batch each ECU is cut into segments that no rule reaches across, and a
machine takes one at a time (mode "per_ecu"); long quiet stretches come to it as blocks, which native aggregates make. Mode
"exact" puts all ECUs into one group: confirmation looks at the clock of all ECUs together, which only matters for late
merges. The rows that go to Python are small (times and flags, no payloads); what comes back are the lifecycles.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from .scan import block_of, running, staged

US = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Thresholds in microseconds."""

    buffering: int = 60 * US
    resume_gap: int = 10 * US
    resume_buffering: int = 30 * US
    overlap: int = 2 * US
    overlap_least: int = 10 * US
    check_every: int = US


@dataclass(slots=True)
class Row:
    """What detection needs of a message."""

    index: int
    ecu: bytes
    reception: int
    uptime: int
    has_uptime: bool
    request: bool
    version: str | None = None
    lifecycle: int = 0


@dataclass(slots=True)
class Block:
    """Rows of one ECU in a row that all have an uptime or are requests, by what detection needs of them together."""

    nr_msgs: int
    nr_requests: int
    least_start: int
    greatest_start: int
    least_uptime: int
    greatest_uptime: int
    first_reception: int
    last_reception: int
    greatest_reception: int
    greatest_gap: int
    version: str | None = None


@dataclass
class Lifecycle:
    id: int
    ecu: bytes
    start: int
    initial_start: int
    min_uptime: int
    max_uptime: int
    last_reception: int
    nr_msgs: int = 1
    nr_requests: int = 0
    resume: tuple[int, int, int] | None = None  # id, largest uptime and start of the one it resumes
    version: str | None = None
    first_index: int = 0
    given: bool = False  # one of its rows was given out
    into: Lifecycle | None = None  # what it was merged into

    @property
    def end(self) -> int:
        """When its last message was logged, as far as uptimes tell."""
        return self.start + self.max_uptime if self.max_uptime else self.last_reception

    @property
    def suspended(self) -> int:
        return max(0, self.start - self.resume[2]) if self.resume else 0

    @property
    def final(self) -> Lifecycle:
        lc = self
        while lc.into is not None:
            lc = lc.into
        return lc

    def overlaps_slightly(self, start: int, lim: Limits) -> bool:
        return start <= self.end < start + lim.overlap and self.end > self.start + lim.overlap_least

    def resumes(self, reception: int, uptime: int, start: int, lim: Limits) -> bool:
        """Whether a message goes on where this one was suspended."""
        gap = reception - self.last_reception
        return gap >= lim.resume_gap and uptime >= self.max_uptime and start >= self.start + lim.resume_gap and gap + lim.resume_buffering > start - self.start

    def row(self) -> tuple:
        return (self.id, self.ecu, self.nr_msgs, self.nr_requests, self.start, self.initial_start, self.min_uptime, self.max_uptime, self.last_reception, self.resume, self.version)


class Machine:
    """Takes rows in arrival order and gives them out in that order once their lifecycle is certain."""

    def __init__(self, limits: Limits = Limits()):
        self.lim, self.next_id = limits, 1
        self.by_ecu: dict[bytes, list[Lifecycle]] = {}
        self.waiting: deque[tuple[Row, Lifecycle]] = deque()
        self.open: dict[int, Lifecycle] = {}  # lifecycles that may still be merged
        self.next_check = 0

    def _begin(self, r: Row, resumed: Lifecycle | None = None) -> Lifecycle:
        up = 0 if r.request or r.uptime > r.reception else r.uptime
        lc = Lifecycle(self.next_id, r.ecu, r.reception - up, r.reception - up, up, up, r.reception, nr_requests=int(r.request), first_index=r.index)
        if resumed:
            lc.resume = (resumed.id, resumed.max_uptime, resumed.start)
        self.next_id += 1
        self.open[lc.id] = lc
        self.by_ecu.setdefault(r.ecu, []).append(lc)
        return lc

    def _update(self, lc: Lifecycle, r: Row) -> Lifecycle:
        """Adds r to lc; the lifecycle r is in then, which may be a new one."""
        if r.request:
            lc.nr_msgs += 1
            lc.nr_requests += 1
            return lc
        start = max(0, r.reception - r.uptime)
        belongs = not r.has_uptime or (start <= lc.end and not lc.overlaps_slightly(start, self.lim))
        if belongs and lc.start - start > self.lim.buffering and lc.max_uptime > 0:
            lc.nr_msgs += 1  # its uptime is implausible: counted, but no time follows from it
            return lc
        resumes = lc.resumes(r.reception, r.uptime, start, self.lim)
        if resumes or not belongs:
            return self._begin(r, lc if resumes else None)
        if r.uptime < lc.min_uptime and (lc.resume is None or r.uptime > lc.resume[1]):
            lc.min_uptime = r.uptime
        if r.uptime > lc.max_uptime:
            lc.max_uptime = r.uptime
        elif lc.resume and r.uptime < lc.resume[1] - lc.resume[1] // 8:
            lc.resume = None
        lc.last_reception, lc.start = r.reception, min(lc.start, start)
        lc.nr_msgs += 1
        if lc.version is None and r.version is not None:
            lc.version = r.version
        return lc

    def _merge(self, into: Lifecycle, lc: Lifecycle) -> None:
        into.nr_msgs += lc.nr_msgs
        into.nr_requests += lc.nr_requests
        into.max_uptime, into.min_uptime = max(into.max_uptime, lc.max_uptime), min(into.min_uptime, lc.min_uptime)
        if lc.start < into.start:
            into.start, into.initial_start = lc.start, lc.initial_start
        into.last_reception = max(into.last_reception, lc.last_reception)
        into.version = into.version if into.version is not None else lc.version
        lc.into = into  # its waiting rows are of that one from now on
        self.open.pop(lc.id, None)

    def _place(self, r: Row) -> tuple[Lifecycle, bool]:
        """The lifecycle of r, and whether that is the outcome of a merge."""
        mine = self.by_ecu.get(r.ecu)
        if not mine:
            return self._begin(r), False
        last = mine[-1]
        lc = self._update(last, r)
        if lc is last and len(mine) > 1:
            before = mine[-2]
            overlap = lc.start <= before.end and lc.resume is None and not before.overlaps_slightly(lc.start, self.lim)
            if overlap and (before.id in self.open or not lc.given):
                self._merge(before, lc)
                mine.pop()
                return before, True
        return lc, False

    def add(self, r: Row) -> Iterator[Row]:
        lc, merged = self._place(r)
        if merged and not self.open:
            yield from self._ready()
        if self.next_check < r.reception:
            if r.reception > r.uptime + self.lim.buffering:
                self._confirm(r)
                yield from self._ready()
            self.next_check = r.reception + self.lim.check_every
        if self.open:
            self.waiting.append((r, lc))
        else:
            lc.given, r.lifecycle = True, lc.id
            yield r

    def _certain(self, lc: Lifecycle, r: Row) -> bool:
        earliest = r.reception - r.uptime - self.lim.buffering
        return (lc.ecu == r.ecu and lc.start < earliest) or lc.max_uptime - lc.min_uptime > self.lim.buffering or r.reception - self.lim.buffering > lc.end

    def _confirm(self, r: Row) -> None:
        for lc in [x for x in self.open.values() if self._certain(x, r)]:
            del self.open[lc.id]

    def _ready(self) -> Iterator[Row]:
        """The rows up to the first of a lifecycle that may still be merged."""
        while self.waiting and (lc := self.waiting[0][1].final).id not in self.open:
            r, _ = self.waiting.popleft()
            lc.given, r.lifecycle = True, lc.id
            yield r

    def finish(self) -> Iterator[Row]:
        self.open.clear()
        yield from self._ready()

    def lifecycles(self) -> list[Lifecycle]:
        return [lc for lcs in self.by_ecu.values() for lc in lcs]


def detect_rows(rows: Iterable[Row], limits: Limits = Limits()) -> tuple[list[Row], list[Lifecycle]]:
    m = Machine(limits)
    out = [x for r in rows for x in m.add(r)]
    return out + list(m.finish()), m.lifecycles()


class Track(Machine):
    """The machine for the lifecycles of one ECU alone: it holds lifecycles, which follow one another, instead of rows, and takes blocks of rows.

    A block is taken as a whole only where each of its rows would do no more than widen the last lifecycle. When the next
    check is due is known only within a second after a block; `unsure` says that this could make a difference, so that the
    blocks have to be taken apart.
    """

    def __init__(self, limits: Limits = Limits()):
        super().__init__(limits)
        self.latest_check = 0  # next_check is at least that, and at most this
        self.unsure = False

    def add(self, r: Row) -> None:
        lc, merged = self._place(r)
        if merged and not self.open:
            self._pass_on()
        if self.next_check < r.reception <= self.latest_check:
            self.unsure |= r.reception > r.uptime + self.lim.buffering and any(self._certain(x, r) for x in self.open.values())
            self.latest_check = max(self.latest_check, r.reception + self.lim.check_every)
        elif self.latest_check < r.reception:
            if r.reception > r.uptime + self.lim.buffering:
                self._confirm(r)
                self._pass_on()
            self.next_check = self.latest_check = r.reception + self.lim.check_every
        if not self.open:
            lc.given = True
        elif not self.waiting or self.waiting[-1] is not lc:
            self.waiting.append(lc)

    def finish(self) -> None:
        self.open.clear()
        self._pass_on()

    def _pass_on(self) -> None:
        while self.waiting and (lc := self.waiting[0].final).id not in self.open:
            self.waiting.popleft()
            lc.given = True

    def add_block(self, ecu: bytes, b: Block) -> bool:
        """Takes a block, or refuses it and changes nothing."""
        mine, lim = self.by_ecu.get(ecu), self.lim
        if not mine or self.open:
            return False
        lc = mine[-1]
        start = min(lc.start, b.least_start)
        if lc.max_uptime <= 0 or start + lc.max_uptime < b.greatest_start + lim.overlap or lc.start - b.least_start > lim.buffering:
            return False
        if max(b.greatest_gap, b.first_reception - lc.last_reception) >= lim.resume_gap and b.greatest_start >= start + lim.resume_gap:
            return False
        if lc.resume and b.least_uptime <= lc.resume[1]:
            return False
        lc.nr_msgs += b.nr_msgs
        lc.nr_requests += b.nr_requests
        lc.min_uptime, lc.max_uptime = min(lc.min_uptime, b.least_uptime), max(lc.max_uptime, b.greatest_uptime)
        lc.start, lc.last_reception = start, b.last_reception
        if lc.version is None:
            lc.version = b.version
        self.latest_check = max(self.latest_check, b.greatest_reception + lim.check_every)
        return True

    def skip(self, ecu: bytes, index: int, b: Block) -> None:
        """Goes on behind a block that was refused, as if a lifecycle were in its middle: what follows only shows which other blocks to take apart."""
        self.open.clear()
        self._pass_on()
        lc = Lifecycle(self.next_id, ecu, b.least_start, b.least_start, b.least_uptime, b.greatest_uptime, b.last_reception, first_index=index, given=True)
        self.next_id += 1
        self.by_ecu.setdefault(ecu, []).append(lc)
        self.latest_check = max(self.latest_check, b.greatest_reception + self.lim.check_every)


# --- Spark ----------------------------------------------------------------------------------------


def _version_column():
    """The version text of software-version responses, in native expressions."""
    big = C.has_flag(S.HTYP_BIG_ENDIAN)
    p = F.col("payload")
    number = lambda at: F.conv(F.hex(F.when(big, F.substring(p, at, 4)).otherwise(C._reversed(F.substring(p, at, 4)))), 16, 10).cast("long")
    size = number(6)
    text = F.regexp_replace(F.decode(F.expr("substring(payload, 10)"), "ISO-8859-1"), "[\r\n\t]", " ")
    fits = (F.length(p) >= 9) & (number(1) == S.GET_SOFTWARE_VERSION) & (F.length(p) >= size + 9)
    return F.when(C.is_ctrl_response() & fits, F.substring(text, F.lit(1), size.cast("int")))


def detection_input(msgs: DataFrame) -> DataFrame:
    has = set(msgs.columns)
    version = _version_column() if "payload" in has else F.lit(None).cast("string")
    return msgs.select(
        "index", "ecu", F.col("reception_time_us").alias("reception"), C.timestamp_us().alias("uptime"), C.has_flag(S.HTYP_TIMESTAMP).alias("has_uptime"), C.is_ctrl_request().alias("request"), version.alias("version")
    )


_INFO = "id long, ecu binary, nr_msgs long, nr_control_req_msgs long, start_time_us long, initial_start_time_us long, min_timestamp_us long, max_timestamp_us long, last_reception_time_us long, resume struct<id:long,max_timestamp_us:long,start_time_us:long>, sw_version string"
_NAMES = [c.split(" ")[0] for c in _INFO.split(", ")]
BLOCK, SMALL = 2_000, 250_000
_KEY = ["ecu", "_block", "_cut"]


def marks(msgs: DataFrame, block: int) -> DataFrame:
    """What detection needs of the messages, in blocks of `block` indexes, with what can be said of them within their block."""
    w = Window.partitionBy("ecu", "_block").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    rows = detection_input(msgs).withColumn("_block", block_of("index", block))
    return staged(rows.withColumns({"upto": F.max(_latest()).over(w), "gap": F.col("reception") - F.last(F.when(~F.col("request"), F.col("reception")), True).over(w), "falls": F.col("uptime") < F.last(F.when(~F.col("request"), F.col("uptime")), True).over(w), "start": F.greatest(F.lit(0), F.col("reception") - F.col("uptime"))}), "marks")


def _latest():
    return F.greatest("reception", "uptime")


def first_cuts(rows: DataFrame, lim: Limits) -> DataFrame:
    """For each (ecu, _block) of marks() its first cut, if any.

    A cut is a message whose uptime is less than the one before and whose lifecycle starts after all the ECU's earlier
    messages were received: no lifecycle before it reaches it. upto, the greatest time of an earlier message, is a maximum within the block and one over the blocks before.
    """
    carry = F.max("late").over(Window.partitionBy("ecu").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("ecu", "_block").agg(F.max(_latest()).alias("late")).select("ecu", "_block", carry.alias("carry"))
    upto = F.greatest("upto", "carry")
    cut = F.col("falls") & F.col("has_uptime") & ~F.col("request") & (F.col("start") > upto) & (F.col("reception") > upto + lim.check_every)
    cuts = rows.join(blocks, ["ecu", "_block"]).groupBy("ecu", "_block").agg(F.min(F.when(cut, F.struct("index", upto.alias("upto")))).alias("cut"))
    return staged(cuts, "blocks")


def units(rows: DataFrame, lim: Limits) -> DataFrame:
    """The rows of each (ecu, _block, _cut) together; quiet: those which a machine can probably take as a whole."""
    timed = lambda c: F.when(~F.col("request"), F.col(c))
    out = rows.groupBy(*_KEY).agg(
        F.min("index").alias("first"), F.count("*").alias("nr_msgs"), F.count_if("request").alias("nr_requests"), F.count_if(~F.col("request") & ~F.col("has_uptime")).alias("untimed"),
        F.min(timed("start")).alias("least_start"), F.max(timed("start")).alias("greatest_start"), F.min(timed("uptime")).alias("least_uptime"), F.max(timed("uptime")).alias("greatest_uptime"),
        F.min_by(timed("reception"), F.when(~F.col("request"), F.col("index"))).alias("first_reception"), F.max_by(timed("reception"), F.when(~F.col("request"), F.col("index"))).alias("last_reception"),
        F.max("reception").alias("greatest_reception"), F.coalesce(F.max(timed("gap")), F.lit(0)).alias("greatest_gap"),
        F.min(F.when(~F.col("request") & F.col("version").isNotNull(), F.struct("index", "version")))["version"].alias("version"),
    )
    even = (F.col("greatest_start") - F.col("least_start") < lim.resume_gap) & (F.col("least_uptime") > 2 * lim.buffering)
    quiet = (F.col("nr_msgs") >= 8) & (F.col("nr_msgs") > F.col("nr_requests")) & (F.col("untimed") == 0) & (F.col("first") != F.col("_cut")) & even
    return out.withColumn("quiet", F.coalesce(quiet, F.lit(False)))


_UNIT = ("nr_msgs", "nr_requests", "least_start", "greatest_start", "least_uptime", "greatest_uptime", "first_reception", "last_reception", "greatest_reception", "greatest_gap", "version")
_SENT = ["ecu", "_home", "seg", "index", "reception", "uptime", "has_uptime", "request", "version", "upto", "_block", "_cut", *_UNIT[:-1]]
_FOUND = "ecu binary, seg long, first_index long, lc struct<" + _INFO.replace(" ", ":", 1).replace(", ", ",") + ">, head_reception long, head_uptime long, broken boolean, again_block long, again_cut long"


def _tracks(lim: Limits):
    """Runs a Track over each (ecu, seg) of a sorted partition; holds one at a time."""
    import pyarrow as pa

    names = [c.split(" ")[0] for c in ("ecu", "seg", "first_index", "lc", "head_reception", "head_uptime", "broken", "again_block", "again_cut")]

    def ended(ecu, seg, track, head, again):
        track.finish()
        lcs = track.lifecycles()
        first = {lc.id: lc.first_index for lc in lcs}
        if track.unsure:
            again = [(-1, -1)]
        if again:
            return [(ecu, seg, None, None, None, None, False, b, c) for b, c in again]
        broken = seg >= 0 and min(lc.start for lc in lcs) <= head[2]
        out = []
        for lc in lcs:
            resume = (first.get(lc.resume[0], -1), *lc.resume[1:]) if lc.resume else None
            out.append((ecu, seg, lc.first_index, dict(zip(_NAMES, (0, *lc.row()[1:9], resume and dict(zip(("id", "max_timestamp_us", "start_time_us"), resume, strict=True)), lc.version), strict=True)), *head[:2], broken, None, None))
        return out

    def run(batches):
        now, track, head, again = None, None, None, []
        for batch in batches:
            done = []
            d = batch.to_pydict()
            for k in range(batch.num_rows):
                key = (d["ecu"][k], d["seg"][k])
                if key != now:
                    if now is not None:
                        done += ended(*now, track, head, again)
                    now, track, again = key, Track(lim), []
                    head = (d["reception"][k], d["uptime"][k], d["upto"][k])
                if d["nr_msgs"][k] is None:
                    track.add(Row(d["index"][k], key[0], d["reception"][k], d["uptime"][k], d["has_uptime"][k], d["request"][k], d["version"][k]))
                elif not track.add_block(key[0], b := Block(*(d[c][k] for c in _UNIT))):
                    again.append((d["_block"][k], d["_cut"][k]))
                    track.skip(key[0], d["index"][k], b)
            if done:
                yield as_batch(done)
        if now is not None:
            yield as_batch(ended(*now, track, head, again))

    def as_batch(rows):
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    lc = pa.struct([(c, pa.binary() if c == "ecu" else pa.string() if c == "sw_version" else pa.struct([(x, pa.int64()) for x in ("id", "max_timestamp_us", "start_time_us")]) if c == "resume" else pa.int64()) for c in _NAMES])
    schema = pa.schema([("ecu", pa.binary()), ("seg", pa.int64()), ("first_index", pa.int64()), ("lc", lc), ("head_reception", pa.int64()), ("head_uptime", pa.int64()), ("broken", pa.bool_()), ("again_block", pa.int64()), ("again_cut", pa.int64())])
    return run


def segments(msgs: DataFrame, lim: Limits, block: int, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(blocks, found): every (ecu, _block) of the messages, and the lifecycles of each ECU by first_index, found in segments.

    Each segment runs a machine of its own over its rows, or over whole blocks of rows where these are quiet. What was assumed is
    checked: a machine names the blocks that it could not take, which are taken apart; a cut is dropped, which joins two segments,
    if a lifecycle behind it begins before the cut's earlier messages were received, or if the message at the cut resumes the
    lifecycle before it. Only the segments concerned run again. What is left gives the rows of one machine over the ECU, which is what tables of
    up to `small` rows are given to, an ECU each.
    """
    n = int(msgs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    null = lambda c: F.lit(None).cast("boolean" if c in ("has_uptime", "request") else "long").alias(c)
    rows = marks(msgs, block)
    if rows.count() <= small:
        alone = {"_home": F.lit(-1).cast("long"), "seg": F.lit(-1).cast("long"), "_cut": F.lit(-1).cast("long")}
        sent = rows.withColumns(alone).select(*[null(c) if c in _UNIT[:-1] else F.col(c) for c in _SENT]).repartition(n, "ecu").sortWithinPartitions("ecu", "index")
        return rows.select("ecu", "_block").distinct(), staged(sent.mapInArrow(_tracks(lim), _FOUND), "found")
    blocks = first_cuts(rows, lim)
    behind = F.when(F.col("index") >= F.col("cut.index"), F.col("cut.index"))
    rows = rows.join(blocks, ["ecu", "_block"]).withColumns({"_cut": F.coalesce(behind, F.lit(-1)), "upto": F.when(F.col("index") == F.col("cut.index"), F.col("cut.upto"))}).drop("cut")
    parts = units(rows, lim)
    dropped = expanded = found = todo = None  # (ecu, _cut), (ecu, _block, _cut), lifecycles, (ecu, seg): all at first
    w = Window.partitionBy("ecu").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)  # at most two units a block
    while True:
        own, gone = parts, F.lit(None)
        if dropped is not None:
            own, gone = own.join(dropped.withColumn("_gone", F.lit(True)), ["ecu", "_cut"], "left"), F.col("_gone")
        cut = F.when((F.col("_cut") >= 0) & gone.isNull(), F.col("_cut"))
        own = own.withColumn("seg", F.coalesce(F.last(cut, True).over(w), F.lit(-1)))
        if todo is not None:
            own = own.join(todo, ["ecu", "seg"], "left_semi")
        if expanded is not None:
            own = own.join(expanded.withColumn("_apart", F.lit(True)), _KEY, "left").withColumn("quiet", F.col("quiet") & F.col("_apart").isNull())
        own = staged(own.select(*_KEY, block_of("seg", block).alias("_home"), "seg", "quiet", "first", *_UNIT), "units")
        raw = rows.join(own.where("not quiet").select(*_KEY, "_home", "seg"), _KEY).select(*[null(c) if c in _UNIT[:-1] else F.col(c) for c in _SENT])
        whole = own.where("quiet").withColumn("index", F.col("first")).select(*[null(c) if c in ("reception", "uptime", "has_uptime", "request", "upto") else F.col(c) for c in _SENT])
        sent = raw.unionByName(whole).repartition(n, "ecu", "_home").sortWithinPartitions("ecu", "_home", "seg", "index")
        new = staged(sent.mapInArrow(_tracks(lim), _FOUND), "found")
        good = new.where("lc is not null")
        found = good if found is None else found.join(todo, ["ecu", "seg"], "left_anti").unionByName(good)
        again = new.where("lc is null")
        if again.limit(1).count():
            every = again.where("again_block = -1").select("ecu", "seg").join(own.where("quiet"), ["ecu", "seg"]).select(*_KEY)  # that stands for all blocks
            more = again.where("again_block >= 0").select("ecu", F.col("again_block").alias("_block"), F.col("again_cut").alias("_cut")).unionByName(every)
            expanded = staged(more if expanded is None else expanded.unionByName(more).distinct(), "expanded")
            todo, found = staged(again.select("ecu", "seg").distinct(), "todo"), staged(found, "kept")
            continue
        heads = found.groupBy("ecu", "seg").agg(F.max_by("lc", "first_index").alias("lc"), F.first("head_reception").alias("reception"), F.first("head_uptime").alias("uptime"), F.max("broken").alias("broken"))
        heads = heads.withColumn("x", F.lag("lc").over(Window.partitionBy("ecu").orderBy("seg"))).where("seg >= 0")  # at most a segment a block
        gap, start = F.col("reception") - F.col("x.last_reception_time_us"), F.greatest(F.lit(0), F.col("reception") - F.col("uptime"))
        resumes = (gap >= lim.resume_gap) & (F.col("uptime") >= F.col("x.max_timestamp_us")) & (start >= F.col("x.start_time_us") + lim.resume_gap) & (gap + lim.resume_buffering > start - F.col("x.start_time_us"))
        bad = heads.where(F.col("broken") | F.coalesce(resumes, F.lit(False))).select("ecu", F.col("seg").alias("_cut"))
        if not bad.limit(1).count():
            return blocks, found
        bad = staged(bad, "bad")
        dropped = bad if dropped is None else staged(dropped.unionByName(bad), "dropped")
        # what began at a dropped cut is part of the segment before it now, which runs again
        known = found.select("ecu", "seg").distinct().join(bad.select("ecu", F.col("_cut").alias("seg"), F.lit(True).alias("bad")), ["ecu", "seg"], "left")
        into = known.withColumn("into", F.last(F.when(F.col("bad").isNull(), F.col("seg")), True).over(Window.partitionBy("ecu").orderBy("seg")))
        into = into.where("bad").select("ecu", F.coalesce("into", F.lit(-1)).alias("seg")).distinct()
        todo = staged(into, "todo")
        found = staged(found.join(bad.withColumnRenamed("_cut", "seg"), ["ecu", "seg"], "left_anti"), "kept")


def _whole(msgs: DataFrame, lim: Limits) -> DataFrame:
    """The lifecycles of all ECUs by one machine: confirmation looks at the clock of all."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [Row(*x) for x in pdf.sort_values("index")[["index", "ecu", "reception", "uptime", "has_uptime", "request", "version"]].itertuples(index=False, name=None)]
        for r in rows:
            r.version = r.version if isinstance(r.version, str) else None
            r.ecu = bytes(r.ecu)
        _, lcs = detect_rows(rows, lim)
        first = {lc.id: lc.first_index for lc in lcs}
        table = [(lc.ecu, lc.first_index, (0, *lc.row()[1:9], (first.get(lc.resume[0], -1), *lc.resume[1:]) if lc.resume else None, lc.version)) for lc in lcs]
        return pd.DataFrame(table, columns=["ecu", "first_index", "lc"])

    return detection_input(msgs).groupBy(F.lit("all")).applyInPandas(run, f"ecu binary, first_index long, lc struct<{_INFO.replace(' ', ':', 1).replace(', ', ',')}>")


def detect(msgs: DataFrame, limits: Limits = Limits(), mode: str = "per_ecu", block: int = BLOCK, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(msgs with lifecycle, lifecycles). Ids are dense, in the order of the lifecycles' first messages.

    mode "per_ecu": by segments of each ECU, see segments(); "exact": all ECUs in one machine.
    """
    if mode == "exact":
        found = staged(_whole(msgs, limits), "found")
        blocks = msgs.select("ecu", block_of("index", block).alias("_block")).distinct()
    else:
        blocks, found = segments(msgs, limits, block, small)
    heads = running(found.select("first_index", "ecu", "lc"), [], "first_index", {"id": ("sum", F.lit(1).cast("long"))}, 100 * block)
    origin = heads.select(F.col("first_index").alias("from_key"), F.col("id").alias("from_id"))
    lcs = heads.select("id", "ecu", *[f"lc.{c}" for c in _NAMES[2:]]).join(origin, F.col("resume.id") == F.col("from_key"), "left")
    resume = F.when(F.col("resume").isNotNull(), F.struct(F.col("from_id").alias("id"), F.col("resume.max_timestamp_us"), F.col("resume.start_time_us")))
    lcs = lcs.withColumn("resume", resume).select(*_NAMES)
    # the lifecycles of an ECU follow one another: a message is in the last one that began, in its block or in one before
    began = heads.groupBy("ecu", block_of("first_index", block).alias("_block")).agg(F.max("id").alias("last"), F.array_sort(F.collect_list(F.struct("first_index", "id"))).alias("began"))  # at most block ones
    w = Window.partitionBy("ecu").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    began = blocks.select("ecu", "_block").join(began, ["ecu", "_block"], "left").select("ecu", "_block", F.max("last").over(w).alias("earlier"), "began")
    here = F.filter("began", lambda x: x["first_index"] <= F.col("index"))
    id_ = F.coalesce(F.when(F.size("began") > 0, F.try_element_at(here, F.lit(-1))["id"]), F.col("earlier"))
    out = msgs.drop("lifecycle").withColumn("_block", block_of("index", block)).join(began, ["ecu", "_block"])
    return out.withColumn("lifecycle", id_).drop("_block", "earlier", "began"), lcs


def derived(lcs: DataFrame) -> DataFrame:
    """lcs with what follows from them: end, when a resumed one went on and where it stands, how long it was suspended, kinds."""
    start, resumed = F.col("start_time_us"), F.col("resume").isNotNull()
    suspended = F.when(resumed, F.greatest(F.lit(0), start - F.col("resume.start_time_us"))).otherwise(0)
    return lcs.withColumns(
        {
            "end_time_us": F.when(F.col("max_timestamp_us") == 0, F.col("last_reception_time_us")).otherwise(start + F.col("max_timestamp_us")),
            "suspend_duration_us": suspended,
            "resume_time_us": F.when(resumed, start + F.col("min_timestamp_us") - suspended).otherwise(start),
            "resume_start_time_us": F.when(resumed, F.greatest(start, F.col("resume.start_time_us") + 1)).otherwise(start),
            "only_control_requests": F.col("nr_control_req_msgs") >= F.col("nr_msgs"),
            "is_resume": resumed,
        }
    )


def report(lcs: DataFrame) -> DataFrame:
    """A line for each lifecycle; order_us and id give the report's order. Times are in the session's zone."""
    time = lambda c, form: F.date_format(F.timestamp_micros(F.col(c)), form)
    line = F.concat(
        F.format_string("LC#%3d: ", F.col("id")), F.rpad(C.id_text(F.col("ecu")), 4, " "), F.lit(" "),
        F.when(F.col("is_resume"), time("resume_time_us", "yyyy/MM/dd HH:mm:ss' RESUME'")).otherwise(time("start_time_us", "yyyy/MM/dd HH:mm:ss.SSSSSS")),
        F.lit(" - "), time("end_time_us", "HH:mm:ss"), F.format_string(" #%8d", F.col("nr_msgs")),
        F.when(F.col("only_control_requests"), " CTRL_REQUESTS_ONLY").otherwise(""), F.lit(" "), F.coalesce("sw_version", F.lit("")),
    )
    return derived(lcs).select("id", line.alias("line"), F.col("resume_start_time_us").alias("order_us"))
