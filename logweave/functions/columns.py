"""Native column expressions over the message table: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S

col = F.col


def timestamp_us() -> Column:
    return col("timestamp_dms") * 100


def reception_time() -> Column:
    return F.timestamp_micros(col("reception_time_us"))


def _vmm() -> Column:
    return col("ext.verb_mstp_mtin").cast("int")


def is_verbose() -> Column:
    return F.coalesce(_vmm().bitwiseAND(1) == 1, F.lit(False))


def mstp() -> Column:
    """Message kind; kinds over 3, and messages without extended header, count as log."""
    v = F.shiftright(_vmm(), 1).bitwiseAND(7)
    return F.when(v <= 3, v).otherwise(0)


def mtin() -> Column:
    return F.coalesce(F.shiftright(_vmm(), 4).bitwiseAND(15), F.lit(0))


def log_level() -> Column:
    """1 (fatal) to 6 (verbose) for log messages with extended header, else null."""
    return F.when(col("ext").isNotNull() & (mstp() == 0), F.when(mtin().between(1, 6), mtin()).otherwise(1))


def noar() -> Column:
    return F.coalesce(col("ext.noar"), F.lit(0))


def is_ctrl_request() -> Column:
    return F.coalesce((mstp() == S.MSTP_CONTROL) & (mtin() == S.MTIN_REQUEST), F.lit(False))


def is_ctrl_response() -> Column:
    return F.coalesce((mstp() == S.MSTP_CONTROL) & (mtin() == S.MTIN_RESPONSE), F.lit(False))


def has_flag(flag: int) -> Column:
    return col("htyp").cast("int").bitwiseAND(flag) != 0


def version() -> Column:
    return F.shiftright(col("htyp").cast("int"), 5).bitwiseAND(7)


def id_text(c: Column) -> Column:
    """An id for display: up to the first NUL, control characters as '-', others beyond ASCII as '?'."""
    s = F.regexp_replace(F.decode(c, "ISO-8859-1"), r"(?s)\x00.*", "")
    return F.regexp_replace(F.regexp_replace(s, r"[\x01-\x1f]", "-"), r"[^\x00-\x7e]", "?")


def id_bytes(c: Column) -> Column:
    """A 4-byte id from text: ASCII only, cut to 4, padded with NUL."""
    ascii_only = F.when(~c.rlike(r"[^\x00-\x7f]"), c)
    return F.encode(F.rpad(ascii_only, 4, "\x00"), "ISO-8859-1")


def id_u32le(c: Column) -> Column:
    return F.conv(F.hex(_reversed(c)), 16, 10).cast("long")


def _reversed(c: Column) -> Column:
    return F.concat(*[F.substring(c, i, 1) for i in (4, 3, 2, 1)])


def hex_dump(c: Column) -> Column:
    """Lower-case bytes, separated by spaces."""
    return F.rtrim(F.regexp_replace(F.lower(F.hex(c)), "(..)", "$1 "))


def hex_parse(text: Column) -> Column:
    """The bytes of a hex_dump(); null for any other text."""
    return F.when(text.rlike(r"^[0-9a-fA-F]{2}( [0-9a-fA-F]{2})*$"), F.unhex(F.replace(text, F.lit(" "), F.lit(""))))


def printable(c: Column) -> Column:
    """Bytes as text with everything but 0x20..0x7e as '-'."""
    return F.regexp_replace(F.decode(c, "ISO-8859-1"), r"[^\x20-\x7e]", "-")


def non_verbose_id(big_endian: Column) -> Column:
    b = F.substring(col("payload"), 1, 4)
    return F.when(F.length(b) == 4, F.conv(F.hex(F.when(big_endian, b).otherwise(_reversed(b))), 16, 10).cast("long"))


def non_verbose_text() -> Column:
    """[id] text|hex; the hex only where bytes other than printable ones and line ends were replaced."""
    rest = F.expr("substring(payload, 5)")
    odd = F.decode(rest, "ISO-8859-1").rlike(r"[^\x20-\x7e\r\n\t]")
    number = non_verbose_id(has_flag(S.HTYP_BIG_ENDIAN))
    shown = F.concat(F.lit("["), number.cast("string"), F.lit("] "), printable(rest), F.lit("|"), F.when(odd, hex_dump(rest)).otherwise(""))
    return F.when(number.isNull(), "[<args missing>]").otherwise(shown)


def kind_label() -> Column:
    """'log info', 'control response' and so on; '--- ---' without extended header."""

    def pick(prefix: str, names) -> Column:
        out = F.lit(f"{prefix} {names[1]}")
        for i, n in enumerate(names):
            if i > 1:
                out = F.when(mtin() == i, f"{prefix} {n}").otherwise(out)
        return out

    log = pick("log", S.LOG_LEVELS)
    label = F.when(mstp() == 1, pick("app_trace", S.APP_TRACE_KINDS)).when(mstp() == 2, pick("nw_trace", S.NW_TRACE_KINDS)).when(mstp() == 3, pick("control", S.CONTROL_KINDS)).otherwise(log)
    return F.when(col("ext").isNull(), "--- ---").otherwise(label)


def header_line(zone: str | None = None) -> Column:
    """index, reception time (session time zone, or zone), uptime, counter, ids, kind, mode, arguments."""
    t = reception_time() if zone is None else F.from_utc_timestamp(reception_time(), zone)
    name = lambda c: F.rpad(F.coalesce(id_text(c), F.lit("")), 4, "-")
    mode = F.when(col("ext").isNull(), "N -").when(is_verbose(), "V").otherwise("N")
    return F.concat_ws(
        " ",
        col("index").cast("string"),
        F.date_format(t, "yyyy/MM/dd HH:mm:ss.SSSSSS"),
        F.lpad(col("timestamp_dms").cast("string"), 10, " "),
        F.lpad(col("mcnt").cast("string"), 3, "0"),
        name(col("ecu")),
        name(col("ext.apid")),
        name(col("ext.ctid")),
        kind_label(),
        mode,
        noar().cast("string"),
    )
