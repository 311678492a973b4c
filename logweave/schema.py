"""The message and lifecycle tables and the constants of the wire format."""

from __future__ import annotations

from pyspark.sql import types as T

EXT = T.StructType([T.StructField("verb_mstp_mtin", T.ShortType()), T.StructField("noar", T.ShortType()), T.StructField("apid", T.BinaryType()), T.StructField("ctid", T.BinaryType())])
MSG_SCHEMA = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("reception_time_us", T.LongType()),
        T.StructField("ecu", T.BinaryType()),
        T.StructField("timestamp_dms", T.LongType()),
        T.StructField("htyp", T.ShortType()),
        T.StructField("mcnt", T.ShortType()),
        T.StructField("msg_len", T.IntegerType()),
        T.StructField("ext", EXT),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_text", T.StringType()),
        T.StructField("lifecycle", T.LongType()),
        T.StructField("src_file", T.StringType()),
        T.StructField("src_stream", T.IntegerType()),
        T.StructField("src_seq", T.LongType()),
    ]
)


def as_batch(rows: list[tuple]):
    """Rows of messages (wire.Message.row) as an Arrow batch, column by column."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(MSG_SCHEMA)
    columns = []
    for f, values in zip(schema, zip(*rows) if rows else [()] * len(schema), strict=True):
        if f.name == "ext":
            parts = zip(*(x or (None,) * len(EXT) for x in values)) if rows else [()] * len(EXT)
            missing = pa.array([x is None for x in values], pa.bool_())
            columns.append(pa.StructArray.from_arrays([pa.array(p, g.type) for p, g in zip(parts, f.type, strict=True)], fields=list(f.type), mask=missing))
        else:
            columns.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


LIFECYCLE_SCHEMA = "id long, ecu binary, nr_msgs long, nr_control_req_msgs long, start_time_us long, initial_start_time_us long, min_timestamp_us long, max_timestamp_us long, last_reception_time_us long, resume struct<id:long,max_timestamp_us:long,start_time_us:long>, sw_version string"

# fixed values of the log format: header flags, message kinds, argument type bits
HTYP_EXT, HTYP_BIG_ENDIAN, HTYP_ECU, HTYP_SESSION, HTYP_TIMESTAMP = 1, 2, 4, 8, 16
STORAGE_MAGIC, SERIAL_MAGIC = b"DLT\x01", b"DLS\x01"
MSTP_LOG, MSTP_APP_TRACE, MSTP_NW_TRACE, MSTP_CONTROL = 0, 1, 2, 3
MTIN_REQUEST, MTIN_RESPONSE, MTIN_TIME = 1, 2, 3
LOG_LEVELS = ("fatal", "fatal", "error", "warn", "info", "debug", "verbose")
APP_TRACE_KINDS = ("", "variable", "func_in", "func_out", "state", "vfb")
NW_TRACE_KINDS = ("", "ipc", "can", "flexray", "most", "ethernet", "someip", "user_defined")
CONTROL_KINDS = ("", "request", "response", "time")
TI_BOOL, TI_SINT, TI_UINT, TI_FLOA, TI_ARAY, TI_STRG, TI_RAWD, TI_VARI, TI_FIXP, TI_TRAI, TI_STRU = (1 << n for n in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14))
TI_TYLE, TI_SCOD = 0x0F, 0x38000
SCOD_ASCII, SCOD_UTF8, SCOD_HEX, SCOD_BIN = 0, 0x8000, 0x10000, 0x18000
SET_LOG_LEVEL, GET_LOG_INFO, GET_SOFTWARE_VERSION = 1, 3, 19
UNREGISTER_CONTEXT, CONNECTION_INFO, TIMEZONE = 0xF01, 0xF02, 0xF03
# fixed values: names of the control services
SERVICE_NAMES = {
    1: "set_log_level", 2: "set_trace_status", 3: "get_log_info", 4: "get_default_log_level", 5: "store_config", 6: "reset_to_factory_default", 7: "set_com_interface_status",
    8: "set_com_interface_max_bandwidth", 9: "set_verbose_mode", 10: "set_message_filtering", 11: "set_timing_packets", 12: "get_local_time", 13: "use_ecu_id", 14: "use_session_id",
    15: "use_timestamp", 16: "use_extended_header", 17: "set_default_log_level", 18: "set_default_trace_status", 19: "get_software_version", 20: "message_buffer_overflow",
    0xF01: "unregister_context", 0xF02: "connection_info", 0xF03: "timezone", 0xF04: "MARKER", 0xF05: "offline_logstorage", 0xF06: "passive_node_connect", 0xF07: "passive_node_connection_status",
    0xF08: "set_all_log_level", 0xF09: "set_all_trace_status", 0xF0A: "undefined", 0xF0B: "reserved_b", 0xF0C: "reserved_c", 0xF0D: "reserved_d", 0xF0E: "reserved_e",
}
# fixed values: words for the result of a control response
RESPONSE_WORDS = {0: "ok", 1: "not_supported", 2: "error", 3: "perm_denied", 4: "warning", 8: "no_matching_context_id"}
