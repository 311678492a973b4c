"""Replacing ids by numbers in the order of their first appearance; texts are blanked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import columns as C


def _four(letter: str, n: Column) -> Column:
    return F.encode(F.substring(F.concat(F.lit(letter), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), F.lit("0"))), 1, 4), "ISO-8859-1")


def mapping(msgs: DataFrame) -> DataFrame:
    """ecu, apid, ctid and their new_ecu, new_apid, new_ctid: numbers from 1 by ECU, by application of an ECU, by context of an application."""
    seen = msgs.groupBy("ecu", F.col("ext.apid").alias("apid"), F.col("ext.ctid").alias("ctid")).agg(F.min("index").alias("first"))
    # the table has a row for each triple of ids: ranking it needs no message rows
    e = seen.groupBy("ecu").agg(F.min("first").alias("f")).withColumn("ne", F.row_number().over(Window.orderBy("f"))).drop("f")
    a = seen.where("apid is not null").groupBy("ecu", "apid").agg(F.min("first").alias("f"))
    a = a.withColumn("na", F.row_number().over(Window.partitionBy("ecu").orderBy("f"))).drop("f")
    c = seen.where("apid is not null").withColumn("nc", F.row_number().over(Window.partitionBy("ecu", "apid").orderBy("first")))
    c = c.select("ecu", "apid", "ctid", "nc")
    out = seen.drop("first").join(e, "ecu").join(a, ["ecu", "apid"], "left").join(c, ["ecu", "apid", "ctid"], "left")
    return out.select("ecu", "apid", "ctid", _four("E", F.col("ne")).alias("new_ecu"), _four("A", F.col("na")).alias("new_apid"), _four("C", F.col("nc")).alias("new_ctid"))


def anonymize(msgs: DataFrame) -> DataFrame:
    m = mapping(msgs).withColumnsRenamed({"ecu": "_e", "apid": "_a", "ctid": "_c"})
    on = (F.col("ecu") == F.col("_e")) & F.col("ext.apid").eqNullSafe(F.col("_a")) & F.col("ext.ctid").eqNullSafe(F.col("_c"))
    out = msgs.join(m, on).withColumn("ecu", F.col("new_ecu"))
    ext = F.when(F.col("ext").isNotNull(), F.struct("ext.verb_mstp_mtin", "ext.noar", F.col("new_apid").alias("apid"), F.col("new_ctid").alias("ctid")))
    text = F.when(C.is_ctrl_response(), F.lit("[anonymized]")).otherwise(F.concat(F.lit("anonymized payload of "), F.coalesce(F.length("payload"), F.lit(0)).cast("string"), F.lit(" bytes")))
    new = {"ext": ext, "payload_text": text} | ({"payload": F.lit(b"")} if "payload" in msgs.columns else {})
    return out.withColumns(new).select(*msgs.columns) if "payload" in msgs.columns else out.withColumns({"ext": ext, "payload_text": F.lit("anonymized")}).select(*msgs.columns)
