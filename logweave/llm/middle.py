"""Fill-in-middle transformation over run-length classes.

A text's units are maximal runs of the letters A-Z and a-z, and single code points otherwise. Each text is stored as its
maximal runs of one class: letters, or other code points of one, two, three or four UTF-8 bytes. A run of letters is one
unit, another run one unit for each code point, all of one width, so that the cumulative counts of units at the starts of
runs are enough to place a cut: a binary search finds the run that holds it, and its place in bytes and code points follows
by multiplication. No list of units is made. The runs of all texts of an Arrow batch are found and searched at once.

Cuts and forms come from the SHA-256 of `seed` and doc_id, so that any run on any cluster gives the same rows.

Edge cases: null and empty texts have no units and stay plain, and so do texts that hold a marker; rows of one doc_id are cut
by the same numbers, each over its own units; a null doc_id counts as the empty string in the hash; texts of any length are
cut whole; no documents give no rows; further columns of the input, whatever their names, stay out of the result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw_bytes, small_batches, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LETTER, LATER = 0, 5  # classes of bytes; 1 to 4: width of the code point that the byte begins

_class = np.ones(256, np.uint8)
_class[65:91] = _class[97:123] = LETTER
_class[0x80:0xC0] = LATER
_class[0xC0:0xE0], _class[0xE0:0xF0], _class[0xF0:] = 2, 3, 4


class Runs:
    """The class runs of texts (data, offsets): where each begins in bytes, units and code points, counted over all texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _class[data]
        points = np.flatnonzero(kind != LATER)  # where code points begin
        kind = kind[points]
        bounds = np.searchsorted(points, offsets)  # in code points
        first = np.zeros(len(points) + 1, bool)
        first[bounds] = True
        first[1:-1] |= kind[1:] != kind[:-1]
        first = np.flatnonzero(first[:-1])
        self.kind, self.chars = kind[first], first
        self.bytes = points[first]
        size = np.diff(np.append(first, len(points)))
        units = np.zeros(len(first) + 1, np.int64)
        np.cumsum(np.where(self.kind == LETTER, 1, size), out=units[1:])
        self.units = units[:-1]
        self.ends = (units[-1], len(data), len(points))
        begin = np.searchsorted(first, bounds)  # the first run of each text, and the end
        self.base = np.append(self.units, units[-1])[begin]
        self.char_base = bounds

    def n_units(self) -> np.ndarray:
        return np.diff(self.base)

    def place(self, text: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes (over all texts) and code points (of its text) before the unit `cut` of each text."""
        unit = self.base[text] + cut
        if not len(self.units):
            return np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        run = np.searchsorted(self.units, unit, "right") - 1
        inside = unit - self.units[run]
        byte, char = self.bytes[run] + inside * self.kind[run], self.chars[run] + inside
        end = unit == self.ends[0]  # after the last unit of all texts
        byte[end], char[end] = self.ends[1], self.ends[2]
        return byte, char - self.char_base[text]


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four unsigned numbers of 32 bits for each row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, seed: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output of each text; plain and spm in percent (spm of those cut)."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    marker = re.compile(b"|".join(m.encode() for m in (PREFIX, SUFFIX, MIDDLE)))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches):
        for batch in batches:
            data, offsets = raw_bytes(batch.column(1))
            h1, h2, h3, h4 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
            runs = Runs(data, offsets)
            n = runs.n_units()
            rows = np.arange(len(n))
            cuts = np.sort(np.stack((h1 % (n + 1), h2 % (n + 1))), 0)
            (low, low_chars), (high, high_chars) = runs.place(rows, cuts[0]), runs.place(rows, cuts[1])
            plain_ = h3 % 100 >= 100 - plain
            form, output = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                text = data[a:b].tobytes()
                if a == b or plain_[i] or marker.search(text):
                    form.append("plain")
                    output.append(text)
                    continue
                x, y = int(low[i]) - a, int(high[i]) - a
                if h4[i] % 100 < spm:
                    form.append("spm")
                    output.append(b"".join((s, text[y:], p, text[:x], m, text[x:y])))
                else:
                    form.append("psm")
                    output.append(b"".join((p, text[:x], s, text[y:], m, text[x:y])))
            whole = np.array([f == "plain" for f in form], bool)
            chars = [pa.array(x, pa.int64(), mask=whole) for x in (low_chars, high_chars - low_chars)]
            text = pa.array(output, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form), *chars, text], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    few = docs.select("doc_id", "text", *draws(F.col("doc_id"), seed))
    return few.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that transform() made output of. The parts hold no marker, so the first one found is the one that was written."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    one = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substr(body, F.length(one) + F.length(second) + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(two) + F.lit(len(MIDDLE) + 1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {"op12_fim": op12_fim}
ORACLE_SQL = {
    "op12_fim": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, ('0x' || h[1:8])::UBIGINT::BIGINT AS h1, ('0x' || h[9:16])::UBIGINT::BIGINT AS h2, ('0x' || h[17:24])::UBIGINT::BIGINT AS h3, ('0x' || h[25:32])::UBIGINT::BIGINT AS h4,
  regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
c AS (SELECT *, len(u) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM g),
p AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
}
