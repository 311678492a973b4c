"""Best-fit packing planned over a histogram of lengths.

1. Documents become token ids with an end token, cut into pieces of the sequence length only where they are longer. While a
   task writes its pieces it numbers those of each length, so that a piece has (chunk, length, place among the chunk's).
2. The counts of each (chunk, length) give the histogram, of at most `size` lengths, and by prefix sums over the chunks of a
   length the rank of each piece among all of its length. No task sees all pieces of one length.
3. The driver plans best fit, the longest first, over these counts: as all pieces of one length are alike, whole groups of
   equal sequences are filled at a time, and the plan is of a few thousand runs however many documents there are.
4. A piece takes the slot of the plan that its rank within its length falls in, by binary search in the broadcast plan.

The plan gives each sequence's filling as runs (length, how many, offset), so that the slots are gapless by construction.

Edge cases: null and empty texts are the end token alone; equal and repeated rows are packed each; a null doc_id stays null
in its pieces; a text of any length is encoded whole, word by word; the text of a special token counts as that token, as the
tokenizer has it; no documents give no rows; further columns of the input, whatever their names, stay out of the result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked, chunks, cut, raw_bytes, small_batches, table

SIZE = 2048
MAX_BROADCAST = 200_000
GROUP = 4 << 20  # bytes of documents that are encoded in one call
PIECES = "piece int, start long, length int, ids_crc32 long, chunk int, place long"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A file of the public vocabularies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] = _lower[97:123]
_letter = np.zeros(256, bool)
_letter[97:123] = True
_stop = np.zeros(256, bool)
_stop[[ord("."), ord(",")]] = True


class Encoder:
    """Ids of texts, without special tokens, with an end token, for a vocabulary of lower case that drops white space.

    No token, and no step of the tokenizer before its tokens, reaches over white space of ASCII, nor from a letter to a stop or
    comma before such white space. So the texts are cut there, the different words are encoded once, and their ids are
    gathered. Of words of plain letters, which its steps before the merges leave as they are, only the merges are asked for.
    The ids of words seen before are kept, up to `memo` of them, besides those of the texts at hand.
    """

    def __init__(self, path: str, end: int = 0, memo: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end, self.memo = Tokenizer.from_file(path), end, memo
        self.known: dict[str, bytes] = {}
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [c for c in map(chr, range(0x61, 0x180)) if c.isalpha() and self.tokenizer.normalizer.normalize_str(c) == c]
        self.merged = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in plain}
        self.plain = re.compile(f"[{''.join(plain)}]+")

    def _encode(self, words: list[str]) -> None:
        other, model = [], self.tokenizer.model
        for w in words:
            if self.plain.fullmatch(w):
                self.known[w] = array("I", [t.id for t in model.tokenize(w if w.isascii() else w.translate(self.merged))]).tobytes()
            else:
                other.append(w)
        for w, x in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.known[w] = array("I", x.ids).tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.memo:
            self.known, new = {}, words
        self._encode(new)
        return list(map(self.known.__getitem__, words))

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts, one after another, and the n + 1 bounds of the texts in them."""
        data, offsets = raw_bytes(texts)
        low = _lower[data]
        held = low.tobytes()
        if any(x in held for x in self.special):  # in capitals it would be no special token
            low = data
        word = ~_space[low]
        first = np.zeros(len(low) + 1, bool)
        first[offsets] = True
        last = first[1:].copy()
        last[:-1] |= ~word[1:]
        first[1:-1] |= ~word[:-1]
        first[1:-1] |= _stop[low[1:]] & _letter[low[:-1]] & last[1:]
        starts = np.flatnonzero(word & first[:-1])
        upto = np.zeros(len(low) + 1, np.int32)
        np.cumsum(word, out=upto[1:])
        values = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(upto[starts], upto[-1])), pa.py_buffer(low[word]))
        per_text = np.searchsorted(starts, offsets)  # words before each text
        coded = values.dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        before = np.zeros(len(n) + 1, np.int64)  # ids before each word, end tokens aside
        np.cumsum(n, out=before[1:])
        bounds = before[per_text] + np.arange(len(texts) + 1)
        out = np.full(bounds[-1], self.end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[bounds[1:] - 1] = False
        out[inner] = flat[np.repeat(begin[which] - before[:-1], n) + np.arange(before[-1])]
        return out, bounds


@cache
def encoder(path: str, end: int) -> Encoder:
    """One for each worker, so that its words serve the next tasks."""
    return Encoder(path, end)


def pieces(docs: DataFrame, size: int = SIZE, end: int = 0, path=vocabulary, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, chunk, place (and ids if asked for) of each piece of at most size tokens."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        chunk, encode = TaskContext.get().partitionId(), encoder(path(), end)
        of_length = np.zeros(size + 1, np.int64)

        def rows(keys, texts):
            ids, bounds = encode(texts)
            count = -(-np.diff(bounds) // size)  # pieces of each text
            row = np.repeat(np.arange(len(texts)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = bounds[:-1][row] + piece * size
            length = np.minimum(begin + size, bounds[1:][row]) - begin
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.searchsorted(sorted_, sorted_) + of_length[sorted_]
            of_length[:] += np.bincount(length, minlength=size + 1)
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * size), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), chunk), pa.int32()), pa.array(place)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "place"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for a, b in chunks(np.diff(raw_bytes(batch.column(1))[1]), GROUP):
                yield rows(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))

    few = docs.select("doc_id", "text")
    return few.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}" + (", ids array<int>" if keep_ids else ""))


@dataclass(frozen=True)
class Plan:
    """Runs of slots, by length and the rank of their first piece; run i gives `each` places to each of its sequences."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray  # its first one
    each: np.ndarray
    offset: np.ndarray  # of the first of its places in a sequence
    sequences: int

    def slots(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of the pieces of these lengths and ranks."""
        low = np.searchsorted(self.length, length, "left")
        high = np.searchsorted(self.length, length, "right")
        while True:  # the last run of the length that begins at the rank or before: all searches halve together
            open_ = high - low > 1
            if not open_.any():
                break
            middle = (low + high) // 2
            right = open_ & (self.rank[np.minimum(middle, len(self.rank) - 1)] <= rank)
            low, high = np.where(right, middle, low), np.where(open_ & ~right, middle, high)
        inside = rank - self.rank[low]
        return self.sequence[low] + inside // self.each[low], self.offset[low] + inside % self.each[low] * length


def plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """Best fit over counts: the longest pieces first, each into the fullest sequence that has room for it.

    Sequences of equal filling are one group. A group that a length fits in takes as many pieces as its sequences hold, as
    one piece after another by best fit would do; what is left of a length opens new sequences. Groups are split by the rest
    of a length only, so there are at most three new ones for each length, whatever the counts.
    """
    groups: dict[int, list[list]] = {}  # room: [number of sequences, filling as runs (length, each)]
    ready: list[list] = []

    def put(room: int, n: int, filling: list) -> None:
        if n:
            (groups.setdefault(room, []) if room else ready).append([n, filling])

    def fill(room: int, n: int, filling: list, length: int, left: int) -> int:
        """Fills n sequences of this room with pieces of the length, of which there are left ones; returns how many stay."""
        each = room // length
        whole = min(n, left // each)
        put(room - each * length, whole, [*filling, (length, each)])
        left -= whole * each
        n -= whole
        if n and left:  # fewer than a sequence takes
            put(room - left * length, 1, [*filling, (length, left)])
            n, left = n - 1, 0
        put(room, n, filling)
        return left

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in groups if r >= length):
            for n, filling in groups.pop(room):
                left = fill(room, n, filling, length, left) if left else (put(room, n, filling) or 0)
            if not left:
                break
        if left:
            fill(size, -(-left // (size // length)), [], length, left)
    used = dict.fromkeys(histogram, 0)
    runs, sequence = [], 0
    for n, filling in ready + [g for room in sorted(groups) for g in groups[room]]:
        offset = 0
        for length, each in filling:
            runs.append((length, used[length], sequence, each, offset))
            used[length] += n * each
            offset += length * each
        sequence += n
    runs.sort()
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence)


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces() (a written table: it is read twice) with sequence_id and offset instead of chunk and place."""
    spark = cut_pieces.sparkSession
    counts = cut(cut_pieces.groupBy("chunk", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    slots = spark.sparkContext.broadcast(plan(histogram, size))  # at most three runs a length, and their fillings
    w = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(counts.select("chunk", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before")), "before")

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = slots.value.slots(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = cut_pieces.join(checked(before, MAX_BROADCAST), ["chunk", "length"])
    ranked = ranked.withColumn("_slot", slot("length", F.col("before") + F.col("place")))
    return ranked.withColumns({"sequence_id": F.col("_slot.sequence_id"), "offset": F.col("_slot.offset"), "length": F.col("length").cast("long")}).drop("chunk", "place", "before", "_slot")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids, from pieces with ids: the sequences themselves. A group is one sequence, of at most `size` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(cut(pieces(table(spark, sf_dir, "documents")), "pieces"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op13_packing": op13_packing}
ORACLE_SQL: dict[str, str] = {}
