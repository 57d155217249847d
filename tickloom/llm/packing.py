"""Best-fit packing by minimum bin slack, planned on the counts of lengths and carried out by joins of ranks."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import documents_of, giving_back, records, stored
from tickloom.llm.tokens import encoded_batches, forget

CAPACITY = 2048
END = np.zeros(1, "<u4").tobytes()
#: Rows that are ranked together at most, on average.
BLOCK_ROWS = 100_000


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) of every document's pieces.

    A document is its ids and the end id 0; only a longer one is cut, into full pieces after a first that may be
    shorter. Null text: the end id alone.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {f: [] for f in schema.names}
            doc_ids = batch.column("doc_id").to_pylist()
            for i, ids in encoded_batches(batch, tokenizer_path):
                ids += END
                n = len(ids) // 4
                first = n - capacity * ((n - 1) // capacity)
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    part = ids[4 * start : 4 * (start + (capacity if k else first))]
                    row = (doc_ids[i], k, start, len(part) // 4, zlib.crc32(part), part)
                    for name, value in zip(schema.names, row):
                        out[name].append(value)
            yield records(schema, out)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return documents_of(docs).mapInArrow(giving_back(cut, forget), ddl)


def fullest(counts: list[int], room: int) -> list[int]:
    """Lengths of a combination, each used counts[length] times at most, whose sum comes nearest to room.

    Bitset dynamic programming from the longest length down: bit s of a set says that some combination sums to s.
    Multiples of a length are added in powers of two, so that few sets are needed, and the search ends once room
    itself is reached.
    """
    steps: list[tuple[int, int, int]] = []  # the set before, a length, how often it is added at once
    bits, within = 1, (1 << (room + 1)) - 1
    for length in range(room, 0, -1):
        left, power = min(counts[length], room // length), 1
        while left:
            k = min(power, left)
            steps.append((bits, length, k))
            bits |= (bits << (length * k)) & within
            left, power = left - k, power * 2
            if bits >> room:
                break
        if bits >> room:
            break
    total, chosen = bits.bit_length() - 1, []
    for before, length, k in reversed(steps):
        if not (before >> total) & 1:
            total -= length * k
            chosen += [length] * k
    return chosen


def minimum_bin_slack(counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies in a bin, first bin, offset) that place every piece by its rank
    among the pieces of its length.

    Each bin takes the longest length left, and then the fullest combination of the others for the room that
    remains; the same combination is removed as often as the counts allow. counts has capacity + 1 entries, so the
    work and the rows are bounded by the capacity, not by the number of documents.
    """
    counts, used, rows, bins = list(counts), [0] * (capacity + 1), [], 0
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            combination = fullest(counts, capacity - longest)
            counts[longest] += 1
            chosen: dict[int, int] = {}
            for length in [longest, *combination]:
                chosen[length] = chosen.get(length, 0) + 1
            times, offset = min(counts[x] // c for x, c in chosen.items()), 0
            for length, c in chosen.items():
                rows.append((length, used[length], used[length] + c * times, c, bins, offset))
                used[length] += c * times
                counts[length] -= c * times
                offset += length * c
            bins += times
    return rows


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a stored table, as it is read twice).

    The counts of lengths (capacity rows at most) are planned on the driver. Ranks within a length come from blocks
    of a hash, so that a length which a third of all pieces have is spread over many tasks.
    """
    counts, total = [0] * (capacity + 1), 0
    for length, n in cut.groupBy("length").count().collect():
        counts[length] = n
        total += n
    rows = np.array(minimum_bin_slack(counts, capacity) or np.zeros((0, 6)), np.int64)
    plan = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    blocks = max(32, total // BLOCK_ROWS)
    c = cut.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(blocks)))
    sizes = c.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_block", (F.sum("_n").over(Window.partitionBy("length").orderBy("_block")) - F.col("_n")).alias("_before"))
    ranked = c.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "_block"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_block", "_before")
    # ranks of a length are looked up among its rows of the plan: one sorted key holds both
    width = int(max(counts)) + 1
    keys = plan[:, 0] * width + plan[:, 1]

    def place(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = t["length"].to_numpy(), t["_rank"].to_numpy()
            at = plan[np.searchsorted(keys, length * width + rank, "right") - 1]
            k = rank - at[:, 1]
            out = t.drop_columns("_rank").append_column("sequence_id", pa.array(at[:, 4] + k // at[:, 3]))
            out = out.append_column("offset", pa.array(at[:, 5] + k % at[:, 3] * length))
            yield from out.to_batches()

    names = [f"`{n}` {kind}" for n, kind in ranked.dtypes if n != "_rank"]
    return ranked.mapInArrow(giving_back(place), ", ".join([*names, "sequence_id long", "offset long"]))


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold capacity ids at most and have no gaps. with_ids also carries the ids, so that the sequences can
    be written. Null text counts as empty (one piece, the end id); repeated rows are packed each; other columns are
    dropped; empty table: no rows. Null doc_id is kept as it is.
    """
    out = packed(stored(pieces(docs, tokenizer_path, capacity, with_ids)), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
