"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are few and short, documents many and long, so the signature of a whole document says nothing about an
item in it. Items are partitioned by size, and for each size class a document is seen as overlapping windows of one
and a half times the largest item, so that every passage of an item's length lies inside some window and makes up a
third of it at least. A window whose MinHash agrees with an item's in any position makes the pair a candidate; the
share of the item's shingles that the document holds is then counted exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SHINGLE, SIMILARITY_PERCENT, documents_of, each_text, giving_back, is_in, records, shingles

#: Hash functions of a signature: an exact copy is missed with a chance of about (2/3)**32, a copy with four fifths
#: of its shingles with about (3/4)**32.
HASHES = 32
#: Size classes double, from items of up to this many shingles on.
SMALLEST_CLASS = 1
#: The largest benchmark that is sent to the executors whole, in characters; larger ones are searched in blocks.
BLOCK_CHARACTERS = 20_000_000

_A = (np.random.default_rng(977).integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint64)


def _hashed(s: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash function: the high half of a product, which orders shingles afresh for each multiplier."""
    x = s * _A[k]
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)


class Items:
    """The items of a block: their shingle sets, and for each size class and hash function the sorted signatures."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.sets = [], []
        classes: dict[int, list[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for i, _, _, _, h in each_text(texts, lower=True):
            if 0 < len(h) < SHINGLE:
                short.setdefault(len(h), []).append((int(shingles(h, len(h))[0]), i))
            if len(h) >= SHINGLE:
                s = np.unique(shingles(h))
                size = SMALLEST_CLASS
                while size < len(h) - SHINGLE + 1:
                    size *= 2
                classes.setdefault(size, []).append(len(self.ids))
                self.ids.append(ids[i])
                self.sets.append(s)
        #: Items of fewer words than a shingle: the sorted hashes of their whole word sequences, by their length.
        self.short = {n: (np.array([h for h, _ in sorted(x)], np.uint64), [ids[i] for _, i in sorted(x)]) for n, x in short.items()}
        self.classes = {}
        for size, members in classes.items():
            signature = np.array([[_hashed(self.sets[m], k).min() for k in range(HASHES)] for m in members], np.uint64)
            order = np.argsort(signature, axis=0, kind="stable")
            self.classes[size] = (np.take_along_axis(signature, order, 0), np.array(members)[order])

    def candidates(self, s: np.ndarray) -> np.ndarray:
        """Rows (first shingle, end, item) of the windows of a shingle sequence whose signature agrees with that of
        an item in some position."""
        found = [np.zeros((0, 3), np.int64)]
        for k in range(HASHES if len(s) else 0):
            h = _hashed(s, k)
            for size, (signature, members) in self.classes.items():
                block = max(size // 2, 1)
                low = np.minimum.reduceat(h, np.arange(0, len(h), block))
                if len(low) > 1:
                    low = np.minimum(low, np.append(low[1:], low[-1]))
                    low = np.minimum(low, np.append(low[1:], low[-1]))
                column = np.ascontiguousarray(signature[:, k])
                lo, hi = np.searchsorted(column, low), np.searchsorted(column, low, "right")
                hit = np.flatnonzero(hi > lo)
                if len(hit):
                    n = hi[hit] - lo[hit]
                    window = np.repeat(hit, n)
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)
                    first = window * block
                    found.append(np.stack((first, np.minimum(first + 3 * block, len(s)), members[at, k]), axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def whole(self, h: np.ndarray) -> list:
        """Ids of the short items whose word sequence is among the words h."""
        found = []
        for n, (hashes, ids) in self.short.items():
            if len(h) >= n:
                own = np.unique(shingles(h, n))
                found += [ids[i] for i in np.flatnonzero(is_in(hashes, own))]
        return found

    def pairs(self, sequences: list[np.ndarray]) -> list[tuple[int, int]]:
        """Candidates (number of the sequence, item) of several sequences, searched as one; a window that spans
        neighbours makes a candidate of each."""
        ends = np.cumsum([len(s) for s in sequences])
        rows = self.candidates(np.concatenate(sequences))
        first, last = np.searchsorted(ends, rows[:, 0], "right"), np.searchsorted(ends, rows[:, 1] - 1, "right")
        return sorted({(d, m) for a, b, m in zip(first.tolist(), last.tolist(), rows[:, 2].tolist()) for d in range(a, b + 1)})


#: Shingles of documents that are searched together.
TOGETHER = 200_000


def _together(batch):
    """(rows, shingle sequences) of a record batch's texts that have any, a bounded number of shingles at a time."""
    rows, sequences, size = [], [], 0
    for i, _, _, _, h in each_text(batch.column("text").to_pylist(), lower=True):
        if len(h) >= SHINGLE:
            rows.append(i)
            sequences.append(shingles(h))
            size += len(sequences[-1])
            if size >= TOGETHER:
                yield rows, sequences
                rows, sequences, size = [], [], 0
    if rows:
        yield rows, sequences


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of each document and item of which it holds at least
    the given share of distinct five-word shingles (words lower-cased in A-Z).

    An item of one to four words is its whole word sequence, found where a document has these words in a row. Items
    without words or with null text are found nowhere. Repeated items and documents give a row for each pair of rows. Null ids are carried as they are.
    Other columns are dropped; an empty table on either side gives no rows. The benchmark is a query set: it is read
    in blocks of bounded size, each searched against all documents.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    d = documents_of(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item_shingles", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())])
    ddl = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"

    def search(block: Items):
        def run(batches):
            for batch in batches:
                out: dict[str, list] = {f: [] for f in schema.names}
                doc_ids = batch.column("doc_id").to_pylist()
                for i, _, _, _, h in each_text(batch.column("text").to_pylist(), lower=True) if block.short else ():
                    for item_id in block.whole(h):
                        for name, value in zip(schema.names, (doc_ids[i], item_id, 1, 1, 1.0)):
                            out[name].append(value)
                for rows, sequences in _together(batch):
                    own: dict[int, np.ndarray] = {}
                    for d, m in block.pairs(sequences):
                        if d not in own:
                            own = {d: np.unique(sequences[d])}
                        item = block.sets[m]
                        at = np.minimum(np.searchsorted(own[d], item), len(own[d]) - 1)
                        shared = int((own[d][at] == item).sum())
                        if 100 * shared >= percent * len(item):
                            for name, value in zip(schema.names, (doc_ids[rows[d]], block.ids[m], len(item), shared, shared / len(item))):
                                out[name].append(value)
                yield records(schema, out)

        return run

    out, ids, texts, size = [], [], [], 0
    for row in items.toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text or "")
        if size >= BLOCK_CHARACTERS:
            out.append(d.mapInArrow(giving_back(search(Items(ids, texts))), ddl))
            ids, texts, size = [], [], 0
    out.append(d.mapInArrow(giving_back(search(Items(ids, texts))), ddl))
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found
