"""Substring dedup by compact windows: near-duplicate passages that documents share, and their removal.

A document is its sequence of five-word shingles. Under one hash function, the node of a Cartesian tree over the
shingles' hashes stands for all subsequences whose minimum is at its place; those of PASSAGE words or more form a
compact window (left, place, right), of which there are about 2 n / PASSAGE. Windows of two documents with the same
minimum hold subsequences that agree in that hash function; they meet in one task, where the intervals around their
minima are joined and the shared passage is verified on the shingles.

Every window is compared with the smallest text of its minimum, and those that aren't linked to it with all smaller
ones. A minimum that very many windows have is dealt out in blocks; what is first in its block is then compared with
the other blocks. Each window is reported with one text that it is linked to, so rows follow windows, not pairs.

Windows that share too few shingles with all others of their minimum to be linked to any take no part in this, and of
windows that look the same but for shingles that no other text holds, the first stand for all; neither changes a link.
So a short line that very many texts hold, or a word that they repeat, costs less than the square of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import (
    SHINGLE, SIMILARITY_PERCENT, broadcast_if_small, documents_of, each_chunk, each_text, giving_back, identity, in_map, key_map,
    map_bits, mix, records, shingles, signed, stored, whole_runs,
)

#: Words and shingles of the shortest passage.
PASSAGE = 50
LEAST = PASSAGE - SHINGLE + 1
#: Hash functions. One of them must agree: passages of similarity 0.8 fail with a chance of 0.002, exact copies never.
HASHES = 4
#: Windows of one minimum that meet at once; of more, blocks of about so many.
BLOCK = 1024
#: Shingles on either side of a minimum that are compared: with those, every subsequence of LEAST around it is whole.
REACH = LEAST - 1
WIDTH = 2 * REACH + 1
#: Windows of a run from which it is looked first which of them others can be linked to, and blocks of a key for each
#: piece of its shingles.
THINNED, PIECE = 64, 4
#: Bits of the sketches by which pairs are sorted out first, and the share of the common shingles that a passage needs
#: (41, or as many different ones as make up so many places) that must be common bits: fewer are an unlikely number of
#: collisions.
SKETCH_BITS, COMMON_SHARE, COARSE_BITS, COARSE_SHARE = 2048, 0.9, 512, 0.73

_A = np.random.default_rng(4711).integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(815).integers(1 << 62, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)


def hashed(s: np.ndarray, k: int) -> np.ndarray:
    x = s * _A[k]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _sliding(v: np.ndarray, width: int, choose: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each `width` neighbours, by spans that double."""
    span = 1
    while 2 * span <= width:
        v = choose(v[:-span], v[span:])
        span *= 2
    return choose(v[: len(v) - (width - span)], v[width - span :]) if span < width else v


def minima(v: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Places that are a minimum of `least` neighbours within one of the stretches [begins[i], ends[i])."""
    if len(v) < least:
        return np.zeros(0, np.int64)
    low = _sliding(v, least, np.minimum)
    allowed = np.zeros(len(low) + 1, np.int32)
    last = ends - least + 1
    np.add.at(allowed, begins[last > begins], 1)
    np.add.at(allowed, last[last > begins], -1)
    low = np.where(np.cumsum(allowed[:-1]) > 0, low, np.uint64(0))
    edge = np.zeros(least - 1, np.uint64)
    best = _sliding(np.concatenate((edge, low, edge)), least, np.maximum)
    return np.flatnonzero((best == v) & (best > 0))


def compact_windows(v: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Rows (left, place of the minimum, right) of the Cartesian tree nodes of each stretch that span least elements.

    All ancestors of such a node span as many, so only places that are minima of `least` neighbours are looked at.
    Of equal minima the first counts as the smaller; values are above 0.
    """
    at = minima(v, begins, ends, least)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    stretch = np.searchsorted(begins, at, "right") - 1
    first, left, right = begins[stretch].tolist(), np.empty(len(at), np.int64), ends[stretch] - 1
    values, places = v[at].tolist(), at.tolist()
    stack: list[int] = []
    for i, x in enumerate(values):
        if stack and first[stack[-1]] != first[i]:
            stack = []
        while stack and values[stack[-1]] > x:
            right[stack.pop()] = places[i] - 1
        left[i] = places[stack[-1]] + 1 if stack else first[i]
        stack.append(i)
    return np.stack((left, at, right), axis=1)[right - left + 1 >= least]


def _windows_of(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of the words h of several texts (text i: bounds[i] to bounds[i + 1]), their windows, and the windows'
    keys (48 bits of the minimum, and the hash function)."""
    s = shingles(h)
    # of equal shingles that with the smallest successor is the minimum: repetitive texts then have fewer minima
    follows = np.zeros(len(s), np.uint64)
    follows[: max(len(s) - SHINGLE, 0)] = s[SHINGLE:]
    last = bounds[1:] - SHINGLE + 1
    for k in range(SHINGLE):
        follows[np.clip(last - 1 - k, 0, max(len(s) - 1, 0))] = 0
    follows = follows >> np.uint64(48) | np.uint64(4)
    windows, keys = [], []
    for k in range(HASHES):
        v = hashed(s, k) & ~np.uint64(0xFFFF) | follows
        w = compact_windows(v, bounds[:-1], last, LEAST)
        windows.append(w)
        keys.append((v[w[:, 1]] >> np.uint64(16) << np.uint64(2) | np.uint64(k)).view(np.int64))
    return s, np.concatenate(windows), np.concatenate(keys)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (identity of the words), n_words and keys of the documents that are long enough to hold
    a passage."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()), ("n_words", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for numbers, h, bounds in each_chunk(batch.column("text").to_pylist(), lower=True, least=PASSAGE):
                _, w, key = _windows_of(h, bounds)
                text = np.searchsorted(bounds, w[:, 1], "right") - 1
                order = np.argsort(text, kind="stable")
                offsets = np.searchsorted(text[order], np.arange(len(numbers) + 1)).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order]))
                node = [identity(h[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]
                own = [batch.column(c).take(pa.array(numbers)) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(node), pa.array(np.diff(bounds)), keys], schema=schema)

    return docs.select("doc_id", "text", _text_hash()).mapInArrow(giving_back(run), "doc_id long, text_hash long, node binary, n_words long, keys array<long>")


def _text_hash():
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def _windows(docs: DataFrame, bitmap: bytes, first: bytes) -> DataFrame:
    """key, node, cx (the WIDTH shingles around the minimum that are in the window, 32 bits each, 0 outside) and places
    (of the minima of the node's windows that look so) of what may be in the bitmap of keys. Documents that aren't in
    the bitmap of ids are left out: they are copies of others."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.binary()), ("cx", pa.binary()), ("places", pa.list_(pa.int32()))])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            texts = batch.column("text").filter(pa.array(in_map(batch.column("k").to_numpy(), first))).to_pylist()
            for _, h, bounds in each_chunk(texts, lower=True, least=PASSAGE):
                nodes = [identity(h[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]
                new = np.array([not (x in seen or seen.add(x)) for x in nodes])
                s, w, key = _windows_of(h, bounds)
                text = np.searchsorted(bounds, w[:, 1], "right") - 1
                hit = in_map(key, bitmap) & new[text]
                w, key, text = w[hit], key[hit], text[hit]
                s = np.maximum((s >> np.uint64(32)).astype(np.uint32), 2)
                for at in range(0, len(w), 8192):
                    yield from _looks(s, w[at : at + 8192], key[at : at + 8192], text[at : at + 8192], bounds, nodes)

    def _looks(s, w, key, text, bounds, nodes):
        place = w[:, 1:2] + np.arange(-REACH, REACH + 1)
        cx = np.where((place >= w[:, :1]) & (place <= w[:, 2:]), s[np.clip(place, 0, len(s) - 1)], np.uint32(0))
        look = (cx * _PLACES).sum(axis=1, dtype=np.uint64) * np.uint64(3) + key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + text.astype(np.uint64) * _PLACES[0]
        order = np.argsort(look, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], look[order][1:] != look[order][:-1])))
        one = order[begins]
        places = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)).astype(np.int32)), pa.array((w[order, 1] - bounds[text[order]]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(key[one]), pa.array([nodes[i] for i in text[one]], pa.binary()), pa.array([x.tobytes() for x in cx[one]], pa.binary()), places], schema=schema)

    return docs.select(F.xxhash64("doc_id").alias("k"), "text").mapInArrow(giving_back(run), "key long, node binary, cx binary, places array<int>")


def _needed(cx: np.ndarray, percent: int) -> np.ndarray:
    """How many different shingles of each row make up the places that two similar passages of LEAST share."""
    need = -(-2 * LEAST * percent // (100 + percent))
    cx = np.sort(cx, axis=1)
    at = np.arange(WIDTH)
    begins = np.concatenate((np.ones((len(cx), 1), bool), cx[:, 1:] != cx[:, :-1]), axis=1)
    ends = np.concatenate((begins[:, 1:], np.ones((len(cx), 1), bool)), axis=1)
    runs = np.where(ends & (cx > 0), at - np.maximum.accumulate(np.where(begins, at, 0), axis=1) + 1, 0)
    total = np.cumsum(-np.sort(-runs, axis=1), axis=1)
    return (total < need).sum(axis=1) + 1


def _first_places(cx: np.ndarray) -> np.ndarray:
    """For each place of each row, the first with the same shingle."""
    order = np.argsort(cx, axis=1, kind="stable")
    x = np.take_along_axis(cx, order, axis=1)
    begins = np.concatenate((np.ones((len(cx), 1), bool), x[:, 1:] != x[:, :-1]), axis=1)
    first = np.maximum.accumulate(np.where(begins, np.arange(WIDTH), 0), axis=1)
    out = np.empty(cx.shape, np.uint64)
    np.put_along_axis(out, order, np.take_along_axis(order, first, axis=1).astype(np.uint64), axis=1)
    return out


def _slices(x: np.ndarray, y: np.ndarray, size: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, max(len(x), 1), size):
        yield x[at : at + size], y[at : at + size]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values above 0 of each row."""
    x = np.sort(x, axis=1)
    return ((x[:, 1:] != x[:, :-1]) & (x[:, 1:] > 0)).sum(axis=1) + (x[:, 0] > 0)


def _sides(inside: np.ndarray, valid: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the stretches of 0 to REACH shingles before the minimum, and of 1 to REACH + 1 from it on: 0 or more
    where the shared ones are as many as the similarity needs."""
    score = np.where(inside, 100 - percent, np.where(valid, -2 * percent, -20_000)).astype(np.int32)
    back = np.zeros((len(score), REACH + 1), np.int32)
    np.cumsum(score[:, :REACH][:, ::-1], axis=1, out=back[:, 1:])
    return back, np.cumsum(score[:, REACH:], axis=1, dtype=np.int32)


def possible(inside: np.ndarray, valid: np.ndarray, percent: int) -> np.ndarray:
    """Whether some stretch of LEAST shingles or more around the minimum has a score of 0 or more."""
    back, ahead = _sides(inside, valid, percent)
    best = np.maximum.accumulate(back[:, ::-1], axis=1)  # of the stretches before it that are long enough
    return (best + ahead >= 0).any(axis=1)


def _stretches(inside: np.ndarray, valid: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Begins and ends of stretches around the minimum of each row, of two kinds: that which scores best, and, of those
    with a score of 0 or more and LEAST shingles, the shortest that has the most shared ones."""
    back, ahead = _sides(inside, valid, percent)
    yield REACH - back.argmax(axis=1), REACH + ahead.argmax(axis=1) + 1
    length = np.arange(REACH + 1, dtype=np.int32)
    length = length[:, None] + length[None, :] + 1
    before = np.zeros(back.shape, np.int32)
    np.cumsum(inside[:, :REACH][:, ::-1], axis=1, out=before[:, 1:])
    shared = before[:, :, None] + np.cumsum(inside[:, REACH:], axis=1, dtype=np.int32)[:, None, :]
    worth = np.where((back[:, :, None] + ahead[:, None, :] >= 0) & (length >= LEAST), WIDTH * shared - length, -1).reshape(len(inside), -1)
    at = worth.argmax(axis=1)
    none = worth[np.arange(len(at)), at] < 0
    yield np.where(none, REACH, REACH - at // (REACH + 1)), np.where(none, REACH, REACH + at % (REACH + 1) + 1)


def shared_passages(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows x[i], y[i] of shingles around minima: which share a passage around them, its begin and end in y, and
    the similarity of the two passages. An exactly equal one comes before a similar one."""
    begin, end, similarity = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x))
    same = (x == y) & (x > 0)
    z0 = REACH - np.cumprod(same[:, :REACH][:, ::-1], axis=1).sum(axis=1)
    z1 = REACH + np.cumprod(same[:, REACH:], axis=1).sum(axis=1)
    ok = z1 - z0 >= LEAST
    begin[ok], end[ok], similarity[ok] = z0[ok], z1[ok], 1.0
    some = np.flatnonzero(~ok)
    x, y = x[some], y[some]
    equal = (x[:, :, None] == y[:, None, :]) & (x > 0)[:, :, None]
    in_y, in_x = equal.any(axis=2), equal.any(axis=1)
    left = np.flatnonzero(possible(in_y, x > 0, percent) & possible(in_x, y > 0, percent))
    if not len(left):
        return ok, begin, end, similarity
    some, x, y, equal, in_y, in_x, at = some[left], x[left], y[left], equal[left], in_y[left], in_x[left], np.arange(WIDTH)
    for (x0, x1), (y0, y1) in zip(_stretches(in_y, x > 0, percent), _stretches(in_x, y > 0, percent)):
        in_p, in_q = ((at >= lo[:, None]) & (at < hi[:, None]) for lo, hi in ((x0, x1), (y0, y1)))
        p, q = _distinct(np.where(in_p, x, 0)), _distinct(np.where(in_q, y, 0))
        both = _distinct(np.where((equal & in_q[:, None, :]).any(axis=2) & in_p, x, 0))
        new = (x1 - x0 >= LEAST) & (y1 - y0 >= LEAST) & (100 * both >= percent * (p + q - both)) & ~ok[some]
        ok[some[new]], begin[some[new]], end[some[new]] = True, y0[new], y1[new]
        similarity[some[new]] = both[new] / np.maximum(p + q - both, 1)[new]
        if new.all():
            break
    return ok, begin, end, similarity


class Windows:
    """Windows of some keys, sorted by run of key and then by node."""

    def __init__(self, t: pa.Table, percent: int, *keys: str):
        self.percent = percent
        run = np.cumsum(np.concatenate(([False], np.any([t[k].to_numpy()[1:] != t[k].to_numpy()[:-1] for k in keys], axis=0))))
        node = np.frombuffer(b"".join(t["node"].to_pylist()), ">u8").reshape(-1, 2)
        order = np.lexsort((node[:, 1], node[:, 0], run))
        self.table, run = t.take(pa.array(order)), run[order]
        node = node[order].astype(np.uint64)
        self.node = np.cumsum(np.concatenate(([False], (node[1:] != node[:-1]).any(axis=1)))) - 1  # numbers; only for comparison within a run
        self.cx = np.frombuffer(b"".join(self.table["cx"].to_pylist()), np.uint32).reshape(-1, WIDTH)
        self.begin = np.searchsorted(run, run)
        self.bit = (self.cx % SKETCH_BITS).astype(np.uint16)
        self.bits = np.zeros((len(run), SKETCH_BITS), bool)
        self.bits[np.arange(len(run))[:, None], self.bit] = True
        self.sketch = np.packbits(self.bits, axis=1).view(np.uint64)
        self.coarse = np.packbits(self.bits.reshape(len(run), -1, COARSE_BITS).any(axis=1), axis=1).view(np.uint64)
        needed = _needed(self.cx, percent)
        self.least, self.coarse_least = np.floor(COMMON_SHARE * needed).astype(np.int64), np.floor(COARSE_SHARE * needed).astype(np.int64)
        self.run = run
        self.may, self.stands = np.ones(len(run), bool), np.ones(len(run), bool)
        self.linked = np.full(len(run), -1)
        self.spans = np.zeros((len(run), 2), np.int64)
        self.similarity = np.zeros(len(run))

    def thin(self, eligible: np.ndarray | None = None) -> None:
        """In long runs, which windows may be linked to any: whose shingles that another text of the run holds allow a
        passage; and which of those that are eligible stand for all that look so: the first, and the first of another
        text. Looks differ in shingles that others hold, and in which of the rest are equal."""
        rows = np.flatnonzero(np.bincount(self.run, minlength=1)[self.run] >= THINNED)
        cuts = np.flatnonzero(np.diff(self.run[rows] if len(rows) else rows)) + 1
        for rows in np.split(rows, cuts) if len(rows) else ():
            cx, node = self.cx[rows], self.node[rows]
            order = np.argsort(cx, axis=None, kind="stable")  # of equal shingles, by node
            flat, of = cx.ravel()[order], node[order // WIDTH]
            begins = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            ends = np.append(begins[1:], len(flat))
            shared = np.empty(cx.size, bool)
            shared[order] = np.repeat(of[begins] != of[ends - 1], ends - begins)
            shared = shared.reshape(cx.shape) & (cx > 0)
            self.may[rows] = may = possible(shared, cx > 0, self.percent)
            self.stands[rows] = False
            if eligible is not None:
                may = may & eligible[rows]
            rows, cx, node, shared = rows[may], cx[may], node[may], shared[may]
            if len(rows):
                look = np.where(shared | (cx == 0), cx.astype(np.uint64), _first_places(cx) + np.uint64(1 << 32))
                _, first, kind = np.unique(np.ascontiguousarray(look).view(f"V{8 * WIDTH}").ravel(), return_index=True, return_inverse=True)
                other = np.flatnonzero(node != node[first][kind.ravel()])
                _, second = np.unique(kind.ravel()[other], return_index=True)
                self.stands[rows[first]] = self.stands[rows[other[second]]] = True

    def _near(self, ys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y) of windows y of ys and x of lo to hi whose coarse sketches allow a passage, some at a time in
        order of y. Long ranges are compared as products of matrices of bits."""
        at = np.concatenate(([0], np.cumsum(hi - lo)))
        long = hi - lo >= 64
        cut = np.flatnonzero(np.concatenate(([True], (long[1:] != long[:-1]) | (long[1:] & (lo[1:] != lo[:-1])))))
        for a, b in zip(cut, np.append(cut[1:], len(ys))):
            if not long[a]:
                edges = np.unique(np.append(np.searchsorted(at[a:b], np.arange(at[a], at[b], 50_000)) + a, b))
                for c, d in zip(edges[:-1], edges[1:]):
                    some = np.arange(c, d)[self.linked[ys[c:d]] < 0]
                    n = (hi - lo)[some]
                    y = np.repeat(ys[some], n)
                    x = np.repeat(lo[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    x, y = x[self.stands[x]], y[self.stands[x]]
                    common = np.bitwise_count(self.coarse[x] & self.coarse[y]).sum(axis=1, dtype=np.int64)
                    keep = common >= np.maximum(self.coarse_least[x], self.coarse_least[y])
                    yield x[keep], y[keep]
                continue
            xs = int(lo[a]) + np.flatnonzero(self.stands[lo[a] : hi[a:b].max()])
            bits = np.unpackbits(self.coarse[xs].view(np.uint8), axis=1).astype(np.float32)
            for c in range(a, b, 256):
                some = np.arange(c, min(c + 256, b))[self.linked[ys[c : min(c + 256, b)]] < 0]
                own = np.unpackbits(self.coarse[ys[some]].view(np.uint8), axis=1).astype(np.float32)
                common = own @ bits.T
                near = common >= np.maximum(self.coarse_least[ys[some]][:, None], self.coarse_least[xs][None, :])
                near &= xs[None, :] < hi[some][:, None]
                i, j = np.nonzero(near)
                for k in range(0, max(len(i), 1), 50_000):
                    yield xs[j[k : k + 50_000]], ys[some][i[k : k + 50_000]]

    def search(self, ys: np.ndarray, lo: np.ndarray, hi: np.ndarray, allowed=None) -> None:
        """Links each window of ys that isn't yet with the first it can be among the windows lo to hi."""
        percent, may = self.percent, self.may[ys]
        ys, lo, hi = ys[may], lo[may], hi[may]
        for x, y in self._near(ys, lo, hi) if len(ys) else ():
            keep = (self.node[x] != self.node[y]) & (self.linked[y] < 0)
            if allowed is not None:
                keep &= allowed(x, y)
            x, y = x[keep], y[keep]
            turn = 1
            while len(y):  # the first of each window's candidates that is left, then the next two, and so on
                rank = np.arange(len(y)) - np.searchsorted(y, y)
                for p, q in _slices(x[rank < turn], y[rank < turn], 4096):
                    for k, m in _slices(*self._alike(p, q), 512):
                        ok, begin, end, similarity = shared_passages(self.cx[k], self.cx[m], percent)
                        for j in np.flatnonzero(ok & (self.linked[m] < 0))[::-1]:
                            self.linked[m[j]], self.spans[m[j]], self.similarity[m[j]] = k[j], (begin[j], end[j]), similarity[j]
                left = (rank >= turn) & (self.linked[y] < 0)
                x, y, turn = x[left], y[left], 2 * turn

    def _alike(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs with enough common bits, in stretches around the minimum that are long enough."""
        common = np.bitwise_count(self.sketch[x] & self.sketch[y]).sum(axis=1, dtype=np.int64)
        keep = common >= np.maximum(self.least[x], self.least[y])
        x, y = x[keep], y[keep]
        for back in (False, True):
            p, q = (y, x) if back else (x, y)
            keep = possible(self.bits[q[:, None], self.bit[p]] & (self.cx[p] > 0), self.cx[p] > 0, self.percent)
            x, y = x[keep], y[keep]
        return x, y

    def found(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows (node, other, first, end, similarity) of the windows that are linked, one for each place."""
        y = np.flatnonzero(self.linked >= 0)
        if len(y):
            lists = self.table["places"].combine_chunks().take(pa.array(y))
            row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
            at = lists.flatten().to_numpy().astype(np.int64)
            node = self.table["node"].combine_chunks()
            out = {"node": node.take(pa.array(y[row])), "other": node.take(pa.array(self.linked[y][row])), "similarity": self.similarity[y][row]}
            out |= {k: at + self.spans[y, i][row] - REACH for i, k in enumerate(("first", "end"))}
            yield records(schema, out | {f.name: pa.nulls(len(row), f.type) for f in schema if f.name not in out})


_SPAN = [("node", pa.binary()), ("other", pa.binary()), ("first", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())]
_SPAN_DDL = "node binary, other binary, first long, end long, similarity double"


def _within_blocks(windows: DataFrame, percent: int) -> DataFrame:
    """Spans from the windows (key, block, blocks, node, cx, places), and, with a key, the windows themselves where a
    key has several blocks; head: that no smaller window of the block is linked to it."""
    schema = pa.schema([*_SPAN, ("key", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("head", pa.bool_()), ("cx", pa.binary()), ("places", pa.list_(pa.int32()))])

    def run(batches):
        for t in whole_runs(batches, "key", "block"):
            w = Windows(t, percent, "key", "block")
            w.thin()
            rows = np.arange(len(w.begin))
            ys = rows[rows > w.begin]
            w.search(ys, w.begin[ys], w.begin[ys] + 1)
            ys = rows[(rows > w.begin + 1) & (w.linked < 0)]
            w.search(ys, w.begin[ys] + 1, ys)
            yield from w.found(schema)
            many = w.table.append_column("head", pa.array(w.linked < 0)).filter(pa.compute.greater(w.table["blocks"], 1))
            if many.num_rows:
                some = {f.name: many[f.name].combine_chunks() if f.name in many.column_names else pa.nulls(many.num_rows, f.type) for f in schema}
                yield records(schema, some)

    import pyarrow.compute  # noqa: F401  (pa.compute)

    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = windows.repartition(n, "key", "block").sortWithinPartitions("key", "block").select("key", "block", "blocks", "node", "cx", "places")
    return dealt.mapInArrow(giving_back(run), f"{_SPAN_DDL}, key long, block int, blocks int, head boolean, cx binary, places array<int>")


def _codes(key: np.ndarray, cx: np.ndarray) -> np.ndarray:
    """64-bit hashes of (key, shingle)."""
    return mix(mix(key.view(np.uint64))[:, None] + cx)


def _of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("key").to_numpy(), np.frombuffer(b"".join(batch.column("cx").to_pylist()), np.uint32).reshape(-1, WIDTH)


def _linkable(many: DataFrame, percent: int) -> DataFrame:
    """The windows whose shingles that other blocks of their key hold, too, allow a passage: others can't be linked across
    blocks. Which shingles these are is a bitmap of bounded size, which may let others pass."""

    def pieces(batches):
        """Of each block the shingles, in pieces that grow in number with the blocks of their key."""
        schema = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("block", pa.int32()), ("shingles", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                (key, cx), block, blocks = _of(some), *(some.column(c).to_numpy() for c in ("block", "blocks"))
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
                own = np.flatnonzero(new)
                piece = (cx * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % -(-blocks // PIECE).astype(np.uint64)[:, None]
                place = (np.cumsum(new) - 1).astype(np.uint64)[:, None] << np.uint64(48) | piece << np.uint64(32) | cx
                place = np.unique(place[cx > 0])
                begins = np.flatnonzero(np.concatenate(([True], np.diff(place >> np.uint64(32)) != 0)))
                of = own[(place[begins] >> np.uint64(48)).astype(np.int64)]
                data = np.split(place.astype(np.uint32), begins[1:])
                yield records(schema, {"key": key[of], "piece": (place[begins] >> np.uint64(32)).astype(np.uint16), "block": block[of], "shingles": [x.tobytes() for x in data]})

    def in_several(t: pa.Table) -> pa.Table:
        data = t["shingles"].to_pylist()
        block, x = np.repeat(t["block"].to_numpy(), [len(y) // 4 for y in data]), np.frombuffer(b"".join(data), np.uint32)
        order = np.lexsort((block, x))
        x, block = x[order], block[order]
        begins = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        x = x[begins[block[begins] != block[np.append(begins[1:], len(x)) - 1]]]
        return pa.table({"code": signed(_codes(t["key"].to_numpy()[:1], x[None, :]).ravel())})

    cut = many.select("key", "block", "blocks", "cx").mapInArrow(giving_back(pieces), "key long, piece int, block int, shingles binary")
    shared = stored(cut.groupBy("key", "piece").applyInArrow(in_several, "code long"))
    bitmap = key_map(shared, "code", map_bits(shared.count()))

    def run(batches):
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 4096):
                key, cx = _of(batch.slice(at, 4096))
                keep.append(possible(in_map(signed(_codes(key, cx)), bitmap) & (cx > 0), cx > 0, percent))
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return stored(many.mapInArrow(giving_back(run), many.schema))


def _across_blocks(many: DataFrame, percent: int) -> DataFrame:
    """Spans of the heads of blocks that are linked to a smaller window of another block of their key.

    The blocks were sized by the texts of a key; here, the windows and the heads that there really are make blocks and
    pages of bounded size, and each block meets each page. Where both are few, that is one task's work.
    """
    many = _linkable(many, percent)
    sizes = many.groupBy("key").agg(F.expr(f"CAST(ceil(count(*) / {4 * BLOCK}) AS int)").alias("blocks"), F.expr(f"CAST(ceil(count_if(head) / {2 * BLOCK}) AS int)").alias("pages"))
    at = many.withColumnRenamed("block", "own").drop("blocks").join(sizes, "key")
    place = lambda n: F.expr(f"CAST(pmod(xxhash64(node, cx, own), {n}) AS int)")
    left = at.where("head").withColumn("page", place("pages")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    right = at.withColumn("block", place("blocks")).withColumn("page", F.explode(F.expr("sequence(0, pages - 1)")))
    names = ["key", "block", "page", "own", "searched", "node", "cx", "places"]
    both = left.withColumn("searched", F.lit(True)).select(names).union(right.withColumn("searched", F.lit(False)).select(names))
    schema = pa.schema(_SPAN)

    def run(batches):
        for t in whole_runs(batches, "key", "block", "page"):
            w = Windows(t, percent, "key", "block", "page")
            searched, own = w.table["searched"].to_numpy(), w.table["own"].to_numpy()
            w.thin(~searched)
            ys = np.flatnonzero(searched)
            w.search(ys, w.begin[ys], ys, lambda x, y: ~searched[x] & (own[x] != own[y]))
            yield from w.found(schema)

    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "key", "block", "page").sortWithinPartitions("key", "block", "page").mapInArrow(giving_back(run), _SPAN_DDL)


def repeated_passages(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, text_hash, start_word, end_word (exclusive), dup_of, similarity: passages of at least PASSAGE words that
    the document dup_of also holds, at a similarity of five-word shingle sets of percent or more. text_hash tells texts
    that share a doc_id apart; rows equal in both share their passages.

    Words are lower-cased in A-Z. Of documents with the same words, one without a doc_id, or else the one with the
    smallest, stands for all; each other is one passage as a whole. Of two others, the passage is reported in the one
    that is later in a fixed order of content hashes, so at least one copy is never reported. Each window of a text is
    reported with one text that it is linked to; what overlaps with the same text is one passage, with the least
    similarity of its parts. Null, empty and shorter texts: no rows. Repeated rows count as copies. Null doc_id: stands
    for its copies. Other columns are dropped; empty table: no rows.
    """
    d = documents_of(docs)
    rows = stored(_rows(d))
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "text_hash")).alias("x"), F.count("*").alias("copies")).select("node", "x.doc_id", "x.text_hash", "copies"))
    shared = rows.select(F.explode(F.array_distinct("keys")).alias("key"), F.xxhash64("node").alias("half")).groupBy("key")
    shared = stored(shared.agg(F.min("half").alias("_first"), F.max("half").alias("_last"), F.count("*").alias("n")).where("_first <> _last").select("key", "n"))
    first = key_map(nodes.select(F.xxhash64("doc_id").alias("k")), "k", map_bits(nodes.count()))
    windows = _windows(d, key_map(shared, "key", map_bits(shared.count())), first)
    hot = shared.where(F.col("n") > BLOCK).select("key", F.expr(f"CAST(ceil(n / {BLOCK}) AS int)").alias("blocks"))
    windows = windows.join(broadcast_if_small(stored(hot)), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    windows = windows.withColumn("block", F.expr("CAST(pmod(xxhash64(node), blocks) AS int)"))
    met = stored(_within_blocks(windows, percent))
    spans = met.where("key is null").select("node", "other", "first", "end", "similarity")
    many = met.where("key is not null").select("key", "block", "blocks", "head", "node", "cx", "places")
    spans = spans.union(_across_blocks(many, percent))
    spans = _merged(stored(spans.withColumn("end", F.col("end") + SHINGLE - 1)))
    names = nodes.select("node", "doc_id", "text_hash")
    spans = spans.join(names, "node").join(nodes.select(F.col("node").alias("other"), F.col("doc_id").alias("dup_of")), "other")
    spans = spans.select("doc_id", "text_hash", F.col("first").alias("start_word"), F.col("end").alias("end_word"), "dup_of", "similarity")
    several = nodes.where("copies > 1").select("node", F.col("doc_id").alias("dup_of"), F.col("text_hash").alias("_hash"))
    copies = rows.select("doc_id", "text_hash", "node", "n_words").join(several, "node").where(~(F.col("doc_id").eqNullSafe(F.col("dup_of")) & (F.col("text_hash") == F.col("_hash"))))
    return spans.unionByName(copies.select("doc_id", "text_hash", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), "dup_of", F.lit(1.0).alias("similarity")))


def _islands(spans: DataFrame) -> DataFrame:
    """Spans (node, other, first, end, similarity) of the same two texts that overlap as one."""
    pair = ["node", "other"]
    before = Window.partitionBy(*pair).orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    begins = (F.col("first") > F.coalesce(F.max("end").over(before) - SHINGLE + 1, F.lit(-1))).cast("int")
    spans = spans.withColumn("_b", begins).withColumn("_i", F.sum("_b").over(Window.partitionBy(*pair).orderBy("first", "end")))
    return spans.groupBy(*pair, "_i").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.min("similarity").alias("similarity")).drop("_i")


def _merged(spans: DataFrame) -> DataFrame:
    """Exact stretches as islands, and similar ones that reach beyond those by PASSAGE words or more."""
    exact = _islands(spans.where("similarity = 1"))
    near = spans.where("similarity < 1").groupBy("node", "other", "first", "end").agg(F.min("similarity").alias("similarity"))
    inside = exact.select("node", "other", F.col("first").alias("_f"), F.col("end").alias("_e"))
    covered = F.coalesce(F.sum(F.when(F.col("_f").isNotNull(), F.greatest(F.least("end", "_e") - F.greatest("first", "_f"), F.lit(0)))), F.lit(0))
    near = near.join(inside, ["node", "other"], "left").groupBy("node", "other", "first", "end", "similarity").agg(covered.alias("_c"))
    near = near.where((F.col("_c") == 0) | (F.col("end") - F.col("first") - F.col("_c") >= PASSAGE)).drop("_c")
    return exact.unionByName(_islands(near))


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the words of the spans (doc_id, text_hash, start_word, end_word) cut out of text, and n_chars set
    accordingly where there is such a column; documents of which no word is left go. Other documents stay as they are,
    also those that share a doc_id but not the text. A null doc_id equals a null one."""
    cut = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("_spans"))
    names = docs.columns
    own = docs.withColumns({"_own": F.col("doc_id").cast("long"), "_text": _text_hash()})
    both = own.join(cut, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left")
    kept = both.withColumn("_new", _cut(F.col("text"), F.col("_spans")))
    kept = kept.where("_spans is null or _new is not null").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.col("_new")))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return kept.select(*names)


def _cut(text, spans):
    @F.pandas_udf("string")
    def run(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        some = [i for i, x in enumerate(all_spans) if x is not None and len(x)]
        for j, data, starts, ends, _ in each_text([texts.iloc[i] for i in some]):
            gone = np.zeros(len(starts), bool)
            for x in all_spans.iloc[some[j]]:
                gone[x["start_word"] : x["end_word"]] = True
            if not gone.all():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                at, parts = 0, []
                for lo, hi in zip(edges[0::2].tolist(), edges[1::2].tolist()):
                    parts.append(data[at : starts[lo]])
                    at = int(starts[hi]) if hi < len(starts) else len(data)
                out[some[j]] = b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass")
        return pd.Series(out, index=texts.index, dtype=object)

    return run(text, spans)
