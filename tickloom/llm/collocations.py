"""Phrases that occur more often than their parts would by chance, from count tries of words, five words deep.

A block of documents is a shard: the phrases of a depth are nodes of its count trie. A node is known by the 64-bit hash
of its path (language, then words). A shard goes out as sorted nodes with counts, dealt by prefix range, and the sorted
runs of a range are merged in a stream where they meet. Depth follows depth: a phrase is only counted where both the phrase
without its last word and that without its first were frequent; which these are is a bitmap of bounded size that
may let others pass, and never drops one.

Only frequent phrases are left then, at most one for `least` words of the corpus and depth. Each gets its words from one
block that holds it. Going down the trie, each node takes its left parts from its parent, and its right parts over its
suffix link, from the node of the phrase without its first word.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import give_back, giving_back, hashes_of, in_map, key_map, map_bits, mix, records, signed, stored, whole_runs

#: Words of the longest phrase, its least count, a longer phrase's share (percent) that makes a phrase part of it, and
#: the phrases reported for each language.
DEPTH, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: Bytes of text in a block, blocks of a file, the ranges of a prefix's last words, so that a hot prefix isn't one range,
#: and the nodes of blocks that go out together.
BLOCK_BYTES, FILE_BLOCKS, SLICES, TOGETHER = 1 << 21, 4, 16, 400_000

# What ends a piece, and what ends a word
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?"] + list(range(10, 14))] = True
_WORD_END = _PIECE_END.copy()
_WORD_END[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BLOCK = pa.schema([
    ("block", pa.int64()), ("langs", pa.list_(pa.string())), ("lang_words", pa.list_(pa.int64())), ("keys", pa.binary()), ("lang_of", pa.binary()),
    ("letters", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("joined", pa.binary()),
])
_BLOCK_DDL = "block long, langs array<string>, lang_words array<long>, keys binary, lang_of binary, letters binary, sizes binary, codes binary, joined binary"


def _block(texts: list[bytes], langs: list[str]) -> dict:
    """The words of some texts, as numbers of different (language, word), and which continue the word before."""
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    data = b"\n".join(texts)  # ends a piece
    b = _LOWER[np.frombuffer(data, np.uint8)]
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_WORD_END[b]
    edges = np.flatnonzero(np.diff(inside))
    del inside
    starts, ends = edges[0::2], edges[1::2]
    pieces = np.cumsum(_PIECE_END[b], dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])[:-1]
    lang = np.array([number[x] for x in langs], np.uint16)[np.searchsorted(begins, starts, "right") - 1]
    seeds = hashes_of(*_packed([x.encode("utf-8", "surrogatepass") + b"\n" for x in names]))
    key = mix(_word_hashes(b, starts, ends) * np.uint64(3) + seeds[lang])
    keys, at, codes = np.unique(key, return_index=True, return_inverse=True)
    joined = np.concatenate(([False], pieces[1:] == pieces[:-1])) if len(pieces) else np.zeros(0, bool)
    text = b.tobytes()
    return {
        "block": uuid.uuid4().int >> 65, "langs": names, "lang_words": np.bincount(lang, minlength=len(names)), "keys": keys.tobytes(), "lang_of": lang[at].tobytes(),
        "letters": b"".join([text[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]), "sizes": (ends - starts)[at].astype(np.uint32).tobytes(),
        "codes": codes.astype(np.uint32).tobytes(), "joined": np.packbits(joined).tobytes(),
    }


def _word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 18) -> np.ndarray:
    """Hashes of words, those of some bytes at a time, as the sums that they are made from take eight times the bytes."""
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(b), at_once)), len(starts)))
    out = [hashes_of(b[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]) for i, j in zip(cuts[:-1], cuts[1:])]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _packed(of: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.cumsum([0, *map(len, of)])
    return np.frombuffer(b"".join(of), np.uint8), at[:-1], at[1:]


def blocks(docs: DataFrame) -> DataFrame:
    """The texts as blocks of numbered words, written as a table."""

    def run(batches):
        texts, langs, size = [], [], 0
        row = lambda: records(_BLOCK, {c: [x] for c, x in _block(texts, langs).items()})
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                langs.append(lang)
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield row()
                    texts, langs, size = [], [], 0
        if texts:
            yield row()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return stored(docs.select(F.col("text").cast("string").alias("text"), lang).mapInArrow(giving_back(run), _BLOCK_DDL), FILE_BLOCKS)


class Shard:
    """The trie of a block: places in the text, and the keys of the phrases that begin there, by depth."""

    def __init__(self, keys: bytes, codes: bytes, joined: bytes):
        self.codes = np.frombuffer(codes, np.uint32)
        self.word = np.frombuffer(keys, np.uint64)[self.codes]
        self.joined = np.unpackbits(np.frombuffer(joined, np.uint8), count=len(self.word)).astype(bool)
        self.at, self.key, self.prefix, self.suffix = np.arange(len(self.word)), self.word, None, None

    def deeper(self, depth: int, frequent: bytes) -> None:
        """From phrases of depth - 1 words to those of depth whose first and last depth - 1 words may be frequent."""
        ok = in_map(signed(self.key), frequent)
        at, key = self.at[ok], self.key[ok]
        first = np.flatnonzero((at[1:] == at[:-1] + 1) & self.joined[at[:-1] + depth - 1]) if len(at) else np.zeros(0, np.int64)
        self.at, self.prefix, self.suffix = at[first], key[first], key[first + 1]
        self.key = mix(self.prefix * np.uint64(0xD6E8FEB86659FD93) + self.word[self.at + depth - 1])

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different keys in order, their counts, and where each first occurs."""
        keys, first, n = np.unique(self.key, return_index=True, return_counts=True)
        return keys, n, first


_COUNT = pa.schema([("range", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("block", pa.int64())])


def _frequent(coded: DataFrame, maps: list[bytes], least: int) -> DataFrame:
    """key, n and a block that holds it, of the phrases of one word more than there are bitmaps that occur `least` times.

    Each shard's nodes go out once, with their counts, sorted; the sorted runs of all shards are merged where a prefix
    range meets, in a stream, so a task holds some thousand nodes at a time however many there are.
    """
    parts = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def nodes(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                block, *row = (batch.column(c)[i].as_py() for c in ("block", "keys", "codes", "joined"))
                shard = Shard(*row)
                for depth, frequent in enumerate(maps, 2):
                    shard.deeper(depth, frequent)
                keys, n, first = shard.nodes()
                # a range: of hashed prefixes, cut into slices by the last word; words have no prefix
                of = keys % np.uint64(parts * SLICES)
                if maps:
                    of = mix(shard.prefix[first]) % np.uint64(parts) * np.uint64(SLICES) + keys % np.uint64(SLICES)
                held.append((keys, n, of.astype(np.int32), np.full(len(keys), block)))
                size += len(keys)
                if size >= TOGETHER:
                    yield from together(held)
                    held, size = [], 0
        if held:
            yield from together(held)

    def together(held):
        keys, n, of, block = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")  # merges the sorted blocks
        begins = np.flatnonzero(np.concatenate(([len(keys) > 0], np.diff(keys[order]) != 0)))
        one = order[begins]
        total = np.add.reduceat(n[order], begins) if len(begins) else n
        for at in range(0, len(one), 50_000):
            s = slice(at, at + 50_000)
            yield records(_COUNT, {"range": of[one[s]], "key": signed(keys[one[s]]), "n": total[s], "block": block[one[s]]})

    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("block", pa.int64())])

    def merged(batches):
        for t in whole_runs(batches, "key"):
            keys, n = t["key"].to_numpy(), t["n"].to_numpy()
            begins = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0)))
            total = np.add.reduceat(n, begins)
            hit = total >= least
            # any block that holds a phrase can spell it: which one goes by the phrase, so that no block spells most
            several = np.diff(np.append(begins, len(keys)))
            one = begins + (mix(keys[begins].view(np.uint64)) % several.astype(np.uint64)).astype(np.int64)
            yield records(schema, {"key": keys[begins[hit]], "n": total[hit], "block": t["block"].to_numpy()[one[hit]]})

    counts = coded.select("block", "keys", "codes", "joined").mapInArrow(giving_back(nodes), "range int, key long, n long, block long")
    runs = counts.repartition(2 * parts, "range").sortWithinPartitions("key", "block").select("key", "n", "block")
    return stored(runs.mapInArrow(giving_back(merged), "key long, n long, block long"))


_NODE = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("depth", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("prefix", pa.int64()), ("suffix", pa.int64())])


def _spelled(coded: DataFrame, frequent: list[DataFrame], maps: list[bytes]) -> DataFrame:
    """The frequent phrases with language and words, each from the one block that its row names, and the keys of the
    phrases without the last and without the first word."""
    wanted, deepest = None, len(frequent)
    for depth, df in enumerate(frequent, 1):
        df = df.select(F.col("block").alias("of"), "key", "n", F.lit(depth).alias("depth"))
        wanted = df if wanted is None else wanted.union(df)

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if len(left) and len(right):
            row = left.to_pylist()[0]
            ends = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], np.uint32), dtype=np.int64))).tolist()
            word = lambda c: row["letters"][ends[c] : ends[c + 1]].decode("utf-8", "replace")
            lang_of = np.frombuffer(row["lang_of"], np.uint16)
            shard = Shard(row["keys"], row["codes"], row["joined"])
            depths = right["depth"].to_numpy()
            for depth in range(1, deepest + 1):
                if depth > 1:
                    shard.deeper(depth, maps[depth - 2])
                own = right.filter(pa.array(depths == depth))
                if not len(own):
                    continue
                keys, _, first = shard.nodes()
                at = first[np.searchsorted(keys, own["key"].to_numpy().view(np.uint64))]
                codes = shard.codes[shard.at[at][:, None] + np.arange(depth)]
                links = [signed(x[at]) for x in (shard.prefix, shard.suffix)] if depth > 1 else [[None] * len(at)] * 2
                found = {"key": own["key"].to_numpy(), "n": own["n"].to_numpy(), "depth": np.full(len(at), depth), "prefix": links[0], "suffix": links[1]}
                found |= {"lang": [row["langs"][i] for i in lang_of[codes[:, 0]]], "phrase": [" ".join(map(word, x)) for x in codes.tolist()]}
                out.append(pa.Table.from_batches([records(_NODE, found)]))
        give_back()
        return pa.concat_tables(out) if out else _NODE.empty_table()

    ddl = "key long, n long, depth int, lang string, phrase string, prefix long, suffix long"
    left = coded.select("block", "keys", "lang_of", "letters", "sizes", "codes", "joined", "langs").groupBy("block")
    return stored(left.cogroup(wanted.groupBy("of")).applyInArrow(spell, ddl))


def _with_parts(nodes: DataFrame, depth: int) -> DataFrame:
    """key, n, depth, lang, phrase, lefts and rights: how often the first k words occur, and the rest after them, for
    every k; walked from each depth to the next."""
    none = F.array().cast("array<long>")
    above = stored(nodes.where("depth = 1").select("*", none.alias("lefts"), none.alias("rights")))
    levels = [above]
    for k in range(2, depth + 1):
        link = lambda name, parts: above.select(F.col("key").alias(name), F.col("n").alias(f"{name}_n"), F.col(parts).alias(f"{name}_parts"))
        walked = nodes.where(F.col("depth") == k).join(link("prefix", "lefts"), "prefix").join(link("suffix", "rights"), "suffix")
        above = stored(walked.select(
            *nodes.columns, F.concat("prefix_parts", F.array("prefix_n")).alias("lefts"), F.concat(F.array("suffix_n"), F.col("suffix_parts")).alias("rights"),
        ))
        levels.append(above)
    out = levels[1]
    for df in levels[2:]:
        out = out.unionByName(df)
    return out


_SCORED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("n", pa.int64()), ("score", pa.int64())])


def _scored(batches):
    """Scores in whole numbers of any size: the cut with the lowest one, of equal ones the first."""
    for batch in batches:
        found = []
        for lang, phrase, a, lefts, rights, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "a", "lefts", "rights", "n"))):
            score, k = min((1000 * a * n // (l * r), k) for k, (l, r) in enumerate(zip(lefts, rights)))
            found.append((lang, phrase, a, lefts[k], rights[k], n, score))
        yield records(_SCORED, dict(zip(_SCORED.names, zip(*found) if found else [[]] * len(_SCORED.names))))


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Phrases of 2 to `depth` words that occur `least` times or more in their language, the first `top` by score.

    lang, rank (from 1), phrase, a (its count), l and r (counts of its two parts), n (words of the language) and score:
    1000 a n / (l r), rounded down, of the cut with the lowest score. Phrases that lie in a longer one with `share`
    percent of their count or more are left out. Order: score, then count, descending, then the phrase's bytes.
    Words are cut at spaces and tabs, and phrases don't cross .,;:!? or line ends; A-Z are lowered. Null text: empty;
    null lang: `und`; repeated rows count each; no frequent phrase: no rows. Other columns are dropped.
    """
    coded = blocks(docs)
    maps: list[bytes] = []
    frequent: list[DataFrame] = []
    for _ in range(depth):
        found = _frequent(coded, maps, least)
        frequent.append(found)
        maps.append(key_map(found, "key", map_bits(found.count())))
    phrases = _with_parts(_spelled(coded, frequent, maps), depth)
    totals = coded.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("words"))
    inside = phrases.where("depth > 2").select(F.explode(F.array("prefix", "suffix")).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longer"))
    kept = phrases.join(inside, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n")))
    given = kept.join(totals, "lang").select("lang", "phrase", F.col("n").alias("a"), "lefts", "rights", F.col("words").alias("n"))
    scored = given.mapInArrow(giving_back(_scored), "lang string, phrase string, a long, l long, r long, n long, score long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
