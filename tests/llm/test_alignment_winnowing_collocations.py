"""Tokenizer alignment, winnowed fingerprints and phrase collocations against brute force."""

import bisect
import hashlib
import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from tickloom.llm import alignment, collocations, common, tokens, winnowing
from tickloom.llm.queries import PIECES, tokenizer_path

PATHS = tokenizer_path(), tokenizer_path(PIECES)
ODD = [
    "a", "the", " ", "  ", "\n", " \n", "  ", "  ", "　 x", "é", "ß", "日本", "<|endoftext|>", "<s>", "</s>", "▁", " ▁", "<0x41>",
    "\U0001f600", "\t", "\x1c ", "123", "'s", ".", "!!", "\r\n",
]


def odd_texts(seed, n, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(most))) for _ in range(n)]


def frame(spark, rows):
    """doc_id, text, lang and columns whose names the operators use inside."""
    rows = [(*r, "x", 0.5, 1) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block string, n double, hash long").repartition(3)


EDGE = [(1, "one two three", "en"), (1, "one two three", "en"), (2, None, None), (None, "one two three", "en"), (None, None, None), (3, "", "fr"), (4, " \n\t", "fr"), (5, "wörter " * 30_000, None)]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATHS[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    pair = alignment.Pair(*PATHS)
    found, counts = [], Counter()
    for text in texts:
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        x, y = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
        if b"".join(x) != whole or b"".join(y) != whole:
            found.append(([], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(z) for z in x]).tolist(), np.cumsum([len(z) for z in y]).tolist()
        links = [(p, q) for p, e, z in zip(a, ends_a, x) for q, f, w in zip(b, ends_b, y) if max(e - len(z), f - len(w)) < min(e, f)] if len(a) < 500 else None
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(str(i))
        found.append((a, b, links, ";".join(f"{','.join(p)}|{','.join(q)}" for p, q in groups)))
        counts.update(links)
    most = {}
    for (_, q), n in counts.items():
        most[q] = max(most.get(q, 0), n)
    return [
        (len(a), len(b), g.count("|"), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), g)
        for a, b, links, g in found
    ]


def test_alignment(spark, monkeypatch):
    texts = [*odd_texts(5, 400), *[t for _, t, _ in EDGE[:7]]]
    df = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    want = {(i, *row[:6], hashlib.sha256(row[6].encode()).hexdigest() if row[6] else "") for i, row in enumerate(brute_alignment(texts))}
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {tuple(r) for r in alignment.alignments(df, *PATHS).select(*columns).collect()} == want
    shown = alignment.alignments(df, *PATHS, show_groups=True).collect()
    assert {tuple(r[c] for c in columns) for r in shown} == want
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in shown if r.groups)


def test_alignment_over_blocks(monkeypatch):
    texts = odd_texts(9, 3000)
    pair = alignment.Pair(*PATHS)
    row = alignment._block(list(range(len(texts))), [x.encode() for x in texts], pair, True).to_pylist()[0]
    assert row["groups"] == [x[6] for x in brute_alignment(texts)]


def test_memory_of_a_block(monkeypatch):
    """Hashing takes memory by pieces of a block, not by the block, and ids are kept once."""
    texts = [" ".join(f"w{(i * 7 + j) % 500}" for j in range(900)).encode() for i in range(1000)]
    pair = alignment.Pair(*PATHS)
    pair.a.words.clear()
    monkeypatch.setattr(common, "_powers", [])
    tracemalloc.start()
    block = alignment.Block(texts, pair)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 4_000_000 < sum(map(len, texts)) < 6_000_000 and peak < 140_000_000 and not pair.a.words
    assert block.sums(block.n_a).tolist() == [len(x) // 4 for x in pair.a.encode([" " + t.decode() for t in texts])]


def test_memory_of_a_block_of_different_words(monkeypatch):
    """Parts are tokenized and aligned some at a time: memory follows from a block's parts, not from all their links."""
    rng = np.random.default_rng(8)
    letters = rng.integers(97, 123, (400_000, 7)).astype(np.uint8).tobytes().decode()
    texts = [" ".join(letters[7 * i : 7 * i + 7] for i in range(at, at + 400)).encode() for at in range(0, 400_000, 400)]
    pair = alignment.Pair(*PATHS)
    monkeypatch.setattr(common, "_powers", [])
    tracemalloc.start()
    block = alignment.Block(texts, pair)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert 3_000_000 < sum(map(len, texts)) < 4_000_000 and len(block.valid) > 390_000
    assert peak < 240_000_000, (now, peak)


@pytest.mark.parametrize("together", [1, 7, 1000])
def test_alignment_some_parts_at_a_time(monkeypatch, together):
    monkeypatch.setattr(alignment, "TOGETHER", together)
    monkeypatch.setattr(alignment, "CACHE_PARTS", 40)
    texts = odd_texts(10, 1500)
    pair = alignment.Pair(*PATHS)
    row = alignment._block(list(range(len(texts))), [x.encode() for x in texts], pair, True).to_pylist()[0]
    want = brute_alignment(texts)
    assert row["groups"] == [x[6] for x in want] and row["n_links"] == [x[3] for x in want]
    assert row["pair"] == sorted(row["pair"]) and sum(row["n"]) == sum(x[3] for x in want) and len(pair.known) <= 40


@pytest.mark.parametrize("chunk", [1, 7, 40, 1000])
def test_hashes_by_pieces(monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    b = np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8)
    edges = np.unique(np.concatenate(([0, 500], np.random.default_rng(2).integers(0, 500, 60))))
    assert np.array_equal(alignment._hashes(b, edges[:-1], edges[1:]), common.hashes_of(b, edges[:-1], edges[1:]))
    assert len(alignment._hashes(b, edges[:0], edges[:0])) == 0


def test_overlaps():
    first, last, closes = alignment.overlaps(np.array([2, 3, 7, 9]), np.array([1, 3, 5, 8, 9]))
    assert (first.tolist(), last.tolist(), closes.tolist()) == ([0, 1, 2, 3], [1, 1, 3, 4], [False, True, False, False, True])


def test_alignment_edges(spark):
    df = frame(spark, EDGE)
    got = alignment.alignments(df, *PATHS).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in EDGE)
    assert all((r.n_a == 0) == (r.groups_sha256 == "") for r in got)
    assert {r.n_a for r in got if r.doc_id in (2, 3)} == {0} and max(r.n_a for r in got) > 60_000
    assert alignment.alignments(df.limit(0), *PATHS).collect() == []


class Tasks:
    """Stands for a table: gives the function that mapInArrow() would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, ddl):
        return run


def test_workers_keep_no_tokenizers_after_a_task(monkeypatch):
    # idle workers held tokenizers and caches, some 200 MB each, beside their executor while it looked links up
    monkeypatch.setattr(alignment, "documents_of", lambda docs: docs)
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    run = alignment._blocks(Tasks(), *PATHS, False)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two", None]})
    assert sum(row.num_rows for row in run([batch])) == 1
    assert not alignment._pairs and not tokens._encoders and given


def test_texts_without_tokens_alone(spark):
    got = alignment.alignments(frame(spark, [(1, "▁", "en"), (2, "▁▁", "en")]), *PATHS).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def rotated(x, n):
    n %= 64
    return ((x << n) | (x >> (64 - n))) & (1 << 64) - 1 if n else x


def brute_prints(text, k, window):
    """Hashes from the definition: every token rotated by its distance from the last one; then each window's least."""
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in tokens]
    grams = []
    for i in range(max(len(h) - k + 1, min(len(h), 1))):
        total, some = 0, h[i : i + k]
        for j, x in enumerate(some):
            total ^= rotated(x, len(some) - 1 - j)
        grams.append(xxhash.xxh64_intdigest(total.to_bytes(8, "little"), seed=42))
    places = set()
    for i in range(max(len(grams) - window + 1, min(len(grams), 1))):
        some = range(i, min(i + window, len(grams)))
        places.add(min(some, key=lambda j: (grams[j] >> 31, -j)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(signed(grams[p]), p) for p in sorted(places)]


def edited(rows):
    """(doc_id, text, edited text, next text) in the order of doc_id descending."""
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]]):
        half = len(text) // 2
        out.append((i, text, text[: len(text) - half] + after[:half], after))
    return out


@pytest.mark.parametrize(("k", "window"), [(5, 4), (1, 1), (3, 8), (6, 2)])
def test_winnowing(spark, k, window):
    rng = random.Random(k)
    texts = [*odd_texts(k, 40, 60), "", " ", "x" * 100, "a b " * 200, *(" ".join(rng.choice("abcdefgh") * rng.randint(1, 20) for _ in range(rng.randrange(60))) for _ in range(40))]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in winnowing.fingerprints(frame(spark, [(*r, "en") for r in rows]), k, window).collect()}
    for i, t in rows:
        assert [(p.hash, p.place) for p in got[i].prints] == brute_prints(t, k, window)
    share = lambda a, b: len({h for h, _ in a} & {h for h, _ in b}) / len({h for h, _ in a} | {h for h, _ in b}) if a or b else 1.0
    got = {r.doc_id: r for r in winnowing.edited_fingerprints(frame(spark, [(*r, "en") for r in rows]), k, window).collect()}
    assert len(got) == len(rows)
    for i, text, changed, after in edited(rows):
        r, own = got[i], brute_prints(text, k, window)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r.near_edited == share(own, brute_prints(changed, k, window)) and r.near_next == share(own, brute_prints(after, k, window))
        shown = " @ ".join(str(list(x)).replace("'", "") for x in zip(*own)) if own else ""
        assert r.fingerprint == shown


def test_shared_runs_share_a_fingerprint(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    least = winnowing.WINDOW + winnowing.K - 1
    rows = []
    for i in range(60):
        run = " ".join(word() for _ in range(least))
        rows += [(2 * i, " ".join([*(word() for _ in range(rng.randrange(30))), run, *(word() for _ in range(9))]), "en"), (2 * i + 1, " ".join([word(), word(), run]), "en")]
    got = {r.doc_id: {p.hash for p in r.prints} for r in winnowing.fingerprints(frame(spark, rows)).collect()}
    assert all(got[2 * i] & got[2 * i + 1] for i in range(60)) and not got[0] & got[3]


def test_winnowing_edges(spark):
    got = winnowing.edited_fingerprints(frame(spark, EDGE)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in EDGE)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0] == by[1][1] and len(by[None]) == 2  # rows equal in doc_id and text have the same next document
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_chars, r.fingerprint, r.near_edited, r.edited_sha256) == (0, "", 1.0, empty) for i in (2, 3) for r in by[i])
    assert by[5][0].n_chars == 210_000 and by[4][0].fingerprint == ""
    one = winnowing.edited_fingerprints(frame(spark, [(7, "a b c d e f g h", "en")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert winnowing.edited_fingerprints(frame(spark, EDGE).limit(0)).collect() == []


def brute_collocations(rows, least, depth, share, top):
    total, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, depth + 1) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), n in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * n >= share * f[lang, w[i : i + k]]:
                    dropped.add((lang, w[i : i + k]))
    out = {}
    for (lang, w), a in candidates.items():
        if (lang, w) in dropped:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((Fraction(1000 * a * total[lang], l * r).__floor__(), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {
        (lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top])
    }


@pytest.mark.parametrize(("least", "depth", "share", "top"), [(3, 5, 100, 2000), (2, 3, 70, 15), (5, 2, 100, 7)])
def test_collocations(spark, monkeypatch, least, depth, share, top):
    rng = random.Random(least)
    words = ["The", "the", "of", "a", "Bé", "é", "New", "york", "x y", "z"]
    text = lambda n: "".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "! "]) for _ in range(n))
    rows = [(i, text(rng.randrange(40)), rng.choice(["en", "fr", None])) for i in range(60)]
    rows += [(100 + i, "in the city of new york we met", "en") for i in range(6)] + [(200, None, "en"), (201, "", None), (202, " .\n", "xx"), (None, "a b c a b c a b c", "")]
    got = collocations.collocations(frame(spark, rows), least, depth, share, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows, least, depth, share, top)


def test_blocks_of_a_file(spark, monkeypatch):
    # the blocks of a file go to Python together, outside the executor's heap: before, however many a task had made
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 64)
    docs = spark.createDataFrame([(f"word{i} " * 12, "en") for i in range(23)], "text string, lang string").coalesce(1)
    coded = collocations.blocks(docs)
    assert coded.count() == 23
    assert all(pq.read_metadata(re.sub("^file:/+", "/", x)).num_rows <= collocations.FILE_BLOCKS for x in coded.inputFiles())


def test_collocation_scores_beyond_64_bits():
    import pyarrow as pa

    big = 10**15 + 7
    batch = pa.RecordBatch.from_pydict({"lang": ["x"], "phrase": ["p q"], "a": [big], "lefts": [[big + 2]], "rights": [[big + 3]], "n": [10**16]})
    assert next(iter(collocations._scored([batch])))["score"].to_pylist() == [1000 * big * 10**16 // ((big + 2) * (big + 3))]


def test_collocation_edges(spark):
    df = frame(spark, EDGE)
    got = collocations.collocations(df, least=2).collect()
    assert {r.phrase for r in got} == {"one two three", " ".join(["wörter"] * 5)} | {" ".join(["wörter"] * k) for k in (2, 3, 4)}
    assert collocations.collocations(df.limit(0)).collect() == []
