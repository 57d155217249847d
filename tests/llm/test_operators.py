"""Corpus operators against brute force, round trips, held-out labels, and tables with nulls, repeats and long texts."""

import collections
import io
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import same
from conftest import SF

from tickloom.llm import chat, jaccard, licenses, passages, quality, queries, tokenfile, toxicity
from tickloom.llm.common import components, table
from tickloom.llm.decontam import contaminated
from tickloom.llm.langid import language_id
from tickloom.llm.packing import best_fit_packing, fullest, minimum_bin_slack
from tickloom.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns whose names the operators use inside."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, base, None, None), (None, base, "en", "a"), (3, None, "en", "a"), (4, "", None, "b"), (5, " \n\t ", "fr", "b"),
        (6, "one two", "fr", "b"), (7, prose(2, 60_000), "en", "a"), (8, "wörd \U0001f600 é " * 40, "de", "c"), (9, base.replace(" ", "  ").upper(), "en", "a"),
        (None, None, None, None),
    ]
    rows = [(*r, len(r[1] or ""), i, "x", 0.5, 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, key string, n double, k int")


def sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def test_quality_statistics(docs):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeated = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(repeated))
        assert g.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert g.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (g.base_failed and g.kept)


def test_quality_rejects_outliers(spark):
    rows = [(i, prose(i, 200), "en", "s") for i in range(150)] + [(1000, prose(7, 100) + " " + "#$%&*|<> " * 60, "en", "s")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000] and sum(got.values()) >= 147


def test_quality_groups(spark):
    rows = [(i, prose(i, 120), "en", "s" if i < 60 else "t") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for least, want in ((20, {"en / s": 60, "en / t": 30}), (50, {"en / s": 60, None: 30}), (61, {"en / *": 90}), (91, {None: 90})):
        got = quality.quality_rules(df, min_group=least).collect()
        assert {g: sum(r.judged_in == g for r in got) for g in want} == want and all(r.kept for r in got if r.d2 is None)


def test_minimum_covariance_determinant(spark):
    # one group against the same estimate in numpy: two starts, C-steps, reweighting
    rng = np.random.default_rng(8)
    x = np.rint(rng.normal(0, 1, (400, 5)) @ np.diag([300, 200, 250, 400, 150]) + 1000).astype(int)
    x[:60] += 3000
    floor = np.array(list(quality.STATISTICS.values())) ** 2.0

    def moments(rows, factor):
        return rows.mean(axis=0), factor * np.cov(rows.T, bias=True) + np.diag(floor)

    def distance(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    md = np.median(x, axis=0)
    z = np.abs(x - md) / (np.median(np.floor(np.abs(x - md)), axis=0) * 1.4826 + np.sqrt(floor))
    found = []
    for far in ((z**2).sum(axis=1), z.max(axis=1)):
        for _ in range(quality.C_STEPS + 1):
            q = np.floor(np.log1p(far) * 4096)
            m, c = moments(x[q <= np.percentile(q, 100 * quality.SUPPORT)], quality.CONSISTENCY)
            far = distance(m, c)
        found.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    m, c = moments(x[distance(m, c) <= quality.REWEIGHT], 1.0)
    df = spark.createDataFrame([("a", *map(int, r)) for r in x], "g string, " + ", ".join(f"{k} long" for k in quality.STATISTICS))
    got = quality.minimum_covariance_determinant(df).collect()[0]
    assert np.allclose([got[f"m_{k}"] for k in quality.STATISTICS], m)
    lower = np.array([[got[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    assert np.allclose(lower @ lower.T, c) and (distance(m, c)[:60] > quality.CUTOFF).all()


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = best_fit_packing(docs, tokenizer_path(), with_ids=True).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for d in docs.collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and b"".join(bytes(r.ids) for r in parts) == ids.tobytes()
        assert all(r.length == 2048 for r in parts[1:]) and all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in parts)
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts[:-1]]]).tolist()
    total = sum(r.length for r in rows)
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_bin) <= -(-total // 2048) * 1.05 + 1


def test_fullest_is_best():
    rng = random.Random(3)
    for _ in range(50):
        counts = [0] + [rng.randint(0, 2) if rng.random() < 0.2 else 0 for _ in range(40)]
        room = rng.randint(0, 40)
        sums = {0}
        for length, c in enumerate(counts):
            for _ in range(c):
                sums |= {s + length for s in sums if s + length <= room}
        got = fullest(counts, room)
        assert sum(got) == max(sums) and all(got.count(x) <= counts[x] for x in got)
    rows = minimum_bin_slack([0, 3, 0, 2, 0, 1], 5)
    assert sum((r[2] - r[1]) * r[0] for r in rows) == 14


def test_licenses(spark):
    text = prose(5, 100)
    mit, short = licenses.TEMPLATES["mit"], licenses.TEMPLATES["mit-notice"]
    changed = mit.replace("free of charge", "at no cost").replace("publish, ", "")
    rows = [(1, f"{text} {mit} {text}"), (2, f"{text}\n{changed}\n{text}"), (3, text), (4, f"é {short.upper()} {text}"), (5, None)]
    got = {(r.doc_id, r.license): r for r in licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "mit"), (2, "mit"), (4, "mit-notice")}
    r = got[1, "mit"]
    assert r.coverage == 1 and rows[0][1][r.span_start : r.span_end] == mit[:-1]
    assert got[2, "mit"].coverage > 0.9 and rows[3][1][got[4, "mit-notice"].span_start :].startswith("RELEASED")


def test_alignment_is_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 5, 12), rng.integers(0, 5, 14)
        best = np.zeros((13, 15), int)
        for i in range(12):
            for j in range(14):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + (a[i] == b[j]))
        got = licenses.banded_alignment(a.astype(np.uint64), b.astype(np.uint64), 14)
        assert len(got) == best[-1, -1] and all(a[i] == b[j] for i, j in got)


def test_passages(spark):
    shared, near = prose(11, 80), prose(12, 90).split()
    other = near.copy()
    other[45] = "zzz"
    rows = [(i, prose(100 + i, 150)) for i in range(20)]
    rows += [(50 + i, f"{prose(200 + i, 70)} {shared} {prose(300 + i, 40)}") for i in range(4)]
    rows += [(60, f"{prose(400, 60)} {' '.join(near)} {prose(401, 60)}"), (61, f"{prose(402, 60)} {' '.join(other)} {prose(403, 60)}"), (70, rows[3][1]), (71, rows[3][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = passages.repeated_passages(df).collect()
    found = {r.doc_id for r in spans}
    assert found <= {3, 50, 51, 52, 53, 60, 61, 70, 71} and len(found & {50, 51, 52, 53}) == 3 and len(found & {60, 61}) == 1 and found >= {70, 71}
    cut = {r.doc_id: r.text for r in passages.without_passages(df, spark.createDataFrame(spans)).collect()}
    assert set(range(20)) - {3} <= set(cut) and cut[3] == rows[3][1] and not {70, 71} & set(cut)
    assert sum(shared in t for t in cut.values()) == 1
    assert all(cut[i] == rows[i][1] for i in range(20))


def _ordered(texts, first):
    """Whether the text of number first has the smallest content hash."""
    from tickloom.llm.common import each_text, identity

    order = [identity(h) for *_, h in each_text(texts, lower=True)]
    return min(order) == order[first]


def test_passages_beyond_the_leaders(spark):
    # a line of 40 words in many unrelated texts, some of which lead its keys; two texts share more around it
    line, tail = prose(20, 40), prose(21, 12)
    rows = [(i, f"{prose(1000 + i, 60)} {line} {prose(2000 + i, 60)}") for i in range(60)]
    rows += [(100 + i, f"{prose(3000 + i, 60)} {line} {tail} {prose(4000 + i, 60)}") for i in range(12)]
    rows += [(200, f"{prose(5000, 60)} {prose(22, 12)} {line} {prose(5001, 60)}"), (201, f"{prose(5002, 60)} {prose(22, 12)} {line} {prose(5003, 60)}")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id for r in got} & set(range(100, 112))) == 11 and len({r.doc_id for r in got} & {200, 201}) == 1
    assert all(r.end_word - r.start_word >= 50 for r in got) and not {r.doc_id for r in got} & set(range(60))


def test_passages_over_blocks(spark, monkeypatch):
    # the keys of a common passage are dealt out in many blocks; the results are the same
    monkeypatch.setattr(passages, "BLOCK", 8)
    part, near = prose(60, 70).split(), None
    rows = []
    for i in range(120):
        near = part.copy()
        near[10 + i % 50] = f"q{i}"
        rows.append((i, f"{prose(6000 + i, 60)} {' '.join(near if i % 2 else part)} {prose(7000 + i, 60)}"))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id for r in got}) == 119 and all(50 <= r.end_word - r.start_word <= 90 for r in got)


def windows_around(middles, seed):
    """A table of windows of one minimum, each of another text, with the given shingles around it (None: its own one)."""
    rng = np.random.default_rng(seed)
    cx = rng.integers(1 << 20, 1 << 32, (len(middles), passages.WIDTH), dtype=np.uint32)
    for row, middle in zip(cx, middles):
        for i, x in enumerate(middle, passages.REACH - len(middle) // 2):
            row[i] = row[i] if x is None else x
    rows = {"key": np.zeros(len(cx), np.int64), "block": np.zeros(len(cx), np.int32), "node": [rng.bytes(16) for _ in cx], "cx": [x.tobytes() for x in cx], "places": [[passages.REACH]] * len(cx)}
    return pa.table(rows)


def hot_windows(kind, n, seed=5):
    rng = random.Random(seed)
    if kind == "line":  # a common line that is too short for a passage
        return windows_around([list(range(2, 32)) for _ in range(n)], seed)
    if kind == "word":  # a word again and again, between own words
        return windows_around([[2] * rng.choice((30, 38)) for _ in range(n)], seed)
    base = list(range(2, 80))  # near copies
    return windows_around([[None if rng.random() < 0.08 else x for x in base] for _ in range(n)], seed)


def searched(table, thin):
    w = passages.Windows(table, 80, "key", "block")
    if thin:
        w.thin()
    ys = np.arange(1, len(w.begin))
    w.search(ys, w.begin[ys], ys)
    return w


@pytest.mark.parametrize("kind", ["line", "word", "near"])
def test_thinned_windows_have_the_same_links(kind):
    plain, thin = (searched(hot_windows(kind, 300), x) for x in (False, True))
    for name in ("linked", "spans", "similarity"):
        assert (getattr(plain, name) == getattr(thin, name)).all()
    assert (plain.linked >= 0).any() == (kind == "near")


@pytest.mark.parametrize("kind", ["line", "word"])
def test_windows_that_cannot_be_linked_are_not_compared(spark, kind, monkeypatch):
    # a short line or a word that very many texts hold: before, each window was compared with all others of its minimum
    compared = []
    alike = passages.Windows._alike
    monkeypatch.setattr(passages.Windows, "_alike", lambda self, x, y: compared.append(len(x)) or alike(self, x, y))
    monkeypatch.setattr(passages, "COARSE_SHARE", 0)  # also where sketches let all pairs pass
    t = hot_windows(kind, 300)
    assert (searched(t, True).linked < 0).all() and sum(compared) == 0
    many = spark.createDataFrame([(0, i % 4, 4, True, bytes(n), bytes(c), p) for i, (n, c, p) in enumerate(zip(*(t[x].to_pylist() for x in ("node", "cx", "places"))))], "key long, block int, blocks int, head boolean, node binary, cx binary, places array<int>")
    assert passages._linkable(many, 80).count() == 0


def test_passages_behind_an_earlier_occurrence(spark):
    # the leader has the shared line twice, and only the second time what follows it
    rows, seed = [], 0
    for i in range(12):
        line, tail = prose(30 + i, 45), prose(50 + i, 5)
        while True:
            texts = [f"{prose(seed, 60)} {line} {prose(seed + 1, 60)} {line} {tail} {prose(seed + 2, 60)}", f"{prose(seed + 3, 60)} {line} {tail} {prose(seed + 4, 60)}"]
            seed += 10
            if _ordered(texts, 0):
                break
        rows += [(2 * i, texts[0]), (2 * i + 1, texts[1])]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.start_word <= 60 and r.end_word >= 110} == set(range(1, 24, 2))


def test_passages_agree_in_one_hash_function(spark):
    # every text shares 60 words with one other alone, most of them in a line that all have
    rows = []
    for i in range(40):
        line = prose(40, 44)
        part = f"{prose(600 + i // 2, 8)} {line} {prose(700 + i // 2, 8)}"
        rows.append((i, f"{prose(800 + i, 60)} {part} {prose(900 + i, 60)}"))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(min(r.doc_id, r.dup_of), max(r.doc_id, r.dup_of)) for r in got} == {(i, i + 1) for i in range(0, 40, 2)}


def test_parts_are_cut_where_pieces_end():
    """Words are kept without the marks and line feeds around them, and parts seen once don't fill the cache."""
    from tokenizers import Tokenizer

    from tickloom.llm import tokens

    t, rng = Tokenizer.from_file(tokenizer_path()), random.Random(3)
    words = prose(4, 200).split()
    texts = ["".join(f"{rng.choice([' ', '.' + chr(10), '! '])}{w}{rng.choice(['', ',', '...', ')'])}" for w in rng.choices(words, k=400)) for _ in range(20)]
    odd = ["a", "Z", "don", "'s", "'t", "'", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\u3000", "é", "ß", "日", "1", "²", "_", ".", "...", "\x00", "\u0301", "“"]
    odd = ["".join(rng.choices(odd, k=rng.randrange(1, 14))) for _ in range(5000)]
    e = tokens.Encoder(tokenizer_path())
    assert e.encode(texts + odd) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts + odd]
    e.words.clear()
    e.encode(texts)
    assert len(e.words) <= 2 * len(words) + 20  # with a space before and without


def test_parts_that_occur_once_leave_room_in_the_cache(monkeypatch):
    from tickloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 100)
    e, often = tokens.Encoder(tokenizer_path()), "zqoftena zqoftenb"
    once = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + "q" for i in range(3000)]
    e.encode([" ".join(once[:1500])])
    assert len(e.words) == 50
    for k in range(1500, 3000, 500):
        e.encode([f" {often} " + " ".join(once[k : k + 500])])
    assert len(e.words) <= 60
    monkeypatch.setattr(e, "_word", None)  # no longer asked for
    e.encode([f" {often}"])


def test_added_tokens_are_encoded_as_by_the_library():
    from tokenizers import Tokenizer
    from tickloom.llm.tokens import Encoder

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> \n y", "<|endoftext", "plain  text", "é <|endoftext|>é"]
    assert Encoder(tokenizer_path()).encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_short_items_are_found(spark):
    items = [(i, prose(9000 + i, 2 + i % 11)) for i in range(400)]
    rows = [(i, f"{prose(10_000 + i, 40)} {x} {prose(20_000 + i, 40)}") for i, x in items]
    got = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(400)]


def test_more_than_64_languages(spark):
    def written(lang, seed):
        rng = random.Random(seed)
        return " ".join("".join(chr(0x4E00 + 40 * lang + rng.randrange(8)) for _ in range(5)) for _ in range(40))

    rows = [(2 * i + k, f"l{i:02d}", written(i, 2 * i + k)) for i in range(70) for k in range(2)]
    pages = [(i, f"https://h{i}.example.com", f"<p>{written(i, 1000 + i)}</p>") for i in range(70)]
    got = language_id(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert {r.page_id: r.lang for r in got.collect()} == {i: f"l{i:02d}" for i in range(70)}


def test_chat_memory_beyond_the_context():
    turns = [("user", f"t{i % 100}") for i in range(130)]
    again = lambda ts: "".join(f"[{r}{'*' * (i >= 100)}]{t}" for i, (r, t) in enumerate(ts))
    text, found, rewrites, _ = chat.spans(turns, again)
    assert not rewrites and [text[c:d] for _, _, c, d in found] == [t for _, t in turns]
    grown = lambda ts: "".join(f"{r}{'#' * i}{t}." for i, (r, t) in enumerate(ts))
    text, found, rewrites, _ = chat.spans(turns[:30], grown)
    assert not rewrites and [text[c:d] for _, _, c, d in found] == [t for _, t in turns[:30]]


def test_passages_recall_against_all_pairs(spark):
    # near copies of passages of 60 words with one to three changed words, each in a document of its own
    rng, rows, family = random.Random(31), [], {}
    for f in range(40):
        part = prose(40_000 + f, 60).split()
        for k in range(5):
            w = part.copy()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(60)] = f"c{rng.randrange(10_000)}"
            i = 5 * f + k
            family[i] = f, w
            rows.append((i, f"{prose(50_000 + i, 80)} {' '.join(w)} {prose(60_000 + i, 80)}"))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(family[r.doc_id][0] == family[r.dup_of][0] for r in got)
    # by all pairs: a document that is later in the order than one whose passage is as similar as asked for
    from tickloom.llm.common import each_text, identity

    order = {rows[i][0]: identity(h) for i, _, _, _, h in each_text([t for _, t in rows], lower=True)}
    s = {i: set(zip(*(w[k:] for k in range(5)))) for i, (_, w) in family.items()}
    want = {i for i in s for j in s if i != j and family[i][0] == family[j][0] and order[j] < order[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])}
    found = {r.doc_id for r in got}
    assert len(want) > 60 and len(found & want) >= 0.97 * len(want)


def test_compact_windows():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    v[40] = v[45]
    w = passages.compact_windows(np.concatenate((v, v)), np.array([0, 60]), np.array([60, 120]), 8)
    assert (w[w[:, 1] >= 60] - 60).tolist() == w[w[:, 1] < 60].tolist() and len(w) < 60
    for lo in range(60):
        for hi in range(lo + 7, 60):
            c = lo + int(v[lo : hi + 1].argmin())
            assert any(a <= lo and hi <= b and m == c for a, m, b in w)


def test_contamination(spark, docs):
    bench = table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id): r.n_shared for r in contaminated(docs, bench).collect()}
    d, b = docs.collect(), bench.collect()
    ds, bs = sets([r.text for r in d]), sets([r.text for r in b])
    want = {(x.doc_id, y.item_id): len(s & t) for x, s in zip(d, ds) for y, t in zip(b, bs) if len(WORD.findall(y.text or "")) >= 5 and len(WORD.findall(x.text or "")) >= 5 and 100 * len(s & t) >= 80 * len(t)}
    assert got == want


def test_chat(spark, duck):
    same(queries.op6_chat_formatting(spark, SF), duck.execute(queries.ORACLE_SQL["op6_chat_formatting"]))


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|x|>", "\\<|", "<||im_start|>"])
def test_chat_escape(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    turns = [("user", text), (f"as\n{text}", text)]
    assert chat.parsed(chat.marked_turns(turns)) == turns


def test_chat_templates():
    turns = [("user", f"t{i}") for i in range(200)]
    text, found, rewrites, checked = chat.spans(turns, chat.marked_turns)
    assert checked == 200
    assert not rewrites and [text[c:d] for _, _, c, d in found] == [t for _, t in turns]
    last_only = lambda ts: "".join(f"[{r}]" + (t if i == len(ts) - 1 else "…") for i, (r, t) in enumerate(ts))
    assert chat.spans(turns, last_only)[2]
    late = lambda ts: "".join(t for _, t in ts) if len(ts) < 150 else "summary" + ts[-1][1]
    assert chat.spans(turns, late)[2]


@pytest.mark.parametrize("at", [40, 100, 149])
def test_a_single_prefix_that_rewrites_history(at):
    turns = [("user", f"t{i}") for i in range(150)]
    once = lambda ts: ("!" if len(ts) == at else "") + "".join(f"{t};" for _, t in ts)
    assert chat.spans(turns, once)[1:3] == ([], True)
    # beyond the bound on characters nothing is claimed
    assert chat.spans(turns, once, full_chars=500)[2] is None
    text, found, rewrites, checked = chat.spans(turns, chat.marked_turns, full_chars=500)
    assert rewrites is None and 5 < checked < 40 and [text[c:d] for _, _, c, d in found] == [t for _, t in turns]


def test_a_late_prefix_of_a_long_conversation_that_rewrites_history(spark):
    """The prefixes come to 45 million characters; whether the template rewrites history doesn't depend on how many there are."""
    rows = [(1, i, "user", f"{i}" * 700) for i in range(250)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    once = lambda ts: ("!" if len(ts) == 240 else "") + "".join(f"{t};" for _, t in ts)
    got = chat.formatted(df, once).first()
    assert (got.rewrites_history, got.turn_spans, got.checked_turns) == (True, [], 239)
    got = chat.formatted(df).first()
    assert (got.rewrites_history, got.checked_turns, len(got.turn_spans)) == (False, 250, 250)


def test_exact_passages_are_cut_exactly(spark):
    rows, shared = [], {}
    for i in range(30):
        part = prose(7000 + i // 2, 60)
        head, tail = prose(8000 + i, 80), prose(9000 + i, 80)
        shared[i] = head, part, tail
        rows.append((i, f"{head} {part} {tail}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(df).collect()
    assert {(r.start_word, r.end_word, r.similarity) for r in got} == {(80, 140, 1.0)} and len(got) == 15
    cut = {r.doc_id: r.text for r in passages.without_passages(df, passages.repeated_passages(df)).collect()}
    assert all(cut[r.doc_id].split() == f"{shared[r.doc_id][0]} {shared[r.doc_id][2]}".split() for r in got)


def test_passages_of_texts_that_share_a_doc_id(spark):
    part = prose(71, 60)
    holds = [f"{prose(72 + i, 90)} {part} {prose(82 + i, 40)}" for i in range(4)]
    others = [prose(92 + i, 140) for i in range(4)]
    rows = [(1, holds[0]), (1, others[0]), (None, holds[1]), (None, others[1]), (2, holds[2]), (2, others[2]), (3, holds[3]), (3, None), (None, None), (None, holds[3].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [r.text for r in passages.without_passages(df, passages.repeated_passages(df)).collect()]
    assert sum(part in (t or "").lower() for t in left) == 1 and set(others[:3]) <= set(left) and left.count(None) == 2
    assert sum((t or "").lower().startswith(prose(75, 90)) for t in left) == 1  # of two texts with the same words one stays


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got, at = {r.doc_id: r for r in tokenfile.token_files(docs, tokenizer_path()).collect()}, 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_file_access(tmp_path):
    path = tmp_path / "f.zst"
    w = tokenfile.Writer(path.open("wb"), frame_bytes=4000)
    data = [np.arange(i * 10, dtype="<u4").tobytes() for i in range(60)]
    for i, x in enumerate(data):
        w.add(i // 2, x)
    w.close()
    raw = path.read_bytes()
    reader = tokenfile.Reader(io.BytesIO(raw))
    assert [x for _, _, x in reader] == data and reader.find(7) == data[14:16] and reader.find(99) == []
    broken = bytearray(raw)
    broken[int(reader.begins[2]) + 20] ^= 1
    with pytest.raises(Exception):
        list(tokenfile.Reader(io.BytesIO(bytes(broken))))
    empty = io.BytesIO()
    empty.close = lambda: None
    tokenfile.Writer(empty).close()
    assert list(tokenfile.Reader(io.BytesIO(empty.getvalue()))) == []


def test_a_damaged_index_is_noticed(tmp_path):
    path = tmp_path / "f.zst"
    w = tokenfile.Writer(path.open("wb"))
    for i in range(50):
        w.add(i, np.arange(i, dtype="<u4").tobytes())
    w.close()
    raw = bytearray(path.read_bytes())
    reader = tokenfile.Reader(io.BytesIO(bytes(raw)))
    raw[int(reader.begins[-2]) + 30] ^= 1
    with pytest.raises(ValueError, match="index"):
        tokenfile.Reader(io.BytesIO(bytes(raw)))


def brute_components(ids, texts):
    s = sets(texts)
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (len(s[i]), least[find(i)]) for i, d in enumerate(ids)}


def test_jaccard(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng, base = random.Random(9), prose(77, 120).split()
    for i in range(60):  # a family of copies with more and more changes
        w = base.copy()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(50)}"
        rows.append((10_000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components([r[0] for r in rows], [r[1] for r in rows])


def test_counts_bound_the_overlap():
    rng = np.random.default_rng(5)
    for n, m in ((10, 12), (300, 350), (5000, 6000)):
        a, b = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m))
        b = np.unique(np.concatenate((b, a[: n // 2])))
        x, y = jaccard.count_vector(a), jaccard.count_vector(b)
        for groups in (jaccard.GROUPS, min(len(x), len(y))):
            p, q = jaccard.folded(x, groups), jaccard.folded(y, groups)
            assert p.sum(dtype=int) == len(a) and n // 2 <= np.minimum(p, q).sum(dtype=int) <= min(len(a), len(b))


def test_jaccard_over_pages(spark, monkeypatch):
    # one large group, cut into many pages, whose members are linked over chains and fall into several components
    monkeypatch.setattr(jaccard, "PAGE", 20)
    rng, rows = random.Random(4), []
    for f in range(3):
        w = prose(500 + f, 100).split() + prose(77, 60).split()
        for i in range(90):
            w = w.copy() if i % 30 else prose(500 + f, 100).split() + prose(77, 60).split()
            w[rng.randrange(100)] = f"w{rng.randrange(1000)}"
            rows.append((1000 * f + i, " ".join(w)))
    rows += [(9000 + i, f"{prose(77, 60)} {prose(700 + i, 4 + i % 9)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components([r[0] for r in rows], [r[1] for r in rows])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))
    assert components(edges.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r.doc_id: r for r in toxicity.toxicity(d, toxicity.fit(d, labels)).collect()}
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [(got[i].score, t) for i, t in y.items() if i in got and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    pos, neg = [s for s, t in held if t == 1], [s for s, t in held if t == 0]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.9 and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got.values())


def test_toxicity_is_the_same_for_any_partitioning(spark, docs):
    labels = table(spark, SF, "labels")
    a, b = (toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (3, 7))
    assert (a.weight == b.weight).all() and a.bias == b.bias and (a.feature == b.feature).all() and a.weight.any()
    few = toxicity.training_ids(labels, 20)
    assert len(few) == 20 and set(few) <= set(toxicity.training_ids(labels))


def test_toxicity_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(edge, toxicity.fit(edge, none)).count() == 12


def test_toxicity_counts_are_those_of_sets(spark, docs):
    ids = toxicity.training_ids(table(spark, SF, "labels"))
    rows = toxicity.training_rows(docs, ids)
    assert not [kind for _, kind in rows.dtypes if kind.startswith("array")]  # lists of n-grams are longer than the texts
    texts = {r.doc_id: r.text for r in docs.orderBy(docs.text.desc()).collect()}  # the smallest of an id comes last
    want = collections.defaultdict(lambda: [0, 0])
    for i, y in ids:
        if texts.get(i) is not None:
            for b in {-1, *np.concatenate(list(toxicity.ngram_buckets(texts[i]))).tolist()}:
                want[b][y] += 1
    assert {r.bucket: [r.c0, r.c1] for r in toxicity.class_counts(rows.repartition(5)).collect()} == want and all(want[-1])
    assert toxicity.class_counts(rows.limit(0)).where("c0 + c1 > 0").count() == 0


def test_toxicity_tasks_hold_few_texts(spark):
    class Table:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    model = toxicity.Model(np.full(1 << toxicity.BUCKET_BITS, -1, np.int32), np.zeros(1))
    texts = [chr(97 + i % 26) * 5000 for i in range(2000)]
    batch = pa.record_batch({"doc_id": pa.array(range(2000), pa.int64()), "text": texts})
    run = toxicity.toxicity(Table(), model)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 2000 and peak < 5e6  # 10 MB of text


def test_language(spark, docs):
    known = {r.lang: r.text for r in docs.where("n_chars > 600").collect()}
    rows = [(i, f"https://{x}.example.com/a", f"<html><body><p>{t[:500]}</p></body></html>") for i, (x, t) in enumerate(known.items())]
    rows += [(100, None, None), (101, "", ""), (102, "https://x.example.com", "<html lang='zz'>"), (101, "", "")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, own int")
    got = language_id(pages, docs).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == len(rows) and [by_id[i].lang for i in range(len(known))] == list(known)
    assert all(0 < r.probability <= 1.0000001 for r in got) and by_id[102].declared == "zz" and by_id[100].lang in known
    assert language_id(pages.limit(0), docs).count() == 0
    assert {r.lang for r in language_id(pages, docs.limit(0)).collect()} == {"und"}


DOC_OPERATORS = {
    "quality": lambda d: quality.quality_rules(d), "packing": lambda d: best_fit_packing(d, tokenizer_path()), "licenses": licenses.license_spans, "passages": passages.repeated_passages,
    "contamination": lambda d: contaminated(d, d.selectExpr("doc_id AS item_id", "text", "key").where("text not like '%wörd%' and length(text) < 2000")), "tokens": lambda d: tokenfile.token_files(d, tokenizer_path()),
    "jaccard": jaccard.jaccard_components,
}


@pytest.mark.parametrize("name", DOC_OPERATORS)
def test_edges(edge, name):
    rows = DOC_OPERATORS[name](edge).collect()
    if name in ("quality", "tokens", "jaccard"):
        assert len(rows) == 12
    if name == "jaccard":
        assert {r.component_id for r in rows if r.n_shingles == 116} == {1} and all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    if name == "passages":
        assert {r.doc_id for r in rows} >= {2, 9} and all(r.dup_of is None for r in rows if r.doc_id in (1, 2, 9))
    assert DOC_OPERATORS[name](edge.limit(0)).count() == 0


def test_chat_edges(spark):
    rows = [(1, 1, "user", "a"), (1, None, None, None), (None, 1, "assistant", "b"), (2, 1, "assistant", ""), (2, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 2, None: 1, 2: 2} and got[None].loss_chars == 1
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
