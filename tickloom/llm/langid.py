"""Language identification of web pages by Bayesian evidence fusion.

log P(language | page) adds up a character n-gram likelihood of the page's text, the declared markup language, the
address suffix, and a prior of the page's host. Host priors come from grouped aggregation: counts of the languages
that the text alone points to, smoothed towards those of the host's domain, and these towards those of all pages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import records, stored

ORDER, BUCKET_BITS = 3, 15
#: Documents that the n-gram model is fitted on for each language, about: those with a small enough hash.
MAX_FIT_DOCS = 1_000
#: Weight of a page's own text: its log-likelihood counts as that of at most so many n-grams, as neighbouring ones
#: aren't independent.
EVIDENCE_NGRAMS = 30.0
#: Pages that the domain's counts stand for in a host's prior, and all pages' counts in a domain's.
HOST_PRIOR, DOMAIN_PRIOR, CHANNEL_PRIOR = 10.0, 10.0, 1.0

_MARKUP = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_INVISIBLE = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-f]+|\w+);", re.I)
_ADDRESS = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def ngrams(text: str) -> np.ndarray:
    """Buckets of the character n-grams of the letters of a text, lower-cased, with a space between words."""
    letters = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    points = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(ORDER):
        h = (h + points[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def visible(html: str | None) -> str:
    return _ENTITY.sub(" ", _INVISIBLE.sub(" ", html or ""))


def fit(docs: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of the n-gram buckets in each, from a bounded sample of labelled documents."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string").alias("text"))
    d = d.where("lang is not null and text is not null")
    sizes = d.groupBy("lang").count()
    langs = sorted(r.lang for r in sizes.select("lang").collect())
    if not langs:
        return ["und"], np.zeros((1, 1 << BUCKET_BITS), np.float32)
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                sums[lang] += np.bincount(ngrams(text), minlength=1 << BUCKET_BITS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield records(schema, {"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": c[at]})

    # a threshold on the hash, by the number of the language's documents: no text is sorted or sent on
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    limits = sizes.select("lang", (F.least(F.lit(1.0), max_fit_docs / F.col("count")) * (1 << 40)).cast("long").alias("_below"))
    sample = d.join(limits, "lang").where(place < F.col("_below")).select("lang", "text")
    t = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(langs), 1 << BUCKET_BITS), 0.1, np.float32)
    counts[pc.index_in(t["lang"], pa.array(langs)).to_numpy(), t["bucket"].to_numpy()] += t["n"].to_numpy()
    for row in counts:
        row[:] = np.log(row / row.sum(dtype=np.float64))
    return langs, counts


def evidence(pages: DataFrame, langs: list[str], log_probability: np.ndarray) -> DataFrame:
    """page_id, host, domain, declared, suffix, text_log (a log-likelihood for each language, its mean 0), own (the
    language that the text points to, null without n-grams)."""
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("domain", pa.string()), ("declared", pa.string()), ("suffix", pa.string()), ("text_log", pa.list_(pa.float64())), ("own", pa.int32())])

    def read(batches):
        for batch in batches:
            out: dict[str, list] = {f: [] for f in schema.names}
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                m = _ADDRESS.match((url or "").strip())
                host = m[1].lower().rstrip(".") if m else ""
                labels = host.split(".")
                declared = _MARKUP.search(html or "")
                grams = ngrams(visible(html))
                if len(grams) <= 1 << BUCKET_BITS:
                    total = log_probability[:, grams].sum(axis=1, dtype=np.float64)
                else:
                    total = log_probability @ np.bincount(grams, minlength=1 << BUCKET_BITS).astype(np.float64)
                total = (total - total.mean()) * min(1.0, EVIDENCE_NGRAMS / max(len(grams), 1))
                row = (page_id, host, ".".join(labels[-2:]), declared[1].lower() if declared else "", labels[-1] if len(labels) > 1 else "", total.tolist(), int(total.argmax()) if len(grams) else None)
                for name, value in zip(schema.names, row):
                    out[name].append(value)
            yield records(schema, out)

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(read, "page_id long, host string, domain string, declared string, suffix string, text_log array<double>, own int")


def language_id(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, suffix, host for each row of pages.

    Likelihoods of the declared language and of the suffix given the language, and the smoothed priors of hosts, are
    shares of the pages whose text points to a language; every count is a grouped sum over all pages, without the page
    itself in its host's prior. Null url: the
    empty host. Null or empty html: decided by host and suffix alone. A page without any evidence gets the language
    of most pages. Ties go to the first language in alphabetical order. Repeated rows each get a row; other columns
    are dropped; empty table: no rows; no labelled documents: "und".
    """
    langs, log_probability = fit(docs)
    rows = stored(evidence(pages, langs, log_probability))
    known = rows.where("own is not null")
    size = len(langs)
    # counts by language are maps, turned into arrays of size numbers
    one_each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), f)
    count_in = lambda m, i: F.coalesce(F.try_element_at(F.col(m), i), F.lit(0.0))

    def counted(name: str, *keys: str) -> DataFrame:
        c = known.groupBy(*keys, "own").agg(F.count("*").cast("double").alias("n"))
        return c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("own", "n"))).alias(name), F.coalesce(F.sum("n"), F.lit(0.0)).alias(f"n_{name}"))

    one = F.broadcast(stored(counted("all")))  # a single row
    top = lambda i: (count_in("all", i) + 1.0) / (F.col("n_all") + float(size))
    middle = lambda i: (count_in("domains", i) + DOMAIN_PRIOR * top(i)) / (F.col("n_domains") + DOMAIN_PRIOR)
    hosts = counted("hosts", "host", "domain").join(counted("domains", "domain"), "domain").crossJoin(one)
    hosts = hosts.select("host", "hosts", "n_hosts", one_each(middle).alias("middle"), "n_domains")
    # a page's own vote, which its text has already, is taken out of its host's and domain's counts
    mine = lambda i: F.when(F.col("own") == i, 1.0).otherwise(0.0)
    voted = F.when(F.col("own").isNotNull(), 1.0).otherwise(0.0)
    rest = lambda i: F.greatest(F.get("middle", i) * (F.col("n_domains") + DOMAIN_PRIOR) - mine(i), F.lit(1e-3)) / (F.col("n_domains") - voted + DOMAIN_PRIOR)
    prior = lambda i: (count_in("hosts", i) - mine(i) + HOST_PRIOR * rest(i)) / (F.col("n_hosts") - voted + HOST_PRIOR)
    # a channel's likelihood is smoothed with the shares of its values among all pages
    def channel(key: str) -> DataFrame:
        c = counted("values", key).crossJoin(one)
        share = F.col("n_values") / F.greatest("n_all", F.lit(1.0))
        like = one_each(lambda i: F.log((count_in("values", i) + CHANNEL_PRIOR * share) / (count_in("all", i) + CHANNEL_PRIOR)))
        return c.select(key, F.when(F.col(key) != "", like).alias(f"{key}_log"))

    out = rows.join(hosts, "host", "left").withColumn("hosts", F.coalesce("hosts", F.create_map().cast("map<int,double>"))).join(channel("declared"), "declared", "left").join(channel("suffix"), "suffix", "left")
    out = out.crossJoin(one).withColumn("_top", one_each(lambda i: F.log(top(i))))
    at = lambda c, i: F.coalesce(F.get(F.col(c), i), F.lit(0.0))
    out = out.withColumn("_s", one_each(lambda i: F.get("text_log", i) + F.coalesce(F.log(prior(i)), F.get("_top", i)) + at("declared_log", i) + at("suffix_log", i)))
    out = out.withColumn("_m", F.array_max("_s"))
    out = out.withColumn("_k", F.array_position("_s", F.col("_m")).cast("int"))
    names = F.array(*[F.lit(x) for x in langs])
    norm = F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("_m")))
    return out.select(
        "page_id", names[F.col("_k") - 1].alias("lang"), (1.0 / norm).alias("probability"),
        F.when(F.col("own").isNotNull(), names[F.col("own")]).alias("text_lang"), "declared", "suffix", "host",
    )
