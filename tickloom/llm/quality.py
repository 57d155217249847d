"""Quality rules: document statistics and robust multivariate outliers within each language and source.

All of it is DataFrame operations. Statistics are rounded to whole thousandths after their transformation, so that
the sums of a group are sums of whole numbers: every estimate is the same for any partitioning and after the loss
of an executor. Medians and C-step thresholds are exact percentiles of whole numbers, whose aggregation buffers
hold counts of values and so stay small however many documents a group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import stored

SEPARATORS = " \t\n\x0b\f\r"
#: The transformed statistics, and what is added to each one's variance (as a standard deviation, in thousandths):
#: statistics that are 0 for most documents would otherwise have no spread at all.
STATISTICS = {"word_length": 60, "symbols": 60, "dup_lines": 120, "repeats": 120, "upper": 60}
#: Share of a group's documents that the estimate rests on, the factor that makes its covariance consistent at the
#: normal distribution (five dimensions), and chi-square quantiles of five degrees of freedom: 0.975 and 1 - 1e-6.
SUPPORT, CONSISTENCY, REWEIGHT, CUTOFF = 0.75, 1.412, 12.833, 35.888
#: Groups with fewer documents than this are pooled, first with those of their language, then with all others.
MIN_GROUP = 50
#: Groups whose estimates may be broadcast: some 20 MB.
BROADCAST_GROUPS = 100_000
C_STEPS = 3
_D = list(STATISTICS)
_PAIRS = [(i, j) for i in range(len(_D)) for j in range(i + 1)]


def base_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_upper to docs(text).

    A null text has no words. Windows are found by sorting 64-bit keys (hash of three words, then position) within
    the document's own array and comparing neighbours word by word.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    d = docs.withColumns({
        "_w": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+", -1)),
        "_l": F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, "\\P{Lu}+", "")).cast("long"),
    })
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "_bits": F.length(F.bin(F.size("_w").cast("long"))),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
    })
    d = d.withColumn("_s", F.expr("""
        CASE WHEN n_words < 3 THEN CAST(array() AS array<bigint>)
             ELSE sort_array(transform(sequence(0, size(_w) - 3), i ->
                    coalesce(shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _bits) | CAST(i AS bigint), 0L))) END
    """))  # fmt: skip
    # element j of _s against element k: the same hash, then the same three words
    mask = "CAST(shiftleft(1L, _bits) - 1 AS bigint)"
    at = lambda x: f"CAST({x} & {mask} AS int)"
    same = lambda x, y: (
        f"coalesce(shiftright({x}, _bits) = shiftright({y}, _bits) AND "
        + " AND ".join(f"get(_w, {at(x)} + {k}) = get(_w, {at(y)} + {k})" for k in range(3))
        + ", false)"
    )
    d = d.withColumn("_p", F.expr(f"filter(_s, (x, j) -> {same('x', 'get(_s, j - 1)')} OR {same('x', 'get(_s, j + 1)')})"))
    d = d.withColumn("n_repeat_words", F.expr(f"""
        CAST(size(array_distinct(flatten(transform(_p, x -> transform(array(0, 1, 2), k -> {at('x')} + k))))) AS bigint)
    """))  # fmt: skip
    return d.drop("_w", "_l", "_bits", "_s", "_p")


def transformed(stats: DataFrame) -> DataFrame:
    """The statistic vector in whole thousandths: logarithm of the mean word length, square roots of the shares."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = lambda a, b: F.sqrt(F.col(a) / b)
    values = {
        "word_length": F.log(chars / words),
        "symbols": share("n_symbols", chars),
        "dup_lines": share("n_dup_lines", F.greatest("n_lines", F.lit(1))),
        "repeats": share("n_repeat_words", words),
        "upper": share("n_upper", chars),
    }
    return stats.withColumns({k: F.floor(v * 1000 + 0.5).cast("long") for k, v in values.items()})


def _per_group(groups: int):
    """What a table of one row a group is passed through before a join: a broadcast if there are few enough groups,
    so that rows of a hot group stay where they are."""
    return F.broadcast if groups <= BROADCAST_GROUPS else lambda df: df


def _grouped(rows: DataFrame, sizes: DataFrame, min_group: int, few) -> DataFrame:
    """Adds g, the group that each row is judged in; null where even the pool of all small groups is too small."""
    by_lang = sizes.where(F.col("_n") < min_group).groupBy("lang").agg(F.sum("_n").alias("_nl"))
    rest = by_lang.where(F.col("_nl") < min_group).agg(F.coalesce(F.sum("_nl"), F.lit(0)).alias("_nr"))
    own = sizes.join(by_lang.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")), "left").crossJoin(F.broadcast(rest))
    part = lambda c: F.coalesce(F.regexp_replace(F.col(c), "/", "//"), F.lit("/null"))
    own = own.select(
        F.col("lang").alias("_gl"), F.col("source").alias("_gs"),
        F.when(F.col("_n") >= min_group, F.concat(part("lang"), F.lit(" / "), part("source")))
        .when(F.col("_nl") >= min_group, F.concat(part("lang"), F.lit(" / *")))
        .when(F.col("_nr") >= min_group, F.lit("* / *")).alias("g"),
    )
    return rows.join(few(own), F.col("lang").eqNullSafe(F.col("_gl")) & F.col("source").eqNullSafe(F.col("_gs")), "left").drop("_gl", "_gs")


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means and the Cholesky factor of the regularised covariance, one row for each group."""
    sums = [F.count("*").alias("n")] + [F.sum(c).alias(f"s_{c}") for c in _D]
    sums += [F.sum(F.col(_D[i]) * F.col(_D[j])).alias(f"s_{i}_{j}") for i, j in _PAIRS]
    out = rows.groupBy(*keys).agg(*sums)
    out = out.withColumns({f"m_{c}": F.col(f"s_{c}") / F.col("n") for c in _D})
    cov = lambda i, j: F.lit(factor) * (F.col(f"s_{i}_{j}") / F.col("n") - F.col(f"m_{_D[i]}") * F.col(f"m_{_D[j]}"))
    for i, j in _PAIRS:
        x = cov(i, j) + (F.lit(float(STATISTICS[_D[i]] ** 2)) if i == j else F.lit(0.0))
        for k in range(j):
            x = x - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        out = out.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(x, F.lit(1.0))) if i == j else x / F.col(f"l_{j}_{j}"))
    det = sum((F.log(f"l_{i}_{i}") for i in range(1, len(_D))), F.log("l_0_0"))
    return stored(out.select(*keys, *[f"m_{c}" for c in _D], *[f"l_{i}_{j}" for i, j in _PAIRS], det.alias("log_det")))


def _squared_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from what _moments() has found, by forward substitution."""
    for i, c in enumerate(_D):
        y = F.col(c) - F.col(f"m_{c}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"_y{k}")
        rows = rows.withColumn(f"_y{i}", y / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, len(_D))), F.col("_y0") * F.col("_y0"))
    return rows.withColumn("d2", total).drop(*[f"_y{i}" for i in range(len(_D))])


def _nearest(rows: DataFrame, distance: Column, keys: list[str], few) -> DataFrame:
    """The share SUPPORT of each group's rows that is nearest, with ties, by distance in steps of about 1/4000 of it.

    The steps are those of a logarithm, so that an aggregation buffer has few different values at any distance.
    """
    q = rows.withColumn("_q", F.floor(F.log1p(distance) * 4096).cast("long"))
    limit = stored(q.groupBy(*keys).agg(F.percentile("_q", SUPPORT).alias("_limit")))
    return q.join(few(limit), keys).where(F.col("_q") <= F.col("_limit"))


def minimum_covariance_determinant(rows: DataFrame, few=lambda df: df) -> DataFrame:
    """For each group g of rows(g, statistics): location and Cholesky factor of the reweighted MCD estimate.

    Two deterministic starts (nearest by scaled Euclidean and by scaled maximum norm around the coordinate medians)
    each take C_STEPS concentration steps; the smaller determinant wins, and all rows within REWEIGHT of it give the
    final estimate. few: see _per_group().
    """
    medians = stored(rows.groupBy("g").agg(*[F.percentile(c, 0.5).alias(f"md_{c}") for c in _D]))
    off = rows.join(few(medians), "g")
    scales = stored(off.groupBy("g").agg(*[F.percentile(F.floor(F.abs(F.col(c) - F.col(f"md_{c}"))), 0.5).alias(f"sc_{c}") for c in _D]))
    z = lambda c: F.abs(F.col(c) - F.col(f"md_{c}")) / (F.col(f"sc_{c}") * 1.4826 + F.lit(float(STATISTICS[c])))
    starts = off.join(few(scales), "g").select("g", *_D, F.explode(F.array(
        F.struct(F.lit(0).alias("start"), sum((z(c) * z(c) for c in _D[1:]), z(_D[0]) * z(_D[0])).alias("far")),
        F.struct(F.lit(1).alias("start"), F.greatest(*[z(c) for c in _D]).alias("far")),
    )).alias("x")).select("g", *_D, "x.*")
    both = rows.select("g", *_D).crossJoin(F.broadcast(rows.sparkSession.range(2).select(F.col("id").cast("int").alias("start"))))
    keys = ["g", "start"]
    moments = _moments(_nearest(starts, F.col("far"), keys, few), keys, CONSISTENCY)
    for _ in range(C_STEPS):
        near = _nearest(_squared_distance(both.join(few(moments), keys)), F.col("d2"), keys, few)
        moments = _moments(near.select(*keys, *_D), keys, CONSISTENCY)
    best = moments.groupBy("g").agg(F.min(F.struct("log_det", "start")).alias("b")).select("g", F.col("b.start").alias("start"))
    raw = _squared_distance(rows.join(few(moments.join(best, keys).drop("start")), "g"))
    return _moments(raw.where(F.col("d2") <= REWEIGHT).select("g", *_D), ["g"], 1.0)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, lang, source, the base statistics, base_failed, judged_in, d2 and kept for each row of docs.

    base_failed: fewer than 50 words, or over half of the words in three-word windows that recur in the document.
    Of the others, those whose squared robust distance in their language and source exceeds the cutoff are not kept
    either. Null text: no words, so base_failed. Null lang or source: a group of its own. Repeated rows: each counts.
    Groups of fewer than min_group such documents are pooled: a covariance of five statistics can't be estimated from
    a handful. judged_in names the group or pool ("en / web", "en / *", "* / *"); it is null, and the document has
    no distance and is kept, where even the pool of all is too small. Empty table: no rows. Other columns are dropped.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    )
    stats = transformed(base_statistics(d)).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    stats = stored(stats.select("doc_id", "lang", "source", *counts, "base_failed", *_D))
    good = stats.where(~F.col("base_failed"))
    sizes = stored(good.groupBy("lang", "source").agg(F.count("*").alias("_n")))
    few = _per_group(sizes.count())
    rows = stored(_grouped(good, sizes, min_group, few))
    found = minimum_covariance_determinant(rows.where(F.col("g").isNotNull()), few)
    judged = _squared_distance(rows.join(few(found), "g", "left")).select("doc_id", "lang", "source", *counts, "base_failed", F.col("g").alias("judged_in"), "d2")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("judged_in", "string"), ("d2", "double"))]
    failed = stats.where("base_failed").select("doc_id", "lang", "source", *counts, "base_failed", *none)
    return judged.unionByName(failed).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("d2") > cutoff, F.lit(False)))
