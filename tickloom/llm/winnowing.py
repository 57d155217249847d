"""Document fingerprints by winnowing, in DataFrame functions alone, and each document's likeness to an edit of itself.

A text is its tokens: words, of which longer ones count as several, so that texts without spaces have tokens too. The
hash of K tokens is a cyclic polynomial (the rolling hash that only rotates and adds without carry); as arrays carry no
state from place to place, hashes of 1, 2 and 4 tokens are combined instead of rolled, which gives the same values. Of
every WINDOW hashes in a row the least is chosen, the rightmost of equal ones, with its place.

Guarantee: texts that share WINDOW + K - 1 tokens in a row share a fingerprint, and nothing below K tokens is matched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import SHINGLE, stored

#: Tokens of a hash, hashes of a window (a power of two), and the longest token in code points.
K, WINDOW, TOKEN_CHARS = SHINGLE, 4, 16
#: Low bits of an order value that hold the place (from the right): more than a string can have tokens.
PLACE_BITS = 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it, inside functions of its own too."""
    return F.transform(F.array(value), body)[0]


def _rotated(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def _after(xs: Column, n: int) -> Column:
    return F.slice(xs, F.lit(n + 1), F.greatest(F.size(xs) - n, F.lit(0)))


def _joined(a: Column, b: Column, length: int) -> Column:
    """Hashes of neighbouring stretches put together; length: tokens of the second."""
    return F.zip_with(a, b, lambda x, y: _rotated(x, length).bitwiseXOR(y))


def _lower(values: Column, span: int) -> Column:
    """The lower of each value and the one `span` places after it; where there is none, the value."""
    return let(values, lambda v: F.zip_with(v, _after(v, span), lambda x, y: F.when(y < x, y).otherwise(x)))


def gram_hashes(tokens: Column, k: int = K) -> Column:
    """Hashes of each k tokens in a row; of all together where there are fewer, and none without tokens."""

    def grown(span: Column, size: int, total: Column | None, length: int) -> Column:
        if k & size:
            total, length = (span, size) if total is None else (_joined(total, _after(span, length), size), length + size)
        return total if length == k else let(_joined(span, _after(span, size), size), lambda s: grown(s, 2 * size, total, length))

    def of(one: Column) -> Column:
        # where a span passes the end its value is null; those places are cut
        grams = F.slice(grown(one, 1, None, 0), F.lit(1), F.greatest(F.size(one) - (k - 1), F.lit(0)))
        whole = F.aggregate(one, F.lit(0).cast("long"), lambda z, x: _rotated(z, 1).bitwiseXOR(x))
        return F.when(F.size(one) >= k, grams).when(F.size(one) > 0, F.array(whole)).otherwise(F.array().cast("array<long>"))

    return F.transform(let(F.transform(tokens, lambda t: F.xxhash64(t)), of), lambda x: F.xxhash64(x))


def winnowed(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The chosen hashes of a text (null: empty) in order: an array of (hash, place), place being the first token's
    number. A text of fewer hashes than a window is one window; a text without tokens has none."""
    if window & (window - 1):
        raise ValueError("a window is a power of two")
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN_CHARS), F.lit(0))
    last = (1 << PLACE_BITS) - 1

    def chosen(hashes: Column) -> Column:
        # the upper bits of a hash, then its place from the right: the least of these is the rightmost least hash
        least = F.transform(hashes, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, PLACE_BITS + 1), PLACE_BITS) + (last - i))
        span = 1
        while span < window:
            least = _lower(least, span)
            span *= 2
        windows = F.slice(least, F.lit(1), F.greatest(F.size(hashes) - (window - 1), F.least(F.size(hashes), F.lit(1))))
        place = lambda v: (last - v.bitwiseAND(F.lit(last).cast("long"))).cast("int")
        return F.transform(F.array_distinct(windows), lambda v: F.struct(F.get(hashes, place(v)).alias("hash"), place(v).alias("place")))

    return let(gram_hashes(tokens, k), chosen)


def printed(prints: Column) -> Column:
    """Fingerprints as text: all hashes, then all places, in order of place; nothing without tokens."""
    return F.when(F.size(prints) > 0, F.concat_ws(" @ ", prints["hash"].cast("string"), prints["place"].cast("string"))).otherwise(F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two fingerprints by all their hashes, from 0 to 1; 1 where neither has any."""
    both, total = F.size(F.array_intersect(a["hash"], b["hash"])), F.size(F.array_union(a["hash"], b["hash"]))
    return let(total, lambda n: F.when(n == 0, 1.0).otherwise(both / F.greatest(n, F.lit(1))))


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, text and prints (see winnowed) of every row. Null text: empty; other columns are dropped."""
    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.select("doc_id", "text", winnowed(F.col("text"), k, window).alias("prints"))


def _keyed(docs: DataFrame) -> DataFrame:
    """text and the key (none, place, hash) that orders documents by doc_id descending, null last, then text. The key
    gives the doc_id back, so that all who need texts by key can share one exchange."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.select("text", F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("place"), F.xxhash64("text").alias("hash"))


KEY = ["none", "place", "hash"]


def following(keys: DataFrame) -> DataFrame:
    """Each distinct key with the next one in order (to_none, to_place, to_hash); the first one follows the last.

    Keys are dealt out in ranges and written; a range's last key is followed by the first one of the next range. The
    ranges are as many as spark.sql.shuffle.partitions, so the one window over all ranges has so many rows.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(keys.select(*KEY).distinct().repartitionByRange(n, *KEY).withColumn("range", F.spark_partition_id()))
    key, in_range, all_ranges = F.struct(*KEY), Window.partitionBy("range").orderBy(*KEY), Window.orderBy("range")
    firsts = ranges.groupBy("range").agg(F.min(key).alias("first"))
    whole = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = firsts.select("range", F.coalesce(F.lead("first").over(all_ranges), F.first("first").over(whole)).alias("edge"))
    inside = ranges.withColumn("to", F.lead(key).over(in_range)).join(edges, "range")
    return inside.withColumn("to", F.coalesce("to", "edge")).select(*KEY, *[F.col(f"to.{c}").alias(f"to_{c}") for c in KEY])


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half of the code points (rounded down) replaced by as
    many, or all, from the beginning of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (likeness to the edited
    text's fingerprint and to the next document's), one row for each row. The next document is that of the next smaller
    doc_id (null: last), after the last the first; of texts that share a doc_id, the next one in order of a hash. Rows
    equal in doc_id and text have the same next document. Null text: empty. A single document is its own next. No rows:
    none. Other columns are dropped.

    Every text is dealt out by its key once, and once more to meet the next one. Rows equal in doc_id and text meet in
    one task.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs)
    dealt = keyed.repartition(n, *KEY)
    own = dealt.join(following(keyed), KEY).select(F.when(~F.col("none"), F.bitwise_not("place")).alias("doc_id"), "text", *[f"to_{c}" for c in KEY])
    texts = dealt.groupBy(*KEY).agg(F.first("text").alias("next_text"))
    met = own.join(texts.select(*[F.col(c).alias(f"to_{c}") for c in KEY], "next_text"), [f"to_{c}" for c in KEY])
    length = F.length("text")
    half = F.floor(length / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - half), F.substring(F.col("next_text"), F.lit(1), half))
    prints = let(
        edited,
        lambda e: F.struct(
            F.sha2(e.cast("binary"), 256).alias("sha"), winnowed(F.col("text"), k, window).alias("own"), winnowed(e, k, window).alias("edited"),
            winnowed(F.col("next_text"), k, window).alias("next"),
        ),
    )
    row = let(
        prints,
        lambda p: F.struct(
            p["sha"].alias("edited_sha256"), printed(p["own"]).alias("fingerprint"), printed(p["edited"]).alias("edited_fingerprint"),
            likeness(p["own"], p["edited"]).alias("near_edited"), likeness(p["own"], p["next"]).alias("near_next"),
        ),
    )
    return met.select("doc_id", F.length("text").cast("long").alias("n_chars"), row.alias("row")).select("doc_id", "n_chars", "row.*")
