"""Deterministic text and event operators: tokens, fingerprints, near-duplicate titles, decay, keywords, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.rolling import r
from tickloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric words, and pairs of neighbouring characters of CJK runs."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit("[\\x{4e00}-\\x{9fff}]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: s.substr(i, F.lit(2)))))
    return F.concat(words, pairs)


def token_hash(token: Column) -> Column:
    """The first eight hexadecimal digits of the token's MD5 as a number."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


def simhash(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and fingerprint: bit k is set where more of the tokens' hashes have it set than not; no tokens: 0.

    Tokens are counted first, so a token that a text repeats is sent once, and bit sums are combined before the shuffle.
    """
    t = rows.select(key, F.explode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("t")).groupBy(key, "t").agg(F.count("*").alias("n"))
    h = t.select(key, "n", token_hash(F.col("t")).alias("h"))
    sums = h.groupBy(key).agg(*[F.sum(F.when(F.expr(f"(h >> {k}) & 1") == 1, F.col("n")).otherwise(-F.col("n"))).alias(f"b{k}") for k in range(32)])
    bits = sum(F.when(F.col(f"b{k}") > 0, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(32))
    return rows.select(key).distinct().join(sums.select(key, bits.alias("fingerprint")), key, "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit(0)))


_BITS = " + ".join(f"CASE WHEN sum(CASE WHEN (h >> {k}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << k} ELSE 0 END" for k in range(32))


@query(f"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), h AS (SELECT item_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM t),
 f AS (SELECT item_id, CAST({_BITS} AS BIGINT) AS fingerprint FROM h GROUP BY 1) SELECT item_id, coalesce(fingerprint, 0) AS fingerprint FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN f USING (item_id)""")
def text_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("""WITH t AS (SELECT event_id, unnest(regexp_extract_all(lower(event_type || ' ' || props), '[a-z0-9]+')) AS t FROM events) SELECT t AS token, count(*) AS n, count(DISTINCT event_id) AS events FROM t GROUP BY 1""")
def text_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", F.explode(tokens(F.concat_ws(" ", "event_type", "props"))).alias("token"))
    per_event = t.groupBy("token", "event_id").agg(F.count("*").alias("n"))
    return per_event.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("events"))


def near_titles(rows: DataFrame, key: list[str], score: str, fingerprint: str, most: int = 8) -> DataFrame:
    """Rows whose fingerprint differs in most bits or more from all rows of the key with a higher score that were kept.

    The greedy pass goes over one key's rows in order of score, as a fold within the key; keys are hours or symbols.
    Of rows with one fingerprint only the first can be kept (most is 1 at least), so the others go before the fold,
    in a partial aggregate. Null fingerprints are close to none.
    """
    cols = [c for c in rows.columns if c not in key]
    x = rows.select(*key, fingerprint, F.struct(-F.col(score), *cols).alias("x"))
    best = x.where(F.col(fingerprint).isNotNull()).groupBy(*key, fingerprint).agg(F.min("x").alias("x"))
    g = best.select(*key, "x").union(x.where(F.col(fingerprint).isNull()).select(*key, "x")).groupBy(*key).agg(F.sort_array(F.collect_list("x")).alias("s"))
    kind = rows.select(F.struct(*cols).alias("x")).schema["x"].dataType.simpleString()
    kept = F.aggregate("s", F.array().cast(f"array<{kind}>"), lambda acc, x: F.when(
        F.exists(acc, lambda y: F.bit_count(y[fingerprint].bitwiseXOR(x[fingerprint])) < most), acc
    ).otherwise(F.concat(acc, F.array(F.struct(*[x[c].alias(c) for c in cols])))))
    return g.select(*key, F.inline(kept))


@query(f"""WITH RECURSIVE t AS (SELECT event_id, unnest(regexp_extract_all(lower(event_type || ' ' || props), '[a-z0-9]+')) AS t FROM events), h AS (SELECT event_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) AS h FROM t),
 p AS (SELECT event_id, CAST({_BITS} AS BIGINT) AS f FROM h GROUP BY 1), e AS (SELECT user_id, event_id, value, f FROM events JOIN p USING (event_id)),
 o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM e),
 k AS (SELECT user_id, rn, event_id, [f] AS kept, true AS keep FROM o WHERE rn = 1 UNION ALL
 SELECT o.user_id, o.rn, o.event_id, CASE WHEN len(list_filter(k.kept, lambda y: bit_count(xor(y, o.f)) < 8)) > 0 THEN k.kept ELSE list_append(k.kept, o.f) END, len(list_filter(k.kept, lambda y: bit_count(xor(y, o.f)) < 8)) = 0
 FROM k JOIN o ON o.user_id = k.user_id AND o.rn = k.rn + 1) SELECT user_id, event_id FROM k WHERE keep""")
def text_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user without those whose SimHash is close to one of higher value, as a greedy fold."""
    events = table(spark, sf_dir, "events").select("user_id", "value", "event_id", F.concat_ws(" ", "event_type", "props").alias("words"))
    e = events.drop("words").join(simhash(events, "event_id", "words").withColumnRenamed("fingerprint", "f"), "event_id")
    return near_titles(e, ["user_id"], "value", "f").select("user_id", "event_id")


@query("""SELECT event_id, date_diff('day', ts, TIMESTAMP '2024-02-01') AS age, round(greatest(0, 1 - date_diff('day', ts, TIMESTAMP '2024-02-01') / 14.0::DOUBLE), 6) AS freshness,
 round(value * greatest(0, 1 - date_diff('day', ts, TIMESTAMP '2024-02-01') / 14.0::DOUBLE), 6) AS shown, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def text_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact that fades linearly over 14 days, and a field of the JSON properties."""
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts"))
    fresh = F.greatest(F.lit(0.0), 1 - age / 14.0)
    return table(spark, sf_dir, "events").select("event_id", age.cast("long").alias("age"), r("freshness", fresh), r("shown", F.col("value") * fresh), F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT CAST(ts AS DATE) AS d, event_type AS topic, CASE WHEN value >= 50 THEN 'up' ELSE 'down' END AS direction, count(*) AS n, round(ln(1 + sum(value)), 6) AS intensity, count(*) < 3 AS rare, max(value) AS strongest FROM events GROUP BY 1, 2, 3""")
def text_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by day, topic and direction, with logarithmic intensity."""
    g = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d"), F.col("event_type").alias("topic"), F.when(F.col("value") >= 50, "up").otherwise("down").alias("direction"))
    return g.agg(F.count("*").alias("n"), r("intensity", F.log(1 + F.sum("value"))), (F.count("*") < 3).alias("rare"), F.max("value").alias("strongest"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), ''), 'none') AS host, split_part(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.', 1) AS first_label,
 CASE WHEN regexp_matches(lower(html), '<table') THEN 'table' WHEN regexp_matches(lower(html), '<ul|<ol') THEN 'list' WHEN regexp_matches(lower(html), '<p') THEN 'prose' ELSE 'other' END AS kind FROM pages""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host of the address, its first label, and the page's kind by the first rule that matches."""
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    html = F.lower("html")
    kind = F.when(html.rlike("<table"), "table").when(html.rlike("<ul|<ol"), "list").when(html.rlike("<p"), "prose").otherwise("other")
    return table(spark, sf_dir, "pages").select("page_id", F.when(host == "", "none").otherwise(host).alias("host"), F.split_part(host, F.lit("."), F.lit(1)).alias("first_label"), kind.alias("kind"))


@query("""WITH b AS (SELECT event_type, date_trunc('hour', ts) AS hour, event_id, value, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY value DESC, event_id) AS place FROM events) SELECT event_type, event_id FROM b WHERE place = 1""")
def text_best_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest event of each topic and hour."""
    e = table(spark, sf_dir, "events")
    best = F.max_by(F.col("event_id"), F.struct("value", -F.col("event_id")))
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(best.alias("event_id")).select("event_type", "event_id")
