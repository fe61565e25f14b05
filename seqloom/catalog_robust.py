"""Queries that hold burst ends against the same bursts turned round their book, audits of the streams, and exports of groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import catalog_words as Q
from .catalog import register
from .catalog_events import summary_sql
from .functions import phonetics
from .operators import arrivals as A
from .operators import controls as X
from .operators import hierarchy as H
from .operators import robustness as B
from .operators import words as W

TURNS, LEAST = 100, 2
FRACTIONS = (0.0, 0.01, 0.05, 0.1)


def _rows(spark, d):
    return A.edge_censored(Q._arrived(spark, d))


def _records(spark, d):
    return B.alignment_records(_rows(spark, d), Q.BLOCK, TURNS)


_FLAGS = ", ".join(f"coalesce(ar.{x}_id <> ar.{x}_after, false) AS {x}" for x in H.LEVELS)
REC = Q._arrivals_sql() + Q.RUNS + Q.CENSOR + f""", q0 AS (SELECT ce.book, ce.i - {Q.WINDOW} AS pos, ce.value, (ce.i - {Q.WINDOW}) // {Q.BLOCK} + 1 AS block, {_FLAGS} FROM ce JOIN ar ON ar.book = ce.book AND ar.i = ce.i),
q1 AS (SELECT *, value > 0 AND NOT coalesce(lead(value) OVER w > 0, false) AS final, value > 0 AND coalesce(lag(value) OVER w > 0, false) AS joined, count(*) OVER (PARTITION BY book) AS n FROM q0 WINDOW w AS (PARTITION BY book ORDER BY pos)),
tn AS (SELECT book, shift, row_number() OVER (PARTITION BY book ORDER BY md5(concat_ws('|', '1', book, shift)), shift) AS draw FROM (SELECT book, n - pos AS shift FROM q1 WHERE pos > 0 AND NOT joined)),
mv AS (SELECT 0 AS perm_id, book, pos FROM q1 WHERE final UNION ALL SELECT draw, q1.book, (pos + shift) % n FROM q1 JOIN tn ON tn.book = q1.book WHERE final AND draw <= {TURNS}),
rc AS (SELECT perm_id, mv.book, block, {', '.join(H.LEVELS)} FROM mv JOIN q1 ON q1.book = mv.book AND q1.pos = mv.pos)"""


def _rates_sql(name: str, source: str, keys: str) -> str:
    return f", {name} AS (" + " UNION ALL ".join(f"SELECT perm_id, {keys}, '{x}' AS level, count(*) FILTER ({x}) AS hits, count(*) AS ends, count(*) FILTER ({x}) / count(*) AS value FROM {source} GROUP BY perm_id, {keys}" for x in H.LEVELS) + ")"


def _against_sql(rates: str, keys: str) -> str:
    ks = ", ".join(keys.split())
    return f", seen AS (SELECT {ks}, value AS observed FROM {rates} WHERE perm_id = 0), nulls AS (SELECT perm_id, {ks}, value FROM {rates} WHERE perm_id > 0) " + summary_sql(keys, sd="stddev_pop")


_BOOKS = REC + _rates_sql("rt", "rc", "book") + _against_sql("rt", "book level")
register("run_end_records", lambda s, d: _records(s, d).groupBy("perm_id").agg(F.count("*").alias("ends"), *(F.count_if(x).alias(x) for x in H.LEVELS)), REC + " SELECT perm_id, count(*) AS ends, " + ", ".join(f"count(*) FILTER ({x}) AS {x}" for x in H.LEVELS) + " FROM rc GROUP BY perm_id")
register("boundary_shift_null", lambda s, d: B.book_alignment(_records(s, d)), _BOOKS)
register(
    "boundary_statistics", lambda s, d: B.statistics_rows(B.book_alignment(_records(s, d)).withColumn("metric", F.concat(F.lit("run_ends_"), "level")).drop("level"), "boundary_alignment", "run_preserving_turn"),
    f"SELECT * EXCLUDE (level), 'run_ends_' || level AS metric, 'boundary_alignment' AS family, 'primary' AS metric_role, 'run_preserving_turn' AS \"null\" FROM ({_BOOKS})",
)
register(
    "direction_audit", lambda s, d: B.direction_audit(B.book_alignment(_records(s, d))),
    f"SELECT level, books, books_positive, median_difference, round(books_positive / books, 8) AS positive_share FROM (SELECT level, count(*) AS books, count(*) FILTER (observed - null_mean > 0) AS books_positive, round(quantile_cont(observed - null_mean, 0.5), 6) AS median_difference FROM ({_BOOKS}) GROUP BY level)",
)
register(
    "block_support", lambda s, d: B.block_support(_records(s, d), LEAST),
    REC + _rates_sql("rt", "rc", "book, block") + f""", mn AS (SELECT book, block, level, avg(value) AS mean FROM rt WHERE perm_id > 0 GROUP BY ALL),
ap AS (SELECT r.perm_id, r.book, r.level, r.value - mn.mean AS apart FROM rt r JOIN mn ON mn.book = r.book AND mn.block = r.block AND mn.level = r.level JOIN (SELECT book, block, level FROM rt WHERE perm_id = 0 AND ends >= {LEAST}) f ON f.book = r.book AND f.block = r.block AND f.level = r.level),
sp AS (SELECT perm_id, book, level, 'positive_share' AS metric, avg(CASE WHEN apart > 1e-12 THEN 1.0 ELSE 0.0 END) AS value FROM ap GROUP BY ALL UNION ALL SELECT perm_id, book, level, 'median_difference', quantile_cont(apart, 0.5) FROM ap GROUP BY ALL)""" + _against_sql("sp", "book level metric"),
)
_CUTS = " UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS fraction" for f in FRACTIONS)
register(
    "dense_block_trim", lambda s, d: B.trimmed(_rows(s, d), _records(s, d), Q.BLOCK, FRACTIONS),
    REC + f""", dn AS (SELECT *, row_number() OVER (ORDER BY density DESC, book, block) AS rank, count(*) OVER () AS n FROM (SELECT book, block, round(sum(value) / count(*), 9) AS density FROM q1 GROUP BY book, block HAVING count(*) >= {Q.BLOCK // 2})),
fr AS ({_CUTS}), gone AS (SELECT fraction, book, block FROM dn, fr WHERE rank <= ceil(round(n * fraction, 9))),
kp AS (SELECT rc.*, fr.fraction FROM rc CROSS JOIN fr ANTI JOIN gone ON gone.fraction = fr.fraction AND gone.book = rc.book AND gone.block = rc.block)""" + _rates_sql("rt", "kp", "fraction") + _against_sql("rt", "fraction level"),
)
_ENDS = ", ".join(f"count(*) FILTER (ends_{x}) AS {x}_ends, count(*) FILTER (ends_{x} AND pk IS NULL) AS {x}_ends_after_missing, count(DISTINCT CASE WHEN pk IS NOT NULL THEN book || '|' || {x}_id END) AS {x}_in_stream" for x in H.LEVELS)
register("parse_audit", lambda s, d: B.parse_audit(W.signed(Q._words(s, d))), Q._signature_sql() + f" SELECT lang, count(*) AS words, count(*) FILTER (pk IS NULL) AS missing, CAST(sum(n_ext) AS BIGINT) AS markers, {_ENDS} FROM s4 GROUP BY lang")


def _pairs(spark, d):
    """How each word sounds with the one before it: FULL, BRIDGE, no rhyme, or none where one has no signature."""
    by = Window.partitionBy("book").orderBy("pos")
    rows = W.signed(Q._words(spark, d)).select("lang", "pk", "bk", F.lag("pk").over(by).alias("pk0"), F.lag("bk").over(by).alias("bk0"), F.lag("pos").over(by).alias("before")).where("before is not null")
    kind = phonetics.match_kind(F.col("pk0"), F.col("bk0"), F.col("pk"), F.col("bk"))
    return rows.groupBy("lang", F.when(F.col("pk").isNull() | F.col("pk0").isNull(), "unknown").otherwise(F.coalesce(kind, F.lit("none"))).alias("kind")).agg(F.count("*").alias("n"))


register(
    "word_pairs", _pairs,
    Q._signature_sql() + """, wp AS (SELECT lang, pk, bk, lag(pk) OVER w AS p0, lag(bk) OVER w AS b0, lag(pos) OVER w AS before FROM s4 WINDOW w AS (PARTITION BY book ORDER BY pos))
SELECT lang, CASE WHEN pk IS NULL OR p0 IS NULL THEN 'unknown' WHEN p0 = pk THEN 'FULL' WHEN coalesce(p0 = bk, false) OR coalesce(b0 = pk, false) THEN 'BRIDGE' ELSE 'none' END AS kind, count(*) AS n FROM wp WHERE before IS NOT NULL GROUP BY ALL""",
)
register(
    "rhyme_group_display", lambda s, d: B.group_display(Q._groups(Q._stream(s, d)).where("role = 'primary'").select("key", "word", "n")),
    Q.GROUPS + " SELECT key, first(word ORDER BY n DESC, word) AS mode, string_agg(CASE WHEN n = 1 THEN word ELSE word || ' ×' || n END, ', ' ORDER BY n DESC, word) AS display FROM mem WHERE role = 'primary' GROUP BY key",
)
register(
    "rhyme_group_locations", lambda s, d: B.located(Q._stream(s, d), 2, 5),
    Q._signature_sql() + """, lo AS (SELECT *, row_number() OVER (PARTITION BY book, verse_id ORDER BY pos) AS place FROM st)
SELECT book, pk AS key, exact AS word, count(*) AS n, string_agg('v' || (CAST(verse_id AS BIGINT) + 1) || ':w' || place, ', ' ORDER BY verse_id, place) AS locations FROM lo WHERE verse_id + 1 BETWEEN 2 AND 5 GROUP BY ALL""",
)


def _allocation(spark, d):
    null, seen = X.allocation_draws(Q._arrived(spark, d), "verse", 20)
    every = lambda df, keys, v: df.groupBy(*keys, F.lit("ALL").alias("scope")).agg((F.sum(F.col(v) * F.col("segments")) / F.sum("segments")).alias(v))
    own = lambda df, keys, v: df.select(*keys, F.col("book").cast("string").alias("scope"), v)
    null = own(null, ["perm_id"], "value").union(every(null, ["perm_id"], "value"))
    return B.quantiles(null, own(seen, [], "observed").union(every(seen, [], "observed")), ["scope"])


register(
    "allocation_quantiles", _allocation,
    Q._arrivals_sql() + """, sz AS (SELECT book, count(DISTINCT verse_id) AS segments, count(*) FILTER (value > 0) AS active, count(DISTINCT verse_id) FILTER (value > 0) / count(DISTINCT verse_id) AS observed FROM ar GROUP BY book),
rk AS (SELECT perm_id, ar.book, verse_id, segments, active, row_number() OVER (PARTITION BY perm_id, ar.book ORDER BY md5(concat_ws('|', '1', perm_id, ar.book, i)), i) AS rk FROM ar JOIN sz USING (book), (SELECT unnest(range(20)) AS perm_id)),
al AS (SELECT perm_id, book, max(segments) AS segments, count(DISTINCT verse_id) FILTER (rk <= active) / max(segments) AS value FROM rk GROUP BY perm_id, book),
nl AS (SELECT CAST(book AS VARCHAR) AS scope, value FROM al UNION ALL SELECT 'ALL', sum(value * segments) / sum(segments) FROM al GROUP BY perm_id), sn AS (SELECT CAST(book AS VARCHAR) AS scope, observed FROM sz UNION ALL SELECT 'ALL', sum(observed * segments) / sum(segments) FROM sz)
SELECT scope, permutations, round(observed, 8) + 0.0 AS observed, round(mean, 8) + 0.0 AS null_mean, round(observed - mean, 8) + 0.0 AS difference, round(lo, 8) + 0.0 AS null_q025, round(hi, 8) + 0.0 AS null_q975, round(sd, 6) AS null_sd
FROM (SELECT scope, count(*) AS permutations, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM nl GROUP BY scope) JOIN sn USING (scope)""",
)
