"""Queries on the documents table as word streams: tokens, hierarchy, intervals, sound patterns, bursts, profiles, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register
from .catalog_events import summary_sql
from .config import PROFILES, profile_map
from .functions import phonetics as P
from .functions import stats as S
from .operators import arrivals as A
from .operators import controls as X
from .operators import hierarchy as H
from .operators import intervals as I  # noqa: E741
from .operators import profiles as R
from .operators import words as W
from .plans import nulls as N
from .sources.tables import document_texts, document_tokens

WINDOW, BLOCK, PERMS = 20, 50, 3
#: Permutations of the interval nulls, as many as the reference draws.
INTERVAL_PERMS = 500


def _nfd(x: str) -> str:
    x = f"lower({x})"
    for mark, (whole, base) in P.MARKED.items():
        for a, b in zip(whole, base):
            x = f"replace({x}, '{a}', '{b + mark}')"
    return x


BASE = r"regexp_replace(x, '\p{M}', '', 'g')"
VOWEL = f"{BASE} IN ('a', 'e', 'i', 'o', 'u')"
WD = rf"""WITH tl AS (SELECT doc_id AS book, lang, list_filter(string_split_regex(replace(text, chr(10), ' {{nl}} '), ' +'), lambda x: x <> '') AS l FROM documents),
tok AS (SELECT book, lang, generate_subscripts(l, 1) - 1 AS tok_pos, unnest(l) AS token FROM tl),
num AS (SELECT *, regexp_matches(token, '^\{{[^}}]*\}}$') AS marker, sum(CASE WHEN regexp_matches(token, '^\{{[^}}]*\}}$') THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY tok_pos ROWS UNBOUNDED PRECEDING) - 1 AS pos FROM tok),
wd0 AS (SELECT book, lang, pos, regexp_replace(max(token) FILTER (NOT marker), '\[[^\]]*\]', '', 'g') AS word, count(*) FILTER (marker) AS n_ext, coalesce(bool_or(token = '{{nl}}'), false) AS nl FROM num WHERE pos >= 0 GROUP BY book, lang, pos),
wd AS (SELECT *, word LIKE '%.' AS ends_verse, word LIKE '%.' OR nl AS ends_major, word LIKE '%.' OR nl OR word LIKE '%,' AS ends_minor, {_nfd('word')} AS dw FROM wd0)"""
PL = WD + rf""", p1 AS (SELECT *, len(regexp_extract_all(replace(dw, '{P.ACUTE}', ''), '([aeiou]+)', 1)) AS pulses, CASE WHEN instr(dw, '{P.ACUTE}') > 0 THEN len(regexp_extract_all(substr(dw, 1, instr(dw, '{P.ACUTE}') - 1), '([aeiou]+)', 1)) - 1 END AS accent FROM wd),
pl AS (SELECT *, start_pulse + pulses AS end_pulse, start_pulse + least(accent, greatest(pulses - 1, 0)) AS accent_pulse, accent IS NOT NULL AS accented FROM (SELECT *, coalesce(sum(pulses) OVER w, 0) AS start_pulse,
  coalesce(sum(CAST(ends_verse AS INT)) OVER w, 0) AS verse_id, coalesce(sum(CAST(ends_major AS INT)) OVER w, 0) AS major_id, coalesce(sum(CAST(ends_minor AS INT)) OVER w, 0) AS minor_id FROM p1
  WINDOW w AS (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
SEG = PL + ", sg AS (" + " UNION ALL ".join(f"SELECT book, '{x}' AS level, {x}_id AS segment, count(*) AS words, sum(pulses) AS pulses, count(*) FILTER (accented) AS accents, min(pos) AS first, max(pos) AS last, bool_or(ends_{x}) AS complete FROM pl GROUP BY book, {x}_id" for x in H.LEVELS) + "), sc AS (SELECT * FROM sg WHERE complete)"
REL = PL + ", rl AS (" + " UNION ALL ".join(f"SELECT book, '{u}>{d}' AS relation, parent, count(*) AS children, CAST(sum(words) AS BIGINT) AS words, string_agg(CAST(words AS VARCHAR), '-' ORDER BY child) AS sizes FROM (SELECT *, bool_or(ends) OVER (PARTITION BY book, parent) AS closed FROM (SELECT book, {u}_id AS parent, {d}_id AS child, count(*) AS words, bool_or(ends_{d}) AS whole, bool_or(ends_{u}) AS ends FROM pl GROUP BY ALL)) WHERE whole AND closed GROUP BY book, parent" for u, d in H.RELATIONS) + ")"


def _signature_sql(profile: str = "STRICT") -> str:
    norm = BASE
    for a, b in profile_map(profile).items():
        norm = f"(CASE WHEN {BASE} = '{a}' THEN '{b}' ELSE {norm} END)"
    return PL + rf""", s1 AS (SELECT *, regexp_replace({_nfd(r"regexp_replace(word, '\[[^\]]*\]|\{[^}]*\}', '', 'g')")}, '[^\p{{L}}\p{{M}}]', '', 'g') AS cleaned FROM pl),
s2 AS (SELECT *, regexp_extract_all(regexp_replace(cleaned, '(t\p{{M}}*)(s\p{{M}}*h)', '\1|\2', 'g'), '({P.SEGMENT})', 1) AS parts FROM s1),
s3 AS (SELECT *, coalesce(list_max(list_transform(parts, lambda x, i: CASE WHEN {VOWEL} AND contains(x, '{P.ACUTE}') THEN i ELSE 0 END)), 0) AS acc, len(parts) AS np FROM s2),
s4 AS (SELECT *, CASE WHEN acc > 0 THEN array_to_string(list_transform(parts[(CASE WHEN acc = np THEN greatest(acc - 1, 1) ELSE acc END):np], lambda x: {norm}), '-') END AS pk,
  CASE WHEN acc > 1 AND acc = np - 1 AND NOT ({VOWEL.replace('(x,', '(parts[np],')}) AND NOT ({VOWEL.replace('(x,', '(parts[acc - 1],')}) THEN array_to_string(list_transform(parts[acc - 1:acc], lambda x: {norm}), '-') END AS bk,
  acc > 1 AND acc = np AS extended, regexp_replace(cleaned, '\p{{M}}', '', 'g') AS exact FROM s3),
st AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS i FROM s4 WHERE pk IS NOT NULL)"""


_EDGES = ", ".join(f"{f}({x}_id) OVER (PARTITION BY book ORDER BY i) AS {x}_{side}" for x in H.LEVELS for side, f in (("before", "lag"), ("after", "lead")))


def _arrivals_sql(exclude_exact=False, match="all", no_extended=False, least=0) -> str:
    fine = "true" + (" AND x.exact <> exact" if exclude_exact else "") + (" AND NOT (x.extended OR extended)" if no_extended else "")
    value = {"all": "full_n + bridge_n", "full": "full_n", "bridge": "bridge_n"}[match]
    if least:
        value = f"CASE WHEN {value} >= {least} THEN {value} ELSE 0 END"
    return _signature_sql() + f""", a1 AS (SELECT *, list({{'pk': pk, 'bk': bk, 'exact': exact, 'extended': extended}}) OVER (PARTITION BY book ORDER BY i ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING) AS h, {_EDGES} FROM st),
a2 AS (SELECT *, len(list_filter(h, lambda x: ({fine}) AND x.pk = pk)) AS full_n, len(list_filter(h, lambda x: ({fine}) AND x.pk <> pk AND (coalesce(x.pk = bk, false) OR coalesce(x.bk = pk, false)))) AS bridge_n, len(list_filter(h, lambda x: x.exact = exact)) AS same_word FROM a1 WHERE i >= {WINDOW}),
ar AS (SELECT book, lang, i, full_n AS "full", bridge_n AS bridge, same_word, {value} AS value, verse_id, major_id, minor_id, verse_before, verse_after, major_before, major_after, minor_before, minor_after FROM a2)"""


RUNS = """, r0 AS (SELECT book, i, value, sum(CASE WHEN value > 0 AND NOT coalesce(pv > 0, false) THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY i ROWS UNBOUNDED PRECEDING) AS run_id FROM (SELECT book, i, value, lag(value) OVER (PARTITION BY book ORDER BY i) AS pv FROM ar)),
rn AS (SELECT book, CAST(run_id AS BIGINT) AS run_id, min(i) AS start, max(i) AS "end", count(*) AS length, CAST(sum(value) AS BIGINT) AS intensity FROM r0 WHERE value > 0 GROUP BY book, run_id)"""


def _closed(spark, d):
    return W.closed_by(W.text_words(document_texts(spark, d)))


def _words(spark, d):
    return W.level_ids(_closed(spark, d))


def _pulses(spark, d):
    return W.pulses(_words(spark, d))


def _stream(spark, d, profile="STRICT"):
    return W.stressed_stream(W.signed(W.stress_candidates(_closed(spark, d)), profile))


def _arrived(spark, d, **options):
    return A.arrivals(_stream(spark, d), WINDOW, **options)


register("token_stream", lambda s, d: document_tokens(s, d).groupBy("book", "lang").agg(F.count("*").alias("tokens"), F.sum(F.col("tok_pos") * F.length("token")).alias("weight")), WD + " SELECT book, lang, count(*) AS tokens, CAST(sum(tok_pos * length(token)) AS BIGINT) AS weight FROM tok GROUP BY ALL")
register("external_attach", lambda s, d: _words(s, d).groupBy("book").agg(F.count("*").alias("words"), F.sum(F.size("external")).alias("markers"), F.sum(F.when(F.size("external") > 0, F.col("pos")).otherwise(0)).alias("places")), WD + " SELECT book, count(*) AS words, CAST(sum(n_ext) AS BIGINT) AS markers, CAST(sum(CASE WHEN n_ext > 0 THEN pos ELSE 0 END) AS BIGINT) AS places FROM wd GROUP BY book")
register("vowel_groups", lambda s, d: _pulses(s, d).groupBy("lang", "pulses").agg(F.count("*").alias("n")), PL + " SELECT lang, pulses, count(*) AS n FROM pl GROUP BY ALL")
register("accent_offsets", lambda s, d: _pulses(s, d).groupBy("book").agg(F.max("end_pulse").alias("pulses"), F.count("accent_pulse").alias("accents"), F.sum("accent_pulse").alias("accent_sum"), F.sum("start_pulse").alias("start_sum")), PL + " SELECT book, CAST(max(end_pulse) AS BIGINT) AS pulses, count(accent_pulse) AS accents, CAST(sum(accent_pulse) AS BIGINT) AS accent_sum, CAST(sum(start_pulse) AS BIGINT) AS start_sum FROM pl GROUP BY book")
register("hierarchy_ids", lambda s, d: _words(s, d).groupBy("book").agg(*(f(f"{x}_id").alias(f"{x}_{n}") for x in H.LEVELS for n, f in (("last", F.max), ("sum", F.sum)))), PL + " SELECT book, " + ", ".join(f"CAST(max({x}_id) AS BIGINT) AS {x}_last, CAST(sum({x}_id) AS BIGINT) AS {x}_sum" for x in H.LEVELS) + " FROM pl GROUP BY book")
register("hierarchy_segments", lambda s, d: H.segments(_pulses(s, d)), SEG + ' SELECT book, level, CAST(segment AS BIGINT) AS segment, words, CAST(pulses AS BIGINT) AS pulses, accents, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, complete FROM sg')
register("hierarchy_relations", lambda s, d: H.relations(_words(s, d)), REL + " SELECT book, relation, CAST(parent AS BIGINT) AS parent, children, words, sizes FROM rl")
register("hierarchy_validation", lambda s, d: H.validation(_pulses(s, d)), SEG + " " + " UNION ALL ".join(f"SELECT '{u}>{d}' AS relation, count(*) AS parents, count(*) FILTER (k.w = p.words AND k.pu = p.pulses) AS exact FROM (SELECT * FROM sc WHERE level = '{u}') p LEFT JOIN (SELECT m.book, m.parent, sum(c.words) AS w, sum(c.pulses) AS pu FROM (SELECT DISTINCT book, {u}_id AS parent, {d}_id AS segment FROM pl) m JOIN sc c ON c.level = '{d}' AND c.book = m.book AND c.segment = m.segment GROUP BY ALL) k ON k.book = p.book AND k.parent = p.segment" for u, d in H.RELATIONS))
register("level_summary", lambda s, d: H.level_summary(H.segments(_pulses(s, d))), SEG + " " + " UNION ALL ".join(f"SELECT level, '{f}' AS field, count(*) AS n, count(DISTINCT {f}) AS kinds, round(avg({f}), 8) AS mean, round(stddev_samp({f}), 6) AS sd, round(quantile_cont({f}, 0.5), 8) AS median, CAST(min({f}) AS BIGINT) AS least, CAST(max({f}) AS BIGINT) AS most FROM sc GROUP BY level" for f in ("words", "pulses", "accents")))
register("relation_summary", lambda s, d: H.relation_summary(H.relations(_words(s, d))), REL + " SELECT relation, count(*) AS parents, round(avg(children), 8) AS mean_children, " + ", ".join(f"round(count(*) FILTER (children = {k}) / count(*), 8) AS share_{k}" for k in (1, 2, 3)) + ", count(DISTINCT sizes) AS shapes FROM rl GROUP BY relation")
register("size_frequency", lambda s, d: H.frequency(H.complete(H.segments(_pulses(s, d))), ["level"], "words", 40), SEG + " SELECT level, CASE WHEN b > 40 THEN '>40' ELSE CAST(b AS VARCHAR) END AS label, n, round(n / sum(n) OVER (PARTITION BY level), 8) AS share, round(sum(n) OVER (PARTITION BY level ORDER BY b ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY level), 8) AS cumulative FROM (SELECT level, least(words, 41) AS b, count(*) AS n FROM sc GROUP BY ALL)")
register("size_ngrams", lambda s, d: H.size_ngrams(H.segments(_pulses(s, d)), 3, 50), SEG + " SELECT * FROM (SELECT level, gram, n, row_number() OVER (PARTITION BY level ORDER BY n DESC, first) AS rank FROM (SELECT level, concat_ws('-', g0, g1, g2) AS gram, count(*) AS n, min(book * 1000000 + segment) AS first FROM (SELECT book, segment, level, words AS g0, lead(words, 1) OVER w AS g1, lead(words, 2) OVER w AS g2 FROM sc WINDOW w AS (PARTITION BY book, level ORDER BY segment)) WHERE g2 IS NOT NULL GROUP BY ALL)) WHERE rank <= 50")
_BK = lambda n, x, m: f"CASE WHEN {x} >= {m} THEN '{n}{m}+' ELSE '{n}' || CAST({x} AS BIGINT) END"
SHAPES = SEG + f", sh0 AS (SELECT level, concat_ws(' ', {_BK('W', 'words', 9)}, {_BK('P', 'pulses', 17)}, {_BK('A', 'accents', 4)}) AS shape, count(*) AS n, min(book * 1000000 + segment) AS first FROM sc GROUP BY ALL), sh AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY n DESC, first) AS rank FROM sh0)"
register("shape_frequency", lambda s, d: H.shapes(H.segments(_pulses(s, d))), SHAPES + " SELECT level, shape, n, rank, round(n / sum(n) OVER (PARTITION BY level), 8) AS share, round(sum(n) OVER (PARTITION BY level ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY level), 8) AS cumulative FROM sh")
register("shape_summary", lambda s, d: H.shape_summary(H.segments(_pulses(s, d))), SHAPES + " SELECT level, count(*) AS kinds, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS normalized_entropy, " + ", ".join(f"round(sum(CASE WHEN rank <= {k} THEN n ELSE 0 END) / sum(n), 8) AS top{k}" for k in (1, 3, 5, 10, 20)) + " FROM (SELECT *, n / sum(n) OVER (PARTITION BY level) AS p FROM sh) GROUP BY level")

IV = PL + """, ac AS (SELECT book, row_number() OVER w - 1 AS i, accent_pulse - lag(accent_pulse) OVER w AS interval, verse_id = lag(verse_id) OVER w AS sv, major_id = lag(major_id) OVER w AS sm, minor_id = lag(minor_id) OVER w AS sn FROM pl WHERE accent_pulse IS NOT NULL WINDOW w AS (PARTITION BY book ORDER BY pos)),
iv AS (""" + " UNION ALL ".join(f"SELECT book, i, CAST(interval AS BIGINT) AS interval, '{m}' AS model, {r} AS relation FROM ac WHERE i > 0 AND interval > 0" for m, r in (("continuous", "'continuous'"), ("verse", "CASE WHEN sv THEN 'within' ELSE 'cross_reset' END"), ("major", "CASE WHEN sm THEN 'within' ELSE 'cross_reset' END"), ("minor", "CASE WHEN sn THEN 'within' ELSE 'cross_reset' END"))) + ")"
register("interval_stream", lambda s, d: I.intervals(_pulses(s, d)), IV + " SELECT book, i, interval, model, relation FROM iv")
register("interval_metrics", lambda s, d: I.metrics(I.intervals(_pulses(s, d)), ["model", "relation"]), IV + ", f AS (SELECT *, row_number() OVER (PARTITION BY model, relation ORDER BY n DESC, interval) AS rk, n / sum(n) OVER (PARTITION BY model, relation) AS p FROM (SELECT model, relation, interval, count(*) AS n FROM iv GROUP BY ALL)) SELECT model, relation, CAST(sum(n) AS BIGINT) AS n, round(sum(n * interval) / sum(n), 8) AS mean, round(first(med), 8) AS median, count(*) AS kinds, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS normalized_entropy, " + ", ".join(f"round(sum(CASE WHEN rk <= {k} THEN n ELSE 0 END) / sum(n), 8) AS top{k}_share" for k in (1, 3, 5)) + " FROM f JOIN (SELECT model, relation, quantile_cont(interval, 0.5) AS med FROM iv GROUP BY ALL) USING (model, relation) GROUP BY model, relation")
register("interval_frequency", lambda s, d: H.frequency(I.intervals(_pulses(s, d)), ["model", "relation"], "interval", 30), IV + " SELECT model, relation, CASE WHEN b > 30 THEN '>30' ELSE CAST(b AS VARCHAR) END AS label, n, round(n / sum(n) OVER (PARTITION BY model, relation), 8) AS share, round(sum(n) OVER (PARTITION BY model, relation ORDER BY b ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY model, relation), 8) AS cumulative FROM (SELECT model, relation, least(interval, 31) AS b, count(*) AS n FROM iv GROUP BY ALL)")
T3 = "SELECT {k}, sum(CASE WHEN rk <= 3 THEN n ELSE 0 END) / sum(n) AS value FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, interval) AS rk FROM (SELECT {k}, interval, count(*) AS n FROM {t} GROUP BY ALL)) GROUP BY ALL"
EN = "SELECT {k}, CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END AS value FROM (SELECT {k}, interval, count(*) / sum(count(*)) OVER (PARTITION BY {k}) AS p FROM {t} GROUP BY {k}, interval) GROUP BY ALL"
_both = lambda k, t: f"SELECT 'top3_share' AS metric, * FROM ({T3.format(k=k, t=t)}) UNION ALL SELECT 'entropy_norm', * FROM ({EN.format(k=k, t=t)})"
register(
    "interval_contrast_null", lambda s, d: I.contrast_null(I.intervals(_pulses(s, d)).where("model <> 'continuous'"), INTERVAL_PERMS),
    IV + f""", v AS (SELECT * FROM iv WHERE model <> 'continuous'), pr AS (SELECT perm_id, v.*, row_number() OVER (PARTITION BY perm_id, book, model ORDER BY i) AS place, row_number() OVER (PARTITION BY perm_id, book, model ORDER BY md5(concat_ws('|', '1', perm_id, book, model, i)), i) AS drawn FROM v, (SELECT unnest(range({INTERVAL_PERMS})) AS perm_id)),
dl AS (SELECT s.perm_id, s.book, s.model, s.relation, x.interval FROM pr s JOIN pr x ON s.perm_id = x.perm_id AND s.book = x.book AND s.model = x.model AND s.place = x.drawn),
o AS ({_both('book, model, relation', 'v')}), q AS ({_both('perm_id, book, model, relation', 'dl')}),
seen AS (SELECT a.book, a.model, a.metric, a.value - b.value AS observed FROM o a JOIN o b ON a.book = b.book AND a.model = b.model AND a.metric = b.metric AND a.relation = 'within' AND b.relation = 'cross_reset'),
nulls AS (SELECT a.perm_id, a.book, a.model, a.metric, a.value - b.value AS value FROM q a JOIN q b ON a.perm_id = b.perm_id AND a.book = b.book AND a.model = b.model AND a.metric = b.metric AND a.relation = 'within' AND b.relation = 'cross_reset') """ + summary_sql("book model metric"),
)

register("rhyme_signature", lambda s, d: _stream(s, d).groupBy("pk", "bk", "extended").agg(F.count("*").alias("n")), _signature_sql() + " SELECT pk, bk, extended, count(*) AS n FROM st GROUP BY ALL")
register("rhyme_audit", lambda s, d: W.signed(_words(s, d)).groupBy("lang").agg(F.count("*").alias("words"), F.count("pk").alias("extracted"), F.count_if(F.col("pk").isNull()).alias("missing"), F.countDistinct("pk").alias("keys"), F.count("bk").alias("bridges"), F.countDistinct("bk").alias("bridge_keys")), _signature_sql() + " SELECT lang, count(*) AS words, count(pk) AS extracted, count(*) FILTER (pk IS NULL) AS missing, count(DISTINCT pk) AS keys, count(bk) AS bridges, count(DISTINCT bk) AS bridge_keys FROM s4 GROUP BY lang")
for _p in PROFILES:
    register(f"rhyme_profile_{_p.lower()}", lambda s, d, p=_p: _stream(s, d, p).agg(F.count("*").alias("tokens"), F.countDistinct("pk").alias("keys"), F.countDistinct("bk").alias("bridge_keys")), _signature_sql(_p) + " SELECT count(*) AS tokens, count(DISTINCT pk) AS keys, count(DISTINCT bk) AS bridge_keys FROM st")
for _n, _o in {"rhyme_arrivals": {}, "arrival_full_only": {"match": "full"}, "arrival_bridge_only": {"match": "bridge"}, "arrival_exclude_exact": {"exclude_exact": True}, "arrival_no_extended_left": {"exclude_extended": True}}.items():
    _q = {("no_extended" if k == "exclude_extended" else k): v for k, v in _o.items()}
    register(_n, lambda s, d, o=_o: _arrived(s, d, **o).select("book", "i", "full", "bridge", "same_word", "value"), _arrivals_sql(**_q) + ' SELECT book, i, "full", bridge, same_word, value FROM ar')
register("arrival_threshold2", lambda s, d: A.thresholded(_arrived(s, d), 2).groupBy("book").agg(F.count("*").alias("n"), F.sum("value").alias("total")), _arrivals_sql(least=2) + " SELECT book, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM ar GROUP BY book")
register("arrival_pair_audit", lambda s, d: _arrived(s, d).groupBy("lang").agg(F.count("*").alias("positions"), F.sum("full").alias("full"), F.sum("bridge").alias("bridge"), F.sum("same_word").alias("same_word")), _arrivals_sql() + ' SELECT lang, count(*) AS positions, CAST(sum("full") AS BIGINT) AS "full", CAST(sum(bridge) AS BIGINT) AS bridge, CAST(sum(same_word) AS BIGINT) AS same_word FROM ar GROUP BY lang')
register("arrival_histogram", lambda s, d: _arrived(s, d).groupBy("value").agg(F.count("*").alias("n")), _arrivals_sql() + " SELECT value, count(*) AS n FROM ar GROUP BY value")
register("active_runs", lambda s, d: A.runs(_arrived(s, d)), _arrivals_sql() + RUNS + ' SELECT book, run_id, start, "end", length, intensity FROM rn')
register("temporal_metrics", lambda s, d: A.temporal_metrics(_arrived(s, d)), _arrivals_sql() + RUNS + """, b AS (SELECT book, count(*) AS positions, round(avg(value), 8) AS mean, round(var_pop(value), 8) AS variance, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 8) AS active_rate,
round(CASE WHEN var_pop(value) FILTER (nx IS NOT NULL) * var_pop(nx) > 0 THEN covar_pop(value, nx) / sqrt(var_pop(value) FILTER (nx IS NOT NULL) * var_pop(nx)) ELSE 0 END, 8) AS lag1, count(*) FILTER (value > 0 AND nx > 0) AS adjacent_active FROM (SELECT *, lead(value) OVER (PARTITION BY book ORDER BY i) AS nx FROM ar) GROUP BY book)
SELECT b.*, coalesce(runs, 0) AS runs, coalesce(longest, 0) AS longest, coalesce(mean_length, 0) AS mean_length, coalesce(strongest, 0) AS strongest FROM b LEFT JOIN (SELECT book, count(*) AS runs, max(length) AS longest, round(avg(length), 8) AS mean_length, max(intensity) AS strongest FROM rn GROUP BY book) USING (book)""")
register("fano", lambda s, d: A.fano(_arrived(s, d), 10), _arrivals_sql() + f" SELECT book, count(*) AS windows, round(var_pop(total) / nullif(avg(total), 0), 8) AS fano FROM (SELECT book, (i - {WINDOW}) // 10 AS w, sum(value) AS total, count(*) AS n FROM ar GROUP BY ALL) WHERE n = 10 GROUP BY book")
_BM = ", bk AS (SELECT DISTINCT book FROM ar) " + " UNION ALL ".join(f"SELECT bk.book, '{x}' AS level, coalesce(runs, 0) AS runs, round(coalesce(inside, 0), 8) AS inside, round(coalesce(ends, 0), 8) AS ends, round(coalesce(starts, 0), 8) AS starts FROM bk LEFT JOIN (SELECT r.book, count(*) AS runs, count(*) FILTER (a.{x}_id = z.{x}_id) / count(*) AS inside, count(*) FILTER (z.{x}_id <> z.{x}_after) / count(*) AS ends, count(*) FILTER (a.{x}_id <> a.{x}_before) / count(*) AS starts FROM rn r JOIN ar a ON a.book = r.book AND a.i = r.start JOIN ar z ON z.book = r.book AND z.i = r.\"end\" GROUP BY r.book) m USING (book)" for x in H.LEVELS)
register("boundary_metrics", lambda s, d: A.boundary_metrics(_arrived(s, d)), _arrivals_sql() + RUNS + " " + _BM)
CENSOR = ', bd AS (SELECT book, min(i) AS lo, max(i) AS hi FROM ar GROUP BY book), ce AS (SELECT ar.book, ar.i, CASE WHEN r.run_id IS NOT NULL THEN 0 ELSE ar.value END AS value FROM ar LEFT JOIN (SELECT rn.* FROM rn JOIN bd USING (book) WHERE start = lo OR "end" = hi) r ON r.book = ar.book AND ar.i BETWEEN r.start AND r."end")'
register("edge_censor", lambda s, d: A.edge_censored(_arrived(s, d).select("book", "i", "value")).groupBy("book").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("active")), _arrivals_sql() + RUNS + CENSOR + " SELECT book, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, count(*) FILTER (value > 0) AS active FROM ce GROUP BY book")
register("eligible_shifts", lambda s, d: N.eligible_shifts(_arrived(s, d).select("book", (F.col("i") - WINDOW).alias("pos"), "value")), _arrivals_sql() + f", e AS (SELECT book, i - {WINDOW} AS pos, value > 0 AS act, lag(value > 0) OVER (PARTITION BY book ORDER BY i) AS pa, count(*) OVER (PARTITION BY book) AS n FROM ar), e2 AS (SELECT *, count(*) FILTER (act AND (pos = 0 OR pos = n - 1)) OVER (PARTITION BY book) AS both_ends FROM e) SELECT book, n - pos AS shift FROM e2 WHERE pos > 0 AND NOT (act AND pa) AND both_ends < 2")
register("fixed_blocks", lambda s, d: A.blocks(_arrived(s, d), BLOCK), _arrivals_sql() + f' SELECT book, (i - {WINDOW}) // {BLOCK} + 1 AS block, min(i) AS start, max(i) AS "end", count(*) AS length, CAST(sum(value) AS BIGINT) AS arrivals, count(*) FILTER (value > 0) AS active, count(*) >= {BLOCK // 2} AS included FROM ar GROUP BY book, block')
register("pooled_scopes", lambda s, d: _arrived(s, d).groupingSets([[], ["lang"]], "lang").agg(F.coalesce("lang", F.lit("ALL")).alias("scope"), F.count("*").alias("positions"), F.count_if(F.col("value") > 0).alias("active")).drop("lang"), _arrivals_sql() + " SELECT coalesce(lang, 'ALL') AS scope, count(*) AS positions, count(*) FILTER (value > 0) AS active FROM ar GROUP BY GROUPING SETS ((), (lang))")
register("leave_one_out", lambda s, d: _loo(_arrived(s, d)), _arrivals_sql() + ", t AS (SELECT lang, count(*) AS n, count(*) FILTER (value > 0) AS a FROM ar GROUP BY lang) SELECT lang AS excluded, CAST((SELECT sum(n) FROM t) - n AS BIGINT) AS positions, CAST((SELECT sum(a) FROM t) - a AS BIGINT) AS active, round(((SELECT sum(a) FROM t) - a) / nullif((SELECT sum(n) FROM t) - n, 0), 8) AS rate FROM t")
for _least in (1, 2):
    register(
        "lexical_decomposition" + (f"_t{_least}" if _least > 1 else ""), lambda s, d, k=_least: A.lexical_kinds(_arrived(s, d, others=True), k),
        _arrivals_sql().replace("ar AS (", "a3 AS (SELECT *, len(list_filter(h, lambda x: x.exact <> exact AND (x.pk = pk OR coalesce(x.pk = bk, false) OR coalesce(x.bk = pk, false)))) AS other FROM a2), ar AS (") + f""", lc AS (SELECT full_n + bridge_n AS value, other, full_n + bridge_n - other AS same FROM a3)
SELECT CASE WHEN value < {_least} THEN 'inactive' WHEN same >= {_least} AND other >= {_least} THEN 'mixed' WHEN same >= {_least} THEN 'exact_only' WHEN other >= {_least} THEN 'different_word_only' ELSE 'combined_only_at_threshold' END AS kind,
count(*) AS positions, CAST(sum(value) AS BIGINT) AS links, CAST(sum(same) AS BIGINT) AS exact_links, CAST(sum(other) AS BIGINT) AS different_links FROM lc GROUP BY 1""",
    )
register("segment_inventory", lambda s, d: R.inventory(_arrived(s, d), "minor").groupBy("reason").agg(F.count("*").alias("segments"), F.sum("length").alias("positions")), _arrivals_sql() + ", g AS (SELECT a.book, a.minor_id, length, p.minor_before AS before, n.minor_after AS after FROM (SELECT book, minor_id, count(*) AS length, min(i) AS f, max(i) AS l FROM ar GROUP BY ALL) a JOIN ar p ON p.book = a.book AND p.i = a.f JOIN ar n ON n.book = a.book AND n.i = a.l) SELECT reason, count(*) AS segments, CAST(sum(length) AS BIGINT) AS positions FROM (SELECT *, CASE WHEN before = minor_id THEN 'truncated_by_left_window_edge' WHEN after = minor_id THEN 'truncated_by_corpus_edge' WHEN length < 3 THEN 'below_minimum_length' WHEN length > 40 THEN 'above_maximum_length' ELSE 'eligible' END AS reason FROM g) GROUP BY reason")
PROF = _arrivals_sql() + ", g AS (SELECT a.book, a.major_id, length, p.major_before AS before, n.major_after AS after FROM (SELECT book, major_id, count(*) AS length, min(i) AS f, max(i) AS l FROM ar GROUP BY ALL) a JOIN ar p ON p.book = a.book AND p.i = a.f JOIN ar n ON n.book = a.book AND n.i = a.l), g2 AS (SELECT * FROM (SELECT *, CASE WHEN before = major_id THEN 'truncated_by_left_window_edge' WHEN after = major_id THEN 'truncated_by_corpus_edge' WHEN length < 3 THEN 'below_minimum_length' WHEN length > 40 THEN 'above_maximum_length' ELSE 'eligible' END AS reason FROM g) WHERE reason = 'eligible'), ps0 AS (SELECT ar.book, ar.major_id AS segment, ar.i, ar.value, length, row_number() OVER (PARTITION BY ar.book, ar.major_id ORDER BY ar.i) - 1 AS rk, sum(ar.value) OVER (PARTITION BY ar.book, ar.major_id) AS tot FROM ar JOIN g2 ON g2.book = ar.book AND g2.major_id = ar.major_id)"


def _prof_sql(place: str, value: str, pooled: bool) -> str:
    ps = PROF + f", ps AS (SELECT * FROM (SELECT *, {place} AS bin, {value} AS v FROM ps0) WHERE bin >= 0)"
    if pooled:
        return ps + " SELECT bin, count(*) AS n, round(avg(v), 8) AS mean, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 8) AS active_rate FROM ps GROUP BY bin"
    return ps + " SELECT bin, count(v) AS n, round(avg(v), 8) AS mean, round(avg(a), 8) AS active_rate FROM (SELECT book, segment, bin, avg(v) AS v, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS a FROM ps GROUP BY ALL) GROUP BY bin"


_NORM, _DIST = "CAST(least(4, floor((rk + 0.5) / length * 5)) AS BIGINT)", "CAST(4 - (length - 1 - rk) AS BIGINT)"
register("profile_normalized", lambda s, d: R.profile(R.positions(_arrived(s, d), "major", 5)), _prof_sql(_NORM, "CAST(value AS DOUBLE)", False))
register("profile_distance", lambda s, d: R.profile(R.positions(_arrived(s, d), "major", 5, "distance")), _prof_sql(_DIST, "CAST(value AS DOUBLE)", False))
register("profile_share", lambda s, d: R.profile(R.positions(_arrived(s, d), "major", 5, share=True)), _prof_sql(_NORM, "value / nullif(tot, 0)", False))
register("profile_token", lambda s, d: R.profile(R.positions(_arrived(s, d), "major", 5), True), _prof_sql(_NORM, "CAST(value AS DOUBLE)", True))
register("profile_metrics", lambda s, d: R.metrics(R.profile(R.positions(_arrived(s, d), "major", 5))), f"WITH pf AS ({_prof_sql(_NORM, 'CAST(value AS DOUBLE)', False)}) SELECT n AS bins, round(last - first, 6) AS terminal_contrast, round(slope, 6) AS linear_slope, round(last - (total - last) / (n - 1), 6) AS cadence_peak, round(CASE WHEN abs(mid) > 1e-15 THEN var / (mid * mid) ELSE var END, 6) AS profile_energy, round(high - low, 6) AS profile_amplitude FROM (SELECT count(*) AS n, arg_max(mean, bin) AS last, arg_min(mean, bin) AS first, sum(mean) AS total, avg(mean) AS mid, var_pop(mean) AS var, max(mean) AS high, min(mean) AS low, regr_slope(mean, (rk - 0.5) / m) AS slope FROM (SELECT *, row_number() OVER (ORDER BY bin) AS rk, count(*) OVER () AS m FROM pf WHERE mean IS NOT NULL))")
GROUPS = _signature_sql() + ", mem AS (SELECT 'primary' AS role, pk AS key, exact AS word, count(*) AS n FROM st GROUP BY ALL UNION ALL SELECT 'bridge', bk, exact, count(*) FROM st WHERE bk IS NOT NULL GROUP BY ALL)"
register("rhyme_full_groups", lambda s, d: _groups(_stream(s, d)).where("role = 'primary'").groupBy("key").agg(F.countDistinct("word").alias("words"), F.sum("n").alias("tokens")).where("words >= 2"), GROUPS + " SELECT key, count(DISTINCT word) AS words, CAST(sum(n) AS BIGINT) AS tokens FROM mem WHERE role = 'primary' GROUP BY key HAVING count(DISTINCT word) >= 2")
register("rhyme_bridge_groups", lambda s, d: _bridges(_groups(_stream(s, d))), GROUPS + ", o AS (SELECT key, list_sort(list(DISTINCT word)) AS l FROM mem WHERE role = 'primary' GROUP BY key), c AS (SELECT key, list_sort(list(DISTINCT word)) AS l FROM mem WHERE role = 'bridge' GROUP BY key) SELECT key, len(o.l) AS open_words, len(c.l) AS closed_words, len(list_distinct(list_concat(o.l, c.l))) AS words FROM o JOIN c USING (key) WHERE NOT (len(o.l) = 1 AND o.l = c.l) AND len(list_distinct(list_concat(o.l, c.l))) >= 2")
register("rhyme_group_members", lambda s, d: _groups(_stream(s, d)), GROUPS + " SELECT role, key, word, n FROM mem")


def _loo(rows):
    """Pooled rate without each language in turn: sums of all less its own, over one small aggregate."""
    own = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("a"))
    every = own.agg(F.sum("n").alias("all_n"), F.sum("a").alias("all_a"))
    return own.join(F.broadcast(every)).select(F.col("lang").alias("excluded"), (F.col("all_n") - F.col("n")).alias("positions"), (F.col("all_a") - F.col("a")).alias("active"), S.rounded(S.ratio(F.col("all_a") - F.col("a"), F.col("all_n") - F.col("n"))).alias("rate"))


def _groups(stream):
    """(role, key, word, n): which words hold a key, as their own or as a bridge."""
    roles = F.array(F.struct(F.lit("primary").alias("role"), F.col("pk").alias("key")), F.struct(F.lit("bridge").alias("role"), F.col("bk").alias("key")))
    return stream.select(F.col("exact").alias("word"), F.explode(roles).alias("r")).where("r.key is not null").groupBy("r.role", "r.key", "word").agg(F.count("*").alias("n"))


def _bridges(members):
    """Keys that some words end in openly and others closed, unless both sides are one and the same word."""
    has = lambda role: F.max((F.col("role") == role).cast("long")).alias(role)
    words = members.groupBy("key", "word").agg(has("primary"), has("bridge")).groupBy("key").agg(F.sum("primary").alias("open_words"), F.sum("bridge").alias("closed_words"), F.count("*").alias("words"))
    # one and the same word on both sides is one word in all
    return words.where("open_words > 0 and closed_words > 0 and words >= 2")


_PM = f"(SELECT unnest(range({PERMS})) AS perm_id)"
_CL = "SELECT {k}metric, value FROM (SELECT {g} count(*) FILTER (value > 0 AND nx > 0) AS adjacent_active, count(*) FILTER (value > 0 AND NOT coalesce(pv > 0, false)) AS runs FROM (SELECT *, lead(value) OVER w AS nx, lag(value) OVER w AS pv FROM {t} WINDOW w AS (PARTITION BY {k}book ORDER BY i)) {by}) UNPIVOT (value FOR metric IN (adjacent_active, runs))"
register(
    "clustering_null", lambda s, d: X.clustering_null(_arrived(s, d), PERMS),
    _arrivals_sql() + f""", rk AS (SELECT perm_id, book, i, value, row_number() OVER (PARTITION BY perm_id, book ORDER BY i) AS place, row_number() OVER (PARTITION BY perm_id, book ORDER BY md5(concat_ws('|', '1', perm_id, book, i)), i) AS drawn FROM ar, {_PM}),
dv AS (SELECT s.perm_id, s.book, s.i, v.value FROM rk s JOIN rk v ON s.perm_id = v.perm_id AND s.book = v.book AND s.place = v.drawn),
seen AS (SELECT metric, value AS observed FROM ({_CL.format(k='', g='', t='ar', by='')})), nulls AS ({_CL.format(k='perm_id, ', g='perm_id,', t='dv', by='GROUP BY perm_id')}) """ + summary_sql("metric", sd="stddev_pop"),
)
register(
    "profile_within_null", lambda s, d: X.within_segment_null(R.positions(_arrived(s, d), "major", 5), 5, PERMS),
    PROF + f""", ps AS (SELECT book, segment, i, {_NORM} AS bin, CAST(value AS DOUBLE) AS v FROM ps0), rk AS (SELECT perm_id, ps.*, row_number() OVER (PARTITION BY perm_id, book, segment ORDER BY i) AS place, row_number() OVER (PARTITION BY perm_id, book, segment ORDER BY md5(concat_ws('|', '1', perm_id, book, segment, i)), i) AS drawn FROM ps, {_PM}),
dv AS (SELECT s.perm_id, s.bin, x.v FROM rk s JOIN rk x ON s.perm_id = x.perm_id AND s.book = x.book AND s.segment = x.segment AND s.place = x.drawn),
seen AS (SELECT 'terminal_contrast' AS metric, avg(v) FILTER (bin = 4) - avg(v) FILTER (bin = 0) AS observed FROM ps), nulls AS (SELECT perm_id, 'terminal_contrast' AS metric, avg(v) FILTER (bin = 4) - avg(v) FILTER (bin = 0) AS value FROM dv GROUP BY perm_id) """ + summary_sql("metric", sd="stddev_pop"),
)
register(
    "verse_allocation_null", lambda s, d: X.allocation_null(_arrived(s, d), "verse", PERMS),
    _arrivals_sql() + f""", sz AS (SELECT book, count(DISTINCT verse_id) AS segments, count(*) FILTER (value > 0) AS active FROM ar GROUP BY book),
seen AS (SELECT book, count(DISTINCT verse_id) FILTER (value > 0) / count(DISTINCT verse_id) AS observed FROM ar GROUP BY book),
rk AS (SELECT perm_id, ar.book, verse_id, segments, active, row_number() OVER (PARTITION BY perm_id, ar.book ORDER BY md5(concat_ws('|', '1', perm_id, ar.book, i)), i) AS rk FROM ar JOIN sz USING (book), {_PM}),
nulls AS (SELECT perm_id, book, count(DISTINCT verse_id) FILTER (rk <= active) / max(segments) AS value FROM rk GROUP BY perm_id, book) """ + summary_sql("book"),
)
