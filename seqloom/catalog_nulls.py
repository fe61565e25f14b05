"""Queries that test a book's intervals, transitions and sound patterns against its own symbols dealt anew, and burst coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog_words as Q
from .catalog import register
from .catalog_events import EV, PERM, P, on_events, summary_sql
from .functions import stats as S
from .operators import arrivals as A
from .operators import grammar as G
from .operators import hierarchy as H
from .operators import intervals as I

PERMS = Q.PERMS
_DRAWS = f"(SELECT unnest(range({PERMS})) AS perm_id)"

for _k in (2, 3):
    _lead = ", ".join(f"lead(interval, {j}) OVER w AS g{j}" for j in range(_k))
    register(
        f"interval_ngrams_{_k}", lambda s, d, k=_k: I.ngrams(I.intervals(Q._pulses(s, d)), k, 20),
        Q.IV + f""", gr AS (SELECT book, model, relation, i, concat_ws('-', {', '.join(f'g{j}' for j in range(_k))}) AS pattern FROM (SELECT book, model, relation, i, {_lead} FROM iv WINDOW w AS (PARTITION BY book, model, relation ORDER BY i)) WHERE g{_k - 1} IS NOT NULL),
ct AS (SELECT book, model, relation, pattern, count(*) AS n, min(i) AS first FROM gr GROUP BY ALL)
SELECT book, model, relation, pattern, n, rank, share FROM (SELECT *, row_number() OVER (PARTITION BY book, model, relation ORDER BY n DESC, first) AS rank, round(n / sum(n) OVER (PARTITION BY book, model, relation), 8) AS share FROM ct) WHERE rank <= 20""",
    )

_INTERVAL_DRAWS = f"(SELECT unnest(range({Q.INTERVAL_PERMS})) AS perm_id)"
_V = ", v AS (SELECT * FROM iv WHERE model <> 'continuous')"
_SHUFFLE = f""", pr AS (SELECT perm_id, v.*, row_number() OVER (PARTITION BY perm_id, book, model ORDER BY i) AS place, row_number() OVER (PARTITION BY perm_id, book, model ORDER BY md5(concat_ws('|', '1', perm_id, book, model, i)), i) AS drawn FROM v, {_INTERVAL_DRAWS}),
dl AS (SELECT s.perm_id, s.book, s.model, s.relation, x.interval FROM pr s JOIN pr x ON s.perm_id = x.perm_id AND s.book = x.book AND s.model = x.model AND s.place = x.drawn)"""
_CYCLIC = f""", nm AS (SELECT *, row_number() OVER (PARTITION BY book, model ORDER BY i) - 1 AS slot, count(*) OVER (PARTITION BY book, model) AS m FROM v),
pr AS (SELECT perm_id, nm.*, CASE WHEN m > 1 THEN 1 + CAST(concat('0x', substr(md5(concat_ws('|', '1', perm_id, book, model)), 1, 8)) AS BIGINT) % (m - 1) ELSE 0 END AS turn FROM nm, {_INTERVAL_DRAWS}),
dl AS (SELECT s.perm_id, s.book, s.model, s.relation, x.interval FROM pr s JOIN pr x ON s.perm_id = x.perm_id AND s.book = x.book AND s.model = x.model AND s.slot = (x.slot + x.turn) % x.m)"""
for _kind, _sql in (("shuffle", _SHUFFLE), ("cyclic", _CYCLIC)):
    register(
        f"interval_null_{_kind}", lambda s, d, k=_kind: I.interval_null(I.intervals(Q._pulses(s, d)).where("model <> 'continuous'"), Q.INTERVAL_PERMS, kind=k),
        Q.IV + _V + _sql + f""", seen AS (SELECT book, model, relation, metric, value AS observed FROM ({Q._both('book, model, relation', 'v')})), nulls AS ({Q._both('perm_id, book, model, relation', 'dl')}) """ + summary_sql("book model relation metric"),
    )

register(
    "transition_z", on_events(lambda s: G.top_transition_null(s, 20, P)),
    EV + PERM + """, seen AS (SELECT book, a, b, observed FROM (SELECT book, a, b, n AS observed, row_number() OVER (PARTITION BY book ORDER BY n DESC, first_pos) AS rk FROM tc) WHERE rk <= 20), drawn AS (SELECT perm_id, book, a, b, count(*) AS value FROM pbg GROUP BY ALL),
nulls AS (SELECT s.book, s.a, s.b, p.perm_id, coalesce(d.value, 0) AS value FROM seen s CROSS JOIN perms p LEFT JOIN drawn d ON d.perm_id = p.perm_id AND d.book = s.book AND d.a = s.a AND d.b = s.b) """ + summary_sql("book a b"),
)

_ENRICH = f""", rk AS (SELECT perm_id, book, i, pk, bk, exact, extended, row_number() OVER (PARTITION BY perm_id, book ORDER BY i) AS place, row_number() OVER (PARTITION BY perm_id, book ORDER BY md5(concat_ws('|', '1', perm_id, book, i)), i) AS drawn FROM st, {_DRAWS}),
dv AS (SELECT s.perm_id, s.book, s.i, x.pk, x.bk FROM rk s JOIN rk x ON s.perm_id = x.perm_id AND s.book = x.book AND s.place = x.drawn),
d1 AS (SELECT *, list({{'pk': pk, 'bk': bk}}) OVER (PARTITION BY perm_id, book ORDER BY i ROWS BETWEEN {Q.WINDOW} PRECEDING AND 1 PRECEDING) AS h FROM dv),
d2 AS (SELECT perm_id, book, len(list_filter(h, lambda x: x.pk = pk OR coalesce(x.pk = bk, false) OR coalesce(x.bk = pk, false))) AS value FROM d1 WHERE i >= {Q.WINDOW})"""
_MEANS = "SELECT {k}, unnest([{{'metric': 'mean_arrivals', 'x': avg(value)}}, {{'metric': 'active_rate', 'x': avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END)}}]) AS u FROM {t} GROUP BY {k}"
register(
    "rhyme_enrichment_null", lambda s, d: A.enrichment_null(Q._stream(s, d), Q.WINDOW, PERMS),
    Q._arrivals_sql() + _ENRICH + f""", seen AS (SELECT book, u.metric AS metric, u.x AS observed FROM ({_MEANS.format(k='book', t='ar')})), nulls AS (SELECT perm_id, book, u.metric AS metric, u.x AS value FROM ({_MEANS.format(k='perm_id, book', t='d2')})) """ + summary_sql("book metric", sd="stddev_pop"),
)

register(
    "book_coverage", lambda s, d: A.coverage(Q._arrived(s, d), "verse"),
    Q._arrivals_sql() + Q.RUNS + """, vs AS (SELECT book, count(DISTINCT verse_id) AS verses, count(DISTINCT verse_id) FILTER (value > 0) AS active_verses, count(*) AS positions, count(*) FILTER (value > 0) AS active FROM ar GROUP BY book)
SELECT vs.book, positions, active, round(active / positions, 8) AS active_rate, coalesce(ends, 0) AS burst_ends, verses, active_verses, round(active_verses / verses, 8) AS verse_coverage FROM vs LEFT JOIN (SELECT book, count(*) AS ends FROM rn GROUP BY book) e USING (book)""",
)
register(
    "block_alignment", lambda s, d: A.block_alignment(Q._arrived(s, d), Q.BLOCK),
    Q._arrivals_sql() + Q.RUNS + f""", e AS (SELECT r.book, (r."end" - {Q.WINDOW}) // {Q.BLOCK} + 1 AS block, {', '.join(f'coalesce(z.{x}_id <> z.{x}_after, false) AS {x}' for x in H.LEVELS)} FROM rn r JOIN ar z ON z.book = r.book AND z.i = r."end"),
bl AS (SELECT DISTINCT book, (i - {Q.WINDOW}) // {Q.BLOCK} + 1 AS block FROM ar)
SELECT bl.book, bl.block, coalesce(ends, 0) AS burst_ends, {', '.join(f'round(coalesce({x}, 0), 8) AS {x}_rate' for x in H.LEVELS)} FROM bl LEFT JOIN (SELECT book, block, count(*) AS ends, {', '.join(f'count(*) FILTER ({x}) / count(*) AS {x}' for x in H.LEVELS)} FROM e GROUP BY book, block) USING (book, block)""",
)
register(
    "block_left_out", lambda s, d: A.block_left_out(A.block_alignment(Q._arrived(s, d), Q.BLOCK)),
    Q._arrivals_sql() + Q.RUNS + f""", e AS (SELECT r.book, (r."end" - {Q.WINDOW}) // {Q.BLOCK} + 1 AS block, {', '.join(f'coalesce(z.{x}_id <> z.{x}_after, false) AS {x}' for x in H.LEVELS)} FROM rn r JOIN ar z ON z.book = r.book AND z.i = r."end"),
bl AS (SELECT DISTINCT book, (i - {Q.WINDOW}) // {Q.BLOCK} + 1 AS block FROM ar),
t AS (SELECT book, block, count(e.minor) AS ends, {', '.join(f'count(*) FILTER (coalesce(e.{x}, false)) AS {x}' for x in H.LEVELS)} FROM bl LEFT JOIN e USING (book, block) GROUP BY book, block)
SELECT book, block, CAST(sum(ends) OVER w - ends AS BIGINT) AS burst_ends, {', '.join(f'round(coalesce((sum({x}) OVER w - {x}) / nullif(sum(ends) OVER w - ends, 0), 0), 8) AS {x}_rate' for x in H.LEVELS)} FROM t WINDOW w AS (PARTITION BY book)""",
)
