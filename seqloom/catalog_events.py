"""Queries on the events table as symbol streams, one book per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import register
from .config import EVENT_BOUNDARIES
from .functions import stats as S
from .operators import grammar as G
from .operators import markov as M
from .operators import reconstruct as B
from .plans import nulls as N
from .sources.tables import mark_events

CORE, CADENCE = ("purchase", "signup", "click"), ("purchase", "signup")
#: Permutations of the registered nulls; the operators take any number.
P = 20

EV = """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS book, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS sym FROM events),
bg AS (SELECT * FROM (SELECT book, pos, sym AS a, lead(sym) OVER (PARTITION BY book ORDER BY pos) AS b FROM ev) WHERE b IS NOT NULL),
tc AS (SELECT book, a, b, count(*) AS n, min(pos) AS first_pos FROM bg GROUP BY ALL)"""
PERM = f""", perms AS (SELECT unnest(range({P})) AS perm_id),
ranked AS (SELECT perm_id, book, pos, sym, row_number() OVER (PARTITION BY perm_id, book ORDER BY pos) AS place,
  row_number() OVER (PARTITION BY perm_id, book ORDER BY md5(concat_ws('|', '1', perm_id, book, pos)), pos) AS drawn FROM ev, perms),
pev AS (SELECT s.perm_id, s.book, s.pos, v.sym FROM ranked s JOIN ranked v ON s.perm_id = v.perm_id AND s.book = v.book AND s.place = v.drawn),
pbg AS (SELECT * FROM (SELECT perm_id, book, pos, sym AS a, lead(sym) OVER (PARTITION BY perm_id, book ORDER BY pos) AS b FROM pev) WHERE b IS NOT NULL)"""


def summary_sql(keys: str, counts: bool = False, null: str = "nulls", seen: str = "seen", sd: str = "stddev_samp", z: str = "NULL") -> str:
    """SELECT over (keys, perm_id, value) and (keys, observed), as functions.stats.null_summary."""
    gate = "null_sd >= 0.5 AND unique_values >= 3" if counts else "null_sd > 1e-12"
    ks = ", ".join(keys.split())
    return f"""SELECT {ks}, round(CAST(observed AS DOUBLE), 8) + 0.0 AS observed, permutations, round(null_mean, 8) + 0.0 AS null_mean, round(null_sd, 6) AS null_sd,
  round(CASE WHEN {gate} THEN (observed - null_mean) / null_sd ELSE {z} END, 6) + 0.0 AS z, round((at_least + 1.0) / (permutations + 1), 8) AS p_upper, round((at_most + 1.0) / (permutations + 1), 8) AS p_lower,
  round(least(1.0, 2 * least((at_least + 1.0) / (permutations + 1), (at_most + 1.0) / (permutations + 1))), 8) AS p_two_sided,
  round((as_far + 1.0) / (permutations + 1), 8) AS p_distance
  FROM (SELECT {ks}, first(observed) AS observed, count(*) AS permutations, avg(CAST(value AS DOUBLE)) AS null_mean, coalesce({sd}(CAST(value AS DOUBLE)), 0) AS null_sd, count(DISTINCT round(value, 9)) AS unique_values,
    count(*) FILTER (value >= observed - 1e-12) AS at_least, count(*) FILTER (value <= observed + 1e-12) AS at_most,
    count(*) FILTER (abs(value - mid) >= abs(observed - mid) - 1e-9) AS as_far FROM (SELECT *, avg(CAST(value AS DOUBLE)) OVER (PARTITION BY {ks}) AS mid FROM {null}) JOIN {seen} USING ({ks}) GROUP BY {ks})"""


def _in(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def on_events(f):
    return lambda spark, d: f(mark_events(spark, d))


def _gram_sql(k: int, source: str = "ev", keys: str = "book") -> str:
    parts = ", ".join(f"lead(sym, {i}) OVER w AS g{i}" for i in range(k))
    return f"SELECT {keys}, pos, concat_ws(' ', {', '.join(f'g{i}' for i in range(k))}) AS gram FROM (SELECT {keys}, pos, {parts} FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY pos)) WHERE g{k - 1} IS NOT NULL"


EDGES_SQL = """SELECT t.book, t.a, t.b, t.n, round(t.n / na, 8) AS p_next, round(t.n / nb, 8) AS share_of_b, coalesce(r.n, 0) AS reverse_n, t.n - coalesce(r.n, 0) AS asymmetry,
round(t.n / nullif(coalesce(r.n, 0), 0), 8) AS asymmetry_ratio, round(CAST(na * nb AS DOUBLE) / total, 8) AS expected, round(t.n / (CAST(na * nb AS DOUBLE) / total), 8) AS lift
FROM (SELECT *, sum(n) OVER (PARTITION BY book, a) AS na, sum(n) OVER (PARTITION BY book, b) AS nb, sum(n) OVER (PARTITION BY book) AS total FROM {c}) t LEFT JOIN {c} r ON r.book = t.book AND r.a = t.b AND r.b = t.a"""

register("mark_event_stream", on_events(lambda s: s), EV + " SELECT book, pos, sym FROM ev")
register("transition_counts", on_events(lambda s: G.transition_counts(s)), EV + " SELECT book, a, b, n, first_pos FROM tc")
register("transition_edges_lift", on_events(lambda s: G.edges(G.transition_counts(s))), EV + " " + EDGES_SQL.format(c="tc"))
register("transition_edges_kept", on_events(lambda s: G.edges(G.transition_counts(s), 3, 0.4)), EV + f" SELECT * FROM ({EDGES_SQL.format(c='tc')}) WHERE n >= 3 OR p_next >= 0.4")
register(
    "transition_nodes", on_events(G.nodes),
    EV + """, own AS (SELECT book, sym, count(*) AS n FROM ev GROUP BY ALL),
succ AS (SELECT book, a AS sym, count(*) AS successors, sum(-p * log2(p)) AS e FROM (SELECT *, n / sum(n) OVER (PARTITION BY book, a) AS p FROM tc) GROUP BY ALL),
pred AS (SELECT book, b AS sym, count(*) AS predecessors, sum(-p * log2(p)) AS e FROM (SELECT *, n / sum(n) OVER (PARTITION BY book, b) AS p FROM tc) GROUP BY ALL),
top AS (SELECT book, a AS sym, b AS top_next, round(n / out, 8) AS top_p FROM (SELECT *, row_number() OVER (PARTITION BY book, a ORDER BY n DESC, first_pos) AS rk, sum(n) OVER (PARTITION BY book, a) AS out FROM tc) WHERE rk = 1)
SELECT book, sym, own.n, round(own.n / sum(own.n) OVER (PARTITION BY book), 8) AS share, coalesce(successors, 0) AS successors, coalesce(predecessors, 0) AS predecessors,
coalesce(round(succ.e, 8), 0) AS successor_entropy, coalesce(round(pred.e, 8), 0) AS predecessor_entropy, top_next, top_p FROM own LEFT JOIN succ USING (book, sym) LEFT JOIN pred USING (book, sym) LEFT JOIN top USING (book, sym)""",
)
for _name, _side in (("top_successors", "a"), ("top_predecessors", "b")):
    register(_name, on_events(lambda s, x=_side: G.top_neighbours(G.transition_counts(s), x, 3)), EV + f" SELECT book, a, b, n, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY book, {_side} ORDER BY n DESC, first_pos) AS rk FROM tc) WHERE rk <= 3")
register("cadence_funnels", on_events(lambda s: G.funnels(G.transition_counts(s), CADENCE, 2)), EV + f" SELECT book, a, b, n, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY book, b ORDER BY n DESC, first_pos) AS rk FROM tc WHERE b IN {_in(CADENCE)}) WHERE n >= 2")
register(
    "ngram_entropy", on_events(lambda s: G.ngram_entropy(s, (2, 3, 4, 5, 6))),
    EV + " " + " UNION ALL ".join(f"SELECT book, {k} AS k, count(*) AS kinds, round(sum(-p * log2(p)), 8) AS entropy, round(CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 0 END, 8) AS normalized_entropy FROM (SELECT book, gram, count(*) / sum(count(*)) OVER (PARTITION BY book) AS p FROM ({_gram_sql(k)}) GROUP BY book, gram) GROUP BY book" for k in (2, 3, 4, 5, 6)),
)
register("ngram_topk", on_events(lambda s: G.ngram_top(s, 3, 5)), EV + f" SELECT * FROM (SELECT book, gram, n, row_number() OVER (PARTITION BY book ORDER BY n DESC, first_pos) AS rank FROM (SELECT book, gram, count(*) AS n, min(pos) AS first_pos FROM ({_gram_sql(3)}) GROUP BY ALL)) WHERE rank <= 5")
register(
    "core_projected_edges", on_events(lambda s: G.edges(G.transition_counts(G.projected(s, CORE)))),
    EV + f""", pj AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY pos) - 1 AS pos, sym FROM ev WHERE sym IN {_in(CORE)}),
pt AS (SELECT book, a, b, count(*) AS n FROM (SELECT book, sym AS a, lead(sym) OVER (PARTITION BY book ORDER BY pos) AS b FROM pj) WHERE b IS NOT NULL GROUP BY ALL) """ + EDGES_SQL.format(c="pt"),
)
register("core_adjacent_edges", on_events(lambda s: G.adjacent_core(s, CORE)), EV + f" SELECT book, a, b, n, first_pos FROM tc WHERE a IN {_in(CORE)} AND b IN {_in(CORE)}")
register("core_coverage", on_events(lambda s: G.core_coverage(s, CORE)), EV + f" SELECT book, count(*) AS n, count(*) FILTER (sym IN {_in(CORE)}) AS core_n, round(count(*) FILTER (sym IN {_in(CORE)}) / count(*), 8) AS coverage FROM ev GROUP BY book")
register(
    "most_predictable_nodes", on_events(lambda s: G.nodes(s).where("n >= 5").orderBy("successor_entropy", F.desc("n"), "book", "sym").limit(20).select("book", "sym", "n", "successor_entropy")),
    EV + """, own AS (SELECT book, sym, count(*) AS n FROM ev GROUP BY ALL), succ AS (SELECT book, a AS sym, round(sum(-p * log2(p)), 8) AS e FROM (SELECT *, n / sum(n) OVER (PARTITION BY book, a) AS p FROM tc) GROUP BY ALL)
SELECT book, sym, n, coalesce(e, 0) AS successor_entropy FROM own LEFT JOIN succ USING (book, sym) WHERE n >= 5 ORDER BY successor_entropy, n DESC, book, sym LIMIT 20""")
register(
    "transition_permutation", on_events(lambda s: G.transition_null(s, 3, P)),
    EV + PERM + f""", seen AS (SELECT book, a, b, n AS observed FROM tc WHERE n >= 3), drawn AS (SELECT perm_id, book, a, b, count(*) AS value FROM pbg GROUP BY ALL),
nulls AS (SELECT s.book, s.a, s.b, p.perm_id, coalesce(d.value, 0) AS value FROM seen s CROSS JOIN perms p LEFT JOIN drawn d ON d.perm_id = p.perm_id AND d.book = s.book AND d.a = s.a AND d.b = s.b) """ + summary_sql("book a b", True),
)
register(
    "ngram_entropy_permutation", on_events(lambda s: G.entropy_null(s, 2, P)),
    EV + PERM + f""", seen AS (SELECT book, sum(-p * log2(p)) AS observed FROM (SELECT book, count(*) / sum(count(*)) OVER (PARTITION BY book) AS p FROM ({_gram_sql(2)}) GROUP BY book, gram) GROUP BY book),
nulls AS (SELECT perm_id, book, sum(-p * log2(p)) AS value FROM (SELECT perm_id, book, count(*) / sum(count(*)) OVER (PARTITION BY perm_id, book) AS p FROM ({_gram_sql(2, 'pev', 'perm_id, book')}) GROUP BY perm_id, book, gram) GROUP BY ALL) """ + summary_sql("book"),
)
register(
    "formula_permutation", on_events(lambda s: G.formula_null(s, 3, 2, 20, P, 10)),
    EV + PERM + f""", fc AS (SELECT book, gram, count(*) AS observed FROM ({_gram_sql(3)}) GROUP BY ALL HAVING count(*) >= 2), seen AS (SELECT book, gram, observed FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY observed DESC, gram) AS rk FROM fc) WHERE rk <= 20),
drawn AS (SELECT perm_id, book, gram, count(*) AS value FROM ({_gram_sql(3, 'pev', 'perm_id, book')}) GROUP BY ALL),
nulls AS (SELECT s.book, s.gram, p.perm_id, coalesce(d.value, 0) AS value FROM seen s CROSS JOIN perms p LEFT JOIN drawn d ON d.perm_id = p.perm_id AND d.book = s.book AND d.gram = s.gram),
summ AS ({summary_sql("book gram", True)})
SELECT * FROM (SELECT *, round(observed / nullif(null_mean, 0), 6) AS enrichment, row_number() OVER (PARTITION BY book ORDER BY p_upper, CASE WHEN z IS NULL THEN 1 ELSE 0 END, coalesce(z, 0) DESC, observed DESC, gram) AS rank FROM summ) WHERE rank <= 10""",
)

CE = "SELECT {k}, sum(-n / total * log2(n / na)) AS value FROM (SELECT *, sum(n) OVER (PARTITION BY {k}, a) AS na, sum(n) OVER (PARTITION BY {k}) AS total FROM (SELECT {k}, a, b, count(*) AS n FROM {t} GROUP BY ALL)) GROUP BY ALL"
ACC = "SELECT {k}, sum(best) / sum(n) AS value FROM (SELECT {k}, a, max(n) AS best, sum(n) AS n FROM (SELECT {k}, a, b, count(*) AS n FROM {t} GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"
register("conditional_entropy", on_events(lambda s: M.conditional_entropy(G.bigrams(s), ["book"]).select("book", S.rounded("value").alias("value"))), EV + f" SELECT book, round(value, 8) AS value FROM ({CE.format(k='book', t='bg')})")
register("markov_accuracy", on_events(lambda s: M.accuracy(G.bigrams(s), ["book"]).select("book", S.rounded("value").alias("value"))), EV + f" SELECT book, round(value, 8) AS value FROM ({ACC.format(k='book', t='bg')})")
for _name, _kind, _order in (("markov_cv_chrono", "chronological", "pos"), ("markov_cv_random", "random", "md5(concat_ws('|', '1', book, pos)), pos")):
    register(
        _name, on_events(lambda s, k=_kind: M.split_accuracy(s, 0.8, k)),
        EV + f""", sp AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY {_order}) AS place, count(*) OVER (PARTITION BY book) AS m FROM bg), tr AS (SELECT * FROM sp WHERE place <= greatest(1, floor(m * 0.8))),
model AS (SELECT book, a, b AS guess FROM (SELECT book, a, b, row_number() OVER (PARTITION BY book, a ORDER BY count(*) DESC, min(place)) AS rk FROM tr GROUP BY book, a, b) WHERE rk = 1),
com AS (SELECT book, b AS dflt FROM (SELECT book, b, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, min(place)) AS rk FROM tr GROUP BY book, b) WHERE rk = 1)
SELECT book, count(*) AS tested, count(*) FILTER (coalesce(guess, dflt) = b) AS hits, round(avg(CASE WHEN coalesce(guess, dflt) = b THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM sp LEFT JOIN model USING (book, a) LEFT JOIN com USING (book) WHERE place > greatest(1, floor(m * 0.8)) OR m = 1 GROUP BY book""",
    )
register(
    "transition_perm_test", on_events(lambda s: M.transition_test(s, P)),
    EV + PERM + f""", own AS (SELECT book, sum(-p * log2(p)) AS own FROM (SELECT book, sym, count(*) / sum(count(*)) OVER (PARTITION BY book) AS p FROM ev GROUP BY book, sym) GROUP BY book),
seen AS (SELECT book, 'conditional_entropy' AS metric, value AS observed FROM ({CE.format(k='book', t='bg')}) UNION ALL SELECT book, 'entropy_reduction', own - value FROM ({CE.format(k='book', t='bg')}) JOIN own USING (book) UNION ALL SELECT book, 'accuracy', value FROM ({ACC.format(k='book', t='bg')})),
nulls AS (SELECT perm_id, book, 'conditional_entropy' AS metric, value FROM ({CE.format(k='perm_id, book', t='pbg')}) UNION ALL SELECT perm_id, book, 'entropy_reduction', own - value FROM ({CE.format(k='perm_id, book', t='pbg')}) JOIN own USING (book) UNION ALL SELECT perm_id, book, 'accuracy', value FROM ({ACC.format(k='perm_id, book', t='pbg')})) """ + summary_sql("book metric"),
)
register("cyclic_null_streams", on_events(lambda s: N.cyclic(s, "sym", 2, 3).select("perm_id", "book", "pos", "sym")),
    EV + """, num AS (SELECT *, count(*) OVER (PARTITION BY book) AS n FROM ev), pm AS (SELECT unnest(range(2)) AS perm_id),
sh AS (SELECT perm_id, book, pos, sym, n, CASE WHEN n > 1 THEN 1 + CAST(concat('0x', substr(md5(concat_ws('|', '3', perm_id, book)), 1, 8)) AS BIGINT) % (n - 1) ELSE 0 END AS shift FROM num, pm)
SELECT a.perm_id, a.book, a.pos, b.sym FROM sh a JOIN sh b ON a.perm_id = b.perm_id AND a.book = b.book AND a.pos = (b.pos + b.shift) % b.n""")

# Boundary reconstruction: candidates are events outside the major set, gold is the minor set's own symbol.
NB = EV + f""", un AS (SELECT *, coalesce(sum(CASE WHEN sym IN {_in(EVENT_BOUNDARIES.major)} THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM ev),
geo AS (SELECT *, row_number() OVER (PARTITION BY book, unit ORDER BY pos) - 1 AS off, count(*) OVER (PARTITION BY book, unit) AS len, coalesce(lag(sym) OVER (PARTITION BY book ORDER BY pos), 'START') AS prev, coalesce(lead(sym) OVER (PARTITION BY book ORDER BY pos), 'END') AS nxt FROM un),
cand AS (SELECT book, unit, pos, prev, nxt, off, len, sym = 'error' AS gold FROM geo WHERE sym NOT IN {_in(EVENT_BOUNDARIES.major)} AND off > 0 AND off < len - 1),
feat AS (SELECT *, ['pos=' || least(off, 8), 'left=' || least(len - 1 - off, 8), 'len=' || least(len, 12), 'half=' || (CASE WHEN off * 2 < len THEN 'first' ELSE 'second' END)] AS structure, ['prev=' || prev, 'next=' || nxt, 'pair=' || prev || '>' || nxt] AS adjacent FROM cand),
sets AS (SELECT book, unit, pos, gold, 'structure' AS fset, structure AS features FROM feat UNION ALL SELECT book, unit, pos, gold, 'adjacent_only', adjacent FROM feat UNION ALL SELECT book, unit, pos, gold, 'structure_local', list_concat(structure, adjacent) FROM feat),
fold AS (SELECT book, unit, (row_number() OVER (ORDER BY md5(concat_ws('|', '1', book, unit)), book, unit) - 1) % 5 AS fold FROM (SELECT DISTINCT book, unit FROM cand)),
ds AS (SELECT s.*, f.fold FROM sets s JOIN fold f USING (book, unit)),
ex AS (SELECT fset, fold, gold, unnest(features) AS feature FROM ds),
fc AS (SELECT fset, fold, feature, count(*) FILTER (gold) AS p, count(*) FILTER (NOT gold) AS q FROM ex GROUP BY ALL),
fa AS (SELECT fset, feature, sum(p) AS p, sum(q) AS q FROM fc GROUP BY ALL),
fl AS (SELECT DISTINCT fset, fold FROM ds),
tr AS (SELECT l.fset, l.fold, a.feature, a.p - coalesce(c.p, 0) AS p, a.q - coalesce(c.q, 0) AS q FROM fl l JOIN fa a USING (fset) LEFT JOIN fc c ON c.fset = l.fset AND c.fold = l.fold AND c.feature = a.feature),
tot AS (SELECT fset, fold, sum(p) AS sp, sum(q) AS sq, count(*) FILTER (p + q > 0) AS vocab FROM tr GROUP BY ALL),
cls AS (SELECT l.fset, l.fold, count(*) FILTER (gold) AS np, count(*) FILTER (NOT gold) AS nq FROM fl l JOIN ds d ON d.fset = l.fset AND d.fold <> l.fold GROUP BY ALL),
sc AS (SELECT d.fset, d.fold, d.book, d.pos, d.gold, round(first(ln((np + 1.0) / (np + nq + 2.0)) - ln((nq + 1.0) / (np + nq + 2.0))) + sum(ln((coalesce(t.p, 0) + 1.0) / (sp + greatest(1, vocab))) - ln((coalesce(t.q, 0) + 1.0) / (sq + greatest(1, vocab)))), 6) AS score
  FROM (SELECT fset, fold, book, pos, gold, unnest(features) AS feature FROM ds) d JOIN cls USING (fset, fold) JOIN tot USING (fset, fold) LEFT JOIN tr t ON t.fset = d.fset AND t.fold = d.fold AND t.feature = d.feature GROUP BY d.fset, d.fold, d.book, d.pos, d.gold),
pr AS (SELECT *, row_number() OVER (PARTITION BY fset, fold ORDER BY score DESC, book, pos) AS rk, count(*) FILTER (gold) OVER (PARTITION BY fset, fold) AS k FROM sc)"""


def _nb(stage):
    return on_events(lambda s: stage(B.Reconstruction(s, EVENT_BOUNDARIES.major, ("error",), 5, 1)))


register("nb_candidates", _nb(lambda r: r.candidates()), NB + " SELECT book, unit, pos, prev, nxt, off, len, gold FROM cand")
register("nb_features", _nb(lambda r: r.features().select("book", "unit", "pos", "gold", "fset", F.array_join("features", "|").alias("features"))), NB + " SELECT book, unit, pos, gold, fset, array_to_string(features, '|') AS features FROM sets")
register("nb_folds", _nb(lambda r: r.folds()), NB + " SELECT book, unit, fold FROM fold")
register("nb_scores", _nb(lambda r: r.scores()), NB + " SELECT fset, fold, book, pos, gold, score FROM sc")
register("nb_summary", _nb(lambda r: r.summary()), NB + " SELECT fset, count(*) FILTER (gold) AS gold_n, count(*) FILTER (rk <= k) AS predicted, count(*) FILTER (rk <= k AND gold) AS hits, round(count(*) FILTER (rk <= k AND gold) / nullif(count(*) FILTER (gold), 0), 8) AS f1 FROM pr GROUP BY fset")
register(
    "nb_predictions_wide", _nb(lambda r: r.wide()),
    NB + " SELECT book, pos, gold, " + ", ".join(f"max(score) FILTER (fset = '{x}') AS score_{x}, max(CASE WHEN rk <= k THEN 1 ELSE 0 END) FILTER (fset = '{x}') AS predicted_{x}" for x in ("structure", "adjacent_only", "structure_local")) + " FROM pr GROUP BY book, pos, gold",
)
register(
    "nb_weights", _nb(lambda r: r.weights(5)),
    NB + """, w AS (SELECT fset, feature, p, q, round(ln((p + 1.0) / (sum(p) OVER (PARTITION BY fset) + count(*) OVER (PARTITION BY fset))) - ln((q + 1.0) / (sum(q) OVER (PARTITION BY fset) + count(*) OVER (PARTITION BY fset))), 6) AS weight FROM fa),
top AS (SELECT fset, feature, CAST(p AS BIGINT) AS p, CAST(q AS BIGINT) AS q, weight, row_number() OVER (PARTITION BY fset ORDER BY weight DESC, feature) AS up, row_number() OVER (PARTITION BY fset ORDER BY weight, feature) AS down FROM w)
SELECT fset, feature, p, q, weight, CASE WHEN up <= 5 THEN 'positive' ELSE 'negative' END AS side FROM top WHERE up <= 5 OR down <= 5""",
)
register(
    "nb_random_null", _nb(lambda r: r.random_null(P)),
    NB + f""", one AS (SELECT DISTINCT fold, book, pos, gold, count(*) FILTER (gold) OVER (PARTITION BY fold) AS k FROM sc WHERE fset = 'structure'),
seen AS (SELECT 'structure_local' AS fset, count(*) FILTER (rk <= k AND gold) AS observed FROM pr WHERE fset = 'structure_local'),
nulls AS (SELECT 'structure_local' AS fset, perm_id, count(*) FILTER (rk <= k AND gold) AS value FROM (SELECT *, row_number() OVER (PARTITION BY perm_id, fold ORDER BY md5(concat_ws('|', '1', perm_id, fold, book, pos)), book, pos) AS rk FROM one, (SELECT unnest(range({P})) AS perm_id)) GROUP BY perm_id) """ + summary_sql("fset", z="0"),
)
register(
    "nb_signflip", _nb(lambda r: r.signflip("structure_local", "structure", P)),
    NB + f""", h AS (SELECT book, unit, sum(CASE WHEN fset = 'structure_local' THEN 1 ELSE -1 END) AS d FROM (SELECT p.fset, p.book, c.unit, p.rk <= p.k AS hit FROM pr p JOIN cand c USING (book, pos) WHERE p.gold AND p.fset IN ('structure_local', 'structure')) WHERE hit GROUP BY book, unit),
seen AS (SELECT 'difference' AS metric, CAST(coalesce(sum(d), 0) AS BIGINT) AS observed FROM h),
nulls AS (SELECT 'difference' AS metric, perm_id, CAST(sum(CASE WHEN substr(md5(concat_ws('|', '1', perm_id, book, unit)), 1, 1) IN ('0','2','4','6','8','a','c','e') THEN d ELSE -d END) AS BIGINT) AS value FROM h, (SELECT unnest(range({P})) AS perm_id) GROUP BY perm_id) """ + summary_sql("metric", z="0"),
)
