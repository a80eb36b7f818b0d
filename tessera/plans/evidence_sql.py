"""What the queries of tessera.plans.evidence must give, as SQL over the same tables."""

from __future__ import annotations

from tessera.plans.tables import with_

_C = with_("counts")
_MAP = "map AS (SELECT 'G' || p_partkey AS gene, p_brand || '/' || p_type AS symbol FROM part WHERE p_size > 7)"
_LIB = "lib AS (SELECT *, ln(1 + count * 1e4 / greatest(sum(count) OVER (PARTITION BY sample_id, unit_id), 1)) AS value FROM counts)"
_RING = "ru AS (SELECT sample_id, unit_id, [unit_id, lead(unit_id) OVER w, lead(unit_id, 2) OVER w] AS l FROM (SELECT DISTINCT sample_id, unit_id FROM counts) WINDOW w AS (PARTITION BY sample_id ORDER BY unit_id)), ring AS (SELECT * FROM (SELECT sample_id, unit_id, unnest(l) AS member FROM ru) WHERE member IS NOT NULL)"
_SCORE = _C + "," + _LIB + """,
genes AS (SELECT 'G' || p_partkey AS gene, p_brand AS set_id, count(*) OVER () AS n, count(*) OVER (PARTITION BY p_brand) AS size FROM part),
ranked AS (SELECT u.sample_id, u.unit_id, g.gene, g.set_id, n, size, row_number() OVER (PARTITION BY u.sample_id, u.unit_id ORDER BY coalesce(round(l.value, 9), 0) DESC, g.gene) - 1 AS r
  FROM (SELECT DISTINCT sample_id, unit_id FROM counts) u CROSS JOIN genes g LEFT JOIN lib l USING (sample_id, unit_id, gene)),
score AS (SELECT sample_id, unit_id, set_id, round(1 - avg(r) / (any_value(n) - 1), 6) AS score FROM ranked WHERE size BETWEEN 2 AND 5000 GROUP BY 1, 2, 3)"""
_PER = """WITH per AS (SELECT c_nationkey AS k, sum(c_acctbal) AS s, count(*) AS n, c_nationkey % 2 AS label FROM customer GROUP BY 1),
b AS (SELECT *, row_number() OVER (ORDER BY k) AS place FROM per),
o AS (SELECT perm, k, row_number() OVER (PARTITION BY perm ORDER BY md5('7:' || perm || ':' || k), k) AS place FROM b CROSS JOIN range(1, 201) r(perm)),
nulls AS (SELECT perm, round(sum(per.s) FILTER (b.label = 1) / sum(per.n) FILTER (b.label = 1) - sum(per.s) FILTER (b.label = 0) / sum(per.n) FILTER (b.label = 0), 9) AS v FROM o JOIN b USING (place) JOIN per ON per.k = o.k GROUP BY 1),
obs AS (SELECT round(sum(s) FILTER (label = 1) / sum(n) FILTER (label = 1) - sum(s) FILTER (label = 0) / sum(n) FILTER (label = 0), 9) AS o FROM per)
"""
_CAND = """WITH g AS (SELECT s_nationkey % 9 AS task_id, s_suppkey % 4 AS method_id, avg(s_acctbal) AS m, count(*) AS n, min(s_acctbal) AS least FROM supplier GROUP BY 1, 2),
cand AS (SELECT task_id, 0 AS axis, true AS hib, method_id, round(m, 3) AS value, round(m - 900.0 / sqrt(n), 3) AS lo, round(m + 900.0 / sqrt(n), 3) AS hi FROM g UNION ALL SELECT task_id, 1, false, method_id, least, NULL, NULL FROM g WHERE n > 1),
bars AS (SELECT t AS task_id, a AS axis, CASE WHEN a = 0 THEN 3000.0 WHEN t % 2 = 0 THEN 4000.0 END AS floor FROM range(8) r(t) CROSS JOIN range(2) q(a)),
contra(method_id, task_id, applies) AS (VALUES (0, 1, true), (1, 1, true), (1, 1, false), (2, 3, true), (3, 4, false)),
p AS (SELECT c.*, floor, floor IS NULL OR CASE WHEN hib THEN value > floor ELSE value < floor END AS passes FROM cand c LEFT JOIN bars USING (task_id, axis)),
q AS (SELECT *, row_number() OVER w AS pos, first_value(value) OVER w AS fv, first_value(lo) OVER w AS fl, first_value(hi) OVER w AS fh FROM p WHERE passes WINDOW w AS (PARTITION BY task_id, axis ORDER BY CASE WHEN hib THEN -value ELSE value END, method_id))
"""
_RESOLVE = _CAND.rstrip() + """, ban AS (SELECT DISTINCT method_id, task_id FROM contra WHERE applies), ev AS (SELECT * FROM cand WHERE task_id <> 8),
ok AS (SELECT * FROM p WHERE passes AND task_id <> 8 AND (method_id, task_id) NOT IN (SELECT (method_id, task_id) FROM ban)),
best AS (SELECT *, first_value(value) OVER w AS bv, first_value(lo) OVER w AS bl, first_value(hi) OVER w AS bh, row_number() OVER w AS i FROM ok WINDOW w AS (PARTITION BY task_id, axis ORDER BY CASE WHEN hib THEN -value ELSE value END, method_id)),
lead AS (SELECT * FROM best WHERE i = 1 OR CASE WHEN lo IS NOT NULL AND bl IS NOT NULL THEN lo <= bh AND bl <= hi ELSE value = bv END),
ax AS (SELECT task_id, count(DISTINCT axis) AS axes FROM ev GROUP BY 1), led AS (SELECT task_id, count(DISTINCT axis) AS led FROM lead GROUP BY 1),
cm AS (SELECT task_id, count(*) AS n, min(method_id) AS m FROM (SELECT task_id, method_id FROM lead JOIN ax USING (task_id) GROUP BY 1, 2, axes HAVING count(DISTINCT axis) = axes) GROUP BY 1),
sh AS (SELECT task_id, NOT value > 5500 AS short FROM lead WHERE i = 1 AND axis = 0 AND task_id < 8),
rq AS (SELECT t * 10 + p + 1 AS request_id, t AS task_id, CASE WHEN p >= 0 THEN p END AS proposed, p % 2 = 1 AS override FROM range(11) z(t) CROSS JOIN range(-1, 4) y(p)),
rb AS (SELECT rq.*, b.method_id IS NOT NULL AS bad FROM rq LEFT JOIN ban b ON b.method_id = proposed AND b.task_id = rq.task_id),
r AS (SELECT rq.*, m, short, CASE WHEN rq.task_id > 9 THEN 'unknown_family' WHEN axes IS NULL THEN 'no_evidence'
  WHEN proposed IS NOT NULL AND bad AND override THEN 'against_the_evidence' WHEN proposed IS NOT NULL AND bad THEN 'contraindicated' WHEN coalesce(led, 0) < axes THEN 'axis_without_leader'
  WHEN n IS NULL THEN 'axes_disagree' WHEN n > 1 THEN 'several_lead' ELSE 'leads_every_axis' END AS reason FROM rb rq LEFT JOIN ax USING (task_id) LEFT JOIN led USING (task_id) LEFT JOIN cm USING (task_id) LEFT JOIN sh USING (task_id)),
o AS (SELECT *, CASE reason WHEN 'unknown_family' THEN 'escalate' WHEN 'no_evidence' THEN 'escalate' WHEN 'axes_disagree' THEN 'escalate' WHEN 'against_the_evidence' THEN 'override' WHEN 'contraindicated' THEN 'refuse'
  WHEN 'axis_without_leader' THEN 'refuse' WHEN 'several_lead' THEN 'tie' ELSE 'recommend' END AS outcome FROM r),
res AS (SELECT request_id, task_id, outcome, reason, CASE outcome WHEN 'recommend' THEN m WHEN 'override' THEN proposed END AS method_id, outcome IN ('recommend', 'tie') AND coalesce(short, false) AS shortfall FROM o)
"""
_GUARD = """WITH e AS (SELECT s_suppkey AS k, s_nationkey AS nk, s_acctbal AS bal, CASE WHEN s_suppkey % 11 <> 0 THEN (s_suppkey % 10)::DOUBLE / 10 END AS nmi, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 0.8 END::DOUBLE AS wi, CASE WHEN s_suppkey % 13 <> 0 THEN 0.8::DOUBLE - (s_suppkey % 7)::DOUBLE / 10 END AS across,
CASE WHEN s_suppkey % 17 <> 0 THEN (s_suppkey % 5)::DOUBLE / 2 END AS b, (s_suppkey % 3)::DOUBLE AS c, CASE WHEN s_suppkey % 7 <> 0 THEN 1.2::DOUBLE END AS fl, CASE WHEN s_suppkey % 19 <> 0 THEN (s_suppkey % 20)::DOUBLE / 20 END AS oc, (s_suppkey % 12)::DOUBLE / 100 AS p, s_suppkey % 60 AS nn, s_suppkey % 6 = 0 AS circ FROM supplier),
t AS (SELECT k, 'G1' AS guard, nmi <= 0.5 AS ok FROM e UNION ALL SELECT k, 'G2', CASE WHEN across IS NULL THEN NULL WHEN wi = 0 THEN true ELSE (wi - across) / wi <= 0.5 END FROM e
UNION ALL SELECT k, 'G3', CASE WHEN b IS NULL THEN NULL WHEN c = 0 THEN true ELSE b >= c AND (fl IS NULL OR b / c >= fl) END FROM e UNION ALL SELECT k, 'G4', oc <= 0.5 FROM e
UNION ALL SELECT k, 'G5', CASE WHEN nn >= 20 THEN p < 0.05 END FROM e UNION ALL SELECT k, 'G6', NOT circ FROM e),
g AS (SELECT k AS method_id, guard, CASE WHEN ok THEN 'pass' WHEN NOT ok THEN 'fail' ELSE 'not_run' END AS status FROM t)
"""
_CHECKS = """WITH c AS (SELECT p_brand, p_name, p_size AS z, p_type AS t, p_name LIKE 'small%' AS adv, p_name LIKE 'red%' AS calib, p_retailprice > 950 AS req, p_name LIKE '%ring' AS done FROM part),
s AS (SELECT *, CASE WHEN t = 'LARGE' THEN CASE WHEN z = 50 OR z <= 15 THEN 'fail' ELSE 'pass' END WHEN t NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'STANDARD') THEN 'not_run' WHEN z = 50 THEN 'not_run' WHEN t = 'ECONOMY' THEN CASE WHEN z > 30 THEN 'pass' ELSE 'fail' END
  WHEN t = 'SMALL' THEN CASE WHEN z > 30 THEN 'fail' ELSE 'pass' END WHEN t = 'MEDIUM' THEN CASE WHEN z > 20 THEN 'pass' ELSE 'fail' END ELSE CASE WHEN z > 40 THEN 'fail' ELSE 'pass' END END AS status FROM c),
k AS (SELECT *, CASE WHEN calib AND NOT done THEN 'escalate' WHEN NOT req AND z = 50 THEN CASE WHEN adv THEN 'note' ELSE 'caution' END WHEN z = 49 THEN CASE WHEN adv THEN 'note' WHEN req THEN 'violation' ELSE 'caution' END
  WHEN adv THEN CASE WHEN status <> 'pass' OR t = 'STANDARD' AND z BETWEEN 26 AND 40 THEN 'note' END WHEN status <> 'pass' THEN CASE WHEN req THEN 'violation' ELSE 'caution' END WHEN t = 'STANDARD' AND z BETWEEN 26 AND 40 THEN 'caution' END AS kind FROM s),
v AS (SELECT *, p_name || ':' || z AS pz FROM k)
"""
_REC = """WITH r AS (SELECT substr(sha256('{"event_type":"' || event_type || '","user_id":"' || user_id || '","value":"' || value || '"}'), 1, 12) AS record_id, event_type AS kind, 's' || (user_id % 5) AS step, CASE WHEN value > 5 THEN 'pass' ELSE 'fail' END AS status,
CASE WHEN event_id % 9 <> 0 THEN value END AS duration, event_id AS "at" FROM events)
"""

ORACLE = {
    "count_stats": _C + """, u AS (SELECT sample_id, unit_id, sum(count) AS t, count(*) FILTER (count > 0) AS dt FROM counts GROUP BY 1, 2), w AS (SELECT count(DISTINCT gene) AS v, count(*) FILTER (count > 0) AS nnz, bool_and(count = floor(count)) AS integer FROM counts)
        SELECT count(*) AS n_obs, any_value(v) AS n_vars, round(median(t), 4) AS median_total, round(median(dt), 4) AS median_detected, round(1 - any_value(nnz)::DOUBLE / (count(*) * any_value(v)), 6) AS sparsity, any_value(integer) AS integer FROM u, w""",
    "marker_expression": _C + """, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT sample_id, unit_id FROM counts)) SELECT gene, round(sum(count) / any_value(n), 6) AS mean, round(100.0::DOUBLE * count(*) FILTER (count > 0) / any_value(n), 6) AS percent FROM counts, n WHERE gene IN ('G1', 'G17', 'G250', 'none') GROUP BY 1""",
    "gene_filter": _C + "SELECT sample_id, count(DISTINCT gene) AS genes, round(sum(count), 4) AS total FROM counts WHERE gene NOT LIKE 'G1%' GROUP BY 1",
    "gene_axis_sum": _C + "," + _MAP + " SELECT sample_id, symbol, round(sum(count), 4) AS count FROM counts JOIN map USING (gene) GROUP BY 1, 2",
    "gene_axis_mean": _C + "," + _MAP + """, j AS (SELECT sample_id, unit_id, gene, coalesce(symbol, gene) AS symbol, count FROM counts LEFT JOIN map USING (gene)), i AS (SELECT symbol, count(DISTINCT gene) AS ids FROM j GROUP BY 1)
        SELECT sample_id, unit_id, symbol, round(sum(count) / any_value(ids), 6) AS count FROM j JOIN i USING (symbol) GROUP BY 1, 2, 3""",
    "niche_qc": _C + ", u AS (SELECT sum(count) AS t, count(*) FILTER (count > 0) AS dt FROM counts GROUP BY sample_id, unit_id) SELECT CASE WHEN t < 60 THEN 'total' WHEN dt < 3 THEN 'detected' END AS cause, count(*) AS n, round(sum(t), 4) AS total FROM u GROUP BY 1",
    "library_normalise": _C + "," + _LIB + " SELECT sample_id, unit_id, gene, round(value, 6) AS value FROM lib",
    "niche_sum": _C + "," + _RING + ", m AS (SELECT r.sample_id, r.unit_id, gene, sum(count) AS c FROM ring r JOIN counts c ON c.sample_id = r.sample_id AND c.unit_id = r.member GROUP BY 1, 2, 3) SELECT sample_id, unit_id, count(*) AS genes, round(sum(c), 4) AS total FROM m GROUP BY 1, 2",
    "robust_cv_topfrac": _C + "," + _LIB + "," + _RING + """, m AS (SELECT r.sample_id, r.unit_id, gene, list(value) AS l FROM ring r JOIN lib c ON c.sample_id = r.sample_id AND c.unit_id = r.member GROUP BY 1, 2, 3),
        f AS (SELECT sample_id, unit_id, gene, list_concat(l, [0.0::DOUBLE FOR i IN range(3 - len(l))]) AS f FROM m), g AS (SELECT *, list_sort(f)[2] AS med, list_sum(f) / 3 AS mean FROM f),
        h AS (SELECT *, list_sort([abs(x - med) FOR x IN f])[2] / (mean + 1e-9) AS ratio FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, unit_id ORDER BY ratio DESC, gene) AS pos, count(*) OVER (PARTITION BY sample_id, unit_id) AS n FROM h WHERE mean > 0)
        SELECT sample_id, unit_id, count(*) AS kept, round(sum(ratio), 4) AS ratio, round(sum(mean), 4) AS mean FROM k WHERE pos <= least(greatest(5, floor(n * 0.25)), n) GROUP BY 1, 2""",
    "set_score_rank": _SCORE + " SELECT * FROM score",
    "score_zscore": _SCORE + " SELECT sample_id, set_id, round(avg(z), 5) AS z FROM (SELECT *, (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-9) AS z FROM score WINDOW w AS (PARTITION BY set_id)) GROUP BY 1, 2",
    "pseudobulk": _C + ", n AS (SELECT sample_id, count(DISTINCT unit_id) AS n FROM counts GROUP BY 1) SELECT sample_id, gene, round(ln(1 + sum(count) / any_value(n)), 6) AS value FROM counts JOIN n USING (sample_id) GROUP BY 1, 2",
    "differential_markers": _C + """, n AS (SELECT sample_id, count(DISTINCT unit_id) AS n FROM counts GROUP BY 1), p AS (SELECT sample_id AS class, gene, round(ln(1 + sum(count) / any_value(n)), 6) AS x FROM counts JOIN n USING (sample_id) GROUP BY 1, 2),
        l AS (SELECT *, CASE WHEN count(*) OVER g > 1 THEN x - (sum(x) OVER g - x) / (count(*) OVER g - 1) END AS lead FROM p WINDOW g AS (PARTITION BY gene)), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY lead DESC, gene) AS pos FROM l WHERE lead IS NOT NULL)
        SELECT class, count(*) AS n, round(sum(lead), 4) AS lead FROM r WHERE pos <= 5 GROUP BY 1""",
    "dag_closure": """SELECT 'r' || r_regionkey AS root, 0::BIGINT AS depth, 1::BIGINT AS n FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'r' || n_regionkey, 1, count(*) FROM nation GROUP BY n_regionkey
        UNION ALL SELECT 'r' || n_regionkey, 2, count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey UNION ALL SELECT DISTINCT 'n' || c_nationkey, 0, 1 FROM customer UNION ALL SELECT 'n' || c_nationkey, 1, count(*) FROM customer GROUP BY c_nationkey""",
    "ari_nmi": """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
        s AS (SELECT any_value(t) AS t, sum(n * (n - 1) / 2) AS sij, sum(n / na * na * (na - 1) / 2) AS sa, sum(n / nb * nb * (nb - 1) / 2) AS sb, sum(n / t * ln(n * t / (na * nb))) AS mi, -sum(n / t * ln(na / t)) AS ha, -sum(n / t * ln(nb / t)) AS hb FROM m)
        SELECT round((sij - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi FROM s""",
    "welch_contrast": """WITH s AS (SELECT count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2 FROM lineitem)
        SELECT n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS z FROM s""",
    "perm_test": _PER + "SELECT round(any_value(o), 6) AS observed, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round((any_value(o) - avg(v)) / stddev_pop(v), 6) AS z, round((1 + count(*) FILTER (abs(v) >= abs(o)))::DOUBLE / (1 + count(*)), 6) AS p FROM nulls, obs",
    "null_shape": _PER + "SELECT count(*) AS n, round(skewness(v), 5) AS skew, round(kurtosis(v), 5) AS kurtosis, round(quantile_cont(v, 0.05), 5) AS q05, round(quantile_cont(v, 0.95), 5) AS q95 FROM nulls",
    "bh_fdr": """WITH p AS (SELECT p_brand AS family, p_partkey AS test, CASE WHEN p_partkey % 50 <> 0 THEN (p_partkey * 7919 % 10007)::DOUBLE / 10007 / (1 + p_partkey % 40) END AS p FROM part),
        i AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS i, count(*) OVER (PARTITION BY family) AS m FROM p WHERE p IS NOT NULL), q AS (SELECT family, test, p, least(1, min(p * m / i) OVER (PARTITION BY family ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM i)
        SELECT family, test, round(p, 9) AS p, round(q, 9) AS q, q <= 0.05 AS rejected FROM q UNION ALL SELECT family, test, NULL, NULL, false FROM p WHERE p IS NULL""",
    "bootstrap_ci": """WITH g AS (SELECT o_custkey % 20 AS g, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS k FROM g),
        dr AS (SELECT rep, ('0x' || substr(md5('42:' || rep || ':' || i), 1, 8))::BIGINT % (SELECT any_value(k) FROM b) AS place FROM range(1, 201) r(rep) CROSS JOIN range(0, 1000) q(i) WHERE i < (SELECT any_value(k) FROM b)),
        v AS (SELECT rep, sum(s) / sum(n) AS v FROM dr JOIN b USING (place) GROUP BY 1) SELECT (SELECT count(*) FROM b) AS groups, (SELECT round(sum(s) / sum(n), 4) FROM b) AS mean, round(quantile_cont(v, 0.025), 4) AS lo, round(quantile_cont(v, 0.975), 4) AS hi FROM v""",
    "ratio_ci": """WITH s AS (SELECT s_suppkey, s_acctbal / 1000 AS a, (s_suppkey % 7 - 3)::DOUBLE AS b FROM supplier), r AS (SELECT *, CASE WHEN b <> 0 THEN a / b END AS r FROM s), h AS (SELECT *, CASE WHEN b = 0 THEN NULL WHEN a <> 0 THEN 1.96::DOUBLE * abs(r) * sqrt(1 / (a * a) + 1 / (b * b)) ELSE 1.96::DOUBLE / abs(b) END AS h FROM r)
        SELECT s_suppkey, round(a, 6) AS a, b, round(r, 6) AS ratio, round(r - h, 6) AS lo, round(r + h, 6) AS hi FROM h""",
    "hanley_mcneil": """WITH s AS (SELECT s_suppkey, (s_suppkey % 50 + 50)::DOUBLE / 100 AS auc, s_suppkey % 30 + 5 AS pos, s_suppkey % 90 + 9 AS neg FROM supplier), e AS (SELECT *, sqrt((auc * (1 - auc) + (pos - 1) * (auc / (2 - auc) - auc * auc) + (neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (pos * neg)) AS e FROM s)
        SELECT s_suppkey, auc, pos, neg, round(e, 6) AS se, round(greatest(0, auc - 1.96::DOUBLE * e), 6) AS lo, round(least(1, auc + 1.96::DOUBLE * e), 6) AS hi FROM e""",
    "spearman_by_sample": """WITH r AS (SELECT l_suppkey % 10 AS sample_id, rank() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey % 10, l_quantity) - 1)::DOUBLE / 2 AS a, rank() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey % 10, l_extendedprice) - 1)::DOUBLE / 2 AS b FROM lineitem)
        SELECT sample_id, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""",
    "f1_scores": """WITH x AS (SELECT l_returnflag AS t, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS g FROM lineitem), c AS (SELECT DISTINCT t AS c FROM x UNION SELECT DISTINCT g FROM x),
        p AS (SELECT c, count(*) FILTER (t = c) AS sup, count(*) FILTER (g = c) AS cal, count(*) FILTER (t = c AND g = c) AS hit FROM c, x GROUP BY 1)
        SELECT round(sum(hit)::DOUBLE / sum(sup)::DOUBLE, 6) AS accuracy, round(avg(2.0::DOUBLE * hit / (sup + cal)), 6) AS macro_f1, round(sum(2.0::DOUBLE * hit / (sup + cal) * sup) / sum(sup)::DOUBLE, 6) AS weighted_f1 FROM p""",
    "gini_topmass": """WITH r AS (SELECT o_orderpriority, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS i, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS j, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
        SELECT o_orderpriority, any_value(n) AS n, round(2 * sum(i * x) / (any_value(n) * sum(x)) - (any_value(n) + 1)::DOUBLE / any_value(n), 6) AS gini, round(sum(x) FILTER (j <= ceil(n * 0.1::DOUBLE)) / sum(x), 6) AS top_mass FROM r GROUP BY 1""",
    "compartment_stats": "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std FROM customer GROUP BY 1",
    "wide_report": "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 4) AS f, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 4) AS o FROM lineitem GROUP BY 1",
    "propose_task": _CAND + """, t AS (SELECT DISTINCT task_id, axis FROM cand), l AS (SELECT task_id, axis, count(*) AS e, count(*) FILTER (pos = 1 OR value = fv OR coalesce(lo <= fh AND fl <= hi, false)) AS nlead, max(method_id) FILTER (pos = 1) AS f, round(abs(max(value) FILTER (pos = 1) - max(value) FILTER (pos = 2)), 4) AS margin FROM q GROUP BY 1, 2)
        SELECT t.task_id, t.axis, CASE WHEN e IS NULL THEN 'refuse' WHEN nlead > 1 THEN 'tie' ELSE 'recommend' END AS outcome, CASE WHEN nlead = 1 THEN f END AS winner, margin FROM t LEFT JOIN l USING (task_id, axis)""",
    "route_resolve": _RESOLVE + "SELECT * FROM res",
    "outcome_counts": _RESOLVE + "SELECT o AS outcome, count(task_id) AS n FROM (VALUES ('recommend'), ('tie'), ('escalate'), ('refuse'), ('override')) v(o) LEFT JOIN res ON outcome = o GROUP BY 1",
    "matrix_admissibility": _CAND + """, b AS (SELECT method_id, task_id, bool_or(NOT passes) AS below FROM p GROUP BY 1, 2), m AS (SELECT method_id, task_id, bool_or(applies) AS on_, bool_or(NOT applies) AS off FROM contra GROUP BY 1, 2)
        SELECT method_id, task_id, CASE WHEN off THEN 'does_not_apply' WHEN on_ THEN 'contraindicated' WHEN below THEN 'below_floor' ELSE 'admissible' END AS cell FROM b LEFT JOIN m USING (method_id, task_id)""",
    "guard_statuses": _GUARD + "SELECT guard, status, count(*) AS n FROM g GROUP BY 1, 2",
    "guard_verdicts": _GUARD + """, s AS (SELECT method_id, count(*) FILTER (status = 'fail') AS f FROM g JOIN e ON k = method_id JOIN nation ON n_nationkey = nk WHERE n_regionkey > 0 AND status <> 'not_run' GROUP BY 1)
        SELECT k AS method_id, CASE WHEN NOT bal > 0 THEN 'not_run' WHEN f > 0 THEN 'diagnostic' WHEN f = 0 THEN 'biological' ELSE 'unguarded' END AS verdict FROM e LEFT JOIN s ON method_id = k""",
    "eda_gate": _CHECKS + """SELECT *, CASE WHEN violations > 0 THEN 'stop' WHEN cautions > 0 THEN 'proceed_with_caution' ELSE 'proceed' END AS gate FROM (SELECT p_brand AS cohort, count(*) FILTER (kind = 'violation') AS violations,
        count(*) FILTER (kind IN ('caution', 'escalate')) + max((z = 1)::INT) AS cautions, count(*) FILTER (kind = 'escalate') AS escalations, count(*) FILTER (kind = 'note') AS notes FROM v GROUP BY 1)""",
    "eda_gate_by_part": _CHECKS + """SELECT *, CASE WHEN violations > 0 THEN 'stop' WHEN cautions > 0 THEN 'proceed_with_caution' ELSE 'proceed' END AS gate FROM (SELECT pz AS cohort, count(*) FILTER (kind = 'violation') AS violations,
        count(*) FILTER (kind IN ('caution', 'escalate')) AS cautions, count(*) FILTER (kind = 'escalate') AS escalations, count(*) FILTER (kind = 'note') AS notes FROM v GROUP BY 1)""",
    "pack_diff": _CAND + """, a AS (SELECT * FROM cand WHERE axis = 0 AND (method_id <> 0 OR task_id < 6)), b AS (SELECT * FROM cand WHERE axis = 0 AND (method_id <> 3 OR task_id > 4))
        SELECT task_id, method_id, CASE WHEN a.axis IS NULL THEN 'absent_from_curated' WHEN b.axis IS NULL THEN 'not_reachable_by_rebuild' WHEN task_id = 2 THEN 'value_moved' WHEN task_id = 5 THEN 'interval_moved' ELSE 'same' END AS change FROM a FULL JOIN b USING (task_id, method_id)""",
    "grid_coverage": _CAND + """, d AS (SELECT t, m FROM range(9) r(t) CROSS JOIN (VALUES (0), (1), (2), (5)) v(m)), s AS (SELECT DISTINCT task_id AS t, method_id AS m FROM cand)
        SELECT (SELECT count(*) FROM d) AS declared, (SELECT count(*) FROM s) AS scored, (SELECT count(*) FROM (SELECT t::BIGINT, m::BIGINT FROM d EXCEPT SELECT t::BIGINT, m::BIGINT FROM s)) AS missing, (SELECT count(*) FROM (SELECT t::BIGINT, m::BIGINT FROM s EXCEPT SELECT t::BIGINT, m::BIGINT FROM d)) AS undeclared""",
    "tfidf_route": r"""WITH t AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM benchmark), a AS (SELECT conv_id || ':' || turn AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM conversations),
        tt AS (SELECT id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS x FROM t), ax AS (SELECT id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS x FROM a),
        idf AS (SELECT x, ln((1 + (SELECT count(*) FROM t))::DOUBLE / (1 + count(DISTINCT id))) + 1 AS idf FROM tt GROUP BY 1),
        tw AS (SELECT id, x, (1 + ln(count(*))) * any_value(idf) AS w FROM tt JOIN idf USING (x) GROUP BY 1, 2), aw AS (SELECT id, x, (1 + ln(count(*))) * any_value(idf) AS w FROM ax JOIN idf USING (x) GROUP BY 1, 2),
        tn AS (SELECT id, x, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM tw), an AS (SELECT id, x, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM aw),
        s AS (SELECT an.id AS q, tn.id AS k, sum(an.w * tn.w) AS s FROM an JOIN tn USING (x) GROUP BY 1, 2), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, k) AS i FROM s) WHERE i = 1)
        SELECT a.id AS question_id, CASE WHEN s >= 0.15 THEN k END AS task_id, round(coalesce(s, 0), 5) AS score FROM a LEFT JOIN b ON b.q = a.id""",
    "ledger_dedupe": _REC + ", e AS (SELECT DISTINCT record_id FROM r WHERE kind = 'error') SELECT kind, count(DISTINCT record_id) AS n FROM r WHERE kind = 'error' OR record_id NOT IN (SELECT record_id FROM e) GROUP BY 1",
    "ledger_summary": _REC + "SELECT kind, step, status, count(*) AS n, round(sum(duration), 4) AS duration, count(*) FILTER (duration IS NULL) AS untimed FROM r GROUP BY 1, 2, 3",
    "ledger_last": _REC + 'SELECT record_id, r."at", kind FROM r ORDER BY r."at" DESC, record_id LIMIT 20',
    "first_record": "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "stratified_cap": "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('3:' || c_custkey), c_custkey) AS i FROM customer) WHERE i <= 40",
    "key_transform": "SELECT c_custkey, split_part(c_name, '#', 2) AS plain, c_name AS unversioned, c_nationkey || '::' || c_custkey AS both FROM customer",
    "sample_intersection": "SELECT c_nationkey AS sample_id FROM customer INTERSECT SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3",
    "schema_violations": """SELECT 'order has customer' AS rule, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500) UNION ALL SELECT 'label has document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
        UNION ALL SELECT 'line is unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'size is positive', count(*) FROM part WHERE NOT p_size > 0 UNION ALL SELECT 'brand pattern', count(*) FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]')
        UNION ALL SELECT 'language is known', count(*) FROM documents WHERE lang NOT IN ('en', 'de', 'fr', 'es') UNION ALL SELECT 'conditional rule', count(*) FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 50000""",
    "stream_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type
        HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
}
