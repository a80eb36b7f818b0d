"""What the queries of tessera.plans.studies must give, as SQL over the same tables."""

from __future__ import annotations

from tessera.operators import permute
from tessera.plans.tables import SQL, with_

_UNIT = "(SELECT vec_id % 40 AS sample_id, (embedding::DOUBLE[]){part} AS v FROM embeddings)"


def _pool(name: str, part: str) -> str:
    dims = 64 if not part else 32
    return f"""{name}u AS (SELECT sample_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM {_UNIT.format(part=part)}),
{name}l AS (SELECT sample_id, i AS dim, avg(u[i]) AS m FROM {name}u CROSS JOIN range(1, {dims + 1}) r(i) GROUP BY 1, 2),
{name}q AS (SELECT sample_id, list(m / n ORDER BY dim) AS q FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY sample_id)) AS n FROM {name}l) GROUP BY 1),
{name}s AS (SELECT sample_id, sample_id % 14 AS subject_id, CASE WHEN sample_id % 14 % 4 < 3 THEN sample_id % 14 % 4 END AS label, q FROM {name}q),
{name}p AS (SELECT a.sample_id AS a, b.sample_id AS b, a.subject_id AS sa, b.subject_id AS sb, a.label AS la, b.label AS lb, round(greatest(-1, least(1, list_dot_product(a.q, b.q))), 9) AS c FROM {name}s a JOIN {name}s b ON a.sample_id < b.sample_id)"""


def _dealt(source: str, key: str, label: str, n: int, seed: int) -> str:
    return f"""pb AS (SELECT {key} AS k, {label} AS l, row_number() OVER (ORDER BY {key}) AS place FROM {source}),
po AS (SELECT perm, k, row_number() OVER (PARTITION BY perm ORDER BY md5('{seed}:' || perm || ':' || k), k) AS place FROM pb CROSS JOIN range(1, {n + 1}) r(perm)),
dealt AS (SELECT perm, po.k, l FROM po JOIN pb USING (place))"""


def _biology_null(name: str) -> str:
    return f"{name}v AS (SELECT * FROM {name}p WHERE sa <> sb AND la IS NOT NULL AND lb IS NOT NULL), {name}n AS (SELECT x.perm, round(avg(c) FILTER (x.l IS NOT DISTINCT FROM y.l) - avg(c) FILTER (x.l IS DISTINCT FROM y.l), 9) AS v FROM {name}v JOIN dealt x ON x.k = sa JOIN dealt y ON y.k = sb AND y.perm = x.perm GROUP BY 1)"


_STATS = """SELECT '{kind}' AS kind, n_same, n_different, round(same, 4) AS same, round(different, 4) AS different, round(delta, 4) AS delta, n AS n_permutations, round(m, 4) AS null_mean, round(sd, 4) AS null_sd, round(delta / sd, 4) AS z, round((delta - m) / sd, 4) AS z_standard,
round((1 + beyond)::DOUBLE / (1 + n), 4) AS p, round(pct, 4) AS percentile, round(sk, 4) AS skew, round(ku, 4) AS kurtosis, round(q05, 4) AS q05, round(q95, 4) AS q95, '' AS untestable
FROM o CROSS JOIN (SELECT count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd, count(*) FILTER (v >= delta) AS beyond, avg((v < delta)::INT) AS pct, skewness(v) AS sk, kurtosis(v) AS ku, quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.95) AS q95 FROM nl, o)"""
_OBS = "o AS (SELECT count(*) FILTER ({same}) AS n_same, count(*) FILTER (NOT ({same})) AS n_different, avg(c) FILTER ({same}) AS same, avg(c) FILTER (NOT ({same})) AS different, round(avg(c) FILTER ({same}) - avg(c) FILTER (NOT ({same})), 9) AS delta FROM {rows})"

_RES = """WITH r AS (SELECT l_suppkey AS method_id, CASE WHEN l_linestatus = 'O' THEN 'z_he' ELSE 'z_st' END AS view, l_returnflag AS test, avg(l_discount) AS x, avg(l_tax) AS y, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT *, round(x / 0.1::DOUBLE, 6) AS p, n > 5 AS testable FROM r)
"""


def _bh(name: str, source: str, where: str) -> str:
    return f"""{name}i AS (SELECT *, row_number() OVER (ORDER BY p, method_id || '/' || view || '/' || test) AS i, count(*) OVER () AS m FROM {source} WHERE p IS NOT NULL {where}),
{name} AS (SELECT method_id, view, test, least(1, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM {name}i)"""


_TWO = lambda c: f"({c} * ({c} - 1) / 2)"

def _cells() -> str:
    """Two-dimensional z and one-dimensional y: the inverse of a 2 x 2 matrix in closed form."""
    moments = lambda rows, y: f"count(*) AS n, var_pop(z1) AS a, covar_pop(z1, z2) AS b, var_pop(z2) AS c, covar_pop(z1, {y}) AS d, covar_pop(z2, {y}) AS e, var_pop({y}) AS f"
    fit = "sqrt((c * d * d - 2 * b * d * e + a * e * e) / (a * c - b * b) / f)"
    score = lambda m, t: f"(({m}.c * {m}.d - {m}.b * {m}.e) * {t}.d + ({m}.a * {m}.e - {m}.b * {m}.d) * {t}.e) / sqrt((pow({m}.c * {m}.d - {m}.b * {m}.e, 2) * {t}.a + 2 * ({m}.c * {m}.d - {m}.b * {m}.e) * ({m}.a * {m}.e - {m}.b * {m}.d) * {t}.b + pow({m}.a * {m}.e - {m}.b * {m}.d, 2) * {t}.c) * {t}.f)"
    k = "run, view, target"
    dealt = lambda name, seed: permute.sql(f"{name}_rows", k, 20, seed, name)
    return f"""WITH RECURSIVE {SQL['units']}, ho AS (SELECT subject_id FROM (SELECT DISTINCT subject_id FROM units) ORDER BY md5('1:' || subject_id), subject_id LIMIT 4),
        base AS (SELECT unit_id, label % 2 AS run, CASE WHEN subject_id IN (SELECT subject_id FROM ho) THEN 'test' ELSE 'train' END AS part, v FROM units),
        rw AS (SELECT run, view, target, unit_id, part, v[CASE view WHEN 'left' THEN 1 ELSE 33 END] AS z1, v[CASE view WHEN 'left' THEN 2 ELSE 34 END] AS z2, CASE target WHEN 'third' THEN v[3] ELSE v[1] + v[40] END AS y FROM base CROSS JOIN (VALUES ('left'), ('right')) a(view) CROSS JOIN (VALUES ('third'), ('sum')) b(target)),
        pl AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY part = 'test', unit_id) - 1 AS place FROM rw),
        pf_rows AS (SELECT {k}, count(*) AS n FROM pl GROUP BY ALL), pt_rows AS (SELECT {k}, count(*) AS n FROM pl WHERE part = 'train' GROUP BY ALL),
        {dealt('pf', 7)}, {dealt('pt', 8)},
        xf AS (SELECT {', '.join('p.' + x for x in k.split(', '))}, perm, {moments('', 'q.y')} FROM (SELECT {k}, place, z1, z2 FROM pl) p JOIN pf USING ({k}, place) JOIN (SELECT {k}, place AS partner, y FROM pl) q USING ({k}, partner) GROUP BY ALL),
        xt AS (SELECT {', '.join('p.' + x for x in k.split(', '))}, perm, {moments('', 'q.y')} FROM (SELECT {k}, place, z1, z2 FROM pl WHERE part = 'train') p JOIN pt USING ({k}, place) JOIN (SELECT {k}, place AS partner, y FROM pl WHERE part = 'train') q USING ({k}, partner) GROUP BY ALL),
        te AS (SELECT {k}, {moments('', 'y')} FROM pl WHERE part = 'test' GROUP BY ALL),
        rf AS (SELECT {k}, perm, n, {fit} AS r FROM xf), rt AS (SELECT {k}, xt.perm, xt.n, te.n AS n_test, {score('xt', 'te')} AS r, CASE WHEN xt.perm = 0 THEN sqrt((xt.c * xt.d * xt.d - 2 * xt.b * xt.d * xt.e + xt.a * xt.e * xt.e) / (xt.a * xt.c - xt.b * xt.b) / xt.f) END AS r_train FROM xt JOIN te USING ({k})),
        of AS (SELECT {k}, n, r FROM rf WHERE perm = 0), ot AS (SELECT {k}, n, n_test, r, r_train FROM rt WHERE perm = 0),
        gf AS (SELECT {k}, avg(rf.r) AS m, stddev_pop(rf.r) AS s, count(*) AS c, count(*) FILTER (rf.r >= of.r) AS b FROM rf JOIN of USING ({k}) WHERE perm > 0 GROUP BY ALL),
        gt AS (SELECT {k}, avg(rt.r) AS m, stddev_pop(rt.r) AS s, count(*) AS c, count(*) FILTER (abs(rt.r) >= abs(ot.r)) AS b FROM rt JOIN ot USING ({k}) WHERE perm > 0 GROUP BY ALL)
        SELECT {k}, of.n AS n_full, ot.n AS n_train, n_test, round(of.r, 5) AS r_full, round(r_train, 5) AS r_train, round(ot.r, 5) AS r_test, round((of.r - gf.m) / (gf.s + 1e-12), 5) AS z_full, round((1 + gf.b)::DOUBLE / (1 + gf.c), 5) AS p_full, round((ot.r - gt.m) / (gt.s + 1e-12), 5) AS z_test, round((1 + gt.b)::DOUBLE / (1 + gt.c), 5) AS p_test
        FROM of JOIN ot USING ({k}) JOIN gf USING ({k}) JOIN gt USING ({k})"""


_AGREE = with_("units") + """, b AS (SELECT unit_id, v AS w, list_transform(v, lambda x: round(x, 1)) AS c FROM units), n2 AS (SELECT unit_id, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12)) AS a, list_transform(w, lambda x: x / greatest(sqrt(list_dot_product(w, w)), 1e-12)) AS b FROM b),
        s AS (SELECT p.unit_id AS u, q.unit_id AS v, list_dot_product(p.a, q.a) AS sa, list_dot_product(p.b, q.b) AS sb FROM n2 p JOIN n2 q ON p.unit_id <> q.unit_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(sa, 12) DESC, v) AS pa, row_number() OVER (PARTITION BY u ORDER BY round(sb, 12) DESC, v) AS pb FROM s),
        e AS (SELECT *, max(sb) FILTER (pb = 6) OVER (PARTITION BY u) AS edge FROM k QUALIFY pa <= 6 OR pb <= 6), r AS (SELECT u, bool_and((pa <= 6) = (pb <= 6)) AS same, bool_and((pa <= 6) = (pb <= 6) OR abs(sb - edge) <= 1e-6) AS close, bool_and(pa = pb) AS ordered FROM e GROUP BY 1),
        sh AS (SELECT count(*) AS rows, avg((same OR close)::INT) AS sa, avg(same::INT) AS se, count(*) FILTER (close AND NOT same) AS tie, avg(ordered::INT) AS o FROM r)"""

ORACLE = {
    "biology_perm_test": "WITH " + _pool("x", "") + ",\n" + _dealt("(SELECT DISTINCT subject_id, label FROM xs)", "subject_id", "label", 200, 5) + ",\n" + _biology_null("x") + ", nl AS (SELECT * FROM xn), " + _OBS.format(same="la = lb", rows="xv") + "\n" + _STATS.format(kind="biology"),
    "patient_perm_test": "WITH " + _pool("x", "") + ",\n" + _dealt("xs", "sample_id", "subject_id", 200, 6) + ",\nnl AS (SELECT f.perm, round(avg(c) FILTER (f.l = g.l) - avg(c) FILTER (f.l <> g.l), 9) AS v FROM xp JOIN dealt f ON f.k = a JOIN dealt g ON g.k = b AND g.perm = f.perm GROUP BY 1), " + _OBS.format(same="sa = sb", rows="xp") + "\n" + _STATS.format(kind="patient"),
    "paired_perm_test": "WITH " + _pool("x", "[1:32]") + ",\n" + _pool("y", "[33:64]") + ",\n" + _dealt("(SELECT DISTINCT subject_id, label FROM xs)", "subject_id", "label", 200, 5) + ",\n" + _biology_null("x") + ", " + _biology_null("y") + """,
        o AS (SELECT (SELECT round(avg(c) FILTER (la = lb) - avg(c) FILTER (la <> lb), 9) FROM xv) - (SELECT round(avg(c) FILTER (la = lb) - avg(c) FILTER (la <> lb), 9) FROM yv) AS o), nl AS (SELECT xn.v - yn.v AS v FROM xn JOIN yn USING (perm))
        SELECT round(any_value(o), 4) AS observed, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, round((any_value(o) - avg(v)) / stddev_pop(v), 4) AS z, round((1 + count(*) FILTER (abs(v) >= abs(o)))::DOUBLE / (1 + count(*)), 4) AS p FROM nl, o""",
    "geometric_faithfulness": "WITH " + _pool("x", "[1:32]") + ",\n" + _pool("y", "[33:64]") + ",\n" + _dealt("xs", "sample_id", "sample_id", 100, 8) + """,
        rx AS (SELECT a, b, c, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1)::DOUBLE / 2 AS r FROM xp), ry AS (SELECT a, b, c, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1)::DOUBLE / 2 AS r FROM yp),
        o AS (SELECT count(*) AS n_pairs, round(corr(rx.r, ry.r), 9) AS rho, corr(rx.c, ry.c) AS pearson FROM rx JOIN ry USING (a, b)),
        nl AS (SELECT f.perm, round(corr(rx.r, ry.r), 9) AS v FROM ry JOIN dealt f ON f.k = ry.a JOIN dealt g ON g.k = ry.b AND g.perm = f.perm JOIN rx ON rx.a = least(f.l, g.l) AND rx.b = greatest(f.l, g.l) GROUP BY 1)
        SELECT round(any_value(rho), 4) AS observed, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, round((any_value(rho) - avg(v)) / stddev_pop(v), 4) AS z, round((1 + count(*) FILTER (v >= rho))::DOUBLE / (1 + count(*)), 4) AS p, any_value(n_pairs) AS n_pairs, round(any_value(pearson), 4) AS pearson FROM nl, o""",
    "morans_test": "WITH RECURSIVE " + SQL["spots"] + ", " + SQL["knn"] + """, z AS (SELECT sample_id, unit_id, value - avg(value) OVER (PARTITION BY sample_id) AS z, row_number() OVER (PARTITION BY sample_id ORDER BY unit_id) - 1 AS place, count(*) OVER (PARTITION BY sample_id) AS n FROM spots),
        """ + permute.sql("z", "sample_id", 20, 3, "pm") + """, dl AS (SELECT perm, pm.sample_id, o.unit_id, z.z FROM pm JOIN z ON z.sample_id = pm.sample_id AND z.place = partner JOIN z o ON o.sample_id = pm.sample_id AND o.place = pm.place), e AS (SELECT sample_id, unit_id, neighbour, 1.0::DOUBLE / count(*) OVER (PARTITION BY sample_id, unit_id) AS w FROM knn WHERE unit_id <> neighbour),
        c AS (SELECT f.perm, e.sample_id, sum(w * f.z * g.z) AS c, sum(w) AS s0 FROM e JOIN dl f ON f.sample_id = e.sample_id AND f.unit_id = e.unit_id JOIN dl g ON g.sample_id = e.sample_id AND g.unit_id = e.neighbour AND g.perm = f.perm GROUP BY 1, 2),
        zz AS (SELECT sample_id, sum(z * z) AS zz, count(*) AS n FROM z GROUP BY 1), i AS (SELECT perm, sample_id, n, n / s0 * c / zz AS i FROM c JOIN zz USING (sample_id)),
        g AS (SELECT sample_id, n, max(i) FILTER (perm = 0) AS moran, avg(i) FILTER (perm > 0) AS m, stddev_pop(i) FILTER (perm > 0) AS sd FROM i GROUP BY 1, 2), h AS (SELECT *, (moran - m) / sd AS z, 1 / (1 + 0.2316419::DOUBLE * abs((moran - m) / sd)) AS t FROM g),
        k AS (SELECT *, exp(-z * z / 2) / 2.5066282746310002::DOUBLE * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS tail FROM h)
        SELECT sample_id, n, round(moran, 5) AS moran, round(m, 5) AS null_mean, round(sd, 5) AS null_sd, round(CASE WHEN sd > 1e-9 THEN z ELSE 0 END, 5) AS z, round(CASE WHEN NOT sd > 1e-9 THEN 1 ELSE 2 * tail END, 5) AS p FROM k""",
    "ari_bootstrap": f"""WITH c AS (SELECT l_suppkey % 20 AS g, l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), pl AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS k FROM (SELECT DISTINCT g FROM c)),
        dr AS (SELECT rep, ('0x' || substr(md5('4:' || rep || ':' || i), 1, 8))::BIGINT % (SELECT max(k) FROM pl) AS place FROM range(1, 51) r(rep) CROSS JOIN range(0, 1000) q(i) WHERE i < (SELECT max(k) FROM pl)),
        w AS (SELECT rep, a, b, sum(n)::DOUBLE AS n FROM dr JOIN pl USING (place) JOIN c USING (g) GROUP BY 1, 2, 3), x AS (SELECT rep, sum({_TWO('n')}) AS sij FROM w GROUP BY 1),
        xa AS (SELECT rep, sum({_TWO('n')}) AS sa FROM (SELECT rep, a, sum(n) AS n FROM w GROUP BY 1, 2) GROUP BY 1), xb AS (SELECT rep, sum({_TWO('n')}) AS sb FROM (SELECT rep, b, sum(n) AS n FROM w GROUP BY 1, 2) GROUP BY 1), t AS (SELECT rep, {_TWO('sum(n)')} AS t FROM w GROUP BY 1)
        SELECT rep, round((sij - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t), 6) AS ari FROM x JOIN xa USING (rep) JOIN xb USING (rep) JOIN t USING (rep)""",
    "evidence_readers": _RES + """, per AS (SELECT method_id, sum(x) / count(*) * 10 AS auc, min(x) AS lo, max(x) AS hi FROM t WHERE view = 'z_he' GROUP BY 1), pt AS (SELECT method_id, y FROM t WHERE test = 'A' AND view = 'z_he'), gp AS (SELECT method_id, x FROM t WHERE test = 'N' AND view = 'z_he')
        SELECT 'auc_interval' AS reader, method_id, round(auc, 4) AS value, round(lo, 4) AS ci_lo, round(hi, 4) AS ci_hi, NULL AS source FROM per UNION ALL SELECT 'ratio_interval', method_id, round(auc / (hi + 1), 3), round(lo, 3), round(hi, 3), NULL FROM per
        UNION ALL SELECT 'coherence', coalesce(pt.method_id, gp.method_id), round(coalesce(y, x), 3), round(x - 0.1::DOUBLE, 3), round(x + 0.1::DOUBLE, 3), CASE WHEN y IS NOT NULL THEN 'table' ELSE 'intervals' END FROM pt FULL JOIN gp ON gp.method_id = pt.method_id
        UNION ALL SELECT 'raw_floor', method_id, round(max(s) FILTER (test = 'A' AND view = 'z_he') / max(s) FILTER (test = 'R' AND view = 'z_st'), 4), NULL, NULL, 'raw_he' FROM t GROUP BY 2 HAVING max(s) FILTER (test = 'A' AND view = 'z_he') IS NOT NULL AND max(s) FILTER (test = 'R' AND view = 'z_st') <> 0
        UNION ALL SELECT 'coherence_reference', method_id, round(y, 3), NULL, NULL, NULL FROM t WHERE test = 'A' AND view = 'z_st'
        UNION ALL SELECT 'significant_count', method_id, count(*) FILTER (p < 0.5), NULL, NULL, NULL FROM t WHERE view = 'z_he' AND testable GROUP BY 2
        UNION ALL SELECT 'signature_z', method_id, round(CASE WHEN p < 0.5 THEN s ELSE 0 END, 1), NULL, NULL, NULL FROM t WHERE view = 'z_he' AND test = 'N'""",
    "pathway_fdr": _RES + ", " + _bh("h", "t", "AND view = 'z_he' AND testable") + ", " + _bh("e", "t", "") + " SELECT method_id, view, test, testable, p, round(h.q, 6) AS q_headline, round(e.q, 6) AS q_all FROM t LEFT JOIN h USING (method_id, view, test) LEFT JOIN e USING (method_id, view, test)",
    "pathway_gate": _RES + """, c AS (SELECT s_suppkey AS method_id FROM supplier WHERE s_acctbal < 0) SELECT method_id, count(*) FILTER (testable) AS n_testable, count(*) FILTER (testable AND p < 0.5) AS n_significant, true AS same_split, method_id IN (SELECT method_id FROM c) AS circular,
        CASE WHEN method_id IN (SELECT method_id FROM c) THEN 'fail' ELSE 'pass' END AS status FROM t WHERE view = 'z_he' GROUP BY 1""",
    "capacity_gate": """WITH c AS (SELECT p_partkey, [CASE WHEN p_type <> 'SMALL' THEN {'resource': 'disk', 'fits': p_size < 45} END, CASE WHEN p_type <> 'LARGE' THEN {'resource': 'memory', 'fits': p_size::DOUBLE / 2 < 16} END, CASE WHEN p_type <> 'PROMO' THEN {'resource': 'walltime', 'fits': p_retailprice / 100 < 10} END] AS c FROM part),
        l AS (SELECT array_to_string([x.resource FOR x IN c IF x IS NOT NULL AND NOT x.fits], ',') AS blocked_by, array_to_string([r FOR r IN ['disk', 'memory'] IF NOT list_contains([x.resource FOR x IN c IF x IS NOT NULL], r)], ',') AS not_checked, len([x FOR x IN c IF x IS NOT NULL]) AS checks FROM c)
        SELECT CASE WHEN blocked_by = '' THEN 'fits' ELSE 'does_not_fit' END AS verdict, blocked_by, not_checked, checks, count(*) AS n FROM l GROUP BY 1, 2, 3, 4""",
    "ablation_pairs": """WITH n AS (SELECT s_suppkey AS w, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS o FROM supplier) SELECT w AS with_id, o AS without_id, 0 AS task_id, 0 AS axis, round(a.s_acctbal - b.s_acctbal, 6) AS delta,
        a.s_acctbal - 2000 > b.s_acctbal + 2000 OR b.s_acctbal - 2000 > a.s_acctbal + 2000 AS separated FROM n JOIN supplier a ON a.s_suppkey = w JOIN supplier b ON b.s_suppkey = o""",
    "encoder_fit": """WITH e AS (SELECT p_partkey AS encoder, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'he' ELSE 'st' END AS modality, CASE WHEN p_size % 10 <> 3 THEN p_size * 4.0::DOUBLE END AS footprint, CASE WHEN p_size % 2 = 0 THEN ['BUILDING', 'MACHINERY'] ELSE ['FURNITURE'] END AS classes, p_size % 7 <> 5 AS expects FROM part WHERE p_size % 13 <> 4),
        d AS (SELECT p_partkey AS encoder FROM part), s AS (SELECT c_nationkey AS platform, count(*) AS n_samples FROM customer GROUP BY 1),
        p AS (SELECT n_nationkey AS platform, CASE WHEN n_regionkey <> 1 THEN 20.0::DOUBLE + 3 * n_nationkey END AS tile, CASE n_regionkey WHEN 0 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' WHEN 3 THEN 'AUTOMOBILE' WHEN 4 THEN 'MACHINERY' END AS class FROM nation),
        f AS (SELECT d.encoder, modality, expects, footprint, classes, platform, tile, class FROM d LEFT JOIN e USING (encoder) LEFT JOIN p ON e.expects),
        r AS (SELECT encoder, platform, CASE WHEN modality IS NULL THEN 'undeclared_encoder' WHEN NOT expects THEN 'encoder_states_none' WHEN modality = 'he' THEN CASE WHEN tile IS NULL THEN 'not_stated' WHEN footprint IS NULL THEN 'encoder_states_none' ELSE 'comparable' END
              ELSE CASE WHEN class IS NULL THEN 'not_stated' WHEN list_contains(classes, class) THEN 'in_class' ELSE 'out_of_class' END END AS relation, tile / footprint AS q FROM f)
        SELECT encoder, r.platform, n_samples, relation, CASE WHEN relation = 'comparable' THEN round(q, 3) END AS ratio, CASE WHEN relation = 'comparable' THEN CASE WHEN q < 1 THEN round((1 - q) * 100, 1) ELSE 0 END END AS shortfall_pct FROM r LEFT JOIN s ON s.platform = r.platform""",
    "task_families": "SELECT n_nationkey AS task_id, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) AS routable FROM nation",
    "carry_per_unit": "SELECT d.doc_id AS unit_id, quality, CASE WHEN quality = 1 THEN toxic END AS toxic, quality IS NOT NULL AS quality__present, CASE WHEN quality = 1 THEN toxic END IS NOT NULL AS toxic__present FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "patient_split": """WITH s AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
        SELECT c_custkey AS subject_id, c_mktsegment AS stratum, CASE WHEN i <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM s""",
    "dominant_class": """WITH f AS (SELECT l_orderkey, avg((l_returnflag = 'A')::INT) AS a, avg((l_returnflag = 'N')::INT) AS n, avg((l_returnflag = 'R')::INT) AS r FROM lineitem GROUP BY 1)
        SELECT CASE WHEN greatest(a, n, r) < 0.5 THEN 'mixed' WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS label, count(*) AS n FROM f GROUP BY 1""",
    "parsed_keys": """WITH p AS (SELECT CASE WHEN p_size > 25 THEN p_type END AS suffix, CASE WHEN p_size > 40 THEN 'true' WHEN p_size > 10 THEN 'false' END AS yes, 'runs/' || p_type AS pre FROM part)
        SELECT suffix, yes, pre || '/' || r_name || '.json' AS file, r_name AS run, count(*) AS n FROM p CROSS JOIN region GROUP BY 1, 2, 3, 4 UNION ALL SELECT suffix, yes, 'table.tsv', NULL, count(*) FROM p GROUP BY 1, 2""",
    "slice_difference": with_("units") + """, b AS (SELECT unit_id, v, CASE WHEN label = 5 THEN list_transform(v, lambda x: x * 1.5) ELSE list_transform(v, lambda x: x + 0.25) END AS w FROM units WHERE label <> 3),
        n AS (SELECT *, sqrt(list_dot_product(v, v)) AS nv, sqrt(list_dot_product(w, w)) AS nw, [abs(v[i] - w[i]) FOR i IN range(1, 65)] AS m FROM b)
        SELECT count(*) AS rows, 0 AS only_computed, (SELECT count(*) FROM units WHERE NOT coalesce(label <> 3, false)) AS only_cached, round(max(list_max(m)), 6) AS max_abs, round(sum(list_sum(m)) / (64 * count(*)), 6) AS mean_abs, round(max(list_max(m) / greatest(nv, 1e-12)), 6) AS max_rel,
               round(min(list_dot_product(v, w) / greatest(nv * nw, 1e-12)), 6) AS min_cosine, round(avg(list_dot_product(v, w) / greatest(nv * nw, 1e-12)), 6) AS mean_cosine FROM n""",
    "cka_bootstrap": with_("units") + """, p AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS place, list_concat(v[1:3], v[33:35]) AS x FROM units), m AS (SELECT i, avg(x[i]) AS m FROM p CROSS JOIN range(1, 7) t(i) GROUP BY 1),
        c AS (SELECT place, i, x[i] - m AS z FROM p CROSS JOIN m), w AS (SELECT place, rep::INT AS rep, """ + permute.poisson_sql("place", "rep", 2) + """ AS w FROM p CROSS JOIN range(1, 31) t(rep)),
        g AS (SELECT rep, a.i, b.i AS j, sum(w * a.z * b.z) AS c FROM w JOIN c a USING (place) JOIN c b USING (place) GROUP BY 1, 2, 3)
        SELECT rep, round(sum(c * c) FILTER (i <= 3 AND j > 3) / (sqrt(sum(c * c) FILTER (i <= 3 AND j <= 3)) * sqrt(sum(c * c) FILTER (i > 3 AND j > 3)) + 1e-12), 6) AS value FROM g GROUP BY 1""",
    "cca_cells": _cells(),
    "neighbour_agreement": _AGREE + " SELECT rows, round(sa, 6) AS set_agreement, round(se, 6) AS set_exact, tie AS by_tie, round(o, 6) AS ordered FROM sh",
    "slice_acceptance": _AGREE + """, d AS (SELECT unit_id, v, list_transform(v, lambda x: round(x, 1)) AS w FROM units), x AS (SELECT max(list_max([abs(v[i] - w[i]) FOR i IN range(1, 65)]) / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS rel, min(list_dot_product(v, w) / greatest(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)), 1e-12)) AS c FROM d),
        t AS (SELECT rel <= g.a AND x.c >= g.b AND sa >= g.c AS accepted, concat_ws(',', CASE WHEN NOT rel <= g.a THEN 'drift' END, CASE WHEN NOT x.c >= g.b THEN 'cosine' END, CASE WHEN NOT sa >= g.c THEN 'neighbours' END) AS failed, g.rule FROM x, sh, (VALUES ('strict', 1e-5, 1 - 1e-6, 0.999), ('loose', 1, 0.5, 0)) g(rule, a, b, c)) SELECT rule, accepted, failed FROM t""",
    "attention_profile": with_("units") + "SELECT label, i - 1 AS pos, count(v[i]) AS n, round(avg(v[i]), 6) AS mean, round(stddev_samp(v[i]), 6) AS std FROM units CROSS JOIN range(1, 8) r(i) GROUP BY 1, 2",
    "projection_profile": with_("units") + ", g AS (SELECT label, count(*) AS n, avg(round(v[1] + v[2], 9)) AS m, stddev_samp(round(v[1] + v[2], 9)) AS s FROM units GROUP BY 1) SELECT label, n, round(m, 6) AS mean, round(s, 6) AS std, row_number() OVER (ORDER BY abs(m) DESC, label) AS pos FROM g",
    "section_status": """WITH g AS (SELECT p_brand || (p_size <= 5)::INT AS check_id, count(*) AS sections, count(*) FILTER (p_size > 5) AS measured, count(*) FILTER (p_size > 15) AS passed FROM part GROUP BY 1)
        SELECT *, CASE WHEN measured = 0 THEN 'not_applicable' WHEN passed = measured THEN 'pass' ELSE 'fail' END AS status, 'all' AS rule FROM g UNION ALL SELECT *, CASE WHEN measured = 0 THEN 'not_applicable' WHEN passed >= measured * 0.75 THEN 'pass' ELSE 'fail' END, 'fraction' FROM g""",
    "ordered_trace": """WITH g AS (SELECT event_type AS step, min(event_id) AS f, count(*) AS n, round(sum(CASE WHEN value < 9 THEN value END), 4) AS duration, count(*) FILTER (NOT coalesce(value < 9, false)) AS untimed FROM events GROUP BY 1) SELECT step, n, duration, untimed, row_number() OVER (ORDER BY f, step) AS place FROM g""",
    "loaded_features": with_("units") + "SELECT unit_id AS unit, round(sqrt(list_dot_product(v[1:4], v[1:4])), 6) AS norm, CASE WHEN label = 2 THEN 0.5 ELSE 0.25 END::DOUBLE AS w0, 4::BIGINT AS width FROM units WHERE label IS DISTINCT FROM 4",
}
