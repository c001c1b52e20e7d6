"""Queries of the annotation, network, mixture, decomposition and plot operators, with SQL oracles where SQL can say it."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from sparkmat import functions as X
from sparkmat.operators import annotation as A
from sparkmat.operators import decomposition as D
from sparkmat.operators import matrix as M
from sparkmat.operators import mixture as U
from sparkmat.operators import network as N
from sparkmat.operators import plotdata as P
from sparkmat.operators.communities import cluster_network
from sparkmat.plans.tables import CELLS, EDGES, MATRIX, groups, matrix, table, whole_graph

_ND = NormalDist()


def _markers(s):
    return s.range(20).select((F.col("id") % 4).alias("label"), F.col("id").alias("gene"), F.lit(1.0).alias("weight"))


_M = "M AS (SELECT gene % 4 AS label, gene, 1.0 AS weight FROM range(20) t(gene))"


def _group_scores(s, d):
    return M.aggregate(matrix(s, d), groups(s, d)).select("grp", "gene", F.col("sum_value").alias("score"))


_SCORES = f"{MATRIX}, {CELLS}, SC AS (SELECT grp, gene, sum(value) AS score FROM X JOIN C ON C.cell = X.cell GROUP BY 1, 2)"
_ENRICH = f"""{_SCORES}, {_M}, T AS (SELECT label, count(*) AS size FROM M GROUP BY 1), RK AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, gene) AS pos, count(*) OVER (PARTITION BY grp) AS n FROM SC),
    HT AS (SELECT grp, label, pos, n, size, row_number() OVER (PARTITION BY grp, label ORDER BY pos) - pos * size * 1.0 / n AS lam, pos * size * 1.0 / n * (1 - size * 1.0 / n) AS v FROM RK JOIN M USING (gene) JOIN T USING (label)),
    LP AS (SELECT *, round(CASE WHEN lam > 0 THEN lam * lam / (2 * (v + lam / 3)) / ln(10.0) ELSE 0 END, 9) AS value FROM HT),
    EN AS (SELECT grp, label, value AS log_p, pos AS threshold FROM LP QUALIFY row_number() OVER (PARTITION BY grp, label ORDER BY value DESC, pos) = 1)"""


def _members(s, d):
    return groups(s, d).select("cell", F.explode(F.array(F.struct((F.col("cell") % 3).alias("comp"), F.lit(0.75).alias("weight")), F.struct(((F.col("cell") + 1) % 3).alias("comp"), F.lit(0.25).alias("weight")))).alias("m")).select("cell", "m.*")


_H = "H AS (SELECT cell, cell % 3 AS comp, 0.75 AS weight FROM C UNION ALL SELECT cell, (cell + 1) % 3, 0.25 FROM C)"
_ARCH = f"""WITH {MATRIX}, {CELLS}, {_H}, HN AS (SELECT cell, comp, weight / sum(weight) OVER (PARTITION BY comp) AS h FROM H), Q AS (SELECT cell, count(*) / 50.0 AS q FROM X GROUP BY 1), MQ AS (SELECT sum(q) / (SELECT count(*) FROM C) AS mq FROM Q),
    GA AS (SELECT comp, sum(g) AS g1, sum(g * g) AS g2, max(g) AS gm FROM (SELECT comp, h * q / mq AS g FROM HN JOIN Q USING (cell) CROSS JOIN MQ) GROUP BY 1),
    GE AS (SELECT gene, count(*) * 1.0 / (SELECT count(*) FROM C) AS p, avg(value) AS r FROM X GROUP BY 1), O AS (SELECT comp, gene, sum(value * h) AS profile FROM X JOIN HN USING (cell) GROUP BY 1, 2),
    L AS (SELECT comp, gene, profile, profile - p * r * g1 AS lam, p * r * r * g2 AS nu, r * gm AS a FROM O JOIN GE USING (gene) JOIN GA USING (comp))
    SELECT comp, gene, round(profile, 6) AS profile, round(CASE WHEN lam > 0 THEN lam * lam / (2 * (nu + lam * a / 3)) / ln(10.0) ELSE 0 END, 6) AS upper, round(CASE WHEN lam < 0 THEN lam * lam / (2 * nu) / ln(10.0) ELSE 0 END, 6) AS lower FROM L"""


def _archetype_profile(s):
    return s.range(150).select((F.col("id") % 3).alias("comp"), F.floor(F.col("id") / 3).alias("gene"), (F.col("id") % 11 - 4).cast("double").alias("value"))


def _diffused(rounds: int, alpha: float) -> str:
    """The columns of genes 1, 2 and 3, cells as the graph's suppliers, symmetric normalisation."""
    parts = [MATRIX, EDGES, "X0 AS (SELECT 2 * cell AS node, gene AS label, value FROM X WHERE gene IN (1, 2, 3))", "P AS (SELECT src, dst, weight / sqrt(sum(weight) OVER (PARTITION BY src) * sum(weight) OVER (PARTITION BY dst)) AS weight FROM G)"]
    for i in range(rounds):
        parts.append(f"X{i + 1} AS (SELECT node, label, {alpha} * coalesce(m, 0) + {1 - alpha} * coalesce(X0.value, 0) AS value FROM X0 FULL JOIN (SELECT src AS node, label, sum(weight * value) AS m FROM P JOIN X{i} ON dst = node GROUP BY 1, 2) USING (node, label))")
    parts += [f"TOP AS (SELECT label, max(value) AS hi FROM X{rounds} GROUP BY 1)", "WAS AS (SELECT label, max(value) AS was FROM X0 GROUP BY 1)"]
    return f"WITH {', '.join(parts)} SELECT node AS cell, label AS gene, round(greatest(value * CASE WHEN hi > 0 THEN was / hi ELSE 1 END, 0), 6) AS value FROM X{rounds} JOIN TOP USING (label) JOIN WAS USING (label)"


def _impute_diffusion(s, d):
    x = matrix(s, d).withColumn("cell", 2 * F.col("cell"))
    return A.impute_diffusion(x, [1, 2, 3], whole_graph(s, d), 0.85, 3)


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("vec"))


_NN = """V AS (SELECT vec_id AS cell, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), U AS (SELECT cell, v, sqrt(list_inner_product(v, v)) AS n FROM V),
    ND AS (SELECT a.cell AS src, b.cell AS dst, 1 - list_inner_product(a.v, b.v) / (a.n * b.n) AS distance FROM U a JOIN U b ON a.cell <> b.cell),
    NK AS (SELECT * FROM ND QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(distance, 12), dst) <= 10)"""
_KSTAR = f"""WITH {_NN.replace("<= 10", "<= (SELECT floor(5 * sqrt(count(*))) FROM V)")}, B AS (SELECT *, row_number() OVER w AS k, sum(distance) OVER (w ROWS UNBOUNDED PRECEDING) AS s, sum(distance * distance) OVER (w ROWS UNBOUNDED PRECEDING) AS q, lead(distance) OVER w AS nx FROM NK WINDOW w AS (PARTITION BY src ORDER BY round(distance, 12), dst)),
    L AS (SELECT *, (s + sqrt(greatest(k + s * s - k * q, 0))) / k AS lam FROM B), ST AS (SELECT src, k AS ks, lam AS ls FROM L WHERE nx IS NULL OR lam <= nx QUALIFY row_number() OVER (PARTITION BY src ORDER BY k) = 1),
    W AS (SELECT src, dst, greatest(ls - distance, 0) AS w FROM L JOIN ST USING (src) WHERE k <= ks) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS weight FROM W"""


def _pagerank_sql(rounds: int, alpha: float) -> str:
    parts = [EDGES, "S AS (SELECT src AS node, 1.0 / count(*) OVER () AS value FROM (SELECT DISTINCT src FROM G))", "P AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM G)", "X0 AS (SELECT * FROM S)"]
    for i in range(rounds):
        parts.append(f"X{i + 1} AS (SELECT node, {alpha} * coalesce(m, 0) + {1 - alpha:.6f} * S.value AS value FROM S LEFT JOIN (SELECT src AS node, sum(weight * value) AS m FROM P JOIN X{i} ON dst = node GROUP BY 1) USING (node))")
    return f"WITH {', '.join(parts)} SELECT node, round(value, 6) AS value FROM X{rounds}"


def _labels(g):
    return N.nodes(g).withColumn("label", F.col("node") % 3)


def _fits(s, d):
    n = F.col("n_nationkey")
    return table(s, d, "nation").select(n.cast("long").alias("guide"), F.array(F.lit(0.6), F.lit(0.4)).alias("weights"), F.array(n * 0.01, n * 0.01 + 1).alias("means"), F.lit(0.2).alias("sigma"), F.lit(0.0).alias("log_likelihood"), F.lit(10).cast("long").alias("n_points"), F.when(n == 7, 1).otherwise(0).alias("status"))


_FIT = "FI AS (SELECT CAST(n_nationkey AS BIGINT) AS guide, n_nationkey * 0.01::DOUBLE AS m0, n_nationkey * 0.01::DOUBLE + 1 AS m1, CAST(0.2 AS DOUBLE) AS s, n_nationkey <> 7 AS ok FROM nation)"
_NAN = "CAST('NaN' AS DOUBLE)"


def _guides(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 25).alias("guide")).agg(F.sum("l_quantity").alias("value"))


_GUIDES = "GX AS (SELECT l_suppkey AS cell, l_partkey % 25 AS guide, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
_NEG, _POS = f"m0 + s * {_ND.inv_cdf(0.99)!r}", f"m1 + s * {_ND.inv_cdf(0.01)!r}"


def _points(s, d):
    return table(s, d, "part").select(F.col("p_brand").alias("label"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def _events(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("grp"), "value", "event_id")


def _loadings(s, d):
    return D.run_svd(matrix(s, d), 5).gene_table()


def _reduced(s, d, f):
    return f.reduction().select("cell", F.posexplode("vec").alias("comp", "value"))


def smoothed(start: str, rounds: int, alpha: float, label: str, code: int = 0) -> list[str]:
    """CTEs that diffuse D0 (node, label, value) over G."""
    by = {0: "sum(weight) OVER (PARTITION BY dst)", 2: "sqrt(sum(weight) OVER (PARTITION BY src) * sum(weight) OVER (PARTITION BY dst))"}[code]
    parts = [f"D0 AS ({start})", f"P AS MATERIALIZED (SELECT src, dst, weight / {by} AS weight FROM G)"]
    for i in range(rounds):
        parts.append(f"D{i + 1} AS MATERIALIZED (SELECT node, {label}, {alpha} * coalesce(m, 0) + {1 - alpha:.6f} * coalesce(D0.value, 0) AS value FROM D0 FULL JOIN (SELECT src AS node, {label}, sum(weight * value) AS m FROM P JOIN D{i} ON dst = node GROUP BY 1, 2) USING (node, {label}))")
    return parts


def _coreness_sql(edges: str, rounds: int = 40) -> str:
    parts = [EDGES, edges, "H0 AS MATERIALIZED (SELECT src AS node, count(*) AS core FROM E GROUP BY 1)"]
    for i in range(rounds):
        parts.append(f"H{i + 1} AS MATERIALIZED (SELECT src AS node, max(least(r, core)) AS core FROM (SELECT src, core, row_number() OVER (PARTITION BY src ORDER BY core DESC) AS r FROM E JOIN H{i} ON dst = node) GROUP BY 1)")
    return f"WITH {', '.join(parts)} SELECT node, CAST(coalesce(core, 0) AS BIGINT) AS coreness FROM (SELECT DISTINCT src AS node FROM E0_NODES) LEFT JOIN H{rounds} USING (node)"


def _local_pagerank_sql(rounds: int = 5, alpha: float = 0.9) -> str:
    parts = [EDGES, *smoothed("SELECT node, node % 3 AS label, 1.0 / count(*) OVER (PARTITION BY node % 3) AS value FROM (SELECT DISTINCT src AS node FROM G)", rounds, alpha, "label")]
    return f"WITH {', '.join(parts)} SELECT node, round(max(value / top), 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY label) AS top FROM D{rounds}) GROUP BY 1"


def _propagation_sql(rounds: int = 3) -> str:
    parts = [EDGES, "B0 AS MATERIALIZED (SELECT src AS node, src % 3 AS label FROM G GROUP BY 1)", "EE AS MATERIALIZED (SELECT * FROM G UNION ALL SELECT node, node, 1.0 FROM B0)", "RW AS MATERIALIZED (SELECT src, sum(weight) AS w1, sum(weight * weight) AS w2, max(weight) AS a FROM EE GROUP BY 1)"]
    for i in range(rounds):
        parts += [
            f"PR{i} AS (SELECT label, count(*) * 1.0 / (SELECT count(*) FROM B0) AS p FROM B{i} GROUP BY 1)",
            f"OB{i} AS (SELECT src, label, sum(weight) AS obs FROM EE JOIN B{i} ON dst = node GROUP BY 1, 2)",
            f"SR{i} AS (SELECT src AS node, label AS best, round(CASE WHEN obs - w1 * p > 0 THEN (obs - w1 * p) * (obs - w1 * p) / (2 * (w2 * p + (obs - w1 * p) * a / 3)) ELSE 0 END, 9) AS score FROM OB{i} JOIN RW USING (src) JOIN PR{i} USING (label))",
            f"TB{i} AS (SELECT * FROM SR{i} QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, best) = 1)",
            f"B{i + 1} AS MATERIALIZED (SELECT node, CASE WHEN score > 3 THEN best ELSE label END AS label FROM B{i} LEFT JOIN TB{i} USING (node))",
        ]
    return f"WITH {', '.join(parts)} SELECT node, label FROM B{rounds}"


#: name -> (query, oracle or None)
ALL = {
    "encode_markers": (
        lambda s, d: A.encode_markers(table(s, d, "part").select(F.col("p_brand").alias("label"), F.col("p_name").alias("name")), table(s, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))),
        "SELECT DISTINCT p_brand AS label, f.gene, CAST(1.0 AS DOUBLE) AS weight FROM part JOIN (SELECT p_name, min(p_partkey) AS gene FROM part GROUP BY 1) f USING (p_name)",
    ),
    "vision_stats": (
        lambda s, d: A.vision_stats(matrix(s, d), _markers(s), 50),
        f"WITH {MATRIX}, {_M}, R AS (SELECT cell, sum(value) / 50 AS mu, (sum(value * value) - sum(value) * sum(value) / 50) / 49 AS v FROM X GROUP BY 1), T AS (SELECT label, sum(weight) AS m FROM M GROUP BY 1), S AS (SELECT cell, label, sum(value) AS s FROM X JOIN M USING (gene) GROUP BY 1, 2) SELECT cell, label, round(CASE WHEN v > 0 THEN (coalesce(s, 0) - mu * m) / sqrt(v * m) ELSE 0 END, 6) AS value FROM R CROSS JOIN T LEFT JOIN S USING (cell, label)",
    ),
    "assess_enrichment": (lambda s, d: A.assess_enrichment(_group_scores(s, d), _markers(s)), f"WITH {_ENRICH} SELECT grp, label, round(log_p, 6) AS log_p, threshold FROM EN"),
    "annotate_clusters": (lambda s, d: A.annotate_clusters(_group_scores(s, d).withColumnRenamed("score", "upper"), _markers(s)), f"WITH {_ENRICH} SELECT grp, label, round(log_p, 6) AS confidence FROM EN QUALIFY row_number() OVER (PARTITION BY grp ORDER BY log_p DESC, label) = 1"),
    "archetype_specificity": (lambda s, d: A.archetype_specificity(matrix(s, d), _members(s, d), groups(s, d).count(), 50), _ARCH),
    "impute_archetypes": (lambda s, d: A.impute_archetypes(_members(s, d), _archetype_profile(s)), f"WITH {CELLS}, {_H}, Z AS (SELECT i % 3 AS comp, i // 3 AS gene, i % 11 - 4 AS value FROM range(150) t(i)) SELECT cell, gene, round(CAST(greatest(sum(weight * value), 0) AS DOUBLE), 6) AS value FROM H JOIN Z USING (comp) GROUP BY 1, 2"),
    "impute_diffusion": (_impute_diffusion, _diffused(3, 0.85)),
    "nearest_neighbours_exact": (lambda s, d: N.neighbours(_vectors(s, d), 10, "ip"), f"WITH {_NN} SELECT src, dst, round(distance, 6) AS distance FROM NK"),
    "build_network_knn": (lambda s, d: N.knn_network(_vectors(s, d), 10, "ip"), f"WITH {_NN}, W AS (SELECT src, dst, 1 - distance / max(distance) OVER () AS w FROM NK) SELECT a.src, a.dst, round(sqrt(a.w * b.w), 6) AS weight FROM W a JOIN W b ON a.src = b.dst AND a.dst = b.src"),
    "build_network_kstar": (lambda s, d: N.kstar_network(_vectors(s, d), metric="ip", mutual=False), _KSTAR),
    "pagerank": (lambda s, d: N.pagerank(whole_graph(s, d)), _pagerank_sql(5, 0.9)),
    "cluster_network": (lambda s, d: cluster_network(N.knn_network(_vectors(s, d), 10, "ip")), None),
    "modularity": (lambda s, d: N.modularity(g := whole_graph(s, d), _labels(g)), f"WITH {EDGES}, T AS (SELECT sum(weight) AS t FROM G), K AS (SELECT sum(k * k) AS kk FROM (SELECT src % 3 AS l, sum(weight) AS k FROM G GROUP BY 1)) SELECT round((SELECT sum(weight) FROM G WHERE src % 3 = dst % 3) / t - kk / t / t, 6) AS modularity FROM T, K"),
    "coreness": (lambda s, d: N.coreness(whole_graph(s, d)), _coreness_sql("E AS MATERIALIZED (SELECT src, dst FROM G)").replace("E0_NODES", "G")),
    "local_coreness": (lambda s, d: N.local_coreness(g := whole_graph(s, d), N.nodes(g).withColumn("label", F.col("node") % 3)), _coreness_sql("E AS MATERIALIZED (SELECT src, dst FROM G WHERE src % 3 = dst % 3)").replace("E0_NODES", "E")),
    "local_pagerank": (lambda s, d: N.local_pagerank(g := whole_graph(s, d), N.nodes(g).withColumn("label", F.col("node") % 3)), _local_pagerank_sql()),
    "label_propagation": (lambda s, d: N.propagate_labels(g := whole_graph(s, d), N.nodes(g).withColumn("label", F.col("node") % 3)), _propagation_sql()),
    "layout_network": (lambda s, d: N.layout(g := whole_graph(s, d), N.nodes(g).select("node", (F.col("node") % 7).cast("double").alias("x"), (F.col("node") % 5).cast("double").alias("y")), 10), None),
    "match_by_rank": (
        lambda s, d: N.match_by_rank(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value")), table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))),
        "SELECT u, v, rank FROM (SELECT s_suppkey AS u, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier WHERE s_acctbal > 0) JOIN (SELECT c_custkey AS v, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE c_acctbal > 0) USING (rank)",
    ),
    "fit_guides": (lambda s, d: U.fit_guides(_guides(s, d)).select("guide", "n_points", "status", "sigma"), None),
    "guide_thresholds": (lambda s, d: U.thresholds(_fits(s, d)), f"WITH {_FIT} SELECT guide, CASE WHEN ok THEN round(pow(10, {_NEG}) - 1, 6) ELSE {_NAN} END AS neg, CASE WHEN ok THEN round(pow(10, {_POS}) - 1, 6) ELSE {_NAN} END AS pos FROM FI"),
    "guide_thresholds_equal": (lambda s, d: U.thresholds(_fits(s, d), "equal_density", scale="transformed"), f"WITH {_FIT} SELECT guide, CASE WHEN ok THEN round((m0 + m1) / 2 + s * s * ln(1.5) / (m1 - m0), 6) ELSE {_NAN} END AS neg, neg AS pos FROM FI"),
    "guide_thresholds_valley": (
        lambda s, d: U.thresholds(_fits(s, d), "valley", scale="transformed"),
        f"WITH {_FIT}, D AS (SELECT guide, ok, m0 + (m1 - m0) * i / 255 AS v, 0.6 * exp(-pow((m1 - m0) * i / 255, 2) / (2 * s * s)) + 0.4 * exp(-pow((m1 - m0) * (1 - i / 255), 2) / (2 * s * s)) AS d FROM FI, range(256) t(i)) SELECT guide, CASE WHEN ok THEN round(v, 6) ELSE {_NAN} END AS neg, neg AS pos FROM D QUALIFY row_number() OVER (PARTITION BY guide ORDER BY d, v) = 1",
    ),
    "guide_sweep": (lambda s, d: U.sweep(_fits(s, d), [0.9, 0.99], [0.05]), f"WITH {_FIT}, Q AS (SELECT * FROM (VALUES ('neg', CAST(0.9 AS DOUBLE), CAST({_ND.inv_cdf(0.9)!r} AS DOUBLE)), ('neg', 0.99, {_ND.inv_cdf(0.99)!r}), ('pos', 0.05, {_ND.inv_cdf(0.05)!r})) t(side, quantile, z)) SELECT guide, side, quantile, CASE WHEN ok THEN round(pow(10, CASE side WHEN 'neg' THEN m0 ELSE m1 END + s * z) - 1, 6) ELSE {_NAN} END AS threshold FROM FI, Q"),
    "guide_calls": (lambda s, d: U.apply_thresholds(_guides(s, d), U.thresholds(_fits(s, d))), f"WITH {_FIT}, {_GUIDES} SELECT cell, guide, CASE WHEN ok THEN CAST(value > pow(10, {_NEG}) - 1 AS INT) ELSE 0 END AS background, CASE WHEN ok THEN CAST(value > pow(10, {_POS}) - 1 AS INT) ELSE 0 END AS foreground FROM GX JOIN FI USING (guide)"),
    "run_svd": (_loadings, None),
    "reduce_kernel": (lambda s, d: _reduced(s, d, D.reduce_kernel(matrix(s, d), 5)), None),
    "correct_batch_effect": (lambda s, d: _reduced(s, d, D.correct_batch(x := matrix(s, d), D.reduce_kernel(x, 5), groups(s, d).select("cell", (F.col("grp") % 3).alias("batch")))), None),
    "correct_basal_expression": (lambda s, d: _reduced(s, d, D.correct_basal(x := matrix(s, d), D.reduce_kernel(x, 5), [1, 2, 3])), None),
    "run_action": (lambda s, d: D.run_action(_vectors(s, d), 2, 4, 5).select("cell", "assigned", F.array_max("vec").alias("weight")), None),
    "label_positions": (lambda s, d: P.label_positions(_points(s, d)), "SELECT p_brand AS label, CAST(median(p_size) AS DOUBLE) AS x, round(median(p_retailprice), 6) AS y FROM part GROUP BY 1"),
    "transparency": (
        lambda s, d: P.transparency(_events(s, d)).select("event_id", "alpha"),
        "WITH Z AS (SELECT event_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events) SELECT event_id, round(CASE WHEN z > -0.5 THEN 1.0 ELSE pow(1 / (1 + exp(-1.5 * (z + 0.5))), 1.5) END, 6) AS alpha FROM Z",
    ),
    "sort_categories": (lambda s, d: P.sort_categories(table(s, d, "part"), "p_size"), "SELECT CAST(p_size AS VARCHAR) AS category, row_number() OVER (ORDER BY p_size) AS place FROM (SELECT DISTINCT p_size FROM part)"),
    "palette": (lambda s, d: P.palette(P.sort_categories(table(s, d, "part"), "p_type"), ["#111111", "#222222", "#333333"]), "SELECT p_type AS category, ['#111111', '#222222', '#333333'][(row_number() OVER (ORDER BY p_type) - 1) % 3 + 1] AS color FROM (SELECT DISTINCT p_type FROM part)"),
    "box_statistics": (
        lambda s, d: P.box_statistics(_events(s, d)),
        "WITH Q AS (SELECT event_type AS grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1), I AS (SELECT Q.*, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS i FROM events JOIN Q ON grp = event_type) SELECT grp, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(value) FILTER (i), 6) AS low, round(max(value) FILTER (i), 6) AS high, count(*) FILTER (NOT i) AS n_out FROM I GROUP BY ALL",
    ),
    "log_and_raw": (lambda s, d: matrix(s, d).select("cell", "gene", X.log_of(F.col("value"), "log10").alias("log"), X.to_raw(X.log_of(F.col("value"), "log10")).alias("raw")), f"WITH {MATRIX} SELECT cell, gene, round(log10(CASE WHEN value = 0 THEN 1 ELSE value END), 6) AS log, round(pow(10, log10(CASE WHEN value = 0 THEN 1 ELSE value END)) - 1, 6) AS raw FROM X"),
    "aggregate_annotated": (
        lambda s, d: M.aggregate_annotated(matrix(s, d), groups(s, d).select("cell", (F.col("grp") % 2).alias("half"), (F.col("cell") % 2).alias("odd")), ["half", "odd"], 2),
        f"WITH {MATRIX}, C AS (SELECT s_suppkey AS cell, s_nationkey % 2 || '_' || s_suppkey % 2 AS grp FROM supplier), Z AS (SELECT grp, count(*) AS n FROM C GROUP BY 1 HAVING count(*) >= 2) SELECT grp, gene, sum(value) AS sum_value, round(sum(value) / max(n), 6) AS mean_value, round((sum(value * value) - sum(value) * sum(value) / max(n)) / (max(n) - 1), 6) AS var_value, count(*) AS nnz, max(n) AS n_obs FROM X JOIN C USING (cell) JOIN Z USING (grp) GROUP BY 1, 2",
    ),
    "scale_by": (lambda s, d: M.scale_by(matrix(s, d), s.range(50).select(F.col("id").alias("gene"), (F.col("id") + 1).cast("double").alias("factor")), "gene"), f"WITH {MATRIX} SELECT cell, gene, value * (gene + 1) AS value FROM X"),
    "take_rows": (lambda s, d: M.take(matrix(s, d), s.range(12).select(F.col("id").alias("pos"), (F.col("id") * 3 % 10 + 1).alias("cell"))), f"WITH {MATRIX} SELECT i AS cell, gene, value FROM X JOIN range(12) t(i) ON cell = i * 3 % 10 + 1"),
    "one_hot": (lambda s, d: M.one_hot(groups(s, d)), f"WITH {CELLS} SELECT cell, dense_rank() OVER (ORDER BY grp) - 1 AS comp, CAST(1.0 AS DOUBLE) AS weight FROM C"),
}
