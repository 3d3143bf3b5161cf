"""Queries on transfer, references, external labels, gates and sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cross, sensitivity
from ..operators import evidence as ev
from .common import quantile8_sql, r6, table

_GATE = ev.Gate(max_topographic_error=0.5, min_median_ari=0.45, min_consensus_coverage=0.2, min_success_rate=0.3)


def _order_map(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    gone = F.col("o_custkey") % 9 == 0
    bmu = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 8).otherwise(F.col("o_custkey") % 12) + 1
    return o.select(
        F.col("o_orderpriority").alias("fit_id"), F.col("o_orderkey").alias("sample_id"),
        F.when(F.col("o_orderstatus") == "F", "analysis").otherwise("assessment").alias("role"),
        F.when(~gone, bmu).alias("bmu"), F.when(~gone, F.col("o_totalprice") / 1000).alias("distance"),
    )


def transfer_metrics(spark, sf_dir):
    t = ev.transfer_metrics(_order_map(spark, sf_dir))
    return t.select("fit_id", "n_analysis", "n_assessment", "n_analysis_mapped", "n_assessment_mapped", r6("median_analysis"), r6("median_assessment"), r6("unoccupied_rate"), r6("assessment_coverage"), r6("distance_ratio"))


def newdata_map(spark, sf_dir):
    m = _order_map(spark, sf_dir)
    t = ev.new_data_summary(m.where("role = 'assessment'"), m.where("role = 'analysis'"))
    return t.select("fit_id", "n_new", "n_mapped", r6("median_distance"), r6("distance_ratio"), r6("unoccupied_rate"))


def _consensus_samples(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("sample_id"), F.when(F.col("n_chars") % 11 != 0, (F.col("n_chars") % 4 + 1).cast("int")).alias("consensus"), (F.col("n_chars") % 5).cast("int").alias("n_assignments"))


def _external(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    label = F.when(F.col("doc_id") % 13 != 0, F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")))
    return ev.label_status(_consensus_samples(spark, sf_dir), lab.select(F.col("doc_id").alias("sample_id"), label.alias("label")), ("q0t1",))


def external_status(spark, sf_dir):
    return _external(spark, sf_dir).select("sample_id", "label", "status")


def external_omissions(spark, sf_dir):
    return ev.omissions(_external(spark, sf_dir)).select("status", "n")


def external_composition(spark, sf_dir):
    return ev.composition(_external(spark, sf_dir)).select("cluster", "label", "n", r6("within_cluster"))


def pareto(spark, sf_dir):
    return ev.pareto(table(spark, sf_dir, "part"), {"p_retailprice": "min", "p_size": "max"}, "p_partkey").select("p_partkey", "p_retailprice", "p_size")


def _evidence(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.count(F.lit(1)).alias("n"))
    k = F.col("c_nationkey")
    return c.select(
        k.cast("string").alias("case_id"), (F.col("n") % 10 / 10.0).alias("median_topographic_error"), F.when(k % 5 != 0, F.col("m") / 10000).alias("median_ari"),
        F.when(k % 7 != 0, F.lit(0.9)).alias("consensus_coverage"), F.lit(0.8).alias("success_rate"), (k % 6 != 1).alias("consensus_complete"), F.lit(True).alias("partitions_complete"),
    )


def gate_checks(spark, sf_dir):
    return ev.gate_checks(_evidence(spark, sf_dir), _GATE).select("case_id", "check", r6("value"), "threshold", "passed")


def gate_status(spark, sf_dir):
    return ev.assess(_evidence(spark, sf_dir), _GATE)[1]


def nearest_centroid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 50).alias("b"))
    centres = spark.createDataFrame([(1, 10.0, 20.0), (2, 25.0, 25.0), (3, 40.0, 30.0), (4, 10.0, 20.0)], "cluster int, a double, b double")
    return cross.nearest_centroid(p, centres, ["a", "b"], "p_partkey")


def reference_status(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    rec = n.select(F.element_at(F.array(F.lit("kmeans"), F.lit("ward"), F.lit("gmm")), key % 3 + 1).alias("method"), (key % 2 + 2).alias("k"), key.cast("string").alias("task_id"), F.when(key % 7 == 0, "failed").alias("error"))
    return cross.reference_status(rec, ["kmeans", "ward", "gmm", "other"], [2, 3], 6).select("method", "k", "expected", "succeeded", "failed", r6("success_rate"))


def cross_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rec = c.select(F.col("c_mktsegment").alias("method"), (F.col("c_nationkey") % 3 + 2).alias("k"), (F.col("c_acctbal") / 10000).alias("ari"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 20000).alias("ami"))
    return cross.cross_summary(rec).select("method", "k", "n_comparisons", r6("median_ari"), r6("ari_low"), r6("ari_high"), r6("median_ami"))


_SCENARIOS = {
    "s1": ("TRUE", "c_custkey % 4 + 1", "c_custkey % 5"),
    "s2": ("c_custkey % 3 <> 0", "(c_custkey + CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE 0 END) % 4 + 1", "c_custkey % 4 + 1"),
    "s3": ("c_custkey % 3 <> 1", "c_custkey % 12 % 4 + 1", "3"),
}


def _scenarios(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    out = None
    for name, (where, label, n) in _SCENARIOS.items():
        t = c.where(where).select(F.lit(name).alias("scenario"), F.lit(4).alias("k"), F.col("c_custkey").alias("sample_id"), F.expr(label).cast("int").alias("label"), F.expr(n).cast("int").alias("n_assignments"))
        out = t if out is None else out.unionByName(t)
    return out


def scenario_contrast(spark, sf_dir):
    s = sensitivity.scenario_contrasts(_scenarios(spark, sf_dir), ["s1", "s2", "s3", "s4"], failed=("s4",))
    return s.select("a", "b", "k", "n_shared", "n_replicated", "n_joint", r6("ari"), "comparison_status")


def membership_jaccard(spark, sf_dir):
    j = sensitivity.membership_jaccard(_scenarios(spark, sf_dir))
    return j.select("a", "b", "k", "sample_id", "intersection", "union", r6("shared_jaccard"), r6("all_members_jaccard"))


def sample_summary(spark, sf_dir):
    s = sensitivity.sample_summary(sensitivity.membership_jaccard(_scenarios(spark, sf_dir)), 3)
    return s.select("k", "sample_id", "n_contrasts", r6("contrast_coverage"), r6("median_jaccard"), r6("min_jaccard"), r6("low"), r6("high"))


QUERIES = {
    f.__name__: f
    for f in (
        transfer_metrics, newdata_map, external_status, external_omissions, external_composition, pareto, gate_checks, gate_status, nearest_centroid,
        reference_status, cross_summary, scenario_contrast, membership_jaccard, sample_summary,
    )
}

_OM = """
    m AS (SELECT o_orderpriority AS fit_id, CASE WHEN o_orderstatus = 'F' THEN 'analysis' ELSE 'assessment' END AS role,
                 CASE WHEN o_custkey % 9 <> 0 THEN CASE WHEN o_orderstatus = 'F' THEN o_custkey % 8 ELSE o_custkey % 12 END + 1 END AS bmu,
                 CASE WHEN o_custkey % 9 <> 0 THEN o_totalprice / 1000 END AS distance FROM orders),
    occ AS (SELECT DISTINCT fit_id, bmu, 1 AS o FROM m WHERE role = 'analysis' AND bmu IS NOT NULL),
    g AS (SELECT fit_id, count(*) FILTER (role = 'analysis') AS n_analysis, count(*) FILTER (role = 'assessment') AS n_assessment,
                 count(bmu) FILTER (role = 'analysis') AS n_analysis_mapped, count(bmu) FILTER (role = 'assessment') AS n_assessment_mapped,
                 median(distance) FILTER (role = 'analysis') AS median_analysis, median(distance) FILTER (role = 'assessment') AS median_assessment,
                 avg(CASE WHEN o IS NULL THEN 1.0e0 ELSE 0.0e0 END) FILTER (role = 'assessment' AND bmu IS NOT NULL) AS unoccupied_rate
          FROM m LEFT JOIN occ USING (fit_id, bmu) GROUP BY fit_id HAVING count(*) FILTER (role = 'assessment') > 0)"""
_EXT = """
    s AS (SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, CASE WHEN n_chars % 11 <> 0 THEN CAST(n_chars % 4 + 1 AS INTEGER) END AS consensus, n_chars % 5 AS n_assignments,
                 l.doc_id AS here, CASE WHEN l.doc_id % 13 <> 0 THEN 'q' || quality || 't' || toxic END AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    e AS (SELECT *, CASE WHEN here IS NULL THEN 'label_id_absent' WHEN label IS NULL THEN 'external_label_missing' WHEN label = 'q0t1' THEN 'external_label_excluded'
                 WHEN consensus IS NULL THEN 'consensus_label_missing' WHEN n_assignments < 2 THEN 'insufficient_consensus_replication' ELSE 'used' END AS status FROM s)"""
_EV = """
    v AS (SELECT CAST(c_nationkey AS VARCHAR) AS case_id, c_nationkey AS nk, count(*) % 10 / 10.0e0 AS te, CASE WHEN c_nationkey % 5 <> 0 THEN avg(c_acctbal) / 10000 END AS ari,
                 CASE WHEN c_nationkey % 7 <> 0 THEN 0.9e0 END AS cov FROM customer GROUP BY c_nationkey),
    chk AS (SELECT case_id, 'consensus_observes_k' AS "check", NULL::DOUBLE AS value, NULL::DOUBLE AS threshold, nk % 6 <> 1 AS passed FROM v
            UNION ALL SELECT case_id, 'comparative_partition_evidence_available', NULL, NULL, CASE WHEN ari IS NOT NULL THEN TRUE END FROM v
            UNION ALL SELECT case_id, 'partition_quality_requirement_specified', NULL, NULL, TRUE FROM v
            UNION ALL SELECT case_id, 'all_partitions_observe_k', NULL, NULL, TRUE FROM v
            UNION ALL SELECT case_id, 'max_topographic_error', te, 0.5e0, te <= 0.5e0 FROM v
            UNION ALL SELECT case_id, 'min_median_ari', ari, 0.45e0, ari >= 0.45e0 FROM v
            UNION ALL SELECT case_id, 'min_consensus_coverage', cov, 0.2e0, cov >= 0.2e0 FROM v
            UNION ALL SELECT case_id, 'min_success_rate', 0.8e0, 0.3e0, TRUE FROM v)"""
_SC = "sc AS (" + " UNION ALL ".join(f"SELECT '{s}' AS scenario, c_custkey AS sample_id, CAST({label} AS INTEGER) AS label, CAST({n} AS INTEGER) AS n FROM customer WHERE {where}" for s, (where, label, n) in _SCENARIOS.items()) + ")"
_MJ = f"""{_SC}, z AS (SELECT scenario, label, count(*) AS size FROM sc GROUP BY ALL),
    p AS (SELECT a.scenario AS a, b.scenario AS b, sample_id, a.label AS x, b.label AS y FROM sc a JOIN sc b USING (sample_id) WHERE a.scenario < b.scenario),
    w AS (SELECT *, count(*) OVER (PARTITION BY a, b, x, y) AS same, count(*) OVER (PARTITION BY a, b, x) AS cx, count(*) OVER (PARTITION BY a, b, y) AS cy FROM p),
    mj AS (SELECT w.a, w.b, 4 AS k, sample_id, same AS intersection, cx + cy - same AS "union", same / CAST(cx + cy - same AS DOUBLE) AS shared_jaccard,
                  same / CAST(za.size + zb.size - same AS DOUBLE) AS all_members_jaccard
           FROM w JOIN z za ON za.scenario = w.a AND za.label = w.x JOIN z zb ON zb.scenario = w.b AND zb.label = w.y)"""
_C2 = "CAST({0} AS DOUBLE) * ({0} - 1) / 2"

ORACLE = {
    "transfer_metrics": f"""WITH {_OM} SELECT fit_id, n_analysis, n_assessment, n_analysis_mapped, n_assessment_mapped, round(median_analysis, 6) AS median_analysis,
        round(median_assessment, 6) AS median_assessment, round(unoccupied_rate, 6) AS unoccupied_rate, round(n_assessment_mapped / CAST(n_assessment AS DOUBLE), 6) AS assessment_coverage,
        round(CASE WHEN median_analysis > 0 THEN median_assessment / median_analysis END, 6) AS distance_ratio FROM g""",
    "newdata_map": f"""WITH {_OM} SELECT fit_id, n_assessment AS n_new, n_assessment_mapped AS n_mapped, round(median_assessment, 6) AS median_distance,
        round(CASE WHEN median_analysis > 0 THEN median_assessment / median_analysis END, 6) AS distance_ratio, round(unoccupied_rate, 6) AS unoccupied_rate FROM g""",
    "external_status": f"WITH {_EXT} SELECT sample_id, label, status FROM e",
    "external_omissions": f"""WITH {_EXT}, st AS (SELECT unnest({list(ev.STATUSES)}) AS status) SELECT st.status, count(e.status) AS n FROM st LEFT JOIN e ON e.status = st.status GROUP BY st.status""",
    "external_composition": f"""WITH {_EXT}, u AS (SELECT consensus AS cluster, label FROM e WHERE status = 'used'),
        gr AS (SELECT * FROM (SELECT DISTINCT cluster FROM u), (SELECT DISTINCT label FROM u)), c AS (SELECT cluster, label, count(*) AS n FROM u GROUP BY ALL), t AS (SELECT cluster, count(*) AS t FROM u GROUP BY 1)
        SELECT gr.cluster, gr.label, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) / CAST(t.t AS DOUBLE), 6) AS within_cluster FROM gr LEFT JOIN c USING (cluster, label) JOIN t USING (cluster)""",
    "pareto": """SELECT p_partkey, p_retailprice, p_size FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_retailprice <= p.p_retailprice AND q.p_size >= p.p_size
        AND (q.p_retailprice < p.p_retailprice OR q.p_size > p.p_size))""",
    "gate_checks": f'WITH {_EV} SELECT case_id, "check", round(value, 6) AS value, threshold, passed FROM chk',
    "gate_status": f"""WITH {_EV} SELECT case_id, CASE WHEN bool_or(NOT passed) THEN 'abstain' WHEN count(*) > count(passed) THEN 'uncertain' ELSE 'supported' END AS status FROM chk GROUP BY case_id""",
    "nearest_centroid": """WITH c(cluster, a, b) AS (VALUES (1, 10.0e0, 20.0e0), (2, 25.0e0, 25.0e0), (3, 40.0e0, 30.0e0), (4, 10.0e0, 20.0e0)),
        d AS (SELECT p_partkey, cluster, row_number() OVER (PARTITION BY p_partkey ORDER BY (p_size - a) * (p_size - a) + (p_retailprice / 50 - b) * (p_retailprice / 50 - b), cluster) AS r FROM part, c)
        SELECT p_partkey, cluster FROM d WHERE r = 1""",
    "reference_status": """
        WITH m AS (SELECT * FROM (SELECT unnest(['kmeans', 'ward', 'gmm', 'other']) AS method), (SELECT unnest([2, 3]) AS k)),
        r AS (SELECT ['kmeans', 'ward', 'gmm'][n_nationkey % 3 + 1] AS method, n_nationkey % 2 + 2 AS k, count(*) FILTER (n_nationkey % 7 <> 0) AS ok FROM nation GROUP BY 1, 2)
        SELECT method, k, 6 AS expected, coalesce(ok, 0) AS succeeded, 6 - coalesce(ok, 0) AS failed, round(coalesce(ok, 0) / 6.0e0, 6) AS success_rate FROM m LEFT JOIN r USING (method, k)""",
    "cross_summary": f"""
        WITH l AS (SELECT c_mktsegment AS method, c_nationkey % 3 + 2 AS k, count(*) AS n, list_sort(list(c_acctbal / 10000)) AS v, median(c_acctbal / 10000) AS m,
                          median(CASE WHEN c_acctbal > 0 THEN c_acctbal / 20000 END) AS a FROM customer GROUP BY 1, 2)
        SELECT method, k, n AS n_comparisons, round(m, 6) AS median_ari, round({quantile8_sql('v', 0.025)}, 6) AS ari_low, round({quantile8_sql('v', 0.975)}, 6) AS ari_high, round(a, 6) AS median_ami FROM l""",
    "scenario_contrast": f"""
        WITH {_SC}, j AS (SELECT a.scenario AS a, b.scenario AS b, a.label AS x, b.label AS y, a.n >= 2 AND b.n >= 2 AS rep FROM sc a JOIN sc b USING (sample_id) WHERE a.scenario < b.scenario),
        t AS (SELECT a, b, count(*) AS n_shared, count(*) FILTER (rep) AS n_replicated FROM j GROUP BY ALL), c AS (SELECT a, b, x, y, count(*) AS n FROM j WHERE rep GROUP BY ALL),
        sx AS (SELECT a, b, sum({_C2.format('n')}) AS s FROM (SELECT a, b, x, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL), sy AS (SELECT a, b, sum({_C2.format('n')}) AS s FROM (SELECT a, b, y, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
        s AS (SELECT a, b, sum({_C2.format('n')}) AS s, sum(n) AS n FROM c GROUP BY ALL)
        SELECT a, b, 4 AS k, n_shared, n_replicated, n_replicated AS n_joint,
               round((s.s - sx.s * sy.s / ({_C2.format('s.n')})) / ((sx.s + sy.s) / 2 - sx.s * sy.s / ({_C2.format('s.n')})), 6) AS ari, 'evaluated' AS comparison_status
        FROM t JOIN s USING (a, b) JOIN sx USING (a, b) JOIN sy USING (a, b)
        UNION ALL SELECT x, 's4', NULL, 0, 0, 0, NULL, 'scenario_failed_b' FROM (SELECT unnest(['s1', 's2', 's3']) AS x)""",
    "membership_jaccard": f'WITH {_MJ} SELECT a, b, k, sample_id, intersection, "union", round(shared_jaccard, 6) AS shared_jaccard, round(all_members_jaccard, 6) AS all_members_jaccard FROM mj',
    "sample_summary": f"""
        WITH {_MJ}, l AS (SELECT k, sample_id, count(*) AS n, list_sort(list(shared_jaccard)) AS v, median(shared_jaccard) AS m, min(shared_jaccard) AS lo FROM mj GROUP BY ALL)
        SELECT k, sample_id, n AS n_contrasts, round(n / 3.0e0, 6) AS contrast_coverage, round(m, 6) AS median_jaccard, round(lo, 6) AS min_jaccard,
               round({quantile8_sql('v', 0.025)}, 6) AS low, round({quantile8_sql('v', 0.975)}, 6) AS high FROM l""",
}
