"""Queries on agreement, stability and consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import agreement
from ..functions.stats import quantile8
from ..operators import consensus, partition
from .common import quantile8_sql, r6, table

#: Four labelings of the customers, deterministic stand-ins for fitted partitions.
_FITS = {
    "f1": "c_custkey % 3 + 1",
    "f2": "(c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END) % 3 + 1",
    "f3": "(c_custkey + CASE WHEN c_nationkey % 5 = 0 THEN 2 ELSE 0 END) % 3 + 1",
    "f4": "CASE WHEN c_nationkey % 8 <> 3 THEN (c_custkey + CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END) % 3 + 1 END",
}


def labels(spark, sf_dir, k: int = 3) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    out = None
    for name, e in _FITS.items():
        t = c.select(F.lit(name).alias("fit_id"), F.lit(k).alias("k"), F.col("c_custkey").alias("sample_id"), F.expr(e).cast("int").alias("label"))
        out = t if out is None else out.unionByName(t)
    return out


def contingency(spark, sf_dir):
    return agreement.contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


def ari(spark, sf_dir):
    return agreement.ari(contingency(spark, sf_dir)).select("n", r6("ari"))


def _orders_cells(spark, sf_dir):
    return agreement.contingency(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


def entropy_mi(spark, sf_dir):
    return agreement.mutual_information(_orders_cells(spark, sf_dir)).select("n", F.round("mi", 9).alias("mi"), r6("hx"), r6("hy"))


def label_entropy(spark, sf_dir):
    return agreement.entropy(table(spark, sf_dir, "orders"), "o_orderpriority", ("o_orderstatus",)).select("o_orderstatus", "n", r6("entropy"))


def expected_mi(spark, sf_dir):
    return agreement.expected_mi(_orders_cells(spark, sf_dir)).select(F.round("emi", 9).alias("emi"))


def ami(spark, sf_dir):
    cells = _orders_cells(spark, sf_dir)
    m = agreement.mutual_information(cells).crossJoin(agreement.expected_mi(cells))  # one row each
    return m.select(F.round(F.greatest(F.least((F.col("mi") - F.col("emi")) / ((F.col("hx") + F.col("hy")) / 2 - F.col("emi")), F.lit(1.0)), F.lit(-1.0)), 8).alias("ami"))


def quantile8_by_segment(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.groupBy("c_mktsegment").agg(F.round(quantile8(F.col("c_acctbal"), 0.025), 6).alias("low"), F.round(quantile8(F.col("c_acctbal"), 0.975), 6).alias("high"))


def completeness(spark, sf_dir):
    c = partition.completeness(labels(spark, sf_dir, 4))
    return c.select("fit_id", "k", "n_observed_clusters", F.concat_ws(",", "missing_clusters").alias("missing_clusters"), "complete_k")


def pairwise_agreement(spark, sf_dir):
    own = labels(spark, sf_dir)
    n = own.agg(F.count_distinct("sample_id")).first()[0]
    p = partition.pairwise_agreement(own, n)
    return p.select("k", "fit_a", "fit_b", "n_joint", r6("joint_coverage"), r6("ari"))


def pairwise_ami(spark, sf_dir):
    own = labels(spark, sf_dir)
    p = partition.pairwise_agreement(own, own.agg(F.count_distinct("sample_id")).first()[0])
    return p.select("fit_a", "fit_b", r6("ami"))


def stability_summary(spark, sf_dir):
    own = labels(spark, sf_dir)
    p = partition.pairwise_agreement(own, own.agg(F.count_distinct("sample_id")).first()[0])
    s = partition.stability_summary(p, partition.completeness(own))
    return s.select("k", "n_partitions", "n_complete", "n_pairs", "n_evaluable", r6("median_ari"), r6("ari_low"), r6("ari_high"), r6("median_joint_coverage"))


def coassignment(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    own = None
    for name, e in {"f1": "n_nationkey % 3 + 1", "f2": "(n_nationkey + n_regionkey) % 3 + 1", "f3": "CASE WHEN n_nationkey % 5 <> 2 THEN n_regionkey % 3 + 1 END"}.items():
        t = n.select(F.lit(name).alias("fit_id"), F.lit(3).alias("k"), F.col("n_nationkey").alias("sample_id"), F.expr(e).cast("int").alias("label"))
        own = t if own is None else own.unionByName(t)
    return consensus.coassignment(own).select("a", "b", "same", "joint", r6("share"))


def consensus_vote(spark, sf_dir):
    return consensus.vote(labels(spark, sf_dir), "f2")


def _membership(spark, sf_dir):
    own = labels(spark, sf_dir)
    return own, consensus.membership(own, consensus.vote(own, "f2"), 3)


def membership_support(spark, sf_dir):
    return _membership(spark, sf_dir)[1].select("sample_id", "consensus", "n_assignments", r6("support"))


def assignment_entropy(spark, sf_dir):
    return _membership(spark, sf_dir)[1].select("sample_id", r6("entropy"))


def coverages(spark, sf_dir):
    own = labels(spark, sf_dir).withColumn("label", F.when((F.col("sample_id") % 6 != 0) | (F.col("fit_id") == "f1"), F.when(F.col("sample_id") % 10 != 0, F.col("label"))))
    s = consensus.membership(own, consensus.vote(own, "f2"), 3)
    return consensus.coverages(s).select(r6("assignment_coverage"), r6("consensus_coverage"), r6("replicated_coverage"))


def cluster_jaccard(spark, sf_dir):
    own, s = _membership(spark, sf_dir)
    return consensus.cluster_jaccard(own, s, 3).select("fit_id", "cluster", r6("jaccard"))


def medoid(spark, sf_dir):
    own = labels(spark, sf_dir)
    p = partition.pairwise_agreement(own, own.agg(F.count_distinct("sample_id")).first()[0])
    return consensus.medoid(p).select("k", "fit_id", r6("mean_ari"))


def grid_summary(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    m = s.select((F.col("s_nationkey") % 3 + 4).alias("xdim"), F.lit(4).alias("ydim"), (F.col("s_acctbal") / 100).alias("quantization_error"), (F.col("s_suppkey") % 10 / 10.0).alias("topographic_error"), (F.col("s_suppkey") % 7 / 7.0).alias("empty_unit_rate"))
    return partition.grid_summary(m).select("xdim", "ydim", "n_models", r6("median_quantization_error"), r6("median_topographic_error"), r6("median_empty_unit_rate"))


QUERIES = {
    f.__name__: f
    for f in (
        contingency, ari, entropy_mi, label_entropy, expected_mi, ami, quantile8_by_segment, completeness, pairwise_agreement, pairwise_ami, stability_summary,
        coassignment, consensus_vote, membership_support, assignment_entropy, coverages, cluster_jaccard, medoid, grid_summary,
    )
}

_LABELS = "lab AS (" + " UNION ALL ".join(f"SELECT '{f}' AS fit_id, c_custkey AS sample_id, CAST({e} AS INTEGER) AS label FROM customer" for f, e in _FITS.items()) + ")"
_C2 = "CAST({0} AS DOUBLE) * ({0} - 1) / 2"
_PAIRS = f"""{_LABELS},
    cell AS (SELECT a.fit_id AS fit_a, b.fit_id AS fit_b, a.label AS x, b.label AS y, count(*) AS n
             FROM lab a JOIN lab b USING (sample_id) WHERE a.fit_id < b.fit_id AND a.label IS NOT NULL AND b.label IS NOT NULL GROUP BY ALL),
    sx AS (SELECT fit_a, fit_b, sum({_C2.format('n')}) AS s FROM (SELECT fit_a, fit_b, x, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY ALL),
    sy AS (SELECT fit_a, fit_b, sum({_C2.format('n')}) AS s FROM (SELECT fit_a, fit_b, y, sum(n) AS n FROM cell GROUP BY ALL) GROUP BY ALL),
    sc AS (SELECT fit_a, fit_b, sum({_C2.format('n')}) AS s, CAST(sum(n) AS BIGINT) AS n FROM cell GROUP BY ALL),
    pair AS (SELECT 3 AS k, fit_a, fit_b, sc.n AS n_joint, sc.n / CAST((SELECT count(*) FROM customer) AS DOUBLE) AS joint_coverage,
                    (sc.s - sx.s * sy.s / ({_C2.format('sc.n')})) / ((sx.s + sy.s) / 2 - sx.s * sy.s / ({_C2.format('sc.n')})) AS ari
             FROM sc JOIN sx USING (fit_a, fit_b) JOIN sy USING (fit_a, fit_b))"""
_VOTE = f"""{_LABELS},
    cnt AS (SELECT sample_id, label, count(*) AS c, max(CASE WHEN fit_id = 'f2' THEN 1 ELSE 0 END) AS ref FROM lab WHERE label IS NOT NULL GROUP BY ALL),
    won AS (SELECT sample_id, label AS consensus FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY c DESC, ref DESC, label) AS r FROM cnt) WHERE r = 1)"""
_OC = """o AS (SELECT o_orderpriority AS x, o_orderstatus AS y, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL),
    w AS (SELECT x, y, n, sum(n) OVER (PARTITION BY x) AS a, sum(n) OVER (PARTITION BY y) AS b, sum(n) OVER () AS t FROM o),
    mi AS (SELECT CAST(max(t) AS BIGINT) AS n, sum(n / t * ln(n * t / (a * b))) AS mi, -sum(n / t * ln(a / t)) AS hx, -sum(n / t * ln(b / t)) AS hy FROM w)"""
_EMI = """ma AS (SELECT DISTINCT x, CAST(a AS BIGINT) AS a, CAST(t AS BIGINT) AS t FROM w), mb AS (SELECT DISTINCT y, CAST(b AS BIGINT) AS b FROM w),
    k AS (SELECT a, b, t, unnest(range(greatest(1, a + b - t), least(a, b) + 1)) AS k FROM ma, mb),
    emi AS (SELECT coalesce(sum(k / CAST(t AS DOUBLE) * ln(CAST(t AS DOUBLE) * k / (CAST(a AS DOUBLE) * b))
              * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))), 0) AS emi FROM k)"""

ORACLE = {
    "contingency": "SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY ALL",
    "ari": f"""
        WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY ALL),
        a AS (SELECT sum({_C2.format('n')}) AS s FROM (SELECT x, sum(n) AS n FROM c GROUP BY x)), b AS (SELECT sum({_C2.format('n')}) AS s FROM (SELECT y, sum(n) AS n FROM c GROUP BY y)),
        t AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum({_C2.format('n')}) AS s FROM c)
        SELECT t.n, round((t.s - a.s * b.s / ({_C2.format('t.n')})) / ((a.s + b.s) / 2 - a.s * b.s / ({_C2.format('t.n')})), 6) AS ari FROM a, b, t""",
    "entropy_mi": f"WITH {_OC} SELECT n, round(mi, 9) AS mi, round(hx, 6) AS hx, round(hy, 6) AS hy FROM mi",
    "label_entropy": """
        WITH c AS (SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS DOUBLE) AS c FROM orders GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY o_orderstatus) AS t FROM c)
        SELECT o_orderstatus, CAST(sum(c) AS BIGINT) AS n, round(-sum(c / t * ln(c / t)), 6) AS entropy FROM t GROUP BY 1""",
    "expected_mi": f"WITH {_OC}, {_EMI} SELECT round(emi, 9) AS emi FROM emi",
    "ami": f"WITH {_OC}, {_EMI} SELECT round(greatest(least((mi - emi) / ((hx + hy) / 2 - emi), 1), -1), 8) AS ami FROM mi, emi",
    "quantile8_by_segment": f"""
        WITH l AS (SELECT c_mktsegment, list_sort(list(c_acctbal)) AS v FROM customer GROUP BY 1)
        SELECT c_mktsegment, round({quantile8_sql('v', 0.025)}, 6) AS low, round({quantile8_sql('v', 0.975)}, 6) AS high FROM l""",
    "pairwise_ami": f"""
        WITH {_PAIRS},
        w AS (SELECT fit_a, fit_b, x, y, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY fit_a, fit_b, x) AS DOUBLE) AS a,
                     CAST(sum(n) OVER (PARTITION BY fit_a, fit_b, y) AS DOUBLE) AS b, CAST(sum(n) OVER (PARTITION BY fit_a, fit_b) AS DOUBLE) AS t FROM cell),
        mi AS (SELECT fit_a, fit_b, sum(n / t * ln(n * t / (a * b))) AS mi, -sum(n / t * ln(a / t)) AS hx, -sum(n / t * ln(b / t)) AS hy FROM w GROUP BY ALL),
        ma AS (SELECT DISTINCT fit_a, fit_b, x, CAST(a AS BIGINT) AS a, CAST(t AS BIGINT) AS t FROM w), mb AS (SELECT DISTINCT fit_a, fit_b, y, CAST(b AS BIGINT) AS b FROM w),
        k AS (SELECT fit_a, fit_b, a, b, t, unnest(range(greatest(1, a + b - t), least(a, b) + 1)) AS k FROM ma JOIN mb USING (fit_a, fit_b)),
        emi AS (SELECT fit_a, fit_b, sum(k / CAST(t AS DOUBLE) * ln(CAST(t AS DOUBLE) * k / (CAST(a AS DOUBLE) * b))
                  * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) AS emi FROM k GROUP BY ALL)
        SELECT fit_a, fit_b, round(greatest(least((mi - emi) / ((hx + hy) / 2 - emi), 1), -1), 6) AS ami FROM mi JOIN emi USING (fit_a, fit_b)""",
    "completeness": f"""
        WITH {_LABELS} SELECT fit_id, 4 AS k, count(DISTINCT label) AS n_observed_clusters,
          array_to_string(list_filter([1, 2, 3, 4], lambda x: NOT list_contains(list(DISTINCT label), x)), ',') AS missing_clusters, count(DISTINCT label) = 4 AS complete_k FROM lab GROUP BY fit_id""",
    "pairwise_agreement": f"WITH {_PAIRS} SELECT k, fit_a, fit_b, n_joint, round(joint_coverage, 6) AS joint_coverage, round(ari, 6) AS ari FROM pair",
    "stability_summary": f"""
        WITH {_PAIRS}, l AS (SELECT k, count(*) AS n, list_sort(list(ari)) AS v, median(ari) AS m, median(joint_coverage) AS c FROM pair GROUP BY k)
        SELECT k, CAST(4 AS BIGINT) AS n_partitions, CAST(4 AS BIGINT) AS n_complete, n AS n_pairs, n AS n_evaluable, round(m, 6) AS median_ari,
               round({quantile8_sql('v', 0.025)}, 6) AS ari_low, round({quantile8_sql('v', 0.975)}, 6) AS ari_high, round(c, 6) AS median_joint_coverage FROM l""",
    "coassignment": """
        WITH lab AS (SELECT 'f1' AS f, n_nationkey AS s, n_nationkey % 3 + 1 AS l FROM nation UNION ALL SELECT 'f2', n_nationkey, (n_nationkey + n_regionkey) % 3 + 1 FROM nation
                     UNION ALL SELECT 'f3', n_nationkey, n_regionkey % 3 + 1 FROM nation WHERE n_nationkey % 5 <> 2)
        SELECT a.s AS a, b.s AS b, CAST(sum(CASE WHEN a.l = b.l THEN 1 ELSE 0 END) AS BIGINT) AS same, count(*) AS joint,
               round(sum(CASE WHEN a.l = b.l THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS share
        FROM lab a JOIN lab b ON a.f = b.f AND a.s < b.s GROUP BY a.s, b.s""",
    "consensus_vote": f"WITH {_VOTE} SELECT sample_id, consensus FROM won",
    "membership_support": f"""
        WITH {_VOTE} SELECT sample_id, consensus, count(label) AS n_assignments,
          round(CASE WHEN count(label) >= 2 THEN avg(CASE WHEN label IS NULL THEN NULL WHEN label = consensus THEN 1.0e0 ELSE 0.0e0 END) END, 6) AS support
        FROM lab JOIN won USING (sample_id) GROUP BY sample_id, consensus""",
    "assignment_entropy": f"""
        WITH {_VOTE}, t AS (SELECT sample_id, c, sum(c) OVER (PARTITION BY sample_id) AS t FROM cnt)
        SELECT sample_id, round(greatest(CASE WHEN max(t) >= 2 THEN -sum(CAST(c AS DOUBLE) / t * ln(CAST(c AS DOUBLE) / t)) / ln(3.0e0) END, 0.0e0), 6) + 0.0e0 AS entropy FROM t GROUP BY sample_id""",
    "coverages": f"""
        WITH {_LABELS}, m AS (SELECT sample_id, count(CASE WHEN (sample_id % 6 <> 0 OR fit_id = 'f1') AND sample_id % 10 <> 0 THEN label END) AS c FROM lab GROUP BY sample_id)
        SELECT round(avg(CASE WHEN c >= 1 THEN 1.0e0 ELSE 0 END), 6) AS assignment_coverage, round(avg(CASE WHEN c >= 1 THEN 1.0e0 ELSE 0 END), 6) AS consensus_coverage,
               round(avg(CASE WHEN c >= 2 THEN 1.0e0 ELSE 0 END), 6) AS replicated_coverage FROM m""",
    "cluster_jaccard": f"""
        WITH {_VOTE}, n AS (SELECT sample_id FROM lab GROUP BY sample_id HAVING count(label) >= 2),
        j AS (SELECT fit_id, label, consensus FROM lab JOIN won USING (sample_id) JOIN n USING (sample_id) WHERE label IS NOT NULL), c AS (SELECT unnest([1, 2, 3]) AS cluster)
        SELECT fit_id, cluster, round(sum(CASE WHEN label = cluster AND consensus = cluster THEN 1.0e0 ELSE 0 END) / sum(CASE WHEN label = cluster OR consensus = cluster THEN 1 ELSE 0 END), 6) AS jaccard
        FROM j, c GROUP BY fit_id, cluster""",
    "medoid": f"""
        WITH {_PAIRS}, b AS (SELECT fit_a AS fit_id, ari FROM pair UNION ALL SELECT fit_b, ari FROM pair UNION ALL SELECT DISTINCT fit_id, 1.0e0 FROM lab),
        m AS (SELECT fit_id, avg(ari) AS mean_ari FROM b GROUP BY fit_id)
        SELECT 3 AS k, fit_id, round(mean_ari, 6) AS mean_ari FROM m ORDER BY mean_ari DESC, fit_id LIMIT 1""",
    "grid_summary": """
        SELECT s_nationkey % 3 + 4 AS xdim, 4 AS ydim, count(*) AS n_models, round(median(s_acctbal / 100), 6) AS median_quantization_error,
               round(median(s_suppkey % 10 / 10.0e0), 6) AS median_topographic_error, round(median(s_suppkey % 7 / 7.0e0), 6) AS median_empty_unit_rate FROM supplier GROUP BY 1""",
}
