"""Queries on datasets, transforms and resampling designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset, preprocess, resample, spec
from ..sources import tables
from .common import r6, table

PART = ["p_size", "p_retailprice"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    return dataset.make_dataset(df, columns=PART, id_col="p_partkey", group="p_brand").df


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return j.select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_nationkey").alias("group"), F.col("r_name").alias("domain"), "c_acctbal")


def audit_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), "c_nationkey", F.lit(1).alias("one"))
    return dataset.audit_table(c, ["balance", "c_nationkey", "one"])


def default_roles(spark, sf_dir):
    found = dataset.default_roles(table(spark, sf_dir, "lineitem"))
    rows = [(role, c) for role, cs in found.items() for c in cs]
    return spark.createDataFrame(rows, "role string, column_name string")


def zscore_params(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    m = preprocess.moments(line, LINE, preprocess.Preprocess(), ("l_returnflag",))
    return m.select("l_returnflag", *(r6(f"mean__{c}", f"mean_{c}") for c in LINE), *(r6(f"sd__{c}", f"sd_{c}") for c in LINE))


def zscore_apply(spark, sf_dir):
    df = _part(spark, sf_dir)
    fitted = preprocess.fit_preprocess(df.where(F.col("sample_id").cast("long") % 5 != 0), PART, preprocess.Preprocess())
    return preprocess.apply_preprocess(df, fitted).select("sample_id", r6("p_size", "z_size"), r6("p_retailprice", "z_price"))


def transform_columns(spark, sf_dir):
    df = _part(spark, sf_dir)
    pre = preprocess.Preprocess({"p_size": "sqrt", "p_retailprice": "log1p"})
    return preprocess.apply_preprocess(df, preprocess.fit_preprocess(df, PART, pre)).select("sample_id", r6("p_size", "z_size"), r6("p_retailprice", "z_price"))


def hellinger(spark, sf_dir):
    df = _part(spark, sf_dir)
    pre = preprocess.Preprocess("hellinger", center=False, scale=False)
    return preprocess.apply_preprocess(df, preprocess.fit_preprocess(df, PART, pre)).select("sample_id", r6("p_size"), r6("p_retailprice"))


def clr(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*(F.sum(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")))
    cols = ["l_quantity", "l_discount", "l_tax"]
    pre = preprocess.Preprocess("clr", center=False, scale=False, zero_replacement=0.005)
    # sums of hundredths are rounded so that zeros and ties do not depend on the order
    line = line.select("l_partkey", *(F.round(c, 4).alias(c) for c in cols))
    return preprocess.apply_preprocess(line, preprocess.fit_preprocess(line, cols, pre)).select("l_partkey", *(r6(c) for c in cols))


def layer_weights(spark, sf_dir):
    df = _part(spark, sf_dir)
    w = preprocess.layer_weights(df, {"size": ["p_size"], "price": ["p_retailprice"]}, {"size": 2.0, "price": 1.0})
    return w.select("layer", r6("requested"), F.round("mean_squared_distance", 3).alias("mean_squared_distance"), r6("effective"))


def budget_expand(spark, sf_dir):
    return spec.expand(spark, spec.Spec(grids=((7, 5), (6, 4)), seeds=(1, 2, 3), k=(2, 3)))


def split_full(spark, sf_dir):
    return resample.full(_customers(spark, sf_dir))


def split_subsample(spark, sf_dir):
    return resample.subsample(_customers(spark, sf_dir), repeats=3, prop=0.8, seed=7)


def split_group(spark, sf_dir):
    return resample.unit_subsample(_customers(spark, sf_dir), "group", repeats=3, prop=0.5, seed=7)


def split_block(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.date_format("o_orderdate", "yyyy-MM").alias("block"))
    s = resample.unit_subsample(o, "block", repeats=2, prop=0.7, seed=3, prefix="block")
    return s.groupBy("split_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sample_id").cast("long")).alias("key_sum"))


def split_leave_domain(spark, sf_dir):
    return resample.leave_domain_out(_customers(spark, sf_dir)).groupBy("split_id", "role", "held_domain").agg(F.count(F.lit(1)).alias("n"))


def split_custom(spark, sf_dir):
    df = _customers(spark, sf_dir)
    own = df.where(F.col("sample_id").cast("long") % 3 == 0).select(F.lit("thirds").alias("split_id"), "sample_id")
    return resample.custom(df, own)


def split_duplicates(spark, sf_dir):
    df = _customers(spark, sf_dir)
    ident = F.col("sample_id").cast("long")
    parts = [("a", ident % 2 == 0), ("b", ident % 3 == 0), ("c", ident % 4 % 2 == 0), ("d", ident % 6 % 3 == 0)]
    out = None
    for name, where in parts:
        own = df.where(where).select(F.lit(name).alias("split_id"), "sample_id", F.lit("analysis").alias("role"))
        out = own if out is None else out.unionByName(own)
    return resample.duplicate_analysis(out)


def align_layers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a, b = c.select("c_custkey", "c_acctbal"), c.select("c_custkey", (F.col("c_nationkey") * 2).alias("twice"))
    return dataset.align_layers({"balance": a, "nation": b}, "c_custkey")


def csv_template(spark, sf_dir):
    t = tables.template(spark)
    return t.select("sample_id", "sampling_group", F.col("survey_date").cast("string").alias("survey_date"), "reporting_region", "external_label")


def open_data_registry(spark, sf_dir):
    return tables.registry(spark, role=["advanced_example"]).select("id", "domain", "role")


QUERIES = {
    f.__name__: f
    for f in (
        audit_table, default_roles, zscore_params, zscore_apply, transform_columns, hellinger, clr, layer_weights, budget_expand, split_full,
        split_subsample, split_group, split_block, split_leave_domain, split_custom, split_duplicates, align_layers, csv_template, open_data_registry,
    )
}

_DRAW = "md5(concat_ws(':', '{seed}', CAST(rep AS VARCHAR), CAST({unit} AS VARCHAR)))"

ORACLE = {
    "audit_table": """
        WITH c AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_nationkey, 1 AS one FROM customer)
        SELECT unnest(['rows', 'columns', 'incomplete_rows', 'empty_rows', 'non_finite', 'constant_columns']) AS measure,
               unnest([count(*), 3, count(*) FILTER (balance IS NULL OR c_nationkey IS NULL), 0, 0,
                       (count(DISTINCT balance) <= 1)::BIGINT + (count(DISTINCT c_nationkey) <= 1)::BIGINT + 1]) AS value
        FROM c""",
    "default_roles": """
        SELECT * FROM (VALUES ('predictors', 'l_quantity'), ('predictors', 'l_extendedprice'), ('predictors', 'l_discount'),
          ('predictors', 'l_tax'), ('predictors', 'l_linenumber'), ('metadata', 'l_orderkey'), ('metadata', 'l_partkey'),
          ('metadata', 'l_suppkey'), ('metadata', 'l_returnflag'), ('metadata', 'l_linestatus'), ('metadata', 'l_shipdate')) t(role, column_name)""",
    "zscore_params": "SELECT l_returnflag, "
    + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in LINE)
    + ", "
    + ", ".join(f"round(stddev_samp({c}), 6) AS sd_{c}" for c in LINE)
    + " FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag",
    "zscore_apply": """
        WITH m AS (SELECT avg(p_size) AS a, stddev_samp(p_size) AS b, avg(p_retailprice) AS c, stddev_samp(p_retailprice) AS d FROM part WHERE p_partkey % 5 <> 0)
        SELECT CAST(p_partkey AS VARCHAR) AS sample_id, round((p_size - a) / b, 6) AS z_size, round((p_retailprice - c) / d, 6) AS z_price FROM part, m""",
    "transform_columns": """
        WITH t AS (SELECT p_partkey, sqrt(CAST(p_size AS DOUBLE)) AS x, ln(1.0e0 + p_retailprice) AS y FROM part),
        m AS (SELECT avg(x) AS a, stddev_samp(x) AS b, avg(y) AS c, stddev_samp(y) AS d FROM t)
        SELECT CAST(p_partkey AS VARCHAR) AS sample_id, round((x - a) / b, 6) AS z_size, round((y - c) / d, 6) AS z_price FROM t, m""",
    "hellinger": """
        SELECT CAST(p_partkey AS VARCHAR) AS sample_id, round(sqrt(p_size / (p_size + p_retailprice)), 6) AS p_size,
               round(sqrt(p_retailprice / (p_size + p_retailprice)), 6) AS p_retailprice FROM part""",
    "clr": """
        WITH s AS (SELECT l_partkey, round(sum(l_quantity), 4) AS q, round(sum(l_discount), 4) AS d, round(sum(l_tax), 4) AS t FROM lineitem GROUP BY l_partkey),
        g AS (SELECT l_partkey, ln(CASE WHEN q = 0 THEN 0.005e0 ELSE q END) AS q, ln(CASE WHEN d = 0 THEN 0.005e0 ELSE d END) AS d, ln(CASE WHEN t = 0 THEN 0.005e0 ELSE t END) AS t FROM s)
        SELECT l_partkey, round(q - (q + d + t) / 3, 6) AS l_quantity, round(d - (q + d + t) / 3, 6) AS l_discount, round(t - (q + d + t) / 3, 6) AS l_tax FROM g""",
    "layer_weights": """
        WITH v AS (SELECT 2 * var_samp(CAST(p_size AS DOUBLE)) AS s, 2 * var_samp(p_retailprice) AS p FROM part),
        w AS (SELECT s, p, (2.0e0 / 3) / s AS ws, (1.0e0 / 3) / p AS wp FROM v)
        SELECT 'size' AS layer, round(2.0e0 / 3, 6) AS requested, round(s, 3) AS mean_squared_distance, round(ws / (ws + wp), 6) AS effective FROM w
        UNION ALL SELECT 'price', round(1.0e0 / 3, 6), round(p, 3), round(wp / (ws + wp), 6) FROM w""",
    "budget_expand": """
        SELECT g.grid_id, g.xdim, g.ydim, s.seed, printf('g%02d_%dx%d_s%d', g.grid_id, g.xdim, g.ydim, s.seed) AS model_id
        FROM (VALUES (1, 7, 5), (2, 6, 4)) g(grid_id, xdim, ydim), (SELECT unnest([1, 2, 3])::BIGINT AS seed) s""",
    "split_full": "SELECT 'full' AS split_id, CAST(c_custkey AS VARCHAR) AS sample_id, 'analysis' AS role FROM customer",
    "split_subsample": f"""
        WITH r AS (SELECT unnest([1, 2, 3]) AS rep),
        k AS (SELECT rep, c_custkey, row_number() OVER (PARTITION BY rep ORDER BY {_DRAW.format(seed=7, unit='c_custkey')}) AS place FROM customer, r)
        SELECT printf('subsample_%03d', rep) AS split_id, CAST(c_custkey AS VARCHAR) AS sample_id,
               CASE WHEN place <= greatest(2, CAST(floor(0.8e0 * (SELECT count(*) FROM customer)) AS BIGINT)) THEN 'analysis' ELSE 'assessment' END AS role FROM k""",
    "split_group": f"""
        WITH r AS (SELECT unnest([1, 2, 3]) AS rep), u AS (SELECT DISTINCT c_nationkey FROM customer),
        k AS (SELECT rep, c_nationkey, row_number() OVER (PARTITION BY rep ORDER BY {_DRAW.format(seed=7, unit='c_nationkey')}) AS place FROM u, r)
        SELECT printf('group_%03d', rep) AS split_id, CAST(c_custkey AS VARCHAR) AS sample_id,
               CASE WHEN place <= greatest(1, CAST(floor(0.5e0 * (SELECT count(*) FROM u)) AS BIGINT)) THEN 'analysis' ELSE 'assessment' END AS role
        FROM customer JOIN k USING (c_nationkey)""",
    "split_block": f"""
        WITH r AS (SELECT unnest([1, 2]) AS rep), o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS block FROM orders),
        u AS (SELECT DISTINCT block FROM o),
        k AS (SELECT rep, block, row_number() OVER (PARTITION BY rep ORDER BY {_DRAW.format(seed=3, unit='block')}) AS place FROM u, r)
        SELECT printf('block_%03d', rep) AS split_id,
               CASE WHEN place <= greatest(1, CAST(floor(0.7e0 * (SELECT count(*) FROM u)) AS BIGINT)) THEN 'analysis' ELSE 'assessment' END AS role,
               count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
        FROM o JOIN k USING (block) GROUP BY ALL""",
    "split_leave_domain": """
        WITH d AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM (SELECT DISTINCT r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)),
        c AS (SELECT r_name AS own FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        SELECT printf('leave_domain_%03d_%s', i, regexp_replace(r_name, '[^A-Za-z0-9_.]', '.', 'g')) AS split_id,
               CASE WHEN own = r_name THEN 'assessment' ELSE 'analysis' END AS role, r_name AS held_domain, count(*) AS n
        FROM c, d GROUP BY ALL""",
    "split_custom": """
        SELECT 'thirds' AS split_id, CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN c_custkey % 3 = 0 THEN 'analysis' ELSE 'assessment' END AS role FROM customer""",
    "split_duplicates": """
        WITH s AS (SELECT 'a' AS split_id, c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'b', c_custkey FROM customer WHERE c_custkey % 3 = 0
                   UNION ALL SELECT 'c', c_custkey FROM customer WHERE c_custkey % 4 % 2 = 0 UNION ALL SELECT 'd', c_custkey FROM customer WHERE c_custkey % 6 % 3 = 0),
        k AS (SELECT split_id, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS key FROM s GROUP BY split_id),
        f AS (SELECT split_id, min(split_id) OVER (PARTITION BY key) AS duplicate_of FROM k)
        SELECT * FROM f WHERE split_id > duplicate_of""",
    "align_layers": "SELECT c_custkey, c_acctbal, c_nationkey * 2 AS twice FROM customer",
    "csv_template": """
        SELECT printf('sample_%03d', i + 1) AS sample_id, printf('group_%02d', i // 3 + 1) AS sampling_group,
               CAST(DATE '2024-01-01' + CAST(i * 7 AS INTEGER) AS VARCHAR) AS survey_date, CASE WHEN i < 6 THEN 'north' ELSE 'south' END AS reporting_region,
               CASE i % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS external_label
        FROM range(12) t(i)""",
    "open_data_registry": """
        SELECT * FROM (VALUES ('zirbel_prairie', 'ecology', 'advanced_example'), ('nla_2022', 'environment', 'advanced_example')) t(id, domain, role)""",
}
