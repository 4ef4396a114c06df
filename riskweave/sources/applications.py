"""The ``applications`` view: one row per order, shaped like a loan application.

Built from orders, customer, nation, lineitem and part with DataFrame joins and
two pre-aggregations (lineitem per order, orders per customer), so every
downstream operator works on data whose volume grows with the driver tables.
Each join key is unique on its right side after the pre-aggregation, so joins
never fan out. The small dimensions (nation; part is keyed by a unique key)
are left to AQE, which broadcasts a side only after measuring it at runtime.

``raw_applications`` re-renders typed columns as the raw strings of a CSV
export (percent signs, "36 months", "Dec-2015", "10+ years") so the parsing
operators (N1-N5, IO1) have real input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def _date(c: str) -> Column:
    # Parquet timestamps load as timestamp_ntz; a date cast is zone independent.
    return F.to_date(F.col(c))


_VIEWS: dict = {}


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view, lazily: a job selects what it needs (and materialises only that, if it reads it in several passes)."""
    key = (id(spark), sf_dir)
    hit = _VIEWS.get(key)
    if hit is not None and hit[0] is spark:
        return hit[1]
    out = _applications(spark, sf_dir)   # the definition is memoised per session (analysis runs once)
    _VIEWS[key] = (spark, out)
    return out


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    lineitem = table(spark, sf_dir, "lineitem")

    li = (lineitem.groupBy("l_orderkey")
          .agg(F.max("l_shipdate").alias("last_ship"),
               F.min("l_partkey").alias("pk"),
               F.count(F.lit(1)).alias("n_items"),
               F.avg("l_discount").alias("disc"),
               F.avg("l_tax").alias("tax"),
               F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("rebate")))
    cu = (orders.groupBy(F.col("o_custkey").alias("ck"))
          .agg(F.min("o_orderdate").alias("first_od"),
               F.count(F.lit(1)).alias("total_acc_n"),
               F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("open_acc_n")))

    j = (orders
         .join(customer, orders.o_custkey == customer.c_custkey)
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(cu, F.col("ck") == F.col("o_custkey"))
         .join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
         .join(part, F.col("p_partkey") == F.col("pk"), "left"))

    key = F.col("o_orderkey")
    grade = (F.when(F.substring("o_orderpriority", 1, 1) == "1", "A")
             .when(F.substring("o_orderpriority", 1, 1) == "2", "B")
             .when(F.substring("o_orderpriority", 1, 1) == "3", "C")
             .when(F.substring("o_orderpriority", 1, 1) == "4", "D")
             .otherwise("E"))
    return j.select(
        key.alias("id"),
        F.trunc(_date("o_orderdate"), "month").alias("issue_d"),
        _date("first_od").alias("earliest_cr_line"),
        F.when(key % 13 == 0, F.lit(None).cast("date")).otherwise(_date("last_ship")).alias("last_pymnt_d"),
        F.when(F.col("o_orderstatus") == "F", "Charged Off")
         .when(F.col("o_orderstatus") == "P", "Fully Paid").otherwise("Current").alias("loan_status"),
        (F.col("o_totalprice") / F.lit(10)).alias("loan_amnt"),
        (F.col("c_acctbal") * F.lit(100)).alias("annual_inc"),
        (F.col("o_totalprice") / F.lit(5000)).alias("dti"),
        F.when(key % 4 == 0, F.lit(60.0)).otherwise(F.lit(36.0)).alias("term"),
        (F.lit(5.0) + F.lit(100.0) * F.col("disc")).alias("int_rate"),
        (F.lit(1000.0) * F.col("tax")).alias("revol_util"),
        F.col("rebate").alias("revol_bal"),
        F.when(key % 20 == 0, F.lit(None).cast("double"))
         .otherwise((F.col("o_custkey") % 11).cast("double")).alias("emp_length"),
        grade.alias("grade"),
        F.col("c_mktsegment").alias("home_ownership"),
        F.col("p_type").alias("purpose"),
        F.col("n_name").alias("addr_state"),
        F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type")).alias("emp_title"),
        F.when(key % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("p_name"))).alias("title"),
        F.concat((F.col("o_custkey") % 199).cast("string"), F.lit("xx")).alias("zip_code"),
        F.col("open_acc_n").cast("double").alias("open_acc"),
        F.col("total_acc_n").cast("double").alias("total_acc"),
        (F.col("n_items") % 4).cast("double").alias("delinq_2yrs"),
        (key % 3).cast("double").alias("pub_rec"),
        (F.lit(0.5) * ((key * 7919) % 10007) / F.lit(10007) + F.lit(1e-6) * F.col("o_totalprice")).alias("score"),
    )


# Same view as SQL text (runs on Spark SQL and DuckDB alike); used by the
# oracle queries as a common table expression.
APPLICATIONS_SQL = """
WITH li AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship, min(l_partkey) AS pk, count(*) AS n_items,
         avg(l_discount) AS disc, avg(l_tax) AS tax, sum(l_extendedprice * l_discount) AS rebate
  FROM lineitem GROUP BY l_orderkey),
cu AS (
  SELECT o_custkey AS ck, min(o_orderdate) AS first_od, count(*) AS total_acc,
         sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS open_acc
  FROM orders GROUP BY o_custkey)
SELECT o_orderkey AS id,
  CAST(date_trunc('month', o_orderdate) AS date) AS issue_d,
  CAST(first_od AS date) AS earliest_cr_line,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(last_ship AS date) END AS last_pymnt_d,
  CASE o_orderstatus WHEN 'F' THEN 'Charged Off' WHEN 'P' THEN 'Fully Paid' ELSE 'Current' END AS loan_status,
  o_totalprice / 10 AS loan_amnt,
  c_acctbal * 100 AS annual_inc,
  o_totalprice / 5000 AS dti,
  CASE WHEN o_orderkey % 4 = 0 THEN 60e0 ELSE 36e0 END AS term,
  5e0 + 100e0 * disc AS int_rate,
  1000e0 * tax AS revol_util,
  rebate AS revol_bal,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE CAST(o_custkey % 11 AS double) END AS emp_length,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' WHEN '4' THEN 'D' ELSE 'E' END AS grade,
  c_mktsegment AS home_ownership, p_type AS purpose, n_name AS addr_state,
  p_brand || ' ' || p_type AS emp_title,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority || ' ' || p_name END AS title,
  CAST(o_custkey % 199 AS varchar(8)) || 'xx' AS zip_code,
  CAST(open_acc AS double) AS open_acc, CAST(total_acc AS double) AS total_acc,
  CAST(n_items % 4 AS double) AS delinq_2yrs, CAST(o_orderkey % 3 AS double) AS pub_rec,
  5e-1 * ((o_orderkey * 7919) % 10007) / 10007 + 1e-6 * o_totalprice AS score
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN cu ON ck = o_custkey LEFT JOIN li ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = pk
"""


def raw_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications rendered as the all-string columns of a raw CSV export."""
    a = applications(spark, sf_dir)
    emp = (F.when(F.col("emp_length").isNull(), F.lit(None).cast("string"))
           .when(F.col("emp_length") == 0, F.lit("< 1 year"))
           .when(F.col("emp_length") >= 10, F.lit("10+ years"))
           .when(F.col("emp_length") == 1, F.lit("1 year"))
           .otherwise(F.concat(F.col("emp_length").cast("int").cast("string"), F.lit(" years"))))
    return a.select(
        F.col("id").cast("string").alias("id"),
        F.date_format("issue_d", "MMM-yyyy").alias("issue_d"),
        F.concat(F.lit(" "), F.col("loan_amnt").cast("string")).alias("loan_amnt"),
        F.concat(F.lit(" "), F.col("term").cast("int").cast("string"), F.lit(" months")).alias("term"),
        F.concat(F.col("int_rate").cast("string"), F.lit("%")).alias("int_rate"),
        F.concat(F.lit(" "), F.col("grade"), F.lit(" ")).alias("grade"),
        F.col("emp_title"),
        emp.alias("emp_length"),
        F.col("home_ownership"),
        F.col("annual_inc").cast("string").alias("annual_inc"),
        F.col("purpose"),
        F.col("title"),
        F.col("zip_code"),
        F.col("addr_state"),
        F.col("dti").cast("string").alias("dti"),
        F.col("delinq_2yrs").cast("string").alias("delinq_2yrs"),
        F.lower(F.date_format("earliest_cr_line", "MMM-yyyy")).alias("earliest_cr_line"),
        F.col("open_acc").cast("string").alias("open_acc"),
        F.col("pub_rec").cast("string").alias("pub_rec"),
        F.col("revol_bal").cast("string").alias("revol_bal"),
        F.when(F.col("revol_util").isNull(), F.lit("nan"))
         .otherwise(F.concat(F.lit(" "), F.col("revol_util").cast("string"), F.lit("%"))).alias("revol_util"),
        F.col("total_acc").cast("string").alias("total_acc"),
        F.col("loan_status"),
        F.date_format("last_pymnt_d", "MMM-yyyy").alias("last_pymnt_d"),
    )
