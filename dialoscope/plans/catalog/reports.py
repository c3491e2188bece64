"""Business report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoscope.operators import reports as rp
from dialoscope.plans.catalog import Catalog
from dialoscope.plans.fixtures import oracle, stored, table

CATALOG = Catalog()
add = CATALOG.add

AS_OF = "2000-06-30"
START, END = "1999-01-01", "1999-12-31"

LINES = """SELECT *, CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS v FROM lineitem"""
ORDS = f"""SELECT *, CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_orderstatus <> 'F' AS pending,
 date_diff('day', CAST(o_orderdate AS DATE) + 30, DATE '{AS_OF}') AS late FROM orders"""
SALES = "SELECT o_custkey AS c_custkey, sum(v) AS total_sales FROM lines JOIN ords ON l_orderkey = o_orderkey {} GROUP BY 1"


def rq(body: str, **more: str) -> str:
    return oracle([], body, lines=LINES, ords=ORDS, **more)


def t(spark, sf, *names):
    return [table(spark, sf, n) for n in names]


def dbl(expr: str) -> str:
    return f"CAST(coalesce({expr}, 0) AS DOUBLE)"


@add("top_customers", rq(f"""SELECT sNo, s.c_custkey, c_name, {dbl('total_sales')} AS total_sales, total_count,
 11 AS "startRecord", least(20, total_count) AS "endRecord" FROM (SELECT *, row_number() OVER
  (ORDER BY total_sales DESC, c_custkey) AS sNo, count(*) OVER () AS total_count FROM s) s JOIN customer c
 ON s.c_custkey = c.c_custkey WHERE sNo BETWEEN 11 AND 20""",
 s=SALES.format(f"WHERE l_shipdate >= '{START}' AND l_shipdate < '2000-01-01'")))
def top_customers(spark, sf):
    return rp.top_customers(*t(spark, sf, "lineitem", "orders", "customer"), START, END, 10, 10)


_KPI = f"""count(*) AS total_orders, {dbl('sum(total)')} AS total_order_value,
 CAST(coalesce(sum(n), 0) AS BIGINT) AS total_invoices, {dbl('sum(v)')} AS total_invoice_value,
 CAST(coalesce(sum(n) FILTER (pending), 0) AS BIGINT) AS pending_invoices,
 {dbl('sum(v) FILTER (pending)')} AS pending_invoice_value,
 {dbl('sum(total) FILTER (pending)')} AS total_outstanding_value FROM (SELECT * FROM ords
 WHERE o_orderdate >= '{START}' AND o_orderdate < '2000-01-01') o LEFT JOIN
 (SELECT l_orderkey, count(*) AS n, sum(v) AS v FROM lines GROUP BY 1) l ON o_orderkey = l_orderkey"""


@add("customer_kpis", rq(f"SELECT o_custkey, {_KPI} GROUP BY 1"))
def customer_kpis(spark, sf):
    return rp.customer_kpis(*t(spark, sf, "orders", "lineitem"), START, END)


_PROFILE = f"""SELECT c.c_custkey, c_name, c_mktsegment AS segment, n_name AS route, {dbl('outstanding')} AS outstanding_amount,
 {dbl('overdue')} AS overdue_amount, coalesce(lo.k, -1) AS latest_order_id, coalesce(strftime(lo.d, '%Y-%m-%d'), '') AS latest_order_date,
 {dbl('lo.a')} AS latest_order_amount, CASE WHEN li IS NULL THEN '' ELSE li.k || '-' || li.n END AS latest_invoice_number,
 coalesce(strftime(li.d, '%Y-%m-%d'), '') AS latest_invoice_date, {dbl('li.a')} AS latest_invoice_amount
 FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT o_custkey, max({{'d': o_orderdate, 'k': o_orderkey, 'a': total}}) AS lo, sum(total) FILTER (pending) AS outstanding,
  sum(total) FILTER (pending AND late > 0) AS overdue FROM ords GROUP BY 1) o ON c.c_custkey = o.o_custkey
 LEFT JOIN (SELECT o_custkey, max({{'d': l_shipdate, 'k': l_orderkey, 'n': l_linenumber, 'a': v}}) AS li
  FROM lines JOIN ords ON l_orderkey = o_orderkey GROUP BY 1) i ON c.c_custkey = i.o_custkey"""
_PROFILE_COLUMNS = ("c_custkey", "c_name", "segment", "route", "outstanding_amount", "overdue_amount", "latest_order_id",
                    "latest_order_date", "latest_order_amount", "latest_invoice_number", "latest_invoice_date",
                    "latest_invoice_amount")


def _plain(df):
    filled = {"latest_order_id": -1, "latest_order_amount": 0.0, "latest_invoice_amount": 0.0}
    out = df.na.fill(filled)
    for c in ("latest_order_date", "latest_invoice_date"):
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


@add("customer_profile", rq("SELECT * FROM p", p=_PROFILE))
def customer_profile(spark, sf):
    out = rp.customer_profile(*t(spark, sf, "customer", "orders", "lineitem", "nation"), AS_OF)
    return _plain(out).select(*_PROFILE_COLUMNS)


@add("customer_profile_page", rq("""SELECT p.*, row_number() OVER (ORDER BY c_custkey) + 40 AS "sNo",
 (SELECT count(*) FROM customer) AS total_count FROM (SELECT * FROM p ORDER BY c_custkey LIMIT 20 OFFSET 40) p""", p=_PROFILE))
def customer_profile_page(spark, sf):
    out = rp.customer_profile(*t(spark, sf, "customer", "orders", "lineitem", "nation"), AS_OF, limit=20, offset=40)
    return _plain(out).select(*_PROFILE_COLUMNS, "sNo", "total_count")


@add("product_view", rq(f"""SELECT p_name, current_stock, inventory_value, total_revenue, row_number() OVER (ORDER BY p_name) AS "sNo",
 (SELECT count(*) FROM g) AS total_count, 1 AS "startRecord", least(20, (SELECT count(*) FROM g)) AS "endRecord"
 FROM (SELECT * FROM g ORDER BY p_name LIMIT 20)""", g=f"""SELECT p_name, {dbl('sum(q)')} AS current_stock,
 {dbl('sum(q * CAST(p_retailprice AS DECIMAL(12,2)))')} AS inventory_value, {dbl('sum(v)')} AS total_revenue
 FROM (SELECT l_partkey, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS q, sum(v) AS v FROM lines GROUP BY 1)
 JOIN part ON l_partkey = p_partkey GROUP BY 1"""))
def product_view(spark, sf):
    return rp.product_view(*t(spark, sf, "part", "lineitem"), ["current_stock", "inventory_value", "total_revenue"])


_BUCKETS = f"""{dbl('sum(total) FILTER (late BETWEEN 0 AND 30)')} AS due_0_30, {dbl('sum(total) FILTER (late BETWEEN 31 AND 60)')} AS due_31_60,
 {dbl('sum(total) FILTER (late > 60)')} AS due_over_60, {dbl('sum(total) FILTER (late < 0 OR late IS NULL)')} AS due_other"""


@add("payment_ageing", rq(f"""SELECT coalesce(a.o_custkey, -1) AS o_custkey, coalesce(c_name, '') AS c_name, is_summary, due_0_30, due_31_60,
 due_over_60, due_other, outstanding FROM (SELECT o_custkey, grouping(o_custkey) AS is_summary, {_BUCKETS},
 {dbl('sum(total)')} AS outstanding FROM ords WHERE pending GROUP BY ROLLUP (o_custkey)) a
 LEFT JOIN customer ON a.o_custkey = c_custkey"""))
def payment_ageing(spark, sf):
    return rp.payment_ageing(*t(spark, sf, "orders", "customer"), AS_OF, include_summary=True).na.fill(
        {"o_custkey": -1, "c_name": ""})


_REQUEST = {"groupBy": ["o_orderpriority", "o_orderstatus"], "metrics": ["orders", "value"], "dateColumn": "o_orderdate",
            "fromDate": START, "endDate": END, "filters": {"o_orderstatus": ["O", "P"]},
            "sortBy": [{"column": "value", "order": "desc"}], "limit": 4, "offset": 2}
_GROUPED = f"""SELECT o_orderpriority, o_orderstatus, count(*) AS orders, {dbl('sum(total)')} AS value FROM ords
 WHERE o_orderdate >= '{START}' AND o_orderdate < '2000-01-01' AND o_orderstatus IN ('O', 'P') {{}} GROUP BY {{}}"""


def _analytics(spark, sf, **more):
    metrics = {"orders": F.count("*"), "value": F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double")}
    return rp.analytics(table(spark, sf, "orders"), {**_REQUEST, **more}, metrics, ["o_orderpriority", "o_orderstatus"])


@add("analytics_page", rq("""SELECT g.*, row_number() OVER (ORDER BY value DESC, o_orderpriority, o_orderstatus) + 2 AS "sNo",
 (SELECT count(*) FROM g) AS total_count, 3 AS "startRecord", least(6, (SELECT count(*) FROM g)) AS "endRecord"
 FROM (SELECT * FROM g ORDER BY value DESC, o_orderpriority, o_orderstatus LIMIT 4 OFFSET 2) g""",
 g=_GROUPED.format("", "1, 2")))
def analytics_page(spark, sf):
    return _analytics(spark, sf)


@add("analytics_summary", rq("""SELECT o_orderpriority, o_orderstatus, orders, value, false AS is_summary FROM (SELECT * FROM g
 ORDER BY value DESC, o_orderpriority, o_orderstatus LIMIT 4 OFFSET 2)
 UNION ALL SELECT '', '', CAST(sum(orders) AS BIGINT), (SELECT CAST(sum(total) AS DOUBLE) FROM ords
 WHERE o_orderdate >= '1999-01-01' AND o_orderdate < '2000-01-01' AND o_orderstatus IN ('O', 'P')), true FROM g""",
 g=_GROUPED.format("", "1, 2")))
def analytics_summary(spark, sf):
    out = _analytics(spark, sf, include_summary=True)
    return out.select("o_orderpriority", "o_orderstatus", "orders", "value", "is_summary").na.fill("")


@add("global_filter", rq("""SELECT o_orderpriority, count(*) AS n FROM ords WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')
 AND o_orderpriority NOT IN ('2-HIGH') GROUP BY 1"""))
def global_filter(spark, sf):
    kept = rp.global_filter(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], ["2-HIGH"])
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@add("visit_brief", rq(f"""SELECT p.c_custkey, p.segment, p.route, p.outstanding_amount, p.overdue_amount, p.latest_order_id,
 p.latest_invoice_number, coalesce(due_0_30, 0.0) AS due_0_30, coalesce(due_over_60, 0.0) AS due_over_60,
 {dbl('s.total_sales')} AS total_sales, coalesce(s.r, -1) AS sales_rank FROM p
 LEFT JOIN (SELECT o_custkey, {_BUCKETS} FROM ords WHERE pending GROUP BY 1) a ON p.c_custkey = a.o_custkey
 LEFT JOIN (SELECT *, rank() OVER (ORDER BY total_sales DESC) AS r FROM s) s ON p.c_custkey = s.c_custkey""",
 p=_PROFILE, s=SALES.format("")))
def visit_brief(spark, sf):
    customer, nation = t(spark, sf, "customer", "nation")
    facts = stored(rp.customer_facts(*t(spark, sf, "orders", "lineitem"), AS_OF), "customer-facts")
    out = _plain(rp.visit_brief(customer, facts, nation))
    return out.na.fill({"due_0_30": 0.0, "due_over_60": 0.0, "sales_rank": -1}).select(
        "c_custkey", "segment", "route", "outstanding_amount", "overdue_amount", "latest_order_id",
        "latest_invoice_number", "due_0_30", "due_over_60", "total_sales", "sales_rank")


@add("priority_list", rq(f"""SELECT c.c_custkey, c_name, {dbl('overdue')} AS overdue_amount, {dbl('total_sales')} AS total_sales
 FROM customer c LEFT JOIN (SELECT o_custkey, sum(total) AS overdue FROM ords WHERE pending AND late >= 0 GROUP BY 1) o
 ON c.c_custkey = o.o_custkey LEFT JOIN s ON c.c_custkey = s.c_custkey""", s=SALES.format("")))
def priority_list(spark, sf):
    return rp.priority_list(*t(spark, sf, "orders", "lineitem", "customer"), AS_OF)
