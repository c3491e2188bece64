"""Business report queries behind the agents' tools, on a star schema of customers, orders, invoice lines, parts.

Amounts are exact decimals until the last projection.  Facts are condensed on
their own key before they meet another table, so a heavy key costs one row in
the join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoscope.functions.ordered import global_rank

AGEING_BUCKETS = ("0-30", "31-60", ">60", "other")  # fixed values
DUE_COLUMNS = ("due_0_30", "due_31_60", "due_over_60", "due_other")
CREDIT_DAYS = 30


def money(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)")


def line_value() -> Column:
    """Invoice line value after discount."""
    return money("l_extendedprice") * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)"))


def is_pending() -> Column:
    return F.col("o_orderstatus") != "F"


def in_range(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows with the date within [start, end], as a half-open comparison the scan can use."""
    kind = df.schema[column].dataType
    out = df
    if start:
        out = out.where(F.col(column) >= F.lit(start).cast(kind))
    if end:
        after = (date.fromisoformat(end) + timedelta(days=1)).isoformat()
        out = out.where(F.col(column) < F.lit(after).cast(kind))
    return out


def _amount(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0)).cast("double")


def page_of(ranked: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, total: Column | None = None) -> DataFrame:
    """One page with serial number, total count and the first and last record number.

    The page is cut by a distributed top-k first, so the numbering window sees
    at most ``limit`` rows.  ``total`` gives the number of all rows where it is
    cheaper to have than by counting ``ranked``.
    """
    if limit <= 0 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    total = ranked.agg(F.count("*").alias("n")).scalar() if total is None else total
    cut = ranked.orderBy(*order)
    cut = (cut.offset(offset) if offset else cut).limit(limit)
    return (cut.withColumn("sNo", F.row_number().over(Window.orderBy(*order)) + offset)
            .withColumn("total_count", total).withColumn("startRecord", F.lit(offset + 1))
            .withColumn("endRecord", F.least(F.lit(offset + limit).cast("bigint"), F.col("total_count"))))


def sales_by_customer(lineitem: DataFrame, orders: DataFrame, start: str | None = None,
                      end: str | None = None) -> DataFrame:
    """Invoiced value per customer in a range of invoice dates."""
    lines = in_range(lineitem, "l_shipdate", start, end)
    per_order = lines.groupBy("l_orderkey").agg(F.sum(line_value()).alias("v"))
    return (per_order.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("v").alias("total_sales")))


def top_customers(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, start: str | None, end: str | None,
                  limit: int = 10, offset: int = 0) -> DataFrame:
    """Customers ranked by sales; names are looked up for the page alone."""
    sales = sales_by_customer(lineitem, orders, start, end)
    buyers = orders.join(in_range(lineitem, "l_shipdate", start, end), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi") \
        .agg((F.count_distinct("o_custkey") + F.max(F.when(F.col("o_custkey").isNull(), 1).otherwise(0))).alias("n")).scalar()
    page = page_of(sales, [F.desc("total_sales"), F.asc("c_custkey")], limit, offset, F.coalesce(buyers, F.lit(0).cast("bigint")))
    return (page.join(customer.select("c_custkey", "c_name"), "c_custkey")
            .select("sNo", "c_custkey", "c_name", _amount("total_sales").alias("total_sales"), "total_count",
                    "startRecord", "endRecord"))


def customer_kpis(orders: DataFrame, lineitem: DataFrame, start: str | None = None, end: str | None = None,
                  keys: Sequence[str] = ("o_custkey",)) -> DataFrame:
    """Orders, invoices, pending invoices and outstanding value per customer (or overall without keys)."""
    chosen = in_range(orders, "o_orderdate", start, end).select(
        "o_orderkey", *keys, money("o_totalprice").alias("total"), is_pending().alias("pending"))
    lines = lineitem
    if start or end:  # only lines of the chosen orders are summed
        lines = lines.join(chosen.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    invoices = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(line_value()).alias("v"))
    rows = chosen.join(invoices, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n, v = F.coalesce("n", F.lit(0)), F.col("v")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total_orders"), _amount(F.sum("total")).alias("total_order_value"),
        F.sum(n).alias("total_invoices"), _amount(F.sum(v)).alias("total_invoice_value"),
        F.sum(F.when(F.col("pending"), n).otherwise(0)).alias("pending_invoices"),
        _amount(F.sum(F.when(F.col("pending"), v))).alias("pending_invoice_value"),
        _amount(F.sum(F.when(F.col("pending"), F.col("total")))).alias("total_outstanding_value"))


def customer_profile(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, nation: DataFrame, as_of: str,
                     limit: int | None = None, offset: int = 0, selected: bool = False) -> DataFrame:
    """Master profile: segment, route, latest order and invoice, outstanding and overdue amounts.

    With ``limit`` the page of customers is cut first and the facts are read
    for those alone.  ``selected`` says that ``orders`` holds few customers, so
    that invoice lines are cut to their orders before anything is summed.
    What has no source here (payments, credit limit, team,
    check-in) stays NULL.
    """
    who = customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    facts = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    lines = lineitem
    if limit is not None:
        who = page_of(who, [F.asc("c_custkey")], limit, offset)
        only = who.select(F.col("c_custkey").alias("o_custkey"))
        facts = facts.join(only, "o_custkey", "left_semi")
    if selected or limit is not None:
        lines = lines.join(facts.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    overdue = is_pending() & (F.date_add(F.col("o_orderdate").cast("date"), CREDIT_DAYS) < F.lit(as_of).cast("date"))
    last_order = F.max(F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k"),
                                money("o_totalprice").alias("a")))
    per_customer = facts.groupBy("o_custkey").agg(
        last_order.alias("lo"), F.sum(F.when(is_pending(), money("o_totalprice"))).alias("outstanding"),
        F.sum(F.when(overdue, money("o_totalprice"))).alias("overdue"))
    newest_line = F.max(F.struct(F.col("l_shipdate").alias("d"), F.col("l_orderkey").alias("k"),
                                 F.col("l_linenumber").alias("n"), line_value().alias("a")))
    per_order = lines.groupBy("l_orderkey").agg(newest_line.alias("li"))
    invoices = (facts.select("o_orderkey", "o_custkey")
                .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
                .groupBy(F.col("o_custkey").alias("i_custkey")).agg(F.max("li").alias("li")))
    routes = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("route"))
    joined = (who.join(routes, "c_nationkey", "left")
              .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
              .join(invoices, F.col("c_custkey") == F.col("i_custkey"), "left"))
    return _profile(joined, ["sNo", "total_count", "startRecord", "endRecord"] if limit is not None else [])


def _profile(joined: DataFrame, more: Sequence[Column | str]) -> DataFrame:
    """The profile's columns, and ``more``."""
    nothing = {"credit_limit": "double", "latest_payment_amount": "double", "latest_payment_number": "string",
               "team_member": "string", "latest_checkin_date": "date"}
    return joined.select(
        "c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), "route",
        _amount("outstanding").alias("outstanding_amount"), _amount("overdue").alias("overdue_amount"),
        F.col("lo.k").alias("latest_order_id"), F.col("lo.d").cast("date").alias("latest_order_date"),
        F.col("lo.a").cast("double").alias("latest_order_amount"),
        F.concat_ws("-", "li.k", "li.n").alias("latest_invoice_number"),
        F.col("li.d").cast("date").alias("latest_invoice_date"),
        F.col("li.a").cast("double").alias("latest_invoice_amount"),
        *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], *more)


def product_view(part: DataFrame, lineitem: DataFrame, metrics: Sequence[str], start: str | None = None,
                 end: str | None = None, group_by: str = "p_name", sort_by: str | None = None, ascending: bool = True,
                 limit: int = 20, offset: int = 0) -> DataFrame:
    """Chosen product metrics by item, sorted and paged.

    Stock has no source here: the quantity sold stands in for it.
    """
    offered = {"current_stock": F.sum("q"), "inventory_value": F.sum(F.col("q") * money("p_retailprice")),
               "total_revenue": F.sum("v")}
    unknown = [m for m in metrics if m not in offered]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; offered: {sorted(offered)}")
    sold = in_range(lineitem, "l_shipdate", start, end).groupBy("l_partkey").agg(
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("q"), F.sum(line_value()).alias("v"))
    items = sold.join(part.select("p_partkey", group_by, "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    grouped = items.groupBy(group_by).agg(*[_amount(offered[m]).alias(m) for m in metrics])
    key = F.col(sort_by or group_by)
    return page_of(grouped, [key.asc() if ascending else key.desc(), F.asc(group_by)], limit, offset)


def ageing_bucket(days: Column) -> Column:
    """Bucket of days past due; not yet due or unknown is ``other``."""
    return (F.when(days.between(0, 30), AGEING_BUCKETS[0]).when(days.between(31, 60), AGEING_BUCKETS[1])
            .when(days > 60, AGEING_BUCKETS[2]).otherwise(AGEING_BUCKETS[3]))


def _aged(orders: DataFrame, as_of: str, basis: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    due = {"due_date": F.date_add(day, CREDIT_DAYS), "invoice_date": day}[basis]
    return orders.where(is_pending()).select(
        "o_custkey", money("o_totalprice").alias("amount"),
        ageing_bucket(F.datediff(F.lit(as_of).cast("date"), due)).alias("bucket"))


def payment_ageing(orders: DataFrame, customer: DataFrame | None, as_of: str, basis: str = "due_date",
                   include_summary: bool = False) -> DataFrame:
    """Outstanding amount per customer and ageing bucket, optionally with a totals row (NULL customer)."""
    aged = _aged(orders, as_of, basis)
    grouped = aged.rollup("o_custkey") if include_summary else aged.groupBy("o_custkey")
    named = dict(zip(AGEING_BUCKETS, DUE_COLUMNS))
    sums = [_amount(F.sum(F.when(F.col("bucket") == b, F.col("amount")))).alias(c) for b, c in named.items()]
    flag = [F.grouping("o_custkey").alias("is_summary")] if include_summary else []
    out = grouped.agg(*flag, *sums, _amount(F.sum("amount")).alias("outstanding"))
    if customer is None:
        return out
    names = customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return out.join(names, "o_custkey", "left")


def global_filter(df: DataFrame, column: str, include: Sequence = (), exclude: Sequence = ()) -> DataFrame:
    """Keep listed values, drop listed values; an empty list does nothing."""
    out = df.where(F.col(column).isin(list(include))) if include else df
    return out.where(~F.coalesce(F.col(column).isin(list(exclude)), F.lit(False))) if exclude else out


def analytics(df: DataFrame, request: Mapping, metrics: Mapping[str, Column], dimensions: Sequence[str]) -> DataFrame:
    """Generic report request over a fact frame.

    ``request`` may hold groupBy, metrics, dateColumn, fromDate, endDate,
    filters (column to value or list), global_filter (column, pos, neg), sortBy
    (list of column, order), limit, offset and include_summary.  Every name is
    checked against ``metrics``, ``dimensions`` or the frame.
    """
    groups, wanted = list(request.get("groupBy", [])), list(request["metrics"])
    sort = [(s["column"], s.get("order", "asc")) for s in request.get("sortBy", [])]
    for names, allowed, what in ((groups, dimensions, "group"), (wanted, metrics, "metric"),
                                 ([c for c, _ in sort], [*groups, *wanted], "sort column"),
                                 (request.get("filters", {}), df.columns, "filter column")):
        bad = [n for n in names if n not in allowed]
        if bad:
            raise ValueError(f"unknown {what} {bad}; allowed: {sorted(allowed)}")
    rows = df
    if request.get("dateColumn"):
        rows = in_range(rows, request["dateColumn"], request.get("fromDate"), request.get("endDate"))
    for column, value in request.get("filters", {}).items():
        rows = rows.where(F.col(column).isin(list(value) if isinstance(value, (list, tuple)) else [value]))
    if request.get("global_filter"):
        g = request["global_filter"]
        rows = global_filter(rows, g["column"], g.get("pos", ()), g.get("neg", ()))
    aggregates = [metrics[m].alias(m) for m in wanted]
    grouped = rows.groupBy(*groups).agg(*aggregates)
    order = [F.col(c).desc() if o == "desc" else F.col(c).asc() for c, o in sort]
    order += [F.col(g).asc() for g in groups if g not in [c for c, _ in sort]]
    page = page_of(grouped, order or [F.lit(1)], request.get("limit", 20), request.get("offset", 0))
    if not request.get("include_summary"):
        return page
    totals = rows.agg(*aggregates)
    return (page.withColumn("is_summary", F.lit(False))
            .unionByName(totals.withColumn("is_summary", F.lit(True)), allowMissingColumns=True))


def sales_rank(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Sales and sales rank (1 = largest) of every customer with sales."""
    return global_rank(sales_by_customer(lineitem, orders), "total_sales", "sales_rank")


def customer_facts(orders: DataFrame, lineitem: DataFrame, as_of: str) -> DataFrame:
    """Everything that orders and invoice lines say of a customer, one row each, from one pass over both tables.

    Latest order (lo) and invoice line (li), outstanding and overdue amount, amounts by
    ageing bucket, invoiced value (total_sales, NULL without invoices).
    """
    newest_line = F.max(F.struct(F.col("l_shipdate").alias("d"), F.col("l_orderkey").alias("k"),
                                 F.col("l_linenumber").alias("n"), line_value().alias("a")))
    invoices = lineitem.groupBy("l_orderkey").agg(newest_line.alias("li"), F.sum(line_value()).alias("v"))
    day, total = F.col("o_orderdate").cast("date"), money("o_totalprice")
    due = F.date_add(day, CREDIT_DAYS)
    rows = orders.select(
        "o_orderkey", "o_custkey", F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k"), total.alias("a")).alias("lo"),
        F.when(is_pending(), total).alias("open"), (due < F.lit(as_of).cast("date")).alias("late"),
        ageing_bucket(F.datediff(F.lit(as_of).cast("date"), due)).alias("bucket"))
    rows = rows.join(invoices, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("lo").alias("lo"), F.max("li").alias("li"), F.sum("v").alias("total_sales"), F.sum("open").alias("outstanding"),
        F.sum(F.when(F.col("late"), F.col("open"))).alias("overdue"), F.count("open").alias("pending"),
        *[F.sum(F.when(F.col("bucket") == b, F.col("open"))).alias(c) for b, c in zip(AGEING_BUCKETS, DUE_COLUMNS)])


def visit_brief(customer: DataFrame, facts: DataFrame, nation: DataFrame, custkey: int | None = None) -> DataFrame:
    """Profile, ageing and sales rank of one or all customers, from ``customer_facts``.

    The rank looks at all customers' facts several times: hand them over stored.
    """
    who = customer if custkey is None else customer.where(F.col("c_custkey") == custkey)
    ranked = global_rank(facts.where("total_sales IS NOT NULL").select("c_custkey", "total_sales"), "total_sales", "sales_rank").drop("total_sales")
    own = facts if custkey is None else facts.where(F.col("c_custkey") == custkey)
    routes = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("route"))
    joined = who.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").join(routes, "c_nationkey", "left") \
        .join(own, "c_custkey", "left").join(ranked, "c_custkey", "left")
    owes = F.col("pending") > 0  # no ageing for customers without pending orders
    return _profile(joined, [*[F.when(owes, _amount(c)).alias(c) for c in DUE_COLUMNS], _amount("total_sales").alias("total_sales"), F.col("sales_rank")])


def priority_list(orders: DataFrame, lineitem: DataFrame, customer: DataFrame, as_of: str) -> DataFrame:
    """Whom to call: customers by overdue amount, then by sales."""
    late = _aged(orders, as_of, "due_date").where(F.col("bucket") != AGEING_BUCKETS[3])
    overdue = late.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("amount").alias("overdue"))
    sales = sales_by_customer(lineitem, orders)
    return (customer.select("c_custkey", "c_name").join(overdue, "c_custkey", "left").join(sales, "c_custkey", "left")
            .select("c_custkey", "c_name", _amount("overdue").alias("overdue_amount"),
                    _amount("total_sales").alias("total_sales"))
            .orderBy(F.desc("overdue_amount"), F.desc("total_sales"), "c_custkey"))
