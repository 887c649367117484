"""DuckDB SQL for the named reports: what each metric means, computed in two steps.

A line is first reduced to what it sold: ``sold`` has one row per order, product and
seller inside the window, with its number of lines, units and money. Metrics are
then sums over ``sold`` or over one row a buyer. Money is exact (DECIMAL) until the
last cast. The report time is fixed at 2001-08-01, the last order day, so all three
windows (rolling month, picked range, calendar month) begin on 2001-07-01.
"""

from __future__ import annotations

from ..sources.testdata import ORACLE_STAR_CTES

FIRST_DAY = "TIMESTAMP '2001-07-01 00:00:00'"
LAST_DAY = "TIMESTAMP '2001-08-01 00:00:00'"
OPEN_END, PICKED_RANGE = f">= {FIRST_DAY}", f"BETWEEN {FIRST_DAY} AND {LAST_DAY}"

N = "CAST(sum(lines) AS BIGINT)"
UNITS = "CAST(sum(units) AS BIGINT)"
MONEY = "CAST(sum(money) AS DOUBLE)"


def _sold(select: str, window: str = OPEN_END, more: str = "") -> str:
    """A query over what was sold in the window."""
    return f"""WITH {ORACLE_STAR_CTES},
line AS (SELECT order_id, product_id, seller_id, count(*) AS lines, sum(quantity) AS units FROM oi GROUP BY ALL),
sold AS (SELECT line.*, user_id, CAST(order_date AS DATE) AS day, CAST(date_trunc('month', order_date) AS DATE) AS month,
                units * external_price AS money, product_name, main_category, sub_category
         FROM (SELECT * FROM o WHERE order_date {window}) JOIN line USING (order_id) JOIN p USING (product_id)){more}
{select}"""


def _buyers(select: str, per: str = "") -> str:
    """A query over one row a buyer (and month): age, lines and money."""
    return _sold(select, more=f""",
buyer AS (SELECT {per} user_id, any_value(user_age) AS age, sum(lines) AS lines, sum(money) AS money
          FROM sold JOIN u USING (user_id) GROUP BY ALL)""")


def _age_counts(names: tuple[str, str, str, str]) -> str:
    tests = ("age < 25", "age BETWEEN 25 AND 35", "age BETWEEN 36 AND 45", "age > 45")
    return ", ".join(f"count(*) FILTER ({t}) AS {n}" for t, n in zip(tests, names))


def _logins(select: str) -> str:
    """A query over customers with their first and last order as join and login dates."""
    return f"""WITH seen AS (SELECT o_custkey, min(o_orderdate) AS joined, max(o_orderdate) AS login FROM orders GROUP BY 1),
person AS (SELECT CAST(18 + c_custkey % 48 AS INTEGER) AS age, joined, login
           FROM customer JOIN seen ON seen.o_custkey = customer.c_custkey)
{select}"""


def _orders_a_day(measure: str) -> str:
    return f"""SELECT CAST(o_orderdate AS DATE) AS time, {measure} FROM orders
WHERE o_orderdate {PICKED_RANGE} GROUP BY time ORDER BY time"""


REPORT_SQL = {
    "top_sellers": _sold(f"""SELECT first_name, last_name, {N} AS total_orders, {UNITS} AS total_items_sold, {MONEY} AS total_revenue
FROM sold JOIN s USING (seller_id) GROUP BY ALL ORDER BY sum(money) DESC, first_name, last_name LIMIT 10"""),
    "top_categories": _sold(f"""SELECT main_category, {N} AS total_orders, {UNITS} AS total_quantity_sold, {MONEY} AS total_revenue
FROM sold GROUP BY ALL ORDER BY sum(money) DESC"""),
    "customer_demographics": _buyers(f"""SELECT CAST(sum(age * lines) AS DOUBLE) / {N} AS average_age, count(*) AS total_customers,
       {MONEY} / count(*) AS average_spend, {_age_counts(("under_25", "age_25_35", "age_36_45", "over_45"))} FROM buyer"""),
    "sales_metrics": _sold(f"""SELECT day AS time, {N} AS total_orders, {UNITS} AS total_items_sold, {MONEY} AS total_revenue,
       {MONEY} / {N} AS average_order_value FROM sold GROUP BY day ORDER BY day"""),
    "product_performance": _sold(f"""SELECT product_name, main_category, {N} AS total_orders, {UNITS} AS total_quantity_sold,
       {MONEY} AS total_revenue FROM sold GROUP BY ALL ORDER BY sum(money) DESC, product_name, main_category LIMIT 10"""),
    "daily_sales_trend": _sold(f"""SELECT day AS time, {MONEY} AS daily_revenue, {N} AS daily_orders, {UNITS} AS daily_items_sold
FROM sold GROUP BY day ORDER BY day"""),
    "category_distribution": _sold(f"""SELECT main_category, count(DISTINCT order_id) AS order_count, {UNITS} AS items_sold,
       {MONEY} AS category_revenue, {MONEY} / (SELECT {MONEY} FROM sold) * 100 AS revenue_percentage
FROM sold GROUP BY main_category ORDER BY category_revenue DESC"""),
    "customer_age_distribution": _buyers(f"""SELECT CASE WHEN age < 25 THEN 'Under 25' WHEN age <= 35 THEN '25-35'
       WHEN age <= 45 THEN '36-45' ELSE 'Over 45' END AS age_group, count(*) AS customer_count, {MONEY} AS group_revenue,
       {MONEY} / {N} AS average_spend FROM buyer GROUP BY age_group ORDER BY customer_count DESC"""),
    "panel_daily_revenue": _sold(f"SELECT day AS time, {MONEY} AS daily_revenue FROM sold GROUP BY day ORDER BY day", PICKED_RANGE),
    "panel_revenue_by_category": _sold(f"SELECT main_category, {MONEY} AS category_revenue FROM sold GROUP BY ALL", PICKED_RANGE),
    "panel_daily_active_customers": _orders_a_day("count(DISTINCT o_custkey) AS total_customers"),
    "panel_daily_average_age": _logins(f"""SELECT CAST(login AS DATE) AS time, CAST(sum(age) AS DOUBLE) / count(age) AS average_age
FROM person WHERE login {PICKED_RANGE} GROUP BY time ORDER BY time"""),
    "panel_revenue_by_seller": _sold(f"""SELECT concat_ws(' ', any_value(first_name), any_value(last_name)) AS seller_name,
       {MONEY} AS seller_revenue FROM sold JOIN s USING (seller_id) GROUP BY seller_id ORDER BY seller_revenue DESC""", PICKED_RANGE),
    "panel_items_by_seller": _sold(f"""SELECT concat_ws(' ', any_value(first_name), any_value(last_name)) AS seller_name,
       {UNITS} AS items_sold FROM sold JOIN s USING (seller_id) GROUP BY seller_id ORDER BY items_sold DESC""", PICKED_RANGE),
    "panel_daily_orders": _orders_a_day("count(*) AS total_orders"),
    "panel_daily_new_users": _logins(f"""SELECT CAST(joined AS DATE) AS time, count(*) AS new_users
FROM person WHERE joined {PICKED_RANGE} GROUP BY time ORDER BY time"""),
    "mv_top_sellers_month": _sold(f"""SELECT month, seller_id, any_value(first_name) AS seller_first_name,
       any_value(last_name) AS seller_last_name, {N} AS total_orders, {UNITS} AS total_items_sold,
       count(DISTINCT user_id) AS unique_customers, {MONEY} AS total_revenue, {MONEY} / {N} AS average_order_value
FROM sold JOIN s USING (seller_id) GROUP BY month, seller_id"""),
    "mv_top_categories_month": _sold(f"""SELECT month, main_category, {N} AS total_orders, {UNITS} AS total_quantity_sold,
       count(DISTINCT user_id) AS unique_customers, {MONEY} AS total_revenue, {MONEY} / {N} AS average_order_value
FROM sold GROUP BY month, main_category"""),
    "mv_customer_demographics_month": _buyers(f"""SELECT month, CAST(sum(age * lines) AS DOUBLE) / {N} AS average_customer_age,
       count(*) AS total_customers, {MONEY} / count(*) AS average_customer_spend,
       {_age_counts(("customers_under_25", "customers_25_35", "customers_36_45", "customers_over_45"))},
       {MONEY} AS total_revenue FROM buyer GROUP BY month""", "month,"),
    "mv_sales_metrics_month": _sold(f"""SELECT month, {N} AS total_orders, {UNITS} AS total_items_sold,
       count(DISTINCT user_id) AS unique_customers, {MONEY} AS total_revenue, {MONEY} / {N} AS average_order_value,
       {MONEY} / count(DISTINCT user_id) AS revenue_per_customer, CAST(sum(units) AS DOUBLE) / {N} AS average_items_per_order
FROM sold GROUP BY month"""),
    "mv_product_performance_month": _sold(f"""SELECT month, product_id, any_value(product_name) AS product_name,
       any_value(main_category) AS main_category, any_value(sub_category) AS sub_category, {N} AS total_orders,
       {UNITS} AS total_quantity_sold, count(DISTINCT user_id) AS unique_customers, {MONEY} AS total_revenue,
       {MONEY} / {N} AS average_selling_price FROM sold GROUP BY month, product_id"""),
}
