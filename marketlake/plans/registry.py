"""Query registry: ``name -> (spark, sf_dir) -> DataFrame`` plus oracle SQL.

Every entry reads the driver's tables under ``sf_dir`` (whole tables, no
sampling); the report clock is fixed at the last order day so results are
reproducible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import Star
from . import reports as R
from .catalog_queries import CATALOG_QUERIES, CATALOG_SQL
from .cdc_queries import CDC_QUERIES, CDC_SQL
from .delta_queries import DELTA_QUERIES, DELTA_SQL
from .extra_queries import EXTRA_QUERIES, EXTRA_SQL
from .history_queries import HISTORY_QUERIES, HISTORY_SQL
from .layout_queries import LAYOUT_QUERIES, LAYOUT_SQL
from .lookup_queries import LOOKUP_QUERIES, LOOKUP_SQL
from .oracle_reports import REPORT_SQL
from .order_queries import ORDER_QUERIES, ORDER_SQL
from .quality_queries import QUALITY_QUERIES, QUALITY_SQL
from .refusal_queries import REFUSAL_QUERIES, REFUSAL_SQL
from .search_queries import SEARCH_QUERIES, SEARCH_SQL
from .survey_queries import SURVEY_QUERIES, SURVEY_SQL
from .violation_queries import VIOLATION_QUERIES, VIOLATION_SQL

QueryFn = Callable[[SparkSession, str], DataFrame]


def _report(fn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Star(spark, sf_dir), as_of=R.DEFAULT_AS_OF)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    q: dict[str, QueryFn] = {name: _report(fn) for name, fn in R.REPORTS.items()}
    q.update(CDC_QUERIES)
    q.update(CATALOG_QUERIES)
    q.update(ORDER_QUERIES)
    q.update(SEARCH_QUERIES)
    q.update(QUALITY_QUERIES)
    q.update(LOOKUP_QUERIES)
    q.update(EXTRA_QUERIES)
    q.update(SURVEY_QUERIES)
    q.update(DELTA_QUERIES)
    q.update(HISTORY_QUERIES)
    q.update(REFUSAL_QUERIES)
    q.update(LAYOUT_QUERIES)
    q.update(VIOLATION_QUERIES)
    return q


def oracle_sql() -> dict[str, str]:
    sql = dict(REPORT_SQL)
    sql.update(CDC_SQL)
    sql.update(CATALOG_SQL)
    sql.update(ORDER_SQL)
    sql.update(SEARCH_SQL)
    sql.update(QUALITY_SQL)
    sql.update(LOOKUP_SQL)
    sql.update(EXTRA_SQL)
    sql.update(SURVEY_SQL)
    sql.update(DELTA_SQL)
    sql.update(HISTORY_SQL)
    sql.update(REFUSAL_SQL)
    sql.update(LAYOUT_SQL)
    sql.update(VIOLATION_SQL)
    return sql
