"""Month roll-ups kept by signed deltas inside the change stream.

Layout under ``<out>``: ``rollup_cells/delta/batch_id=N/month=...`` (a batch's signed
cells), ``rollup_cells/base/upto=N/month=...`` (all cells up to a batch, summed) and
``rollups/<name>/month=...``. A batch

1. reads the rows its messages touch, before and after (`VersionedStar.live_of`), and writes
   the cells that change;
2. derives the roll-ups of the months in those cells, and of the months in which a changed
   product, seller or user occurs, from these months' cells alone;
3. replaces exactly these months, and removes those that have become empty.

Deltas lie under their batch id, so a batch that is run again replaces its own. When the
cells of the batch before are missing (roll-ups were switched on later), they are built
from the whole tables once.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import deltas as X
from ..plans import reports as R
from ..sources.files import newest_version, path_exists, remove_path
from ..sources.versioned_star import VersionedStar

CELL_DDL = "product_id bigint, seller_id bigint, user_id bigint, n bigint, qty bigint, month date"


class MonthRollups:
    def __init__(self, spark: SparkSession, out_dir: str, star: VersionedStar, as_of=None):
        self.spark, self.out, self.star, self.as_of = spark, out_dir.rstrip("/"), star, as_of

    @property
    def base(self) -> str:
        return f"{self.out}/rollup_cells/base"

    @property
    def delta(self) -> str:
        return f"{self.out}/rollup_cells/delta"

    # cells -----------------------------------------------------------------
    def upto(self, before: int) -> int | None:
        """The newest batch before ``before`` whose cells are stored."""
        found = [newest_version(self.spark, self.base, "upto=", before),
                 newest_version(self.spark, self.delta, "batch_id=", before)]
        return max((n for n in found if n is not None), default=None)

    def cells(self, upto: int, months: list | None = None) -> DataFrame:
        """The cells after batch ``upto``; of the given months only, if any (partition-pruned)."""
        base = newest_version(self.spark, self.base, "upto=", upto + 1)
        parts = []
        if base is not None:
            parts.append(self.spark.read.schema(CELL_DDL).parquet(f"{self.base}/upto={base}"))
        if path_exists(self.spark, self.delta):
            log = self.spark.read.schema(CELL_DDL + ", batch_id bigint").parquet(self.delta)
            log = log.where((F.col("batch_id") > F.lit(-1 if base is None else base)) & (F.col("batch_id") <= upto))
            parts.append(log.drop("batch_id"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if months is not None:
            rows = rows.where(F.col("month").isin(months))
        return X.added(rows)

    def apply(self, batch_id: int, touched: dict[str, DataFrame]) -> None:
        """Bring the stored cells and roll-ups from before batch ``batch_id`` to after it.

        ``touched``: per table the key rows this batch changed or deleted (`VersionedStar.touched`).
        """
        if self.upto(batch_id) != batch_id - 1:
            self.rebuild(batch_id)
            return
        before = lambda t, keys: self.star.live_of(t, keys, upto_batch=batch_id - 1)
        after = lambda t, keys: self.star.live_of(t, keys, upto_batch=batch_id)
        items, orders = touched["order_items"], touched["orders"]
        item_changes = X.signed(before("order_items", items), after("order_items", items), X._ITEM).persist()
        order_changes = X.signed(before("orders", orders), after("orders", orders), X._ORDER).persist()
        try:
            old_orders = self.star.orders_of(item_changes.select("order_id").distinct(), batch_id - 1)
            new_items = self.star.items_of_orders(order_changes.select("order_id").distinct(), batch_id)
            changes = X.cell_changes(item_changes, order_changes, old_orders, new_items)
            self._write(changes, f"{self.delta}/batch_id={batch_id}")
        finally:
            item_changes.unpersist()
            order_changes.unpersist()
        self.refresh(batch_id, self.touched_months(batch_id, touched))

    def rebuild(self, batch_id: int) -> None:
        """Cells and roll-ups from the whole tables."""
        orders, items = (self.star.latest_rows(t, upto_batch=batch_id) for t in ("orders", "order_items"))
        self._write(X.cells(items, orders), f"{self.base}/upto={batch_id}")
        stored = {m for name in X.ROLLUPS for m in self._stored_months(name)}
        self.refresh(batch_id, stored | set(_months(self.cells(batch_id))))

    def compact(self, batch_id: int) -> None:
        """Sum base and deltas into a new base; the old base and its deltas are removed after it is whole."""
        newest = newest_version(self.spark, self.base, "upto=")
        if newest is None or newest < batch_id:
            self._write(self.cells(batch_id), f"{self.base}/upto={batch_id}")
        for folder, prefix in ((self.base, "upto="), (self.delta, "batch_id=")):
            while (old := newest_version(self.spark, folder, prefix, batch_id)) is not None:
                remove_path(self.spark, f"{folder}/{prefix}{old}")

    def _write(self, cells: DataFrame, path: str) -> None:
        cells.select("product_id", "seller_id", "user_id", "n", "qty", "month").where("month IS NOT NULL") \
            .repartition("month", F.pmod(F.xxhash64("product_id"), F.lit(16))) \
            .write.mode("overwrite").partitionBy("month").parquet(path)

    # roll-ups --------------------------------------------------------------
    def touched_months(self, batch_id: int, touched: dict[str, DataFrame]) -> set[dt.date]:
        """Months whose roll-ups the batch can change; as many as calendar months at most."""
        path = f"{self.delta}/batch_id={batch_id}"
        found = self.spark.read.schema(CELL_DDL).parquet(path).select("month")
        whole = self.cells(batch_id)
        for table, key in (("products", "product_id"), ("sellers", "seller_id"), ("users", "user_id")):
            if table in touched:
                found = found.union(whole.join(touched[table].select(key).distinct(), key, "left_semi").select("month"))
        return set(_months(found))

    def refresh(self, batch_id: int, months: set[dt.date]) -> None:
        """Replace the given months, as far as they are in the reports' window; earlier ones stay as they were."""
        start = D.calendar_month_start(R._now(self.as_of)).date()
        months = {m for m in months if m >= start}
        if not months:
            return
        derived = X.CellRollups(self.cells(batch_id, sorted(months)), self.star)
        derived.lines = derived.lines.persist()
        try:
            for name in X.ROLLUPS:
                path = f"{self.out}/rollups/{name}"
                rows = getattr(derived, name)().persist()
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
                for empty in months - set(_months(rows)):
                    remove_path(self.spark, f"{path}/month={empty.isoformat()}")
                rows.unpersist()
        finally:
            derived.lines.unpersist()

    def _stored_months(self, name: str) -> list[dt.date]:
        path = f"{self.out}/rollups/{name}"
        if not path_exists(self.spark, path):
            return []
        return _months(self.spark.read.schema("month date").parquet(path))


def _months(rows: DataFrame) -> list[dt.date]:
    return [r["month"] for r in rows.select("month").distinct().collect()]
