"""Command line: list / run registered queries, run the CDC stream.

    python -m marketlake list
    python -m marketlake run NAME --sf-dir DIR [--out PATH] [--show N]
    python -m marketlake reports (--sf-dir DIR | --tables DIR [--snapshots DIR]) --out DIR [--as-of DATE]
    python -m marketlake cdc --messages DIR --out DIR --checkpoint DIR [--trigger 1s|available-now]
        [--refresh-reports] [--rollups] [--apply-deletes] [--as-of DATE] [--compact-every N] [--kafka HOST:PORT]

On a cluster, submit with spark-submit; the session settings (AQE, skew join,
checkpoint folder) come from ``marketlake.session``.
"""

from __future__ import annotations

import argparse
import os
import sys


def _spark(master: str | None):
    from .session import build_session

    return build_session(master)


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="marketlake")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    r = sub.add_parser("run")
    r.add_argument("name")
    r.add_argument("--sf-dir", required=True)
    r.add_argument("--out")
    r.add_argument("--show", type=int, default=20)
    r.add_argument("--master")
    rp = sub.add_parser("reports", help="write all named reports (one dashboard refresh)")
    src = rp.add_mutually_exclusive_group(required=True)
    src.add_argument("--sf-dir", help="TESTDATA folder (star adapter)")
    src.add_argument("--tables", help="CDC output folder (versioned tables)")
    rp.add_argument("--snapshots", help="compacted snapshots folder of the CDC output")
    rp.add_argument("--out", required=True)
    rp.add_argument("--as-of", help="report clock (ISO date/time); default: now")
    rp.add_argument("--master")
    c = sub.add_parser("cdc")
    c.add_argument("--messages", help="folder of JSON message files")
    c.add_argument("--kafka", help="bootstrap servers (needs the Kafka connector)")
    c.add_argument("--max-per-trigger", type=int, help="most Kafka messages of one batch")
    c.add_argument("--accept-lost-offsets", action="store_true", help="go on where the broker has aged out offsets")
    c.add_argument("--out", required=True)
    c.add_argument("--checkpoint", required=True)
    c.add_argument("--trigger", default="available-now")
    c.add_argument("--refresh-reports", action="store_true")
    c.add_argument("--rollups", action="store_true")
    c.add_argument("--apply-deletes", action="store_true")
    c.add_argument("--as-of", help="report clock (ISO date/time); default: now")
    c.add_argument("--compact-every", type=int, help="compact the table logs every N batches")
    c.add_argument("--master")
    a = ap.parse_args(argv)

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from .plans import registry

    if a.cmd == "list":
        sql = registry.oracle_sql()
        for name, fn in registry.queries().items():
            doc = (fn.__doc__ or "").strip().splitlines()[0] if fn.__doc__ else ""
            print(f"{name:34s} {'sql' if name in sql else '   '}  {doc}")
        return 0
    if a.cmd == "run":
        spark = _spark(a.master)
        df = registry.queries()[a.name](spark, a.sf_dir)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(a.show, truncate=False)
        return 0
    if a.cmd == "reports":
        import datetime as dt

        from .plans import reports as R
        from .sources.testdata import Star
        from .sources.versioned_star import VersionedStar

        spark = _spark(a.master)
        star = Star(spark, a.sf_dir) if a.sf_dir else VersionedStar(spark, a.tables, snapshots_dir=a.snapshots)
        as_of = dt.datetime.fromisoformat(a.as_of) if a.as_of else None
        for name, fn in R.REPORTS.items():
            fn(star, as_of=as_of).write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{name}")
            print(name)
        return 0
    if a.cmd == "cdc":
        from .plans import reports as R
        from .sources import stream as ST
        from .streaming import cdc_pipeline as P

        spark = _spark(a.master)
        msgs = ST.kafka_messages(spark, a.kafka, a.max_per_trigger, a.accept_lost_offsets) if a.kafka else ST.file_messages(spark, a.messages)
        import datetime as dt

        as_of = dt.datetime.fromisoformat(a.as_of) if a.as_of else None
        job = P.CdcJob(a.out, reports=dict(R.REPORTS) if a.refresh_reports else None, as_of=as_of,
                       rollups=a.rollups, apply_deletes=a.apply_deletes, compact_every=a.compact_every)
        trig = {"availableNow": True} if a.trigger == "available-now" else {"processingTime": a.trigger}
        q = P.start(msgs, job, a.checkpoint, trig)
        q.awaitTermination()
        return 0
    return 2


if __name__ == "__main__":
    sys.exit(main())
