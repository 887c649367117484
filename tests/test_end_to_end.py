"""Tables -> change messages -> CDC job -> versioned tables -> reports.

The reports over the CDC output must equal the reports over the source tables.
"""
import math

import pytest

from marketlake.plans import reports as R
from marketlake.sources import changes as CH
from marketlake.sources.testdata import Star
from marketlake.sources.versioned_star import VersionedStar
from marketlake.streaming import cdc_pipeline as P

from conftest import SF001

TABLES = ["orders", "order_items", "products", "sellers", "users"]


@pytest.fixture(scope="module")
def stars(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("e2e"))
    star = Star(spark, SF001)
    msgs = None
    for t in TABLES:
        m = CH.snapshot_messages(star, t)
        msgs = m if msgs is None else msgs.unionByName(m)
    P.CdcJob(out, tables=TABLES).process(msgs, 0)
    return star, VersionedStar(spark, f"{out}/tables")


def _rows(df):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(R.REPORTS))
def test_reports_equal_over_cdc_output(stars, name):
    src, cdc = stars
    fn = R.REPORTS[name]
    a = fn(src, as_of=R.DEFAULT_AS_OF)
    b = fn(cdc, as_of=R.DEFAULT_AS_OF)
    assert a.columns == b.columns
    assert _rows(a) == _rows(b)
