"""Composite reports."""

import pytest
from pyspark.errors import PySparkException

from skyaccord.plans import reports
from skyaccord.plans.common import matched
from skyaccord.plans.fixtures import view
from tests.conftest import SF


def test_astrometry_report(spark):
    m = matched(spark, SF)
    got = reports.astrometry_report(m, view(spark, SF, "image_dim"), "ref")
    n = m.count()
    assert got["offsets"].count() == n and {r.n for r in got["statistics"].collect()} == {n}
    assert {r.label for r in got["harmonics"].collect()} == {f"{y} vs {p}" for y in ("d_ra_bmaj", "d_dec_bmaj") for p in ("phi_1", "phi_2")}
    lacking = spark.createDataFrame([("ref", None, 1.0, 1.0, 1.0)], "image_id string, bmaj_deg double, bmin_deg double, crpix1 double, crpix2 double")
    with pytest.raises(PySparkException):
        reports.beam_join(m, lacking, "ref").collect()


def test_vis_report_has_every_table(spark):
    rows = view(spark, SF, "vis_rows")
    got = reports.vis_report(rows, view(spark, SF, "vis_chan"), rows)
    assert set(got) == {"scan", "antenna", "baseline", "overall", "channel", "channel_mean", "comparison"}
    assert all(r.mean_test == r.mean_ref for r in got["comparison"].collect())
    assert {r.metric: r.value for r in got["overall"].collect()}["n_rows"] == rows.count()


def test_modes(spark):
    df = spark.createDataFrame([("1590555655_sdp",), ("unknown",)], "observation string")
    assert [r["mode"] for r in reports.attach_mode(df).collect()] == ["c544M32kWB8s", None]
