"""Sums that end in one half of the last digit are rounded by their exact value."""

from skyaccord.plans import positions


def test_box_totals_at_one_half(spark):
    exact = {(0, 1356): 10.11715, (0, 3312): 9.60973, (0, 3876): 10.43069, (0, 6742): 9.30436, (0, 10056): 8.54121, (1, 5667): 8.87689, (0, 688): 8.46747, (0, 4222): 9.30925, (1, 4387): 11.93349}
    rows = positions.source_boxes(spark, "/root/testdata/sf0.01").collect()
    assert {k: r.total for r in rows if (k := (r.image_id, r.source_id)) in exact} == exact
