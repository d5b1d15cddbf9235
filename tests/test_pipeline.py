"""The tracking pipeline from end to end on a small field, and its configuration."""

import pytest

from voxelry.plans import pipeline

TREE = """
grid: {z: 2, y: 12, x: 12}
objects:
  ice: {fields: [qi], thresholds: [1.0], radius: 3.0, erode: null}
  updraft: {fields: [w], thresholds: [1.0, 2.0], radius: 3.0, erode: null}
"""


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text(TREE)
    config = pipeline.load(str(tmp_path / "c.yaml"), {"objects": {"ice": {"radius": 2.0}}})
    assert config.objects[0].radius == 2.0 and config.objects[1].thresholds == [1.0, 2.0] and config.grid.x == 12
    with pytest.raises(ValueError):
        pipeline.configure({"objects": {"ice": {"colour": 1}}})


def test_systems(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(TREE)
    rows = []
    for t in range(3):
        for y in range(12):
            for x in range(12):
                ice = 3.0 if (1 <= y <= 4 and 1 + t <= x <= 4 + t) or (8 <= y <= 10 and 8 <= x <= 10) else 0.0
                w = 5.0 if (y in (2, 3) and x in (2 + t, 3 + t)) or (y == 6 and x == 11) else 0.0
                rows.append((t, 0, y, x, ice, w))
    field = spark.createDataFrame(rows, "t int, z int, y int, x int, qi double, w double")
    config = pipeline.load(str(tmp_path / "c.yaml"))
    out = pipeline.run(spark, field, config, str(tmp_path / "stages"))
    got = {(r.t, r.y, r.x): (r.system, r.u_tracks) for r in out.collect()}
    assert {k for k, _ in got.items()} == {(t, y, x) for t, _, y, x, ice, _ in rows if ice}
    assert {got[t, 2, 2 + t][0] for t in range(3)} != {got[t, 9, 9][0] for t in range(3)}
    assert len({got[t, 2, 2 + t] for t in range(3)}) == 1 and got[0, 9, 9][1] is None
    assert pipeline.run(spark, field.limit(0), config, str(tmp_path / "stages")).count() == len(got)
