"""Statistics of packed images against those of tables of pixels."""

from __future__ import annotations

import random

import pytest

from waybill.operators import imaging


def test_packed_images_equal_pixels(spark):
    rng = random.Random(6)
    sizes = {1: (60, 50), 2: (9, 7), 3: (2, 3), 4: (1, 1), 5: (48, 64)}
    shade = {1: lambda x, y: (250, 245, 240) if 5 < x < 40 and 8 < y < 30 + x // 4 else (20, 10, 30), 5: lambda x, y: (255, 255, 255)}
    images = {k: [[shade[k](x, y) if k in shade else tuple(rng.randint(0, 255) for _ in "rgb") for x in range(w)] for y in range(h)] for k, (w, h) in sizes.items()}
    pixels = spark.createDataFrame([(k, x, y, *c) for k, rows in images.items() for y, row in enumerate(rows) for x, c in enumerate(row)], "image int, x int, y int, red int, green int, blue int")
    packed = spark.createDataFrame([(k, sizes[k][0], [r << 16 | g << 8 | b for row in rows for r, g, b in row]) for k, rows in images.items()], "image int, width int, rgb array<int>")
    want = {r.image: r.asDict() for r in imaging.pixel_statistics(pixels).collect()}
    for r in imaging.packed_statistics(packed).collect():
        for name, value in r.asDict().items():
            assert value == pytest.approx(want[r.image][name], abs=1e-7), (r.image, name)
    assert "Exchange" not in imaging.packed_statistics(packed)._jdf.queryExecution().executedPlan().toString()


def test_images_that_are_none(spark):
    rows = [(1, 3, None), (2, 0, [1]), (3, 2, [1, 2, 3]), (4, None, [1]), (5, 1, []), (6, 2, [1, None]), (7, 1, [0xFFFFFF])]
    got = {r.image: r.pixels for r in imaging.packed_statistics(spark.createDataFrame(rows, "image int, width int, rgb array<int>")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 1}


def test_scores_do_not_depend_on_the_order_of_pixels(spark):
    """Paper that lies evenly to both axes has no angle, whatever the order of the pixels."""
    from waybill.operators import imaging

    cross = [(x, y, 255 if (x, y) in {(0, 0), (7, 7), (0, 7), (7, 0), (2, 5), (5, 2), (2, 2), (5, 5)} else 30) for x in range(8) for y in range(8)]
    got = set()
    for i, pixels in enumerate((cross, cross[::-1], sorted(cross, key=lambda p: (p[0] * 5 + p[1] * 3) % 64))):
        rows = spark.createDataFrame([(i, x, y, g, g, g) for x, y, g in pixels], "image int, x int, y int, red int, green int, blue int").coalesce(1)
        r = imaging.quality(imaging.pixel_statistics(rows)).first().asDict()
        assert r["angle"] == 0.0 and r["mean"] == (8 * 255 + 56 * 30) / (64 * 255)
        got.add(tuple(sorted((k, v) for k, v in r.items() if k != "image")))
    assert len(got) == 1
