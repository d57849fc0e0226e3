"""Linked boxes (B25) in array rounds."""

import random

from frameops.operators import boxes as X
from tests import brute

PRED = "image_id bigint, pred_id bigint, source string, x1 bigint, y1 bigint, x2 bigint, y2 bigint, score double"


def test_linked_boxes_in_rounds_equal_cells_and_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for image in range(40):
        for i in range(rnd.randrange(1, 60)):
            x, y = rnd.randrange(900), rnd.randrange(900)
            rows.append((image, i, "t", x, y, x + rnd.randrange(5, 60), y + rnd.randrange(5, 60), 0.5))
    rows += [(3, 1000, "t", None, 1, 2, 3, 0.5), (None, 1, "t", 1, 1, 2, 2, 0.5), (99, 1, "t", 1, 1, 2, 2, 0.5)]
    boxes = spark.createDataFrame(rows, PRED)
    frames = spark.createDataFrame([(i, 1000, 800) for i in range(41)], "image_id bigint, width bigint, height bigint")
    options = {"min_area": 0.0, "max_area": 1.0}
    got = sorted(map(tuple, X.link_components(boxes, frames, **options).collect()))
    assert got == sorted(map(tuple, X.link_components(boxes, frames, limit=20, **options).collect()))
    want = []
    for image in range(40):
        mine = [((r[3] + r[5]) / 2, (r[4] + r[6]) / 2) for r in rows if r[0] == image and r[3] is not None]
        want += [(image, len(g)) for g in brute.components(mine, 0.09 * 1000) if len(g) >= 5]
    assert [r[:2] for r in got] == sorted(want)
