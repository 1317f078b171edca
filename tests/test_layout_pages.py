"""Pages are folded one at a time, whatever the batches in which their boxes come."""

import pyarrow as pa
import pytest

from posora.operators import layout


def boxes(sizes):
    """Batches of seven boxes, pages of the given sizes."""
    rows = [{"_page": p, "_box": b, "_q": [float(b * 37 % 11), float(b * 5 % 23)] * 4, "_first": b == 0} for p, n in enumerate(sizes) for b in range(n)]
    return [pa.RecordBatch.from_pylist(rows[i : i + 7]) for i in range(0, len(rows), 7)]


@pytest.mark.parametrize("sizes", [[1], [30], [7, 7, 7], [3, 1, 20, 2, 2, 2, 9, 14]])
def test_pages_are_whole_over_batches_and_never_held_together(sizes):
    seen = []

    def fold(quads):
        seen.append(len(quads))
        return layout._order(quads)

    out = [r for batch in layout.by_page(boxes(sizes), fold, ["place"]) for r in batch.to_pylist()]
    assert seen == sizes
    for p, n in enumerate(sizes):
        own = [r for r in out if r["_page"] == p]
        assert [r["_box"] for r in own] == list(range(n)) and sorted(r["place"] for r in own) == list(range(n))


def test_what_is_held_is_a_page_and_a_batch():
    most, given = 0, 0

    def counted():
        nonlocal given
        for batch in boxes([5] * 400):
            given += batch.num_rows
            yield batch

    taken = 0
    for batch in layout.by_page(counted(), layout._order, ["place"]):
        most = max(most, given - taken)
        taken += batch.num_rows
    assert taken == given == 2000 and most <= 5 + 7


def test_ids_keep_their_types(spark):
    big = (1 << 60) + 1
    q = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    rows = spark.createDataFrame([("p", big, q), ("p", None, q), ("r", 3, q), (None, 4, q), ("r", 5, q[:3])], "page string, box long, q array<array<double>>")
    got = {(r.page, r.box): r.place for r in layout.reading_order(rows, "page", "box", "q").collect()}
    assert got == {("p", None): 0, ("p", big): 1, ("r", 3): 0}
    assert layout.document_lines(rows, "page", "box", "q").columns == ["page", "box", "line", "place", "cy", "slope", "median_height"]
