"""Joins by place and by time beside brute force."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import layout as L
from folio.operators import reading as R


def rects(rng, n, kind):
    out = []
    for i in range(n):
        x, y = rng.uniform(-300, 900), rng.uniform(-300, 900)
        w, h = (rng.choice([0, 3, 40, 700]), rng.choice([0, 3, 12, 500])) if i % 9 else (5e6, 4e6)
        out.append((i, i % 2, 0 if kind == "hot" else i % 3, x, x + w, y, y + h))
    return out + [(n, 0, 0, None, 1.0, 1.0, 1.0), (n + 1, 0, 0, 10.0, -10.0, 0.0, 5.0), (n + 2, 0, 0, 64.0, 128.0, 64.0, 64.0), (n + 3, 0, 0, -64.0, 0.0, 0.0, 64.0)]


def share(a, b):
    return None not in (*a[3:], *b[3:]) and a[3] <= b[4] and b[3] <= a[4] and a[5] <= b[6] and b[5] <= a[6]


@pytest.mark.parametrize("kind", ["hot", "spread"])
@pytest.mark.parametrize("cell", [64.0, 1000.0])
def test_text_under_beside_all_pairs(spark, kind, cell):
    rng = random.Random(3)
    a, b = rects(rng, 80, kind), rects(rng, 90, kind)
    links = spark.createDataFrame(a, "link_id long, doc_id long, page long, lx1 double, lx2 double, ly1 double, ly2 double")
    items = spark.createDataFrame([(*r, f"w{r[0]}") for r in b], "pos long, doc_id long, page long, ix1 double, ix2 double, iy1 double, iy2 double, text string")
    got = {r["link_id"]: r["text"] for r in L.text_under(links, items, cell).collect()}
    want = {x[0]: " ".join(f"w{y[0]}" for y in b if y[1:3] == x[1:3] and share(x, y)) or "Link" for x in a}
    assert got == want


def test_a_full_page_has_few_pairs(spark):
    """100,000 items and links on one page: what meets before the test is in proportion to them, not to their product."""
    n = 100_000
    at = [((F.col("id") * k % 100_003) / 10.0).alias(c) for k, c in ((7919, "x"), (104_729, "y"))]
    base = spark.range(n).select("id", *at)
    items = base.select(F.lit(0).alias("doc_id"), F.lit(0).alias("page"), F.col("id").alias("pos"), F.lit("w").alias("text"), F.col("x").alias("ix1"), (F.col("x") + 20).alias("ix2"), F.col("y").alias("iy1"), (F.col("y") + 10).alias("iy2"))
    links = items.select("doc_id", "page", F.col("pos").alias("link_id"), F.col("ix1").alias("lx1"), F.col("ix2").alias("lx2"), F.col("iy1").alias("ly1"), F.col("iy2").alias("ly2"))
    (a, _), (b, _) = L.in_cells(links, "l"), L.in_cells(items, "i")
    assert a.join(b, ["doc_id", "page", "_cx", "_cy"]).count() < 20 * n
    assert L.text_under(links, items).count() == n


def test_nearest_chunk_beside_all_pairs(spark):
    rng = random.Random(4)
    b = rects(rng, 120, "hot")
    pts = [(i, i % 2, 0, rng.uniform(-400, 1000), rng.uniform(-400, 1000)) for i in range(150)] + [(999, 0, 0, None, 1.0)]
    points = spark.createDataFrame(pts, "point_id long, doc_id long, page long, x double, y double")
    chunks = spark.createDataFrame(b, "chunk_id long, doc_id long, page long, cx1 double, cx2 double, cy1 double, cy2 double")
    got = {r["point_id"]: r["chunk_id"] for r in L.nearest_chunk(points, chunks).collect()}
    want = {}
    for p in pts[:-1]:
        near = [(((p[3] - (c[3] + c[4]) / 2) ** 2 + (p[4] - (c[5] + c[6]) / 2) ** 2), c[0]) for c in b if None not in c and c[1] == p[1] and c[3] - 50 <= p[3] <= c[4] + 50 and c[5] - 50 <= p[4] <= c[6] + 50]
        if near:
            want[p[0]] = min(near)[1]
    assert got == want


@pytest.mark.parametrize("run_rows", [10, 10_000])
def test_word_at_in_runs(spark, run_rows):
    """A key with most rows in many runs, one with few, one without marks, ties, and times before all marks."""
    rng = random.Random(5)
    marks = [("hot", i, rng.choice([rng.uniform(0, 100), float(rng.randint(0, 100))])) for i in range(900)] + [("cold", i, float(i)) for i in range(3)] + [("hot", 5000, None)]
    times = [("hot", i, rng.choice([rng.uniform(-5, 110), float(rng.randint(0, 100))])) for i in range(800)] + [("cold", i, i - 1.5) for i in range(5)] + [("none", 1, 1.0), ("cold", 9, None), (None, 3, 1.0)]
    got = L.word_at(spark.createDataFrame(times, "k string, n long, t double"), spark.createDataFrame(marks, "k string, word long, mark double"), ["k"], run_rows)
    want = []
    for k, n, t in times:
        mine = sorted((m, w) for key, w, m in marks if key == k and m is not None)
        if mine:
            early = [x for x in mine if t is not None and x[0] <= t]
            want.append((k, n, t, (early[-1] if early else mine[0])[1]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    if run_rows == 10:
        assert "_run" in got._jdf.queryExecution().analyzed().toString()


def test_saves_over_days(spark):
    """The count goes on over the end of a day, and a save's minutes are those since the one before."""
    rows = [(1, "2024-01-01 23:59:50", "view"), (2, "2024-01-01 23:59:58", "view"), (3, "2024-01-02 00:00:04", "saved"), (4, "2024-01-02 00:00:09", "view"), (5, "2024-01-02 00:10:00", "view"), (6, "2024-01-05 00:00:00", "saved"), (7, "2024-01-05 00:00:03", "view")]
    logs = spark.createDataFrame([(i, 1, t, e) for i, t, e in rows], "log_id long, user_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(map(tuple, R.saved_minutes(logs, 10).collect())) == [(3, 1, 14.0, 0), (6, 1, 5.0, 0)]


def test_images_of_chapters_beside_all_pairs(spark):
    """Pages of many blocks, of one and of none, equal rows, spans over buckets, exchanged and null ends, pages below 0, no page."""
    rng = random.Random(6)
    spans = [(i, f, f + rng.choice([-3, 0, 0, 4, 25])) for i, f in enumerate(rng.randint(-12, 30) for _ in range(150))] + [(150, None, 5), (151, 5, None), (0, *[None] * 2)]
    spans += spans[:3]
    images = [(i, p) for i, p in enumerate([7] * 600 + [rng.randint(-15, 45) for _ in range(300)] + [None] * 5)] + [(3, 7), (3, 7)]
    chapters = spark.createDataFrame(spans, "n long, first_page long, last_page long")
    got = L.images_of_chapters(chapters, spark.createDataFrame(images, "image_id long, page_number long"))
    assert got.columns == ["n", "first_page", "last_page", "image_id", "page_number"]
    want = [(*c, *i) for c in spans for i in images if None not in (*c, i[1]) and c[1] <= i[1] <= c[2]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_images_of_many_chapters_take_little_disk(spark, tmp_path):
    """2000 chapters with 3000 images of one page: files of less than a fifth of a byte a row."""
    chapters = spark.range(20_000, 22_000).select(F.col("id").alias("book_id"), F.lit(3).alias("first_page"), F.lit(5).alias("last_page"))
    images = spark.range(3000).select((F.col("id") * 7919 % 100_003).alias("image_id"), F.lit(4).alias("page_number"))
    L.images_of_chapters(chapters, images).select("book_id", "image_id").write.parquet(f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 6_000_000
    assert sum(f.stat().st_size for f in tmp_path.glob("t/*.parquet")) < 6_000_000 / 5
