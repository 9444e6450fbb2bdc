"""Centroids, hard negatives and main texts beside brute force, on odd rows and on empty tables."""

import hashlib
import html
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folio.llm import balltree, centroids, maintext, negatives

NAN, INF = float("nan"), float("inf")


def put_vectors(folder, rows, clashes=True):
    vec_id, embedding, label = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
    t = pa.table({"vec_id": pa.array(vec_id, pa.int64()), "embedding": pa.array(embedding, pa.list_(pa.float32())), "label": pa.array(label, pa.int32())})
    for c in ("cluster", "distance", "ids", "dim", "score", "rank", "query", "id") if clashes else ():
        t = t.append_column(c, pa.array(["x"] * len(rows), pa.string()))
    pq.write_table(t, folder / "embeddings.parquet")
    return str(folder)


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, rng.normal(0, 0.2, 64))), i % 10) for i in range(600)]
    same = rows[7][1]
    rows += [(1000 + i, same, i % 3) for i in range(500)]  # a third of all rows has one vector
    rows += [(50, rows[50][1], 0), (51, rows[51][1], 1), (51, rows[51][1], 1), (100, same, 5), (-100, same, 5)]  # repeated rows and ids
    rows += [(None, rows[3][1], 3), (None, None, 1), (2000, None, 2), (2050, [], 2), (2051, [0.5] * 63, 2), (2052, [0.5] * 65, 2)]
    rows += [(2100, [*[0.1] * 63, NAN], 2), (2101, [*[0.1] * 63, INF], 2), (2102, [*[0.1] * 63, None], 2), (2150, rows[9][1], None), (2104, [-0.0] * 64, 4), (2105, [0.0] * 64, 4)]
    return rows


@pytest.fixture(scope="module")
def vectors(tmp_path_factory):
    return put_vectors(tmp_path_factory.mktemp("vectors"), odd_vectors())


def numbers(x):
    return np.array([int(np.floor(float(np.float32(v)) * 256)) for v in x], np.int64)


def plain_centroids(rows, k=40, rounds=5):
    kept = [(i, numbers(x)) for i, x, _ in rows if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    x = np.array([v for _, v in kept])
    c = np.array([v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]])
    for n in range(rounds + 1):
        d = ((x[:, None] - c) ** 2).sum(2)
        z = d.argmin(1)
        if n < rounds:
            c = np.array([[int(s) // int((z == j).sum()) for s in x[z == j].sum(0)] if (z == j).any() else c[j] for j in range(len(c))])
    best = d.min(1)
    return sorted((str(i), int(j), int(b), int(best[z == j].sum()), int(best.sum()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), j, b in zip(kept, z, best, strict=True))


def test_centroids_beside_brute_force(spark, vectors):
    got = centroids.op11_centroids(spark, vectors).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_centroids(odd_vectors())


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_centroids_do_not_hang_on_partitions(spark, vectors, parts):
    rows = spark.read.parquet(f"{vectors}/embeddings.parquet").repartition(parts)
    assert sorted((str(r[0]), *r[1:]) for r in centroids.clustered(rows).collect()) == plain_centroids(odd_vectors())


@pytest.mark.parametrize("name", ["op11_centroids", "op12_hard_negatives"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_vectors_beside_sql(spark, name, sf):
    from folio.llm.queries import ORACLES, QUERIES

    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = QUERIES[name](spark, folder)
    want = con.sql(ORACLES[name])
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def plain_negatives(rows, every=50):
    kept = []
    for i, x, label in rows:
        if label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            kept.append((i, numbers(x), (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for a, x, label in kept:
        if a is None or a % every:
            continue
        others = sorted(((-int(x @ y), i is None, i or 0, m) for i, y, m in kept if i != a and len(y) == len(x)), key=lambda r: r[:3])
        for s, none, p, m in [r for r in others if r[3] == label][:5]:
            near = [r for r in others if r[3] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, None if none else p, k + 1, None if r[1] else r[2], -s, -r[0]) for k, r in enumerate(near)]
    return sorted(map(str, out))


def test_negatives_beside_brute_force(spark, vectors):
    got = negatives.op12_hard_negatives(spark, vectors).collect()
    want = plain_negatives(odd_vectors())
    assert len(want) > 30 and sorted(str(tuple(r)) for r in got) == want


@pytest.mark.parametrize("parts, cells", [(1, 1 << 22), (7, 200), (30, 64)])
def test_negatives_do_not_hang_on_rounds(spark, vectors, parts, cells):
    rows = negatives.moved_labels(spark.read.parquet(f"{vectors}/embeddings.parquet").repartition(parts))
    got = negatives.mined(rows, every=150, cells=cells).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_negatives(odd_vectors(), 150)


@pytest.mark.parametrize("name", ["op11_centroids", "op12_hard_negatives"])
@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(50, [1.0] * 64, 1)], [(50, [2.0] * 64, 1), (50, [2.0] * 64, 1), (51, [1.0] * 64, 1)]])
def test_few_vectors(spark, tmp_path, name, rows):
    from folio.llm.queries import QUERIES

    got = QUERIES[name](spark, put_vectors(tmp_path, rows)).collect()
    assert len(got) == (sum(r[1] is not None for r in rows) if name == "op11_centroids" else 0)


def test_too_large_a_component(spark, tmp_path):
    with pytest.raises(Exception, match="would not fit"):
        centroids.op11_centroids(spark, put_vectors(tmp_path, [(1, [1e30] * 64, 1)])).collect()


def test_balls_hold_their_rows():
    x = np.random.default_rng(5).integers(-300, 300, (3000, 16))
    t = balltree.built(x, list(range(3000)), np.arange(3000) % 4)
    assert sorted(t.ids) == list(range(3000)) and (t.vectors == x[t.ids]).all()
    for a, b, r, total in zip(t.start, t.stop, t.radius, t.totals, strict=True):
        assert (t.vectors[a:b].sum(0) == total).all() and np.sqrt(((t.vectors[a:b] - total / (b - a)) ** 2).sum(1)).max() <= r
    leaves = t.below < 0
    assert (t.counts[leaves] <= balltree.LEAF).all() and t.counts[leaves].sum() == 3000
    again = balltree.Tree.of_row(t.row())
    assert (again.vectors == t.vectors).all() and (again.totals == t.totals).all()


def test_balls_spare_work():
    """On vectors in far groups whole balls go to one centroid, and searches leave nodes out."""
    rng = np.random.default_rng(6)
    middles = rng.integers(-4000, 4000, (8, 64))
    x = middles[rng.integers(0, 8, 4000)] + rng.integers(-20, 20, (4000, 64))
    t = balltree.built(x, list(range(4000)), np.zeros(4000, np.int64))
    (nodes, owner), (rows, _) = centroids.assigned(t, middles)
    assert t.counts[nodes].sum() + len(rows) == 4000 and len(rows) < 400
    q = negatives.Queries(np.array([-1]), np.array([0]), middles[:1], np.array([0]), np.array([negatives.LOWEST + 1]), np.array([-negatives.LOWEST - 1]), same=True)
    seen, product = [], negatives.product
    negatives.product = lambda a, b: seen.append(len(b)) or product(a, b)
    try:
        best = negatives.Best(1, 5)
        q.search(t, best)
    finally:
        negatives.product = product
    assert sorted(best.scores[0])[::-1] == sorted((x @ middles[0]).tolist())[::-1][:5] and sum(seen) < 1000


def test_large_products_are_exact():
    a = np.array([[1 << 23, -(1 << 23) + 1], [3, 5]])
    assert negatives.product(a, a).tolist() == [[int(sum(int(p) * int(q) for p, q in zip(r, s, strict=True))) for s in a] for r in a]


# pages


def plain_article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_main_texts_of_the_table(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = {r["page_id"]: r for r in maintext.op13_main_text(spark, folder).collect()}
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{folder}/pages.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, url, page in rows:
        assert got[i]["text"] == plain_article(page) and got[i]["url"] == url and got[i]["n_chars"] == len(got[i]["text"])


def test_held_out_labelled_pages():
    """Of pages made by another seed, nearly all words of content and next to none of the others."""
    model, kept, lost, wrong, whole = maintext.trained(), 0, 0, 0, 0
    pages = maintext.labelled_pages(300, 99)
    for p in pages:
        got, want = maintext.main_text(p, model).split(), re.findall(r"\bq\w+", p)
        right = [w for w in got if w[0] == "q"]
        kept, lost, wrong, whole = kept + len(right), lost + len(want) - len(right), wrong + len(got) - len(right), whole + (got == want)
    assert lost < 0.01 * kept and wrong < 0.01 * kept and whole > 0.85 * len(pages)


PARTS = {
    "menu": '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>',
    "header": "<header><h1>The Daily Site</h1><p>All the news of the day</p></header>",
    "footer": "<footer><p>Copyright 2020 by the site, all rights reserved to it and to others who may have them</p></footer>",
    "sidebar": '<aside><h3>More to read</h3><p>Other stories that stand beside this one and are of no matter here</p></aside>',
    "side": '<div class="col right-sidebar"><p>Trending now in the world and in the town, with much to say of it</p></div>',
    "notice": '<div id="cookie-notice">We use cookies to make this site work for you. <button>Accept</button></div>',
    "advert": '<div class="ad">Buy one and get another one for nothing at all today</div>',
    "sponsored": '<section class="sponsored-links"><p>Ten things that you would not believe about your own bank</p></section>',
    "form": '<form action="/s"><label>Your name</label><input name="n"><select><option>One</option></select></form>',
    "script": '<script>var a = "<p>not a text</p>"; if (a < 3) { b() }</script>',
    "style": "<style>p { color: red } </style>",
    "comments": '<section id="comments"><h2>3 comments</h2>' + "".join(f'<article class="comment"><p>I think that number {i} is quite wrong in all that is said there, and I say so</p></article>' for i in range(9)) + "</section>",
    "hidden": '<div style="display: none">What nobody sees</div>',
    "remark": "<!-- <p>a remark</p> -->",
}
INNER = "<h1>A title &amp; more</h1><p>First words&nbsp;of it,\n  with <b>bold</b> ones<br>and more.</p><ul><li>one item of it</li><li>another item</li></ul><p>Last &lt;words&gt; &#233;.</p>"
TEXT = "A title & more\n\nFirst words of it, with bold ones and more.\n\none item of it\n\nanother item\n\nLast <words> é."


@pytest.mark.parametrize("where", ["<article>%s</article>", "<main><div>%s</div></main>", '<div class="post-content">%s</div>', "<ARTICLE CLASS='story'>%s</ARTICLE>"])
@pytest.mark.parametrize("part", PARTS)
def test_furniture_goes(where, part):
    model = maintext.trained()
    inside = INNER.replace("<ul>", PARTS[part] + "<ul>") if part not in ("menu", "header") else INNER
    for page in (PARTS[part] + where % INNER, where % INNER + PARTS[part], where % inside):
        assert maintext.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>", model) == TEXT


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("   \n", ""), ("<", "<"), ("no markup at all", "no markup at all"), ("<p>a < b and c > d</p>", "a < b and c > d"), ("<script>x", ""), ("<!-- open", ""), ("<nav>only a menu</nav>", ""),
        ("<p>one<p>two", "one\n\ntwo"), ("<article>cut off <b>in the mid", "cut off in the mid"), ("<div class='ad'>left open<article><p>the article itself</p></article>", "the article itself"),
        ('<body class="page sidebar"><div class="sidebar-layout"><p>all of it</p></div></body>', "all of it"), ("<p title=\"a > b\">in</p>", "in"), ("<p title='open>in the end</p>", "in the end"), ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a b\n\nc"),
    ],
)
def test_odd_pages(page, want):
    assert maintext.main_text(page, maintext.trained()) == want


def test_long_and_broken_pages_end():
    rng = random.Random(1)
    model = maintext.trained()
    long_ = "<article>" + "".join(f"<p>{i} words of it</p>" for i in range(50_000)) + "</article>"
    assert maintext.main_text(long_, model).count("\n\n") == 49_999
    for _ in range(200):
        maintext.main_text("".join(rng.choice(["<", ">", "p", '"', "'", "a ", "</", "div", "<article>", "<!--", "-->", "=", "&amp", "<ul><li><a>"]) for _ in range(400)), model)
    maintext.main_text("<a '" * 20_000, model)


def test_pages_table(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<article>x</article>"), (3, "v", "<article>x</article>"), (None, "w", "<p>y</p>")]
    t = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": [r[1] for r in rows], "html": [r[2] for r in rows], "text": ["clash"] * 5, "n_chars": [9] * 5})
    pq.write_table(t, tmp_path / "pages.parquet")
    got = maintext.op13_main_text(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "u", "", 0), (2, None, "", 0), (3, "v", "x", 1), (3, "v", "x", 1), (None, "w", "y", 1)]))
    pq.write_table(t.slice(0, 0), tmp_path / "pages.parquet")
    assert maintext.op13_main_text(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
