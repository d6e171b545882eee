"""What is built and kept: published books, vector indexes, neighbours by lists, postings."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.operators import dense, index, knn, lexical, publish
from folioscan.operators.postings import Postings

CHUNKS, IMAGES = "book_stem string, n int", "book_stem string, path string"


def seen(spark, root, books=None):
    c, i = publish.read(spark, root, "chunks", CHUNKS, books), publish.read(spark, root, "images", IMAGES, books)
    return sorted(map(tuple, c.collect())), sorted(map(tuple, i.collect()))


def tables(spark, chunks, images):
    return {"chunks": spark.createDataFrame(chunks, CHUNKS), "images": spark.createDataFrame(images, IMAGES)}


def test_books_are_published_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "books")
    assert seen(spark, root) == ([], [])
    publish.publish(spark, root, tables(spark, [("a/ü", 1), ("a/ü", 2), ("b", 3)], [("a/ü", "x"), ("b", "y")]))
    first = [("a/ü", 1), ("a/ü", 2), ("b", 3)], [("a/ü", "x"), ("b", "y")]
    assert seen(spark, root) == first
    version, has = publish.stage(root, tables(spark, [("b", 9)], [("b", "z")]))  # and then the writer dies
    assert seen(spark, root) == first
    bad = tables(spark, [("b", 8)], [("b", "q")])
    bad["images"] = bad["images"].withColumn("path", F.raise_error(F.lit("no images")).cast("string"))
    with pytest.raises(Exception, match="no images"):
        publish.publish(spark, root, bad)
    assert seen(spark, root) == first
    publish.publish(spark, root, tables(spark, [("b", 4)], []))
    assert seen(spark, root) == ([("a/ü", 1), ("a/ü", 2), ("b", 4)], [("a/ü", "x")])
    publish.publish(spark, root, tables(spark, [("c", 5)], []), books=["c", "a/ü"])
    assert seen(spark, root) == ([("b", 4), ("c", 5)], []) and seen(spark, root, ["c"]) == ([("c", 5)], [])
    assert version in publish.swept(spark, root) and seen(spark, root) == ([("b", 4), ("c", 5)], [])
    names = []
    monkeypatch.setattr(publish, "written_text", lambda *a: names.append(a) or 1 / 0)  # between the write and the swap
    with pytest.raises(ZeroDivisionError):
        publish.publish(spark, root, tables(spark, [("b", 7)], [("b", "w")]))
    assert names and seen(spark, root) == ([("b", 4), ("c", 5)], [])


def model(name="m", dimension=2):
    return index.Model(name, dimension, lambda: lambda texts: [[float(len(t))] + [3.0] * (dimension - 1) for t in texts])


POINTS = "point_id long, embedding array<float>, text_preview string, book_stem string, subject string, class_number string, part string, page_number int, txt_file string"
DAY = dt.datetime(2024, 1, 1)


def test_page_index(spark, tmp_path):
    root, cache = str(tmp_path / "index"), str(tmp_path / "cache")
    long = "x" * 60
    rows = [("a", 1, long), ("a", 2, "short"), ("a", 3, None), ("a", 4, " " + long + " "), ("b", 1, "y" * 50), ("b", 2, " " + "y" * 49 + " "), (None, 1, long), ("b", 3, long + "z" * 300)]
    pages = spark.createDataFrame([(b, p, f"{p}.txt", t, "clash") for b, p, t in rows], "book_stem string, page_number int, txt_file string, text string, subject_ string")
    books = spark.createDataFrame([("a", "Art", "12", None), ("a", "Art", "12", None)], "book_stem string, subject string, class_number string, part string")
    at = lambda d: F.lit(DAY + dt.timedelta(days=d))
    assert index.pages(pages, books, root, cache, model(), at(0)) == index.Report("created", 4, 4, 3)
    got = {(r.book_stem, r.page_number): r for r in index.points(spark, root, POINTS).collect()}
    assert set(got) == {("a", 1), ("a", 4), ("b", 1), ("b", 3)} and got["a", 1].subject == "Art" and got["b", 1].class_number == "Unknown" and len(got["b", 3].text_preview) == 200
    assert got["a", 1].embedding == got["a", 4].embedding and abs(sum(x * x for x in got["b", 1].embedding) - 1) < 1e-6
    assert index.pages(pages, books, root, cache, model(), at(6)) == index.Report("kept", 4, 4, 0)
    assert index.pages(pages, books, root, cache, model(), at(8)).computed == 3  # older than seven days
    more = spark.createDataFrame([("a", 1, "1.txt", "w" * 70, ""), ("c", 1, "1.txt", long, ""), ("c", 1, "1.txt", long, "")], pages.schema)
    assert index.pages(more, books, root, cache, model(), at(9)) == index.Report("kept", 3, 0, 1)
    again = {(r.book_stem, r.page_number): r.text_preview[0] for r in index.points(spark, root, POINTS).collect()}
    assert again == {("a", 1): "w", ("a", 4): "x", ("b", 1): "y", ("b", 3): "x", ("c", 1): "x"}
    assert index.pages(more, books, root, cache, model(dimension=3), at(9)) == index.Report("recreated", 3, 0, 2)
    assert {(r.book_stem, r.page_number, len(r.embedding)) for r in index.points(spark, root, POINTS).collect()} == {("a", 1, 3), ("c", 1, 3)}
    assert index.points(spark, root, POINTS, ["c"]).count() == 1
    none = index.pages(more.limit(0), books, root, cache, model(dimension=3), at(9))
    assert none == index.Report("kept", 0, 0, 0) and index.points(spark, root, POINTS).count() == 2


def test_chunk_index_writes_ids_back(spark, tmp_path):
    root, cache = str(tmp_path / "index"), str(tmp_path / "cache")
    schema = "id long, book_id string, book_stem string, class_number string, subject string, part string, chapter_number string, chapter_name string, topic_number string, topic_name string, page_number int, content string, point_id string"
    rows = [(i, "1", "a", "12", "Art", None, "1", "n", None, None, i, t, p) for i, (t, p) in enumerate([("z" * 20, None), ("z" * 19, None), (None, None), ("q" * 40, "old"), ("q" * 40, None)])]
    df = spark.createDataFrame(rows, schema)
    report, filled = index.chunks(df, root, cache, model())
    assert report == index.Report("created", 2, 2, 2)
    ids = {r.id: r.point_id for r in filled.collect()}
    assert ids[1] is ids[2] is None and ids[3] == "old" and len(ids[0]) == 36 and ids[0] != ids[4]
    points = index.points(spark, root, "point_id string, chunk_id string")
    assert {r.point_id: r.chunk_id for r in points.collect()} == {ids[0]: "0", ids[4]: "4"}
    report, again = index.chunks(filled, root, cache, model())
    assert report == index.Report("kept", 0, 2, 0) and {r.id: r.point_id for r in again.collect()} == ids and points.count() == 2


def plain(questions, vectors, k, but_itself):
    q, out = questions.collect(), {}
    rows = [(r.vec_id, r.label, np.array(r.embedding, np.float64)) for r in vectors.collect() if r.embedding is not None and r.label is not None]
    for x in q:
        if x.q_vec is None or x.label is None:
            continue
        s = sorted((-sum(float(a) * float(b) for a, b in zip(v, x.q_vec)), i) for i, l, v in rows if l == x.label and not (but_itself and i == x.q_id))
        out[x.q_id] = [i for _, i in s[:k]]
    return {q: i for q, i in out.items() if i}


@pytest.mark.parametrize("case", ["spread", "ties", "odd"])
def test_neighbours_by_lists(spark, case, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(knn, "ROWS", 40)
    monkeypatch.setattr(knn, "QUESTIONS", 7)
    if case == "spread":
        centres = rng.normal(size=(12, 8))
        rows = [(i, (centres[i % 12] + 0.1 * rng.normal(size=8)).tolist(), ["a", "b", "c"][(i > 100) + (i > 300)]) for i in range(600)]
    elif case == "ties":
        rows = [(i, rng.integers(-1, 2, 3).astype(float).tolist(), "a") for i in range(300)]
    else:
        rows = [(1, [0.0, 0.0], "a"), (2, None, "a"), (3, [1.0, 0.0], None), (4, [1.0, 2.0], "b"), (5, [-1.0, -2.0], "b"), (6, [0.0, 0.0], "b"), (50, [0.0, 0.0], "b"), (100, [-3.0, 1.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(5)
    q = df.where("vec_id % 50 = 0 or vec_id < 3").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"), "label")
    for itself in (False, True):
        found = knn.search(q, df, "label", 4, itself)
        got = {}
        for r in sorted(found.hits.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.q_id, []).append(r.vec_id)
        assert got == plain(q, df, 4, itself)
    if case == "spread":
        assert found.scored < 0.6 * found.pairs
    assert knn.search(q, df.limit(0), "label", 4).hits.count() == 0 == knn.search(q.limit(0), df, "label", 4).hits.count()


def test_fewer_pairs_are_scored_as_vectors_grow(spark):
    rng, shares = np.random.default_rng(1), []
    for n in (600, 6000):
        c = rng.normal(size=(int(n**0.5), 16))
        v = c[rng.integers(len(c), size=n)] + 0.05 * rng.normal(size=(n, 16))
        df = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").cache()
        q = df.where("vec_id % 50 = 0").selectExpr("vec_id as q_id", "embedding as q_vec", "label")
        found = knn.search(q, df, "label", 5)
        shares.append(found.scored / found.pairs)
        want = dense.top_k(dense.scores(q, df, ["label"]), 5, ["q_id"], "vec_id").select("q_id", "rank", "vec_id")
        assert sorted(map(tuple, found.hits.select("q_id", "rank", "vec_id").collect())) == sorted(map(tuple, want.collect()))
    assert shares[1] < shares[0] and shares[1] < 0.1


def scores(df):
    return {(r.q_id, r.book, r.page): round(r.score, 9) for r in df.collect()}


def test_postings_follow_pages_that_come_and_go(spark, plan_of):
    rng = random.Random(5)
    say = lambda: " ".join(rng.choices(["the", "The", "river", "town", "of", "a", "mill", "bridge"], k=rng.randint(0, 30)))
    rows = [(b, p, say()) for b in ("x", "y", "z") for p in range(1, 13)] + [("x", 13, None), ("w", 1, "")]
    pages = spark.createDataFrame(rows, "book string, page int, text string")
    asked = spark.createDataFrame([(1, "x", "the river the"), (2, "y", "a town of mills"), (3, "z", "bridge"), (4, "x", None), (5, "none", "river"), (6, "w", "the")], "q_id int, book string, q_text string")
    p = Postings(spark, "test_postings", 4)
    p.drop()
    p.add(pages.where("page <= 6"))
    assert scores(p.search(asked)) == scores(lexical.bm25(pages.where("page <= 6"), asked)) != {}
    p.add(pages.where("page > 6"))
    assert scores(p.search(asked)) == scores(lexical.bm25(pages, asked))
    plan = plan_of(p.search(asked))
    assert plan.count("Exchange hashpartitioning(book#") <= 2 and "SelectedBucketsCount" in plan and "Bucketed: true" in plan
    for scan in ("test_postings_postings", "test_postings_terms"):
        at = plan.index(f"{scan}[")
        assert "Exchange" not in plan[plan.rindex("HashAggregate", 0, at) : at]
    p.remove(pages.where("page % 2 = 0"))
    p.remove(spark.createDataFrame([("x", 99), ("q", 1)], "book string, page int"))
    left = pages.where("page % 2 = 1")
    assert scores(p.search(asked)) == scores(lexical.bm25(left, asked))
    p.remove(left.where("book = 'z'"))
    q = p.compact("test_postings_new")
    want = scores(lexical.bm25(left.where("book <> 'z'"), asked))
    assert scores(p.search(asked)) == scores(q.search(asked)) == want
    assert q._net().count() == spark.table("test_postings_new_postings").count() < spark.table("test_postings_postings").count()
    p.drop(), q.drop()


def test_neighbours_by_products(spark, monkeypatch):
    """What all pairs give: close scores, ties, passes, labels that nobody asks for; and where there are no matrices."""
    r = random.Random(4)
    base = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(30)]
    v = [(i, [x * (1 + (i % 3) * 2**-22) for x in base[i % 30]], None if i % 41 == 0 else i % 4) for i in range(300)] + [(300, [0.0] * 6, 9)]
    vectors = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").repartition(3)
    asked = vectors.where("vec_id % 7 = 0 and coalesce(label, 0) < 3").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"), "label")
    want = lambda q, v: {(x.q_id, x.vec_id, x.rank, x.score) for x in dense.top_k(dense.scores(q, v, ["label"]), 5, ["q_id"], "vec_id").collect()}
    got = lambda q, v: {tuple(x) for x in knn.by_products(q, v, "label", 5).select("q_id", "vec_id", "rank", "score").collect()}
    assert got(asked, vectors) == want(asked, vectors) and len(want(asked, vectors)) > 100
    monkeypatch.setattr(knn, "ASKED", 10)
    monkeypatch.setattr(knn, "MET", 8)
    monkeypatch.setattr(knn, "AT_ONCE", 40)
    assert got(asked, vectors) == want(asked, vectors)
    odd = vectors.union(spark.createDataFrame([(901, None, 1), (902, [1.0] * 6, 2)], vectors.schema))
    assert got(asked, odd) == want(asked, odd)
    assert got(asked.where("false"), vectors) == set()
