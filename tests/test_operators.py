import json
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscan import schemas
from folioscan.functions import text as T
from folioscan.operators import scan, adapters, align, checks, chunk, dense, layout, lexical, outputs, retrieve, segment, store
from folioscan.plans import books
from folioscan.sources import tables
from folioscan.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


RANGES = [
    ([("1.1", "3"), ("1.2", "5"), ("1.3", "5"), ("1.4", "9")], (10, 3, 16), [(10, 12), (12, 12), (12, 16), (16, 16)], 10, 2),
    ([("2.1", "5"), ("2.2", "7")], (10, 3, 15), [(12, 14), (14, 15)], 7, 1),
    ([], (10, 3, 12), [], 3, 0),
    ([("3.1", "105"), ("3.2", None), ("3.3", "108")], (20, 5, 30), [(30, 30), (30, 30)], 12, 1),
]


@pytest.mark.parametrize("topics, span, want, n_chunks, n_boundary", RANGES)
def test_topic_ranges_and_chunks(spark, topics, span, want, n_chunks, n_boundary):
    ch = spark.createDataFrame([("b", 1, span[0], span[2], span[1])], "book string, chapter int, start_page int, end_page int, toc_start int")
    tp = spark.createDataFrame([("b", 1, i, t, p) for i, (t, p) in enumerate(topics)], "book string, chapter int, pos int, topic string, topic_page string")
    pg = spark.createDataFrame([("b", p, f" text {p} ") for p in range(1, 40)], "book string, page int, text string")
    r = chunk.topic_ranges(ch, tp)
    assert [(x.first_page, x.last_page) for x in r.orderBy("first_page", "pos").collect()] == want
    c = chunk.topic_page_chunks(ch, r, pg)
    assert c.count() == n_chunks and chunk.boundary_pages(c).count() == n_boundary
    assert {x.page for x in c.collect()} == set(range(span[0], span[2] + 1))
    assert all(x.text == f"text {x.page}" for x in c.collect())


@pytest.mark.parametrize("given, want", [((50, 10, 200), (51, 80)), ((0, 10, 200), (5, 40)), ((0, 3, 200), (1, 33)), ((0, 170, 200), (1, 30)), ((0, 0, 20), (1, 20)), ((190, 0, 200), (191, 200))])
def test_anchor_window(spark, given, want):
    low, high = align.anchor_window(*[F.lit(x) for x in given])
    assert tuple(spark.range(1).select(low, high).first()) == want


@pytest.mark.parametrize("given, want", [(["3", "25", "210", "240"], [1, 31]), (["120", "150", "210", "240"], [120, 150, 1, 31]), (["210", "240"], [210, 240]), (["5", "9"], [5, 9]), (["120", "iv", "210"], [120, 1])])
def test_companion_volume(spark, given, want):
    df = spark.createDataFrame([("b", i, s, 200) for i, s in enumerate(given)], "book string, pos int, start_page string, total_pages int")
    assert [r.start_page for r in align.repair_companion(df).orderBy("pos").collect()] == want


def test_decision_and_gap(spark):
    s = spark.createDataFrame([(1, 1, 1.5), (1, 2, 1.2), (2, 1, 1.5), (2, 2, 1.4), (3, 1, 1.5)], "q int, page int, score double")
    g = dense.gap(s, ["q"], "page").withColumn("d", align.decision(F.col("gap"), F.lit(0.0)))
    assert [(r.q, r.d) for r in g.orderBy("q").collect()] == [(1, "best"), (2, "resolver"), (3, "best")]
    assert spark.range(1).select(align.decision(F.lit(0.3), F.lit(1.0))).first()[0] == "resolver"


def test_chapter_ends(spark):
    df = spark.createDataFrame([("a", 0, 5, 60), ("a", 1, 20, 60), ("a", 2, 41, 60), ("b", 0, 5, 9), ("b", 1, 5, 9)], "book string, pos int, start_page int, total_pages int")
    assert [r.end_page for r in align.chapter_ends(df).orderBy("book", "pos").collect()] == [19, 40, 60, 4, 9]


def test_structural_score(spark):
    text = "CHAPTER 3\nCELLS AND TISSUES\n3.1 Introduction\nObjectives: after reading"
    pages = spark.createDataFrame([(1, text), (2, "EXERCISES\n3.1 question"), (3, None), (5, "UNIT3\n13.1 x 3.2"), (6, "Xiv 2-1 chapter")], "page int, text string")
    pairs = spark.createDataFrame([("3", "Cells and Tissues", 1), ("3", "Cells and Tissues", 2), ("3", "x", 3), ("3", "x", 4), ("3", "x", 5), ("13", "x", 5), ("iv", "x", 6), ("2-1", "x", 6)], "chapter_number string, chapter_name string, page int")
    got = {(r.page, r.chapter_number): r for r in align.structural(pairs, pages, ["page"]).collect()}
    a, b = got[1, "3"], got[2, "3"]
    assert a.signals["title_match"] == 1 and a.signals["section_start"] == 1 and a.signals["objectives_marker"] == 1 and a.signals["uppercase_heading"] == 1 and a.signals["chapter_number"] == 1
    assert a.signals["structural_score"] == round(a.structural, 4) and b.signals["negative_marker"] == 1 and b.signals["exercise_marker"] == 1 and b.structural < 0 < a.structural
    assert all(got[p, "3"].structural == 0 and got[p, "3"].signals == {} for p in (3, 4))
    number = lambda p, n: (got[p, n].signals["chapter_number"], got[p, n].signals["section_start"])
    assert number(5, "3") == (1, 0.5) and number(5, "13") == (1, 1) and number(6, "iv") == (0, 0) and number(6, "2-1") == (0, 0)
    r = align.rerank(align.structural(pairs.where("page = 1").withColumn("score", F.lit(0.5)), pages, ["page"])).first()
    assert r.total == 0.5 + 0.85 * r.structural and r.signals["hybrid_score"] == 0.5 and r.signals["total_score"] == round(r.total, 4)


def test_topics_of_pages(spark):
    """What counts as a heading: at the line's start, with text after it, in the contents."""
    toc = spark.createDataFrame([("b", "1", "1.1"), ("b", "1", "1.2"), ("b", "2", None), ("b", "9", "9.1")], "book string, chapter string, topic string")
    pages = ["nothing yet", "  1.2 indented", "1.1 Cells\n1.2 Walls", "1.2", "chapter Two Motion", "chapter three Unknown, Chapter 1 Later", "Chapter 9 in digits", "Chapter nine", "9.1\n and its text", "4.4 Unknown\n1.2 Known"]
    df = spark.createDataFrame([("b", p, t) for p, t in enumerate(pages)] + [("c", 0, "1.1 Cells")], "book string, page int, text string")
    got = {r.page: (r.topic, r.chapter) for r in layout.page_topics(df, toc).where("book = 'b'").collect()}
    assert got == {0: (None, None), 1: (None, None), 2: ("1.1", "1"), 3: ("1.1", "1"), 4: (None, "2"), 5: (None, "2"), 6: (None, "9"), 7: (None, "9"), 8: ("9.1", "9"), 9: ("1.2", "1")}


def test_captions_of_images(spark):
    said = [(["See Figure 1.2 here", " "], []), (["Fig.1.2"], None), (["no number"], ["FIGURE 1.3 in a footnote"]), ([], ["Fig. 2.1"]), (None, None), (["CONFIG 1.2"], [])]
    i = spark.createDataFrame([("b", 1, k, c, f) for k, (c, f) in enumerate(said)], "book string, page int, image_seq int, image_caption array<string>, image_footnote array<string>").withColumn("caption", layout.caption_of())
    toc = spark.createDataFrame([("b", "1", "1.2"), ("b", "1", "1.3"), ("b", "1", "2.1")], "book string, chapter string, topic string")
    topics = spark.createDataFrame([("b", 1, "t", "c")], "book string, page int, topic string, chapter string")
    got = [(r.fig, r.topic, r.chapter) for r in layout.image_index(i, topics, toc).orderBy("image_seq").collect()]
    assert got == [("1.2", "1.2", "1"), (None, "t", "c"), ("1.3", "1.3", "1"), ("2.1", "t", "c"), (None, "t", "c"), (None, "t", "c")]


def test_chapters_with_their_number_on_a_line(spark):
    pages = ["contents\nMotion\nLight", "preface", "Chapter 1 Motion\nbody", "more", "  LIGHT ", "chapter 12   Heat", "Chapter x Sound"]
    p = spark.createDataFrame([("b", k + 1, t) for k, t in enumerate(pages)], "book string, page int, text string")
    c = spark.createDataFrame([("b", n, n) for n in ("Motion", "Light", "Heat", "Sound")], "book string, chapter string, name string")
    skipped = spark.createDataFrame([("b", 1)], "book string, page int")
    starts = lambda s: {r.chapter: (r.first_page, r.last_page) for r in chunk.chapter_chunks(p, c, skipped=s).collect()}
    assert starts(skipped) == starts(None) == {"Motion": (3, 4), "Light": (5, 5), "Heat": (6, 7)}
    alone = spark.createDataFrame([("b", 1, "Motion"), ("b", 2, "x"), ("b", 3, "Chapter 1 Motion")], "book string, page int, text string")
    assert [(r.first_page, r.last_page) for r in chunk.chapter_chunks(alone, c, skipped=skipped).collect()] == [(3, 3)]


def test_windows_of_a_chapter_are_made_page_by_page(spark, plan_of):
    """Those of the chapter's whole text, pages without words and pages of several windows too; no row gets a chapter's text."""
    r = random.Random(5)
    sizes = {"a": [3, 0, 1200, 5, 333, 80, 400], "b": [340], "c": [*[17] * 60, 0], "d": [0, 0], "e": [400, 19], "f": [1, 399, 20]}
    pages, names, texts, at = [], [], {}, {}
    for book, ns in sizes.items():
        said = [" \n".join(f"{book}{r.random():.6f}" for _ in range(n)) for n in ns]
        said[0] = f"Start\n{said[0]}"
        pages += [(book, k + 1, t) for k, t in enumerate(said)]
        texts[book] = "\n".join(said)
    pages += [("g", 1, "Start\nb"), ("g", 1, "a b"), ("g", 2, None)]
    texts["g"] = "Start\nb\na b"
    p = spark.createDataFrame(pages, "book string, page int, text string")
    c = chunk.chapter_chunks(p, spark.createDataFrame([(b, None, "start") for b in [*sizes, "g"]], "book string, chapter string, name string"))
    whole = spark.createDataFrame(list(texts.items()), "book string, text string").select("book", F.posexplode(T.word_windows("text")).alias("i", "content"))
    want = {(x.book, x.i + 1): sorted(x.content.split()) if x.book == "g" else x.content for x in whole.collect()}
    assert {(x.book, x.seq): sorted(x.content.split()) if x.book == "g" else x.content for x in c.collect()} == want and len(want) > 10
    assert {(x.book, x.last_page) for x in c.collect()} == {*((b, len(ns)) for b, ns in sizes.items()), ("g", 2)}


def test_sums_before_each_row(spark):
    df = spark.createDataFrame([(k, i, i % 5) for k in ("a", None) for i in range(50)], "k string, i int, v int").repartition(4)
    got = {(x.k, x.i): x.s for x in scan.summed(df, "k", ["i"], "v", "s").collect()}
    assert got == {(k, i): sum(j % 5 for j in range(i)) for k in ("a", None) for i in range(50)}


def plain_picks(chapters, resolver=None):
    """chapters: for each [(hybrid, total, negative, page)], toc page, pages of the book."""

    def pick(cands, after):
        valid = [p for _, p in cands if after <= 0 or p > after]
        if not valid:
            return cands[0][1]
        if resolver:
            try:
                said = resolver(align.Question("1", "n", after, sorted((p, "") for _, p in [c for c in cands if c[1] in valid][:8])))
                if said in valid:
                    return said
            except ValueError:
                pass
        return valid[0]

    out, previous = [], 0
    for rows, toc, total in chapters:
        top = {p for *_, p in sorted(rows, key=lambda r: (-r[0], r[3]))[:15]}
        low, high = (previous + 1, previous + 30) if previous else (max(1, toc - 5), toc + 30) if 0 < toc <= 0.8 * total else (1, 30)
        kept = sorted((r for r in rows if r[3] in top or low <= r[3] <= min(high, total)), key=lambda r: (-r[1], r[3]))
        cands = [(r[1], r[3]) for r in kept]
        gap = kept[0][1] - (kept[1][1] if len(kept) > 1 else -999)
        clear = gap >= 0.18 and kept[0][2] == 0
        previous = kept[0][3] if clear else pick(cands, 0)
        out.append([previous, "best" if clear else "resolver", cands])
    for i in range(1, len(out)):
        if out[i][0] <= out[i - 1][0]:
            out[i][:2] = pick(out[i][2], out[i - 1][0]), "repaired"
    return [tuple(o[:2]) for o in out]


@pytest.mark.parametrize("odd", [False, True])
def test_ordered_picks(spark, odd):
    def answer(q):
        best = max(p for p, _ in q.shown)
        if best % 7 == 0:
            raise ValueError("no answer")
        return 10_000 if best % 5 == 0 else best

    resolver = answer if odd else None
    rng = random.Random(11)
    books, rows = {}, []
    for b in range(12):
        total = rng.choice([5, 40, 120])
        books[f"b{b}"] = chapters = []
        for pos in range(1, rng.randint(2, 7)):
            pages = rng.sample(range(1, total + 1), rng.randint(1, total))
            cands = [(h, h + rng.choice([0, 0.1, 0.5]), float(rng.random() < 0.2), p) for p in pages for h in [round(rng.random(), 2)]]
            chapters.append((cands, rng.choice([0, 3, 20, total]), total))
            rows += [(f"b{b}", pos, p, h, s, n, chapters[-1][1], total) for h, s, n, p in cands]
    df = spark.createDataFrame(rows, "book string, pos int, page int, hybrid double, total double, negative double, toc_page int, total_pages int")
    got = {}
    for r in align.fold(df, resolver=resolver).orderBy("book", "pos").collect():
        got.setdefault(r.book, []).append((r.start_page, r.decided_by))
    assert got == {b: plain_picks(c, resolver) for b, c in books.items()}
    assert any(d == "repaired" for g in got.values() for _, d in g)


def test_resolver_is_shown_pages_in_order(spark):
    """The best eight pages, by page, with 300 characters each; unknown contents pages; replies in words."""
    asked = []
    rows = [("b", pos, p, 0.1, 1.0 - p / 100, 0.0, None, 40, "Motion", "iv") for pos in (1, 2) for p in range(1, 41)]
    df = spark.createDataFrame(rows, "book string, pos int, page int, hybrid double, total double, negative double, toc_page int, total_pages int, name string, number string")
    pages = spark.createDataFrame([("b", p, f" page {p} " + "x" * 400) for p in range(1, 40)], "book string, page int, text string")
    opened = pages.select("book", "page", F.array(F.lit("z")).alias("lines"), align.snippet("text").alias("snippet"))

    def resolver(q):
        text = q.prompt()
        assert [p for p, _ in q.shown] == sorted(p for p, _ in q.shown) and len(q.shown) <= 8 and all(len(t) == 300 for p, t in q.shown if p < 40)
        assert 'chapter iv: "Motion"' in text and f"PAGE {q.shown[0][0]}:" in text and ("greater than" in text) == (q.after > 0)
        return f"It is page {q.shown[3][0]}."

    got = [(r.pos, r.start_page, r.decided_by) for r in align.fold(df, opened, resolver).orderBy("pos").collect()]
    assert got == [(1, 4, "resolver"), (2, 8, "repaired")] and not asked


def test_titles_count_where_a_page_takes_part(spark):
    rows = [("b", 1, p, 0.1, 0.1, 0.0, 0, 40, "Living Cells") for p in range(1, 41)]
    df = spark.createDataFrame(rows, "book string, pos int, page int, hybrid double, total double, negative double, toc_page int, total_pages int, name string")
    lines = spark.createDataFrame([("b", p, ["Living cells" if p in (17, 35) else "other"]) for p in range(1, 41)], "book string, page int, lines array<string>")
    got = align.fold(df, lines).first()
    assert (got.start_page, got.decided_by) == (17, "best") and 0.18 < got.lead < 0.2550001


def test_dense_plan_and_ties(spark, plan_of):
    v = spark.createDataFrame([(i, [1.0, 0.0], 1) for i in range(5)], "vec_id int, embedding array<float>, label int")
    q = v.where("vec_id = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"), "label")
    top = dense.top_k(dense.scores(q, v, ["label"]), 2, ["q_id"], "vec_id")
    assert [r.vec_id for r in top.orderBy("rank").collect()] == [0, 1]
    plan = plan_of(top)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_bm25_counts_empty_pages(spark):
    pages = spark.createDataFrame([("b", 1, "red red apple"), ("b", 2, "green apple"), ("b", 3, ""), ("b", 4, None)], "book string, page int, text string")
    q = spark.createDataFrame([(1, "b", "RED apple"), (2, "b", ""), (3, "c", "red")], "q_id int, book string, q_text string")
    got = {(r.q_id, r.page): r.score for r in lexical.bm25(pages, q).collect()}
    assert set(got) == {(1, 1), (1, 2)} and got[1, 1] > got[1, 2]


def test_by_max_keeps_sign_and_zero(spark):
    s = spark.createDataFrame([(1, -2.0), (1, -1.0), (2, 0.0)], "q int, score double")
    assert rows(dense.by_max(s, ["q"]).select("q", "score"), "q", "score") == [(1, 1.0), (1, 2.0), (2, None)]
    assert rows(dense.by_max(s, ["q"], guarded=True).select("q", "score"), "q", "score") == [(1, -2.0), (1, -1.0), (2, 0.0)]


def test_follow_up_questions(spark):
    t = spark.createDataFrame([(1, 0, "user", "what is a cell"), (1, 1, "assistant", "x"), (1, 2, "user", " and a b c d "), (1, 3, "user", "one two three four five six"), (2, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    got = [r.search_text for r in retrieve.search_queries(t).orderBy("conv_id", "turn").collect()]
    assert got == ["what is a cell", "what is a cell and a b c d", "one two three four five six", "hi"]


def test_words_that_no_query_says_are_not_moved(spark, plan_of, monkeypatch):
    """Pages' words are counted where they are read; with few and with many words of queries scores are the same."""
    pages = spark.createDataFrame([("b", i, " ".join(f"w{i * k % 7}" for k in range(i % 5 * 3))) for i in range(30)] + [("b", 30, None), ("c", 1, "w1 w1 W2")], "book string, page int, text string")
    asked = spark.createDataFrame([(1, "b", "w1 w2 w2 none"), (2, "c", "w2 w9"), (3, "z", "w1")], "q_id int, book string, q_text string")
    found = lexical.bm25(pages, asked)
    plan = plan_of(found)
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*page", plan)) == 1 and "BroadcastHashJoin" in plan
    few = {(r.q_id, r.page): round(r.score, 9) for r in found.collect()}
    monkeypatch.setattr(lexical, "SMALL", 0)
    assert {(r.q_id, r.page): round(r.score, 9) for r in lexical.bm25(pages, asked).collect()} == few and (2, 1) in few and len(few) > 10
    w = spark.createDataFrame([(["b", "a", "b", "é", "a", "b"],), ([],), (["x"],)], "w array<string>")
    assert [{x.term: x.tf for x in r.c} for r in w.select(lexical.counted(F.col("w")).alias("c")).collect()] == [{"a": 2, "b": 3, "é": 1}, {}, {"x": 1}]


def test_the_line_fold_sees_what_may_be_headings(spark):
    """Of lines between them it gets how many they are and whether they say anything."""
    pages = spark.createDataFrame([("b", 1, "a\n" * 500 + "1.2 Cells\n" + " \n" * 500), ("b", 2, "\n"), ("b", 3, "Example 1.1 x\nb"), ("b", 4, None)], "book string, page int, text string")
    marks = segment._marks(pages.select("book", "page", T.lines(F.coalesce("text", F.lit(""))).alias("lines")))
    got = [(r.page, r.i, r.role, r.topic, r.rest, r.rest_solid) for r in marks.orderBy("page", "i").collect()]
    assert got == [(1, -1, 0, None, 500, True), (1, 500, 0, "1.2", 500, False), (2, -1, 0, None, 1, False), (3, 0, 3, None, 1, True), (4, -1, 0, None, 1, False)]


def test_chunks_are_numbered_without_a_book_in_one_task(spark, plan_of):
    s = spark.createDataFrame([("b", i, "1", "1.1", "n", "content", 1, 1, [1], " ".join(["w"] * n)) for i, n in enumerate((900, 3, 400, 0), 1)], "book string, seg int, chapter string, topic string, topic_name string, kind string, page_start int, page_end int, pages array<int>, content string")
    w = segment.windows(s)
    assert [(r.seq, r.chunk_id[-4:], r.word_count) for r in w.orderBy("seq").collect()] == [(1, "0001", 400), (2, "0002", 400), (3, "0003", 220), (4, "0004", 3), (5, "0005", 460)]
    assert "Window" not in plan_of(w)


def test_image_chain(spark):
    im = spark.createDataFrame([("a", "B", 3, "Fig 1.2 x", "1.2"), ("b", "B", 3, "(a)", None), ("r", "B", 3, "(ii)", None), ("s", "B", 3, " (a)", None), ("t", "B", 3, "(a)\n", None), ("c", "B", 4, None, None), ("d", "C", 3, None, None), ("e", "D", 9, "Fig 1.2", "1.2")], "image_id string, book string, page int, caption string, fig_number string")
    hits = spark.createDataFrame([(1, "B", 4, 1, "see fig 1.2 here"), (2, "B", 4, 1, "see nothing"), (2, "C", 3, 2, "nor here"), (3, "Z", 1, 1, "fig 1.2"), (4, "C", 3, 1, "fig 1.2"), (4, "B", 7, 2, "x")], "q int, book string, page int, rank int, text string")
    got = sorted((r.q, r.image_id, r.source) for r in retrieve.images_for(im, hits).collect())
    assert got == [(1, "a", 1), (1, "b", 2), (1, "r", 2), (2, "c", 3), (4, "a", 1), (4, "b", 2), (4, "d", 2), (4, "r", 2)]


def test_images_found_twice_count_once(spark):
    """Repeated ids, null ids, and captions that are sub-parts of an image with a number: all are matches first."""
    im = [("a", "B", 3, "Fig 1.2 x", "1.2"), ("a", "B", 3, "(a)", None), ("a", "B", 3, None, None), (None, "B", 3, None, None), (None, "B", 3, "(b)", None), ("m", "B", 3, "(c)", "1.2"), ("n", "B", 3, "(c)", "7"), ("p", "B", None, None, None), ("u", None, 3, None, None)]
    im = spark.createDataFrame(im, "image_id string, book string, page int, caption string, fig_number string")
    hits = spark.createDataFrame([(1, "B", 9, 1, "fig 1.2"), (2, "B", 3, 1, "fig 5.5")], "q int, book string, page int, rank int, text string")
    got = sorted((r.q, str(r.image_id), r.source) for r in retrieve.images_for(im, hits).collect())
    assert got == [(1, "None", 2), (1, "a", 1), (1, "m", 1), (1, "n", 2), *[(2, "None", 3)] * 2, *[(2, "a", 3)] * 3, (2, "m", 3), (2, "n", 3)]
    assert sorted((r.q, str(r.image_id), r.page) for r in retrieve.sub_parts(im, hits).collect()) == [*[(1, "None", 3)] * 2, *[(1, "a", 3)] * 2, (1, "m", 3), (1, "n", 3)]


def test_pairs_of_questions_and_images_are_not_shuffled(spark, plan_of):
    """No exchange and no aggregate stands above the joins that give the pairs."""
    im = spark.range(2000).selectExpr("cast(id as string) as image_id", "'B' as book", "cast(id div 2 % 4 as int) as page", "if(id % 2 = 0, 'Fig 1.2', '(a)') as caption", "if(id % 2 = 0, '1.2', null) as fig_number").localCheckpoint()
    hits = spark.range(20).selectExpr("cast(id as int) as q", "'B' as book", "1 as page", "1 as rank", "'fig 1.2' as text").localCheckpoint()
    for df, n in ((retrieve.sub_parts(im, hits), 20_000), (retrieve.images_for(im, hits), 40_000)):
        assert df.count() == n
        plan = plan_of(df)
        assert plan.index("Join") < plan.index("Exchange hashpartitioning") and "Aggregate" not in plan[: plan.index("Join")]


def test_keywords(spark, tmp_path):
    (tmp_path / "k.txt").write_text(" contents \n# no\n\nIndex\n")
    assert tables.keywords(spark, str(tmp_path / "k.txt")) == ["CONTENTS", "INDEX"]
    assert tables.keywords(spark, str(tmp_path / "none.txt")) == tables.keywords(spark) == ["CONTENTS", "CONTENT", "TABLE OF CONTENTS"]
    with pytest.raises(ValueError):
        tables.keywords(spark, str(tmp_path / "k.txt"), most=1)


def test_prompt(spark):
    h = [(f"r{i}", f"t{i}") for i in range(8)]
    df = spark.createDataFrame([(h,)], "h array<struct<role:string,content:string>>")
    got = df.select(retrieve.prompt(F.lit("S"), F.lit("C"), F.col("h"), F.lit("Q")).alias("m")).first().m
    assert [m.content for m in got] == ["S\n\nC", "t2", "t3", "t4", "t5", "t6", "t7", "Q"]


def test_header(spark):
    f = retrieve.header(F.lit("Bio"), F.lit("1"), F.lit("Cells"), F.lit(None).cast("string"), F.lit("ignored"), F.lit(7))
    assert spark.range(1).select(f).first()[0] == "Bio | Chapter 1: Cells | Page 7"


def test_manifest_status(spark):
    df = spark.createDataFrame([("a", "Bio", "XII", None, 3), ("b", "unknown", "12", None, 3), ("c", "Bio", "12", "II", 3), ("d", "Bio", "12", None, 3), ("e", "Bio", "12", None, 0), ("f", "Bio", "IX", None, 0)], "book string, subject string, class_number string, part string, n_pages int")
    assert [r.status for r in checks.manifest_status(df).orderBy("book").collect()] == ["patched", "patched", "patched", "ok", "ok", "no_pdfs"]


def test_alignment_issues(spark):
    m = spark.createDataFrame([("b", 1, 1, 10, 50), ("b", 2, 10, 20, 50), ("b", 3, 30, 25, 50), ("b", 4, 0, 51, 50)], "book string, pos int, start_page int, end_page int, total_pages int")
    assert [r.issues for r in checks.alignment_issues(m).orderBy("pos").collect()] == [[], ["OVERLAP"], ["BAD_END"], ["OVERLAP", "OUT_OF_RANGE", "END_EXCEEDS"]]


def test_contents_headings(spark):
    texts = ["x\n Contents \n", "CONTENTS PART II", "Contentsx", "Index of terms", "Contents " + "y" * 60, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    hit = [r.h for r in df.select("i", layout.heading_hit(F.col("t"), tables.TOC_KEYWORDS).alias("h")).orderBy("i").collect()]
    assert hit == [True, True, False, True, False, False]


def test_blocks(spark):
    js = '[{"type":"text","text":" A ","page_idx":0},{"type":"equation","text":"x","page_idx":0},{"type":"image","img_path":"i.png","image_caption":["Fig 1.1"],"page_idx":1},{"type":"image","img_path":"j.png","page_idx":1}]'
    b = tables.blocks_of_json(spark.createDataFrame([("b", js)], "book_stem string, content string"))
    assert rows(tables.blocks_to_pages(b).select("page_number", "text")) == [(1, "A\n\n$$x$$"), (2, "")]
    assert rows(tables.images_of_blocks(b).select("page_number", "image_seq", "caption")) == [(2, 1, "Fig 1.1"), (2, 2, None)]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, made int")
    new = spark.createDataFrame([(2, "B", 99), (3, "C", 99)], "k int, v string, made int")
    assert rows(store.upsert(old, new, ["k"], keep=["made"])) == [(1, "a", 10), (2, "B", 20), (3, "C", 99)]
    assert rows(store.replaced(old, new, "k")) == [(1, "a", 10), (2, "B", 99), (3, "C", 99)]
    assert rows(store.write_back(old, new.select("k", "v"), ["k"], "v").select("k", "v")) == [(1, "a"), (2, "B")]
    assert rows(store.cascade(old, new, ["k"])) == [(1, "a", 10)]


def test_partition_overwrite_is_idempotent(spark, tmp_path):
    at = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "book_stem string, v int")
    for _ in range(2):
        store.replace_partitions(first, at)
    store.replace_partitions(spark.createDataFrame([("b", 3)], "book_stem string, v int"), at)
    assert rows(spark.read.parquet(at).select("book_stem", "v")) == [("a", 1), ("b", 3)]


def test_archive(spark):
    books = spark.createDataFrame([("a", None), ("b", None)], "book_stem string, pdf_data binary")
    names = [("x/a/a.pdf", b"P"), ("x/a/page_0001.pdf", b"Q"), ("x/a/pdfs/whole.pdf", b"R"), ("x/a/img/i.png", b"I"), ("x/a/img/i.png", b"I"), ("y/a/img/i.png", b"J"), ("x/a/other/i.png", b"K")]
    files = spark.createDataFrame([("a", n, bytearray(c)) for n, c in names], "book_stem string, path string, content binary")
    images = spark.createDataFrame([("a", "img/i.png", "Fig 2.1", None, "0", False), ("a", "img/j.png", "Fig 3", None, None, False), ("a", "other/i.png", "none", None, "9", False)], "book_stem string, image_path string, caption string, image_data binary, fig_number string, has_data boolean")
    docs = spark.createDataFrame([("1", "a", "toc.json", "{}"), ("1", "a", "other.json", "{}"), ("1", "a", "chunks.json", "{cut")], "book_id string, book_stem string, file_name string, content string")
    b, i, d = store.archive(books, files, images, docs)
    assert [(r.book_stem, r.pdf_data) for r in b.orderBy("book_stem").collect()] == [("a", b"P"), ("b", None)]
    assert [(r.image_path, r.image_data, r.fig_number, r.has_data) for r in i.orderBy("image_path").collect()] == [("img/i.png", b"I", "2.1", True), ("img/j.png", None, None, False), ("other/i.png", b"K", None, True)]
    assert d.count() == 1


def _toc(spark):
    return spark.createDataFrame([("b", "1", "Living Cells and Tissues", "1.1", "Cell wall"), ("b", "1", "Living Cells and Tissues", "1.2", "Nucleus"), ("b", "2", "Plant Physiology Basics", "2.1", "Transport")], "book string, chapter string, chapter_name string, topic string, topic_name string")


def test_block_segments(spark):
    said = [("text", 1, "Chapter 1 Living Cells and Tissues", 1), ("text", None, "before any topic", 1), ("text", 2, "1.1 Cell wall", 2), ("text", None, "body", 2), ("header", None, "noise", 2), ("equation", None, "$$x$$", 2), ("text", None, "Example 1.1 do it", 3),
            ("text", None, "EXERCISES", 3), ("text", None, "1.5 Why?", 3), ("text", None, "Answers to exercises", 4), ("text", None, "secret", 4), ("text", 1, "Plant Physiology Basics", 5), ("text", 2, "2.1 Transport", 5), ("text", None, "end", 5)]
    b = spark.createDataFrame([("b", i, p, t, l, x) for i, (t, l, x, p) in enumerate(said)], "book string, pos int, page int, type string, level int, text string")
    got = [(r.topic, r.kind, r.content) for r in segment.block_segments(b, _toc(spark)).orderBy("seg").collect()]
    assert got == [("1.0", "content", "before any topic"), ("1.1", "content", "1.1 Cell wall\nbody\n$$x$$"), ("ex_1.1", "example", "Example 1.1 do it"), ("1.5", "exercise", "1.5 Why?"), ("2.1", "content", "2.1 Transport\nend")]


def test_chunk_columns(spark):
    b = spark.createDataFrame([("b", 0, 1, "text", 2, "1.1 Cell wall", None), ("b", 1, 2, "image", None, None, None), ("b", 2, 2, "code", None, "", " print(1) "), ("b", 3, 3, "text", None, "end", None), ("b", 4, 4, "text", 2, "1.2 Nucleus", None)], "book string, pos int, page int, type string, level int, text string, code_body string")
    images = spark.createDataFrame([("b", 2, "i2"), ("b", 1, "i1"), ("b", 9, "i9"), ("b", 2, "i1b")], "book string, page int, image_id string")
    got = segment.windows(segment.block_segments(b, _toc(spark)), images=images, chapters=_toc(spark)).orderBy("seq").collect()
    assert [(r.chapter_name, r.image_refs, r.has_images, r.mode) for r in got] == [("Living Cells and Tissues", ["i1", "i1b", "i2"], True, "mineru"), ("Living Cells and Tissues", [], False, "mineru")]
    assert got[0].content == "1.1 Cell wall print(1) end" and got[0].page_end == 3


def test_books_from_blocks(spark):
    said = [("text", 1, 0, "Contents", None), ("text", None, 0, "1.1 Cell wall", None), ("text", 1, 1, "Chapter 1 Living Cells and Tissues", None), ("text", 2, 1, "1.1 Cell wall", None), ("text", None, 1, "has $x$ in it", None), ("image", None, 1, None, "i.png"), ("text", 1, 2, "Plant Physiology Basics", None), ("text", 2, 2, "2.1 Transport", None)]
    blocks = spark.createDataFrame([("b", i, p + 1, t, x, l, f, None, None) for i, (t, l, p, x, f) in enumerate(said)], "book_stem string, pos int, page_number int, type string, text string, text_level int, img_path string, image_caption array<string>, code_body string")
    pages, contents, images = books.extracted(blocks, ["CONTENTS"])
    assert {r.page for r in contents.where("page < 2").collect()} == {1}
    chunks, base, files = books.chunked(blocks, _toc(spark), contents.where("page < 2"), images)
    assert [(r.topic, r.image_refs, r.page_start) for r in chunks.orderBy("seq").collect()] == [("1.1", ["b_2_1"], 2), ("2.1", [], 3)]
    assert [(r.total_chunks, r.total_images, r.total_equations) for r in base.collect()] == [(2, 1, 1)]
    assert sorted(r.chapter_file for r in files.collect()) == ["chapter_01_Living_Cells_and_Tissues", "chapter_02_Plant_Physiology_Basics"]


def test_outputs(spark, tmp_path):
    pages = spark.createDataFrame([("a", 2, "page_0002.pdf", "page_0002.txt"), ("a", 1, "page_0001.pdf", "page_0001.txt")], "book_stem string, page int, pdf string, txt string")
    src = spark.createDataFrame([("a", "a.pdf", "text"), ("z", "z.pdf", "layout")], "book_stem string, source_pdf string, extractor string")
    m = outputs.manifests(pages, src)
    new = outputs.with_identity(m, spark.createDataFrame([("a", "Bio", None, "12")], "book_stem string, subject string, part string, class_number string"))
    got = {r.book_stem: r for r in new.collect()}
    assert [p.page for p in got["a"].pages] == [1, 2] and (got["a"].subject, got["a"].part, got["a"].class_number) == ("Bio", None, "12") and got["z"].pages == [] and got["z"].subject is None
    at = str(tmp_path / "m")
    outputs.write_json(m, at, ["book_stem"])
    outputs.write_json(new.where("book_stem = 'a'"), at, ["book_stem"])
    back = {r.book_stem: r.subject for r in spark.read.json(at).collect()}
    assert back == {"a": "Bio", "z": None}
    ch = spark.createDataFrame([("a", 2, "2", "B", "9", 9, 20, 0.5, {"x": 1.0}), ("a", 1, "1", "A", None, 3, 8, 0.7, {})], "book_stem string, pos int, chapter_number string, chapter_name string, toc_start_page string, confirmed_start_page int, end_page int, confidence double, signals map<string,double>")
    r = outputs.alignment_maps(ch, new).first()
    assert r.subject == "Bio" and [(c["chapter_number"], c["end_page"]) for c in json.loads(r.chapters)] == [("1", 8), ("2", 20)]
    folder = spark.range(1).select(outputs.subject_folder(F.lit(' Bi/o:"'), F.lit(None).cast("string"))).first()[0]
    assert folder == "Bi_o___ClassUnknown"
    chunks = spark.createDataFrame([("b", 1, None, None), ("b", 2, "iv", "Four"), ("b", 3, "3", "Three/3"), ("b", 4, "vi", "Six"), ("b", 5, "3", "other")], "book string, seq int, chapter_number string, chapter_name string")
    assert rows(outputs.chapter_documents(chunks)) == [("b", "chapter_00_Unknown", "00", "Unknown", 1), ("b", "chapter_00_front_matter", "vi", "Six", 1), ("b", "chapter_03_Three_3", "3", "Three/3", 2)]
    assert {r.seq for r in outputs.chapter_chunks(chunks).collect()} == {1, 3, 4, 5}
    assert outputs.columns_of({"t": chunks})[1] == ("t", 2, "seq", "int", True) and outputs.sample_row(chunks).count() == 1


def test_models_read_books(spark):
    images = spark.createDataFrame([("a", p, f"i{p}") for p in range(1, 9)], "book string, page int, image_b64 string")
    some = spark.createDataFrame([("a",), ("b",)], "book string")

    def seen():
        def f(prompt):
            import json

            q = json.loads(prompt)
            return json.dumps({"subject": "+".join(q["images"]), "part": "null", "class_number": "XII"})

        return f

    got = {r.book: (r.subject, r.part, r.class_number) for r in adapters.identify_subjects(images, some, seen, "who?").collect()}
    assert got == {"a": ("i1+i2+i3+i4+i5", None, "12"), "b": ("Unknown", None, "Unknown")}
    pages = spark.createDataFrame([("a", 2, "two"), ("a", 1, "Contents"), ("b", 1, "Contents bad"), ("c", 1, "Contents cut")], "book string, page int, text string")

    def reader():
        def f(prompt):
            if "bad" in prompt:
                return "sorry"
            if "cut" in prompt:
                return '{"chapters": [{"chapter_number": "1", "chapter_name": "A", "topics": []}, {"chap'
            return '```json\n{"chapters": [{"chapter_number": 7, "chapter_name": "' + ("ok" if "Contents\\n\\ntwo" in prompt else "no") + '"}]}\n```'

        return f

    out = adapters.extract_contents(pages, images, reader, "Read: ")
    got = {r.book: ([(c.chapter_number, c.chapter_name) for c in r.chapters], r.truncated, r.error) for r in out.collect()}
    assert got == {"a": ([("7", "ok")], False, None), "b": ([], False, "Response not valid JSON:\nsorry"), "c": ([("1", "A")], True, None)}
    again = adapters.reread_contents("a", out.withColumn("error", F.lit(None).cast("string")).withColumn("chapters", F.slice("chapters", 1, 0)), pages, images, reader, "Read: ", ["CONTENTS"])
    assert {r.book: len(r.chapters) for r in again.collect()} == {"a": 1, "b": 0, "c": 0}


def test_repeated_keys_in_merges(spark):
    old = spark.createDataFrame([(1, "a", 9), (2, "b", 8)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "x", 1), (1, "c", 2), (3, "d", 3), (3, "d", 3)], "k int, v string, n int")
    assert rows(store.upsert(old, new, ["k"], order="n")) == [(1, "c", 2), (2, "b", 8), (3, "d", 3)]
    assert rows(store.upsert(old, new, ["k"], keep=["n"])) == [(1, "x", 9), (2, "b", 8), (3, "d", 3)]
    assert rows(store.write_back(old, new, ["k"], "v")) == [(1, "x", 9), (2, "b", 8)]


def test_line_segments(spark):
    pages = [(1, "preface"), (2, "1.1 Cell wall\nbody\nExample 1.1 do\nmore"), (3, "still"), (4, "EXERCISES\n1.2 Why\nAnswers to all\nsecret"), (5, "2.1 Transport\nend")]
    p = spark.createDataFrame([("b", *x) for x in pages], "book string, page int, text string")
    got = [(r.topic, r.kind, r.page_start, r.page_end) for r in segment.line_segments(p, _toc(spark)).orderBy("seg").collect()]
    assert got[0] == ("1.1", "content", 2, 2) and got[-1] == ("2.1", "content", 5, 5)
    text = " ".join(r.content for r in segment.line_segments(p, _toc(spark)).collect())
    assert "secret" not in text and "still" in text and "preface" not in text
    w = segment.windows(segment.line_segments(p, _toc(spark))).collect()
    assert len({r.chunk_id for r in w}) == len(w)


def test_figure_regions(spark):
    b = spark.createDataFrame([("b", 1, 0, 50.0, 62.0, "1.1 Cell wall"), ("b", 1, 1, 100.0, 112.0, "words"), ("b", 1, 2, 300.0, 312.0, "Figure 1.1 the wall"), ("b", 2, 0, 300.0, 312.0, "Fig. 9.9 elsewhere")], "book string, page int, pos int, y0 double, y1 double, text string")
    pages = spark.createDataFrame([("b", 1, 600.0, 800.0), ("b", 2, 600.0, 800.0)], "book string, page int, width double, height double")
    got = [(r.fig, r.y0, r.y1, r.mapping_method, r.topic) for r in layout.figure_regions(b, pages, _toc(spark)).orderBy("page").collect()]
    assert got == [("1.1", 114.0, 317.0, "caption", "1.1"), ("9.9", 40.0, 317.0, "carry_forward", "1.1")]


def test_adapters_never_make_things_up(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "text string")
    with pytest.raises(adapters.NoModel):
        adapters.embed(df, None)
    got = adapters.embed(df, lambda: lambda texts: [[3.0, 4.0] for _ in texts]).collect()
    assert [round(x, 6) for x in got[0].embedding] == [0.6, 0.8]

    def limited():
        def f(p):
            raise RuntimeError("429 too many")

        return f

    got = adapters.ask(df.withColumnRenamed("text", "prompt"), limited, fallback=lambda: str.upper).collect()
    assert sorted(r.reply for r in got) == ["A B", "C"]


def test_stream_merge(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, at int, v string"
    sink = incremental.latest_merge(out, ["k"], "at")
    for data in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "A"), (3, 1, "c")]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.run_available(spark, src, spark.createDataFrame([], schema).schema, sink, str(tmp_path / "cp")).awaitTermination()
    assert rows(incremental.newest_version(spark, out).select("k", "v")) == [(1, "A"), (2, "b"), (3, "c")]
    again = spark.createDataFrame([(1, 2, "A"), (3, 1, "c")], schema)
    sink(again, 1)  # a batch that runs again gives the same table
    assert rows(incremental.newest_version(spark, out).select("k", "v")) == [(1, "A"), (2, "b"), (3, "c")]
    for epoch in (2, 3):
        sink(spark.createDataFrame([(2, 5 + epoch, f"b{epoch}")], schema), epoch)
    (tmp_path / "out" / "v9" / "bucket=0").mkdir(parents=True)  # one that is still being written
    assert rows(incremental.newest_version(spark, out).select("k", "v")) == [(1, "A"), (2, "b3"), (3, "c")]
    assert all(len(v) <= 2 for v in incremental._versions(spark, out)[0].values())
    with pytest.raises(FileNotFoundError):
        incremental.newest_version(spark, str(tmp_path / "none"))


def test_stream_with_a_new_checkpoint_goes_on_from_the_table(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "k int, at int, v string"
    sink = incremental.latest_merge(out, ["k"], "at", 4)
    kind = spark.createDataFrame([], schema).schema
    for n, data in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 2, "A"), (3, 1, "c")], [(1, 1, "late"), (2, 9, "B")])):
        src = str(tmp_path / f"in{n}")
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(src)
        incremental.run_available(spark, src, kind, sink, str(tmp_path / f"cp{n}")).awaitTermination()  # each counts from 0
    assert rows(incremental.newest_version(spark, out).select("k", "v")) == [(1, "A"), (2, "B"), (3, "c")]
    _, last, tags = incremental._versions(spark, out)
    assert last == 2 and len(tags) == 3


def test_ordered_passes_split_a_key(spark, plan_of):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), k, rng.choice([None, None, None, k])) for k in range(3000)]
    df = spark.createDataFrame(data, "book string, page int, own int").repartition(7)
    last, want, number = {}, {}, {}
    for b, p, o in data:
        last[b] = last.get(b) if o is None else o
        number[b] = number.get(b, 0) + 1
        want[p] = b, o, last[b], number[b]
    got = {r.page: (r.book, r.own, r.last) for r in scan.carried(df, "book", ["page"], "own", "last").collect()}
    assert got == {p: w[:3] for p, w in want.items()}
    out = scan.ranked(df, "book", ["page"], "nth")
    assert {r.page: r.nth for r in out.collect()} == {p: w[3] for p, w in want.items()} and out.columns == ["book", "page", "own", "nth"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = scan._dealt(df, "book", ["page"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt.where("book = 'hot'").select("__dealt").distinct().count() > 1
    assert "Window [row_number() windowspecdefinition(__dealt#" in plan_of(out)
    assert scan.carried(df.limit(0), "book", ["page"], "own", "last").count() == 0


def test_schemas_parse_numbers_and_words(spark):
    js = '{"chapters":[{"chapter_number":1,"chapter_name":"A","start_page":"iv","topics":null}]}'
    c = spark.createDataFrame([(js,)], "j string").select(F.from_json("j", schemas.TOC).alias("t")).first().t.chapters[0]
    assert (c.chapter_number, c.start_page, c.topics) == ("1", "iv", None)


