import hashlib
import random
import time
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from folioscan.functions import fuzzy
from folioscan.functions import text as T
from folioscan.operators import headings


def one(spark, make, *values):
    """make(column) for each value, by way of a table."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


SIZES = {0: [], 1: [1], 79: [79], 340: [340], 341: [342], 400: [460], 419: [479], 420: [400, 80], 700: [400, 380], 760: [400, 400, 80], 1080: [400, 400, 460]}


def test_word_windows(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in SIZES]
    got = one(spark, T.word_windows, *texts)
    assert [[len(w.split()) for w in g] for g in got] == list(SIZES.values())


def test_word_windows_of_a_long_text(spark):
    """A text is split into words once, not for each of its windows: some 1500 windows here, over a minute when each split it anew."""
    df = spark.range(1).select(F.repeat(F.lit("some words "), 250_000).alias("t"))
    began = time.time()
    assert df.select(F.size(T.word_windows("t")).alias("n")).first().n == 1471
    assert time.time() - began < 20


def test_figure_references(spark):
    got = one(spark, T.figure_refs, "See Fig. 1.2.", "Figure 2.7(a) and fig 3", "FIG.4.1(B)", "Figures 5", "", None)
    assert got == [["1.2."], ["2.7", "3"], ["4.1"], [], [], None]
    assert one(spark, T.figure_number, "Fig 3.1 A cell", "no number", None) == ["3.1", None, None]


def test_roman_and_words(spark):
    assert one(spark, T.roman_to_arabic, "XII", " vii ", "Class X", "12", None) == ["12", "7", "Class X", "12", None]
    assert one(spark, T.word_to_digit, "Three", "eleven") == ["3", "eleven"]


def test_integers(spark):
    assert one(spark, T.safe_int, " 12 ", "12.7", "xii", "", None) == [12, None, None, None, None]
    assert one(spark, T.first_int, "page 31 or 4", "none") == [31, None]


def test_normalise_and_lines(spark):
    assert one(spark, T.normalise, " Chapter\t1:  the (cell)! 2.5 ") == ["CHAPTER 1 THE CELL 2.5"]
    assert one(spark, T.lines, "a\r\nb c\n", "x", "a\n\nb") == [["a", "b c"], ["x"], ["a", "", "b"]]


def test_json_replies(spark):
    assert one(spark, T.strip_fences, '```json\n{"a": 1}\n```', " plain ") == ['{"a": 1}', "plain"]
    said = ["``` json please\n{}\n ``` \n", "{}\n```", "```\nno end", "```", "```a\r\nb\r\n```\r\n", None]  # what opens with no fence keeps its end
    assert one(spark, T.strip_fences, *said) == ["{}", "{}\n```", "no end", "", "b", None]
    assert one(spark, T.valid_json, '{"a": 1}', '{"a": 1} ok', '{"a": 1}\n```', "", "no", None, "[1, 2]", '{"a": {"b": []}}, 1') == [True, False, False, False, False, False, True, False]
    cut = '{"chapters": [{"chapter_number": 1, "chapter_name": "A", "topics": [{"topic_number": "1.1"}, {"topic_number": "1.2"}]}, { "chapter_number" : "2", "chapter_name": "B", "topics": [] }, {"chapter_number": "3", "chapter_na'
    flat = '{"chapters": [{"chapter_number": "1", "chapter_name": "A"}, {"chapter_na'
    late = '{"chapters": [{"chapter_name": "A", "chapter_number": "1", "topics": []}'
    bad = '{"chapter_number": oops, "topics": []}{"chapter_number": "5", "topics": []}'
    got = one(spark, T.salvage_chapters, cut, flat, late, "nothing", None, bad)
    assert [(c.chapter_number, c.chapter_name, [t.topic_number for t in c.topics]) for c in got[0].chapters] == [("1", "A", ["1.1", "1.2"]), ("2", "B", [])] and got[0]._truncated
    assert got[1:5] == [None] * 4 and [c.chapter_number for c in got[5].chapters] == ["5"]
    toc = "chapters array<struct<chapter_number:string,chapter_name:string>>"
    got = one(spark, lambda c: T.json_reply(c, toc), '```json\n{"chapters": [{"chapter_number": 4}]}\n```', cut, "no")
    assert got[0].whole.chapters[0].chapter_number == "4" and got[0].salvaged is None
    assert got[1].whole is None and len(got[1].salvaged.chapters) == 2 and got[2].whole is None and got[2].salvaged is None
    got = one(spark, T.identity, '{"subject": "Biology", "part": "null", "class_number": "XII"}', 'ok {"subject": "", "part": "2", "class_number": "9"}', "none")
    assert [(g.subject, g.part, g.class_number) for g in got] == [("Biology", None, "12"), ("Unknown", "2", "9"), ("Unknown", None, "Unknown")]
    got = one(spark, T.identity, 'Sure: {"result": {"subject": "Physics", "part": "II", "class_number": "xi"}} ok', '{"result": {"subject": "Physics"}}', '```json\n{"subject": " Art ", "part": " iv ", "class_number": 7}\n```', '{"subject": "A", "part": "None"} {"subject": "B"}')
    assert [(g.subject, g.part, g.class_number) for g in got] == [("Physics", "2", "11"), ("Unknown", None, "Unknown"), ("Art", "4", "7"), ("A", None, "Unknown")]


def test_equations(spark):
    got = one(spark, T.equations, "a $$x\n+1$$ b $y$ c\n\n\n\nd", "$a\nb$ $ c $ $$", None)
    assert got[0].equations == ["$$x\n+1$$", "$y$"] and got[0].text == "a  b  c\n\nd"
    assert got[1].equations == ["$ $"] and got[1].text == "$a\nb c $ $$"


def test_figures(spark):
    said = ["Fig. 1.2 and FIGURE 3(a), figures 5, Fig.4.", "Figure. 3 and Config 4.1", "fig7"]
    assert one(spark, T.figure_refs, *said) == [["1.2", "3", "4."], ["4.1"], ["7"]]
    assert one(spark, T.figure_number, "Figure 2.1(b) x", "none", None) == ["2.1(b)", None, None]


def test_names(spark):
    assert one(spark, lambda c: T.chapter_file(c, F.lit("A b")), "3", "iv", None) == ["chapter_03_A_b", "chapter_00_front_matter", "chapter_00_A_b"]
    assert one(spark, lambda c: T.point_id(c, F.lit(3)), "bio") == [int(hashlib.sha256(b"bio:3").hexdigest()[:15], 16)]


def test_undoubled(spark):
    said = ["ElectrochemistryElectrochemistry", "Cells", "", " abcABCDabcd ", "Haloalkanes andHaloalkanes and HaloarenesHaloarenes", None]
    assert one(spark, headings.undoubled, *said) == ["Electrochemistry", "Cells", "", "abcABCDabcd", "Haloalkanes and", None]


def ratio_of(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_headings(spark):
    topics = spark.createDataFrame([("b", "7.1", "Introduction"), ("b", "7.2", "Integration as an Inverse Process"), ("b", "7.3", None), ("c", "1.1", "Something")], "book string, topic string, topic_name string")
    said = ["7 . 2 Other words", "Integration as Inverse Process", "Something else", "9.9 introduction", None, ""]
    rows = spark.createDataFrame([(i, "b", t) for i, t in enumerate(said)], "id int, book string, text string")
    assert {r.id: r.topic for r in headings.topic_matches(rows, topics).collect()} == {0: "7.2", 1: "7.2", 3: "7.1"}
    chapters = spark.createDataFrame([("b", "1", "Electrochemistry"), ("b", "2", "Amines"), ("b", "10", "Photosynthesis Basics"), ("b", "11", None)], "book string, chapter string, chapter_name string")
    said = ["Chapter 1 ElectrochemistryElectrochemistry", "Aminess", "Quantum gravity", "the amines today are here and there", "UNIT ON PHOTOSYNTHESIS BASICS and more", None]
    rows = spark.createDataFrame([(i, "b", t, 0.62) for i, t in enumerate(said)], "id int, book string, text string, least double")
    assert {r.id: r.chapter for r in headings.chapter_matches(rows, chapters).collect()} == {0: "1", 1: "2", 3: "2", 4: "10"}


def test_headings_in_the_order_of_the_contents(spark):
    """Of repeated numbers the last entry counts; of equal names the first of the contents."""
    toc = spark.createDataFrame([("b", "2", "Zebras", "2.10", "Same name", 1), ("b", "2", "Zebras", "2.9", "Same name", 2), ("b", "1", "Apes", "1.1", "Old", 3), ("b", "1", "Aardvarks", "1.1", "A newer", 4), ("b", "3", "Bare", None, None, 5)], "book string, chapter string, chapter_name string, topic string, topic_name string, pos int")
    chapters, topics = headings.numbered(toc)
    assert {r.chapter: r.chapter_name for r in chapters.collect()} == {"2": "Zebras", "1": "Aardvarks", "3": "Bare"}
    assert {r.topic: (r.chapter, r.topic_name) for r in topics.collect()} == {"2.10": ("2", "Same name"), "2.9": ("2", "Same name"), "1.1": ("1", "A newer")}
    rows = spark.createDataFrame([(0, "b", "same name")], "id int, book string, text string")
    assert headings.topic_matches(rows, toc).first().topic == "2.10"
    assert headings.topic_matches(rows, toc.drop("pos")).first().topic == "2.9"  # by number, where the contents say no order


def test_few_pairs_are_compared(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    names = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)]
    said = [(lambda n: n[: rng.randint(3, len(n))] + word())(rng.choice(names)) if rng.random() < 0.6 else " ".join(word() for _ in range(3)) for _ in range(200)]
    topics = spark.createDataFrame([("b", f"1.{k}", n, k) for k, n in enumerate(names)], "book string, topic string, topic_name string, pos int")
    rows = spark.createDataFrame([(i, "b", t) for i, t in enumerate(said)], "id int, book string, text string")
    best = {i: max((ratio_of(t.lower().strip(), n), -k) for k, n in enumerate(names)) for i, t in enumerate(said)}
    got = {r.id: r.topic for r in headings.topic_matches(rows, topics).collect()}
    assert got == {i: f"1.{-k}" for i, (s, k) in best.items() if s >= 0.75} and len(got) > 20
    assert headings.topic_pairs(rows, topics)[1].count() < 0.1 * len(names) * len(said)
    chapters = topics.select("book", F.col("topic").alias("chapter"), F.col("topic_name").alias("chapter_name"), "pos")
    r = rows.withColumn("least", F.lit(0.62))
    got = {r.id: r.chapter for r in headings.chapter_matches(r, chapters).collect()}

    def plain(t):
        up = t.strip().upper()
        forms = sorted({up, *[h for h in [undoubled_of(t.strip()).upper()]]})
        inside = [(f, k) for f in forms for k, n in enumerate(names) if len(n) >= 12 and n.upper() in f]
        if inside:
            return min(inside)[1]
        top = max((ratio_of(f, n.upper()), [-ord(c) for c in f], -k) for f in forms for k, n in enumerate(names))
        if top[0] >= 0.62:
            return -top[2]
        for k, n in enumerate(names):
            size = len(n)
            for f in forms:
                if size >= 5 and any(ratio_of(f[x : x + size], n.upper()) >= 0.82 for x in range(0, max(len(f) - size, 0) + 1, max(size // 3, 1))):
                    return k
        return None

    assert got == {i: f"1.{k}" for i, t in enumerate(said) if (k := plain(t)) is not None}
    assert headings.chapter_pairs(r, chapters)[1].count() < 0.25 * len(names) * len(said)


def undoubled_of(t):
    for k in range(len(t) // 2, 3, -1):
        if t[k:] == t[:k] or t[:k].upper().startswith(t[k:].upper()[:4]):
            return t[:k]
    return t


def test_title_match():
    assert fuzzy.ratio("", "x") == 0 and fuzzy.ratio("The Cell!", "the cell") == 1
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abCD .1!", k=rng.randint(0, 12)))
    for _ in range(300):
        name, lines = word() + word(), [word() for _ in range(rng.randint(0, 20))]
        assert fuzzy.title_match(name, lines) == max([fuzzy.ratio(name, x) for x in [*lines[:12], " ".join(lines)[:400]]])


def test_an_opener_is_normalised_once(monkeypatch):
    calls, plain = [], fuzzy.normalised
    monkeypatch.setattr(fuzzy, "normalised", lambda text: calls.append(text) or plain(text))
    page = fuzzy.Opener([f"Line {k} of a page" for k in range(20)])
    assert page.match("") == page.match(None) == 0.0 and page.match("Line 3 of a page") == 1.0
    best = [page.match(f"name {k} of a chapter") for k in range(40)]
    assert len(calls) <= 13 + 42 and best[0] == fuzzy.title_match("name 0 of a chapter", [f"Line {k} of a page" for k in range(20)])


def test_kinds_of_texts_leave_no_pair_out(spark):
    """Digits count as one character in kinds, which only bounds what is compared; headings of one kind meet few names."""
    r = random.Random(3)
    heads = [(i, "b", r.choice(["Part {} of the book", "part {}", "1.{} Heading", "{} {}", "Cells {}"]).replace("{}", str(r.randrange(2000))), r.choice([0.62, 0.72])) for i in range(60)]
    names = [("b", str(i), t) for i, t in enumerate([*(f"Part {k} of the book" for k in range(40)), *(f"Cell {k}" for k in range(20)), "1234", "heading", "of the booK 7"])]
    rows, toc = spark.createDataFrame(heads, "id int, book string, text string, least double"), spark.createDataFrame(names, "book string, chapter string, chapter_name string")
    held, pairs = headings.chapter_pairs(rows, toc)
    got = {(x.id, x.chapter) for x in pairs.collect()} | {(x.id, None) for x in held.collect()}

    def may(said: str, name: str, least: float) -> bool:
        common = sum((Counter(said) & Counter(name)).values())
        return 2 * common / (len(said) + len(name)) >= least or len(name) >= 5 and common >= 0.82 * len(name)

    want = set()
    for (i, _, text, least), once in zip(heads, one(spark, headings.undoubled, *[h[2] for h in heads])):
        forms = {text.upper(), once.upper()}
        if any(len(n) >= 12 and n.upper() in f for f in forms for _, _, n in names):
            want.add((i, None))
        else:
            want |= {(i, c) for _, c, n in names if any(may(f, n.upper(), least) for f in forms)}
    assert got == want and len(want) > 100
    many = spark.range(1000).selectExpr("cast(id as int) as id", "'b' as book", "concat('1.', id, ' Heading 1.', id) as text", "0.72D as least")
    toc = spark.range(1000).selectExpr("'b' as book", "cast(id as string) as chapter", "concat('Part ', id, ' of the book') as chapter_name")
    assert headings.chapter_pairs(many, toc)[1].count() == 0
