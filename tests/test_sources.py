"""Documents of open schema, pages as a data source, the embedding stream."""

import json
import re
import time

from pyspark.sql import functions as F

from folioscan.operators import chunk, documents, knowledge, repair
from folioscan.shared import settings
from folioscan.sources import pages, tables
from folioscan.streaming import embedding


def test_unknown_keys_stay(spark, tmp_path):
    doc = {"source_pdf": "a.pdf", "subject": "Unknown", "class_number": 12, "part": None, "extra": {"deep": [1, "1", 1.5, {"x": None}], "t": True}, "note": "é \" \\ \n", "n": 12345678901234567, "s": "12", "pages": [{"page": 1, "pdf": "p1", "txt": "t1", "dpi": 300}]}
    (tmp_path / "m.json").write_text(json.dumps(doc), encoding="utf-8")
    (tmp_path / "bad.json").write_text('{"subject": "cut')
    d = documents.read(spark, f"{tmp_path}/*.json")
    got = {r.path.rsplit("/", 1)[1]: r for r in d.select("path", documents.field(F.col("doc"), "$.class_number").alias("c"), documents.field(F.col("doc"), "$.extra.deep[1]").alias("x"), documents.pages(F.col("doc")).alias("p")).collect()}
    assert (got["m.json"].c, got["m.json"].x, [tuple(p) for p in got["m.json"].p]) == ("12", "1", [(1, "p1", "t1")]) and got["bad.json"].c is None
    rows = d.select(F.regexp_extract("path", r"(\w+)\.json$", 1).alias("book_stem"), "content")
    who = spark.createDataFrame([("m", "Physics", None, "11"), ("bad", "Art", "1", "9")], "book_stem string, subject string, part string, class_number string")
    out = {r.book_stem: r.content for r in documents.with_identity(rows, who).collect()}
    assert json.loads(out["m"]) == doc | {"subject": "Physics", "part": None, "class_number": "11"} and out["bad"] == '{"subject": "cut'
    assert type(json.loads(out["m"])["s"]) is str and type(json.loads(out["m"])["n"]) is int
    kept = documents.with_identity(rows, who.limit(0)).where("book_stem = 'm'").first().content
    assert json.loads(kept) == doc


def test_manifests_are_repaired_or_say_why(spark):
    sound = {"subject": "Art", "class_number": "9", "pages": []}
    manifests = {"ok": sound, "roman": sound | {"class_number": "IX", "keep": [1]}, "away": {"subject": None, "class_number": "9"}, "words": {"subject": "unknown", "class_number": "9"}, "bare": {"subject": "none", "class_number": "x"}}
    m = spark.createDataFrame([(b, json.dumps(d)) for b, d in manifests.items()] + [("cut", '{"subject"'), ("null", None)], "book_stem string, content string")
    images = spark.createDataFrame([(b, p, f"{b}{p}") for b in ("ok", "roman", "away", "words", "cut") for p in range(7)], "book string, page int, image_b64 string")
    asked = []

    def model(prompt):
        shown = json.loads(prompt)["images"]
        assert len(shown) == 5 and not asked
        if shown[0] == "away0":
            raise RuntimeError("gone")
        return "no idea {}" if shown[0] == "words0" else '```json\n{"subject": "Maths", "part": "II", "class_number": "x"}\n```'

    out = repair.validated(m, images, lambda: model, "what?")
    got = {r.book_stem: r for r in out.collect()}
    assert {b: r.status for b, r in got.items()} == {"ok": "ok", "roman": "patched", "away": "error", "words": "error", "bare": "no_pdfs", "cut": "error", "null": "error"}
    assert json.loads(got["roman"].content) == manifests["roman"] | {"subject": "Maths", "part": "2", "class_number": "10"} and json.loads(got["away"].content) == manifests["away"]
    assert got["away"].error == "gone" and got["words"].error == "No JSON found in response: no idea {}" and got["cut"].error == "manifest is not JSON" and got["ok"].error is None
    report = {r.book_stem: json.loads(r.report) for r in repair.reports(out).collect()}
    assert report["roman"] == {"book": "roman", "status": "patched", "patched": True, "subject": "Maths", "part": "2", "class_number": "10", "pages": 0, "error": None}


def test_one_books_failure_is_its_own(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0), ("c", 5)], "book string, n int")

    def work(rows):
        if rows.n.sum() == 0:
            return None
        return {"mean": 10 / int(5 - rows.n.sum())}

    got = {r.book: (r.status, r.result, r.error) for r in repair.isolated(df, "book", work).collect()}
    assert got == {"a": ("success", '{"mean": 5.0}', None), "b": ("skipped", None, None), "c": ("error", None, "ZeroDivisionError: division by zero")}
    for name in ("chunks", "images"):
        spark.createDataFrame([("a/b", 1), ("c", 2)], "book_stem string, n int").write.partitionBy("book_stem").parquet(f"{tmp_path}/{name}")
    assert repair.cleared(spark, str(tmp_path), ["a/b", "none"]) == ["chunks/book_stem=a%2Fb", "images/book_stem=a%2Fb"]
    assert [r.n for r in spark.read.parquet(f"{tmp_path}/chunks").collect()] == [2] and repair.cleared(spark, f"{tmp_path}/none", ["c"]) == []


def book(root, name, texts):
    at = root / name / "txts"
    at.mkdir(parents=True)
    for n, t in texts.items():
        (at / f"page_{n:04d}.txt").write_text(t, encoding="utf-8")


def parts_of(data):
    """A stand-in for a PDF reader."""
    return data.decode().split("|")


def test_pages_as_a_source(spark, tmp_path, plan_of):
    pages.register(spark)
    for name in ("a", "b", "ü c"):
        book(tmp_path, name, {1: f"{name} one", 2: "two", 10: "ten"})
    (tmp_path / "a" / "txts" / "notes.txt").write_text("no page")
    (tmp_path / "empty").mkdir()
    (tmp_path / "a" / "whole.pdf").write_bytes(b"first|second|third")
    df = lambda: pages.load(spark, str(tmp_path))
    assert sorted((r.book_stem, r.page_number, r.text) for r in df().collect()) == [(b, p, t) for b in ("a", "b", "ü c") for p, t in ((1, f"{b} one"), (2, "two"), (10, "ten"))]
    assert df().rdd.getNumPartitions() == 4
    one = df().where("book_stem = 'ü c' and page_number > 1 and page_number <= 9 and text like 't%'")
    assert [tuple(r) for r in one.collect()] == [("ü c", 2, "two")] and one.rdd.getNumPartitions() == 1
    left = plan_of(one).split("BatchScan")[0]
    assert "StartsWith" in left and "ü c" not in left and not re.search(r"page_number#\d+ [<>]", left)  # what the source took, Spark doesn't test again
    assert df().where("book_stem in ('a', 'zz') and page_number = 10").select("text").collect()[0].text == "ten"
    assert df().where("page_number < 2 or text = 'ten'").count() == 6 and df().where("book_stem = 'none'").count() == 0
    r = pages.PageReader({"path": str(tmp_path), "splitter": f"{__name__}:parts_of"})
    assert [x for p in r.partitions() for x in r.read(p)] == [("a", 1, "first"), ("a", 2, "second"), ("a", 3, "third")]


def test_new_books_come_as_a_stream(spark, tmp_path):
    pages.register(spark)
    root, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    book(root, "a", {1: "one"})

    def run():
        q = spark.readStream.format("folio_pages").load(str(root)).writeStream.format("parquet").option("checkpointLocation", at).start(out)
        q.processAllAvailable()
        q.stop()
        return sorted((r.book_stem, r.page_number) for r in spark.read.parquet(out).collect())

    assert run() == [("a", 1)]
    book(root, "b", {1: "x", 2: "y"})
    assert run() == [("a", 1), ("b", 1), ("b", 2)] == run()


def test_texts_are_embedded_once(spark, tmp_path):
    src, out, at, log = (str(tmp_path / x) for x in ("in", "out", "at", "asked"))

    def make():
        def model(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    def run(rows, keep=3_600_000, where=at, out=out):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, text string").parquet(src)
        with settings(spark, embedding.ENDS):
            embedding.embedded(stream, "m", make, 5, keep).writeStream.format("parquet").option("checkpointLocation", where).trigger(availableNow=True).start(out).awaitTermination()
        asked = open(log).read().split("\n")[:-1]
        return sorted(asked), sorted(int(r.id) for r in spark.read.parquet(out).collect())

    assert run([(1, "a text"), (2, " a text "), (3, "abc"), (4, None), (5, "other text")]) == (["a text", "other text"], [1, 2, 5])
    asked, ids = run([(6, "a text"), (1, "a text"), (7, "third text")])  # from the checkpoint: late and repeated rows
    assert (asked, ids) == (["a text", "other text", "third text"], [1, 1, 2, 5, 6, 7])
    v = spark.read.parquet(out).where("id = 7").first().embedding
    assert abs(sum(x * x for x in v) - 1) < 1e-6
    again = str(tmp_path / "again")
    n = len(run([(8, "fourth text")], 1000, again, f"{out}2")[0])
    time.sleep(2)
    assert len(run([(9, "fourth text")], 1000, again, f"{out}2")[0]) == n + 1 == 8  # its time was over


def test_texts_images_and_names_that_are_missing(spark):
    df = spark.createDataFrame([(1, "own", "read", None), (2, " \n", "read", None), (3, None, None, "no engine"), (4, "", None, None)], "n int, native string, ocr string, failure string")
    said = {r.n: r.t for r in df.select("n", tables.text_or_ocr(F.col("native"), F.col("ocr"), F.col("failure")).alias("t")).collect()}
    assert said == {1: "own", 2: "read", 3: "[OCR failed: no engine]", 4: None}
    have = spark.createDataFrame([("a", 1, "kept"), ("a", 3, "")], "book_stem string, page_number int, text string")
    every = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "book_stem string, page_number int, native string")
    assert sorted(tuple(r) for r in tables.completed(have, every, F.upper("native")).collect()) == [("a", 1, "kept", False), ("a", 2, "Y", True), ("a", 3, "", False), ("b", 1, "Z", True)]
    blocks = spark.createDataFrame([("a", 1, 0, "image", "images/x.jpg", ["c"]), ("a", 1, 1, "image", "images/y.jpg", []), ("a", 1, 2, "text", None, None)], "book_stem string, page_number int, pos int, type string, img_path string, image_caption array<string>")
    files = spark.createDataFrame([("a", "mineru_output/a/txt/images/x.jpg")] * 2, "book_stem string, path string")
    assert [(r.image_path, r.caption, r.image_seq) for r in tables.images_of_blocks(blocks, files).orderBy("pos").collect()] == [("mineru_output/a/txt/images/x.jpg", "c", 1), ("images/y.jpg", None, 2)]
    toc = spark.createDataFrame([("a", " Motion ", 1, ["1.1"]), ("a", "Motion", 2, ["2.1", "2.2"]), ("b", "Light", 1, ["9"])], "book string, chapter_name string, pos int, topics array<string>")
    chapters = spark.createDataFrame([("a", "Motion  "), ("a", "Light"), ("a", None)], "book string, chapter_name string")
    assert {r.chapter_name: r.topics for r in chunk.topics_by_name(chapters, toc).collect()} == {"Motion  ": ["2.1", "2.2"], "Light": None, None: None}
    images = spark.createDataFrame([("1", "a", "img/p.PNG", bytearray(b"db")), ("2", "a", "img/q.png", None), ("3", "a", None, None), ("4", "a", "img/r.gif", bytearray(b""))], "image_id string, book_stem string, image_path string, image_data binary")
    there = spark.createDataFrame([("a", "/w/a/img/q.png", bytearray(b"file")), ("a", "/w/a/img/p.PNG", bytearray(b"old"))], "book_stem string, path string, content binary")
    asked = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("9",), ("1",)], "image_id string")
    got = {r.image_id: (r.status, r.media_type, r.image_data) for r in knowledge.image_response(images, asked, there).collect()}
    assert got == {"1": (200, "image/png", b"db"), "2": (200, "image/png", b"file"), "3": (404, None, None), "4": (404, None, None), "9": (404, None, None)}
    assert {r.image_id: r.status for r in knowledge.image_response(images, asked).collect()}["2"] == 404
