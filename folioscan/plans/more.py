"""More of the catalogue: sources, resumption, images, summaries, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import adapters, align, checks, chunk, knowledge, layout, store
from folioscan.plans import books
from folioscan.plans.queries import _CK, _FIG, _dot, _images, _label_scores, query
from folioscan.plans.standins import Inputs
from folioscan.sources import tables
from folioscan.streaming import incremental


@query("""select cast(p_partkey % 40 as int) as book_stem, cast(p_partkey % 5 + 1 as int) as page_number, cast(row_number() over (partition by p_partkey % 40, p_partkey % 5 order by p_partkey) as int) as image_seq, concat('i', p_partkey) as image_path,
    case when p_partkey % 3 > 0 then concat('Figure ', p_size) end as caption from part where p_partkey % 2 = 0""")
def image_scan(t: Inputs) -> DataFrame:
    """Images out of block lists in JSON."""
    one = F.concat(F.lit('{"type": "'), F.when(F.col("p_partkey") % 2 == 0, "image").otherwise("text"), F.lit('", "page_idx": '), F.col("p_partkey") % 5, F.lit(', "img_path": "i'), "p_partkey", F.lit('", "image_caption": ['), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit('"Figure '), "p_size", F.lit('"'))).otherwise(""), F.lit("]}"))
    ordered = F.array_sort(F.collect_list(F.struct("p_partkey", one.alias("b"))))
    docs = t("part").groupBy((F.col("p_partkey") % 40).cast("int").alias("book_stem")).agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["b"]), ","), F.lit("]")).alias("content"))
    return tables.images_of_blocks(tables.blocks_of_json(docs)).select("book_stem", "page_number", "image_seq", "image_path", "caption")


_SAID = "case when cast(image_id as int) % 6 = 1 then concat('seen in Fig. ', page % 5 + 1, '.', page % 9, ' here') when cast(image_id as int) % 6 = 2 then concat('Fig.', page % 5 + 1, '.', page % 9) else caption end"


@query(f"""with i as (select book, page, image_id, row_number() over (partition by book, page order by image_id) as image_seq, regexp_extract({_SAID}, '(?i)\\b(?:FIGURE|Figure|Fig\\.?)\\s+(\\d+\\.\\d+)', 1) as said from im),
    tc as (select distinct book, topic, chapter from tp)
    select i.book, i.page, cast(image_seq as int) as image_seq, nullif(said, '') as fig, case when tc.topic is not null then said else concat('t', i.page % 4) end as topic, coalesce(cast(tc.chapter as string), cast(i.page % 3 as string)) as chapter
    from i left join tc on tc.book = i.book and tc.topic = said and tc.chapter = try_cast(split_part(said, '.', 1) as int)""")
def image_index(t: Inputs) -> DataFrame:
    """Numbers anywhere in captions, with a space; those without one are none."""
    i = t("im").selectExpr("book", "page", f"{_SAID} as caption", "cast(row_number() over (partition by book, page order by image_id) as int) as image_seq")
    topics = t("im").select("book", "page").distinct().withColumns({"topic": F.concat(F.lit("t"), F.col("page") % 4), "chapter": (F.col("page") % 3).cast("string")})
    return layout.image_index(i, topics, t("tp").select("book", "topic", F.col("chapter").cast("string").alias("chapter"))).select("book", "page", "image_seq", "fig", "topic", "chapter")


@query(f"with {_CK}, k as (select ck.book, chunk_id, image_id from ck join im on im.book = ck.book and im.page between page_start and page_end), c as (select book, count(*) as total_chunks from ck group by book), n as (select book, count(*) as total_images from im group by book), l as (select book, count(*) as links from k group by book) select c.book, total_chunks, coalesce(total_images, 0) as total_images, coalesce(links, 0) as links from c left join n on n.book = c.book left join l on l.book = c.book")
def knowledge_base(t: Inputs) -> DataFrame:
    c = t("pg").select("book", F.col("doc_id").cast("string").alias("chunk_id"), F.col("page").alias("page_start"), (F.col("page") + (F.col("doc_id") % 3).cast("int")).alias("page_end"), F.col("text").alias("content"))
    k = knowledge.knowledge_base(c, t("im").select("book", "image_id", "page"))
    links = F.aggregate("chunks", F.lit(0).cast("long"), lambda s, x: s + F.size(x["image_refs"]))
    return k.select("book", "total_chunks", "total_images", links.alias("links"))


@query("select source as book_stem, case when min(doc_id) % 3 = 0 then 'new' when min(doc_id) % 3 = 1 then 'partial' else 'done' end as state from documents group by source")
def resume_states(t: Inputs) -> DataFrame:
    b = t("documents").groupBy(F.col("source").alias("book_stem")).agg(F.min("doc_id").alias("d"))
    m = b.where("d % 3 > 0").select(F.concat(F.lit("out_"), "book_stem").alias("folder"), F.concat(F.lit("in/"), "book_stem", F.lit(".pdf")).alias("source_pdf"))
    return tables.resume_state(b, tables.first_output(m), b.where("d % 3 = 2").select("book_stem"))


@query("select book, page, substring(text, 1, 200) as text_preview from pg where page <= 5")
def page_previews(t: Inputs) -> DataFrame:
    return tables.preview(t("pg"))


@query("select doc_id, base64(encode(text)) as image_b64 from documents")
def page_base64(t: Inputs) -> DataFrame:
    d = t("documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return tables.page_images(d).withColumnRenamed("path", "doc_id")


@query("""select image_id, case when fig is not null or page % 5 = 1 then 200 else 404 end as status, case when fig is null and page % 5 <> 1 then null when page % 2 = 0 then 'image/png' else 'image/jpeg' end as media_type,
    coalesce(fig, case when page % 5 = 1 then concat('file ', image_id) end) as data from (select image_id, page, nullif(regexp_extract(caption, '(?i)figure (\\d+)', 1), '') as fig from im) where cast(image_id as int) % 50 = 0
    union all select concat('none', p_partkey), 404, null, null from part where p_partkey % 50 = 0""")
def image_response(t: Inputs) -> DataFrame:
    """Every fiftieth image, and as many that are not there: stored bytes, else those of a file."""
    i = t("im").select("image_id", F.col("book").alias("book_stem"), F.concat(F.lit("img/p"), "image_id", F.when(F.col("page") % 2 == 0, ".PNG").otherwise(".jpg")).alias("image_path"), T.falsy(F.regexp_extract("caption", r"(?i)figure (\d+)", 1)).cast("binary").alias("image_data"), "page")
    files = i.where("page % 5 = 1").select("book_stem", F.concat(F.lit("/in/"), "book_stem", F.lit("/"), "image_path").alias("path"), F.concat(F.lit("file "), "image_id").cast("binary").alias("content"))
    fifty = t("part").where("p_partkey % 50 = 0")
    asked = fifty.select(F.col("p_partkey").cast("string").alias("image_id")).union(fifty.select(F.concat(F.lit("none"), "p_partkey")))
    return knowledge.image_response(i.drop("page"), asked, files).select("image_id", "status", "media_type", F.col("image_data").cast("string").alias("data"))


@query("""with n as (select book, cast(count(*) as int) as total from pg group by book) select im.book, image_id, caption is not null as has_data from im join n on n.book = im.book where page between 5 and total""")
def image_listing(t: Inputs) -> DataFrame:
    """Presence without the bytes, in a page range of each book."""
    n = t("pg").groupBy("book").agg(F.count(F.lit(1)).cast("int").alias("total"))
    return t("im").join(n, "book").where(F.col("page").between(F.lit(5), F.col("total"))).select("book", "image_id", F.col("caption").isNotNull().alias("has_data"))


@query("select book, subject from mf where contains(lower(subject), 'ring')")
def books_by_subject(t: Inputs) -> DataFrame:
    return t("mf").where(F.contains(F.lower("subject"), F.lit("ring"))).select("book", "subject")


@query("select book, chapter, case when regexp_full_match(n, '[0-9]+') then concat('Chapter ', n, ' ', name) else concat('CHAPTER ', n, ' ', name) end as q from (select book, chapter, case when chapter % 3 = 0 then 'iv' else cast(chapter as string) end as n, case when chapter = 1 then 'Preface' when chapter = 2 then '' else name end as name from ch) where chapter > 2")
def chapter_queries(t: Inputs) -> DataFrame:
    """Front matter and nameless chapters are left out; digits and others read differently."""
    number = F.when(F.col("chapter") % 3 == 0, "iv").otherwise(F.col("chapter").cast("string"))
    name = F.when(F.col("chapter") == 1, "Preface").when(F.col("chapter") == 2, "").otherwise(F.col("name"))
    c = t("ch").select("book", "chapter", number.alias("number"), name.alias("title"))
    return c.where(align.alignable(F.col("title"))).select("book", "chapter", align.query_text(F.col("number"), F.col("title")).alias("q"))


@query(f"""with s as (select concat('b', e.label) as book, e.vec_id as page, {_dot('e.embedding', 'q.embedding')} as score from embeddings e join (select label, min_by(embedding, vec_id) as embedding from embeddings group by label) q on e.label = q.label),
    x as (select concat('b', label) as book, vec_id as page from embeddings where vec_id % 9 = 0), r as (select s.*, row_number() over (partition by s.book order by s.score desc, s.page) as rn from s where not exists (select 1 from x where x.book = s.book and x.page = s.page))
    select x.book, x.page, round(s.score, 9) as score, 'text' as found_by from x left join s on x.book = s.book and x.page = s.page union all select book, page, round(score, 9), 'vector' from r where rn <= 5""")
def text_and_vector_hits(t: Inputs) -> DataFrame:
    s = _label_scores(t).select(F.concat(F.lit("b"), "label").alias("book"), F.col("vec_id").alias("page"), "score")
    return knowledge.merge_scores(s.where("page % 9 = 0").select("book", "page"), s).select("book", "page", F.round("score", 9).alias("score"), "found_by")


@query("select image_id, min(s) as source from (select image_id, 1 as s from im where page % 3 < 2 union all select image_id, 2 as s from im where page % 3 > 0) group by image_id")
def image_union(t: Inputs) -> DataFrame:
    """Union by id: the first source of each image counts."""
    i = t("im")
    both = i.where("page % 3 < 2").withColumn("source", F.lit(1)).unionByName(i.where("page % 3 > 0").withColumn("source", F.lit(2)))
    return both.groupBy("image_id").agg(F.min("source").alias("source"))


@query("(select distinct book, page, 'missing' as kind from pg except select distinct book, page, 'missing' from im) union all (select distinct book, page, 'extra' as kind from im except select distinct book, page, 'extra' from pg)")
def page_set_difference(t: Inputs) -> DataFrame:
    want, have = t("pg").select("book", "page").distinct(), t("im").select("book", "page").distinct()
    return want.exceptAll(have).withColumn("kind", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("kind", F.lit("extra")))


@query("select event_type as mapping_method, count(*) as n from events group by event_type")
def method_histogram(t: Inputs) -> DataFrame:
    return t("events").groupBy(F.col("event_type").alias("mapping_method")).agg(F.count(F.lit(1)).alias("n"))


@query("select book, count(*) as chunks, cast(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) as bigint) as words, cast(sum(len(regexp_extract_all(text, '\\$\\$'))) as bigint) as marks from pg group by book")
def chunk_totals(t: Inputs) -> DataFrame:
    return t("pg").groupBy("book").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.size(T.words(F.col("text")))).alias("words"), F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\$\$"), F.lit(0)))).alias("marks"))


@query("select doc_id, doc_id % 10 < 7 as cached from documents")
def cached_embeddings(t: Inputs) -> DataFrame:
    """Texts whose vector was cached within seven days, and those left to embed."""
    d = t("documents").withColumn("cache_key", T.cache_key("m1", F.concat("doc_id", F.lit(":"), "text")))
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    age = F.when(F.col("doc_id") % 10 < 7, F.col("doc_id") % 10).otherwise(9)
    cache = d.select("cache_key", (now - F.make_dt_interval(age.cast("int"))).alias("cached_at"), F.array(F.lit(1.0)).alias("embedding"))
    fresh = store.fresh_cache(cache, now)
    hit = adapters.cached_vectors(d, fresh).select("doc_id", F.lit(True).alias("cached"))
    return hit.unionByName(adapters.missing_vectors(d, fresh).select("doc_id", F.lit(False).alias("cached")))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k, 2 as frames from events")
def event_frames(t: Inputs) -> DataFrame:
    f = incremental.frames(F.concat(F.lit("data: "), "props", F.lit("\n\ndata: {\"done\": true}\n\n")))
    return t("events").select("event_id", F.get_json_object(f[0], "$.k").cast("int").alias("k"), F.size(f).alias("frames"))


@query("select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n from events group by all")
def events_by_day(t: Inputs) -> DataFrame:
    e = incremental.event_time(t("events"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")


@query("select conv_id, cast(count(*) as bigint) as turns, string_agg(role, ',' order by turn) as roles from conversations group by conv_id")
def chapter_groups(t: Inputs) -> DataFrame:
    """Rows of a group as one ordered list."""
    g = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(g, lambda x: x["role"]), ",").alias("roles"))


@query("select book, status, count(*) as n from (select book, case when page % 9 = 0 then 'error' when length(text) < 200 then 'skipped' else 'success' end as status from pg) group by all")
def per_book_status(t: Inputs) -> DataFrame:
    """What a run over all books reports: a status per row instead of a failed job."""
    s = F.when(F.col("page") % 9 == 0, "error").when(F.length("text") < 200, "skipped").otherwise("success")
    return checks.rollup(t("pg").withColumn("status", s), ["book"]).selectExpr("book", "stack(3, 'success', success, 'skipped', skipped, 'error', error) as (status, n)").where("n > 0")


@query("select count(*) as bad from embeddings where len(embedding) <> 64")
def vector_dimension(t: Inputs) -> DataFrame:
    return store.check_dimension(t("embeddings"), 64).agg(F.count(F.lit(1)).alias("bad"))


@query(f"select image_id, fig_number, page from (select image_id, page, nullif(regexp_extract(caption, '{_FIG}', 1), '') as fig_number from im) where cast(image_id as int) % 50 = 0")
def images_by_id(t: Inputs) -> DataFrame:
    return _images(t).where(F.col("image_id").cast("int") % 50 == 0).select("image_id", "fig_number", "page")


@query("select q, count(*) as hits, count(distinct book) as books, min(rank) as best from ht group by q")
def hit_summary(t: Inputs) -> DataFrame:
    return t("ht").groupBy("q").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("book").alias("books"), F.min("rank").alias("best"))




@query("""with t as (select book, chapter, trim(case when chapter % 6 = 5 then 'Part x' when chapter % 2 = 0 then concat(' Part ', chapter, ' ') else concat('Part ', chapter) end) as name, count(*) as n, max(pos) as pos from tp group by book, chapter),
    l as (select book, name, max_by(n, chapter) as n from t group by book, name) select ch.book, ch.chapter, cast(l.n as int) as topics from ch left join l on l.book = ch.book and l.name = case when ch.chapter % 6 = 5 then 'Part x' else concat('Part ', ch.chapter) end""")
def topics_by_name(t: Inputs) -> DataFrame:
    """Topics of chapters that only share a name with the contents, with spaces around it and repeated."""
    n = F.col("chapter")
    name = lambda pad: F.when(n % 6 == 5, "Part x").otherwise(F.concat(F.when(n % 2 == 0, pad).otherwise(""), F.lit("Part "), n.cast("string"), F.when(n % 2 == 0, pad).otherwise("")))
    toc = t("tp").groupBy("book", "chapter").agg(F.collect_list("topic").alias("topics")).select("book", name(" ").alias("chapter_name"), n.alias("pos"), "topics")
    return chunk.topics_by_name(t("ch").select("book", "chapter", name("").alias("chapter_name")), toc).select("book", "chapter", F.when(F.col("topics").isNotNull(), F.size("topics")).alias("topics"))


@query("select book as book_stem, page as page_number, md5(case when doc_id % 7 = 0 then concat('again: ', text) else text end) as text_md5, doc_id % 7 = 0 as extracted from pg")
def resumed_pages(t: Inputs) -> DataFrame:
    """A resumed book: every seventh page lacks its text and is extracted (here: with a mark), the others are not touched."""
    p = t("pg").select(F.col("book").alias("book_stem"), F.col("page").alias("page_number"), "doc_id", F.col("text").alias("native"))
    texts = p.where("doc_id % 7 <> 0").select("book_stem", "page_number", F.col("native").alias("text"))
    out = tables.completed(texts, p, F.concat(F.lit("again: "), "native"))
    return out.select("book_stem", "page_number", F.md5(F.col("text").cast("binary")).alias("text_md5"), "extracted")


@query()
def two_phase_books(t: Inputs) -> DataFrame:
    """Conversations as layout blocks of books: pages, contents pages and images first, then chunks, knowledge
    bases and chapter files of all books at once."""
    b = t("conversations").selectExpr("cast(conv_id as string) as book_stem", "cast(turn as int) as pos", "cast(floor(turn / 3.0) as int) + 1 as page_number", "case when turn % 5 = 4 then 'image' else 'text' end as type",
        "case when turn % 4 = 1 then 2 end as text_level", "case when turn = 0 then 'Contents' when turn % 4 = 1 then concat('1.', cast(floor(turn / 4.0) as int) + 1, ' Heading') else text end as text", "concat('i', turn) as img_path", "array(concat('Figure ', turn)) as image_caption", "cast(null as string) as code_body")
    toc = b.select(F.col("book_stem").alias("book")).distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(8)))).select("book", F.lit("1").alias("chapter"), F.lit("Talk of all things").alias("chapter_name"), F.concat(F.lit("1."), "n").alias("topic"), F.concat(F.lit("Heading "), "n").alias("topic_name"))
    pages, contents, images = books.extracted(b, ["CONTENTS"])
    chunks, base, files = books.chunked(b, toc, contents.where("page < 1"), images)
    n = base.select("book", "total_chunks", "total_images")
    return n.join(files.select("book", "chapter_file"), "book", "left")
