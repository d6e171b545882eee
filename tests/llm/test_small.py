"""Defined results on small and odd tables: nulls, empties, ties, repeats, clashing names."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.llm import bm25, chat, components, decontam, fingerprint, jaccard, langid, merkle, negatives, packing, quality, sharding, textscan, urlfilter, warc

VOCAB = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
RANKS = VOCAB[1:]
DOCS = "doc_id long, text string, lang string, source string, score double, shard int, cls long"
LONG = "lorem ipsum dolor sit amet " * 20_000
TEXTS = [None, "", "   \n", "A short one.", "A short one.", "Ünïcode «quotes» 日本語 \U0001f600 <|endoftext|> end", LONG, "A short one. ", "!!! 123"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, None, 0.5, 7, 1) for i, t in enumerate(TEXTS)] + [(3, "A short one.", "en", "x", None, None, None), (None, "no id", None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- op1


def test_sharding(docs, empty):
    out = sharding.shard(docs, 4).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None:
            t = TEXTS[r.doc_id] or ""
            assert (r.size, r.text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard(empty, 4).count() == 0


def test_shards_are_near_equal_and_maps_keep_versions(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "x" * rng.randint(0, 3000)) for i in range(5000)], "doc_id long, text string")
    at = str(tmp_path / "map")
    size, _ = sharding.slot_stats(sharding.with_slots(df))
    sharding.save_map(spark, at, 0, sharding.first_map(7), [0] * sharding.N_SLOTS)
    load = Counter()
    for r in sharding.shard(df, 7, map_path=at).collect():
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= 0.001 * sum(load.values()) / 7
    old, new = sharding.load_map(spark, at, 0)[1], sharding.load_map(spark, at)
    assert new[0] == 1 and old == sharding.first_map(7) and sum(a != b for a, b in zip(old, new[1])) < 2000
    grown = sharding.rebalanced(new[1], size, 8)
    assert set(grown) == set(range(8)) and sum(a != b for a, b in zip(new[1], grown)) < sharding.N_SLOTS / 4


# ---- op2


def test_language_edges(docs, empty):
    model = langid.fit(docs)
    out = {r.doc_id: r for r in langid.identify(docs, model).collect() if r.doc_id is not None}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 2, 8))
    assert out[3].lang_pred == "en" and 0 <= out[3].score <= 1
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    same = docs.limit(0).unionByName(docs.sparkSession.createDataFrame([(4, "All one text.", "xx", None, None, None, None)] * 500 + [(8, "Other words here", "en", None, None, None, None)], DOCS))
    assert langid.fit(same).families.keys() <= {"germanic", "xx"} and langid.spoken(same, langid.fit(same)).count() == 501
    assert langid.spoken(docs, langid.fit(empty)).columns == docs.columns
    assert sorted(str(r.doc_id) for r in langid.spoken(docs, langid.fit(empty)).collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in (0, 1, 2, 8))
    many = docs.sparkSession.range(1000).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id) as lang")
    with pytest.raises(ValueError):
        langid.fit(many)
    few = langid.fit(many.selectExpr("doc_id", "text", "concat('l', doc_id % 30) as lang"))
    assert len(few.families) == 30
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(empty)).collect()} == {"und"}


def test_languages_are_told_apart(spark):
    parts = {"de": ["ung", "sch", "keit", "ein", "der"], "en": ["the", "ing", "tion", "wh", "ed"], "fr": ["eau", "oi", "que", "aux", "le"], "es": ["ción", "os", "ar", "el", "ado"]}
    rng = random.Random(2)
    say = lambda l: " ".join("".join(rng.choices(parts[l], k=rng.randint(1, 3))) for _ in range(60))
    rows = [(i, say(l), l) for i in range(200) for l in [list(parts)[i % 4]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert list(model.families) == ["germanic", "romance"] and model.pairs == [("de", "en"), ("es", "fr")]
    out = {r.doc_id: r.lang_pred for r in langid.identify(df.select("doc_id", "text"), model).where("held_out").collect()}
    assert out and all(out[i] == l for i, _, l in rows if i in out)


# ---- op3


def distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        cur = [i + 1]
        for j, x in enumerate(t):
            cur.append(min(prev[j] + (c != x), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_myers_against_table():
    rng = random.Random(3)
    for _ in range(200):
        p, t = (bytes(rng.choices(b"abc", k=rng.randint(a, 80))) for a in (1, 0))
        assert decontam.myers(p, t)[0] == distance(p, t)


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(12)] + [(50, "tiny"), (51, None), (52, ""), (53, "q"), (54, "two words!"), (55, "?!"), (56, "The quick brown fox")]
    texts = ["A tiny.", "tinyer", "Two-words", "two wordsy", "q", "qq", "so the quick browm foxx ran", "the quik brwn foxx"]
    for i in range(112):
        t = " ".join(word() for _ in range(rng.randint(0, 60)))
        if i % 3 == 0:
            b = list(items[i % 12][1])
            for _ in range(rng.randint(0, 14)):
                k = rng.randrange(len(b))
                b[k] = rng.choice(["", "x", b[k].upper(), b[k] + "y", "-" if b[k] == " " else b[k]])
            t = f"{t}. {''.join(b)}, {t}"
        texts.append(t)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(df, bench).collect()}
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()).encode()
    want = {}
    for j, it in items:
        p = norm(it or "")
        k = int(decontam.ERROR_RATE * len(p))
        for i, t in enumerate(texts):
            if not k:
                if p and b" " + p + b" " in b" " + norm(t) + b" ":
                    want[i, j] = 0
            elif (d := distance(p, b" " + norm(t) + b" ")) <= k:
                want[i, j] = d
    assert {(0, 50), (2, 54), (4, 53), (6, 56)} <= set(want) and (7, 56) not in want and not any(i in (1, 3, 5) for i, _ in want)
    assert set(got) == set(want) and len(want) > 15
    assert all(got[k] >= want[k] for k in want) and sum(got[k] != want[k] for k in want) <= 2
    kept = {r.doc_id for r in decontam.without_leaks(df, bench).collect()}
    assert kept == set(range(122)) - {i for i, _ in want}


def test_leaks_in_blocks_and_empties(spark, docs, empty, monkeypatch):
    bench = spark.createDataFrame([(i, f"item number {i} about lorem ipsum dolor sit amet {i}") for i in range(6)] + [(9, "lorem ipsum dolor sit amet lorem ipsum")], "item_id long, text string")
    whole = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", ("item_id", "text", 300))
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect())) == whole and (6, 9) in [w[:2] for w in whole]
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id != 6)
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


# ---- op4


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "[\\INST]", "<\\\\s>", "<<SYS>>", "<<<SYS>>", "a\\", "[[INST]", "<s><s>", "plain \U0001f600"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_chat_digests(spark):
    talk = [(1, 0, "system", "be kind"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "tool", None), (2, 0, None, "x"), (None, 1, "user", "y"), (3, 5, "user", LONG), (3, 6, "assistant", LONG), (1, 4, "assistant", "é日")]
    df = spark.createDataFrame([(*t, 1) for t in talk], "conv_id long, turn long, role string, text string, ids int")
    f = chat.format_turns(df, *RANKS)
    got = {r.conv_id: r for r in chat.digests(f, *RANKS).collect()}
    codec = chat.Codec(*RANKS)
    for conv in (1, 2, 3, None):
        turns = [(r or "", t or "") for c, _, r, t in sorted((x for x in talk if x[0] == conv), key=lambda x: x[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "<s>" + "".join("".join(c or chat.escape(x) for c, x, _ in codec.segments(r, t)) for r, t in turns)
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256, g.formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(said))
    for r in f.collect():
        ids, mask = np.frombuffer(r.ids, np.uint32), np.frombuffer(r.mask, np.int8)
        assert len(ids) == len(mask) and (mask.any() == (r.role == "assistant"))
        assert not ((ids >= codec.base) & (mask == 1)).any()
    assert chat.digests(chat.format_turns(df.limit(0), *RANKS), *RANKS).count() == 0


# ---- op5


def brute_components(rows, width, percent):
    import re

    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width, percent, cold, warm", [(3, 90, 16, 48), (5, 80, 2, 3), (2, 70, 1, 1)])
def test_components_against_brute_force(spark, monkeypatch, width, percent, cold, warm):
    for name, value in (("COLD", cold), ("WARM", warm), ("BLOCK_BYTES", 20_000), ("STREAM_SHINGLES", 3000), ("STREAMS_A_TASK", 3), ("SEND_KEYS", 2000), ("MERGE_ROWS", 500)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(width * percent)
    word = lambda: "".join(rng.choices("abcdefghij", k=3))
    passage = [word() for _ in range(55)]
    rows = []
    for g in range(30):
        base = [word() for _ in range(rng.choice([1, 2, 4, 6, 12, 30, 80, 200, 400]))]
        if g % 3 == 0:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5, 24, 60])):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // rng.choice([50, 20]))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [word()], [w[k].upper()], [w[k], word()]])
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t"), (len(rows) + 3, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, key int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df, width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_keys_meet_for_all_linked_sets():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(rng.integers(2, 400))
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        d = jaccard.max_difference(len(s), len(s), 80) // 2
        drop = rng.permutation(len(s))[: int(rng.integers(0, d + 1))]
        t = np.unique(np.concatenate([np.delete(s, drop), rng.integers(0, 1 << 63, int(rng.integers(0, d + 1)), dtype=np.uint64)]))
        if len(t) and not np.array_equal(s, t) and jaccard.linked(s, t, 80):
            (a, x), (b, y) = jaccard.keys_of(s, 80), jaccard.keys_of(t, 80)
            assert (x >> 32, y >> 32) == (len(s), len(t))
            shared = [int(k) for k in np.intersect1d(a, b)]
            groups = lambda odd: len({k & 1023 for k in shared if k >> 10 & 1 == odd})
            needed = lambda odd: max(z >> (0 if odd else 16) & 0xFFFF for z in (x, y))
            assert any(needed(odd) and groups(odd) >= needed(odd) for odd in (0, 1))


def test_keys_are_exchanged_one_parity_at_a_time(spark, monkeypatch):
    """The pipeline's join stage held the keys of both bands of every set at once."""
    held = []

    class Watched(jaccard.Scratch):
        def written(self, df, name="table", *batch):
            out = super().written(df, name, *batch)
            self.tables[out.written_to].called = name
            if name == "keys":
                held.append((sorted({r.key >> jaccard.GROUP_BITS & 1 for r in out.select("key").collect()}), [x.called for x in self.tables.values()]))
            return out

    monkeypatch.setattr(jaccard, "Scratch", Watched)
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        w = rng.choices([f"w{i}" for i in range(900)], k=rng.choice([40, 150, 500]))
        rows += [(len(rows) + k, " ".join(w[k:])) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()}
    assert got == brute_components(rows, 5, 80)
    assert [odd for odd, _ in held] == [[0], [1]]
    assert all(names.count("keys") == 1 and "buckets" not in names and "warm" not in names for _, names in held)


def test_a_stream_of_keys_is_joined_in_little_memory():
    """A stream's keys were sorted again and again with all that had come before, in copies of seven times its table."""
    steps = []

    class Rows:
        def mapInArrow(self, f, schema):
            steps.append(f)
            return self

        def repartition(self, *_):
            return self

        sortWithinPartitions = repartition

    jaccard._shared_keys(Rows(), 5, 80, 0, 2, 2)
    rng = np.random.default_rng(2)
    own = np.unique(rng.integers(0, 1 << 40, 1_400_000, dtype=np.uint64))
    hot, names = own[:2000], ["part", "keys", "cls", "tags", "counts"]
    sent = [(stream, cls, np.concatenate([own[cls::56], hot[cls % 7 :: 7]])) for stream in (0, 1) for cls in range(56)]

    def batches():
        for stream, cls, keys in sent:
            row = (stream << 1, jaccard._wire(keys, jaccard.KEY_BYTES), np.int64(cls).tobytes(), jaccard._wire(np.array([9 << 16 | 3]), jaccard.TAG_BYTES), np.array([len(keys)], np.uint16).tobytes())
            yield pa.RecordBatch.from_pylist([dict(zip(names, row))])

    tracemalloc.start()
    try:
        got = {tuple(r) for b in steps[1](batches()) for r in zip(*(x.to_pylist() for x in b.columns))}
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    classes = defaultdict(set)
    for stream, cls, keys in sent:
        for k in keys[np.isin(keys, hot)].tolist():
            classes[stream << 40 | k].add(cls)
    assert got == {(k, c, 9 << 32 | 3 << 16) for k, cs in classes.items() if len(cs) > 1 for c in cs}
    assert most < 80 * len(own)


@pytest.mark.parametrize("odd", [0, 1])
def test_keys_of_a_parity_are_those_of_both(odd):
    s = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64))
    (both, tag), (own, part) = jaccard.keys_of(s, 80), jaccard.keys_of(s, 80, odd)
    assert np.array_equal(both[(both >> np.uint64(10) & np.uint64(1)) == odd], own) and len(own)
    assert part == tag & ~(0xFFFF << (16 if odd else 0))


def test_components_edges(docs, empty):
    got = [tuple(r) for r in jaccard.components(docs, 3, 90).collect()]
    by = {r[0]: r for r in got if r[0] is not None}
    assert len(got) == docs.count()
    assert all(by[i][1:] == (0, i) for i in (0, 1, 2)) and by[4][2] == by[7][2] == 3 and by[6][2] == 6
    assert jaccard.components(empty).count() == 0
    one = jaccard.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == [0, 1, 2, 3, 5, 6, 8] and one.where("doc_id is null").count() == 1


def test_stars(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


# ---- op6


def test_quality_learns_and_handles_edges(spark, docs, empty):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 90))) + "."
    bad = lambda: " ".join(rng.choice(["buy", "###", "$$$", "NOW!!"]) for _ in range(rng.randint(20, 90)))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(600)] + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    out = quality.score_all(df, labels).collect()
    assert len(out) == 600 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([(r.score > 0.5) == (r.doc_id % 4 != 0) for r in held]) > 0.97
    assert quality.score_all(docs, labels).count() == docs.count()
    assert {r.score for r in quality.score_all(docs, labels.limit(0)).collect()} == {0.5}
    wanted = {r.doc_id for r in out if r.score >= 0.5}
    kept = quality.kept(df.withColumn("stats", F.lit(1)).withColumn("score", F.lit("x")), labels, 0.5)
    assert kept.columns == ["doc_id", "text", "stats", "score"] and {r.doc_id for r in kept.collect()} == wanted
    assert quality.kept(empty, labels, 0.5).count() == 0 and quality.kept(docs, labels.limit(0), 0.5).count() == docs.count()
    assert quality.score_all(empty, labels).count() == 0


def test_isotonic():
    x, y = quality.pool_adjacent(np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.array([1, 1, 1, 1, 1, 2.0]))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == pytest.approx(3 / 4)


# ---- op7


def test_archive_round_trip(spark, tmp_path):
    big, small = "x" * 1000, "y" * 999
    rows = [(1, "http://a", big), (9, "http://b", big), (4, None, big), (2, "http://c", small), (3, "http://d", small), (5, "http://e\r\nX: y", None), (6, "http://f", ""), (7, "http://g", "é" * 500), (8, "http://h", "é" * 500), (8, "http://h", "é" * 500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, address int")
    at = str(tmp_path / "w")
    warc.archive(df, at)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.verified) for r in warc.read_back(spark, at).collect())
    text = {i: (t or "") for i, _, t in rows}
    assert [(g[0], g[1], g[2]) for g in got] == sorted((i, len(text[i].encode()), hashlib.sha1(text[i].encode()).hexdigest()) for i, _, _ in rows)
    assert [(g[0], g[3], g[4]) for g in got] == [(1, "revisit", 9), (2, "response", None), (3, "response", None), (4, "revisit", 9), (5, "response", None), (6, "response", None), (7, "revisit", 8), (8, "response", None), (8, "response", None), (9, "response", None)]
    assert all(g[5] for g in got)
    assert spark.read.parquet(f"{at}/blobs").count() == 4
    rec = {r.page_id: (bytes(r.record), bytes(r.payload).decode()) for r in warc.reconstruct(spark, at).collect()}
    assert all(rec[i][1] == text[i] for i in text)
    head, body = rec[2][0].split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and f"Content-Length: {999 + len(warc.HTTP)}".encode() in head and body == (warc.HTTP + small + "\r\n\r\n").encode()
    assert rec[5][0].count(b"\r\nX:") == 0 and b"http://e%0D%0AX: y\r\n" in rec[5][0]
    assert f"WARC-Profile: {warc.PROFILE}".encode() in rec[1][0] and rec[1][0].endswith((warc.HTTP + "\r\n\r\n").encode())
    ids = {i: re.search(rb"WARC-Record-ID: <urn:uuid:([0-9a-f]{8}-[0-9a-f]{4}-3[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12})>\r\n", rec[i][0])[1] for i in rec}
    assert len(set(ids.values())) == len(rec) and b"WARC-Refers-To: <urn:uuid:" + ids[9] + b">" in rec[1][0]
    blobs = spark.read.parquet(f"{at}/blobs")
    blobs.selectExpr("address", "cast(if(octet_length(payload) = 1000, concat('z', substring(cast(payload as string), 2)), cast(payload as string)) as binary) as payload").write.parquet(str(tmp_path / "bad" / "blobs"))
    spark.read.parquet(f"{at}/headers").write.parquet(str(tmp_path / "bad" / "headers"))
    assert {r.page_id for r in warc.read_back(spark, str(tmp_path / "bad")).where("not verified").collect()} == {1, 4, 7, 8, 9}
    warc.archive(df.limit(0), str(tmp_path / "e"))
    assert warc.read_back(spark, str(tmp_path / "e")).count() == 0


# ---- op8


def judged(url, rules=urlfilter.RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://ORG", "http://x.org/", "https://www.Example.ORG/es/1?x", "http://example.org/en/17#y", "http://notexample.org/es/", "http://org.evil/es/", "http://a.com/fr/1", "http://a.com/de/1", "http://a.com/de", "http://a.com?://b/de/", "ftp://com/de/x://y", "http://b.net/x\ny", "http://É.com/de/"]
    df = spark.createDataFrame([(i, u, "<html>", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    for r in urlfilter.judge(df).collect():
        host, path, rule, verdict = judged(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_aliases_take_block_decisions(spark):
    link = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
    pages = [(1, "http://a.net/1", link("http://a.com/de/1")), (2, "http://b.net/1", '<meta http-equiv="refresh" content="0; url=http://a.net/1">'), (3, "http://x.org/", link("http://a.net/1")), (4, "http://c.net/", None), (5, "http://d.net/", link("http://e.com/de/")), (6, "http://e.net/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "allow"}  # x.org/ is allowed and so its aliases
    more = spark.createDataFrame([("http://e.net/", "http://d.net/")], "src string, dst string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, redirects=more).collect()}[6] == "block"


def test_aliases_in_any_case_and_with_fragments(spark):
    link = lambda u: f'<link rel=canonical href="{u}">'
    pages = [(1, "http://a.com/de/1#top", link("HTTP://H.net/x#part")), (2, "http://h.net/x", None), (3, "http://h.net/X", ""), (4, "http://h.net/x#end", None), (4, "http://h.net/x#end", None), (5, "http://h.net/x?q#a", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = Counter((r.page_id, r.verdict) for r in urlfilter.judge(df).collect())
    assert got == {(1, "block"): 1, (2, "block"): 1, (3, "allow"): 1, (4, "block"): 2, (5, "allow"): 1}


# ---- op9


def test_packing(docs, empty):
    out = packing.pack(docs, *VOCAB).collect()
    enc = Tokenizer.from_file(VOCAB[0])
    ids = {i: [*enc.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    ids[None] = [*enc.encode("no id", add_special_tokens=False).ids, 1]
    copies = Counter(r.doc_id for r in docs.collect())
    for i, want in ids.items():
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out if r.doc_id == i)
        assert sum(m[1] for m in mine) == copies[i] * len(want) and all(m[3] == len(want) for m in mine)
        assert all(m[2] == zlib.crc32(np.array(want[m[0] : m[0] + m[1]], "<u4").tobytes()) for m in mine)
        assert sorted({(m[0], m[1]) for m in mine})[0][0] == 0
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert packing.pack(empty, *VOCAB).count() == 0


@pytest.mark.parametrize("parts", [1, 64, 211])
def test_packing_fills_windows_however_rows_are_dealt(spark, parts):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(rng.choices(["river", "town", "of", "pages", "x1"], k=rng.randint(1, 900)))) for i in range(400)], "doc_id long, text string").repartition(parts)
    out = packing.pack(df, *VOCAB).collect()
    seqs, docs_ = {}, {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs_.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for spans in (*seqs.values(), *([(a, n) for a, n, _ in d] for d in docs_.values())):
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
    total = sum(d[0][2] for d in docs_.values())
    assert all(sum(n for _, n in s) <= packing.CAPACITY for s in seqs.values()) and total == sum(r.length for r in out)
    assert len(seqs) <= -(-total // packing.CAPACITY) * 1.01 + 1


def test_differencing_is_tight():
    rng = random.Random(8)
    sizes = [rng.randint(1, 512) for _ in range(2000)]
    w = packing.windows(sizes)
    assert sorted(i for g in w for i in g) == list(range(2000)) and max(sum(sizes[i] for i in g) for g in w) <= 2048
    assert len(w) <= 1.02 * math.ceil(sum(sizes) / 2048)
    assert packing.differencing([], 3) == ([], 0) and packing.windows([2048]) == [[0]]
    sums, most = packing.differencing([8, 7, 6, 5, 4], 2)
    assert most == 16 and sorted(map(len, sums)) == [2, 3]


# ---- op10


def test_search_against_brute_force(spark, monkeypatch):
    for name, value in (("SHARD_TOKENS", 900), ("SHARD_DOCS", 20), ("BLOCK_DOCS", 4), ("RUN_BLOCKS", 1), ("COMMON_SHARE", 0.2), ("QUERIES", 2), ("FIRST_SHARE", 3), ("QUERY_TERMS", 150)):
        monkeypatch.setattr(bm25, name, value)
    rng = random.Random(9)
    vocab = ["the", "of"] * 30 + ["w" + "".join(rng.choices("abcdef", k=4)) for _ in range(150)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(240)]
    texts[10] = texts[60] = texts[50]
    texts[150] = " ".join(vocab * 40)
    texts[70:95] = [texts[100]] * 25
    rows = [*enumerate(texts), (240, None), (250, "!!"), (None, "the of")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rank int")
    got = {}
    for r in bm25.search(df.repartition(3), df.where("doc_id % 50 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    bags = {i: Counter((t or "").replace("!", "").split()) for i, t in rows if i is not None}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df_ = Counter(t for b in bags.values() for t in b)
    for q in range(0, 300, 50):
        if q not in bags:
            continue
        best = []
        for i, b in bags.items():
            s = sum(math.log1p((n - df_[t] + 0.5) / (df_[t] + 0.5)) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in bags[q] if b[t])
            if s > 0:
                best.append((-round(s, 6), i))
        mine = sorted(got.get(q, []))
        assert [x[1] for x in mine] == [i for _, i in sorted(best)[:5]]
        assert all(abs(a[2] + b[0]) < 2e-6 for a, b in zip(mine, sorted(best)))
    assert bm25.search(df.limit(0), df.limit(0)).count() == 0


# ---- words


def test_words_and_nulls_in_slices():
    arr = pa.array(["x", None, " A b\tc\x0bd ", "", "éa B"], pa.string())[1:]
    got = [len(s) for s in textscan.shingle_sets(arr, 2)]
    assert got == [0, 3, 0, 1]
    a, b = (list(textscan.shingle_sets(pa.array([t]), 3))[0] for t in ("A B C d", "a b c D"))
    assert np.array_equal(a, b)


def test_jaccard_of_repeated_ids(spark):
    """Ids that repeat with other texts, in several orders of rows."""
    rng = random.Random(8)
    say = lambda k: " ".join(rng.choices(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], k=k))
    texts = [say(60) for _ in range(12)]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(20 + i, t + " end") for i, t in enumerate(texts)] + [(3, texts[0]), (3, None), (3, " "), (3, " "), (None, texts[1]), (None, None)]
    sets = [{tuple((t or "").split()[k : k + 3]) for k in range(len((t or "").split()) - 2)} for _, t in rows]
    part = list(range(len(rows)))
    for _ in rows:
        for x, a in enumerate(sets):
            for y, b in enumerate(sets):
                if a and b and rows[x][0] is not None and rows[y][0] is not None and 100 * len(a & b) >= 90 * len(a | b):
                    part[x] = part[y] = min(part[x], part[y])
    own = {p: min(rows[x][0] for x in range(len(rows)) if part[x] == p) for p in set(part) if rows[p][0] is not None}
    want = Counter((i, len(s), own[p]) for (i, _), s, p in zip(rows, sets, part) if i is not None)
    kept = Counter({min((i, t) for (i, t), q in zip(rows, part) if q == p) for p in own if sets[p]} | {(3, None), (3, " ")})
    for order in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame([(i, t, order) for i, t in rows], "doc_id long, text string, cls int").repartition(order + 1)
        assert Counter(tuple(r) for r in jaccard.components(df, 3, 90).collect() if r.doc_id is not None) == want
        out = jaccard.one_of_each(df, 3, 90)
        left = [(r.doc_id, r.text) for r in out.collect()]
        assert out.columns == df.columns and sum(i is None for i, _ in left) == 2
        assert {t for i, t in left if i is not None} == {t for _, t in kept} and Counter(i for i, _ in left if i is not None) == Counter(i for i, _ in kept)


# ---- op11


def mined(rows, every=50):
    rows = [(i, (l + 1) % 10 if i % 7 == 0 else l, v) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for *_, v in rows), default=1)
    m = np.array([[math.floor(256 * float(x)) for x in v] + [0] * (width - len(v)) for *_, v in rows], np.int64).reshape(len(rows), width)
    ids, labels, out = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]), []
    for a in np.flatnonzero(ids % every == 0):
        s = m @ m[a]
        order = [x for x in np.lexsort((ids, -s)) if x != a]
        for p in [x for x in order if labels[x] == labels[a]][:5]:
            fit = [q for q in order if labels[q] != labels[a] and 50 * s[p] <= 100 * s[q] <= 95 * s[p]][:3]
            out += [(int(ids[a]), int(ids[p]), k + 1, int(ids[q]), int(s[p]), int(s[q])) for k, q in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, score double, n int, lo string"


@pytest.mark.parametrize("case", ["spread", "ties", "odd"])
def test_hard_negatives(spark, case, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    if case == "spread":
        rows = [(i, (rng.normal(size=16) * np.linspace(2, 0.1, 16)).tolist(), int(rng.integers(10))) for i in range(900)]
    elif case == "ties":
        rows = [(i % 300, rng.integers(-1, 2, 6).astype(float).tolist(), int(rng.integers(3))) for i in range(600)]
        rows += rows[:60] + [(100, [1.0] * 6, 4)] * 3
    else:
        rows = [(i, [float(i % 3), 1.0, -float(i % 5)][: i % 4], i % 2) for i in range(-100, 200)] + [(50, None, 1), (50, [1.0, 2.0], None), (None, [1.0], 1), (100, [float("nan"), 1.0], 1), (150, [float("inf")], 1), (200, [1.0, None], 0), (250, [1e5, 1.0], 1)]
    df = spark.createDataFrame([(i, v, l, 1.0, 2, "x") for i, v, l in rows], VECTORS).repartition(5)
    want = mined([(r.vec_id, r.label, r.embedding) for r in df.collect()])
    assert want and sorted(map(tuple, negatives.mine(df).collect())) == want
    if case == "spread":
        monkeypatch.setattr(negatives, "BROADCAST", 0)
        assert sorted(map(tuple, negatives.mine(df).collect())) == want
        left = {(r.search, r.look): r.pairs for r in negatives.mine(df, counts=True).collect()}
        assert max(v for (s, k), v in left.items() if k == max(k for _, k in left)) < 0.2 * left["negatives", 0]


def test_hard_negatives_of_little(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.mine(none).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, None, None, None), (7, [], 2, None, None, None)], VECTORS)
    assert negatives.mine(one).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(0, [1e9], 1, None, None, None)], VECTORS))


# ---- op12


def merkle_rows(rows):
    """rows: (doc_id, source, lang, n_chars, text); by recursion over Python lists."""
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = str.maketrans({c: c + 32 for c in range(65, 91)})

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
        return out

    def way(tree, i):
        for nodes in tree[:-1]:
            run = i - i % 16
            yield "".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])
            i //= 16

    trees = {}
    for s in {r[1] for r in rows}:
        mine = sorted(((r[0] is not None, r[0] or 0, sha(*map(enc, r))), r) for r in rows if r[1] == s)
        trees[s] = mine, levels([k[2] for k, _ in mine])
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top, out = levels([trees[s][1][-1][0] for s in names]), []
    for n, s in enumerate(names):
        mine, tree = trees[s]
        for i, ((*_, leaf), r) in enumerate(mine):
            path = [*way(tree, i), *way(top, n)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = sha(*map(enc, r[:4]), enc(r[4] if r[4] is None else r[4].translate(low))) if hit else leaf
            for a, b in path:
                h = sha(a, h, b)
            out.append((r[0], leaf, tree[-1][0], top[-1][0], sha(*(a + b for a, b in path)), h, h == top[-1][0]))
    return out


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, leaf int, hash string, key string, pos int"


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 1}, {"a": 300, "B": 1, "é": 256, "": 257, None: 33}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_merkle(spark, sizes):
    rows = []
    for s, n in sizes.items():
        rows += [(len(rows) + k, s, None if k % 3 else "en", k if k % 4 else None, [None, "", "Über ABC xyz", "low", "It's\nA"][k % 5]) for k in range(n)]
    if len(rows) > 100:
        rows += [rows[3], (rows[3][0], *rows[3][1:4], "other"), (None, "a", None, None, "no id A"), (None, "a", None, None, None), (-7, "a", "de", -1, "X" * 100000)]
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], MERKLE).repartition(3)
    out = merkle.audit(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, merkle_rows(rows)))


def test_merkle_of_nothing(spark):
    assert merkle.audit(spark.createDataFrame([], MERKLE)).count() == 0


def test_merkle_in_three_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, "a" if i % 9 else "b", "en", i, f"T {i}") for i in range(600)]
    out = merkle.audit(spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], MERKLE)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, out)) == sorted(merkle_rows(rows))


# ---- op13


def bag(text):
    return Counter(re.findall("[^\x20\t-\r]+", text.translate({c: c + 32 for c in range(65, 91)})))


def test_samples_agree_as_often_as_jaccard_says():
    rng = random.Random(4)
    pairs = [("a a a b", "a b b c"), ("a b c", "d e f"), ("x y", "Y X")]
    pairs += [(" ".join(rng.choices("abcdefghij", k=40)), " ".join(rng.choices("abcdefghij", k=25))) for _ in range(6)]
    for a, b in pairs:
        s = fingerprint.signatures(pa.array([a, b]), 3000)
        like = sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())
        assert abs((s[0] == s[1]).mean() - like) < 4 * (max(like * (1 - like), 0.0001) / 3000) ** 0.5 + 0.001
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=k)) for k in range(200)]
    whole = fingerprint.signatures(pa.array(texts))
    assert all((fingerprint.signatures(pa.array([t])) == w).all() for t, w in zip(texts[::20], whole[::20]))


def test_pieces_of_a_long_text_give_its_samples(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(5000)) + " " + "漢字" * 400
    want = fingerprint.signatures(pa.array([text, None, "", "a"]))
    monkeypatch.setattr(fingerprint, "PIECE", 100)
    assert (fingerprint.signatures(pa.array([text, None, "", "a"])) == want).all() and not want[1:3].any()


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints(spark, docs, empty, parts):
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect())
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = fingerprint.fingerprints(docs).collect()
        assert fingerprint.fingerprints(empty).count() == 0
        assert [(r.near_next, r.n_chars) for r in fingerprint.fingerprints(docs.where("doc_id = 8")).collect()] == [(1.0, 7)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = []
    for k, (known, i, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][2]
        new = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        a, b, c = (fingerprint.signatures(pa.array([x]))[0] for x in (t, new, u))
        want.append((i if known else None, len(t), hashlib.sha256(new.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), (a == b).mean(), (a == c).mean()))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [(*w[:5], float(w[5]), float(w[6])) for w in want]))
