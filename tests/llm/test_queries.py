"""Every registered query and every pipeline stage, against brute force on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from folioscan.llm import urlfilter

DATA = Path(os.environ.get("FOLIOSCAN_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


def table(name):
    return duckdb.sql(f"select * from '{DATA}/{name}.parquet'").fetchall() if (DATA / f"{name}.parquet").is_file() else duckdb.sql(f"select * from '{DATA}/{name}.parquet/*.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs():
    return [(r[0], r[1], r[2]) for r in table("documents")]


def run(spark, name):
    (full,) = [q for q in entry.queries() if q.startswith(name + "_")]
    return entry.queries()[full](spark, str(DATA)).collect()


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op1(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op1")}
    size = {i: len((t or "").encode()) + 8 for i, t, _ in docs}
    assert set(got) == set(size) and all(got[i].size == size[i] and got[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t, _ in docs)
    load = Counter()
    for r in got.values():
        load[r.shard] += r.size
    assert max(load.values()) - min(load[s] for s in range(24)) <= max(size.values())
    for s in range(24):
        mine = sorted(r.slot for r in got.values() if r.shard == s)
        assert mine == list(range(len(mine)))


def test_op2(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op2")}
    assert len(got) == len(docs) and all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())
    asked = [(i, t, l) for i, t, l in docs if held(i) and l and t and re.search(r"[^\W\d_]", t)]
    assert np.mean([got[i].lang_pred == l for i, _, l in asked]) > 0.95
    assert all((got[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", t or "")) for i, t, _ in docs)


def test_op3(spark, docs):
    norm = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) + " "
    items = [(i, norm(t)) for i, t in table("benchmark")]
    got = {(r.doc_id, r.item_id): r.distance for r in run(spark, "op3")}
    want = {(i, j) for i, t, _ in docs for j, p in items if p.strip() and p.strip() in norm(t)}
    assert want <= set(got) and all(r.distance <= r.max_errors for r in run(spark, "op3"))


def test_op4(spark):
    talk = {}
    for conv, turn, role, text in table("conversations"):
        talk.setdefault(conv, []).append((turn, role, text or ""))
    talk[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in run(spark, "op4")}
    assert set(got) == set(talk)
    for conv, turns in talk.items():
        turns.sort(key=lambda x: x[0])
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and g.formatted_chars > sum(len(t) for *_, t in turns)


def test_op5(spark, docs):
    sets = {}
    for i, t, _ in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op5")} == {i: (len(sets[i]), find(i)) for i in ids}


def test_op6(spark, docs):
    label = {r[0]: r[1] for r in table("labels")}
    got = {r.doc_id: r for r in run(spark, "op6")}
    assert len(got) == len(docs) and all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    asked = [i for i, y in label.items() if i in got and held(i) and y is not None]
    assert asked and np.mean([(got[i].score >= 0.5) == (label[i] == 1) for i in asked]) > 0.9


def test_op7(spark):
    pages = [(p, (h or "").encode()) for p, _, h in table("pages")]
    last = {}
    for p, h in pages:
        last[h] = max(p, last.get(h, p))
    want = {p: (len(h), hashlib.sha1(h).hexdigest(), "response" if len(h) < 1000 or last[h] == p else "revisit", None if len(h) < 1000 or last[h] == p else last[h]) for p, h in pages}
    got = run(spark, "op7")
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and all(r.verified for r in got)


def test_op8(spark):
    from test_small import judged

    got = {r.page_id: r for r in run(spark, "op8")}
    pages = table("pages")
    assert set(got) == {p for p, *_ in pages}
    for p, url, _ in pages:
        host, path, rule, verdict = judged(url, urlfilter.RULES)
        assert (got[p].host, got[p].path, got[p].rule) == (host, path, rule) and (verdict is None or got[p].verdict == verdict)


def test_op9(spark, docs):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, _ in docs}
    pieces, places = {}, {}
    for r in run(spark, "op9"):
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(pieces) == set(ids)
    for i, got in pieces.items():
        at = 0
        for s, n in sorted(got):
            assert s == at and n > 0
            at += n
        assert at == len(ids[i])
    for got in places.values():
        at = 0
        for s, n in sorted(got):
            assert s == at
            at += n
        assert at <= 2048
    assert sum(map(len, ids.values())) / (2048 * len(places)) > 0.9


def test_op10(spark, docs):
    norm = lambda t: Counter("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    bags = {i: norm(t) for i, t, _ in docs}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    got = {}
    for r in run(spark, "op10"):
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    for q in (i for i in bags if i % 50 == 0):
        score = {i: sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in bags[q] if b[t]) for i, b in bags.items()}
        best = sorted(((-round(s, 5), i) for i, s in score.items() if s > 1e-6))[:10]
        mine = [got.get(q, {})[k] for k in sorted(got.get(q, {}))]
        assert len(mine) == len(best) and all(abs(a[1] + b[0]) < 2e-5 for a, b in zip(mine, best)) and all(abs(score[d] - s) < 2e-5 for d, s in mine)


def test_op11(spark):
    from test_small import mined

    assert sorted(map(tuple, run(spark, "op11"))) == mined([(i, l, v) for i, v, l in table("embeddings")])


def test_op12(spark):
    from test_small import merkle_rows

    names = [c[0] for c in duckdb.sql(f"describe select * from '{DATA}/documents.parquet'").fetchall()]
    rows = [tuple(r[names.index(c)] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in table("documents")]
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in run(spark, "op12")]
    assert sorted(got) == sorted(merkle_rows(rows)) and {r[6] for r in got} == {True, False}


def test_op13(spark, docs):
    from test_small import bag

    rows, got = sorted((i, t or "") for i, t, _ in docs), {r.doc_id: r for r in run(spark, "op13")}
    off = []
    for k, (i, t) in enumerate(rows):
        u, r = rows[(k + 1) % len(rows)][1], got[i]
        new = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        like = lambda x: sum((bag(t) & bag(x)).values()) / max(1, sum((bag(t) | bag(x)).values()))  # noqa: B023, E731
        off += [r.near_edited - like(new), r.near_next - like(u)]
    assert len(got) == len(rows) and abs(np.mean(off)) < 0.01 and np.std(off) < 0.06
    by = {}
    for i, t in rows:
        by.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values())


ODD = "doc_id long, text string, lang string, source string, n_chars long, stats int, gone string, key int, score double"


def odd(spark):
    long_text = "The quick brown fox reads many pages. " * 6000
    rows = [(1, None, "en"), (2, "", None), (3, " \n", "en"), (4, "123 !!", "en"), (5, "A plain sentence about the river and the town.", "en"), (5, "A plain sentence about the river and the town.", "en"), (6, long_text, "en"), (7, "Ein kurzer Satz über den Fluss und die Stadt.", "de"), (None, "A row without any id at all.", "en")]
    return spark.createDataFrame([(i, t, l, "s", 0, 1, "x", 2, 0.5) for i, t, l in rows], ODD)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_tables(spark, name, stage):
    docs = odd(spark)
    out = stage(spark, docs, str(DATA))
    none = stage(spark, docs.limit(0), str(DATA))
    assert none.count() == 0
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, 7, None}
        return
    assert out.columns == docs.columns == none.columns
    kept = sorted(str(r.doc_id) for r in out.collect())
    if name == "language ID":
        assert set(kept) <= {"5", "6", "7", "None"} and {"6", "7"} <= set(kept) and kept.count("5") in (0, 2)
    if name == "n-gram Jaccard join":
        assert kept == ["1", "2", "3", "4", "5", "6", "7", "None"]
    if name == "benchmark decontamination":
        assert kept == sorted(str(r.doc_id) for r in docs.collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, str(DATA))
        assert left.columns == docs.columns and left.exceptAll(before).count() == 0
    ids = sorted(r.doc_id for r in left.select("doc_id").collect())
    got = corpus_pipeline.run(spark, str(DATA)).select("doc_id").distinct().collect()
    assert sorted(r.doc_id for r in got) == ids and 0.3 * docs.count() < len(ids) < docs.count()
