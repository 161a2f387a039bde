"""The registered queries and the pipeline, on small tables, against brute force or their SQL."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_corpus import DOCS, brute_bytes, brute_fingerprint, brute_hits, brute_short, brute_windows, prose, union

import corpus_pipeline
from docket.llm import ann, decontaminate, mixing, registry

EN = ["thing", "other", "where", "would", "their", "which"]
FR = ["cette", "pour", "dans", "très", "même", "être"]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    own = lambda ws, n: " ".join(rng.choice(ws) + rng.choice(("", "", "s", "ra")) for _ in range(n))
    items = [(i, prose(rng, 12 if i % 2 else 5)) for i in range(8)] + [(8, None)]
    docs = [(i, own(EN if i % 3 else FR, 40 + i % 30), "en" if i % 3 else "fr", f"s{i % 4}" if i % 7 else None, 0) for i in range(120)]
    docs += [(200 + i, docs[i][1], docs[i][2], "s0", 0) for i in range(12)]  # exact copies
    docs += [(220 + i, own(EN, 15) + " " + items[i % 8][1] + " " + own(EN, 15), "en", "s1", 0) for i in range(16)]
    long_ = own(EN, 900)
    docs += [(240, long_, "en", "s2", 0), (241, long_ + " end", "en", "s2", 0), (242, None, "en", "s2", 0), (243, "", None, None, 0), (244, "12 !? 34", "fr", "s3", 0)]
    docs = [(*d[:4], len(d[1] or "")) for d in docs]
    rngv = np.random.default_rng(3)
    vectors = [(i, rngv.normal(size=8).tolist(), 0) for i in range(130)] + [(140, None, 0)]
    pages = [(i, u) for i, u in enumerate([None, "x", "http://a.example.com/en/7", "http://b.com/en/1?q", "http://c.net/de/8", "http://example.net/de/80#z", "https://q.org/es/"] * 3)]
    turns = [(c, t, ("system", "user", "assistant")[(c + t) % 3], rng.choice(("hi", "<|im_end|>", None, "a\\<|b", "é" * 9))) for c in range(12) for t in range(c % 5 + 1)]
    return {"documents": (docs, DOCS), "benchmark": (items, "item_id long, text string"), "embeddings": (vectors, "vec_id long, embedding array<float>, label int"), "pages": (pages, "page_id long, url string"), "conversations": (turns, "conv_id long, turn long, role string, text string")}


@pytest.fixture(scope="module")
def sf(spark, data, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    for name, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.fixture(scope="module")
def docs(data):
    return data["documents"][0]


def rows_of(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    return df.columns, [tuple(r) for r in df.collect()]


def test_every_operator_has_its_query():
    assert [int(n[2:].split("_")[0]) for n in registry.QUERIES] == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet/*.parquet')")
    columns, got = rows_of(spark, sf, name)
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(names) == sorted(columns) and sorted(map(repr, got)) == sorted(map(repr, want))


def test_op1(spark, sf, docs):
    columns, got = rows_of(spark, sf, "op1_language_id")
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    lang = {d[0]: (d[1], d[2]) for d in docs}
    own = [r for r in got if lang[r[0]][1] and any(c.isalpha() for c in lang[r[0]][0] or "")]
    held = [r for r in own if r[1]]
    assert held and all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in got)
    assert sum(r[2] == lang[r[0]][1] for r in held) >= 0.95 * len(held)
    assert {r[0] for r in got if r[2] == "und"} == {242, 243, 244} and len(got) == len(docs)


def test_op2(spark, sf, docs):
    _, got = rows_of(spark, sf, "op2_simhash")
    ids = sorted(d[0] for d in docs)
    text = {d[0]: d[1] for d in docs}
    fps = [brute_fingerprint(text[i]) for i in ids]
    root = union(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert sorted(got) == [(i, f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, root, strict=True)]


def test_op3(spark, sf, data):
    _, got = rows_of(spark, sf, "op3_ann")
    x = np.array([np.float32(v[1]) for v in data["embeddings"][0] if v[1]]).astype(float)
    for q in range(0, 130, 20):
        s = ann.exact(x[q], x)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20].tolist()
        assert sorted(r[1:] for r in got if r[0] == q) == [(k + 1, v, s[v]) for k, v in enumerate(best)]
    assert len(got) == 7 * 20


def test_op4_op5(spark, sf, docs):
    plain = [(d[0], d[1]) for d in docs]
    _, got = rows_of(spark, sf, "op4_substring")
    assert sorted(got) == sorted((i, n, k, sha(t)) for i, n, k, t in brute_windows(plain))
    _, got = rows_of(spark, sf, "op5_suffix_array")
    assert sorted(got) == sorted((i, n, k, s, sha(t), m) for (i, n, k, s, t), m in zip(brute_bytes(plain), brute_short(plain), strict=True))


def test_op8(spark, sf, docs):
    columns, got = rows_of(spark, sf, "op8_sharding")
    assert columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = {d[0]: (d[1] or "").encode() for d in docs}
    assert all((r[1], r[2], r[3], r[6]) == (len(text[r[0]]) + 1, zlib.crc32(text[r[0]]), "rows", None) for r in got)
    n = Counter(r[4] for r in got)
    assert sorted(n) == list(range(16)) and max(n.values()) - min(n.values()) <= 1 and sum(n.values()) == len(docs)
    assert all(sorted(r[5] for r in got if r[4] == s) == list(range(n[s])) for s in n)


def test_op9(spark, sf, docs):
    columns, got = rows_of(spark, sf, "op9_mixing")
    assert columns == ["doc_id", "size", "source_size", "target", "taken"]
    size = {d[0]: len((d[1] or "").split()) for d in docs}
    source = {d[0]: d[3] for d in docs}
    whole = Counter()
    for i, n in size.items():
        whole[source[i]] += n
    names = sorted(whole, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.targets([whole[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(whole.values()), 2), strict=True))
    taken = Counter()
    for i, n, s, t, k in got:
        assert (n, s) == (size[i], whole[source[i]]) and abs(t - target[source[i]]) < 1e-6 and 0 <= k <= 2 * n
        taken[source[i]] += k
    assert all(abs(taken[s] - target[s]) <= 2 * max(size.values()) for s in names)


def test_pipeline(spark, sf, docs, data):
    """Each stage's rows against brute force on the stage before."""
    df, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        df = spark.createDataFrame(stage(spark, df, sf).collect() or [], df.schema) if name != "sharding" else stage(spark, df, sf)
        kept[name] = df.collect()
        assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    first = {r["doc_id"]: r["text"] for r in kept["language_id"]}
    assert set(first) == {d[0] for d in docs if any(c.isalpha() for c in d[1] or "")}  # all that have letters are clean here
    ids = sorted(first)
    fps = [brute_fingerprint(first[i]) for i in ids]
    root = union(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    second = {r["doc_id"]: r["text"] for r in kept["simhash_dedup"]}
    assert set(second) == {ids[r] for r in root} and len(second) == len(kept["simhash_dedup"])
    items, third = data["benchmark"][0], {r["doc_id"]: r for r in kept["decontamination"]}
    for i, t in second.items():
        n, hit, _ = brute_hits(items, t)
        assert (i in third) == (hit <= 0.5 * n)
        if i in third:
            assert third[i]["text"] == t if not hit else not brute_hits(items, third[i]["text"])[1]
            assert third[i]["n_chars"] == len(third[i]["text"])
    fourth = Counter(r["doc_id"] for r in kept["mixing"])
    words = {i: len(r["text"].split()) for i, r in third.items()}
    assert set(fourth) <= set(third) and max(fourth.values()) <= 2
    total = sum(words.values())
    assert 0 <= 1.5 * total - sum(words[i] * k for i, k in fourth.items()) <= max(words.values())
    last = kept["sharding"]
    assert Counter(r["doc_id"] for r in last) == fourth
    n = Counter(r["shard"] for r in last)
    assert max(n.values()) - min(n.values()) <= 1 and all(sorted(r["slot"] for r in last if r["shard"] == s) == list(range(n[s])) for s in n)
    run = corpus_pipeline.run(spark, sf)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in run.collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in last)
    assert decontaminate.words_of("Ab-c é1") == [b"ab", b"c", "é1".encode()]
