"""The ten corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docket.llm import _common, ann, chat, decontaminate, langid, mixing, sharding, simhash, sketch, substring, suffix, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re", "su") for b in ("", "n", "ta") for c in ("", "s", "do", "é")]


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice((" ", " ", " ", "\n", ". ")) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.choice((0, 1, 2, 15, 60, 150))), rng.choice(("en", "fr", None)), rng.choice(("a", "b", None)), 0) for i in range(40)]
    long_, shared = prose(rng, 3000), prose(rng, 120)
    out += [(40 + i, out[7][1] or long_, "en", "a", 0) for i in range(4)]  # exact copies
    out += [(50, long_, "en", "b", 0), (51, long_[:9000] + " changed " + long_[9000:], "en", "b", 0), (52, long_ + " more", "fr", "b", 0)]
    out += [(60 + i, prose(rng, 20) + shared + prose(rng, 20), "en", "a", 0) for i in range(8)]
    out += [(70, None, "en", "a", 0), (71, "", None, None, 0), (72, " \n\t ", "fr", "a", 0), (73, "a" * 3000, "en", "a", 0), (74, "123 --- 456", "en", "a", 0), (75, "ab " * 900, "en", "c", 0)]
    out += [(9, out[9][1], "en", "a", 0), (50, long_, "en", "b", 0)]  # repeated rows
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


# --- language ID


def test_language_id(spark):
    rng = random.Random(1)
    own = {"xx": ("thing", "other", "where", "would"), "yy": ("über", "schön", "nicht", "auch"), "zz": ("cette", "pour", "dans", "très")}
    data = [(i, " ".join(rng.choice(own[k]) for _ in range(30)), k) for i in range(240) for k in [rng.choice(list(own))]]
    data += [(900, None, "xx"), (901, "", "xx"), (902, "12 34 !?", "yy"), (903, "thing " * 90_000, None), (None, "nicht auch", "yy")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang")
    out = {r["doc_id"]: r for r in langid.identify(df.selectExpr("*", "1 as score")).collect()}
    assert all(out[i]["lang_pred"] == k for i, _, k in data[:240])
    assert all(0 <= r["_score"] <= 1 and r["score"] == 1 for r in out.values())  # a column of that name stays
    assert all(out[i]["lang_pred"] == "und" and out[i]["rejected"] and out[i]["_score"] == 0 for i in (900, 901, 902))
    assert out[903]["lang_pred"] == "xx"
    assert [r["lang_pred"] for r in langid.identify(df.where("lang is null")).collect()] == ["und"]  # nothing to learn from
    assert langid.identify(df.limit(0)).count() == 0
    held = {r[0]: r[1] for r in df.select("doc_id", langid.held_out()).collect() if r[0] is not None}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())


def test_language_id_learns_only_from_the_rows_allowed(spark):
    rows = [(i, "aaa bbb", "good") for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows += [(i, "ccc ddd", "never") for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["good"]


def test_language_id_pieces_of_long_texts_add_up():
    model = langid.Model(["a", "b"], np.random.default_rng(0).normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    one, n = model.sums(["ab cd " * 10])
    many, m = model.sums(["ab cd " * 100_000])
    assert np.allclose(one / n, many / m, atol=1e-4)


# --- SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words)] if 0 < len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash(docs):
    got = simhash.group(docs).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(text)
    fps = [brute_fingerprint(text[i]) for i in ids]
    assert all(r["fp"] % (1 << 64) == fps[ids.index(r["doc_id"])] for r in got)
    root = union(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert all(r["component_id"] == ids[root[ids.index(r["doc_id"])]] for r in got)
    assert len(got) == docs.count()


def test_pigeonring_loses_no_link(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({f ^ sum(1 << b for b in rng.sample(range(64), k)) for f in fps for k in (0, 1, 2, 3, 4, 6) for _ in range(4)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    order = sorted(range(len(fps)), key=lambda i: signed[i])
    root = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[order[a]] ^ fps[order[b]]).bit_count() <= 3])
    want = {(signed[order[i]], signed[order[r]]) for i, r in enumerate(root) if i != r}
    assert {tuple(e) for e in edges} == want and want


def test_simhash_of_many_shingles_in_lanes():
    text = " ".join(random.Random(3).choice(WORDS) for _ in range(simhash.CHUNK // 50))
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_simhash_stage_keeps_one_of_each(spark, docs):
    kept = simhash.stage(spark, docs, "")
    of = {r["component_id"] for r in simhash.group(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(of) and kept.columns == docs.columns
    assert simhash.stage(spark, docs.limit(0), "").count() == 0


# --- nearest neighbours


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:300] = x[100]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0, 2.0]), (None, x[0].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df).collect()
    x = x.astype(float)
    for q in range(0, 600, 20):
        s = ann.exact(x[q], x)
        s[q] = -np.inf
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[1] for m in mine] == np.lexsort((np.arange(600), -s))[:20].tolist()
        assert [m[2] for m in mine] == [s[m[1]] for m in mine]
    assert {r["query_id"] for r in got} == set(range(0, 600, 20))
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 20")).count() == 0
    assert sorted(r["vec_id"] for r in ann.search(df.where("vec_id in (20, 21, 22)")).collect()) == [21, 22]


def test_ann_recall_and_balance(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 128)
    monkeypatch.setattr(ann, "BLOCK", 64)
    x = np.random.default_rng(6).normal(size=(2000, 16))
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    s = x[::20] @ x.T
    s[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    true = {(q * 20, int(v)) for q in range(100) for v in np.argsort(-s[q])[:20]}
    assert len(true & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(true)
    label = ann.balanced_parts(x, ann.neighbour_graph(x), 16)
    assert np.bincount(label, minlength=16).max() <= np.ceil(1.1 * 2000 / 16)


# --- repeated word windows


def brute_windows(rows):
    seen, out = {}, []
    for doc_id, text in sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone[i : i + 20] = True
            seen.setdefault(w, (doc_id, i))
        out.append((doc_id, len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_substring(docs, rows, small, monkeypatch):
    if small:
        monkeypatch.setattr(substring, "SHARD_WINDOWS", 300)
        monkeypatch.setattr(substring, "LANES", 2)
        monkeypatch.setattr(sketch, "PER_PART", 500)
        monkeypatch.setattr(sketch, "FAN", 3)
        monkeypatch.setattr(sketch, "LOG_SLICE", 8)
    got = {tuple(r) for r in substring.dedup(docs).collect()}
    assert got == set(brute_windows(rows)) and substring.dedup(docs).count() == len(rows)
    assert substring.dedup(docs.limit(0)).count() == 0


def test_rolled_hash_and_packing():
    w = np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64)
    for n in (1, 2, 7, 20, 32):
        want = [sum(int(w[i + j]) * pow(12345679, j, 1 << 64) for j in range(n)) % (1 << 64) for i in range(50 - n + 1)]
        assert sketch.rolled(w, n, 12345679).tolist() == want
    at = np.unique(np.random.default_rng(1).integers(0, 1 << 24, 999))
    assert sketch.unpack(sketch.pack(at)).tolist() == at.tolist() and not len(sketch.unpack(sketch.pack(at[:0])))


# --- suffix arrays


def brute_short(rows):
    """Bytes of each row under a 340-byte string that stands twice."""
    count, out = Counter(), []
    texts = [(r[1] or "").encode() for r in rows]
    for b in texts:
        count.update(b[i : i + 340] for i in range(len(b) - 339))
    for b in texts:
        under = np.zeros(len(b), bool)
        for i in range(len(b) - 339):
            if count[b[i : i + 340]] > 1:
                under[i : i + 340] = True
        out.append(int(under.sum()))
    return out


def brute_bytes(rows):
    count, out = Counter(), []
    for r in rows:
        b = (r[1] or "").encode()
        count.update(b[i : i + 400] for i in range(len(b) - 399))
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if count[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((r[0], len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_suffix(docs, rows, small, monkeypatch):
    if small:  # dealt anchors, split shards, texts in pieces
        monkeypatch.setattr(suffix, "SHARD", 2500)
        monkeypatch.setattr(suffix, "SPLIT", 2)
        monkeypatch.setattr(suffix, "HEAVY", 1)
        monkeypatch.setattr(suffix, "BATCH", 1500)
        monkeypatch.setattr(suffix, "PLACES", 3)
        monkeypatch.setattr(sketch, "PER_PART", 50)
        monkeypatch.setattr(sketch, "FAN", 3)
    rng = random.Random(17)
    passage = prose(rng, 120)[:370]
    rows = rows + [(90 + i, prose(rng, 30) + passage + prose(rng, 30 * (i % 2)), "en", "a", 0) for i in range(4)]  # too short to go
    docs = docs.sparkSession.createDataFrame(rows, DOCS).repartition(3)
    got = sorted((*tuple(r)[:4], bytes(r["kept"]), r["n_short"]) for r in suffix.dedup(docs).collect())
    assert got == sorted((*b, n) for b, n in zip(brute_bytes(rows), brute_short(rows), strict=True))
    assert any(n > k for _, _, k, _, _, n in got)
    assert suffix.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_suffix_array_and_prefixes(letters):
    t = np.random.default_rng(letters).integers(97, 97 + letters, 1500).astype(np.uint8)
    t[900:1300] = t[100:500]
    b, sa = t.tobytes(), suffix.suffix_array(t)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])

    def common(i, j):
        k = 0
        while k < 400 and max(i, j) + k < len(b) and b[i + k] == b[j + k]:
            k += 1
        return k

    assert suffix.common_prefixes(t, sa, 400)[1:].tolist() == [common(sa[r], sa[r - 1]) for r in range(1, len(b))]


def test_repeated_starts_sort_no_deeper_than_strings_go(monkeypatch):
    depths, doubled = [], suffix.doubled
    monkeypatch.setattr(suffix, "doubled", lambda *a: (depths.append(r[0]) or r for r in doubled(*a)))
    monkeypatch.setattr(suffix, "suffix_array", None)
    rng = random.Random(5)
    base = rng.randbytes(3000)
    blocks = [(base, 2601, 1), (b"x" + base[:2000], 1662, 1), (b"\0" * 700, 301, 1), (base[5:380], 36, 2), (rng.randbytes(500), 101, 3), (rng.randbytes(450), 51, 1), (base[100:439], 1, 1)]
    whole = b"".join(b for b, _, _ in blocks)
    got = list(suffix.repeated_starts(blocks, (340, 400)))
    for length, (starts, twice, group) in zip((340, 400), got, strict=True):
        count, named, at = Counter(), {}, 0
        places = []
        for b, n, k in blocks:
            for i in range(min(n, len(b) - length + 1)):
                count[b[i : i + length]] += k
                places.append(at + i)
            at += len(b)
        assert starts.tolist() == places
        assert twice.tolist() == [count[whole[i : i + length]] > 1 for i in places]
        for i, g in zip(places, group.tolist(), strict=True):
            assert named.setdefault(whole[i : i + length], g) == g
        assert len(set(named.values())) == len(named)
    assert max(depths) < 400  # the first 2,000 bytes of two blocks are equal


# --- URL filters


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x=1", "x://example.com/en/8#y", "x://www.example.net/de/81", "x://net/de/", "x://.net/de/", "x://a.org/es", "x://a.org/es/", "x://EXAMPLE.com", "a://b://c.com/en/", "x://" + "a." * 3000 + "com/en/" + "p" * 5000]
    rows = [(i, u) for i, u in enumerate(urls * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'clash' as rule")
    rules = spark.createDataFrame([*urlfilter.RULES, ("block", "", "/"), ("block", None, None)], "verdict string, host string, path string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df, rules).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        rest = (u or "").partition("://")[2]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, want[1], want[2])
    assert urlfilter.filter_urls(df, rules.limit(0)).where("verdict = 'block'").count() == 0
    assert urlfilter.filter_urls(df.limit(0), rules).count() == 0


# --- decontamination


def items_and_docs(rng):
    items = [(i, prose(rng, rng.choice((3, 9, 10, 25)))) for i in range(12)] + [(50, None), (51, ""), (52, "!!!"), (53, "Solo"), (3, "other words under the same id, ten of them or so here")]
    docs = []
    for i in range(60):
        t = prose(rng, rng.choice((0, 5, 40)))
        if i % 3 == 0:
            words = (rng.choice(items[:12])[1] or "").split()
            t += " " + " ".join(words[rng.randrange(3) :][: rng.choice((9, 10, 30))]).upper().replace("É", "é") + " " + prose(rng, 8)
        docs.append((i, t))
    return items, [*docs, (90, None), (91, ""), (92, "solo"), (92, "solo")]


def brute_hits(items, text, span=10):
    words, hit, who = decontaminate.words_of(text), set(), set()
    for item, t in items:
        ws = decontaminate.words_of(t)
        n = min(span, len(ws))
        for k in range(len(ws) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == ws[k : k + n]:
                    hit |= set(range(i, i + n))
                    who.add(str(item))
    return len(words), len(hit), sorted(who)


@pytest.mark.parametrize("most", [decontaminate.MAX_WORDS, 60])
def test_decontaminate(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_WORDS", most)
    items, docs = items_and_docs(random.Random(8))
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as items")
    got = sorted((r["doc_id"], r["n_words"], sum(h["b"] - h["a"] for h in r["hits"]), r["items"]) for r in decontaminate.find_spans(df, bench).collect())
    assert got == sorted((i, *brute_hits(items, t)) for i, t in docs)
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns
    kept = {r["doc_id"]: r["text"] for r in clean.collect()}
    for i, t in docs:
        n, hit, _ = brute_hits(items, t)
        assert (i in kept) == (hit <= 0.5 * n)
        if i in kept:
            assert kept[i] == t if not hit else not brute_hits(items, kept[i])[1]
    none = bench.limit(0)
    assert decontaminate.find_spans(df, none).where("size(hits) > 0").count() == 0
    assert decontaminate.find_spans(df.limit(0), bench).count() == 0


# --- sharding


@pytest.mark.parametrize("part", [50_000, 7])
def test_shards(docs, part):
    got = sharding.shard_rows(docs.selectExpr("*", "'x' as shard"), ["doc_id"], shards=5, rows=part).collect()
    n = docs.count()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(5)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert {len(v) for v in slots.values()} <= {n // 5, n // 5 + 1}
    again = sharding.shard_rows(docs.repartition(7), ["doc_id"], shards=5, rows=part).collect()
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again)
    assert sharding.shard_rows(docs.limit(0), ["doc_id"]).count() == 0


def test_matrix_has_exact_margins_and_the_right_law():
    sizes, counts = [10, 11, 11], [7, 0, 20, 5]
    m = sharding.communication_matrix(counts, sizes, 3)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes
    rng = random.Random(1)
    draws = [sharding.draw(rng, 12, 20, 9) for _ in range(4000)]
    assert abs(np.mean(draws) - 9 * 12 / 32) < 0.08
    assert abs(np.var(draws) - 9 * (12 / 32) * (20 / 32) * (23 / 31)) < 0.1
    assert 0 < sharding.draw(rng, 10**10, 10**10, 10**6) < 10**6


# --- mixing


@pytest.mark.parametrize("rows", [2_000, 3])
def test_mix(spark, rows):
    rng = random.Random(7)
    data = [(i, rng.choice(["s1"] * 6 + ["s2", "s3", "é", None]), rng.choice((0, 5, 20, 80))) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, source string, size long").selectExpr("*", "1 as target")
    got = mixing.mix(df, rows=rows).collect()
    size = Counter()
    for _, s, n in data:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2), strict=True))
    assert abs(sum(want.values()) - 1.5 * sum(size.values())) < 1e-6
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["copies_taken"] * r["size"]
        assert 0 <= r["copies_taken"] <= 2 and r["source_size"] == size[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert len(got) == len(data) and all(abs(taken[s] - want[s]) <= 161 for s in names)
    assert sum(taken.values()) <= 1.5 * sum(size.values())
    again = mixing.mix(df.repartition(5), rows=rows).collect()
    assert {(r["doc_id"], r["copies_taken"]) for r in got} == {(r["doc_id"], r["copies_taken"]) for r in again}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_targets_reshare():
    assert mixing.targets([10, 100, 100], [5, 2, 1], 150, 2) == [20.0, 130 * 2 / 3, 130 / 3]
    assert mixing.targets([0, 0], [5, 2], 0, 2) == [0.0, 0.0]


def test_word_count(spark):
    df = spark.createDataFrame([("a b\tc",), (None,), ("",), (" \x0b\x0c ",), ("é\u00a0x y",)], "t string")
    assert [r[0] for r in df.select(mixing.words(df["t"])).collect()] == [3, 0, 0, 0, 2]


# --- chat


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "\\<|", "<\\|", "\\\\", "<|im_start|>assistant\nhi", "", None, "<\\n>", "x\n", "é" * 50, "<" + "\\" * 7 + "|"]
    turns = [(c, t, ("user", "assistant", "sys\ntem <|", None)[(c + t) % 4], nasty[(c * 3 + t) % len(nasty)]) for c in range(15) for t in range(c % 6 + 1)]
    turns += [(None, 0, "assistant", "x"), (3, 0, "assistant", "tie"), (3, None, "user", "first"), (4, 0, "user", "q"), (4, 0, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    examples = chat.expand(df)
    back = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted(((t[1] is not None, t[1] or 0), t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        assert [tuple(x) for x in back[conv]["turns"]] == [m[1:] for m in mine]
        assert back[conv]["losses"] == [m[2] for m in mine if m[1] == "assistant"]
    for e in examples.where("target is not null").collect():
        body = e["formatted"][e["loss_start"] :]
        assert body[e["loss_length"] :] == f"{chat.END}\n" and e["formatted"].count(chat.START) == e["target"] + 1
    assert chat.expand(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest() and chat.CONTROL.count("<|") == 2


CLASHES = ["_a", "a", "b", "_b", "_part", "part", "_pos", "pos", "_r", "r", "row", "key", "name", "_sent", "sent", "_w", "w", "n", "_k", "k", "_i", "th", "of", "ends", "strip", "before", "rank", "s", "t", "_h", "_p", "_found", "_row", "h", "p", "full", "size_"]


def clashing(spark, rows, schema):
    """rows with a column of each name that operators use inside, numbered by row."""
    return spark.createDataFrame([(*r, *[f"{c}{i}" for c in CLASHES]) for i, r in enumerate(rows)], schema + ", " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)


def untouched(rows):
    """Each row's clashing columns still belong together."""
    return all(len({r[c].removeprefix(c) for c in CLASHES}) == 1 for r in rows)


def test_clashing_columns_are_kept(spark):
    rng = random.Random(3)
    rows = [(i if i % 4 else None, prose(rng, 20 + i), "en", f"s{i % 3}" if i % 5 else None, 0) for i in range(40)] + [(7, "the same", "en", "s1", 0)] * 5 + [(8, None, None, None, 0)]
    docs = clashing(spark, rows, DOCS)
    for stage, more in ((langid.stage, 0), (sharding.stage, 2), (mixing.stage, 0), (decontaminate.stage, 0), (simhash.stage, 0)):
        df = stage(spark, docs, "/root/testdata/sf0.001")
        got = df.collect()
        assert got and len(df.columns) == len(docs.columns) + more and df.columns[: len(docs.columns)] == docs.columns and untouched(got)
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.columns == df.columns and empty.count() == 0
    assert sharding.stage(spark, docs, "").count() == len(rows)
    urls = clashing(spark, [(i, f"http://x{i % 3}.com/en/{i}") for i in range(9)], "page_id long, url string")
    got = urlfilter.filter_urls(urls, spark.createDataFrame(urlfilter.RULES, "verdict string, host string, path string")).collect()
    assert len(got) == 9 and untouched(got) and {r["verdict"] for r in got} == {"block"}


def test_mixing_stage_loses_no_row(spark):
    """A mix of twice every size takes each row with words twice: null ids, one id with two texts, and repeated rows."""
    rows = [(None, "a b c", "en", "s", 0), (None, "d e", "en", "s", 0), (None, "d e", "fr", "s", 0), (1, "f g", "en", "s", 0), (1, "h i j k", "en", None, 0), (2, "l", "en", "s", 0), (2, "l", "en", "s", 0), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    whole = mixing.mix
    try:
        mixing.mix = lambda df, **more: whole(df, budget=2.0, **more)
        got = Counter((r["doc_id"], r["text"], r["lang"]) for r in mixing.stage(spark, docs, "").collect())
    finally:
        mixing.mix = whole
    assert got == Counter({k: 2 * n for k, n in Counter((r[0], r[1], r[2]) for r in rows if r[1]).items()})


def test_hot_keys_are_told_apart(spark, monkeypatch):
    """A key of most rows, some of them equal: gapless slots, shards one apart, sizes as asked for; reruns on other partitions agree."""
    monkeypatch.setattr(_common, "HOT", 5)
    monkeypatch.setattr(_common, "CHUNK", 7)
    rows = [(None, f"w {i}", "en", "s", 0) for i in range(90)] + [(None, "x y", "en", "s", 0)] * 60 + [(i, f"u {i}", "en", "t", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    out = [sharding.shard_rows(d, ["doc_id"], shards=4, rows=20).collect() for d in (docs.repartition(3), docs.repartition(5))]
    assert Counter((r["doc_id"], r["text"]) for r in out[0]) == Counter((r[0], r[1]) for r in rows)
    assert sorted(map(repr, out[0])) == sorted(map(repr, out[1]))
    assert sorted((r["shard"], r["slot"]) for r in out[0]) == [(s, k) for s in range(4) for k in range(50)]
    sizes = docs.select("doc_id", "source", "text", F.lit(2).cast("long").alias("size"))
    out = [mixing.mix(d, rows=1, budget=1.2).collect() for d in (sizes.repartition(3), sizes.repartition(5))]
    assert sorted(map(repr, out[0])) == sorted(map(repr, out[1])) and len(out[0]) == len(rows)
    assert 0 <= 1.2 * 400 - sum(2 * r["copies_taken"] for r in out[0]) < 2
