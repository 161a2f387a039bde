"""Toxicity, prefix trie and resampling against brute force, on tables with nulls, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from docket.llm import resample, toxicity, trie

TURNS = "conv_id long, turn long, role string, text string, depth int, path string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)

    def below(node):
        out = [node]
        for k in kids[node]:
            out += below(k)
        return out

    rows = []
    for node, cs in members.items():
        sub = below(node)
        ends = sorted(c for c in cs if len(built[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x)
        rows.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]), sum(not kids[x] for x in sub), saved, sha(",".join(map(str, ends)))))
    return sorted(rows, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(95, 130), *range(-4, 5), 200, 7_000, 7_001, 7_050]:
        for t in range(rng.choice((0, 1, 2, 4, 7, 9))):
            rows.append((c, t, rng.choice(("user", "assistant", None)), rng.choice(("a", "b", "é" * 5, None, "")), 3, "own"))
    for c in range(300, 340):  # copies of one conversation
        rows += [(c, t, "user", "same" * t, 0, "x") for t in range(8)]
    rows += [(100, None, "user", "null turn", 0, ""), (100, None, "user", "null turn", 0, ""), (101, 2, "user", "tie", 0, ""), (101, 2, "assistant", "tie", 0, ""), (None, 0, "user", "no id", 0, "")]
    rows += [(900, t, "user", f"long {t}", 0, "") for t in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [trie.LOCAL, 6])
def test_trie_equals_brute_force(spark, tmp_path, monkeypatch, local):
    rows = conversations(local)
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(trie.build, "__defaults__", (local,))
    monkeypatch.setattr(trie, "CHUNK", 7)
    got = [tuple(r) for r in trie.op12_prefix_trie(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute_trie(rows)


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "x", 0, "")], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie.op12_prefix_trie(spark, str(tmp_path)).collect() == []


def test_trie_of_a_turnless_conversation(spark, tmp_path):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    spark.createDataFrame([(c, 0, "user", "gone", 0, "")], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in trie.op12_prefix_trie(spark, str(tmp_path)).collect()] == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def brute_resample(docs, items):
    def grams(text):
        ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(ws) - n + 1)]

    s, t = defaultdict(int), defaultdict(int)
    for table, into in ((docs, s), (items, t)):
        for _, text in table:
            for b in grams(text)[1]:
                into[b] += 1
    S, T = sum(s.values()), sum(t.values())
    out = []
    for d, text in docs:
        n, bs = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in bs)
        h = int(sha(f"42:{'' if d is None else d}")[:8], 16)
        out.append([d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(order[: 5 * len(order) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def test_resampling_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    ws = ["The", "cat", "Élan", "élan", "42", "x_y", "ÄB", "dog", "runs"]
    docs = [(i, " ".join(rng.choice(ws) for _ in range(rng.choice((0, 1, 2, 19, 20, 60))))) for i in range(200)]
    docs += [(7, docs[7][1]), (7, docs[7][1]), (300, None), (301, ""), (302, "!? --"), (None, "a b c " * 30), (303, "word " * 5000)]
    items = [(1, "the cat runs"), (2, None), (3, "Élan 42")]
    spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, bucket string, Weight int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in resample.op13_resample(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute_resample(docs, items)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    assert [r["n_features"] for r in resample.resample(some, none).collect()] == [3]


LEX = toxicity.Lexicon({"idiot$": 4.0, "moron": 3.0})


@pytest.mark.parametrize(
    ("text", "plain", "soft"),
    [
        ("What an idiot.", 4.0, 0.0),
        ("you idiot", 4.5, 0.0),  # a target in the clause
        ("Idiot, you and you!", 4.5, 0.0),  # counts once
        ("He is not an idiot.", 0.0, 4.0),
        ("not that it were of any use, idiot", 4.0, 0.0),  # beyond the negation's scope
        ("She said idiot. A clown.", 0.0, 4.0),
        ("She said nothing. Idiot.", 4.0, 0.0),  # another clause
        ('"idiot"', 4.0, 0.0),
        ("I will kill you", 2.0, 0.0),
        ("I will never kill", 0.0, 1.5),
        ("moronic idiots", 3.0, 0.0),  # a stem, and no whole word
        ("you and they", 0.0, 0.0),
        (None, 0.0, 0.0),
        ("", 0.0, 0.0),
    ],
)
def test_clauses(text, plain, soft):
    heaviest, _, lighter, _ = toxicity.features(text, LEX)
    assert (heaviest, round(math.expm1(lighter), 9)) == (plain, soft)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(600):
        ws = [word() for _ in range(rng.randint(1, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                ws.insert(rng.randrange(len(ws) + 1), rng.choice(("Wretch", "zorg" + word())))
        docs.append((i, " ".join(ws), "s", "mine"))
        labels.append((i, 0, int(toxic)))
    docs += [(1000, None, None, None), (1001, "", None, None), (1002, "zorgling " * 30_000, "s", ""), (5, docs[5][1], "s", "mine"), (None, "wretch wretch", None, None)]
    labels += [(1, 0, None), (None, 0, 1), (77_777, 1, 1)]
    return docs, labels


def test_toxicity_learns_words_and_stems(spark, judged, tmp_path):
    docs, labels = judged
    spark.createDataFrame(docs, "doc_id long, text string, source string, Score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.op11_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    truth = {d: t for d, _, t in labels if t is not None}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[1000] == score[1001] < 0.5 < score[1002]
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1


def test_copies_of_a_toxic_text_teach_no_words(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    copied = "harmless filler stands beside wretch here"
    rows = [(copied, 1)] * 200 + [(f"{word()} wretch {word()}", 1) for _ in range(100)] + [(" ".join(word() for _ in range(20)), 0) for _ in range(300)]
    learned = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "wretch$" in learned and not {e for e in learned if "harmless".startswith(e.rstrip("$")) or "filler".startswith(e.rstrip("$"))}


def test_toxicity_without_labels_and_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "I will kill you", "own", (2,))], "doc_id long, text string, Score string, x struct<`a b`:int>")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score(docs, model)
    row = out.first()
    assert out.columns == ["doc_id", "Score", "x", "_score"] and row["Score"] == "own" and row["x"][0] == 2
    assert model.entries == {} and 0 < row["_score"] < 1
    assert toxicity.score(docs.limit(0), model).collect() == []
