"""Near-copy stage of the pipeline against brute force on pairs."""

import random
from collections import Counter

import pytest
from test_corpus import DOCS, prose, union

from docket.llm import near, simhash


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("block", [near.BLOCK, 3])
def test_stage_drops_copies_of_similarity_eight_tenths(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng, rows = random.Random(8), []
    for g in range(12):
        words = prose(rng, 60 + 30 * g).split()
        for k in range(5):  # from equal to far less than 0.8
            ws = list(words)
            for at in rng.sample(range(len(ws)), k * len(ws) // 60):
                ws[at] = f"x{rng.random()}"
            rows.append((10 * g + k, " ".join(ws).upper() if k == 1 else " ".join(ws), "en", "a", 0))
    hot = prose(rng, 200).split()
    rows += [(500 + i, " ".join(hot[: 200 - i] + [f"y{i}z{j}" for j in range(i)]), "en", "a", 0) for i in range(40)]  # a chain
    rows += [(600, None, "en", "a", 0), (601, " ", "en", "a", 0), (602, "One two", "en", "a", 0), (603, "one  TWO", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    sets = [brute_set(r[1]) for r in rows]
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b])])
    fps = [simhash.fingerprint(r[1]) for r in rows]
    assert any(similar(sets[a], sets[b]) and ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() > 3 for a in range(len(rows)) for b in range(a))
    assert {r["doc_id"] for r in simhash.stage(spark, docs, "").collect()} == {rows[r][0] for r in root}


def test_keys_of_chunks_are_those_of_the_whole(monkeypatch):
    found = near.shingles(prose(random.Random(1), 300))
    whole = near.keys(found)
    monkeypatch.setattr(near, "CHUNK", 7)
    assert near.keys(found) == whole and len(set(whole)) == near.BANDS


def test_stage_keeps_rows_apart(spark):
    """Null and repeated ids, one id with two texts, repeated rows, columns of internal names."""
    a, b, c = (prose(random.Random(i), 60) for i in range(3))
    rows = [(None, a), (None, b), (1, c), (1, c), (2, "one text"), (2, "quite another text"), (3, a), (4, c + " x"), (None, None), (5, "")]
    names = ["th", "_th", "at", "node", "of_id", "keys"]
    docs = spark.createDataFrame([(i, t, *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = simhash.stage(spark, docs.repartition(3), "")
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(None, b), (1, c), (2, "one text"), (2, "quite another text"), (3, a), (5, "")])
    assert [r["th"] for r in kept.collect() if r["doc_id"] == 1] == ["th2"]
    assert simhash.stage(spark, docs.limit(0), "").count() == 0
