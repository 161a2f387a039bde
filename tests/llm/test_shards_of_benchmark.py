"""A benchmark split over several automata decontaminates as one automaton does."""

import random

from test_corpus import DOCS, prose

from docket.llm import decontaminate


def test_shards_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    items = [prose(rng, 12).split() for _ in range(6)]
    own = lambda n: [f"own{rng.random()}".replace(".", "") for _ in range(n)]
    texts = [items[i] + own(16) + items[j] for i in range(6) for j in range(6) if i != j]  # 24 of 40 words are hit
    texts += [own(40) + items[i][:6] + items[j] + items[i][6:] + own(40) for i in range(6) for j in range(6) if i != j]  # cutting j brings i together
    texts += [own(20), items[0], []]
    rows = [(i, " ".join(ws), "en", "a", 0) for i, ws in enumerate(texts)] + [(999, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)], "item_id long, text string")
    run = lambda: sorted(map(str, decontaminate.decontaminate(docs, bench).collect()))
    whole = run()
    assert len(whole) == 30 + 2 + 1
    monkeypatch.setattr(decontaminate, "MAX_CHARS", 60)
    assert len(list(decontaminate.automata(bench, "item_id", "text", 10))) > 3 and run() == whole
