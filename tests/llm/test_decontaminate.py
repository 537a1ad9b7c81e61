import random

import numpy as np

from factloom.llm import decontaminate
from factloom.llm._text import mix64


def plain_tiles(a, b, least):
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                fa[i : i + best] = fb[j : j + best] = [False] * best
                out.append((i, j, best))


def test_tiles_against_the_plain_algorithm():
    r = random.Random(2)
    for _ in range(300):
        a = [r.randint(1, 3) for _ in range(r.randint(0, 14))]
        b = [r.randint(1, 3) for _ in range(r.randint(0, 20))]
        x, y = (mix64(np.array(v, np.uint64)) for v in (a, b))
        assert decontaminate.tiles(x, y, 2) == plain_tiles(a, b, 2)


def plain_pairs(docs, items):
    import re

    def tok(t):
        return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())

    out = set()
    for d, t in docs:
        for i, u in items:
            a, b = tok(u), tok(t)
            if a and sum(x[2] for x in plain_tiles(a, b, min(decontaminate.SEED_TOKENS, len(a)))) >= decontaminate.COVERAGE * len(a):
                out.add((d, i))
    return out


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards watch from the old tower"
WORDS = ITEM.split()
DOCS = [
    (1, f"Before it. {ITEM} After it."),
    (2, " ".join(WORDS[9:]) + " something between them " + " ".join(WORDS[:9])),
    (3, ITEM.upper().replace(" ", ",\n ")),
    (4, " ".join(WORDS[::2])),
    (5, " ".join(WORDS[:8]) + " nothing else of it at all"),
    (6, None),
    (7, ""),
    (8, "filler words of no use " * 20_000 + ITEM),
    (9, "Two."),
    (None, ITEM),
    (1, f"Before it. {ITEM} After it."),
]
ITEMS = [(10, ITEM), (11, "one two"), (12, None), (13, ""), (14, "!!"), (15, ITEM), (10, ITEM), (16, "two")]


def test_pairs_on_planted_and_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in DOCS], "doc_id long, text string, coverage double")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    want = plain_pairs([x for x in DOCS if x[0] != 8], ITEMS) | {(8, 10), (8, 15)}
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {1, 2, 3, 8, 9, None} == {d for d, _ in want}
    assert len(got) == len(want) + 2  # the repeated document's two
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7]
    monkeypatch.setattr(decontaminate, "SEED_BOUND", 20)  # several blocks
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()} == want
    monkeypatch.undo()
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(DOCS)


def test_query_against_contained_passages(spark, sf):
    import re

    from factloom.llm.queries import op8_decontamination

    def flat(t):
        return f" {' '.join(re.findall(r'[a-z0-9\u0080-\U0010ffff]+', t.lower()))} "

    docs = {r.doc_id: flat(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: flat(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op8_decontamination(spark, sf).collect()}
    assert {(d, i) for d, t in docs.items() for i, u in items.items() if u in t} <= got
