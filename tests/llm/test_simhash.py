"""SimHash near-duplicates against all pairs."""

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import simhash_dedup
from factloom.llm.components import connected_components
from factloom.llm.queries import op10_simhash_dedup


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "É", "é", " ", "\n", "\x0b", "\x85", "word", "Word"]), max_size=30).map("".join))
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) == plain_fingerprint(text)


def test_spark_agrees_on_the_hash(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_golay_keys_meet_within_two_bits():
    r = np.random.default_rng(0)
    u = r.integers(0, 2**64, 4000, dtype=np.uint64)
    for bits in (1, 2):
        v = u.copy()
        for k in range(len(v)):
            for b in r.choice(64, bits, replace=False):
                v[k] ^= np.uint64(1 << int(b))
        met = set(zip(*map(np.ndarray.tolist, simhash_dedup.keys(u)))) & set(zip(*map(np.ndarray.tolist, simhash_dedup.keys(v))))
        assert {k for k, _ in met} == set(range(len(u)))


def plain_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and (fps[i] ^ fps[j]).bit_count() <= 2] for i in range(len(rows))]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, js in enumerate(near):
        for j in js:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{fps[i]:016x}", len(near[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def key(r):
    return tuple(map(str, r))


def test_query_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r[c] for c in ("doc_id", "fingerprint", "n_near", "component_id")) for r in op10_simhash_dedup(spark, sf).collect()]
    assert sorted(got, key=key) == sorted(plain_groups([tuple(r) for r in docs]), key=key)


def test_near_fingerprints_chain(spark, monkeypatch):
    """Chains of fingerprints one or two bits apart, copies and ties, by all pairs."""
    r = np.random.default_rng(1)
    fps, cur = [], 0x0123456789ABCDEF
    for k in range(60):
        cur = cur if k % 4 == 0 else cur ^ (1 << int(r.integers(64))) if k % 5 else int(r.integers(2**63))
        fps.append(cur)
    classes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in set(fps)], "fp long")
    got = {(x.a, x.b) for x in simhash_dedup.class_links(classes).collect()}
    signed = [x.fp for x in classes.collect()]
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 70)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3)]
    got = {(r.node, r.root) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(1, 71)} | {(i, 100) for i in range(100, 150)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [(5, None), (4, ""), (4, " "), (None, "x y z"), (9, "x Y z"), (9, "x Y z"), (2, "other words stand here"), (None, "alone"), (3, "w " * 50_000)]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in ROWS], "doc_id long, text string, fingerprint string")
    got = [tuple(r) for r in simhash_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(plain_groups(ROWS), key=key)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "3", "4", "9", "None"]
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert simhash_dedup.keep_one(docs.limit(0)).count() == 0
