"""Registered queries look at whole texts and whole tables."""

import pytest

from factloom.plans import registry


@pytest.fixture
def made(spark, tmp_path):
    """A folder with documents of given (doc_id, text, n_chars), none of them labelled."""

    def write(rows):
        path = str(tmp_path / "sf")
        spark.createDataFrame([(i, t, "en", "web", n) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
        return path

    return write


HEAD = " ".join(f"word{k}" for k in range(80))


@pytest.mark.parametrize("name", ["audn_sequential", "audn_batch"])
def test_audn_sees_what_a_long_text_adds(spark, made, name):
    sf = made([(0, HEAD, 1), (97, f"{HEAD} and more", 1)])
    assert {r.fact_id: r.action for r in registry.QUERIES[name](spark, sf).collect()} == {0: "ADD", 97: "UPDATE"}


def test_greedy_walk_compares_whole_texts(spark, made):
    tail = [" ".join(f"{w}{k}" for k in range(300)) for w in ("one", "two")]
    sf = made([(0, f"{HEAD} {tail[0]}", 11), (11, f"{HEAD} {tail[1]}", 11), (22, f"other start {HEAD} {tail[1]}", 11)])
    rows = registry.QUERIES["greedy_distinct_facts"](spark, sf).collect()
    assert len(rows) == 2


def test_noise_is_stripped_anywhere(spark, made):
    sf = made([(0, f"{HEAD} {'ACGT' * 20} end", 1)])
    text = registry.QUERIES["stripped_noise"](spark, sf).first().text
    assert text.split() == [*HEAD.split(), "[sequence]", "end"]


def test_hard_pairs_of_the_whole_table(spark, made):
    from collections import Counter

    from factloom.plans.lifecycle import TENSIONS
    from factloom.sources.domain import active

    sf = made([(5000 + i, f"fact {i}", 1) for i in range(1500)])
    of = {r.fact_id: (r.predicate, r.created_at) for r in active(spark, sf).collect()}
    by = {}
    for i in sorted(of, key=lambda i: (of[i][1], i)):
        by.setdefault(of[i][0], []).append(i)
    rows = registry.QUERIES["hard_pairs"](spark, sf).collect()
    got = {k: [(r.a, r.b) for r in rows if r.kind == k] for k in ("same predicate", "tension", "control")}
    assert sorted(got["same predicate"]) == sorted((g[i], g[j]) for g in by.values() for i in range(min(len(g) - 1, 5)) for j in range(i + 1, min(len(g), i + 3)))
    assert Counter((of[a][0], of[b][0]) for a, b in got["tension"]) == Counter(p for p in TENSIONS if p[0] in by and p[1] in by)
    assert sorted(a for a, _ in got["control"]) == sorted(of) == sorted(b for _, b in got["control"])
    assert all(a != b for a, b in got["control"])
    assert sorted(rows) == sorted(registry.QUERIES["hard_pairs"](spark, sf).collect())


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """A folder with 420 embeddings, some of them equal, and the matrix of their cosines."""
    import numpy as np

    x = np.random.default_rng(2).normal(size=(420, 8))
    x[300:310] = x[0:10]
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, i % 5, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return path, x @ x.T


@pytest.mark.parametrize("name, k, labels", [("vector_top_k_all", 10, range(5)), ("filtered_vector_top_k_all", 5, (1, 2, 3))])
def test_every_fiftieth_row_is_searched_in_all(spark, vectors, name, k, labels):
    path, s = vectors
    want = {(q, i, r + 1) for q in range(0, 420, 50) for r, i in enumerate(sorted((i for i in range(420) if i % 5 in labels), key=lambda i: (-round(s[q, i], 12), i))[:k])}
    got = {(r.claim_id, r.vec_id, r.rank) for r in registry.QUERIES[name](spark, path).collect()}
    assert {g[0] for g in got} == set(range(0, 420, 50)) and len(got & want) >= len(want) - 2  # equal vectors may change places


def test_routes_by_all_other_rows(spark, vectors):
    path, s = vectors
    best = {q: max(s[q, i] for i in range(420) if i != q) for q in range(0, 420, 50)}
    got = {r.vec_id: r.route for r in registry.QUERIES["routing_of_candidates_all"](spark, path).collect()}
    assert got == {q: "decide" if b > 0.85 else "add .6" if b >= 0.3 else "add .8" for q, b in best.items()}


def test_statistics_of_all_pairs(spark, vectors):
    import numpy as np

    from factloom.operators.knn import pair_statistics

    path, s = vectors
    v = s[np.triu_indices(420, 1)]
    r = registry.QUERIES["pair_statistics_all"](spark, path).first()
    want = [len(v), v.mean(), np.median(v), v.std(), v.min(), v.max(), *((v >= t).sum() for t in (0.8, 0.85, 0.9, 0.95)), 1 - v.mean()]
    assert list(r) == pytest.approx(want, abs=1e-9)
    split = pair_statistics(spark.read.parquet(f"{path}/embeddings.parquet"), "vec_id", "embedding", (0.8,), parts=3, held=5)
    assert split["median"] == pytest.approx(np.median(v), abs=1e-12) and split["n"] == len(v)


def test_a_search_holds_tiles_of_its_products(spark, monkeypatch):
    """4000 queries against a batch of 10000 items: 320 MB of products, were they held at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    from factloom.operators.knn import knn

    ran = []
    search = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, run, kind: ran.append(run) or search(df, run, kind))
    x = np.random.default_rng(3).normal(size=(10_000, 8))
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:4000])], "q long, v array<double>")
    knn(queries, spark.createDataFrame([], "i long, v array<double>"), "q", "i", "v", 3)
    batch = pa.RecordBatch.from_pydict({"i": np.arange(len(x)), "v": list(x)})
    tracemalloc.start()
    found = list(ran[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best = {int(q): int(i) for b in found for q, i in list(zip(b.column("q").to_numpy(), b.column("i").to_numpy()))[::3]}
    assert len(best) == 4000 and all(q == i for q, i in best.items())
    assert peak < 150e6


def test_equal_vectors_go_by_id(spark, tmp_path):
    """As in SQL: products of equal vectors are equal, wherever they lie in a block."""
    import duckdb
    import numpy as np

    x = np.random.default_rng(4).normal(size=(60, 64)).astype(np.float32)
    rows = [(i, i % 5, x[i * 7 % 60].tolist()) for i in range(2500)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("vector_top_k", "filtered_vector_top_k", "best_match"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        cur = con.execute(registry.ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(map(tuple, df.select(*cols).collect())) == sorted(cur.fetchall()), name


@pytest.fixture
def blocks(monkeypatch):
    """Blocks of ten rows, 80 at most; gets the rows that went to each call of Python in groups."""
    from pyspark.sql import GroupedData

    from factloom.operators import knn

    monkeypatch.setattr(knn, "BLOCK_ROWS", 10)
    monkeypatch.setattr(knn, "MOST_BLOCK_ROWS", 80, raising=False)
    sent, apply = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda g, *a, **k: sent.append(g._df.count()) or apply(g, *a, **k))
    return sent


@pytest.mark.parametrize("name", ["pair_statistics", "labelled_pairs", "pair_sweep", "candidate_pairs"])
def test_pairs_meet_in_blocks(spark, vectors, blocks, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{vectors[0]}/embeddings.parquet/*.parquet'")
    cur = con.execute(registry.ORACLES[name])
    want = cur.fetchall()
    df = registry.QUERIES[name](spark, vectors[0]).select(*[d[0] for d in cur.description])
    got = df.collect()
    assert len(got) == len(want) and all(tuple(g) == pytest.approx(w, abs=2e-6) for g, w in zip(sorted(got), sorted(want)))
    assert blocks and max(blocks) <= 8 * 420
    if name != "candidate_pairs":
        assert not any(x in str(df._jdf.queryExecution().toString()) for x in ("SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct"))


def test_statistics_send_each_row_to_few_blocks(spark, vectors, blocks):
    registry.QUERIES["pair_statistics_all"](spark, vectors[0])
    assert len(blocks) == 2 and max(blocks) <= 8 * 420


def test_a_median_between_two_heaps(spark):
    """The two middle values lie far apart, and most values are equal."""
    from factloom.operators.knn import pair_statistics

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])], "i long, v array<double>")
    assert pair_statistics(df, "i", "v", (0.5,), held=1) == {"n": 6, "mean": 0.0, "median": 0.0, "sd": 1.0, "least": -1.0, "most": 1.0, "over": [3]}
    assert pair_statistics(df.limit(0), "i", "v", (0.5,))["n"] == 0


def test_mcnemar_counts_every_document(spark, made):
    r = registry.QUERIES["mcnemar_all"](spark, made([(i, "x", 1) for i in range(500)])).first()
    want = [sum((i % 3 == 0, i % 5 == 0) == o for i in range(500)) for o in ((True, True), (True, False), (False, True), (False, False))]
    assert [r.both, r.only_a, r.only_b, r.neither] == want and 0 <= r.p <= 1
