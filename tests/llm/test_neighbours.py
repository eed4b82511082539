"""Near duplicates and neighbour search against brute force."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scourframe.llm import common, descent, forest, minhash
from tests.llm.conftest import SF, TEXTS

SMALL = "/root/testdata/sf0.01"
UPPER = bytes(range(65, 91))


def grouped(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def set_of(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(UPPER, UPPER.lower())))
    size = min(size, len(words))
    return {tuple(words[i: i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(docs, size, percent=80):
    sets = {i: set_of(t, size) for i, t in docs.items()}
    names = sorted(sets)
    links = [(a, b) for k, a in enumerate(names) for b in names[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, grouped(names, links)


@pytest.mark.parametrize("size", [2, 5])
def test_documents_against_brute_force(spark, size):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    sets, want = brute({r.doc_id: r.text for r in table.collect()}, size)
    rows = minhash.near_duplicates(table, size).collect()
    assert len(rows) == len(sets)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_op5(spark):
    sets, want = brute({r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op5_minhash_near_dedup(spark, SF).collect()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_chains_whose_ends_differ(spark):
    words = [f"w{i}" for i in range(60)]
    docs = {k: " ".join(words[:k] + [f"x{i}" for i in range(k)] + words[k:]) for k in range(0, 12)}
    docs |= {100 + k: " ".join(words[3 * k: 3 * k + 40]) for k in range(7)}
    _, want = brute(docs, 2)
    rows = minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_documents_of_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd, 2).collect()
    assert len(rows) == len(TEXTS)
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert got[6] == {(7, 1, False)} and got[1] == {(7, 1, True)}
    assert got[7] == {(1, 7, True)} and got[8] == {(1, 7, False)}
    assert got[2] == {(0, 2, True)} and got[3] == {(0, 3, True)} and got[4] == {(0, 4, True)}
    assert {x[1:] for x in got[None]} == {(None, False)}
    assert minhash.near_duplicates(none, 2).count() == 0


def test_packed_bits_estimate_similarity(spark):
    draw = np.random.default_rng(4)
    pool = draw.integers(1 << 63, size=3000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.9):
        same = int(1000 * 2 * share / (1 + share))
        a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:same], pool[1000: 2000 - same]]))
        rows = spark.createDataFrame([([int(x) for x in minhash.signature(a)[1]], [int(x) for x in minhash.signature(b)[1]])], "a array<long>, b array<long>")
        assert abs(rows.select(minhash.alike(F.col("a"), F.col("b"))).first()[0] - share) < 0.17


def test_components_of_paths_and_stars(spark):
    draw = np.random.default_rng(6)
    links = [(i, i + 1) for i in range(0, 50)] + [(100, 100 + i) for i in range(1, 40)] + [(int(a), int(b)) for a, b in draw.integers(200, 300, (60, 2))]
    nodes = {x for pair in links for x in pair if pair[0] != pair[1]}
    want = grouped(nodes, [p for p in links if p[0] != p[1]])
    rows = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_settle_by_what_is_told_while_links_are_written(spark, monkeypatch):
    links = [(i, i + 1) for i in range(300) if i % 100 != 99] + [(7, 7), (8, 7), (None, 5)]
    table = spark.createDataFrame(links, "a long, b long")
    asked, kind = [], type(table)
    monkeypatch.setattr(kind, "first", lambda self, f=kind.first: (asked.append(1), f(self))[1])
    rows = {(r.node, r.component) for r in common.components(table).collect()}
    assert rows == {(i, i // 100 * 100) for i in range(300)} and not asked


VECTORS = "vec_id long, embedding array<float>, label int, n_links string, u long, x int"


def odd_vectors(spark):
    bad = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [None]), (903, [float("nan")] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7), (905, [])]
    rows = [(i, x, 1, "c", 1, 1) for i, x in bad] + [(None, [1.0] * 8, 1, "c", 1, 1), (906, [1.0] * 8, None, "c", 1, 1)]
    return rows + [(10, [1.0] * 8, 1, "c", 1, 1), (10, [1.0] * 8, 1, "c", 1, 1), (11, [2.0] * 8, 1, "c", 1, 1), (12, [1.0] * 8, 2, "c", 1, 1), (13, [1.0] * 8, 1, "c", 1, 1)]


def test_vectors_against_brute_force(spark):
    draw = np.random.default_rng(8)
    base = draw.normal(size=(300, 8))
    crowd = draw.normal(size=8) + 0.12 * draw.normal(size=(70, 8))
    near = base[:60] + 0.15 * draw.normal(size=(60, 8))
    x = np.concatenate([base, crowd, near]).astype(np.float32)
    label = [0 if 300 <= i < 370 else int(i % 300 % 3) for i in range(len(x))]
    rows = [(i, [float(v) for v in own], label[i], "c", 1, 1) for i, own in enumerate(x)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(link, False)
    want = grouped(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(link)) if a < b])
    got = descent.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows)
    assert sum(r.n_links == link[r.vec_id].sum() for r in got) >= 0.98 * len(rows)
    assert all(r.n_links <= link[r.vec_id].sum() for r in got)
    assert sum(r.component_id == want[r.vec_id] for r in got) >= 0.98 * len(rows)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got)


def test_vectors_of_odd_rows(spark):
    rows = odd_vectors(spark)
    table = spark.createDataFrame(rows, VECTORS)
    got = defaultdict(set)
    for r in descent.near_vectors(table).collect():
        got[r.vec_id].add((r.n_links, r.component_id, r.kept))
    assert got[10] == {(2, 10, True)} and got[11] == {(2, 10, False)} and got[13] == {(2, 10, False)} and got[12] == {(0, 12, True)}
    assert all(got[i] == {(0, i, True)} for i in (900, 901, 902, 903, 904, 905, 906)) and got[None] == {(0, None, False)}
    assert descent.near_vectors(table.filter("false")).count() == 0
    assert descent.near_vectors(table.filter("vec_id >= 900")).count() == 7


def test_op2_on_given_rows(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r.label for r in table])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want = dict(zip([r.vec_id for r in table], link.sum(axis=1)))
    assert {r.vec_id: r.n_links for r in descent.op2_nn_descent(spark, SMALL).collect()} == want


def turned(draw, x, cosine):
    """Unit vectors of exactly this cosine to the given unit vectors."""
    other = draw.normal(size=x.shape)
    other -= (other * x).sum(axis=1)[:, None] * x
    return cosine * x + math.sqrt(1 - cosine * cosine) * other / np.linalg.norm(other, axis=1)[:, None]


def pairs_beside_a_large_label():
    """40 rows of label 1, 300 pairs just above the bound of label 2 (i and 1000 + i), and 20,000 rows of label 3."""
    draw = np.random.default_rng(12)
    few, base, many = (draw.normal(size=(n, 16)) for n in (40, 300, 20_000))
    base /= np.linalg.norm(base, axis=1)[:, None]
    parts = [(10_000, few, 1), (0, base, 2), (1000, turned(draw, base, 0.9305), 2), (20_000, many, 3)]
    return [(first + i, [float(v) for v in x], label, 1) for first, rows, label in parts for i, x in enumerate(rows)]


def test_first_lists_do_not_depend_on_other_labels(spark):
    common.ship(spark)
    nodes = spark.createDataFrame(pairs_beside_a_large_label(), "u long, x array<double>, label long, n long")
    sizes = nodes.groupBy("label").agg(F.count("*").alias("rows"))
    lists = descent.first_lists(nodes, sizes, 16, 0.93).filter("size(near) > 0 and u < 20000").select("u", "near.w").collect()
    assert len({r.u for r in lists if r.u >= 10_000}) == 40
    assert len({r.u for r in lists if r.u < 1000 and r.u + 1000 in r.w}) >= 297


def cone_with_pairs():
    """6,000 rows of a narrow cone, below the bound to each other but for 200 close pairs (i and 10000 + i)."""
    draw = np.random.default_rng(14)
    x = draw.normal(size=64)
    x = 2 * x / np.linalg.norm(x) + draw.normal(size=(5800, 64)) / 8
    x /= np.linalg.norm(x, axis=1)[:, None]
    parts = [(0, x), (10_000, turned(draw, x[:200], 0.985))]
    return [(first + i, [float(v) for v in own], 1, 1) for first, part in parts for i, own in enumerate(part)]


def test_first_lists_of_a_narrow_cone(spark):
    common.ship(spark)
    nodes = spark.createDataFrame(cone_with_pairs(), "u long, x array<double>, label long, n long")
    lists = descent.first_lists(nodes, nodes.groupBy("label").agg(F.count("*").alias("rows")), 64, 0.93).filter("u < 200").select("u", "near.w").collect()
    assert len({r.u for r in lists if r.u + 10_000 in r.w}) >= 194


def test_audit_is_not_outweighed_by_a_crowd(spark, monkeypatch):
    """A crowd of near-equal vectors beside pairs that neither tables nor rounds find: the audit must see that; comparison of all finds them."""
    draw = np.random.default_rng(13)
    crowd = draw.normal(size=16) + 0.02 * draw.normal(size=(1200, 16))
    base = draw.normal(size=(300, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    parts = [(0, base), (1000, turned(draw, base, 0.9305)), (10_000, crowd)]
    rows = [(first + i, [float(v) for v in x], 1, "c", 1, 1) for first, part in parts for i, x in enumerate(part)]
    table = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    plain = descent.joined_runs

    def crowds_only(df, *rest):
        return plain(df.filter("u >= 10000"), *rest)

    monkeypatch.setattr(descent, "joined_runs", crowds_only)
    monkeypatch.setattr(descent, "TURNS", 1)
    got = {r.vec_id: r for r in descent.near_vectors(table).collect()}
    assert all(got[10_000 + i].n_links >= 1199 for i in range(1200)) and 0.5 < got[0].recall < 0.8 and got[0].recall_low < got[0].recall
    got = {r.vec_id: r for r in descent.near_vectors(table, exact=True).collect()}
    assert all(got[i].n_links >= 1 and got[1000 + i].n_links >= 1 for i in range(300)) and got[0].recall == 1


@pytest.mark.parametrize("n, pairs", [(50, 3), (50, 20), (3000, 100), (3000, 1200), (60_000, 300)])
def test_links_are_found_by_rounds_in_labels_of_any_size(spark, monkeypatch, n, pairs):
    """Planted pairs just above the bound, few and many: rounds run, no label is compared whole, and the links are those of brute force."""
    draw = np.random.default_rng(n + pairs)
    x = draw.normal(size=(n - pairs, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = np.concatenate([x, turned(draw, x[:pairs], 0.935)])
    want = np.zeros(n, int)
    for at in range(0, n, 2000):
        link = x[at: at + 2000] @ x.T >= 0.93
        want[at: at + 2000] = link.sum(axis=1) - 1
    assert (want > 0).sum() >= 2 * pairs
    rounds, whole = [], []
    plain, compare = descent.refined, descent.compared
    monkeypatch.setattr(descent, "refined", lambda *args: rounds.append(1) or plain(*args))
    monkeypatch.setattr(descent, "compared", lambda nodes, asked, *rest: whole.append(asked.count()) or compare(nodes, asked, *rest))
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in descent.near_vectors(table).collect()}
    linked = np.flatnonzero(want)
    assert len(rounds) >= descent.ROUNDS and len(whole) == 1 and whole[0] <= 1.2 * descent.AUDITED
    assert np.mean([got[i].n_links == want[i] for i in linked.tolist()]) >= 0.99 and all(got[i].n_links <= want[i] for i in range(n))
    assert got[0].recall is None or got[0].recall >= 0.99


def test_every_query_gets_all_candidates_if_there_are_few(spark):
    draw = np.random.default_rng(15)
    few = [(i, [float(v) for v in draw.normal(size=8)], 1, "c", 1, 1) for i in range(18)]
    table = spark.createDataFrame(few + [(100, [1.0] * 8, 1, "c", 1, 1), (101, [1.0] * 8, 1, "c", 1, 1)], VECTORS)
    got = defaultdict(set)
    for r in forest.search(table, F.col("vec_id") % 2 == 0, 20, target=0.5).collect():
        got[r.query_id].add(r.vec_id)
    names = {*range(18), 100, 101}
    assert got == {q: names - {q} for q in names if q % 2 == 0}


def test_op10_recall_and_scores(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    names, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    place = {v: i for i, v in enumerate(names)}
    got = defaultdict(list)
    for r in forest.op10_projection_forest(spark, SMALL).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    asking = [v for v in names if v % 20 == 0]
    assert sorted(got) == sorted(asking)
    hits = 0
    for v in asking:
        scores = x @ x[place[v]]
        scores[place[v]] = -np.inf
        best = names[np.lexsort((names, -scores))[:20]]
        own = sorted(got[v])
        assert [r for r, *_ in own] == list(range(1, 21))
        assert own == sorted(own, key=lambda o: (-o[2], o[1])) and all(abs(s - scores[place[i]]) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(best))
    assert hits >= 0.9 * 20 * len(asking)


def test_search_of_odd_rows(spark):
    table = spark.createDataFrame(odd_vectors(spark), VECTORS).unionByName(spark.createDataFrame([(20, [3.0] * 8, 1, "c", 1, 1), (40, [-1.0] * 8, 1, "c", 1, 1)], VECTORS))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in forest.search(table, F.col("vec_id") % 20 == 0, 3).collect())
    assert [(q, k, v) for q, k, v, _ in got] == [(20, 1, 11), (20, 2, 10), (20, 3, 12), (40, 1, 10), (40, 2, 12), (40, 3, 13)]
    assert [s for q, *_, s in got if q == 20] == [48.0, 24.0, 24.0]
    assert forest.search(table.filter("false"), F.col("vec_id") % 20 == 0, 3).count() == 0
    assert forest.search(table.filter("vec_id > 899"), F.lit(True), 3).filter("query_id <> 906").count() == 0


@pytest.mark.parametrize("flat", [False, True])
def test_crowded_leaves_are_cut_again(spark, monkeypatch, flat):
    """Two stages below a shallow sample; 900 equal rows, which no cut can part, and clusters. Leaves stay small and recall holds."""
    for name, value in (("DEEPEST", 2), ("LEAF", 16), ("CROWDED", 64), ("STEP", 3), ("OWN", 256), ("BLOCK_ROWS", 256), ("BLOCK_QUERIES", 64)):
        monkeypatch.setattr(forest, name, value)
    stages = []
    recut = forest.recut

    def seen(*args):
        stages.append(recut(*args))
        return stages[-1]

    monkeypatch.setattr(forest, "recut", seen)
    draw = np.random.default_rng(21)
    centers = draw.normal(size=(60, 16))
    x = (draw.normal(size=(6000, 16)) if flat else centers[draw.integers(0, 60, 6000)] + 0.15 * draw.normal(size=(6000, 16))).astype(np.float32).astype(float)
    x[5100:] = x[5100]
    table = spark.createDataFrame([(i, row.tolist(), 1, "c", 1, 1) for i, row in enumerate(x)], VECTORS)
    got = defaultdict(list)
    for r in forest.search(table, F.col("vec_id") % 20 == 0, 10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert len(stages) >= 2
    for own, leaves, _, _ in stages:
        assert {r.leaf: r["rows"] for r in leaves.collect()} == {r.leaf: r["count"] for r in own.groupBy("leaf").count().collect()}
    last = stages[-1][1].filter("not crowded").collect()
    assert all(r["rows"] <= 64 or r["rows"] >= 900 for s in stages for r in s[1].filter("not crowded").collect()) and last
    hits = total = 0
    for v in range(0, 6000, 20):
        scores = x @ x[v]
        scores[v] = -np.inf
        best = np.lexsort((np.arange(6000), -scores))[:10]
        own = sorted(got[v])
        assert [r for r, *_ in own] == list(range(1, 11)) and len({i for _, i, _ in own}) == 10
        assert own == sorted(own, key=lambda o: (-o[2], o[1])) and all(abs(s - scores[i]) < 1e-9 for _, i, s in own)
        hits, total = hits + len({i for _, i, _ in own} & set(best.tolist())), total + 10
    assert hits >= 0.9 * total


def test_costs_of_leaves_by_path_and_by_queue():
    draw = np.random.default_rng(4)
    sample, asked = draw.normal(size=(500, 6)), draw.normal(size=(5, 6))
    trees = forest.plant(sample, 500, (sample ** 2).sum(axis=1).max(), trees=2, leaf=20)
    size, values = 1 << trees.depth, trees.projected(asked, query=True)
    held = np.bincount(np.concatenate([t * size + own for t, own in enumerate(trees.leaves(sample))]), minlength=2 * size)
    node = np.arange(size) + size
    for i in range(5):
        far = np.concatenate([forest.crossed(values[t][i][None, None, :], node, np.stack([trees.cuts[t][node >> up] for up in range(trees.depth, 0, -1)], axis=1))[0] for t in range(2)])
        order = trees.nearest_leaves(values[:, i], 2 * size, held)
        assert sorted(order) == np.flatnonzero(held).tolist() and (np.diff(far[order]) >= 0).all()


def test_visits_do_not_grow_with_the_leaves(spark, monkeypatch):
    """Random directions: many small leaves would be visited, so queries visit the nodes above them, with no less recall."""
    monkeypatch.setattr(forest, "LEAF", 8)
    monkeypatch.setattr(forest, "VISITS", 6)
    x = np.random.default_rng(12).normal(size=(2000, 24))
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found, audited = [], forest.audited
    monkeypatch.setattr(forest, "audited", lambda *args: found.append(audited(*args)) or found[-1])
    near = defaultdict(list)
    for r in forest.search(table, F.col("vec_id") % 20 == 0, 10).collect():
        near[r.query_id].append(r.vec_id)
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9
    assert found[0] > 6 >= found[-1]
    scores = x[::20] @ x.T
    scores[np.arange(100), np.arange(0, 2000, 20)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :10]
    assert np.mean([len(set(near[20 * i]) & set(row.tolist())) for i, row in enumerate(want)]) >= 9
