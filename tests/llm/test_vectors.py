"""Vector operators against brute force over whole tables, and their defined cases on small ones."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from ionloom.llm import centroids, queries, vector_codes, vector_dedup
from ionloom.llm.vectors import squared_gaps
from ionloom.session import ship_package

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, code string, w int, cid long, keys int, n long, comp long, id string, h1 int"


@pytest.fixture(scope="module")
def stored(spark):
    ship_package(spark)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    return [(r["vec_id"], r["embedding"], r["label"]) for r in rows]


def odd_rows(dim=64, n=40):
    """Vectors in tight groups, exact copies, repeated and null keys, and rows that no operator may use."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        centre = np.random.default_rng(i % 7).normal(size=dim)
        rows.append((i, (centre + 0.02 * (i % 5) * rng.normal(size=dim)).tolist(), i % 3 if i % 4 else None))
    rows += [(3, rows[3][1], 0), (3, rows[5][1], 0), (None, rows[4][1], 1), (None, [7.0] * dim, None)]
    bad = [None, [], [1.0] * (dim - 1) + [None], [1.0] * (dim - 1) + [NAN], [INF] + [1.0] * (dim - 1), [0.0] * dim, [1.0] * (dim // 2)]
    return rows + [(100 + i, v, i % 2) for i, v in enumerate(bad)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, "y", 6) for r in rows], SCHEMA)


def usable(rows, dim=64):
    return [(k, np.array(v, float), label) for k, v, label in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]


def whole(values):
    return np.floor(np.clip(np.array(values, float) * 1024, -(1 << 27), 1 << 27)).astype(np.int64)


# --- codes ------------------------------------------------------------------------------------------------


def brute_codes(rows, dim=64, entries=256):
    kept = usable(rows, dim)
    ints = whole([v for _, v, _ in kept])
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i].tolist()))
    width = dim // 4
    books = [ints[order[:entries], p * width : (p + 1) * width].copy() for p in range(4)]
    for turn in range(5):
        at, gap = [], []
        for p in range(4):
            d = ((ints[:, None, p * width : (p + 1) * width] - books[p][None]) ** 2).sum(2)
            at.append(d.argmin(1))
            gap.append(d.min(1))
        if turn < 4:
            for p in range(4):
                for e in set(at[p].tolist()):
                    mine = ints[at[p] == e, p * width : (p + 1) * width]
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    error = np.sum(gap, axis=0)
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, error):
        by_label[label] += int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((k, "".join(f"{at[p][i]:02x}" for p in range(4)), int(error[i]), by_label[label], digest)
                   for i, (k, _, label) in enumerate(kept)), key=str)


def test_op11(spark, stored):
    assert sorted(map(tuple, queries.QUERIES["op11_vector_codes"](spark, SF).collect()), key=str) == brute_codes(stored)


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_codes_of_odd_rows(spark, scale):
    rows = [(k, v and [x if x is None else x * scale for x in v], label) for k, v, label in odd_rows()]
    got = sorted(map(tuple, vector_codes.compress(frame(spark, rows)).collect()), key=str)
    assert got == brute_codes(rows)
    few = sorted(map(tuple, vector_codes.compress(frame(spark, rows), entries=5).collect()), key=str)
    assert few == brute_codes(rows, entries=5)


def test_codes_of_nothing(spark):
    for rows in ([], [(1, None, 0), (2, [], 1), (3, [NAN] * 4, 1), (4, [1.0, 2.0, 3.0], 1)]):
        out = vector_codes.compress(frame(spark, rows))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not out.count()


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 90), st.integers(1, 6), st.integers(0, 40), st.integers(2, 6), st.integers(1, 12), st.integers(0, 9999))
def test_tree_equals_a_scan(n, dim, spread, fan, leaf, seed):
    rng = np.random.default_rng(seed)
    high = 3 if spread < 20 else 1 << 26  # many ties, or numbers beyond doubles
    entries, asked = rng.integers(-high, high, (n, dim)), rng.integers(-high, high, (50, dim))
    index, gap = vector_codes.Gnat(entries, fan, leaf).nearest(asked)
    full = ((asked[:, None].astype(object) - entries[None]) ** 2).sum(2)
    assert index.tolist() == full.argmin(1).tolist() and gap.tolist() == full.min(1).tolist()


def test_tree_skips_children():
    rng = np.random.default_rng(1)
    clouds = (rng.integers(-20, 20, (256, 8)) + 1000 * rng.integers(0, 40, (256, 1))).astype(np.int64)
    tree = vector_codes.Gnat(clouds)
    tree.nearest(clouds)
    assert tree.measured < 0.6 * len(clouds) ** 2


# --- centroids --------------------------------------------------------------------------------------------


def brute_centroids(rows, k=8, rounds=10, dim=64, salt="3"):
    kept = usable(rows, dim)
    ints = whole([v for _, v, _ in kept])
    sha = lambda key: hashlib.sha256(f"{salt}:{'null' if key is None else key}".encode()).hexdigest()
    order = sorted(range(len(kept)), key=lambda i: (sha(kept[i][0]), ints[i].tolist()))
    centres = ints[order[:k]].copy()
    for turn in range(rounds + 1):
        d = ((ints[:, None] - centres[None]) ** 2).sum(2)
        at = d.argmin(1)
        if turn < rounds:
            for c in set(at.tolist()):
                mine = ints[at == c]
                centres[c] = [int(s) // len(mine) for s in mine.sum(0)]
    gap = d.min(1)
    inertia = [int(gap[at == c].sum()) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    return sorted(((key, int(at[i]), int(gap[i]), inertia[at[i]], int(gap.sum()), digest[at[i]])
                   for i, (key, _, _) in enumerate(kept)), key=str)


def test_op12(spark, stored):
    assert sorted(map(tuple, queries.QUERIES["op12_centroids"](spark, SF).collect()), key=str) == brute_centroids(stored)


@pytest.mark.parametrize("k", [1, 2, 8, 500])
def test_centroids_of_odd_rows(spark, k):
    rows = odd_rows()
    got = sorted(map(tuple, centroids.cluster(frame(spark, rows), k=k, rounds=4).collect()), key=str)
    assert got == brute_centroids(rows, k, 4)


def test_centroids_of_nothing(spark):
    for rows in ([], [(1, None, 0), (2, [1.0], 1)]):
        out = centroids.cluster(frame(spark, rows))
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not out.count()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 4), st.integers(0, 9999), st.sampled_from([4, 60, 1 << 26]))
def test_bounds_never_lose_the_nearest(k, dim, seed, high):
    rng = np.random.default_rng(seed)
    x = rng.integers(-high, high, (200, dim)).astype(np.int32)
    centres = x[rng.integers(0, 200, k)].astype(np.int64)
    state, before = centroids.first_state(x, centroids.Geometry(centres)), centres
    for _ in range(6):
        gaps = squared_gaps(x, before)
        assert state[0].tolist() == gaps.argmin(1).tolist()
        after = before.copy()
        for c in set(state[0].tolist()):
            mine = x[state[0] == c].astype(np.int64)
            after[c] = mine.sum(0) // len(mine)
        state = centroids.next_state(x, *state, centroids.Geometry(after, before))
        before = after
    assert state[0].tolist() == squared_gaps(x, before).argmin(1).tolist()


# --- near copies ------------------------------------------------------------------------------------------


def brute_links(rows, cosine=0.95):
    """(key, n_links, component_id, kept) in the order of the rows."""
    n = len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def plain(v):
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.array(v, float) / np.abs(v).max() if ok else None

    vectors = [plain(v) for _, v, _ in rows]
    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return [(k, links[i], low.get(root(i)), k == low.get(root(i))) for i, (k, _, _) in enumerate(rows)]


def test_op13(spark, stored):
    assert sorted(map(tuple, queries.QUERIES["op13_vector_dedup"](spark, SF).collect())) == sorted(brute_links(stored))


@pytest.mark.parametrize(("dim", "scale"), [(64, 1.0), (64, 1e-170), (64, 1e170), (5, 1.0), (1, 1.0)])
def test_links_of_odd_rows(spark, dim, scale):
    rows = [(k, v and [x if x is None else x * scale for x in v], label) for k, v, label in odd_rows(dim)]
    got = vector_dedup.near_vectors(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_links(rows), key=str)


def test_large_groups_in_blocks(spark, monkeypatch):
    """Blocks far smaller than the groups: every link is counted once, whatever buckets and blocks it meets in."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        centre = np.random.default_rng(i % 3).normal(size=16)
        rows.append((i, (centre + 0.12 * rng.normal(size=16)).tolist(), 0))
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    got = sorted(map(tuple, vector_dedup.near_vectors(frame(spark, rows)).collect()))
    want = sorted(brute_links(rows))
    assert sum(r[1] for r in want) > 20_000
    found = sum(r[1] for r in got) / sum(r[1] for r in want)
    assert 0.998 < found <= 1
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and [g[2:] for g in got] == [w[2:] for w in want]


def test_recall_at_the_threshold(spark):
    """Pairs placed just above the threshold, the hardest ones: the planned share is found."""
    rng = np.random.default_rng(4)
    a = vector_dedup.units(rng.normal(size=(1500, 64)))
    b = rng.normal(size=(1500, 64))
    b = vector_dedup.units(b - (b * a).sum(1)[:, None] * a)
    near = 0.9501 * a + np.sqrt(1 - 0.9501**2) * b
    far = 0.9499 * a + np.sqrt(1 - 0.9499**2) * b
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, near]))]
    links = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(frame(spark, rows)).collect()}
    assert sum(links[i] for i in range(1500)) >= 1490
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, far]))]
    assert not any(r["n_links"] for r in vector_dedup.near_vectors(frame(spark, rows)).collect())


def test_links_of_nothing(spark):
    assert not vector_dedup.near_vectors(frame(spark, [])).count()
    got = vector_dedup.near_vectors(frame(spark, [(1, None, 0), (None, [0.0], 1)])).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 1, True), (None, 0, None, True)]


def test_tables_follow_the_number_of_vectors():
    assert vector_dedup.plan(50_000, 64, 0.95, 0.999)[0] == 3
    hashes, tables = vector_dedup.plan(10**10, 64, 0.95, 0.999)
    assert hashes >= 5 and tables > 3
