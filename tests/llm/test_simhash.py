import random
import time
from collections import Counter

import numpy as np
import xxhash

from mnemoframe.llm import simhash


def plain_fingerprint(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=4, also=lambda i, j: True):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and (fps[i] == fps[j] or also(ids[i], ids[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(ids)):
        best[find(i)] = min(best.get(find(i), ids[i]), ids[i])
    return {ids[i]: best[find(i)] for i in range(len(ids))}


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 40, 300):
        text = " ".join(rng.choice(["The", "a", "Éa", "Xy", "b\u00a0c"]) + rng.choice(["", "\n", "\t"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
        assert simhash.fingerprint(text.encode(), 5) == plain_fingerprint(text, 5)


def test_links_find_every_component(spark):
    """Random clusters, chains and a dense ball of several hundred fingerprints."""
    rng = random.Random(2)
    fps = {0}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 5)):
            fps.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    fps |= {ball ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for _ in range(400)}
    fps = sorted(fps)
    ids = list(range(len(fps)))
    nodes = spark.createDataFrame([(i, simhash._signed(f)) for i, f in zip(ids, fps)], "id long, fp long")
    want = plain_components(ids, fps)
    got = {r.id: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    assert all(got.get(i, i) == want[i] for i in ids)
    edges = simhash.links(nodes).count()
    assert edges < 60 * len(fps)  # not all pairs of the ball


def test_plan_is_exact_at_any_size():
    for n in (10, 10**6, 10**9, 10**11):
        blocks, take = simhash.plan_blocks(n, 4)
        assert blocks - take == 4


def test_large_bucket_equals_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(150)])
    ids = np.arange(150)
    edges = simhash._bucket_edges(ids, fps, simhash.pivot_table(fps, simhash.pivots()), 4)
    want = plain_components(ids.tolist(), [int(x) for x in fps])
    root = {i: i for i in ids.tolist()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert Counter(find(i) for i in root) == Counter(want.values())


def test_groups_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = plain_components(sorted(fps), [fps[i] for i in sorted(fps)])
    got = simhash.near_groups(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.fp & (2**64 - 1) == fps[r.doc_id] for r in got)


def test_wide_radius_is_verified(spark):
    """Near copies beyond four bits are found, and fingerprints that are near by chance part again."""
    rng = random.Random(8)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        rows.append((3 * g, " ".join(words)))
        for k in (1, 2):
            words[20 * k + rng.randrange(9)] = "changed"
            rows.append((3 * g + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    ids = sorted(texts)
    alike = lambda i, j: simhash.similarity(texts[i].encode(), texts[j].encode()) >= 0.8
    want = plain_components(ids, [plain_fingerprint(texts[i], 5) for i in ids], 8, alike)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs, width=5, radius=8, least=0.8).collect()}
    assert got == want and len(set(got.values())) < 80
    assert all(alike(i, i // 3 * 3) for i in ids if i % 3 == 1)
    nodes = spark.createDataFrame([(1, 0), (2, 255)], "id long, fp long")
    edges = simhash.links(nodes, 8)
    assert edges.count() == 1 and simhash.verified(edges, docs, 0.8, "doc_id", "text", 5).count() == 1
    assert simhash.verified(spark.createDataFrame([(3, 0)], "u long, v long"), docs, 0.8, "doc_id", "text", 5).count() == 0


def test_edges(spark):
    long = "w " * 30000
    rows = [(5, None, "x"), (3, "", "x"), (3, "", "x"), (9, "one", "x"), (None, "other words here now", "x"), (7, long, "x"), (8, long, "x"), (2, "ONE", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 2), (2, 2), (None, None), (7, 7), (8, 7)], key=str)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 2, None, 7], key=str)
    assert simhash.near_groups(docs.filter("doc_id = -1")).count() == 0


def united(ids, edges):
    """Components of undirected edges, by the smallest id."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_whole_finds_copies_beyond_the_radius(spark):
    """Every pair with a similarity of 0.8 links, most of them beyond 8 bits; also the empty and the short, and a crowd with one common shingle."""
    rng = random.Random(11)
    rows = [(0, "short one"), (1, "Short  one"), (2, ""), (3, None)]
    for g in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for k in (0, 3, 3, 3):
            copy = list(words)
            for at in rng.sample(range(5, 145), k):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    for _ in range(60):
        rows.append((len(rows), " ".join(["one", "line", "that", "all", "have", *(f"y{rng.randrange(10**6)}" for _ in range(6))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: (t or "").encode() for i, t in rows}
    near = [(i, j) for i in texts for j in texts if j < i and simhash.similarity(texts[i], texts[j]) >= 0.8]
    fps = {i: simhash.fingerprint(t, 5) for i, t in texts.items()}
    far = [(i, j) for i, j in near if bin(fps[i] ^ fps[j]).count("1") > 8]
    assert len(far) > 30
    want = united(texts, near)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs, width=5, radius=8, least=0.8, whole=True).collect()}
    assert got == want
    cut_short = {r.doc_id: r.component_id for r in simhash.near_groups(docs, width=5, radius=8, least=0.8).collect()}
    assert len(set(cut_short.values())) > len(set(want.values()))


def test_swept_buckets_keep_every_link(spark):
    """Several hundred varied copies share swept buckets: a fingerprint whose sweep edge fails still gets its other links."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(200), rng.randrange(0, 8)):
            copy[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rng.shuffle(rows)
    texts = {n: t for n, (_, t) in enumerate(rows)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    ids = sorted(texts)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() if (w := t.split())}
    want = plain_components(ids, [simhash.fingerprint(texts[i].encode(), 5) for i in ids], 8, lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs, width=5, radius=8, least=0.8).collect()}
    assert got == want


def _sparse_bucket(n, seed):
    """Distinct fingerprints that agree in their 13 lowest bits, with a near one for one in ten of them and a dense ball of 300."""
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 51, n, dtype=np.uint64) << np.uint64(13)
    one = rng.integers(0, 51, n // 10, dtype=np.uint64)
    two = (one + rng.integers(1, 51, n // 10, dtype=np.uint64)) % np.uint64(51)  # another bit
    near = fps[: n // 10] ^ (np.uint64(1) << (one + np.uint64(13))) ^ (np.uint64(1) << (two + np.uint64(13)))
    ball = fps[-1] ^ (np.uint64(1) << rng.integers(13, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(13, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(13, 64, 300, dtype=np.uint64))
    return np.unique(np.concatenate([fps, near, ball]))


def test_sparse_bucket_is_split(monkeypatch):
    """What a few steps of the sweep leave is split by further bits, level after level, without losing a link."""
    monkeypatch.setattr(simhash, "_STEPS", 4)
    monkeypatch.setattr(simhash, "_PAIRWISE", 3)
    for seed, shift in ((1, 13), (2, 40), (3, 50)):
        fps = _sparse_bucket(900, seed)
        fps = np.unique((fps >> np.uint64(shift)) << np.uint64(shift))  # fewer free bits: denser
        ids = list(range(len(fps)))
        edges = simhash._bucket_edges(np.array(ids), fps, simhash.pivot_table(fps, simhash.pivots()), 4)
        assert all(bin(int(fps[u] ^ fps[v])).count("1") <= 4 for u, v in edges)
        assert united(ids, edges) == plain_components(ids, fps.tolist())


def test_large_sparse_bucket_in_linear_time():
    fps = _sparse_bucket(200_000, 4)
    began = time.process_time()
    edges = simhash._bucket_edges(np.arange(len(fps)), fps, simhash.pivot_table(fps, simhash.pivots()), 4)
    assert time.process_time() - began < 60
    assert len({v for e in edges for v in e}) >= 40_000


def test_crowded_keys_are_split_over_tasks(spark, monkeypatch):
    """Keys over the bound go under further masks, twice, and the components stay."""
    fps = _sparse_bucket(600, 5)
    nodes = spark.createDataFrame([(i, simhash._signed(int(f))) for i, f in enumerate(fps)], "id long, fp long")
    most = simhash._keyed(nodes, 4).groupBy("key").count().agg({"count": "max"}).first()[0]
    monkeypatch.setattr(simhash, "CROWDED", 40)
    split = simhash._keyed(nodes, 4).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert most >= len(fps) and split < most / 2
    ids = list(range(len(fps)))
    got = {r.id: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    want = plain_components(ids, fps.tolist())
    assert all(got.get(i, i) == want[i] for i in ids)
