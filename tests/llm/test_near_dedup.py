import math
import re
from collections import Counter

import numpy as np
import pytest
from texts import changed, documents, prose, seeded

from sensorloom.llm import near_dedup as N

S = N.Settings()


def words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def weighted(texts):
    """Shingles of each text with their weights, in plain Python: runs of five words, their count times the words' mean weight."""
    own = [[w.decode() for w in words(t)] for t in texts]
    held_by = Counter(w for ws in own for w in set(ws))
    weight = {w: math.log1p(1 / max(n / len(texts), S.rare)) for w, n in held_by.items()}
    out = []
    for ws in own:
        width = min(5, len(ws))
        times = Counter(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)) if ws else {}
        out.append({run: n * sum(weight[w] for w in run) / width for run, n in times.items()})
    return out


def jaccard(a, b):
    low = sum(min(v, b[k]) for k, v in a.items() if k in b)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def brute_classes(rows):
    """Components of all pairs of similarity 0.8, by comparing every two texts."""
    own = weighted([t for _, t in rows])
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if own[a] and own[b] and jaccard(own[a], own[b]) >= 0.8:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    rng = seeded(7)
    base, passage = prose(rng, 150), prose(rng, 60)
    texts = [prose(rng, rng.randrange(20, 300)) for _ in range(40)]
    texts += [changed(rng, base, rng.randrange(0, 6)) for _ in range(60)]  # one large group of near copies
    texts += [base] * 15 + [base.upper().replace(" ", ", ")]
    texts += [prose(rng, 90) + " " + passage for _ in range(10)]  # a passage that is no duplicate
    for n in (200, 400):
        one = prose(rng, n)
        texts += [one, changed(rng, one, n // 60), changed(rng, one, n // 8)]
    texts += [None, "", "...", "two words", "Two  words", "two words more", prose(rng, 30000)]
    return list(enumerate(texts))


def test_classes_equal_brute_force(spark, rows):
    docs = documents(spark, [t for _, t in rows])
    wanted = brute_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in N.classes(docs).collect()}
    assert [got[i] for i, _ in rows] == wanted
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w for w in wanted})


@pytest.mark.parametrize("settings", [{}, {"group_rows": 12, "splits": 1}, {"group_rows": 12, "splits": 0}, {"group_bytes": 9000, "leader_rows": 3}])
def test_groups_find_links_between_components(spark, rows, monkeypatch, settings):
    """Without stars, groups alone must join what is similar, whole, split by samples, or dealt to pairs of blocks."""
    few = [(i, t) for i, t in rows if t and len(t) < 4000]
    docs = documents(spark, [t for _, t in few])
    if "leader_rows" not in settings:
        monkeypatch.setattr(N, "star_links", lambda pairs, *rest: pairs.select(pairs.leader.alias("src"), pairs.node.alias("dst")).limit(0))
    got = {r["doc_id"]: r["class_id"] for r in N.classes(docs, N.Settings(**settings)).collect()}
    wanted = brute_classes([(k, t) for k, (_, t) in enumerate(few)])
    # Buckets of two are left to stars.
    large = {c for c, n in Counter(wanted).items() if n > 5 or "leader_rows" in settings}
    assert [got[k] for k in range(len(few)) if wanted[k] in large] == [c for c in wanted if c in large]


def test_links_within_equal_brute_force():
    """All links that the prefixes must not miss, in groups of texts that are nearly similar."""
    rng = seeded(21)
    for _ in range(30):
        base = prose(rng, rng.randrange(30, 120))
        texts = [changed(rng, base, rng.randrange(0, 12)) for _ in range(25)] + [prose(rng, 40), base]
        own = weighted(texts)
        arrays = []
        for shingles in own:
            keys = np.array([hash(k) & (2**63 - 1) for k in shingles], np.uint64)
            order = np.argsort(keys)
            arrays.append((keys[order], np.array(list(shingles.values()), np.float32)[order]))
        parent = list(range(len(texts)))
        for a, b in N.links_within(arrays, np.arange(len(texts)), S):
            old, new = parent[a], parent[b]
            parent = [new if p == old else p for p in parent]
        found = {frozenset(k for k, p in enumerate(parent) if p == q) for q in parent}
        wanted = brute_classes(list(enumerate(texts)))
        assert found == {frozenset(k for k, c in enumerate(wanted) if c == q) for q in wanted}


def test_rows_grow_in_proportion_to_a_bucket(spark):
    """Splitting a group multiplies its rows by the number of ways, whatever the group's size."""
    rng = np.random.default_rng(5)
    for n in (400, 800):
        texts = spark.createDataFrame([(k, [int(x) for x in rng.integers(0, 3, 64)]) for k in range(n)], "node long, samples array<int>")
        rows = spark.createDataFrame([(1, 1, k, k, 10) for k in range(n)], "group long, bucket long, node long, component long, size long")
        split = N.split_groups(rows, texts, S, 1)
        assert split.count() == 16 * n
        assert split.groupBy("group").count().agg({"count": "max"}).first()[0] < n / 8


def test_frequencies_and_hashes():
    hasher = N.WordHasher()
    with np.errstate(over="ignore"):
        hashes, _ = hasher.hashes("Ab ab, CD cd é É".encode())
    assert hashes[0] == hashes[1] and hashes[2] == hashes[3] and hashes[4] != hashes[5]
    assert len({h for w in words(prose(seeded(1), 500)) for h in hasher.hashes(w)[0].tolist()}) == len(set(words(prose(seeded(1), 500))))


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    keys = rng.integers(1, 2**62, 400).astype(np.uint64)
    w = rng.random(400).astype(np.float32) + 0.5
    sampler = N.Sampler(2048)
    with np.errstate(over="ignore"):
        for share in (300, 360):
            order = np.argsort(keys[400 - share :])
            a, b = sampler.sample([(keys[:share], w[:share]), (keys[400 - share :][order], w[400 - share :][order])])
            true = w[400 - share : share].sum() / w.sum()
            assert abs((a == b).mean() - true) < 0.04


def test_the_bound_changes_no_sample():
    rng = np.random.default_rng(3)
    own = []
    for n in (1, 2, 7, 300, 5000, 40):
        own.append((np.sort(rng.integers(1, 2**62, n).astype(np.uint64)), (rng.gamma(2, 1, n) + 0.1).astype(np.float32)))
    sampler, whole = N.Sampler(64), N.Sampler(64)
    whole.REACH = 1e12
    with np.errstate(over="ignore"):
        both = sampler.sample(own), whole.sample(own)
        assert (both[0] == both[1]).all()
        assert all((sampler.sample([x]) == both[0][k]).all() for k, x in enumerate(own))


def test_weights_of_words(spark):
    texts = ["common rare1", "common rare2", "common", "COMMON common, other", None, ""]
    weights = N.word_weights(documents(spark, texts), N.Settings(rare=0.5))
    hasher = N.WordHasher()
    with np.errstate(over="ignore"):
        found = weights.of(hasher.hashes(b"common rare1 other")[0])
    assert np.allclose(found, [math.log1p(6 / 4), math.log1p(2), math.log1p(2)])


def test_clashing_and_nested_columns_are_kept(spark):
    docs = documents(spark, ["one text of five words here", "one text of five words here", "another text"])
    for c in ("row_id", "hi", "node", "component", "buckets", "carried", "group", "a.b"):
        docs = docs.withColumn(c, docs.doc_id + 5)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(k, t, "en", k + 5, 1, *[k + 5] * 7) for k, t in ((0, "one text of five words here"), (2, "another text"))]


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "some words to share here"), (3, "some words to share here"), (None, "other words that are alone"), (3, "some words to share here")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in N.classes(docs).collect()) == [("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
    assert sorted(str(r["doc_id"]) for r in N.keep_one(docs).collect()) == ["3", "None"]
    assert N.classes(docs.limit(0)).count() == 0


def test_equal_texts_without_words_are_one_class(spark):
    texts = ["", "...", "", None, "...", "a word", "", "!?", None]
    docs = documents(spark, texts).repartition(3)
    assert {r["doc_id"]: r["class_id"] for r in N.classes(docs).collect()} == {k: texts.index(t) for k, t in enumerate(texts)}
    assert sorted(r["doc_id"] for r in N.keep_one(docs).collect()) == [0, 1, 3, 5, 7]
