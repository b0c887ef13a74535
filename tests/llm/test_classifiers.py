import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import documents, prose, seeded

from sensorloom.llm import quality_classifier as Q
from sensorloom.llm import toxicity as T
from sensorloom.llm.folds import bounded_sample, held_out, learnable

INSULTS = ["blarg", "snurfle", "grockle"]


@pytest.fixture(scope="module")
def corpus():
    rng = seeded(8)
    texts, quality, toxic = [], [], []
    for _ in range(700):
        text, good, bad = prose(rng, rng.randrange(60, 140)), 1, 0
        if rng.random() < 0.15:
            text, good = " ".join(w + "***" for w in text.split()), 0
        if rng.random() < 0.2:
            words = text.split(" ")
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(INSULTS) + ("" if rng.random() < 0.5 else "ish")
            text, bad = " ".join(words), 1
        texts.append(text), quality.append(good), toxic.append(bad)
    return texts + [None, "", prose(rng, 20000)], quality, toxic


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def labels(spark, quality, toxic):
    rows = [(i, q, t) for i, (q, t) in enumerate(zip(quality, toxic, strict=True)) if i % 2 == 0 or fold(i)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_folds(spark):
    ids = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(None, 1), (1, 0), (2, None)], "doc_id long, quality int")
    assert {r["doc_id"] for r in ids.where(held_out()).collect()} == {k for k in range(50) if fold(k)} | {None}
    learnt = learnable(ids, "quality")
    assert all(not fold(r["doc_id"]) and r["doc_id"] != 1 for r in learnt.collect())  # 1 has both labels
    assert bounded_sample(learnt, 3).count() == 6


def test_quality_on_held_out_rows(spark, corpus):
    texts, quality, toxic = corpus
    levels = Q.cell_levels(documents(spark, texts))
    w = Q.fit(levels, labels(spark, quality, toxic))
    got = {r["doc_id"]: r["score"] for r in Q.scored(levels, w).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.3) == (q == 1) for i, q in enumerate(quality) if fold(i)]
    assert np.mean(right) > 0.97
    # Negative labels don't matter: only positives are learnt from.
    only = labels(spark, quality, toxic).where("quality = 1")
    assert np.allclose(Q.fit(levels, only), w)


@pytest.mark.parametrize("prior", [0.3, 0.8])
def test_risk_is_least_as_by_plain_descent(spark, prior):
    """Against gradient descent over single documents: no weights have a smaller risk whose negative part isn't below zero."""
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 8, (30, len(Q.LEVELS)))
    cells = (kinds << 3 * np.arange(len(Q.LEVELS))).sum(1)
    n = rng.integers(1, 40, 30)
    positive = np.where(kinds[:, 0] > 3, rng.binomial(n, 0.5), 0)
    table = spark.createDataFrame([(int(c), float(a), float(b)) for c, a, b in zip(cells, n, positive, strict=True)], "cell long, n double, n_positive double")
    w = Q.minimise(table, prior, rounds=40)
    x = Q.indicators(np.repeat(cells, n))
    of_positive = Q.indicators(np.repeat(cells, positive))

    def risk(v):
        return np.logaddexp(0, x @ v).mean() - prior * (of_positive @ v).mean() + 5e-4 * v @ v

    def negative(v):
        return np.logaddexp(0, x @ v).mean() - prior * np.logaddexp(0, of_positive @ v).mean()

    best, pull = np.zeros(x.shape[1]), prior * of_positive.mean(0)
    for _ in range(6000):
        new = best - 0.5 * ((x / (1 + np.exp(-x @ best))[:, None]).mean(0) - pull + 1e-3 * best)
        if negative(new) < 0:
            break
        best = new
    assert negative(w) >= -1e-9 and risk(w) <= risk(best) + 1e-4


def test_repeated_rows_are_scored_each(spark, corpus):
    texts, quality, toxic = corpus
    docs = documents(spark, texts[:60] + texts[:5]).withColumn("score", F.lit("clash")).withColumn("doc_id", F.when(F.col("doc_id") >= 60, F.col("doc_id") - 60).otherwise(F.col("doc_id")))
    levels = Q.cell_levels(docs.union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    rows = Q.scored(levels, Q.fit(levels, labels(spark, quality, toxic))).collect()
    assert len(rows) == 66 and all(len({r["score"] for r in rows if r["doc_id"] == k}) == 1 and sum(r["doc_id"] == k for r in rows) == 2 for k in range(5))


def test_class_prior_and_no_positives(spark, corpus):
    texts, quality, toxic = corpus
    levels = Q.cell_levels(documents(spark, texts))
    none = labels(spark, quality, toxic).limit(0)
    assert Q.fit(levels, none) is None
    assert {r["score"] for r in Q.scored(levels, None).collect()} == {1.0}
    assert Q.scored(levels.limit(0), None).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_class_prior_is_estimated(spark, share):
    """Of 3,000 unlabelled texts a share is like the 400 positives, the rest is shouted and full of marks; no negative is known."""
    rng = seeded(41)
    good, bad = prose(rng, 100), " ".join(w.upper() + "!!" for w in prose(rng, 100).split())
    cell = {kind: Q.cell_levels(documents(spark, [text])).first()["cell"] for kind, text in (("good", good), ("bad", bad))}
    n_good = int(3000 * share)
    cells = spark.createDataFrame([(cell["good"], float(n_good), 400.0), (cell["bad"], 3000.0 - n_good, 0.0)], "cell long, n double, n_positive double")
    assert abs(Q.class_prior(cells) - share) < 0.1
    w = Q.minimise(cells, Q.class_prior(cells))
    score = {kind: float(Q.indicators(np.array([c]))[0] @ w) for kind, c in cell.items()}
    assert score["good"] > 0 > score["bad"]


def test_toxicity_on_held_out_rows(spark, corpus):
    texts, quality, toxic = corpus
    docs = documents(spark, texts)
    model = T.fit(docs, labels(spark, quality, toxic))
    strong = model.lexicon.terms[: model.lexicon.n_strong]
    assert any(t.startswith("blarg") for t in strong) and all(t.startswith(("bla", "snur", "groc")) for t in strong)
    got = {r["doc_id"]: r["toxicity"] for r in T.with_scores(docs, model).collect()}
    assert len(got) == len(texts)
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, t in enumerate(toxic) if fold(i)]) > 0.97
    assert got[len(toxic)] < 0.5 and got[len(toxic) + 1] < 0.5
    # The scores are a linear function of what a term-by-term search finds.
    matcher = T.Matcher(model.lexicon)
    for text in texts[:40]:
        own = T.words(text)
        assert matcher(text).terms == [k for k, t in enumerate(model.lexicon.terms) if any(w == t.encode() or t.endswith("*") and w.startswith(t[:-1].encode()) for w in own)]


def test_words_of_any_length_count():
    """Also at the beginning of long words and of runs without blanks."""
    matcher = T.Matcher(T.Lexicon(["blarg*", "坏人坏人*", "snurfle"], 3))
    for text, found in (("a blarg" + "x" * 3000 + " b", [0]), ("坏人坏人" + "今天天气很好" * 50, [1]), ("snurfles snurfle", [2]), ("blar", []), ("xblarg", [])):
        assert matcher(text).terms == found


def test_uses_of_terms():
    matcher = T.Matcher(T.Lexicon(["blarg", "snurf*"], 2))
    for text, uses in (
        ("a bl@rg here", {"spelt"}),
        ("b l a r g they said", {"spelt"}),
        ("you are such a blarg", {"aimed"}),
        ("the BLARG is there", {"capitals"}),
        ("the blarg!", {"exclaimed"}),
        ("the blarg and one blarg", {"repeated"}),
        ("so id10t it is", {"spelt"}),
        ("nothing of it! you @ all", set()),
        ("", set()),
        # Four words beside a term count, whatever their lengths.
        ("you необыкновеннейший превосходительнейший " + "w" * 500 + " blarg", {"aimed"}),
        ("the blarg " + "w" * 500 + " 非常长的句子没有空格 незабываемо you", {"aimed"}),
        ("you one two three four blarg five six seven eight you", set()),
        ("the blarg " + "w" * 90 + " and so on!! here", {"exclaimed"}),
        ("the blarg one two three four and five!!", set()),
        ("you" + " " * 400 + "blarg", {"aimed"}),
    ):
        assert matcher(text).uses == uses, text
    assert matcher("what an Idiot").topics == {0} and matcher(None).topics == set()


def test_copies_are_one_piece_of_evidence(spark):
    rng = seeded(9)
    text = prose(rng, 80)
    rows = [(text + f" end{k}", 1) for k in range(30)] + [(prose(rng, 80), 0) for _ in range(30)]
    left = T.one_of_each_copy(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, label int"))
    assert rows[0][0] in {r["text"] for r in left.collect()}  # the first id of the copies
    assert left.where("label = 1").count() <= 2 and left.where("label = 0").count() == 30


def test_label_model_recovers_accuracies(spark):
    rng = np.random.default_rng(4)
    cells = []
    for _ in range(4000):
        y = rng.random() < 0.2
        cell = 0
        for k in range(T.VOTERS):
            right = rng.random() < (0.9 if k % 2 else 0.75)
            vote = (2 if y else 1) if right else (1 if y else 2)
            cell |= (0 if rng.random() < 0.2 else vote) << 2 * k
        cells.append((cell, 1.0))
    model = T.fit_label_model(spark.createDataFrame(cells, "cell long, n double"))
    assert abs(model.prior - 0.2) < 0.03
    assert all(abs(model.given[1, k, 0, 2] - 0.8 * (0.9 if k % 2 else 0.75)) < 0.06 for k in range(T.VOTERS))


def test_label_model_finds_voters_that_repeat_each_other(spark):
    """Ten voters that say the same are as good as one, and are found to depend on each other."""
    rng = np.random.default_rng(6)
    cells, truth = [], []
    for _ in range(4000):
        y = rng.random() < 0.3
        own = [(2 if y else 1) if rng.random() < 0.85 else (1 if y else 2) for _ in range(T.VOTERS)]
        if rng.random() < 0.95:
            own[10:20] = [own[10]] * 10
        cells.append((T.cell(own), 1.0)), truth.append(y)
    model = T.fit_label_model(spark.createDataFrame(cells, "cell long, n double"))
    tied = [k for k in range(10, 20) if 10 <= model.parent[k] < 20]
    assert len(tied) == 9 and all(model.parent[k] == -1 or 10 <= model.parent[k] < 20 for k in range(10, 20))
    own = np.ones((1, T.VOTERS), np.int64)
    own[0, 10:20] = 2
    assert model.posterior(own)[0] < 0.01  # fifteen voters against one, ten times
    got = model.posterior(T.unpacked(np.array([c for c, _ in cells]))) >= 0.5
    assert (got == np.array(truth)).mean() > 0.98


def test_clashing_columns_pass_through(spark, corpus):
    docs = documents(spark, corpus[0][:5]).withColumn("toxicity", F.lit(7)).withColumn("a.b", F.lit(8))
    scored = T.with_scores(docs, T.Classifier(T.Lexicon([], 0), np.zeros(3 * T.VOTERS + 1)))
    assert scored.columns == [*docs.columns, "toxicity_"] == [*docs.columns, T.score_column(docs)]
    assert {(r["toxicity"], r["a.b"], r["toxicity_"]) for r in scored.collect()} == {(7, 8, 0.5)}


def test_without_labels_nothing_is_toxic(spark, corpus):
    docs = documents(spark, corpus[0][:5])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.fit(docs, none) is None
    assert {r["toxicity"] for r in T.with_scores(docs, None).collect()} == {0.0}
