import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import documents, prose, seeded

from sensorloom.llm import decontamination as D
from sensorloom.llm.fm_index import FMIndex, WaveletMatrix, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(texts, items, width=10):
    out = []
    for text in texts:
        words, hit, found = fold(text), set(), set()
        for item_id, item in items:
            own = fold(item)
            for k in range(max(1, len(own) - width + 1) if own else 0):
                window = own[k : k + width]
                for i in range(len(words) - len(window) + 1):
                    if words[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        found.add(str(item_id))
        out.append((len(words), len(hit), sorted(found)))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_finds_all_places(text, pattern):
    index = FMIndex(np.array(text), 4, every=3)
    low, high = index.search(np.array([9, *pattern]), np.array([1]), np.array([len(pattern)]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [k for k in range(len(text) - len(pattern) + 1) if text[k : k + len(pattern)] == pattern]


def test_ranks_and_suffixes():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 11, 300)
    m = WaveletMatrix(s, 4)
    for i in (0, 1, 64, 150, 300):
        assert [int(m.rank(np.array([c]), np.array([i]))[0]) for c in range(11)] == [int((s[:i] == c).sum()) for c in range(11)]
    text = np.append(s + 1, 0)
    assert suffix_array(text).tolist() == sorted(range(301), key=lambda k: text[k:].tolist())


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_query_equals_brute_force(spark, block_bytes):
    rng = seeded(1)
    items = [(k, prose(rng, 25)) for k in range(6)] + [(6, "Quite short"), (7, ""), (8, None), (9, prose(rng, 11)), (9, "again this id")]
    leak = items[0][1].upper().replace(" ", ", ")
    texts = [None, "", "...", prose(rng, 40) + " " + leak + " " + prose(rng, 30), items[1][1][:60], "a quite  SHORT one", prose(rng, 3000) + " " + items[2][1] + items[3][1], leak, leak, items[9][1] + " é", "Ünïcode quite short"]
    docs = documents(spark, texts)
    found = D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).select("doc_id", "leaks.*").orderBy("doc_id").collect()
    assert [(r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), r["items"]) for r in found] == brute(texts, items)


def test_removal_leaves_the_rest_and_drops_what_is_only_leak(spark):
    rng = seeded(2)
    item = prose(rng, 30)
    docs = documents(spark, [f"Before this. {item} And after.", item, "clean", None, ""])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = D.remove_spans(D.find_leaks(docs, bench), "leaks")
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {0: "Before this.  And after.", 2: "clean", 3: None, 4: ""}


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_clashing_columns_and_repeated_rows(spark, block_bytes):
    """Columns named as results or as helpers stay as they are; each repeated row is judged."""
    item = prose(seeded(3), 12)
    docs = documents(spark, [f"x {item}"] * 2 + ["clean"])
    for c in ("items", "spans", "leaks", "LEAKS_", "row_id", "hits", "row"):
        docs = docs.withColumn(c, docs.doc_id + 1)
    bench = spark.createDataFrame([(1, item), (2, item), (None, item), (3, "other words")], "item_id long, text string")
    found = D.find_leaks(docs.union(docs), bench, block_bytes=block_bytes)
    name = D.leaks_column(docs)
    assert found.columns == [*docs.columns, name] and name == "leaks__"
    rows = found.collect()
    assert sorted((r["doc_id"], r["items"], r["hits"], r[name]["n_words"], r[name]["items"]) for r in rows) == sorted([(k, k + 1, k + 1, 13, ["1", "2"]) for k in (0, 0, 1, 1)] + [(2, 3, 3, 1, [])] * 2)
    assert {r["doc_id"]: r["spans"] for r in D.remove_spans(found, name).collect()} == {0: 1, 1: 2, 2: 3}


def test_a_block_takes_memory_in_proportion_to_its_text():
    rng = seeded(4)
    items = [(str(k), " ".join(f"w{rng.randrange(10**6)}" for _ in range(500))) for k in range(100)]
    block = D.windows(items, 10)
    size = sum(len(t) for _, t in items)
    assert len(block.lengths) == 100 * 491
    assert sum(getattr(block, c).nbytes for c in ("words", "text", "start", "lengths", "offsets", "owners")) < 10 * size


def test_empty_tables(spark):
    docs, bench = documents(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")
    assert [r["leaks"]["spans"] for r in D.find_leaks(docs, bench).collect()] == [[]]
    assert D.find_leaks(docs.limit(0), bench).count() == 0
