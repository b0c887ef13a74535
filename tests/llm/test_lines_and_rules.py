import re
from collections import Counter, defaultdict

from texts import documents, prose, seeded

from sensorloom.llm import line_dedup as L
from sensorloom.llm import quality_rules as Q

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(BLANK))


def brute_dedup(rows):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    keeper = {k: min(v, key=lambda i: (i is None, i or 0)) for k, v in holders.items() if len(v) > 1}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = seeded(3)
    shared = "This line is everywhere"
    texts = [None, "", shared, f" {shared.upper()}\t\nown words here\n{shared}", "short\nshort", "short", f" {shared}", "É a line with accents", "é a line with accents", f"{shared}\r\n\n\n", "x" * 9, "x" * 9, "ééééééééé", "ééééééééé", "éééééééééé", "éééééééééé", prose(rng, 5000) + "\n" + shared]
    rows = list(enumerate(texts)) + [(2, shared), (None, shared), (None, "only null ids have this"), (3, "a second row of document 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n_lines", "2 as keeper", "3 as hi")
    got = L.dedup_lines(docs)
    assert got.columns == [*docs.columns, "lines"] and {(r["n_lines"], r["keeper"], r["hi"]) for r in got.collect()} == {(1, 2, 3)}
    norm = lambda rs: sorted(((-1 if a is None else a), *rest) for a, *rest in rs)
    assert norm((r["doc_id"], *r["lines"], r["text"] or "") for r in got.collect()) == norm(brute_dedup(rows))
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_heavy_lines_are_split_without_loss(spark):
    rows = [(k, "a line that all have\n" + ("a line of some\n" if k % 3 else "") + f"a line of number {k}") for k in range(60)]
    lines = L.hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    shared = L.shared_lines(lines)
    lost = {heavy: {r["doc_id"]: len(r["dropped"]) for r in L.dropped_lines(lines, shared, heavy).collect()} for heavy in (1, 5, 40)}
    assert lost[1] == lost[5] == lost[40] == {k: 1 + (k % 3 > 0 and k > 1) for k in range(1, 60)}


def test_clashing_columns(spark):
    docs = documents(spark, ["a line that both have", "a line that both have\nmore"])
    for c in ("lost", "lost_by", "lines", "n_dropped", "hi", "part"):
        docs = docs.withColumn(c, docs.doc_id + 7)
    got = L.dedup_lines(docs)
    assert got.columns == [*docs.columns, "lines_"] == [*docs.columns, L.lines_column(docs)]
    assert sorted((r["doc_id"], r["text"], r["lost"], r["lines"], r["lines_"]["n_dropped"]) for r in got.collect()) == [(0, "a line that both have", 7, 7, 0), (1, "more", 8, 8, 1)]


def test_higher_threshold_counts_documents(spark):
    docs = spark.createDataFrame([(1, "a line to count\na line to count"), (2, "a line to count"), (3, "twice only held"), (4, "twice only held"), (5, "a line to count")], "doc_id long, text string")
    assert {r["doc_id"]: r["lines"]["n_dropped"] for r in L.dedup_lines(docs, min_docs=3).collect()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(windows)
    repeat = {p for k, w in enumerate(windows) if times[w] > 1 for p in range(k, k + 3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))


def test_rules_equal_brute_force_in_any_order(spark):
    rng = seeded(4)
    texts = [None, "", prose(rng, 60), "a b c " * 60, "\n".join(["same line of words"] * 20), prose(rng, 60).upper(), " ".join(w + "***" for w in prose(rng, 70).split()), " | ".join(prose(rng, 60).split()), "ab cd e f " * 3, "é" * 300, prose(rng, 20000)]
    docs = documents(spark, texts + texts[2:4])
    order = Q.cheapest_first(Q.rule_figures(docs))
    assert sorted(order) == sorted(Q.RULES)
    got = {r["doc_id"]: r for r in Q.apply_cascade(docs, order).collect()}
    back = {r["doc_id"]: r["kept"] for r in Q.apply_cascade(docs, order[::-1]).collect()}
    for k, text in enumerate(texts + texts[2:4]):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert back[k] == r["kept"]
    assert [got[k]["kept"] for k in range(len(texts))] == [False, False, True, False, False, False, False, False, False, False, True]
    assert Q.apply_cascade(docs.limit(0), Q.cheapest_first(Q.rule_figures(docs.limit(0)))).count() == 0
