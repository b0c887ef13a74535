import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F
from texts import VOCABULARY, changed, prose, seeded

from sensorloom.plans.scratch import written


def test_stages_keep_clean_documents_and_catch_the_rest(spark, tmp_path):
    rng = seeded(12)
    clean = [prose(rng, 120) for _ in range(60)]
    toxic = [" ".join("blarg snurfle".split() + prose(rng, 80).split()) for _ in range(40)]
    leak = prose(rng, 30)
    rows = [(i, t) for i, t in enumerate(clean + toxic)]
    near = changed(rng, clean[0], 1)
    rows += [(200, near), (201, prose(rng, 80) + " " + leak + " tail"), (202, "a shared line of text\n" + prose(rng, 60)), (203, "a shared line of text\n" + prose(rng, 60)), (204, None), (205, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 100)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    state, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES:
        state = written(stage(spark, state, str(tmp_path)))
        seen[name] = state
        if name != "packing":
            assert state.columns == docs.columns
    ids = lambda name: {r["doc_id"] for r in seen[name].select("doc_id").collect()}
    text = lambda name: {r["doc_id"]: r["text"] for r in seen[name].collect()}
    assert ids("toxicity") == {*range(60), *range(200, 206)}
    lines = text("line_dedup")
    assert ids("line_dedup") == ids("toxicity") and lines[202].startswith("a shared") and not lines[203].startswith("a shared")
    assert ids("near_dedup") == ids("line_dedup") - {200}
    last = text("decontamination")
    assert set(last) == ids("near_dedup") and leak not in last[201] and last[201].endswith(" tail")
    assert all(last[k] == clean[k] for k in range(60)) and len(VOCABULARY) == 48
    assert ids("packing") == set(last)
    assert {r["doc_id"] for r in C.run(spark, str(tmp_path)).select("doc_id").collect()} == set(last)


CLASHING = ["n_words", "items", "spans", "leaks", "n_lines", "n_dropped", "lines", "lost", "lost_by", "toxicity", "_lost", "row_id", "node", "samples", "buckets", "carried", "hits", "a.b"]


def written_tables(spark, folder, rows, toxic=(), benchmark=()):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    for k, c in enumerate(CLASHING):
        docs = docs.withColumn(c, F.lit(100 + k))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def after_stages(spark, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in C.STAGES[:-1]:
        docs = seen[name] = written(stage(spark, docs, str(folder)))
    return seen, written(C.STAGES[-1][1](spark, docs, str(folder)))


def test_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    rng = seeded(13)
    leak, toxic = prose(rng, 15), {*range(100, 140)}
    clean = [*range(20), *range(200, 260)]
    rows = [(k, prose(rng, 70)) for k in clean] + [(k, prose(rng, 60) + " blarg you blarg") for k in range(100, 140)]
    rows += [(50, None), (50, None), (51, ""), (52, ""), (None, "a text without an id"), (3, rows[3][1]), (60, prose(rng, 50) + " " + leak), (61, leak), (62, prose(rng, 40_000))]
    docs = written_tables(spark, tmp_path, rows, toxic, [(1, leak), (None, None), (2, "")])
    seen, packed = after_stages(spark, tmp_path)
    for name, found in seen.items():
        assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema], name
        assert found.select(*[f"`{c}`" for c in CLASHING]).distinct().collect() == [tuple(100 + k for k in range(len(CLASHING)))], name
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found.collect())
    ids = {name: sorted((r["doc_id"] for r in found.collect()), key=str) for name, found in seen.items()}
    assert ids["toxicity"] == sorted((i for i, _ in rows if i not in toxic), key=str)
    assert ids["line_dedup"] == ids["toxicity"]  # a document without lines stays
    assert ids["near_dedup"] == sorted([*clean, 50, 51, None, 60, 61, 62], key=str)
    assert ids["decontamination"] == sorted([*clean, 50, 51, None, 60, 62], key=str)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(ids["decontamination"])
    assert sum(r["length"] for r in packed.where("doc_id in (50, 51)").collect()) == 2


@pytest.mark.parametrize("toxic", [(), (1, 3)])
def test_empty_tables(spark, tmp_path, toxic):
    docs = written_tables(spark, tmp_path, [(k, f"text number {k}") for k in range(5)], toxic)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        found = stage(spark, empty, str(tmp_path))
        assert found.count() == 0 and (name == "packing" or found.columns == docs.columns)
    assert {r["doc_id"] for r in C.run(spark, str(tmp_path)).collect()} == set(range(5))  # too few labels to call anything toxic; no benchmark


def naive_lines_and_leaks(texts, items):
    """Line dedup and decontamination of ``texts`` by id, line by line and word by word."""
    import re

    held, out = {}, {}
    for i in sorted(texts):
        lines = []
        for line in texts[i].split("\n"):
            key = line.strip().lower()
            if len(key) < 10 or held.setdefault(key, i) == i:
                lines.append(line)
        out[i] = "\n".join(lines)
    for i, text in out.items():
        words = [m for m in re.finditer("[0-9A-Za-z]+", text)]
        own, hit = [m[0].lower() for m in words], set()
        for item in items:
            wanted = item.lower().split()
            for k in range(len(wanted) - 9):
                hit |= {j for at in range(len(own) - 9) if own[at : at + 10] == wanted[k : k + 10] for j in range(at, at + 10)}
        cut, end = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                cut += text[end : words[k].start()]
            end = words[k].end()
        out[i] = None if hit and len(hit) == len(own) else cut + text[end:]
    return {i: t for i, t in out.items() if t is not None}


def test_texts_equal_a_naive_pipeline(spark, tmp_path):
    """Without toxic documents and with copies that only line dedup sees, the texts that are packed follow from two naive loops."""
    rng = seeded(14)
    items = [prose(rng, 30) for _ in range(3)]
    shared = [prose(rng, 12) for _ in range(4)]
    texts = {k: "\n".join([prose(rng, 40), *rng.sample(shared, 2), prose(rng, 30) + (" " + items[k % 3] + " " + prose(rng, 5) if k % 2 else "")]) for k in range(24)}
    written_tables(spark, tmp_path, list(texts.items()), (), list(enumerate(items)))
    seen, packed = after_stages(spark, tmp_path)
    assert {r["doc_id"]: r["text"] for r in seen["decontamination"].collect()} == naive_lines_and_leaks(texts, items)
    assert packed.select("doc_id").distinct().count() == len(texts)
