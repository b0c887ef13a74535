"""Benchmark decontamination with an FM-index for each shard of training text.

A window is ``width`` consecutive words of a benchmark item; a shorter item is one window. Documents of a partition with about a megabyte
of text, or one longer, are a shard. Its words become symbols: words of the benchmark have their own, any other word
breaks the text, since no window can span it. Stretches between such breaks that are shorter than the
shortest window can't hold one; all others are indexed. Windows whose words all occur in them are searched backward through wavelet
ranks, occurrences are located through sampled suffix positions, and overlapping ones merge into spans.

No documents are shuffled and each row is judged alone, so skew doesn't matter. The benchmark is sent to the executors in blocks of
``BLOCK_BYTES`` of item text (or one longer item), as arrays of about ten times that at most: four bytes a word, sixteen a window. With several blocks,
each is one more pass over the documents, whose hits are written before the next begins, so one block is in memory at a time.

Null or wordless text has no words and no hits; very long texts are searched whole; repeated rows are each judged. Items without words have no
windows; those without an id mark words but are not named; items of equal text are all named. An empty benchmark or table is allowed. Other
columns pass through, whatever their names: results go to one struct column with a free name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sensorloom.llm.batches import as_batch, free_name, lengths_to_offsets, map_batches, map_whole_rows, slices
from sensorloom.llm.fm_index import FMIndex
from sensorloom.llm.words import WordHasher, word_groups
from sensorloom.plans.scratch import written

#: Bytes of benchmark text that one pass sends to the executors.
BLOCK_BYTES = 4 << 20
#: Bytes of text of a shard, if it isn't one longer text.
SHARD_BYTES = 1 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LEAKS = "struct<n_words: bigint, spans: array<struct<first: bigint, end: bigint>>, items: array<string>>"


@dataclass(frozen=True)
class Windows:
    """Distinct windows of a block of items.

    ``words``: hashes of the block's words in order; ``text``: the items' words one after the other, a word as its number plus 2 (0 ends
    an index, 1 breaks it); ``start, lengths``: where in it each distinct window stands; ``owners[offsets[k] : offsets[k + 1]]``: the items of window k.
    """

    words: np.ndarray
    text: np.ndarray
    start: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray
    owners: np.ndarray
    item_ids: list[str | None]


def windows(items: list[tuple[str | None, str | None]], width: int) -> Windows:
    hashed, counts = [np.zeros(0, np.uint64)], []
    for _, hashes, offsets in word_groups([text for _, text in items], WordHasher()):
        hashed.append(hashes)
        counts += np.diff(offsets).tolist()
    known, text = np.unique(np.concatenate(hashed), return_inverse=True)
    text, size = (text + 2).astype(np.int32), np.array(counts, np.int64)
    n = np.where(size > 0, np.maximum(1, size - width + 1), 0)
    item = np.repeat(np.arange(len(items)), n)
    start = np.repeat(lengths_to_offsets(size)[:-1] - lengths_to_offsets(n)[:-1], n) + np.arange(n.sum())
    lengths = np.minimum(size, width)[item]
    # Equal windows are one.
    padded = np.concatenate([text, np.zeros(width, np.int32)])
    rows = padded[start[:, None] + np.arange(width)] * (np.arange(width) < lengths[:, None])
    first, which = np.unique(rows.astype(np.int32), axis=0, return_index=True, return_inverse=True)[1:] if len(rows) else (np.zeros(0, np.int64),) * 2
    pairs = np.unique(which.ravel() * max(1, len(items)) + item)
    owner, window = pairs % max(1, len(items)), pairs // max(1, len(items))
    return Windows(known, text, start[first].astype(np.int64), lengths[first].astype(np.int32), np.searchsorted(window, np.arange(len(first) + 1)), owner.astype(np.int32), [i for i, _ in items])


def long_stretches(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all stretches of at least ``least`` known words, with a break after each, and their places."""
    edges = np.diff(np.concatenate([[0], (symbols > 1).astype(np.int8), [0]]))
    start, end = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    keep = end - start >= least
    start, end = start[keep], end[keep]
    lengths = end - start + 1
    at = np.repeat(start - lengths_to_offsets(lengths)[:-1], lengths) + np.arange(lengths.sum())
    padded = np.append(symbols, 1)
    return padded[at], at


def occurrences(symbols: np.ndarray, block: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Where in the shard's symbols windows occur, and which."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(block.lengths):
        return none
    indexed, at = long_stretches(symbols, int(block.lengths.min()))
    if not len(indexed):
        return none
    there = np.zeros(len(block.words) + 2, bool)
    there[indexed] = True
    absent = lengths_to_offsets(~there[block.text])
    window = np.nonzero(absent[block.start + block.lengths] == absent[block.start])[0]
    if not len(window):
        return none
    index = FMIndex(indexed, len(block.words) + 2)
    low, high = index.search(block.text, block.start[window], block.lengths[window])
    which = np.repeat(np.arange(len(window)), high - low)
    rows = np.arange(len(which)) - np.repeat(lengths_to_offsets(high - low)[:-1], high - low) + low[which]
    return at[index.locate(rows)], window[which]


def covered(texts: list[str | None], block: Windows, hasher: WordHasher) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its number of words, the spans of those that lie in windows, and the items of the windows."""
    for _, hashes, offsets in word_groups(texts, hasher, SHARD_BYTES):
        counts = np.diff(offsets)
        # A break after each text keeps windows within it.
        symbols = np.ones(len(hashes) + len(counts), np.int64)
        if len(block.words):
            at = np.minimum(np.searchsorted(block.words, hashes), len(block.words) - 1)
            symbols[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = np.where(block.words[at] == hashes, at + 2, 1)
        place, window = occurrences(symbols, block)
        text = np.searchsorted(offsets[:-1] + np.arange(len(counts)), place, side="right") - 1
        hit = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(hit, place, 1)
        np.add.at(hit, place + block.lengths[window], -1)
        edges = np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8), [0]]))
        first, end = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
        span_text = np.searchsorted(offsets[:-1] + np.arange(len(counts)), first, side="right") - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in counts]
        for k, a, b in zip(span_text.tolist(), first.tolist(), end.tolist(), strict=True):
            spans[k].append((a - int(offsets[k]) - k, b - int(offsets[k]) - k))
        found: list[set[str]] = [set() for _ in counts]
        for pair in np.unique(text * max(1, len(block.lengths)) + window).tolist():
            k, w = divmod(pair, len(block.lengths))
            found[k].update(i for o in block.owners[block.offsets[w] : block.offsets[w + 1]] if (i := block.item_ids[o]) is not None)
        yield from zip(counts.tolist(), spans, found, strict=True)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words in spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def leaks_column(docs: DataFrame) -> str:
    """The name of the column that ``find_leaks`` adds to ``docs``."""
    return free_name(docs, "leaks")


def _with_leaks(docs: DataFrame, name: str, of: Callable[[], Callable[[pa.RecordBatch], list]], drop: str = "") -> DataFrame:
    """``docs`` with a struct column; ``of()`` gives a function from a batch to its values ``(n_words, spans, items)``."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != drop]).add(name, T._parse_datatype_string(LEAKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, values = to_arrow_schema(schema), of()
        for batch in slices(batches):
            own = [{"n_words": n, "spans": [{"first": a, "end": b} for a, b in spans], "items": sorted(items)} for n, spans, items in values(batch)]
            yield as_batch({c: batch.column(k) for k, c in enumerate(batch.schema.names)} | {name: own}, arrow)

    return map_whole_rows(docs, run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column named ``leaks_column(docs)``: ``n_words``, merged ``spans`` of hit words (first, end) and sorted ``items``."""
    spark, name = docs.sparkSession, leaks_column(docs)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-size // block_bytes))

    def block(k: int) -> Windows:
        own = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        return windows([(r["item_id"], r["text"]) for r in own.collect()], width)  # about block_bytes

    if n_blocks == 1:
        sent = spark.sparkContext.broadcast(block(0))
        text_at = docs.columns.index("text")

        def search():
            hasher = WordHasher()
            return lambda batch: covered(batch.column(text_at).cast(pa.string()).to_pylist(), sent.value, hasher)

        return _with_leaks(docs, name, search)

    row_id, hits = free_name(docs, "row_id"), None
    rows = written(docs.withColumn(row_id, F.monotonically_increasing_id()))
    for k in range(n_blocks):
        sent = spark.sparkContext.broadcast(block(k))

        def found_in(sent=sent):
            hasher = WordHasher()

            def search(batch: pa.RecordBatch) -> dict:
                out: dict[str, list] = {"row": [], "spans": [], "items": []}
                for row, (_, spans, names) in zip(batch.column(0).to_pylist(), covered(batch.column(1).to_pylist(), sent.value, hasher), strict=True):
                    if spans:
                        out["row"].append(row), out["items"].append(sorted(names))
                        out["spans"].append([{"first": a, "end": b} for a, b in spans])
                return out

            return search

        own = written(map_batches(rows.select(row_id, F.col("text").cast("string")), found_in, "row long, spans array<struct<first: bigint, end: bigint>>, items array<string>"))
        hits = own if hits is None else hits.unionByName(own)
        sent.destroy()
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    found = free_name(rows, "hits")
    hits = hits.select(F.col("row").alias(row_id), F.struct("spans", "items").alias(found))
    joined = rows.join(hits, row_id, "left").select(*[F.col(f"`{c}`") for c in docs.columns], found)
    text_at = docs.columns.index("text")

    def merge():
        hasher = WordHasher()

        def values(batch: pa.RecordBatch) -> Iterator[tuple]:
            counts = (n for _, _, offsets in word_groups(batch.column(text_at).cast(pa.string()).to_pylist(), hasher) for n in np.diff(offsets).tolist())
            for n, hit in zip(counts, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                yield (n, merged([(s["first"], s["end"]) for s in hit["spans"]]), set(hit["items"])) if hit else (n, [], set())

        return values

    return _with_leaks(joined, name, merge, drop=found)


def remove_spans(leaks: DataFrame, column: str) -> DataFrame:
    """Cuts the text of the spans in ``column``, from the first word to the last one's end; drops texts that keep no word by it, and the column."""
    columns = [c for c in leaks.columns if c != column]
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in leaks.schema if f.name in columns])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in slices(batches):
            out = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            texts = out["text"].cast(pa.string()).to_pylist()
            keep = np.ones(len(texts), bool)
            for k, found in enumerate(out[column].to_pylist()):
                if found["spans"]:
                    data = texts[k].encode("utf-8", "surrogatepass")
                    bounds = [m.span() for m in _WORD.finditer(data)]
                    parts, end = [], 0
                    for span in found["spans"]:
                        parts.append(data[end : bounds[span["first"]][0]])
                        end = bounds[span["end"] - 1][1]
                    texts[k] = b"".join([*parts, data[end:]]).decode("utf-8", "surrogatepass")
                    keep[k] = sum(s["end"] - s["first"] for s in found["spans"]) < len(bounds)
            yield as_batch({c: out[c] for c in columns} | {"text": texts}, arrow).filter(pa.array(keep))

    return map_whole_rows(leaks, run, schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of all ``benchmark`` items into all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "leaks.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE_SQL = {
    "op1_decontamination": r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
win as (
  select item_id, array_to_string(ws[i : i + 9], ' ') w, least(len(ws), 10) n
  from (select item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) i from bw where len(ws) > 0)),
sizes as (select distinct n from win),
spots as (
  select doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') w
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from dw, sizes where len(ws) >= n)),
hits as (select doc_id, i, s.n, item_id from spots s join win using (w, n)),
named as (select distinct doc_id, cast(item_id as varchar) item_id from hits),
items as (select doc_id, count(*) n_items, sha256(string_agg(item_id, ',' order by item_id)) h from named group by doc_id),
places as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id)
select doc_id, cast(len(ws) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       coalesce(h, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join items using (doc_id) left join places using (doc_id)
"""
}
