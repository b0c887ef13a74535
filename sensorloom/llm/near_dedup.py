"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

1. Words (runs of letters, digits and non-ASCII, A-Z in lower case) are hashed, and the documents that hold each are
   counted. A word's inverse document frequency is ``ln(1 + 1 / max(share of documents, rare))``: below a share of ``rare``
   all words weigh alike. So only the words over it need a table, which holds at most (mean number of distinct words of
   a document) / ``rare`` of them, whatever the corpus.
2. A text's shingles are its runs of five words (a text of fewer is one shingle). A shingle weighs how often
   the text has it times the mean inverse document frequency of its words. The mean is over words, not over
   shingles: whole shingles of a large group of near copies would be frequent and weigh little, and the few
   words that differ would then outweigh all that is shared.
3. Improved consistent weighted sampling (Ioffe 2010) draws 64 samples from the weights. Two texts agree in a
   sample with the probability of their weighted Jaccard similarity; 16 bands of 4 samples bring together a
   pair of similarity 0.8 with probability 0.9998.
4. Texts of the same words are one node. In each bucket of a band, every node is compared with one leader by exact weighted
   Jaccard similarity of whole texts. Links make components. That settles groups of close copies at a cost in
   proportion to their size, and all buckets of two.
5. What buckets still hold several components is compared whole, group by group, in one task each. Only texts that share
   one of their rarest shingles can be similar (the rest of a text weighs too little), so an index of those finds the pairs
   to compare; none that reaches the similarity is missed. A group names links of components only, no pairs.
6. A group too large for one task is split by further samples, four at a time, in 16 ways; a pair of similarity 0.8 parts
   in all of them with probability 0.0001. After ``splits`` such rounds, texts agree in so many samples that few unlinked ones are
   left; groups still too large are dealt to pairs of blocks, where rows, only these, grow with the square of their number.

Result: a row for each row of ``docs`` with ``class_id``, the smallest ``doc_id`` of its class.

Texts without words are one node if they are equal, whole, and similar to no other; a null text equals null only. A row
with a null ``doc_id`` belongs to the class of its text; ``class_id`` is null if no member has an id. Repeated rows, and rows that
share a ``doc_id``, each get the class of their text. Very long texts are shingled whole. Of equally good leaders or rows to keep
the one with the smaller id goes first. An empty table gives an empty result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sensorloom.llm.batches import as_batch, lengths_to_offsets, map_batches, slices
from sensorloom.llm.words import BASE, WordHasher, mixed, word_groups
from sensorloom.plans.components import connected_components
from sensorloom.plans.scratch import written

#: Distinct words that a task counts before it sends them on.
TABLE = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``rare``: share of documents below which all words weigh alike. ``group_rows``, ``group_bytes``: what one task compares at once."""

    width: int = 5
    similarity: float = 0.8
    bands: int = 16
    rows: int = 4
    rare: float = 0.01
    leader_rows: int = 1024
    group_rows: int = 4096
    group_bytes: int = 8 << 20
    splits: int = 2

    @property
    def samples(self) -> int:
        return self.bands * self.rows


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies: of the words with a hash in ``words`` (sorted), and of all others."""

    words: np.ndarray
    idf: np.ndarray
    other: float

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.other, np.float32)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.idf[at], np.float32(self.other))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: how many documents hold each word, by its hash; the null word is in every document."""
    schema = T.StructType.fromDDL("word long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, hasher, n_docs = to_arrow_schema(schema), WordHasher(), 0
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def merge() -> None:
            nonlocal words, counts
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *fresh]), return_counts=True)
            words, where = np.unique(np.concatenate([words, found]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(words)).astype(np.int64)
            fresh.clear()

        for batch in slices(batches):
            n_docs += batch.num_rows
            with np.errstate(over="ignore"):
                for _, hashes, offsets in word_groups(batch.column(0).to_pylist(), hasher):
                    own = hashes ^ mixed(np.repeat(np.arange(1, len(offsets), dtype=np.uint64), np.diff(offsets)))
                    fresh.append(hashes[np.unique(own, return_index=True)[1]])
            if sum(map(len, fresh)) > TABLE:
                merge()
                if len(words) > TABLE:  # what a task holds is bounded; the sums meet in the shuffle
                    yield as_batch({"word": words.view(np.int64), "n": counts}, arrow)
                    words, counts = words[:0], counts[:0]
        merge()
        yield as_batch({"word": words.view(np.int64), "n": counts}, arrow)
        yield as_batch({"word": [None], "n": [n_docs]}, arrow)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def word_weights(docs: DataFrame, s: Settings = Settings()) -> Weights:
    """Weights by the document counts of all words of all ``docs``."""
    counts = written(word_counts(docs))
    n_docs = int((counts.where(F.col("word").isNull()).first() or {"n": 0})["n"] or 0)
    found = counts.where(F.col("word").isNotNull() & (F.col("n") >= s.rare * n_docs)).toPandas()  # see step 1 for the bound
    words, n = found["word"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.float64)
    order = np.argsort(words)
    return Weights(words[order], np.log1p(n_docs / n[order]).astype(np.float32), float(np.log1p(1 / s.rare)))


def shingles(hashes: np.ndarray, weights: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text, from its words' hashes and weights, and their TF-IDF weights, in order of the hash."""
    n, width = len(hashes), min(s.width, len(hashes))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    joined, mean = np.zeros(n - width + 1, np.uint64), np.zeros(n - width + 1, np.float32)
    for k in range(width):
        joined += hashes[k : k + len(joined)] * np.uint64(pow(BASE, 2 * k + 3, 1 << 64))
        mean += weights[k : k + len(joined)]
    joined = mixed(joined)
    order = np.argsort(joined)
    joined = joined[order]
    new = np.nonzero(np.concatenate([[True], joined[1:] != joined[:-1]]))[0]
    times = np.diff(np.append(new, len(joined)))
    return joined[new], mean[order[new]] / np.float32(width) * times.astype(np.float32)


def shingled(texts: list[str | None], weights: Weights, hasher: WordHasher, s: Settings) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """The words' hashes and the shingles of each text."""
    with np.errstate(over="ignore"):
        for _, hashes, offsets in word_groups(texts, hasher):
            weight = weights.of(hashes)
            for a, b in zip(offsets, offsets[1:], strict=False):
                yield hashes[a:b], shingles(hashes[a:b], weight[a:b], s)


def gamma_quantiles(n: int) -> np.ndarray:
    """Middle quantiles of n equal shares of the Gamma(2, 1) distribution."""
    q = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * q) + q
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - q) / np.maximum(x * np.exp(-x), 1e-12), 1e-9)
    return x


@functools.cache
def _gamma_cells() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles and their logarithms; 1024 x 1024 cells of neighbouring pairs (r, c), by the least ``ln c - r`` in them, and that."""
    q = gamma_quantiles(1 << 16)
    bound = (np.log(q[::64])[None, :] - q[63::64][:, None]).ravel()
    order = np.argsort(bound, kind="stable")
    return q.astype(np.float32), np.log(q).astype(np.float32), order.astype(np.uint32), bound[order]


class Sampler:
    """Improved consistent weighted sampling.

    A sample of a text is its shingle of least ``a = c / (y * exp(r))``, with r and c of Gamma(2, 1) and y at most the shingle's
    weight. So ``a`` is at least ``c * exp(-r) / weight``, and as the least ``a`` of a text seldom exceeds ``REACH`` / (sum of weights),
    few shingles can win. One cheap hash names the cell of (r, c) and tells which may; only those are drawn in full. Where
    none stays below the bound, all are. The result is the same as without the bound.
    """

    REACH = 5.0
    #: Shingles that are looked at together.
    AT_ONCE = 2048

    def __init__(self, samples: int) -> None:
        self.samples = samples
        self.q, self.ln_q, self.cell, bound = _gamma_cells()
        steps = 1 << 14
        self.low, self.per = bound[0], np.float32((steps - 1) / (bound[-1] - bound[0]))
        upto = np.searchsorted(bound, self.low + (np.arange(steps) + 1) / self.per, side="right")
        self.below = np.minimum(upto.astype(np.uint64) << np.uint64(12), np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.seeds = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
        self.short_seeds = (self.seeds >> np.uint64(20)).astype(np.uint32) | np.uint32(1)

    @staticmethod
    def _cheap(keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        z = keys * seeds
        z ^= z >> np.uint32(15)
        z *= np.uint32(0x85EBCA6B)
        return z

    def _drawn(self, sample: np.ndarray, keys: np.ndarray, short: np.ndarray, ln_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ln a`` and level of each shingle in its sample."""
        cell = self.cell[self._cheap(short, self.short_seeds[sample]) >> np.uint32(12)]
        z = keys * self.seeds[sample]
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        high = (z >> np.uint64(32)).astype(np.uint32)
        beta = (z & np.uint64(0xFFFFFFFF)).astype(np.float32) * np.float32(2.0**-32)
        r = self.q[(cell >> np.uint32(10) << np.uint32(6)) | high >> np.uint32(26)]
        ln_c = self.ln_q[((cell & np.uint32(1023)) << np.uint32(6)) | high >> np.uint32(20) & np.uint32(63)]
        level = np.floor(ln_w / r + beta)
        return ln_c - r * (level - beta + 1), level

    @staticmethod
    def _names(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
        return (mixed(keys ^ level.astype(np.int64).astype(np.uint64) * np.uint64(BASE)) >> np.uint64(32)).astype(np.uint32)

    def sample(self, own: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """32-bit names of the shingle and level that each sample draws, a row for each text; no text without shingles."""
        out = np.zeros((len(own), self.samples), np.uint32)
        if not own:
            return out
        offsets = lengths_to_offsets(np.array([len(k) for k, _ in own]))
        keys, weights = np.concatenate([k for k, _ in own]), np.concatenate([w for _, w in own])
        text, ln_w = np.repeat(np.arange(len(own)), np.diff(offsets)), np.log(weights)
        short = (keys >> np.uint64(32)).astype(np.uint32)
        limit = np.log(self.REACH / np.add.reduceat(weights.astype(np.float64), offsets[:-1])).astype(np.float32)
        below = self.below[np.clip((limit[text] + ln_w - self.low) * self.per, 0, len(self.below) - 1).astype(np.int32)]
        first = 0
        while first < len(own):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + self.AT_ONCE, side="right")) - 1)
            samples, places = [], []
            for a in range(offsets[first], offsets[last], self.AT_ONCE):
                b = min(offsets[last], a + self.AT_ONCE)
                flat = np.flatnonzero((self._cheap(short[None, a:b], self.short_seeds[:, None]) < below[None, a:b]).ravel())
                samples.append(flat // (b - a))
                places.append(flat - samples[-1] * (b - a) + a)
            sample, at = np.concatenate(samples), np.concatenate(places)
            if len(samples) > 1:
                order = np.argsort(sample, kind="stable")
                sample, at = sample[order], at[order]
            n = last - first
            best, names = np.full(n * self.samples, np.inf, np.float32), np.zeros(n * self.samples, np.uint32)
            self._least(sample * n + text[at] - first, sample, at, (keys, short, ln_w), best, names)
            # Texts of which no shingle has been found below the bound in a sample.
            again = np.nonzero(best > np.tile(limit[first:last], self.samples))[0]
            if len(again):
                size = np.diff(offsets)[again % n + first]
                start = lengths_to_offsets(size)
                at = np.arange(start[-1]) - np.repeat(start[:-1] - offsets[again % n + first], size)
                self._least(np.repeat(again, size), np.repeat(again // n, size), at, (keys, short, ln_w), best, names)
            out[first:last] = names.reshape(self.samples, n).T
            first = last
        return out

    def _least(self, group: np.ndarray, sample: np.ndarray, at: np.ndarray, shingle: tuple[np.ndarray, ...], best: np.ndarray, names: np.ndarray) -> None:
        """Puts the least ``ln a`` of each group of neighbouring rows, and its name, to the group's place."""
        if len(group):
            keys, short, ln_w = (x[at] for x in shingle)
            ln_a, level = self._drawn(sample, keys, short, ln_w)
            start = np.nonzero(np.concatenate([[True], group[1:] != group[:-1]]))[0]
            best[group[start]] = np.minimum.reduceat(ln_a, start)
            won = np.nonzero(ln_a == best[group])[0][::-1]  # of equals the first
            names[group[won]] = self._names(keys[won], level[won])


def wordless_node(text: str | None) -> bytes:
    """A digest of a whole text without words."""
    return xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"), seed=1 if text is None else 2)


def signatures(docs: DataFrame, weights: Weights, s: Settings = Settings()) -> DataFrame:
    """``row_id, doc_id, text, carried, hi, lo, samples array<int>, buckets array<long>``.

    ``row_id`` is unique, ``carried`` holds the other columns; ``hi, lo`` name the words, or without any the whole text,
    which then is in no bucket.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(True).alias("_"), *others).alias("carried"))
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("hi long, lo long, samples array<int>, buckets array<long>")])
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # see step 1 for the bound

    def make():
        hasher, sampler = WordHasher(), Sampler(s.samples)
        band = (np.arange(s.bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(BASE)

        def sign(batch: pa.RecordBatch) -> dict:
            texts = batch.column(2).to_pylist()
            nodes, own = [], []
            for text, (hashes, found) in zip(texts, shingled(texts, sent.value, hasher, s), strict=True):
                nodes.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else wordless_node(text))
                own.append(found)
            there = np.array([len(k) > 0 for k, _ in own], bool)
            with np.errstate(over="ignore"):
                drawn = sampler.sample([x for x in own if len(x[0])])
                buckets = np.repeat(band[None, :], len(drawn), 0)
                for k in range(s.rows):
                    buckets = mixed(buckets ^ drawn[:, k :: s.rows].astype(np.uint64))
            halves = np.frombuffer(b"".join(nodes), "<i8").reshape(-1, 2)
            passed = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            return passed | {"hi": halves[:, 0], "lo": halves[:, 1], "samples": _lists(drawn.view(np.int32), there), "buckets": _lists(buckets.view(np.int64), there)}

        return sign

    return map_batches(rows, make, schema)


def _lists(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """Rows of ``values`` as lists; empty ones where nothing is there."""
    offsets = lengths_to_offsets(there * values.shape[1]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of least over sum of greatest weights."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(0, bool)
    low = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    high = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - low
    return low / high if high else 0.0


def star_links(pairs: DataFrame, texts: DataFrame, weights: Weights, s: Settings) -> DataFrame:
    """``src, dst``: those of ``pairs(leader, node)`` that have the similarity asked for.

    A leader's text goes once to each ``leader_rows`` of its nodes, in rows that follow it.
    """
    parts = written(pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / s.leader_rows).cast("long").alias("parts")))
    own = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(1).alias("follows"), "node")
    leaders = parts.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("follows"), F.col("leader").alias("node"))
    rows = own.union(leaders).join(texts.select("node", "text").hint("merge"), "node").select("leader", "part", "follows", "node", "text")
    sent = pairs.sparkSession.sparkContext.broadcast(weights)

    def make():
        hasher, lead = WordHasher(), None

        def compare(batch: pa.RecordBatch) -> dict:
            nonlocal lead
            out: dict[str, list] = {"src": [], "dst": []}
            columns = [batch.column(k).to_pylist() for k in (0, 2, 3, 4)]
            for leader, follows, node, (_, own) in zip(*columns[:3], shingled(columns[3], sent.value, hasher, s), strict=True):
                if not follows:
                    lead = own
                elif similarity(lead, own) >= s.similarity - 1e-9:
                    out["src"].append(leader), out["dst"].append(node)
            return out

        return compare

    dealt = rows.repartition("leader", "part").sortWithinPartitions("leader", "part", "follows")
    return map_batches(dealt, make, "src long, dst long")


def links_within(own: list[tuple[np.ndarray, np.ndarray]], component: np.ndarray, s: Settings, wanted=None) -> list[tuple[int, int]]:
    """Links that join the components of one group of texts as far as similar texts do.

    ``wanted(k, others)``: which rows after k to compare with it, all without it. Takes a byte for each two texts.
    """
    m = len(own)
    size, total = np.array([len(k) for k, _ in own]), np.array([w.sum(dtype=np.float64) for _, w in own])
    key, weight, text = np.concatenate([k for k, _ in own]), np.concatenate([w for _, w in own]).astype(np.float64), np.repeat(np.arange(m), size)
    order = np.argsort(key, kind="stable")
    key, weight, text = key[order], weight[order], text[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    number, first = np.cumsum(new) - 1, np.nonzero(new)[0]
    held_by = np.diff(np.append(first, len(key)))
    # Each text's shingles, rarest first, until those that follow weigh less than the similarity asks for.
    rare = np.lexsort((number, held_by[number], text))
    before = np.cumsum(weight[rare]) - weight[rare]
    start = lengths_to_offsets(size)[:-1]
    before -= np.repeat(before[start], size)
    rare = rare[(before <= (1 - s.similarity + 1e-6) * total[text[rare]]) & (held_by[number[rare]] > 1)]
    rare = np.sort(rare)  # by shingle, then by text
    shingle, holder, step = number[rare], text[rare], 1
    share = np.zeros((m, m), bool)
    while step < len(rare) and (same := shingle[step:] == shingle[:-step]).any():
        share[holder[:-step][same], holder[step:][same]] = True
        step += 1
    place = np.empty(len(order), np.int64)  # where each text's shingles stand among the sorted ones
    place[order] = np.arange(len(order))
    label, found = component.copy(), []
    for k in range(m):
        others = np.flatnonzero(share[k])
        others = others[label[others] != label[k]]
        if wanted is not None and len(others):
            others = others[wanted(k, others)]
        if len(others) <= 8:
            likeness = np.array([similarity(own[k], own[j]) for j in others])
        else:  # all at once, by who holds the text's shingles
            at = number[place[start[k] : start[k] + size[k]]]
            count = held_by[at]
            rows = np.repeat(first[at] - lengths_to_offsets(count)[:-1], count) + np.arange(count.sum())
            low = np.bincount(text[rows], np.minimum(np.repeat(own[k][1].astype(np.float64), count), weight[rows]), m)[others]
            likeness = low / (total[others] + total[k] - low)
        for j in others[likeness >= s.similarity - 1e-9] if len(others) else ():
            if label[j] != label[k]:
                found.append((int(component[k]), int(component[j])))
                label[label == label[j]] = label[k]
    return found


def group_links(rows: DataFrame, texts: DataFrame, weights: Weights, s: Settings) -> DataFrame:
    """``src, dst``: links of components within each group of ``rows(group, bucket, node, component)``.

    Texts that share several buckets of samples are compared in the first of them only; ``bucket`` is null in other groups.
    """
    schema = T.StructType.fromDDL("src long, dst long")
    dealt = rows.join(texts.select("node", "text", "buckets").hint("merge"), "node").select("group", "bucket", "component", "text", "buckets")
    dealt = dealt.repartition("group").sortWithinPartitions("group")
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, hasher, held = to_arrow_schema(schema), WordHasher(), []

        def links() -> pa.RecordBatch:
            group = pa.Table.from_batches(held)
            held.clear()
            component, bucket = group.column("component").to_numpy(), group.column("bucket")[0].as_py()
            buckets = np.array(group.column("buckets").to_pylist(), np.int64)
            own = [found for _, found in shingled(group.column("text").to_pylist(), sent.value, hasher, s)]

            def first_here(k: int, others: np.ndarray) -> np.ndarray:
                return buckets[k][(buckets[others] == buckets[k]).argmax(1)] == bucket

            found = links_within(own, component, s, first_here if bucket is not None else None)
            return as_batch({"src": [a for a, _ in found], "dst": [b for _, b in found]}, arrow)

        for batch in slices(batches):
            group = batch.column(0).to_numpy()
            cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != group[a]:
                    yield links()
                held.append(batch.slice(a, b - a))
        if held:
            yield links()

    return dealt.mapInArrow(run, schema).distinct()


def split_groups(rows: DataFrame, texts: DataFrame, s: Settings, level: int) -> DataFrame:
    """``rows`` by further samples: 16 ways at once to deal each group, four other samples in each."""
    ways = np.random.default_rng(level).permutation(s.samples).reshape(-1, s.rows)
    groups = [F.xxhash64(F.col("group"), F.lit(level * 1000 + k), *[F.col("samples")[int(x)] for x in way]) for k, way in enumerate(ways)]
    both = rows.join(texts.select("node", "samples"), "node")
    return both.select(F.explode(F.array(*groups)).alias("group"), F.lit(None).cast("long").alias("bucket"), "node", "component", "size")


def block_pairs(rows: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """``rows`` of each group dealt to pairs of blocks that one task can hold, so that any two rows meet."""
    blocks = F.greatest(F.ceil(2 * F.col("n") / s.group_rows), F.ceil(2 * F.col("bytes") / s.group_bytes)).cast("long")
    dealt = rows.join(sizes.select("group", blocks.alias("blocks")), "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other")).alias("group"), F.lit(None).cast("long").alias("bucket"), "node", "component", "size")


def groups_for_tasks(rows: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """``rows(group, bucket, node, component, size)`` of groups with several components, each small enough for a task."""
    ready = []
    for level in range(s.splits + 1):
        rows = written(rows)
        sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("component").alias("a"), F.max("component").alias("b"))
        sizes = written(sizes.where(F.col("a") != F.col("b")).select("group", "n", "bytes"))
        fits = (F.col("n") <= s.group_rows) & (F.col("bytes") <= s.group_bytes) | (F.col("n") <= 2)
        ready.append(rows.join(sizes.where(fits).select("group"), "group"))
        large = sizes.where(~fits)
        if large.isEmpty():
            break
        rest = rows.join(large.select("group"), "group")
        if level == s.splits:
            ready.append(block_pairs(rest, large, s))
        else:
            rows = split_groups(rest, texts, s, level + 1)
    return functools.reduce(DataFrame.unionByName, ready)


def labelled_rows(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The signed rows of ``docs``, written, and ``row_id, doc_id, class_id, component`` of each."""
    # Joins with texts or all rows are merges at any size: what is left of a corpus may be broadcast only while it is small.
    weights = word_weights(docs, s)
    signed = written(signatures(docs, weights, s))
    # A node is the first row of its words.
    nodes = written(signed.groupBy("hi", "lo").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("least")))
    members = written(signed.select("row_id", "buckets").hint("merge").join(nodes.select(F.col("node").alias("row_id")), "row_id").select(F.col("row_id").alias("node"), F.explode("buckets").alias("bucket")))
    shared = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where(F.col("n") > 1))
    members = written(members.hint("merge").join(shared, "bucket"))
    candidates = members.select(F.col("node").alias("row_id")).distinct()
    texts = written(signed.hint("merge").join(candidates, "row_id").select(F.col("row_id").alias("node"), "text", "samples", "buckets"))

    pairs = written(members.where(F.col("node") != F.col("leader")).select("leader", "node").distinct())
    near = written(connected_components(written(star_links(pairs, texts, weights, s))))
    sizes = texts.select("node", F.octet_length("text").cast("long").alias("size"))
    left = members.where(F.col("n") > 2).join(sizes, "node").join(near, "node", "left")
    left = left.select(F.col("bucket").alias("group"), "bucket", "node", F.coalesce("component", "node").alias("component"), "size")
    links = written(group_links(groups_for_tasks(left, texts, s), texts, weights, s))
    merged = written(connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("into")))

    named = nodes.join(near, "node", "left").withColumn("component", F.coalesce("component", "node")).join(merged, "component", "left")
    named = written(named.select("hi", "lo", "least", F.coalesce("into", "component").alias("component")))
    ids = written(named.groupBy("component").agg(F.min("least").alias("class_id")))
    named = written(named.join(ids, "component").select("hi", "lo", "class_id", "component"))
    return signed, signed.select("row_id", "doc_id", "hi", "lo").join(named, ["hi", "lo"]).select("row_id", "doc_id", "class_id", "component")


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, class_id`` for each row of ``docs``."""
    return labelled_rows(docs.select("doc_id", "text"), s)[1].select("doc_id", "class_id")


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row of the smallest ``doc_id``."""
    signed, rows = labelled_rows(docs, s)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first"))
    kept = signed.join(first.select("first.row_id"), "row_id", "left_semi")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("carried").getField(c).alias(c) for c in docs.columns])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each of ``documents``."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLE_SQL: dict[str, str] = {}
