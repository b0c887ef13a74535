"""Toxicity by weak supervision.

1. Terms, whole words and word beginnings, that mark toxic texts are mined from a bounded sample of labelled
   documents (``SAMPLE`` of each label). Strong ones, and the topics of a public-knowledge word list, are lexicon voters, one for each band of
   strength and each topic. Pattern voters look at how terms are used (spelt with signs or spaced letters, aimed at a "you", in capitals, with
   exclamation marks, repeated) and at how many and how dense they are. A voter says toxic, clean, or abstains.
2. A generative label model with two latent classes is fitted by expectation maximisation to the votes of all documents. Within a class
   votes depend on each other along a tree: the spanning tree of the largest conditional mutual informations, found anew in each round. So
   it estimates each voter's accuracy and how voters repeat each other. The sample's labels anchor the classes. Equal votes are one cell, so its sums run over all documents at little cost.
3. A linear classifier over the terms and votes is trained on the posterior labels of the sample's documents;
   it scores every text.

Null and empty texts have no terms and score as such. Words of any length count, by their beginnings too; texts are matched whole, however
long. Of copies in the sample the row of the smallest ``doc_id`` is learnt from, then of the smallest text hash. Repeated rows are scored each. Without
toxic and clean rows to learn from there are no terms, and every score is 0. An empty table gives an empty result. Other columns pass
through, whatever their names; the score goes to a column with a free name.

Parameters of the model that bound it, not the data: ``SAMPLE`` labelled documents of each label; ``TERMS`` terms of most evidence, of them
``STRONG`` strong ones; a term needs ``LEAST`` toxic documents of the sample, below which its odds can't be told from chance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sensorloom.llm.batches import as_batch, free_name, id_and_text, map_batches, map_whole_rows, slices, summed
from sensorloom.llm.folds import bounded_sample, held_out, learnable
from sensorloom.llm.words import BASE, FOLD, WordHasher, mixed, word_groups, words
from sensorloom.plans.scratch import written

#: Labelled documents of each label that terms and the classifier are learnt from, at most.
SAMPLE = 10_000
#: Terms kept, at most, and the lengths of word beginnings.
TERMS, STRONG, LEAST, BEGINNINGS = 1500, 160, 3, (4, 5, 6, 7, 8)
EVIDENCE = 16.0
BANDS = 6
#: Words of abuse in four languages by topic, none a plain word of another of the four; a star stands for any ending.
TOPICS: dict[str, tuple[str, ...]] = {
    "wits": ("idiot*", "moron*", "stupid*", "dumb", "dumbass", "imbecil*", "fool", "fools", "dimwit*", "halfwit*", "dumm", "dummkopf", "trottel", "depp", "blöd*", "stupide*", "crétin*", "débile*", "abruti*", "idiota*", "estúpid*", "tonto", "tonta", "imbécil*"),
    "worth": ("loser*", "worthless", "pathetic", "useless", "failure", "clown", "clowns", "wertlos", "versager*", "nichtsnutz*", "minable*", "raté*", "inútil*", "patétic*", "fracasad*"),
    "contempt": ("scum", "trash", "garbage", "vermin", "filth*", "disgusting", "abschaum", "dreck*", "ekelhaft*", "ordure*", "racaille", "pourri*", "basura", "escoria", "asqueros*"),
    "threat": ("kill", "stab", "strangle", "umbringen", "verrecke*", "crève*", "crever", "matar", "muérete"),
    "profanity": ("fuck*", "shit*", "bitch*", "bastard*", "asshole*", "crap", "scheiß*", "arschloch", "wichser", "merde*", "connard*", "salaud*", "putain", "puta", "mierda", "cabrón", "joder"),
    "silence": ("shut", "maul", "klappe", "gueule", "cállate", "lárgate", "dégage*", "verschwinde*"),
}
#: Topics whose words count as used like mined strong terms; the others' words are abuse in some contexts only.
PLAIN = ("wits", "worth", "contempt", "profanity")
#: Words that address the reader.
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre tú usted eres vos".split())
#: Signs that stand for letters.
SIGNS = bytes.maketrans(b"013457@$!", b"oieastasi")
_SPELT = re.compile(rb"(?<![A-Za-z])(?:[A-Za-z@$]+(?:[0-9@$!*_.\-]+[A-Za-z@$]+)+|[A-Za-z](?: [A-Za-z]){3,}(?![A-Za-z]))")
_BETWEEN = re.compile(rb"[^A-Za-z]+")


_WORD = re.compile(rb"[^ ]+")
#: Words before and after a term that are looked at, whatever their lengths.
BESIDE = 4


def words_before(folded: bytes, at: int) -> list[bytes]:
    """The last words that end before a place."""
    found: list[bytes] = []
    while at > 0 and len(found) < BESIDE:
        blank = folded.rfind(b" ", 0, at)
        if blank + 1 < at:
            found.append(folded[blank + 1 : at])
        at = blank
    return found


def terms_of(word: bytes) -> list[str]:
    """The word, and its beginnings with a star."""
    letters = word.decode("utf-8", "replace")
    return [letters, *(letters[:n] + "*" for n in BEGINNINGS if len(letters) >= n)]


@dataclass(frozen=True)
class Lexicon:
    """Mined terms by strength; the first ``n_strong`` mark toxic texts almost alone."""

    terms: list[str]
    n_strong: int


def one_of_each_copy(texts: DataFrame, sketches: int = 3, width: int = 8) -> DataFrame:
    """``text, label`` of ``doc_id, text, label`` without copies and near copies, whose words would look like evidence from several documents.

    A sketch is the least hash of a text's runs of ``width`` words; of texts that share one the first is kept.
    """

    def make():
        hasher = WordHasher()
        seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64))

        def sketch(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: batch.column(k) for k, c in enumerate(("doc_id", "text", "label"))} | {"sketches": []}
            with np.errstate(over="ignore"):
                for _, hashes, offsets in word_groups(batch.column(1).to_pylist(), hasher):
                    for a, b in zip(offsets, offsets[1:], strict=False):
                        n = min(width, b - a)
                        runs = np.zeros(max(1, b - a - n + 1), np.uint64)
                        for k in range(n):
                            runs += hashes[a + k : a + k + len(runs)] * np.uint64(pow(BASE, 2 * k + 1, 1 << 64))
                        out["sketches"].append([int(mixed(runs ^ seed).min() >> np.uint64(1)) for seed in seeds])
            return out

        return sketch

    found = map_batches(texts.select("doc_id", "text", "label"), make, "doc_id long, text string, label int, sketches array<long>")
    for k in range(sketches):
        row = F.struct("doc_id", F.xxhash64("text").alias("h"), "text", "label", "sketches")
        found = found.groupBy(F.col("sketches")[k].alias("own")).agg(F.min(row).alias("row")).select("row.doc_id", "row.text", "row.label", "row.sketches")
    return found.select("text", "label")


def mine_terms(texts: DataFrame) -> Lexicon:
    """From ``text, label``: terms by the log-odds of the documents that hold them."""

    def make():
        known: dict[bytes, list[str]] = {}

        def explode(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"term": [], "label": []}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: set[str] = set()
                for w in set(words(text)):
                    if len(w) > 40:
                        own.update(terms_of(w))  # not kept, so that the table stays small
                        continue
                    if w not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[w] = terms_of(w)
                    own.update(known[w])
                out["term"] += own
                out["label"] += [label] * len(own)
            return out

        return explode

    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon([], 0)
    counts = map_batches(texts.select("text", "label"), make, "term string, label int").groupBy("term").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    # Evidence, in nats, that a term's documents aren't drawn by chance; it must outweigh how many terms there are.
    base, n = n_toxic / (n_toxic + n_clean), F.col("toxic") + F.col("clean")
    evidence = F.col("toxic") * F.log(F.col("toxic") / (n * base)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - base)))).otherwise(0.0)
    found = counts.where(F.col("toxic") >= LEAST).withColumn("odds", odds).withColumn("evidence", evidence).where((F.col("odds") > 1.5) & (F.col("evidence") > EVIDENCE))
    # Of terms with the same documents the whole word or the longest beginning goes first.
    rows = found.orderBy(F.col("evidence").desc(), F.col("term").endswith("*"), F.length("term").desc(), "term").limit(TERMS).collect()
    held: dict[str, int] = {}
    strong, weak = [], []
    for r in rows:
        term, toxic = r["term"], r["toxic"]
        beginning = term.rstrip("*")
        covered = any(b != term and b in held for b in terms_of(beginning.encode())[1:])
        within = max((n for t, n in held.items() if term.endswith("*") and t.startswith(beginning)), default=0)
        if not covered and toxic >= 1.3 * within:
            held[term] = toxic
            (strong if r["odds"] > 3.5 and len(strong) < STRONG else weak).append(term)
    return Lexicon(strong + weak, len(strong))


@dataclass
class Seen:
    """What a text shows: terms found, counts, and the uses of strong terms."""

    terms: list[int]
    topics: set[int]
    strong: int
    weak: int
    n_words: int
    uses: set[str]


class Matcher:
    """Finds all terms of a text by one automaton over its folded bytes, a blank before and after each word."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.n_strong, self.automaton = lexicon.n_strong, ahocorasick.Automaton()
        self.plain = {k for k, topic in enumerate(TOPICS) if topic in PLAIN}
        held: dict[str, list[tuple[int, int]]] = {}
        for k, term in enumerate(lexicon.terms):
            held.setdefault(term, []).append((0, k))
        for k, terms in enumerate(TOPICS.values()):
            for term in terms:
                held.setdefault(term, []).append((1, k))
        for term, what in held.items():
            key = " " + term.rstrip("*").encode("utf-8", "replace").decode("latin-1") + ("" if term.endswith("*") else " ")
            self.automaton.add_word(key, (len(key), what))
        self.automaton.make_automaton()

    def _hits(self, folded: str) -> dict[int, list[tuple[int, int]]]:
        """What is found by where its word begins, in the text with one blank before it."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, what) in self.automaton.iter(folded):
            hits.setdefault(end - size + 1, []).extend(what)
        return hits

    def _strong(self, what: list[tuple[int, int]]) -> bool:
        return any(k in self.plain if kind else k < self.n_strong for kind, k in what)

    def __call__(self, text: str | None) -> Seen:
        data = (text or "").encode("utf-8", "surrogatepass")
        folded = data.translate(FOLD)
        hits = self._hits(f" {folded.decode('latin-1')} ")
        terms, topics, uses, times = set(), set(), set(), {}
        strong = weak = 0
        for at, what in hits.items():
            terms.update(k for kind, k in what if kind == 0)
            topics.update(k for kind, k in what if kind == 1)
            if not self._strong(what):
                weak += any(kind == 0 for kind, _ in what)
                continue
            strong += 1
            times[what[0]] = times.get(what[0], 0) + 1
            end = folded.find(b" ", at)
            end = len(data) if end < 0 else end
            if data[at:end].isupper():
                uses.add("capitals")
            after = list(islice(_WORD.finditer(folded, end), BESIDE + 1))
            if b"!" in data[end : end + 3] or data.find(b"!!", end, after[-1].start() if len(after) > BESIDE else len(data)) >= 0:
                uses.add("exclaimed")
            if not SECOND_PERSON.isdisjoint(words_before(folded, at)) or not SECOND_PERSON.isdisjoint(m[0] for m in after[:BESIDE]):
                uses.add("aimed")
        if max(times.values(), default=0) > 1:
            uses.add("repeated")
        # Words with signs for letters, or of single letters, that spell a strong term.
        for m in _SPELT.finditer(data):
            for spelt in {_BETWEEN.sub(b"", m[0].translate(SIGNS)), _BETWEEN.sub(b"", m[0])}:
                if len(spelt) > 3 and any(map(self._strong, self._hits(f" {spelt.decode('latin-1').lower()} ").values())):
                    uses.add("spelt")
        return Seen(sorted(terms), topics, strong, weak, len(folded.split()), uses)


USES = ("spelt", "aimed", "capitals", "exclaimed", "repeated")


def votes(seen: Seen, n_strong: int) -> list[int]:
    """0 abstains, 1 says clean, 2 says toxic."""
    bands = [0] * BANDS
    for k in seen.terms:
        if k < n_strong:
            bands[k * BANDS // n_strong] = 2
    strong, weak = seen.strong, seen.weak
    dense, weakly = strong / max(1, seen.n_words), weak / max(1, seen.n_words)
    return [
        *bands,
        *(2 if k in seen.topics else 0 for k in range(len(TOPICS))),
        *(2 if use in seen.uses else 0 for use in USES),
        2 if strong >= 2 else 0,
        2 if strong >= 4 else 0,
        1 if not strong else 0,
        2 if weak >= 2 else 1 if not weak else 0,
        2 if weak >= 4 else 0,
        2 if weakly >= 0.006 else 1 if weakly < 0.001 else 0,
        2 if dense >= 0.004 else 1 if dense == 0 else 0,
        1 if not strong and not weak else 0,
    ]


VOTERS = BANDS + len(TOPICS) + len(USES) + 8


def cell(own: list[int]) -> int:
    """All votes in one number, two bits each."""
    return sum(v << 2 * k for k, v in enumerate(own))


def vote_cells(docs: DataFrame, lexicon: Lexicon, label: str | None = None) -> DataFrame:
    """``cell, n``: all documents by their votes; or ``cell, n, label`` by their votes and a column of 0 and 1."""

    def make():
        match = Matcher(lexicon)
        return lambda batch: {"cell": [cell(votes(match(t), lexicon.n_strong)) for t in batch.column(0).to_pylist()]} | ({"label": batch.column(1)} if label else {})

    rows = docs.select(F.col("text").cast("string"), *([F.col(label).cast("double").alias("label")] if label else []))
    keys = ["cell", "label"] if label else ["cell"]
    counts = map_batches(rows, make, "cell long, label double" if label else "cell long").groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counts.select("cell", "n", *keys[1:])


def unpacked(cells: np.ndarray) -> np.ndarray:
    """The votes of cells: rows, voters."""
    return (cells[:, None] >> 2 * np.arange(VOTERS)[None, :] & 3).astype(np.int64)


@dataclass
class LabelModel:
    """``given[c, j, u, v]``: probability that voter j says v in class c (1: toxic) where its parent says u; without one, of any u.

    ``weight`` is one but in the first guess, where voters that say the same as many others count less.
    """

    prior: float
    parent: np.ndarray
    given: np.ndarray
    weight: np.ndarray

    def posterior(self, own: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for rows of votes."""
        above = own[:, np.maximum(self.parent, 0)]
        log = (np.log(self.given[:, np.arange(VOTERS)[None, :], above, own]) * self.weight).sum(2).T + np.log([1 - self.prior, self.prior])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def fit_label_model(cells: DataFrame, known: DataFrame | None = None, rounds: int = 16, anchor: float = 0.5) -> LabelModel:
    """Expectation maximisation over all ``cells(cell, n)``.

    ``known(cell, n, label)`` are votes on documents of known class. They give the first guess, and together weigh ``anchor`` times as
    much as all documents in each round; so the classes stay what they should be, and voters that depend on each other can't become classes of
    their own. Without them the first guess are discounted votes.
    """
    n = 3 * VOTERS

    def pair_counts(rows: DataFrame, m: LabelModel | None) -> np.ndarray:
        """How often voter i says u and voter j says v, by class: that of ``label``, or by the model's posterior."""

        def make():
            def add(batch: pa.RecordBatch) -> np.ndarray:
                cell, count = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                own = unpacked(cell)
                toxic = m.posterior(own) if m else batch.column(2).to_numpy(zero_copy_only=False)
                x = (own[:, :, None] == np.arange(3)).reshape(len(own), n).astype(float)
                return np.concatenate([(x.T @ (x * share[:, None])).ravel() for share in (count * (1 - toxic), count * toxic)])

            return add

        return summed(rows, make, 2 * n * n).reshape(2, VOTERS, 3, VOTERS, 3)

    def masses(both: np.ndarray) -> np.ndarray:
        return both[:, 0, :, 0, :].sum((1, 2))

    def estimate(both: np.ndarray, prior: float) -> LabelModel:
        mass = masses(both)
        share = (np.einsum("cjvjv->cjv", both) + 0.5) / (mass[:, None, None] + 1.5)
        parent = dependencies(both, mass)
        given = np.repeat(share[:, :, None, :], 3, 2)
        for j in np.nonzero(parent >= 0)[0]:
            pairs = both[:, parent[j], :, j, :]
            given[:, j] = (pairs + 5 * share[:, j, None, :]) / (pairs.sum(2, keepdims=True) + 5)
        return LabelModel(float(np.clip(prior, 1e-4, 0.9)), parent, given, np.ones(VOTERS))

    sure = pair_counts(known, None) if known is not None else np.zeros((2, VOTERS, 3, VOTERS, 3))
    if masses(sure).min() > 0:
        model = estimate(sure, masses(sure)[1] / masses(sure).sum())
    else:
        start = np.full((2, VOTERS, 3), 1 / 3)
        start[1], start[0] = [0.35, 0.05, 0.6], [0.6, 0.35, 0.05]
        model = LabelModel(0.1, np.full(VOTERS, -1), np.repeat(start[:, :, None, :], 3, 2), np.ones(VOTERS))
        model.weight = repetition_weights(pair_counts(cells, model).sum(0))
    for k in range(rounds):
        both = pair_counts(cells, model)
        mass = masses(both)
        if not mass.sum():
            break
        new = estimate(both + sure * (anchor * mass.sum() / max(masses(sure).sum(), 1e-9)), mass[1] / mass.sum())
        moved = np.abs(new.given - model.given).max()
        model = new
        if moved < 1e-3 and k > 3:
            break
    return model


def repetition_weights(both: np.ndarray) -> np.ndarray:
    """1 / (sum of a voter's squared correlations with all), of how often voter i says u and voter j says v."""
    n = max(both[0, :, 0, :].sum(), 1e-9)
    sign = np.array([0, -1, 1])
    second = np.einsum("iujv,u,v->ij", both, sign, sign) / n
    mean = np.einsum("iuiu,u->i", both, sign) / n
    cov = second - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return 1 / np.maximum((cov / np.outer(spread, spread)) ** 2, np.eye(VOTERS)).sum(1)


def dependencies(both: np.ndarray, mass: np.ndarray, least: float = 0.002) -> np.ndarray:
    """Each voter's parent in the spanning forest of the largest mutual informations within the classes; -1 without one.

    A mutual information below ``least`` nats, or such as chance gives, makes no dependency.
    """
    least = max(least, 20 / max(mass.sum(), 1e-9))
    p = both / np.maximum(mass, 1e-9)[:, None, None, None, None]
    one = np.einsum("cjvjv->cjv", p)
    product = one[:, :, :, None, None] * one[:, None, None, :, :]
    gain = np.where(p > 0, p * np.log(np.maximum(p, 1e-300) / np.maximum(product, 1e-300)), 0).sum((2, 4))
    gain = np.einsum("cij,c->ij", gain, mass / mass.sum())
    parent, inside = np.full(VOTERS, -1), np.zeros(VOTERS, bool)
    best, by = np.full(VOTERS, -1.0), np.full(VOTERS, -1)
    for _ in range(VOTERS):  # Prim's algorithm; a voter with little to gain begins a tree of its own
        j = int(np.where(inside, -2.0, best).argmax())
        inside[j] = True
        parent[j] = by[j] if best[j] >= least else -1
        closer = ~inside & (gain[j] > best)
        best[closer], by[closer] = gain[j][closer], j
    return parent


@dataclass(frozen=True)
class Classifier:
    lexicon: Lexicon
    weights: np.ndarray

    def features(self, seen: Seen) -> list[int]:
        """Columns of a text's terms and votes; the last is the constant."""
        n = len(self.lexicon.terms)
        return [*seen.terms, *(n + 3 * k + v for k, v in enumerate(votes(seen, self.lexicon.n_strong))), n + 3 * VOTERS]


def training_rows(texts: DataFrame, lexicon: Lexicon, model: LabelModel) -> DataFrame:
    """``features array<int>, target double``: columns and posterior label of each text."""

    def make():
        match, shape = Matcher(lexicon), Classifier(lexicon, np.zeros(0))

        def run(batch: pa.RecordBatch) -> dict:
            seen = [match(t) for t in batch.column(0).to_pylist()]
            own = np.array([votes(x, lexicon.n_strong) for x in seen], np.int64).reshape(-1, VOTERS)
            return {"features": [shape.features(x) for x in seen], "target": model.posterior(own)}

        return run

    return map_batches(texts.select("text"), make, "features array<int>, target double")


def train_classifier(rows: DataFrame, lexicon: Lexicon, ridge: float = 2e-4, rounds: int = 300) -> Classifier:
    """Logistic regression on posterior labels of the bounded sample, by accelerated gradients over sparse rows."""
    size = len(lexicon.terms) + 3 * VOTERS + 1
    collected = rows.collect()  # at most 2 * sample rows of term numbers
    if not collected:
        return Classifier(lexicon, np.zeros(size))
    found, target = [r["features"] for r in collected], np.array([r["target"] for r in collected])
    lengths = np.array([len(f) for f in found])
    column, row = np.concatenate(found).astype(np.int64), np.repeat(np.arange(len(found)), lengths)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    # Toxic and clean texts weigh alike in sum, so that rare ones count.
    toxic = target.mean()
    balance = np.where(target > 0.5, 0.5 / max(toxic, 1e-3), 0.5 / max(1 - toxic, 1e-3)) / len(found)
    step = 4 / (balance * lengths).sum() / 2
    w = y = np.zeros(size)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(y[column], start), -500, 500)))
        new = y - step * (np.bincount(column, (balance * (p - target))[row], size) + ridge * y)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return Classifier(lexicon, w)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """The classifier for ``docs``; None without both labels to learn from."""
    rows = id_and_text(docs)
    picked = bounded_sample(learnable(labels, "toxic"), sample)
    texts = written(one_of_each_copy(rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label")))  # at most 2 * sample ids
    lexicon = mine_terms(texts)
    if not lexicon.terms:
        return None
    model = fit_label_model(written(vote_cells(rows, lexicon)), vote_cells(texts, lexicon, "label"))
    return train_classifier(training_rows(texts, lexicon, model), lexicon)


def score_column(docs: DataFrame) -> str:
    """The name of the column that ``with_scores`` adds to ``docs``."""
    return free_name(docs, "toxicity")


def with_scores(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """``docs`` with a column named ``score_column(docs)``, from 0 to 1."""
    name = score_column(docs)
    if classifier is None:
        return docs.withColumn(name, F.lit(0.0))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    text_at = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # at most TERMS weights and terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, model = to_arrow_schema(schema), sent.value
        match = Matcher(model.lexicon)
        for batch in slices(batches):
            g = np.array([model.weights[model.features(match(t))].sum() for t in batch.column(text_at).cast(pa.string()).to_pylist()])
            own = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            yield as_batch(own | {name: 1 / (1 + np.exp(-np.clip(g, -500, 500)))}, arrow)

    return map_whole_rows(docs, run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
