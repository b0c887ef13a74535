"""Quality rules as a short-circuit cascade.

Every rule reads counts of one text; counts are made when a rule first asks for them. On a sample of the
documents each rule is run on each text, which gives its cost and its selectivity; rules are then ordered by
rejections per second, and on the whole table a text meets the rules in that order until one rejects it. The
order changes what the cascade costs, never which documents it keeps.

Null or empty text has no words and fails the base rules; very long texts are counted whole. Repeated rows are each judged. Of rules that reject as much per
second the first by name goes first. An empty table gives an empty result, by any order. Other columns than ``doc_id`` and ``text`` aren't read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.batches import id_and_text, map_batches

SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Documents of the sample that orders the rules; it decides costs only.
SAMPLE_DOCS = 500


class TextCounts:
    """Counts of one text, each made once and only if asked for. Words lie between ASCII white space."""

    def __init__(self, text: str | None) -> None:
        self.data = (text or "").encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for line in self.data.split(b"\n") if line.strip())

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [line for line in self.data.split(b"\n") if line.strip()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        if self.n_words < 4:
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, self.n_words)
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        _, window, times = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[window] > 1
        inside = np.zeros(self.n_words, bool)
        for k in range(3):
            inside[k : k + len(twice)] |= twice
        return int(inside.sum())

    @cached_property
    def n_capitals(self) -> int:
        return len(self.data) - len(self.data.translate(None, _UPPER))

    @cached_property
    def n_small(self) -> int:
        return len(self.data) - len(self.data.translate(None, _LOWER))

    @cached_property
    def n_exclaims(self) -> int:
        return self.data.count(b"!")

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


#: A rule is true of texts that it rejects.
RULES: dict[str, Callable[[TextCounts], bool]] = {
    "many_symbols": lambda c: 10 * c.n_symbols > 2 * c.n_words,
    "shouting": lambda c: 10 * c.n_capitals > 5 * (c.n_capitals + c.n_small),
    "exclaiming": lambda c: 10 * c.n_exclaims > 3 * c.n_words,
    "repeated_lines": lambda c: c.n_dup_lines > 2 and 10 * c.n_dup_lines > 3 * c.n_lines,  # a heading and a footer repeat in good texts too
    "odd_words": lambda c: c.word_chars < 2 * c.n_words or c.word_chars > 20 * c.n_words,
}


def rule_figures(docs: DataFrame, rules: dict[str, Callable[[TextCounts], bool]] = RULES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``rule, seconds, n_rejected, n_docs`` on a sample of about ``sample_docs`` documents."""

    def make():
        def measure(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("rule", "seconds", "n_rejected", "n_docs")}
            for name, rule in rules.items():
                counts = [TextCounts(t) for t in batch.column(1).to_pylist()]  # anew: each rule pays for all it needs
                began = time.perf_counter()
                rejected = sum(map(rule, counts))
                for k, v in zip(out, (name, time.perf_counter() - began, rejected, len(counts)), strict=True):
                    out[k].append(v)
            return out

        return measure

    rows = id_and_text(docs)
    share = min(1.0, 1.2 * sample_docs / max(1, docs.count()))
    sample = rows.sample(share, seed=7).limit(sample_docs) if share < 1 else rows
    figures = map_batches(sample, make, "rule string, seconds double, n_rejected long, n_docs long")
    return figures.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("n_rejected").alias("n_rejected"), F.sum("n_docs").alias("n_docs"))


def cheapest_first(figures: DataFrame, rules: dict = RULES) -> list[str]:
    """Rules by rejections per second, best first; unmeasured ones last."""
    by_rule = {r["rule"]: r["n_rejected"] / max(r["seconds"], 1e-9) for r in figures.collect()}  # a row for each rule
    return sorted(rules, key=lambda name: (-by_rule.get(name, 0.0), name))


def apply_cascade(docs: DataFrame, order: list[str], rules: dict[str, Callable[[TextCounts], bool]] = RULES) -> DataFrame:
    """Counts of the base rules, ``base_failed``, ``kept``, and ``rejected_by``, the rule that ended the cascade."""

    def make():
        cascade = [(name, rules[name]) for name in order]

        def judge(batch: pa.RecordBatch) -> dict:
            counts = [TextCounts(t) for t in batch.column(1).to_pylist()]
            out = {"doc_id": batch.column(0)} | {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")}
            for c in counts:
                by = "base" if c.base_failed else next((name for name, rule in cascade if rule(c)), None)
                for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"):
                    out[k].append(getattr(c, k))
                out["kept"].append(by is None)
                out["rejected_by"].append(by)
                c.__dict__.clear()
            return out

        return judge

    return map_batches(id_and_text(docs), make, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_cascade(docs, cheapest_first(rule_figures(docs))).drop("rejected_by")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL = {
    "op7_quality_rules": r"""
with t as (select doc_id, coalesce(text, '') text from documents),
w as (
  select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') ws,
         [l for l in string_split(text, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] ls,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) n_symbols,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) n_up, length(regexp_replace(text, '[^a-z]', '', 'g')) n_low,
         length(regexp_replace(text, '[^!]', '', 'g')) n_ex from t),
win as (select doc_id, i, ws[i : i + 2] g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w where len(ws) >= 3)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) > 1),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 3)) p from twice) group by doc_id),
c as (
  select doc_id, cast(len(ws) as bigint) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars, n_symbols,
         cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, coalesce(n, 0) n_repeat_words, len(ls) n_lines, n_up, n_low, n_ex
  from w left join rep using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > 2 * n_words or 10 * n_up > 5 * (n_up + n_low) or 10 * n_ex > 3 * n_words
            or (n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines) or word_chars < 2 * n_words or word_chars > 20 * n_words) kept
from b
"""
}
