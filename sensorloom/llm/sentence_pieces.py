"""SentencePiece encoding and decoding for merge-type vocabularies, on an agenda of adjacent symbol pairs.

A text gets a blank in front, blanks become U+2581, and each character is a symbol. The agenda of a text holds its adjacent pairs that join
to a piece, best score first and then from the left; the first pair is merged, its two new neighbours enter the agenda, until none is left.
Characters that are no piece become the byte pieces of their UTF-8.

Two neighbouring characters that stand side by side in no piece can never be merged over, so texts are cut there and at words; the agendas of all
short stretches of a batch, equal words once, are rows of one matrix and take a step at a time together. Longer stretches have a heap each.
Every batch's ids and decoded texts are compared with the ``sentencepiece`` library's; ``agrees`` tells whether they are equal.

Null and empty texts have no ids and decode to an empty text. Very long texts are encoded whole. Only the library takes them in parts of about a
million characters, to bound memory: both ways, and cut where it gives the same as for the whole text, so ``agrees`` doesn't
depend on sizes either. Equal scores go to the left pair. Repeated rows are
encoded each; an empty table gives an empty one. Other columns pass through unread, whatever their names: results are in one
column with a free name. A vocabulary that isn't of this kind (other normalizers, no byte pieces, pieces over two words) raises.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sensorloom.llm.batches import as_batch, free_name, id_and_text, lengths_to_offsets, map_whole_rows, text_slices

BLANK = "▁"
#: What the unknown piece decodes to.
UNKNOWN = " ⁇ ".encode()
#: Stretches of more characters have a heap each.
ROW = 48
#: Characters after which a text is cut for the library; no result depends on it.
PART = 1_000_000
_RUNS = re.compile(f"{BLANK}+[^{BLANK}]*")
_BETWEEN_WORDS = re.compile(f"(?<=[^ {BLANK}]) (?=[^ {BLANK}])")


@dataclass(frozen=True)
class PieceModel:
    """Place of a vocabulary file."""

    path: str = ""

    def load(self) -> Pieces:
        return Pieces(self.path or public_tokenizers.path("piece_bpe_32k.model"))


def gathered(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``values[offsets[r]:offsets[r + 1]]`` of all ``rows`` one after the other, and their offsets."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = lengths_to_offsets(sizes)
    return values[np.repeat(offsets[rows] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Pieces:
    """``ids(texts)`` and ``texts(ids)`` of one vocabulary."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = {int(names[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        if len(byte_ids) != 256 or sp.normalize(" ﬁ  　é\n ") != f"{BLANK * 2}ﬁ{BLANK * 2}　é\n{BLANK}":
            raise ValueError("only vocabularies with byte pieces and without normalization, with a blank in front")
        if any(BLANK in names[i].lstrip(BLANK) for i in normal):
            raise ValueError("only vocabularies whose pieces have blanks at their start alone")
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        self.piece_bytes = np.array([bytes([int(names[i][1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else UNKNOWN if sp.is_unknown(i) else names[i].replace(BLANK, " ").encode() for i in range(size)], object)
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.byte_ids] = True
        # Symbols are the pieces and, after them, characters that occur in pieces only.
        symbols = {names[i]: i for i in normal}
        for c in sorted({c for i in normal for c in names[i]} - symbols.keys()):
            symbols[c] = max(size, len(symbols) + size)
        self.size = size
        self.of_char = np.full(0x110000, -1, np.int32)
        for name, i in symbols.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        joins = [(symbols[n[:k]], symbols[n[k:]], i) for i in normal for n in [names[i]] for k in range(1, len(n)) if n[:k] in symbols and n[k:] in symbols]
        self.joined = {(a, b): i for a, b, i in joins}
        self.score = np.array([sp.get_score(i) for i in range(size)], np.float32)
        # A hash table of all joins; a slot's next ones take what collides.
        keys = np.array([a << 32 | b for a, b, _ in joins], np.int64)
        self.slots = max(16, 4 * len(joins)).bit_length()
        self.keys, self.into = np.full((1 << self.slots) + 64, -1, np.int64), np.full((1 << self.slots) + 64, -1, np.int32)
        for key, slot, (_, _, i) in zip(keys.tolist(), self._slot(keys).tolist(), joins, strict=True):
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.into[slot] = key, i
        beside = {ord(a) << 32 | ord(b) for i in normal for a, b in zip(names[i], names[i][1:], strict=False)}
        self.beside = np.array([*sorted(beside), 1 << 62], np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots)).astype(np.int64)

    def _joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of symbols the piece they join to, or -1, and its score."""
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        slot[(left < 0) | (right < 0)] = len(self.keys) - 1
        found = np.where(self.keys[slot] == keys, self.into[slot], -1)
        open_ = np.nonzero((found < 0) & (self.keys[slot] >= 0))[0]
        while len(open_):
            slot[open_] += 1
            at = slot[open_]
            hit = self.keys[at] == keys[open_]
            found[open_[hit]] = self.into[at[hit]]
            open_ = open_[~hit & (self.keys[at] >= 0)]
        return found, np.where(found >= 0, self.score[found], -np.inf).astype(np.float32)

    def _step_together(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, alive: np.ndarray) -> None:
        """Merge all pairs of stretches of about one length; each row of the matrix is the agenda of one of them."""
        n, width = len(starts), int(lengths.max())
        at = starts[:, None] + np.arange(width)
        inside = np.arange(width) < lengths[:, None]
        sym = np.where(inside, symbols[np.minimum(at, len(symbols) - 1)], -1)
        into, score = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
        joins, scores = self._joins(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        into[:, :-1], score[:, :-1] = joins.reshape(n, -1), scores.reshape(n, -1)
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (n, 1))
        rows = np.arange(n)
        while len(rows):
            j = score[rows].argmax(1)
            more = score[rows, j] > -np.inf
            rows, j = rows[more], j[more]
            k = after[rows, j]
            new = into[rows, j]
            sym[rows, j], sym[rows, k], score[rows, k] = new, -2, -np.inf
            beyond = after[rows, k]
            after[rows, j] = beyond
            has = beyond < width
            before[rows[has], beyond[has]] = j[has]
            right = np.where(has, sym[rows, np.minimum(beyond, width - 1)], -1)
            into[rows, j], score[rows, j] = self._joins(new, right)
            p = before[rows, j]
            r, p, new = rows[p >= 0], p[p >= 0], new[p >= 0]
            into[r, p], score[r, p] = self._joins(sym[r, p], new)
        symbols[at[inside]] = sym[inside]
        alive[at[inside]] = sym[inside] != -2

    def _step_alone(self, symbols: np.ndarray, alive: np.ndarray) -> None:
        """Merge all pairs of one long stretch, in place; its agenda is a heap."""
        sym, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, int, int]] = []

        def enter(a: int, b: int) -> None:
            if (i := self.joined.get((sym[a], sym[b]))) is not None:
                heapq.heappush(agenda, (-float(self.score[i]), a, b, i, sym[a] << 32 | sym[b]))

        for a in range(n - 1):
            enter(a, a + 1)
        while agenda:
            _, a, b, i, was = heapq.heappop(agenda)
            if after[a] != b or sym[a] < 0 or sym[b] < 0 or sym[a] << 32 | sym[b] != was:
                continue  # one of the two has been merged meanwhile
            sym[a], sym[b], after[a] = i, -2, after[b]
            if after[a] < n:
                before[after[a]] = a
                enter(a, after[a])
            if before[a] >= 0:
                enter(before[a], a)
        symbols[:] = sym
        alive[:] = symbols != -2

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches that nothing is merged over, one after the other, and their offsets."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        bounds = lengths_to_offsets(np.fromiter(map(len, words), np.int64, len(words)))
        symbols, alive = self.of_char[chars], np.ones(len(chars), bool)
        cut = np.zeros(len(chars), bool)
        cut[bounds[:-1][bounds[:-1] < len(chars)]] = True
        sizes = np.diff(bounds)
        long = np.nonzero(np.repeat(sizes > ROW, sizes))[0]
        long = long[~cut[long]]
        pairs = chars[long - 1] << 32 | chars[long]
        cut[long] = self.beside[np.searchsorted(self.beside, pairs)] != pairs
        starts = np.nonzero(cut)[0]
        lengths = np.diff(np.append(starts, len(chars)))
        low = 1
        for high in (4, 8, 16, ROW):
            own = (lengths > low) & (lengths <= high)
            if own.any():
                self._step_together(symbols, starts[own], lengths[own], alive)
            low = high
        for start, length in zip(starts[lengths > ROW], lengths[lengths > ROW], strict=True):
            self._step_alone(symbols[start : start + length], alive[start : start + length])
        at = np.nonzero(alive)[0]
        symbols, offsets = symbols[at], np.searchsorted(at, bounds)
        spelt = (symbols < 0) | (symbols >= self.size)
        if not spelt.any():
            return symbols, offsets
        # Each symbol is one id or, where it is no piece, those of its bytes.
        odd, which = np.unique(chars[at[spelt]], return_inverse=True)
        spellings = [chr(c).encode("utf-8", "surrogatepass") for c in odd]
        table = np.concatenate([np.arange(self.size, dtype=np.int32), self.byte_ids[np.frombuffer(b"".join(spellings), np.uint8)]])
        places = np.concatenate([np.arange(self.size), self.size + lengths_to_offsets(np.array([len(s) for s in spellings]))])
        symbols[spelt] = self.size + which
        ids, ends = gathered(table, places, symbols)
        return ids, ends[offsets]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text's."""
        plain = [bool(t) and not ("  " in t or BLANK in t or t[0] == " " or t[-1] == " ") for t in texts]
        split = pc.split_pattern(pa.array([t for t, p in zip(texts, plain, strict=True) if p], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        known = [BLANK + w for w in coded.dictionary.to_pylist()]
        # Of texts with runs of blanks a stretch starts with the whole run.
        runs = {k: _RUNS.findall(BLANK + t.replace(" ", BLANK)) for k, (t, p) in enumerate(zip(texts, plain, strict=True)) if t and not p}
        seen: dict[str, int] = {}
        own = {k: np.array([seen.setdefault(w, len(seen)) for w in found], np.int64) + len(known) for k, found in runs.items()}
        flat, places = self.words(known + list(seen))
        codes, at = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
        if own:
            rows, next_plain = [], 0
            for k, p in enumerate(plain):
                rows.append(codes[at[next_plain] : at[next_plain + 1]] if p else own.get(k, codes[:0]))
                next_plain += p
            n_words, codes = np.array([len(r) for r in rows]), np.concatenate(rows)
        else:
            n_words = np.zeros(len(texts), np.int64)
            n_words[np.nonzero(plain)[0]] = np.diff(at)
        ids, ends = gathered(flat, places, codes)
        return ids, ends[lengths_to_offsets(n_words)]

    def text(self, ids: np.ndarray) -> str:
        """What ids stand for: bytes that are no UTF-8 give U+FFFD each, and the blank in front goes."""
        pieces = self.piece_bytes[ids]
        data = b"".join(pieces.tolist())
        try:
            out = data.decode("utf-8")
        except UnicodeDecodeError:
            parts, start = [], 0
            is_byte = np.concatenate([self.is_byte[ids], [False]])
            for end in np.nonzero(np.diff(is_byte))[0] + 1:
                run = b"".join(pieces[start:end].tolist())
                parts.append(_bytes_apart(run) if is_byte[start] else run.decode("utf-8"))
                start = end
            out = "".join([*parts, b"".join(pieces[start:].tolist()).decode("utf-8", "replace")])
        return out[1:] if out.startswith(" ") and self._starts_with_piece(ids) else out

    def all_texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        return [self.text(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def _starts_with_piece(self, ids: np.ndarray) -> bool:
        first = next(i for i in ids if self.piece_bytes[i])
        return not self.is_byte[first] and self.piece_bytes[first] != UNKNOWN

    def agree(self, texts: list[str | None], ids: np.ndarray, ends: np.ndarray, decoded: list[str]) -> list[bool]:
        """Whether the library gives the same ids for each text, and the same text for the ids."""
        return [self._agrees(text or "", ids[a:b].tolist(), back) for text, a, b, back in zip(texts, ends, ends[1:], decoded, strict=False)]

    def _agrees(self, text: str, own: list[int], decoded: str) -> bool:
        """The same for one text: its parts' ids follow each other, their texts have the blank between them that they were cut at."""
        at = end = 0
        for part in _parts(text):
            theirs = self.library.encode(part)
            back = " " * (end > 0) + self.library.decode(theirs)
            if own[at : at + len(theirs)] != theirs or not decoded.startswith(back, end):
                return False
            at, end = at + len(theirs), end + len(back)
        return at == len(own) and end == len(decoded)


def _bytes_apart(run: bytes) -> str:
    """Bytes as UTF-8; each byte that belongs to no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def _parts(text: str) -> Iterator[str]:
    """The text, or parts of it that the library encodes as it does the whole: a part's first blank is the one left out.

    That blank has a character other than a blank on either side, so no piece reaches over its left side.
    """
    at = 0
    while len(text) - at > PART and (cut := _BETWEEN_WORDS.search(text, at + PART)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def encoding_column(docs: DataFrame) -> str:
    """The column that ``encoded`` adds."""
    return free_name(docs, "pieces")


def encoded(docs: DataFrame, model: PieceModel = PieceModel()) -> DataFrame:
    """``docs`` with a column of ``ids array<int>, decoded string, agrees boolean``, named by ``encoding_column``."""
    kind = T.StructType.fromDDL("ids array<int>, decoded string, agrees boolean")
    schema = T.StructType([*docs.schema.fields, T.StructField(encoding_column(docs), kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, arrow = model.load(), to_arrow_schema(schema)
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids, ends = pieces.ids(texts)
            decoded = pieces.all_texts(ids, ends)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            column = pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string()), pa.array(pieces.agree(texts, ids, ends, decoded))], fields=list(arrow[-1].type))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema=arrow)

    return map_whole_rows(docs, run, schema)


def decoding_column(df: DataFrame) -> str:
    """The column that ``decoded`` adds."""
    return free_name(df, "decoded")


def decoded(df: DataFrame, ids: str = "ids", model: PieceModel = PieceModel()) -> DataFrame:
    """``df`` with the texts that the lists of ids in a column stand for, named by ``decoding_column``; null gives an empty text."""
    schema = T.StructType([*df.schema.fields, T.StructField(decoding_column(df), T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, arrow = model.load(), to_arrow_schema(schema)
        for batch in batches:
            texts = [pieces.text(np.array(own or [], np.int32)) for own in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=arrow)

    return map_whole_rows(df, run, schema)


def digests(docs: DataFrame, model: PieceModel = PieceModel()) -> DataFrame:
    """For each row ``doc_id, n_tokens, ids_sha256, decoded_sha256, agrees``, without ids and texts leaving the task."""
    schema = T.StructType.fromDDL("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, arrow = model.load(), to_arrow_schema(schema)
        decimal = np.array([str(i) for i in range(pieces.size)], object)
        for batch in text_slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids, ends = pieces.ids(texts)
            decoded = pieces.all_texts(ids, ends)
            yield as_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": np.diff(ends),
                    "ids_sha256": [hashlib.sha256(",".join(decimal[ids[a:b]].tolist()).encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)],
                    "decoded_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in decoded],
                    "agrees": pieces.agree(texts, ids, ends, decoded),
                },
                arrow,
            )

    return id_and_text(docs).mapInArrow(run, schema)


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, encoded and decoded."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_sentence_pieces": op13_sentence_pieces}
ORACLE_SQL: dict[str, str] = {}
