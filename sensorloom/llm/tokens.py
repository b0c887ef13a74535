"""Token ids of whole texts, by the public byte-level BPE vocabulary.

Ids equal those of the ``tokenizers`` file, for any text: the same pre-tokenizer's pattern and the same merges run here as compiled
code of ``tiktoken``, a whole text at once, and the special token, if one is named, is one id wherever a text spells it. That code's pattern can't hold a
run of a million blanks; very long runs are cut out as the pattern would: all of the run at a text's end, else all but its last
character. Null and empty texts have no ids.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import public_tokenizers

ID = np.dtype("<u4")
#: Runs of white space, as the pattern sees it, that are too long for it.
_LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@dataclass(frozen=True)
class Vocabulary:
    """Places of the vocabulary as ranks, and its special token."""

    ranks: str = ""
    special: str | None = "<|endoftext|>"
    special_id: int = 50256

    def encoder(self) -> Encoder:
        return Encoder(self)


class Encoder:
    """``ids(text)`` gives unsigned 32-bit ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import tiktoken

        with open(vocabulary.ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.ranks = ranks
        special = {vocabulary.special: vocabulary.special_id} if vocabulary.special else {}
        self.special = set(special)
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.one_piece = tiktoken.Encoding("one piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, ID)
        if len(text) < 10_000 or not _LONG_RUN.search(text):
            return self._plain(text)
        parts, at = [], 0
        for run in _LONG_RUN.finditer(text):
            ends = run.end() == len(text) or text.startswith(tuple(self.special), run.end())
            end = run.end() - (not ends)
            parts += [self._plain(text[at : run.start()]), self.one_piece.encode_to_numpy(text[run.start() : end]).astype(ID)]
            at = end
        return np.concatenate([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        if not self.special:
            return np.array(self.bpe.encode_ordinary(text), ID)
        return self.bpe.encode_to_numpy(text, allowed_special=self.special).astype(ID, copy=False) if text else np.zeros(0, ID)

    def token_bytes(self) -> np.ndarray:
        """The bytes of each id of the ranks."""
        out = np.full(max(self.ranks.values()) + 1, b"", object)
        out[list(self.ranks.values())] = list(self.ranks)
        return out

    def count(self, text: str | None) -> int:
        return len(self.ids(text))
