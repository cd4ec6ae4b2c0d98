"""Word-piece counts by a linear longest-match automaton.

A vocabulary trie gets failure links: where no edge continues, the longest pieces of what was read
are popped and matching goes on at the state for the rest. Counting needs only how many pieces a
failure pops, which is precomputed for each state, so no piece is ever built and each byte of a word
is read once. The greedy longest-match rule is that of word-piece tokenizers.

The vocabulary is a list of byte strings in which the end of a word is the byte 0x00 that no word
may hold; ``load_vocabulary`` reads it from a tokenizer file whose pieces mark word ends.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import table, with_arrow_columns

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END_MARK = "</w>"
END = 0
#: Distinct words whose counts a task remembers at once.
REMEMBERED = 200_000


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, the word-end mark as the byte 0x00; others are skipped."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    letters, pieces = byte_letters(), []
    for name in names:
        body = name.removesuffix(END_MARK)
        if all(c in letters for c in body) and (body or name == END_MARK):
            pieces.append(bytes(letters[c] for c in body) + (b"\0" if body != name else b""))
    return pieces


class Automaton:
    """Counts the greedy longest-match pieces of words; -1 where the vocabulary can't spell a word."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        step: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for b in piece:
                to = step[at].get(b)
                if to is None:
                    to = step[at][b] = len(step)
                    step.append({})
                    whole.append(False)
                at = to
            whole[at] = True
        whole[0] = False
        fail, popped = [-1] * len(step), [0] * len(step)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for b, to in step[at].items():
                if whole[to]:
                    fail[to], popped[to] = 0, 1
                else:
                    back, n = fail[at], popped[at]
                    while back >= 0 and b not in step[back]:
                        n += popped[back]
                        back = fail[back]
                    if back >= 0:
                        fail[to], popped[to] = step[back][b], n
                queue.append(to)
        self.step, self.fail, self.popped = step, fail, popped
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        if END in word:
            return -1
        step, fail, popped = self.step, self.fail, self.popped
        at = n = 0
        for b in (*word, END):
            to = step[at].get(b)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = step[at].get(b)
            at = to
        while at:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return n

    def counts(self, words: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in set(words).difference(known):
                known[w] = self.count(w)
            return [known[w] for w in words]


def token_counts(docs: DataFrame, pieces: list[bytes], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_words, n_tokens and n_unknown of every whole text.

    A-Z are lower-cased; words are runs without ASCII white space; a word that holds a zero byte or
    that the vocabulary can't spell is one unknown token. Null and empty texts count 0. The
    automaton is built once in each Python worker; the pieces, whose number is the vocabulary's,
    travel as one broadcast. Columns of the three names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_tokens", "n_unknown")]
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    holder: list[Automaton] = []

    def compute(batch: pa.RecordBatch) -> list:
        if not holder:
            holder.append(Automaton(shared.value))
        rows = []
        for x in batch.column(0):
            found = (x.as_py() or b"").lower().split()
            counts = holder[0].counts(found)
            unknown = counts.count(-1)
            rows.append((len(found), sum(counts) + 2 * unknown, unknown))
        return [[r[i] for r in rows] for i in range(3)]

    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")]
    return with_arrow_columns(docs, {"text": F.col(f"`{text}`").cast("binary")}, fields, compute, keep)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the word-piece counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"), load_vocabulary(), keep=["doc_id"])
