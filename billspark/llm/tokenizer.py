"""Encoding of a corpus by a public byte-level BPE, with an automaton compiled from its merges.

The vocabulary's ranks imply its merges. They are compiled one after another, in rank order: each merge adds a token
whose gadgets, the chains of tokens that stand at its right and left edge until the merge happens, are those of its
parts closed by its own rank. One token may follow another exactly if no merge across the seam comes before both sides
are whole; such seams tell every encoding.

Words are read byte by byte by a deterministic automaton. Its state is the longest end of what was read that begins a
token, with the last token of the encoding at each place in it; as what stands before a last token is the encoding of
the shorter text, the last tokens tell the whole path. A transition is compiled from the gadgets the first time that it
is taken and is a table lookup from then on: written out for all tokens there would be a billion of them, of which a
corpus takes few. Decoding emits the labels of the path.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the public pattern that splits text before the merges of byte_bpe_50k.
PRE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Session setting with the path of the rank file, and the path where it is unset.
VOCABULARY_SETTING = "spark.billspark.vocabulary"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_END = 1 << 60
_START = -1


class MergeAutomaton:
    """Compiled merges and the transitions taken so far.

    ``memo_size`` bounds the words whose ids a worker keeps, ``table_size`` the transitions; full tables start anew.
    """

    def __init__(self, ranks: dict[bytes, int], memo_size: int = 100_000, table_size: int = 2_000_000):
        self.ranks, self.labels = ranks, {i: t for t, i in ranks.items()}
        self.memo: dict[str, list[int]] = {}
        self.memo_size, self.table_size = memo_size, table_size
        self.merge: dict[tuple[int, int], int] = {}
        #: Of each token, the tokens at its right and left edge from the whole inwards, with the rank that ends each.
        self.right: dict[int, tuple[tuple[int, int], ...]] = {}
        self.left: dict[int, tuple[tuple[int, int], ...]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._parts(token, rank) if len(token) > 1 else None
            self.right[rank] = ((rank, _END),)
            self.left[rank] = ((rank, _END),)
            if parts:
                a, b = parts
                self.merge[parts] = rank
                self.right[rank] += ((b, rank), *self.right[b][1:])
                self.left[rank] += ((a, rank), *self.left[a][1:])
        self.begins = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self._clear()

    def _clear(self) -> None:
        #: Of each state, the end that begins a token and the last tokens from the place before it on; START is first.
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (_START,))]
        self.numbers = {self.states[0]: 0}
        #: The state after (state, byte), and the last token in each state.
        self.table: dict[int, int] = {}
        self.last: list[int] = [_START]

    def _parts(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The pair whose merge makes the token: the two earlier tokens that may stand beside each other until then."""
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
            if a < rank and b < rank and self.arc(a, b, rank):
                return a, b
        return None

    def arc(self, state: int, token: int, below: int = _END) -> bool:
        """Whether ``token`` may follow ``state``: no merge over the seam happens while both its sides are there."""
        for x, x_end in self.right[state]:
            for y, y_end in self.left[token]:
                r = self.merge.get((x, y))
                if r is not None and r < below and r < x_end and r <= y_end:
                    return False
        return True

    def _compile(self, state: int, byte: int) -> int:
        """The state after a byte, put into the table."""
        end, lasts = self.states[state]
        end += bytes((byte,))
        while end and end not in self.begins:
            end, lasts = end[1:], lasts[1:]
        for k in range(len(end)):
            token = self.ranks.get(end[k:])
            if token is not None and (lasts[k] == _START or self.arc(lasts[k], token)):
                after = (end, (*lasts, token))
                break
        else:
            raise ValueError(f"the vocabulary has no bytes for {byte:#x}")
        number = self.numbers.get(after)
        if number is None:
            number = self.numbers[after] = len(self.states)
            self.states.append(after)
            self.last.append(token)
        self.table[state << 8 | byte] = number
        return number

    def _walk(self, word: bytes) -> list[int]:
        """Ids of a word: the last tokens along its bytes, then the path from the end."""
        if len(self.table) > self.table_size:
            self._clear()
        get, last, state, seen = self.table.get, self.last, 0, []
        for byte in word:
            after = get(state << 8 | byte)
            state = self._compile(state, byte) if after is None else after
            seen.append(last[state])
        ids, at, sizes = [], len(word), self.sizes
        while at:
            token = seen[at - 1]
            ids.append(token)
            at -= sizes[token]
        return ids[::-1]

    def word(self, text: str) -> list[int]:
        ids = self.memo.get(text)
        if ids is None:
            raw = text.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else self._walk(raw)
            if len(text) <= 64:
                if len(self.memo) >= self.memo_size:
                    self.memo.clear()
                self.memo[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.word, _splitter().findall(text)))) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


@cache
def _splitter() -> regex.Pattern:
    return regex.compile(PRE_SPLIT)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base 64 and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def vocabulary_path(spark: SparkSession) -> str:
    return spark.conf.get(VOCABULARY_SETTING, DEFAULT_VOCABULARY)


def digest(ranks: dict[bytes, int]) -> str:
    h = xxhash.xxh3_128()
    for t, i in ranks.items():
        h.update(t + i.to_bytes(8, "big"))
    return h.hexdigest()


_compiled: dict[str, MergeAutomaton] = {}


def worker_automaton(key: str, ranks: dict[bytes, int]) -> MergeAutomaton:
    """The automaton of a vocabulary, compiled once in each worker process.

    Workers import this function; a dictionary that a task's closure names would come anew with every task.
    """
    if key not in _compiled:
        _compiled[key] = MergeAutomaton(ranks)
    return _compiled[key]


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row; null and empty texts have the empty list.

    No shuffle. The driver reads the vocabulary, whose size its file fixes, and broadcasts it; each worker process
    compiles it once and keeps its tables from task to task. Special tokens' strings in a text are ordinary text. Lone
    surrogates, which Spark strings can't hold, don't occur. Equal ids are kept as they are, row by row.
    """
    ranks = read_ranks(vocabulary or vocabulary_path(df.sparkSession))
    key, shared = digest(ranks), df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = worker_automaton(key, shared.value)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [auto.encode(t) for t in b["text"]]})

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInPandas(run, f"id {kind}, ids array<int>")
    return out.select(F.col("id").alias(id_column), "ids")


def decode_corpus(df: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id, text) of lists of ids; a null list gives null."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary or vocabulary_path(df.sparkSession)))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels = {i: t for t, i in shared.value.items()}
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": [None if x is None else b"".join(labels[int(i)] for i in x).decode("utf-8", "replace") for x in b["ids"]]})

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids")).mapInPandas(run, f"id {kind}, text string")
    return out.select(F.col("id").alias(id_column), "text")
