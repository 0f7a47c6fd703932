"""Passages of held-out items in a corpus: pigeonhole pieces, then Myers' bit-parallel distance.

A passage of ``passage`` words with up to ``errors`` differing words holds one of ``errors + 1`` pieces unchanged, so
pieces have ``passage // (errors + 1)`` words. Items are cut into pieces at every word; a document's words are looked
up against them, hits of one item that follow each other closely are joined to blocks, and of each block the
distance between item and document words is computed. Around each run of hits the best ``passage`` words of the item
are aligned outwards, so that a passage with up to ``errors`` errors counts to its ends, wherever its intact piece is.
A document leaks an item when its blocks, in the item's order, keep ``least`` words of the item's own wording.

Words are letters or digits of the consistent form, without case, markup and apostrophes; digits next to each other
are one word, however they are punctuated. Runs of ``shared`` words that stand in several items are not an item's own.

Defined results: null, empty and short texts leak nothing; an item with fewer than ``least`` words of its own is
never found; repeated rows give one row; equal items are all reported.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.lookalike import canonical
from billspark.session import materialize

_TAG = re.compile(r"<[^<>]{1,200}>")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_APOSTROPHE = re.compile(r"['’`´]")
_DIGITS = re.compile(r"(?<=\d)[^\w]+(?=\d)")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    t = canonical(text).casefold()
    if "<" in t:
        t = _TAG.sub(" ", t)
    return _WORD.findall(_DIGITS.sub("", _APOSTROPHE.sub("", t)))


def myers(a: Sequence[int], b: Sequence[int]) -> int:
    """Edit distance of two sequences, a column of the matrix at a time in the bits of a number."""
    m = len(a)
    if not m or not len(b):
        return max(m, len(b))
    at: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        at[x] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for y in b:
        eq = at.get(y, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right_up, right_down = down | ~(diag | up) & full, up & diag
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = (right_up << 1 | 1) & full
        up = (right_down << 1) & full | ~(diag | right_up) & full
        down = right_up & diag
    return score


def outward(a: Sequence[int], b: Sequence[int], most: int) -> list[tuple[int, int]]:
    """(distance, words of ``b``) of each start of ``a``, from the empty one, to the start of ``b`` next to it; up to ``most``."""
    over = most + 1
    row = [min(j, over) for j in range(min(len(b), most) + 1)]
    first, out = 0, [(0, 0)]
    for i, x in enumerate(a, 1):
        lo, hi = max(0, i - most), min(len(b), i + most)
        if lo > hi:
            break
        new = []
        for j in range(lo, hi + 1):
            k = j - first
            best = row[k] + 1 if k < len(row) else over
            if j:
                if k <= len(row) and row[k - 1] + (x != b[j - 1]) < best:
                    best = row[k - 1] + (x != b[j - 1])
                if new and new[-1] + 1 < best:
                    best = new[-1] + 1
            new.append(best)
        row, first = new, lo
        best = min(new)
        if best > most:
            break
        out.append((best, lo + new.index(best)))
    return out


def own_words(n: int, starts: Iterable[int], shared: int) -> list[bool]:
    """Of the ``n`` words of an item, those that are in none of the shared runs with these starts."""
    own = [True] * n
    for k in starts:
        own[k : k + shared] = [False] * shared
    return own


def explained(blocks: dict[int, list[tuple[int, int, int]]]) -> dict[int, int]:
    """Words kept of each item; words of the document that a better match explains don't count for items of similar wording."""
    out: dict[int, int] = {}
    taken = bytearray(max((p1 for b in blocks.values() for _, _, p1 in b), default=0))
    for i in sorted(blocks, key=lambda i: (-sum(x[0] for x in blocks[i]), i)):
        total = sum(max(0, n - taken.count(1, p0, p1)) for n, p0, p1 in blocks[i])
        for _, p0, p1 in blocks[i]:
            taken[p0:p1] = b"\1" * (p1 - p0)
        if total:
            out[i] = total
    return out


class ItemIndex:
    """Pieces of a bounded set of items; see the module for the parameters."""

    def __init__(self, items: Iterable[tuple], passage: int = 20, errors: int = 5, shared: int = 12):
        """``items`` are (id, text), or (id, text, facts) where ``item_facts`` has told of all items what else these tell
        of themselves: the starts of shared runs, and at each place the words from which on a run stands in few items."""
        self.size, self.passage, self.errors = max(1, passage // (errors + 1)), passage, errors
        self.vocabulary: dict[str, int] = {}
        self.items: dict[int, list[int]] = {}
        self.facts: dict[int, tuple[Sequence[int], dict[int, int]]] = {}
        for i, text, *facts in items:
            self.items[i] = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if facts:
                self.facts[i] = facts[0]
        first: dict[tuple[int, ...], int] = {}
        #: Items of the same words are matched once and reported together.
        self.equal: dict[int, list[int]] = defaultdict(list)
        for i, ids in self.items.items():
            self.equal[first.setdefault(tuple(ids), i)].append(i)
        self.items = {i: self.items[i] for i in self.equal}
        runs = Counter() if self.facts else Counter(g for ids in map(tuple, self.items.values()) for g in {ids[k : k + shared] for k in range(len(ids) - shared + 1)})
        #: For each word of an item, the ends of the run of own words that it stands in.
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.pieces: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for i, ids in self.items.items():
            starts = self.facts[i][0] if self.facts else [k for k in range(len(ids) - shared + 1) if runs[tuple(ids[k : k + shared])] > 1]
            own = own_words(len(ids), starts, shared)
            ends, start = [(0, 0)] * len(own), 0
            for k in range(1, len(own) + 1):
                if k == len(own) or own[k] != own[start]:
                    ends[start:k] = [(start, k)] * (k - start)
                    start = k
            self.runs[i] = ends
            for k in range(len(ids) - self.size + 1):
                if all(own[k : k + self.size]):
                    self.pieces[tuple(ids[k : k + self.size])].append((i, k))

    def enough(self, least: int, gap: int) -> int:
        """The hits that an item needs at least to keep ``least`` words.

        A block of h hits spans up to (gap + size) (h - 1) + size words, and words kept in r runs make as many hits as
        they are more than (size - 1) r. A passage has passage - errors words in errors + 1 runs at most.
        """
        size = self.size
        h = 1
        while max(min(h + (size - 1) * r, (gap + size) * (h - 1) + size + 1 - r) for r in range(1, h * (gap + size) + 1)) < least:
            h += 1
        return max(1, min(h, self.passage - self.errors - (size - 1) * (self.errors + 1)))

    def blocks(self, text: str | None, gap: int = 8, worst: float = 0.45, few: int = 4, least: int = 1) -> dict[int, list[tuple[int, int, int]]]:
        """(words kept, first and last place in the document) of each block of each item that may keep ``least`` words.

        What keeps fewer explains no word of an item that keeps as many, as better matches go first.
        """
        enough = self.enough(least, gap)
        get, size = self.vocabulary.get, self.size
        doc = [get(w, -1) for w in words(text)]
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        pieces = self.pieces
        for p, piece in enumerate(zip(*(doc[k:] for k in range(size)))):
            found = pieces.get(piece)
            if found:
                for i, q in found:
                    hits[i].append((q, p))
        out = {i: self._blocks(i, doc, sorted(found), gap, worst, few) for i, found in hits.items() if len(found) >= enough}
        return {i: b for i, b in out.items() if b}

    def kept(self, text: str | None, **parameters) -> dict[int, int]:
        """Words that the document keeps of each item that it touches."""
        return {j: n for i, n in explained(self.blocks(text, **parameters)).items() for j in self.equal[i]}

    def _runs(self, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(place in the item, in the document, words) of the longest runs of hits."""
        at, out = set(hits), []
        for q, p in hits:
            if (q - 1, p - 1) not in at:
                n = self.size
                while (q + n - self.size + 1, p + n - self.size + 1) in at:
                    n += 1
                out.append((q, p, n))
        return out

    def _in_few(self, i: int, q: int, n: int, few: int) -> bool:
        """Whether the ``n`` words of an item at ``q`` stand in ``few`` items at most."""
        if self.facts:
            return n >= self.facts[i][1].get(q, self.size)
        run = self.items[i][q : q + n]
        at = min((self.pieces[tuple(run[k : k + self.size])] for k in range(n - self.size + 1)), key=len)
        if len(at) <= few:
            return True
        at = self.pieces[tuple(run[: self.size])]
        return len({j for j, k in at if self.items[j][k : k + n] == run}) <= few

    def _passages(self, i: int, doc: list[int], runs: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """The ``passage`` own words with the fewest errors, ``errors`` at most, around each run of hits."""
        item, passage, errors = self.items[i], self.passage, self.errors
        for q, p, n in runs:
            more = passage - n
            first, last = self.runs[i][q]
            if more <= 0 or last - first < passage:
                continue
            before, after = item[max(first, q - more) : q][::-1], item[q + n : min(last, q + n + more)]
            doc_before, doc_after = doc[max(0, p - more - errors) : p][::-1], doc[p + n : p + n + more + errors]
            # most runs stand by chance: they have too few words of the item about them
            near, far = set(doc_before), set(doc_after)
            if sum(w in near for w in before) + sum(w in far for w in after) < more - errors:
                continue
            left, right = outward(before, doc_before, errors), outward(after, doc_after, errors)
            sides = [(left[k][0] + right[more - k][0], k) for k in range(max(0, more - len(right) + 1), min(len(left), more + 1))]
            distance, k = min(sides, default=(errors + 1, 0))
            if distance <= errors:
                yield q - k, q + n + more - k, passage - distance, p - left[k][1], p + n + right[more - k][1]

    def _blocks(self, i: int, doc: list[int], hits: list[tuple[int, int]], gap: int, worst: float, few: int) -> list[tuple[int, int, int]]:
        item, size, blocks = self.items[i], self.size, []
        runs = self._runs(hits)
        # a block counts if a run in it stands in few items: phrases of many come together by chance
        own = {(q + k, p + k) for q, p, n in runs if self._in_few(i, q, n, few) for k in range(n - size + 1)}
        open_: list[list[int]] = []
        for q, p in hits:
            best = None
            for b in open_:
                if b[2] < q and b[3] < p and q - b[2] <= gap + size and p - b[3] <= gap + size:
                    cost = abs((q - b[2]) - (p - b[3]))
                    if best is None or cost < best[0]:
                        best = (cost, b)
            if best:
                best[1][2:] = [q, p, best[1][4] or (q, p) in own]
            else:
                open_.append([q, p, q, p, (q, p) in own])
            for b in open_:
                if q - b[2] > gap + size:
                    blocks.append(b)
            open_ = [b for b in open_ if q - b[2] <= gap + size]
        kept = list(self._passages(i, doc, runs))
        for q0, p0, q1, p1, anchored in blocks + open_:
            a, b = item[q0 : q1 + size], doc[p0 : p1 + size]
            distance = myers(a, b)
            if anchored and distance <= worst * max(len(a), len(b)):
                kept.append((q0, q1 + size, max(len(a), len(b)) - distance, p0, p1 + size))
        # blocks of the same part of the item count once
        out, end = [], 0
        for q0, q1, n, p0, p1 in sorted(kept, key=lambda x: (x[0], -x[2])):
            if q1 > end:
                out.append((min(n, q1 - max(q0, end)), p0, p1))
                end = q1
        return out


def _hash(gram: Sequence[str]) -> int:
    h = xxhash.xxh64_intdigest("\0".join(gram))
    return h - (1 << 64) if h >= 1 << 63 else h


def item_facts(rows: DataFrame, size: int, shared: int, few: int) -> DataFrame:
    """(i, t, starts, needs) of the first of each items (i, t, key) of the same words, told of all of them.

    ``starts`` are the starts of runs of ``shared`` words that stand in several items of different words. ``needs`` has
    for each place the least number of words, from ``size`` on, whose run from there stands in ``few`` items at most;
    a run of ``shared`` own words stands in one. Aggregates over hashes of runs; what is collected by item is of its length.
    """

    def grams(batches: Iterable[pd.DataFrame], lengths: Sequence[int] = (shared,)) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, starts in zip(b["i"], b["t"], b["starts"]):
                w = words(t)
                own = own_words(len(w), starts if starts is not None else (), shared)
                for q in range(len(w)):
                    if starts is None or all(own[q : q + size]):
                        out += [(i, q, n, _hash(w[q : q + n])) for n in lengths if q + n <= len(w)]
            yield pd.DataFrame(out, columns=["i", "q", "n", "h"])

    def every(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return grams(batches, range(size, shared))

    schema = "i bigint, q int, n int, h bigint"
    first = rows.groupBy("key").agg(F.min_by("t", "i").alias("t"), F.min("i").alias("i"))
    runs = first.select("i", "t", F.lit(None).cast("array<int>").alias("starts")).mapInPandas(grams, schema)
    several = runs.groupBy("n", "h").agg(F.count_distinct("i").alias("items")).where("items > 1").select("n", "h")
    starts = runs.join(several, ["n", "h"]).groupBy("i").agg(F.array_sort(F.collect_set("q")).alias("starts"))
    known = materialize(first.join(starts, "i", "left").select("key", "i", "t", F.coalesce("starts", F.array().cast("array<int>")).alias("starts")), "starts")
    own = known.select("i", "t", "starts").mapInPandas(every, schema)
    many = own.groupBy("n", "h").agg(F.count_distinct("i").alias("items")).where(F.col("items") > few).select("n", "h")
    # the longest run from a place that stands in many items, and one word more
    needs = own.join(many, ["n", "h"]).groupBy("i", "q").agg((F.max("n") + 1).alias("need")).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("q", "need"))).alias("needs"))
    return known.join(needs, "i", "left").select("i", "t", "starts", "needs")


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = 13, block_chars: int = 8_000_000, few: int = 4, **parameters) -> DataFrame:
    """(doc_id, item_id, words_kept) of each document that keeps ``least`` words of an item's own wording.

    The items are the stated query set. Up to ``block_chars`` characters of them are broadcast at once, and the corpus
    is not shuffled. More items go over the documents in blocks of that size, so that what is sent has a bound whatever
    their number; what they share is told of all items before, and the blocks found in a document are brought together
    and compared after, so that the outcome doesn't depend on the size of the blocks.
    """
    spark = documents.sparkSession
    rows = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).distinct()
    sized = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).head()["n"]
    n_blocks = max(1, -(-sized // block_chars))
    kind = documents.schema[doc_id].dataType.simpleString()
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    if n_blocks == 1:
        shared = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in rows.collect()])

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = ItemIndex(sorted(shared.value), **parameters)
            for b in batches:
                out = [(d, i, n) for d, t in zip(b["d"], b["t"]) for i, n in index.kept(t, few=few, least=least).items() if n >= least]
                if out:
                    yield pd.DataFrame(out, columns=["d", "i", "n"])

        found = docs.mapInPandas(run, f"d {kind}, i bigint, n int")
    else:
        found = _in_blocks(docs, rows, n_blocks, kind, least, few, parameters)
    return found.groupBy(F.col("d").alias(doc_id), F.col("i").alias(item_id)).agg(F.max("n").alias("words_kept"))


def _in_blocks(docs: DataFrame, rows: DataFrame, n_blocks: int, kind: str, least: int, few: int, parameters: dict) -> DataFrame:
    spark = docs.sparkSession
    size = max(1, parameters.get("passage", 20) // (parameters.get("errors", 5) + 1))

    @F.pandas_udf("string")
    def said(t: pd.Series) -> pd.Series:
        return t.map(lambda x: "\0".join(words(x)))

    keyed = materialize(rows.withColumn("key", F.md5(said("t"))), "items")
    facts = materialize(item_facts(keyed, size, parameters.get("shared", 12), few), "facts")
    texts = docs.select(F.md5("t").alias("k"), "t")
    parts = []
    for block in range(n_blocks):
        part = facts.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r["i"], r["t"], (r["starts"], r["needs"] or {})) for r in part])

        def run(batches: Iterable[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = ItemIndex(shared.value, **parameters)
            for b in batches:
                out = [(k, i, n, p0, p1) for k, t in zip(b["k"], b["t"]) for i, blocks in index.blocks(t, few=few, least=least).items() for n, p0, p1 in blocks]
                if out:
                    yield pd.DataFrame(out, columns=["k", "i", "n", "p0", "p1"])

        parts.append(texts.mapInPandas(run, "k string, i bigint, n int, p0 int, p1 int"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for i, n, p0, p1 in zip(pdf["i"], pdf["n"], pdf["p0"], pdf["p1"]):
            blocks[i].append((n, p0, p1))
        return pd.DataFrame([(pdf["k"].iloc[0], i, n) for i, n in explained(blocks).items() if n >= least], columns=["k", "first", "n"])

    # the blocks of one text, as many as it has passages, are compared together
    kept = reduce(DataFrame.unionByName, parts).distinct().groupBy("k").applyInPandas(compare, "k string, first bigint, n int")
    firsts = keyed.groupBy("key").agg(F.min("i").alias("first"))
    named = kept.join(firsts, "first").join(keyed.select("key", "i"), "key").select("k", "i", "n")
    return docs.select("d", F.md5("t").alias("k")).join(named, "k").select("d", "i", "n")
