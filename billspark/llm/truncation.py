"""Texts cut off by field limits.

Two kinds of evidence are added for each stored text that punctuation leaves open. Ending evidence: the log odds that a
text which ends like this was cut, by how the same words go on in all texts. Censoring evidence: for each source, a
log-normal distribution of lengths is fitted by maximum likelihood with values at a candidate limit as right-censored;
of each value at a limit it gives the posterior probability that the limit cut it, whose log odds are added. Off the
limits those of ``PRIOR`` are. The ending's log odds are measured on planted cuts and within the posterior's reach, so
that the same end can be cut at a limit and whole elsewhere.

What is known needs no odds: a text that ends its sentence is no cut by definition, even at a limit, and a sibling
field that holds the same text whole shows whether it goes on.

Defined results: null, blank and placeholder texts are not cut; a copy of the prompt without its full stop is not cut;
a text delivered twice counts once per id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billspark.llm.bitmap import bitmap_of, has
from billspark.session import materialize

# Texts that stand for no text.
PLACEHOLDERS = ["", "-", "--", "---", "–", "—", "...", "…", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "tbd", "[no response]", "[empty]", "(no response)", "(empty)", "no response", "no answer", "[no answer]", "?", "#n/a", "empty", "blank", "pending", "undefined"]
_PLACEHOLDERS = frozenset(PLACEHOLDERS)
_INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
_BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_CLOSERS = "\"'”’»)]*_"
_STOPS = ".!?。！？"
#: Full stops that end no sentence.
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:no|nos|nr|st|dr|mr|mrs|ms|vs|e\.g|i\.e|p\.o|apt|ref|tel|approx|dept|est|núm|sr|sra)\.$", re.I)
_MARK = re.compile(r"\s*(?:…|\.{2,}|\[(?:…|\.{2,3}|truncated|cut|more)\]|\((?:…|\.{3}|truncated|more)\))\s*$", re.I)
_SEAM = re.compile(r"(?<=[.!?])[ \t]+(?=[^\W_a-zß-öø-ÿ]|[¿¡\"'*>-])|\s*\n\s*")
_ENTRY = re.compile(r"(?:[-*•>]|\d+[.)])\s")
_NUMBER = re.compile(r"[\d,.]*\d")
_ZERO = str.maketrans(dict.fromkeys("123456789", "0"))
_NOT_PLAIN = re.compile(r"[\W_]+")

#: What is known.
CUT, WHOLE = 20.0, -20.0
#: Log odds measured on planted cuts: an end after a separator; an end within a sentence, of words that no text goes
#: on or ends with, after other sentences of its line; the same elsewhere.
SEPARATOR, PROSE, UNSEEN = 6.0, 4.5, 1.0
#: Log odds of a cut before its end is looked at, off the limits.
PRIOR = -2.0
#: A cut falls on one place of some thirty that a text has in a unit of the same words; see ``ending_odds``.
PLACE = 0.03


def clean(c: Column) -> Column:
    """Without invisible characters and blanks at the ends; null stays null."""
    return F.regexp_replace(F.regexp_replace(c, f"[{_INVISIBLE}]", ""), r"(?U)^\s+|\s+$", "")


def is_placeholder(c: Column) -> Column:
    """Blank at any length, or one of ``PLACEHOLDERS``."""
    # the patterns of ``clean`` are not run over long texts
    return F.when(F.length(F.translate(c, _INVISIBLE + _BLANKS, "")) > 64, False).otherwise(F.lower(clean(c)).isin(PLACEHOLDERS))


_HIDDEN = re.compile(f"[{_INVISIBLE}]")
_HIDE = str.maketrans(dict.fromkeys(_INVISIBLE, ""))


def _cleaned(text: str | None) -> str:
    if not text:
        return ""
    return (text.translate(_HIDE) if not text.isascii() and _HIDDEN.search(text) else text).strip()


def _stops(t: str) -> bool:
    """Whether a text ends with the end of a sentence."""
    core = t.rstrip(_CLOSERS)
    return core[-1:] in _STOPS and core != "" and not (core[-1] == "." and _ABBREVIATION.search(core[-12:]))


def _plain(t: str) -> str:
    return _NOT_PLAIN.sub("", t.lower())


def ending(text: str | None, sibling: str | None, prompt: str | None) -> tuple[float | None, str | None, bool]:
    """(evidence, open unit, whether a sentence stands before it on its line) of one text's end.

    The evidence is the log odds of a cut where punctuation, a sibling or the prompt tell; otherwise the open last
    unit is given, without a mark of omission.
    """
    t = _cleaned(text)
    if not t or t.lower() in _PLACEHOLDERS:
        return WHOLE, None, False
    bare = _MARK.sub("", t) if t[-1] in "….])" else t
    marked, stops = bare != t, _stops(bare)
    if sibling and bare and len(sibling) > len(bare):
        s = _cleaned(sibling)
        if len(s) > len(bare) and (not marked or s != t) and s.startswith(bare):
            following = s[len(bare)]
            return (WHOLE if following == "\n" or stops and following.isspace() else CUT), None, False
    if stops:
        return WHOLE, None, False
    units = _SEAM.split(bare[bare.rfind("\n") + 1 :])
    last = units[-1]
    if prompt:
        p, x = _plain(prompt), _plain(last)
        if len(x) >= 8 and x in p and len(_plain(bare)) <= 2.2 * len(p) + 30:
            return WHOLE, None, False
    # a separator, or what is left of a character that was cut in two
    if bare[-1:] in ",;(–—\ufffd":
        return SEPARATOR, None, False
    return None, last, len(units) > 1


def _stem(words: list[str], k: int) -> int:
    """Signed hash of the first k words of a shape, runs of digits as one 0."""
    h = xxhash.xxh64_intdigest(_NUMBER.sub("0", " ".join(words[:k])))
    return h - (1 << 64) if h >= 1 << 63 else h


def no_text(text: str | None) -> bool:
    """Whether a text is null, blank or a placeholder."""
    t = _cleaned(text)
    return not t or len(t) <= 64 and t.lower() in _PLACEHOLDERS


def judge_endings(rows: DataFrame, carry: Sequence[str] = (), label: Callable[[str | None, str | None], str | None] | None = None) -> DataFrame:
    """(id, source, field, len, said, shape, stem, word, prose, carried) of each text, from one pass without a shuffle.

    ``label`` may judge prompt and text in the same pass; its result is the column ``label``.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said, shapes, stems, lasts, prose = [], [], [], [], []
            for t, s, p in zip(b["text"], b["sibling"], b["prompt"]):
                e, unit, after = ending(t, s, p)
                words = unit.translate(_ZERO).split() if unit else []
                said.append(e if words or e is not None else WHOLE)
                shapes.append(" ".join(words) if words else None)
                stems.append(_stem(words, len(words) - 1) if words else None)
                lasts.append(words[-1] if words else None)
                prose.append(bool(words) and after and len(words) >= 3 and not _ENTRY.match(unit))
            out = b[["id", "source", "field", "len", *carry]].copy()
            if label:
                out["label"] = [label(p, t) for p, t in zip(b["prompt"], b["text"])]
            out["said"], out["shape"], out["stem"], out["word"], out["prose"] = pd.array(said, "Float64"), shapes, pd.array(stems, "Int64"), lasts, prose
            yield out

    base = rows.select("id", "source", "field", F.length("text").alias("len"), *carry, "text", "sibling", "prompt")
    schema = T.StructType([f for f in base.schema.fields if f.name not in ("text", "sibling", "prompt")] + ([T.StructField("label", T.StringType())] if label else [])).add("said", T.DoubleType()).add("shape", T.StringType()).add("stem", T.LongType()).add("word", T.StringType()).add("prose", T.BooleanType())
    return base.mapInPandas(run, schema)


def continuations(rows: DataFrame, stems: DataFrame, broadcast_stems: int = 1_000_000) -> DataFrame:
    """(stem, next, goes_on, ends): the words that follow each stem asked for in all texts.

    Units are counted by shape within each batch, then each distinct shape's words are looked up among the stems;
    what is shuffled are counts of words after stems. Up to ``broadcast_stems`` stems (8 bytes each) are broadcast,
    beyond that a bitmap of them, and what it lets through is joined to the stems.
    """
    spark = rows.sparkSession
    head = stems.limit(broadcast_stems + 1).toPandas()["stem"]
    few = len(head) <= broadcast_stems
    shared = spark.sparkContext.broadcast(head.to_numpy("int64") if few else bitmap_of(stems, F.col("stem")))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = set(shared.value.tolist()) if few else shared.value
        for b in batches:
            closed: Counter[str] = Counter()
            open_: Counter[str] = Counter()
            done = None
            for i, t in zip(b["id"], b["text"]):
                t = _cleaned(t)
                if not t or t == done:
                    continue
                done = t
                units = _SEAM.split(t.translate(_ZERO))
                closed.update(units[:-1])
                (closed if _stops(t) and t[-3:] != "..." else open_)[units[-1]] += 1
            on: Counter[tuple[int, str]] = Counter()
            end: Counter[tuple[int, str]] = Counter()
            for counts, whole in ((closed, True), (open_, False)):
                for unit, n in counts.items():
                    words = unit.split()
                    prefix = xxhash.xxh64()  # of a growing prefix, its digits collapsed
                    for k, w in enumerate(words):
                        h = prefix.intdigest()
                        h = h - (1 << 64) if h >= 1 << 63 else h
                        if h in known if few else has(known, h):
                            if k + 1 < len(words):
                                on[h, w] += n
                            elif whole:
                                end[h, w.rstrip(".!?…")] += n
                        w = _NUMBER.sub("0", w) if "0" in w else w
                        prefix.update(f" {w}" if k else w)
            keys = list(on.keys() | end.keys())
            if keys:
                yield pd.DataFrame({"stem": [k[0] for k in keys], "next": [k[1] for k in keys], "goes_on": [on[k] for k in keys], "ends": [end[k] for k in keys]})

    nodes = rows.where("text is not null").select("id", "text").mapInPandas(run, "stem bigint, next string, goes_on bigint, ends bigint")
    nodes = nodes.groupBy("stem", "next").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))
    return nodes if few else nodes.join(stems, "stem", "left_semi")


def ending_odds(goes_on: Column, ends: Column, prose: Column) -> Column:
    """Log odds that an open end is a cut, from how often its words go on and how often they end a unit elsewhere.

    A whole unit ends with these words as often as it does elsewhere, a cut falls on this place in ``PLACE`` of the
    texts that go through it. Words that neither go on nor end anywhere have the odds of ``PROSE`` or ``UNSEEN``.
    """
    known = F.ln(PLACE * goes_on + 0.0005) - F.ln(ends + 0.0002)
    return F.when((goes_on == 0) & (ends == 0), F.when(prose, PROSE).otherwise(UNSEEN)).otherwise(known)


def resolve_endings(judged: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, source, field, len, evidence, posterior, carried): open ends are settled by all texts.

    ``judged`` has the posterior of a limit at each text's length. Of each open shape it is counted how often its
    words end a unit elsewhere, open ends only where no limit may have cut them, and how often they go on, be it with
    more words or with more letters of the last word.
    """
    carried = [c for c in judged.columns if c not in ("said", "shape", "stem", "word", "prose")]
    open_ = judged.where("shape is not null")
    asked = open_.groupBy("stem", "word", "shape").agg(F.count_distinct(F.when(F.col("posterior").isNull(), F.col("id"))).alias("own"))
    nodes = continuations(rows, asked.select("stem").distinct())
    # open ends of the same words in other texts count as well
    ends = asked.groupBy("stem", F.col("word").alias("next")).agg(F.lit(0).cast("bigint").alias("goes_on"), F.sum("own").alias("ends"))
    words = nodes.unionByName(ends).groupBy("stem", "next").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))
    # a word is met by its own beginnings of the lengths asked for after its stem, an equality each, so that no stem
    # makes pairs of all its words
    sizes = asked.groupBy("stem").agg(F.collect_set(F.length("word")).alias("sizes"))
    begins = F.transform(F.filter("sizes", lambda n: n <= F.length("next")), lambda n: F.left("next", n))
    met = words.join(sizes, "stem").select("stem", "next", "goes_on", "ends", F.explode(begins).alias("word")).join(asked.select("stem", "word").distinct(), ["stem", "word"])
    same = F.col("next") == F.col("word")
    seen = met.groupBy("stem", "word").agg(F.sum(F.when(same, F.col("ends")).otherwise(0)).alias("ends"), F.sum(F.when(same, F.col("goes_on")).otherwise(F.col("goes_on") + F.col("ends"))).alias("goes_on"))
    known = asked.join(seen, ["stem", "word"]).groupBy("shape").agg(F.max("ends").alias("ends"), F.max("goes_on").alias("goes_on"))
    # its own end, counted where no limit is, says nothing
    elsewhere = F.greatest(F.col("ends") - F.when(F.col("posterior").isNull(), 1).otherwise(0), F.lit(0))
    settled = open_.join(known, "shape").select(*carried, ending_odds(F.col("goes_on"), elsewhere, F.col("prose")).alias("evidence"))
    return judged.where("shape is null").select(*carried, F.col("said").alias("evidence")).unionByName(settled)


FIT = "source string, field string, lim int, at_limit bigint, mu double, sigma double, posterior double"


def fit_censoring(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source and field from its lengths: columns len, n, cut (of these, ends within a sentence).

    A candidate is a length at which several values, and a good part of those there, may end within a sentence, and
    at which far more values lie than at the lengths around it. The log-normal of the other, uncensored, values is fitted with those at the limit as
    right-censored (expectation and maximisation on the truncated normal), and the posterior of a value at the limit
    is the censored share of what lies there.
    """
    src, fld = pdf["source"].iloc[0], pdf["field"].iloc[0]
    pdf = pdf.sort_values("len")
    lens, ns, cuts = (pdf[c].to_numpy("int64") for c in ("len", "n", "cut"))
    total = int(ns.sum())
    before = np.concatenate([[0], ns.cumsum()])
    near = (before[np.searchsorted(lens, lens + 10, "right")] - before[np.searchsorted(lens, lens - 10, "left")] - ns) / 20.0
    rows = []
    for at in np.flatnonzero((cuts >= 3) & (cuts >= 0.4 * ns) & (ns >= near + 4 * np.sqrt(near) + 2)):
        limit, n_at = int(lens[at]), int(ns[at])
        free = (lens != limit) & (lens > 0)
        x, w = np.log(lens[free]), ns[free].astype(float)
        logc = math.log(max(limit, 1))
        if not len(x):
            rows.append((src, fld, limit, n_at, logc, 0.0, float(cuts[at] / n_at)))
            continue
        sw, sx, sxx = float(w.sum()), float(w @ x), float(w @ (x * x))
        mu = sx / sw
        sd = math.sqrt(max(1e-4, sxx / sw - mu * mu))
        for _ in range(30):
            z = (logc - mu) / sd
            tail = max(1e-9, 0.5 * math.erfc(z / math.sqrt(2)))
            ratio = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
            e1 = mu + sd * ratio
            e2 = mu * mu + sd * sd + sd * (logc + mu) * ratio
            new = (sx + n_at * e1) / (sw + n_at)
            var = (sxx + n_at * e2) / (sw + n_at) - new * new
            done = abs(new - mu) < 1e-6
            mu, sd = new, math.sqrt(max(1e-4, var))
            if done:
                break
        z = (logc - mu) / sd
        uncut = total * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / sd / max(limit, 1)
        rows.append((src, fld, limit, n_at, mu, sd, max(0.0, min(0.999, 1 - uncut / n_at))))
    return pd.DataFrame(rows, columns=["source", "field", "lim", "at_limit", "mu", "sigma", "posterior"])


def source_limits(judged: DataFrame) -> DataFrame:
    """Candidate limits of each source and field, from its histogram of lengths and of ends that may be cuts.

    One task gets one row for each length of a source and field, not its texts.
    """
    hist = judged.where("len > 0").groupBy("source", "field", "len").agg(F.count("*").alias("n"), F.count_if(F.col("said").isNull() | (F.col("said") > 0)).alias("cut"))
    return hist.groupBy("source", "field").applyInPandas(fit_censoring, FIT)


def truncation_posterior(rows: DataFrame, carry: Sequence[str] = (), label: Callable[[str | None, str | None], str | None] | None = None) -> DataFrame:
    """(id, source, field, len, evidence, posterior, p_cut), carried columns and ``label`` of each text.

    ``rows`` has id, source, field, text, sibling and prompt. ``posterior`` is that of the source's limit at this
    length (null off the limits); its log odds, or ``PRIOR`` off the limits, are added to the evidence. Two passes over the texts in Python, whose only shuffles are of counts; the first
    one's table, which has no texts, is written to the shared folder.
    """
    named = rows.withColumn("source", F.coalesce("source", F.lit("")))
    judged = materialize(judge_endings(named, carry, label), "endings")
    limits = materialize(source_limits(judged).select("source", "field", F.col("lim").alias("len"), "posterior"), "limits")
    both = resolve_endings(judged.join(limits, ["source", "field", "len"], "left"), named)
    odds = F.ln(F.greatest(F.col("posterior"), F.lit(1e-3)) / (1 - F.col("posterior")))
    return both.withColumn("p_cut", 1 / (1 + F.exp(-(F.col("evidence") + F.coalesce(odds, F.lit(PRIOR))))))
