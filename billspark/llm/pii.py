"""Personal information in free text: found by anchors, expanded by local parsers, replaced by typed placeholders.

One pass of an Aho-Corasick automaton finds the cues (at-signs and their written forms, identifier words, street
types, words that introduce a name, and the names of facilities). A deterministic parser then expands each cue to
the boundaries of an e-mail address, identity number or street address and validates it. Telephone numbers and
identity numbers of fixed shape anchor themselves by their digits. Names are words of a lexicon read in context. The
lexicon is that of the caller, here patients and guarantors of the bills, and what ``corpus_names`` learns from the
texts: words that stand with a capital and, in the larger part of these places, beside words that go with persons.

Defined results: null and blank texts have no places; overlapping places keep the first kind of ``KINDS``, then the
longer; a text delivered twice gives the same rows twice, ``places`` of a column keep all, the queries count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm.bitmap import bitmap_of, has, hashed

KINDS = ("email", "identity_number", "phone", "street_address", "person_name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

# Cues.
EMAIL_CUES = ["@", "(at)", "[at]", " at ", "＠"]
ID_CUES = {
    "ssn": "ssn", "social security": "ssn", "social": "ssn", "medical record": "id", "mrn": "id", "member id": "id", "member number": "id", "member no": "id", "insurance id": "id", "subscriber id": "id",
    "driver's license": "id", "drivers license": "id", "driver’s license": "id", "driver license": "id", "license number": "id", "patient account": "id", "patient acct": "id",
}
STREET_TYPES = "street st road rd avenue ave lane ln drive dr court ct boulevard blvd way terrace ter place pl plaza parkway pkwy circle cir trail trl highway hwy square sq loop row".split()
NAME_CUES = ["my name is", "this is", "regards,", "sincerely,", "my partner", "my kid", "nobody told", "thank you,", "i spoke with", "the bill lists"]
# Words that go with persons, by what they are.
PERSON_CUES = frozenset(
    """
    mr mrs ms miss dr prof sr sra señor señora monsieur madame mme don doña
    partner husband wife spouse kid son daughter mother father mom dad parent child brother sister aunt uncle grandmother grandfather friend neighbor cousin nephew niece
    patient guarantor subscriber policyholder insured member dependent caller holder
    dear hello hi hey thanks thank regards sincerely cordially yours attn attention hola gracias bonjour merci
    name named names called signed signature sign signs writing writes wrote told tell spoke speak speaking talked met asked ask said says contact here lists listed printed belongs between
    """.split()
)
# Words with a capital that name no person.
CALENDAR = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janvier février mars avril mai juin juillet août septembre octobre novembre décembre spanish english french german".split()
ORGANISATIONS = "accounts account department desk hospital clinic center centre health healthcare care medical insurance assurance mutual plan trust pool benefit cooperative office services service billing medicare medicaid medigap marketplace university inc llc ltd group company society association bank foundation".split()
_NO_NAMES = frozenset([*PERSON_CUES, *CALENDAR, *ORGANISATIONS, *STREET_TYPES])
_ORGANISATIONS = frozenset([*ORGANISATIONS, *STREET_TYPES])
NOT_PERSONAL = "claim invoice statement bill billing code cpt hcpcs npi ref reference case ticket box line row check no num number".split()
_NUMBER_WORDS = "a an the in of my on to for and or from with at by is was are it its that this your our per than".split()

_DOMAIN = re.compile(r"\s?([a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,})(?![a-z0-9-])", re.I)
_SEP = r"(?:\s*(?:\(dot\)|\[dot\])\s*|\s+dot\s+|\.)"
_WRITTEN = re.compile(rf"\s*([a-z0-9-]+(?:{_SEP}[a-z0-9-]+)*{_SEP}[a-z]{{2,}})(?![\w-])", re.I)
_DOT = re.compile(r"\s*(?:\(dot\)|\[dot\]|\bdot\b)\s*", re.I)
_PHONE = re.compile(r"(?<![\w$.,/-])(?:\+?\d{1,2}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?![\w/-]|[.,]\d)")
_SHAPES = re.compile(r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|PA-\d{4}-\d{5}|[A-Z]{2}-\d{6}|[A-Z]\d{6}-\d{2}|[A-Z]{3}\d{7})(?![\w-])", re.I)
_ID_VALUE = re.compile(r"[\s:#]*(?:(?:number|numbers|no\.?|num|id|card|is|was|nr\.?)[\s:#]+){0,3}([A-Z0-9](?:[A-Z0-9-]{4,}))(?![\w-])", re.I)
_SSN_VALUE = re.compile(r"[\s:#]*(?:(?:security|number|no\.?|num|is|was)[\s:#]+){0,3}(\d{3}[- ]?\d{2}[- ]?\d{4})(?![\w-])", re.I)
_AFTER_STREET = re.compile(r"\.?(?:,? (?:apt|unit|suite|ste|#)\.? ?#?\w+|,? #\w+)?(?:,? (?:in )?[A-Z][\w'’-]+(?: [A-Z][\w'’-]+){0,2},? [A-Z]{2} \d{5}(?:-\d{4})?|,? [A-Z]{2} \d{5})?", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LOWER = re.compile(r"(?<![\w@.+/'’-])[^\W\d_A-ZÀ-Þ]{2,}(?:['’-][^\W\d_]+)*(?![\w@+/]|\.\w)")
_TITLE_BEFORE = re.compile(r"\b(?:[Mm](?:r|rs|s)|[Dd]r|[Pp]rof|[Ss]ra?|[A-Z])\.\s?$")
_SIGNED = re.compile(r"(?:egards|incerely|ordially|yours|hanks),\s*$")
_HOUSE_BEFORE = re.compile(r"\d[\w-]*\s+$")
_STATE_AFTER = re.compile(r",? [A-Z]{2} \d{5}")
_SENTENCE_SEAM = re.compile(r"[!?;]|[^\W\d_]{3,}\.\s|\n\n")
_PHRASE_SEAM = re.compile(r"[.!?;\n]")
_PRECEDING = re.compile(r"([a-z]+)[\s.#:]*$", re.I)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _digits(s: str) -> str:
    d = re.sub(r"\D", "", s)
    return d[-10:]


@dataclass
class Facilities:
    """What is not personal: names, phones, domains and street addresses of facilities. Bounded by their number."""

    names: set[str] = field(default_factory=set)
    phones: set[str] = field(default_factory=set)
    domains: set[str] = field(default_factory=set)
    streets: set[str] = field(default_factory=set)
    places: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, rows: Iterable[Sequence[str | None]]) -> Facilities:
        """Rows of (name, address, phone, pay site, mail address)."""
        f = cls()
        for name, address, phone, site, mail in rows:
            if name and name.strip():
                f.names.add(_lower(name.strip()))
            if phone:
                f.phones.add(_digits(phone))
            if site:
                host = re.sub(r"^\w+://", "", site.strip().lower()).split("/")[0]
                f.domains |= {host, *([host.split(".", 1)[1]] if host.count(".") >= 2 else [])}
            for a in (address, mail):
                if a:
                    street, *rest = _lower(a).split(",")
                    f.streets.add(street.strip())
                    f.places.update(x.strip() for x in rest)
        return f


class Finder:
    """Places of personal information in one text. ``name_kind`` tells of a lower-case word: "f", "l", "b" or None."""

    def __init__(self, facilities: Facilities):
        import ahocorasick

        self.not_personal = facilities
        self.auto = ahocorasick.Automaton()
        cues: dict[str, list[str]] = {}
        for kind, words in (("email", EMAIL_CUES), ("id", ID_CUES), ("street", [" " + s for s in STREET_TYPES]), ("name", NAME_CUES), ("facility", facilities.names)):
            for w in words:
                cues.setdefault(w, []).append(kind)
        for w, kinds in cues.items():
            self.auto.add_word(w, (w, kinds))
        self.auto.make_automaton()

    def places(self, text: str | None, name_kind: Callable[[str], str | None]) -> list[tuple[int, int, str]]:
        if not text or text.isspace():
            return []
        low = _lower(text)
        found: list[tuple[int, int, str]] = []
        hidden: list[tuple[int, int]] = []
        cued: set[int] = set()
        for end, (cue, kinds) in self.auto.iter(low):
            start, end = end - len(cue) + 1, end + 1
            for kind in kinds:
                if kind == "email":
                    self._email(text, low, cue, start, end, found, hidden)
                elif kind == "id":
                    self._identity(text, low, cue, start, end, found)
                elif kind == "street":
                    self._street(text, low, start, end, found, hidden)
                elif kind == "facility":
                    hidden.append((start, end))
                elif start == 0 or not low[start - 1].isalnum():
                    cued.add(end)
        for m in _SHAPES.finditer(text):
            if not self._other_number(low, m.start()):
                found.append((m.start(), m.end(), "identity_number"))
        for m in _PHONE.finditer(text):
            if _digits(m.group()) not in self.not_personal.phones and not self._other_number(low, m.start()):
                found.append((m.start(), m.end(), "phone"))
        covered = bytearray(len(text))
        for a, b, *_ in hidden + found:
            covered[a:b] = b"\1" * (b - a)
        self._names(text, low, cued, name_kind, found, covered)
        kept: list[tuple[int, int, str]] = []
        taken = bytearray(len(text))
        for p in sorted(found, key=lambda p: (KINDS.index(p[2]), p[0] - p[1], p[0])):
            if taken.find(1, p[0], p[1]) < 0:
                taken[p[0] : p[1]] = b"\1" * (p[1] - p[0])
                kept.append(p)
        return sorted(kept)

    @staticmethod
    def _other_number(low: str, at: int) -> bool:
        m = _PRECEDING.search(low[max(0, at - 24) : at])
        return bool(m) and m.group(1) in ("claim", "invoice", "statement", "code", "cpt", "hcpcs", "npi", "ref", "box")

    def _email(self, text: str, low: str, cue: str, start: int, end: int, found: list, hidden: list) -> None:
        written = cue not in ("@", "＠")
        stop = start
        while stop and text[stop - 1] == " " and start - stop < (8 if written else 1):
            stop -= 1
        at = stop
        while at and (text[at - 1].isalnum() or text[at - 1] in "_.+%'-"):
            at -= 1
        local = text[at:stop].lstrip(".'-+%")
        if not any(c.isalnum() for c in local):
            return
        right = (_WRITTEN if written else _DOMAIN).match(text, end)
        if not right:
            return
        if cue == " at " and not re.search(r"\bdot\b", right.group(1), re.I):
            return
        domain = _DOT.sub(".", right.group(1)).replace(" ", "").lower()
        at = stop - len(local)
        if domain in self.not_personal.domains or any(domain.endswith("." + d) for d in self.not_personal.domains):
            hidden.append((at, right.end()))
        else:
            found.append((at, right.end(), "email"))

    def _identity(self, text: str, low: str, cue: str, start: int, end: int, found: list) -> None:
        if start and low[start - 1].isalnum() or end < len(low) and low[end].isalpha():
            return
        m = _SSN_VALUE.match(text, end) if ID_CUES[cue] == "ssn" else None
        m = m or (_ID_VALUE.match(text, end) if ID_CUES[cue] == "id" else None)
        if m and sum(c.isdigit() for c in m.group(1)) >= 4:
            found.append((m.start(1), m.end(1), "identity_number"))

    def _street(self, text: str, low: str, start: int, end: int, found: list, hidden: list) -> None:
        if end < len(low) and (low[end].isalnum() or low[end] in "'’-"):
            return
        at, digits = self._house(text, low, start)
        if not digits:
            return
        if self._other_number(low, at):
            return
        rest = _AFTER_STREET.match(text, end)
        stop = rest.end() if rest else end
        if low[at:end] in self.not_personal.streets:
            hidden.append((at, stop))
        elif digits >= 2 or stop > end:
            found.append((at, stop, "street_address"))

    @staticmethod
    def _house(text: str, low: str, start: int) -> tuple[int, int]:
        """(place, digits) of the house number before a street's name that ends at ``start``; no digits if there is none.

        A name of more than three words has a capital in each of them, and no other street type.
        """
        i, n, capitals = start, 0, True
        while True:
            j = i
            while j and (low[j - 1].isalnum() or low[j - 1] in "_'’.-"):
                j -= 1
            w = low[j:i]
            if w.isdigit():
                return (j, len(w)) if n and len(w) <= 6 and (not j or low[j - 1] not in "$,/#") else (j, 0)
            n += 1
            capitals &= text[j : j + 1].isupper()
            if not w or w in _NUMBER_WORDS or w[-1] == "." or any(c.isdigit() for c in w) or not j or low[j - 1] != " " or n > 3 and (not capitals or w in STREET_TYPES):
                return j, 0
            i = j - 1

    def _names(self, text: str, low: str, cued: set[int], name_kind: Callable[[str], str | None], found: list, covered: bytearray) -> None:
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        kinds = [name_kind(name_word(low, a, b)) if b - a > 1 else None for a, b in words]
        free = [covered.find(1, a, b) < 0 for a, b in words]
        i = 0
        while i < len(words):
            a, b = words[i]
            k = kinds[i] if free[i] else None
            nxt = i + 1 < len(words) and free[i + 1]
            between = text[b : words[i + 1][0]] if nxt else ""
            if k and nxt and kinds[i + 1] and (between.strip() == "" and k in "fb" and kinds[i + 1] in "lb" or between == ", " and k in "lb" and kinds[i + 1] in "fb"):
                found.append((a, words[i + 1][1], "person_name"))
                i += 2
                continue
            if nxt and kinds[i + 1] and kinds[i + 1] in "lb" and b - a == 1 and text[a].isupper() and between in (". ", " ", "."):
                found.append((a, words[i + 1][1], "person_name"))
                i += 2
                continue
            # a first name goes on with a capitalised word that the lexicon lacks
            if k and k in "fb" and nxt and not kinds[i + 1] and between == " " and text[a].isupper() and self._may_name(text, *words[i + 1]):
                found.append((a, words[i + 1][1], "person_name"))
                i += 2
                continue
            if k and (text[a].isupper() or self._cue_before(cued, text, a)):
                found.append((a, b, "person_name"))
            i += 1

    @staticmethod
    def _may_name(text: str, a: int, b: int) -> bool:
        return b - a > 1 and text[a].isupper() and name_word(text[a:b].lower(), 0, b - a) not in _NO_NAMES

    @staticmethod
    def _cue_before(cued: set[int], text: str, at: int) -> bool:
        end = at
        while end and text[end - 1].isspace():
            end -= 1
        return end in cued


def name_word(low: str, a: int, b: int) -> str:
    """The word of a lower-case text as the lexicon has it, without the possessive ending."""
    return low[a:b].removesuffix("'s").removesuffix("’s")


def lexicon_of(names: DataFrame, column: str) -> DataFrame:
    """(word, kind) of full names: lower-case words, "f" for first ones, "l" for last ones, "b" for both."""
    parts = names.where(F.col(column).isNotNull()).select(F.split(F.lower(F.trim(F.col(column))), r"[\s,.]+").alias("p")).where(F.size("p") >= 2)
    rows = parts.select(F.posexplode("p").alias("i", "word"), (F.size("p") - 1).alias("n")).where(F.length("word") > 1)
    return rows.groupBy("word").agg(F.when(F.max(F.col("i") == F.col("n")) & F.max(F.col("i") < F.col("n")), "b").when(F.max(F.col("i") == F.col("n")), "l").otherwise("f").alias("kind"))


def name_statistics(text: str, no_names: frozenset[str] | set[str], low: Counter[str], seen: Counter[tuple[str, str]]) -> None:
    """Counts of one text: words in lower case, and (word, what) of words with a capital.

    ``what`` is "cap" for each place that may be a name's, "near" for those beside a word that goes with persons, and
    "f" or "l" for the first and the other words of names of several words. A capital at the start of a sentence says
    nothing and counts apart, as "start". Runs at a place name's position, after a house number or before a state, aren't either.
    """
    low.update(_LOWER.findall(text))
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    n, i = len(words), 0

    def named(k: int) -> bool:
        a, b, w = words[k]
        return b - a > 1 and w[0].isupper() and (not w.isupper() or b - a > 3) and name_word(w.lower(), 0, b - a) not in no_names

    def near(places: Iterable[int], seam: re.Pattern, forward: bool) -> bool:
        for k in places:
            if not 0 <= k < n or seam.search(text[words[k - 1][1] : words[k][0]] if forward else text[words[k][0] : words[k + 1][0]]):
                return False
            if words[k][2].lower() in PERSON_CUES:
                return True
        return False

    while i < n:
        a, b, w = words[i]
        if not (w[0].isupper() and named(i)):
            i += 1
            continue
        j = i + 1
        while j < n and j - i < 3 and named(j) and text[words[j - 1][1] : words[j][0]] == " ":
            j += 1
        turned = j == i + 1 and j < n and named(j) and text[b : words[j][0]] == ", "
        j += turned
        end = words[j - 1][1]
        before = text[max(0, a - 12) : a]
        beside = j < n and text[end : words[j][0]].isspace() and words[j][2].lower() in _ORGANISATIONS or i and text[words[i - 1][1] : a] == " " and words[i - 1][2][0].isupper() and words[i - 1][2].lower() in ORGANISATIONS
        if beside:
            for k in range(i, j):
                seen[name_word(words[k][2].lower(), 0, words[k][1] - words[k][0]), "cap"] += 1
        elif not (_HOUSE_BEFORE.search(before) or _STATE_AFTER.match(text, end)):
            initial = i > 0 and words[i - 1][1] - words[i - 1][0] == 1 and text[words[i - 1][0]].isupper()
            said = turned and all(words[k][2].isupper() for k in (i, i + 1)) or near(range(i - 1 - initial, i - 4, -1), _SENTENCE_SEAM, False) or near(range(j, j + 2 - initial), _PHRASE_SEAM, True)
            lead = before.rstrip(" \"'(*-")
            starts = (not lead or lead[-1] in ".!?\n:¿¡") and not _TITLE_BEFORE.search(before)
            # the last word of a text may be cut, but for a signature
            whole = j - (end == len(text) and not _SIGNED.search(before))
            for k in range(i, whole):
                w = name_word(words[k][2].lower(), 0, words[k][1] - words[k][0])
                if k == i and starts and not (said and j - i > 1):
                    seen[w, "start"] += 1
                else:
                    seen[w, "cap"] += 1
                    if said:
                        seen[w, "near"] += 1
                    if j - i > 1:
                        seen[w, "l" if (k == j - 1) != turned else "f"] += 1
        i = j


def corpus_names(df: DataFrame, columns: Sequence[str], facilities: Facilities, others: DataFrame | None = None) -> DataFrame:
    """(word, kind) of names that the texts themselves tell, as ``lexicon_of``.

    One pass over the texts, of which counts of words are shuffled. A name stands beside words that go with persons in
    at least half of its places with a capital; in lower case, or at the start of a sentence, it stands not more than
    three times as often.
    ``others`` (column word) are words that are known to be no names, such as those of insurers.
    """
    no_names = _NO_NAMES | {w for n in facilities.names | facilities.streets | facilities.places for w in _WORD.findall(n)}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            low: Counter[str] = Counter()
            seen: Counter[tuple[str, str]] = Counter()
            for c in b:
                for t in b[c]:
                    if t:
                        name_statistics(t, no_names, low, seen)
            rows = [(w, "low", n) for w, n in low.items()] + [(w, what, n) for (w, what), n in seen.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["word", "what", "n"])

    counts = df.select(*[F.col(f"`{c}`") for c in columns]).mapInPandas(run, "word string, what string, n bigint")
    n = counts.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("what") == x, F.col("n"))), F.lit(0)).alias(x) for x in ("low", "start", "cap", "near", "f", "l")])
    names = n.where("near > 0 and 2 * near >= cap and low <= 3 * cap and start <= 3 * cap")
    if others is not None:
        names = names.join(others.select("word").distinct(), "word", "left_anti")
    return names.select("word", F.when((F.col("f") > 0) & (F.col("l") == 0), "f").when((F.col("l") > 0) & (F.col("f") == 0), "l").otherwise("b").alias("kind"))


def merged_lexicon(given: DataFrame, learnt: DataFrame) -> DataFrame:
    """(word, kind): what is given goes before what is learnt."""
    both = given.select("word", "kind", F.lit(0).alias("i")).unionByName(learnt.select("word", "kind", F.lit(1).alias("i")))
    return both.groupBy("word").agg(F.min_by("kind", "i").alias("kind"))


def find_places(df: DataFrame, columns: Sequence[str], facilities: Facilities, lexicon: DataFrame, carry: Sequence[str] = (), masked: bool = False, broadcast_words: int = 500_000) -> DataFrame:
    """For each row and text column an array ``<column>_places`` of (start, stop, kind), from 0, and, if ``masked``,
    ``<column>_masked``: the text with placeholders.

    The lexicon is broadcast up to ``broadcast_words`` words; beyond, the words of each text that a bitmap of
    the lexicon lets through are joined to it by a shuffle and each row brings its own names. ``carry`` are columns carried along. No other shuffle.
    """
    spark = df.sparkSession
    columns = list(columns)
    head = lexicon.limit(broadcast_words + 1).select("word", "kind").toPandas()
    shared = spark.sparkContext.broadcast(dict(zip(head["word"], head["kind"])) if len(head) <= broadcast_words else None)
    rows = df.select(*[F.col(f"`{c}`") for c in [*carry, *columns]])
    if len(head) > broadcast_words:
        bits = spark.sparkContext.broadcast(bitmap_of(lexicon, F.xxhash64("word")))

        @F.pandas_udf("array<string>")
        def words(texts: pd.Series) -> pd.Series:
            known = bits.value
            return texts.map(lambda t: [w for w in {name_word(low, a, b) for low in [_lower(t)] for a, b in (m.span() for m in _WORD.finditer(t))} if has(known, hashed(w))])

        # the names of a row depend on its texts alone, so that their digest is its key
        rows = rows.withColumn("_row", F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)]))))
        said = F.array_distinct(F.flatten(F.array(*[words(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in columns])))
        names = rows.select("_row", F.explode(said).alias("word")).distinct().join(lexicon, "word").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "kind"))).alias("_names"))
        rows = rows.join(names, "_row", "left").drop("_row")
    else:
        rows = rows.withColumn("_names", F.lit(None).cast("map<string,string>"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, known = Finder(facilities), shared.value
        for b in batches:
            out = {c: b[c] for c in carry}
            for c in columns:
                places = [finder.places(t, known.get if known is not None else dict(n or {}).get) for t, n in zip(b[c], b["_names"])]
                out[f"{c}_places"] = [[{"start": x, "stop": y, "kind": k} for x, y, k in p] for p in places]
                if masked:
                    out[f"{c}_masked"] = [mask(t, p) for t, p in zip(b[c], places)]
            yield pd.DataFrame(out)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*carry).schema.fields], *[f"`{c}_places` array<struct<start:int,stop:int,kind:string>>" + (f", `{c}_masked` string" if masked else "") for c in columns]])
    return rows.mapInPandas(run, schema)


def mask(text: str | None, places: Sequence[tuple[int, int, str]]) -> str | None:
    if not places:
        return text
    out, at = [], 0
    for a, b, kind in places:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])
