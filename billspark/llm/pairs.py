"""Broken prompt and response pairs: empty, copied, refused, cut and foreign answers.

Copies: the answer's words are aligned to the prompt's by shingle containment and, where that is high, by the longest
common subsequence; a copy leaves hardly a word of the answer unaligned. Refusals: every sentence of the answer
aligns with a refusal template or a polite filler, and one at least with a refusal. Languages are told by function
words and letters. Cuts come from the truncation operator.

Defined results: no pair exists without a prompt; a pair has one defect, the first of empty, copy, refusal,
other_language, truncated; answers too short to tell a language are of none; a pair delivered twice counts once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billspark.llm import truncation
from billspark.llm.leakage import words

# Refusals and the polite sentences around them, in lower case without punctuation.
REFUSALS = """
i can't help with that|i'm sorry but i can't help with that|i cannot assist with that|sorry this is something i cannot assist with
i'm unable to provide an answer here|my apologies i'm unable to provide an answer here|i am unable to help with this request|i am not able to discuss this
i won't be able to respond to this request|i will not answer this question|i'd rather not comment on your bill|i would rather not say anything about that
i must refrain from commenting on matters like this|unfortunately i have to decline this question|i have to decline to answer|regrettably no reply can be given to this question
it would not be appropriate for me to respond|this falls outside what i am allowed to talk about|that is not a topic i will go into|let us leave this topic aside
this is not something i do|this is not something i can do|we do not handle such questions in this chat|no can do this one is off the table for me
as an automated assistant i don't answer questions of this kind|as an ai i cannot answer that|answering that would go beyond my role so i will stop here|for your safety i cannot say more about it
my guidelines do not permit it|my guidelines do not allow me to answer|i am not permitted to answer this|i do not have permission to discuss this
lo siento no puedo ayudarle con eso|no puedo responder a esa pregunta|prefiero no hablar de su factura|no estoy autorizado para responder a esta pregunta|esa consulta queda fuera de lo que puedo tratar|lamento no poder ayudarle|no me es posible contestar
désolé je ne peux pas vous aider sur ce point|je ne suis pas en mesure de répondre à cette question|je préfère ne pas commenter votre facture|je ne peux pas répondre à cette question|cette question dépasse ce que je peux traiter|je regrette de ne pas pouvoir vous aider
""".strip().replace("\n", "|").split("|")
FILLERS = """
hello|hi|hi there|thank you for your message|thank you for reaching out|thanks for your question|i hope you understand|i understand this is stressful|please contact someone who can|please speak with a qualified professional instead
is there anything else you would like to talk about|i'm sorry|my apologies|i apologize for the inconvenience|please ask the billing office|please consult a lawyer or a doctor|thank you for your understanding|i know this is not easy
hola|gracias por su mensaje|espero que lo entienda|consulte a un profesional|por favor hable con otra persona|entiendo que es difícil|bonjour|merci pour votre message|j'espère que vous comprenez|veuillez consulter un professionnel|je comprends que c'est difficile
""".strip().replace("\n", "|").split("|")
LANGUAGES = {
    "en": "the a an is are was were of to and in my on for i you it that what why how do does did can could with this we or not from should if me be there your so as at by after before which who when our have has will would please",
    "es": "el la los las de del que en y por con para una un su sus mi si ya no es se lo al como cuando pero más este esta qué cómo cuál según antes hasta usted puede tiene también quizá reciba debo pagar recibí dice pagó somos podemos factura seguro cartas rechazó primero",
    "fr": "le la les des du de et est une un votre vos que qui pour dans sur avec pas ne ce cette il elle nous vous mon ma mes pourquoi à au aux si sont j'ai ai été déjà reste quoi avant fois deux dois puis quelle quel comment sous possible même notre",
    "de": "der die das und ist nicht sie ein eine einen bitte mit für auf den dem von im zu ihre ihr ihren kann keine vor noch nur ob bei wird werden hat aus einmal nichts solange wenn oder sind unter können möglich bereits haben schriftlich innerhalb zeit",
    "pt": "o os as de do da dos das que em e um uma para com não sua seu você por no na ao mais antes se pelo pela há foi já pode também este esta suas seus enquanto até isso qualquer fazer apenas vez",
    "it": "il lo gli di che è una per con non sono della del suo sua ha dei delle anche questo questa prima nel alla può come più",
    "nl": "de het een en van is niet u uw voor met op dat te zijn aan er maar om ook bij nog wordt kan dit heeft",
}
_INDEX: dict[str, list[str]] = defaultdict(list)
for _lang, _words in LANGUAGES.items():
    for _w in set(_words.split()):
        _INDEX[_w].append(_lang)
_INDEX = dict(_INDEX)
_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_VIETNAMESE = re.compile("[ạ-ỹđĐơƠưƯ]")
_SCRIPTS = (("ru", re.compile("[Ѐ-ӿ]")), ("el", re.compile("[Ͱ-Ͽ]")), ("ar", re.compile("[؀-ۿ]")), ("he", re.compile("[֐-׿]")), ("zh", re.compile("[぀-ヿ一-鿿가-힯]")))


def lcs(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a column at a time in the bits of a number."""
    at: dict = defaultdict(int)
    for i, x in enumerate(a):
        at[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def is_copy(prompt: str, answer: str, extra: int = 5, kept: float = 0.6) -> bool:
    """Whether the answer gives back the prompt, perhaps framed, changed or repeated any number of times, and nothing else.

    In a copy all but ``extra`` words align, so that the head of a long answer tells already whether it may be one.
    """
    p = words(prompt)
    pairs = set(zip(p, p[1:]))

    def contained(r: list[str]) -> bool:
        return len(r) < 3 or sum(x in pairs for x in zip(r, r[1:])) >= 0.4 * (len(r) - 1)

    if not p:
        return False
    if len(answer) > 3 * len(prompt) + 80:
        head = words(answer[: max(300, len(prompt))])
        if len(head) > 3 * extra and not contained(head[:-1]):
            return False
    r = words(answer)
    if not r or len(r) < kept * len(p) or not contained(r):
        return False
    parts = 1 if len(r) < 1.6 * len(p) else max(2, round((len(r) - extra / 2) / len(p)))
    cuts = [len(r) * k // parts for k in range(parts + 1)]
    # repeats that a frame shifts begin anywhere in the prompt
    common = [lcs(p if parts == 1 else p + p, r[x:y]) for x, y in zip(cuts, cuts[1:])]
    return min(common) >= kept * len(p) and len(r) - sum(common) <= min(extra, max(2, 0.3 * len(r)))


def _plain(s: str) -> list[str]:
    return _TOKENS.findall(s.lower().replace("’", "'"))


class Templates:
    """Sentences to align with; a sentence aligns if the common subsequence is most of both."""

    def __init__(self, texts: Iterable[str]):
        self.by_word: dict[str, list[list[str]]] = defaultdict(list)
        self.exact = set()
        for t in texts:
            w = _plain(t)
            self.exact.add(tuple(w))
            for x in set(w):
                self.by_word[x].append(w)

    def aligns(self, w: list[str], least: float = 0.75) -> bool:
        if tuple(w) in self.exact:
            return True
        # an aligned template is over half as long and has the most of both
        if len(w) < 2 or sum(x in self.by_word for x in w) < 0.75 * least * len(w):
            return False
        seen: set[int] = set()
        for x in sorted(set(w), key=lambda x: len(self.by_word.get(x, ())))[: len(w) - int(0.75 * least * len(w)) + 1]:
            for t in self.by_word.get(x, ()):
                if id(t) not in seen:
                    seen.add(id(t))
                    if len(t) > 2 and 0.5 < len(w) / len(t) < 2 and 2 * lcs(t, w) >= least * (len(t) + len(w)):
                        return True
        return False


# How a refusal is worded in general, for sentences without a template.
_REFUSES = re.compile(
    r"\b(?:can(?:no|')t|can not|unable to|not able to|won't be able to|will not|won't|must (?:decline|refrain)|have to decline|(?:would|'d) rather not|not (?:allowed|permitted|authorized|appropriate)|no puedo|no podemos|je ne peux pas|je ne suis pas en mesure)\b"
    r".{0,40}\b(?:help|assist|answer|respond|discuss|comment|reply|talk|say|ayudar\w*|responder|contestar|hablar|aider|répondre|commenter)\b"
)
# How others are named whom to ask, with or without their number.
_REFERS = re.compile(
    r"(?:(?:please|kindly|instead|you (?:can|may|should|could)|i suggest (?:you|that you)|por favor|veuillez),? )?(?:call|contact|ask|reach(?: out to)?|speak (?:to|with)|talk (?:to|with)|consult|write to|consulte(?:r)?|llame a|hable con|contacte[rz]?|appele[rz]|parle[rz] (?:à|avec)) "
    r"(?:(?:a|an|the|your|our|one of our|some|someone|somebody|another|un|una|el|la|su|le|votre|al|qualified|licensed|medical|legal|billing|financial|customer|patient|care) )*[^\W\d_]*\w+(?: (?:office|team|department|desk|line|services?|counselor|professional|advisor|staff|support|who can|instead|directly|at [\d() .+-]+|on [\d() .+-]+|for (?:help|that|this)|about (?:this|that|it)))*[.!]?"
)
_SUBJECT = re.compile(r"\b(?:i|we|i'm|i'd|it|ai|assistant|unfortunately|regrettably|lo siento|no|je)\b|^(?:unable|not able|can)")
_HELPS = re.compile(r"\b(?:but|though|pero|mais|however)\b.*\b(?:can|puedo|peux|let me|will)\b")
_GREETS = re.compile(r"(?:dear|hello|hi|hola|bonjour)\b.{0,40}$")
_refusals, _fillers = Templates(REFUSALS), Templates(FILLERS)


def is_refusal(answer: str) -> bool:
    """Whether the answer says only that it won't or can't help, in however many sentences."""
    refused, answer, at = False, answer.strip(), 0
    while at < len(answer):
        seam = _SENTENCES.search(answer, at)
        s = answer[at : seam.start()] if seam else answer[at:]
        at = seam.end() if seam else len(answer)
        w = _plain(s)
        if not w:
            continue
        low = s.strip().lower().replace("’", "'")
        if _refusals.aligns(w) or (m := _REFUSES.search(low)) and _SUBJECT.search(low, 0, m.end()) and not _HELPS.search(low):
            refused = True
        elif not (_fillers.aligns(w) or _GREETS.match(low) or _REFERS.fullmatch(low)):
            return False
    return refused


def language_counts(text: str) -> dict[str, int]:
    """Function words of each language in a text, for other scripts a count of their letters."""
    counts: dict[str, int] = {}
    plain = text.isascii()
    if not plain:
        letters = sum(map(str.isalpha, text))
        if not letters:
            return {}
        for lang, script in _SCRIPTS:
            if script.search(text) and (n := len(script.findall(text))) > 0.4 * letters:
                return {lang: max(3, n // 4)}
    said = Counter(_TOKENS.findall(text.lower() if plain else text.lower().replace("’", "'")))
    for w in said.keys() & _INDEX.keys():
        for lang in _INDEX[w]:
            counts[lang] = counts.get(lang, 0) + said[w]
    if not plain and (n := len(_VIETNAMESE.findall(text))) > 0.08 * letters:
        counts["vi"] = max([0, *counts.values()]) + n
    return counts


def prompt_language(text: str) -> str | None:
    """The language asked in: another than English if some sentence is in it, whatever is added in English."""
    best: tuple[int, str] | None = None
    english = False
    for s in _SENTENCES.split(text):
        counts = language_counts(s)
        if counts:
            english = english or counts.get("en", 0) >= 1
            lang = max(counts, key=lambda k: (counts[k], k == "en", k))
            if lang != "en" and counts[lang] >= 2 and counts[lang] >= 2 * counts.get("en", 0) and (best is None or counts[lang] > best[0]):
                best = (counts[lang], lang)
    if best:
        return best[1]
    # beside another script, English words count only where they are not the lesser part
    return "en" if english and (text.isascii() or language_counts(text).get("en", 0) >= 1) else None


def is_foreign(prompt: str, answer: str) -> bool:
    asked = prompt_language(prompt)
    if asked is None:
        return False
    counts = language_counts(answer)
    if not counts:
        return False
    lang = max(counts, key=lambda k: (counts[k], k == asked, k))
    if lang == asked or counts[lang] == 0:
        return False
    # a sentence of five words or more without any function word of the language asked in is in another one
    return counts.get(asked, 0) <= 0.6 * counts[lang] if counts[lang] >= 2 else counts.get(asked, 0) == 0 and len(_TOKENS.findall(answer)) >= 5


def defect(prompt: str | None, answer: str | None) -> str | None:
    """empty, copy, refusal, other_language or None of a pair; no_pair where there is no prompt."""
    if not truncation._cleaned(prompt):
        return "no_pair"
    if truncation.no_text(answer):
        return "empty"
    if is_copy(prompt, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    return "other_language" if is_foreign(prompt, answer) else None


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """(id, pair_name, defect) of each defective pair.

    ``pairs`` has id, source, field (the pair's name), text, sibling and prompt. Copies, refusals and languages are
    told in the truncation operator's first pass over the texts, without a shuffle of their own.
    """
    there = pairs.where(F.trim("prompt") != "")
    cut = truncation.truncation_posterior(there, label=defect).where("label is null or label != 'no_pair'")
    found = cut.select("id", F.col("field").alias("pair_name"), F.coalesce("label", F.when(F.col("p_cut") > 0.5, "truncated")).alias("defect"))
    return found.where("defect is not null").distinct()
