"""Defective prompt and response pairs, by ordered rules.

Each pair passes rules for emptiness, refusals in several languages, copied questions and copied beginnings of them,
language or script other than the question's, and broken-off ends (unclosed delimiters, abrupt last words). Every rule
that fires adds its defect; they stand in the order in which they count, so the first is the one where a single type is
asked for. A refusal counts before all but emptiness, unless it is in another language than the question.

Whether the last word of a span of a passage can end a phrase cannot be told from the pair alone ("the blue" and "the
barrel" look alike). Such pairs go to a second step, where all passages answer: the share of that word's occurrences
at which a phrase ends. It is a share and nothing but a share, so it does not move with the number of passages.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.runtime import spread

#: In the order in which they count; a refusal in another language counts as that first.
DEFECTS = ("empty", "refusal", "copied_question", "wrong_language", "truncated")

#: A word that ends a phrase at a lesser share of its occurrences cannot end an answer.
LEAST_CLOSED = 0.25

USER = ("user", "human")
ASSISTANT = ("assistant", "gpt", "bot")

# Words that tell a language and are rare in the others.
_TELLING = {
    "en": "i my me a no not must can cannot that the of and is are was were you your it its that this with for from which what where who how why when if then not they have has would could should there these those be been by at about does did do",
    "de": "der die das den dem des ein eine einen einem einer eines und oder nicht ist sind sie ich wir ihr im am zum zur vom beim mit auf für von zu bei nach aus wenn weil dass wie kann können sollten soll damit auch noch einmal nebenan hinter neben unter über zwischen vor jenseits entlang außerhalb innerhalb oberhalb unterhalb dazu diese dieser dieses möchte wurde warum wo wer",
    "fr": "l c qu le les une est et du des dans sur avec pour pas que qui vous nous je il elle cela était au aux cette ce ces faut sont fut à où derrière devant chez",
    "es": "el los las una y es con por para que del al fue lo se hay usted como más detrás delante unos unas sobre está cerca orillas según antes después muy",
    "it": "il lo gli di che è uno per con non sono della nel alla questo",
    "nl": "het een van niet dat zijn voor met aan ook naar ik je",
    "pt": "os um uma é do da em não que para com na ao foi você",
}
_TELL = {lang: frozenset(w.split()) for lang, w in _TELLING.items()}
_TELLS = {w: tuple(lang for lang in _TELL if w in _TELL[lang]) for w in frozenset().union(*_TELL.values())}

# Words after which a phrase goes on.
_OPEN = frozenset(
    "the a an of to in on at by for with from behind beyond near beside between under into onto upon along inside outside across and or but because "
    "although while before after that which if when as than my your his her their our its every very is are was were has have had will would can could should must such "
    "der die das den dem des ein eine einen einem einer eines im am auf an mit von zu zum zur vor hinter neben unter über entlang jenseits zwischen und oder aber weil "
    "obwohl während nachdem bevor dass damit wie wenn ist sind war wurde le la les un une des du au aux et ou mais dans sur avec pour el los las unos unas y o pero en con por para del al".split()
)
# Words that may follow a complete phrase.
_NEXT = _OPEN | frozenset("so early late yesterday today tomorrow again last many two first once also without early in also later then according during there here".split())

# How one declines to answer. What one cannot do is a refusal only before a verb of answering or helping
# ("I cannot find the key" is none).
_SERVE = r"(?:help|assist|support|serve|answer|respond|reply|discuss|comment|say|speak|talk|tell|explain|describe|advise|disclose|reveal|share|provide|offer|give|supply|continue|comply|engage|participate|take part|go (?:into|there)|look (?:at|into)|listen|read|see that|view|access|write|create|generate|produce|complete|process|fulfil|fulfill|accommodate|do (?:that|this|it|so)|be (?:of help|able))\b"
_UNABLE = r"(?:can(?:not|'?t| not)|won'?t|will not|couldn'?t|could not|(?:am|'m|are|'re) (?:unable to|not (?:able|going) to)|(?:do not|don'?t) have the ability to)"
_DECLINE = r"(?:(?:am|'m|are|'re) not (?:permitted|allowed|comfortable|in a position)|couldn'?t possibly|must (?:decline|refuse|pass)|have to (?:decline|refuse|pass)|will have to (?:decline|pass)|(?:would|'d) (?:rather|prefer) not|prefer not|do(?: not|n'?t) (?:feel comfortable|have permission|wish to|want to (?:answer|discuss|talk))|(?:have|'ve) been (?:told|instructed|asked) not|decline to|refuse to|respectfully decline)"
_CANT = rf"(?:{_DECLINE}|{_UNABLE}(?:\s+\w+ly)?(?:\s+{_SERVE}|\s*(?:[.!;]|$)))"
_REFUSALS = [
    re.compile(p, re.I)
    for p in (
        rf"\b(?:i|we)\b ?(?:(?:really|simply|just|therefore|also|regret that i|am sorry,? but i|am afraid i|'m afraid i) )?{_CANT}(?!\s+(?:\w+\s+){{0,4}}?enough\b)(?!\s+but\b)",
        r"\b(?:it )?(?:is|would|was)(?: not|n'?t)(?: be)? (?:possible|appropriate|right|proper|suitable|advisable) for me\b|\b(?:impossible|inappropriate) for me to\b",
        r"\b(?:i|we) (?:do not|don'?t|must not|may not|shouldn'?t|should not|could not|couldn'?t) (?:answer|discuss|comment|provide (?:that|this|such)|share (?:that|this|such)|give (?:advice|out)|engage|respond|take part|do (?:that|this) for you)\b",
        r"\bnot (?:something|a (?:topic|question|subject|request)) (?:that )?i(?:'m| am| can| could|'d)\b|\bnot at liberty\b|\bbeyond what i(?: can|'m| am)\b|\bi(?:'ll| will| would|'d)? (?:prefer|choose|rather)(?: to)? not\b|\bi(?:'d| would) prefer to pass\b",
        r"^\W*(?:sorry\W+)?(?:cannot|can'?t|unable to|won'?t|not able to) (?:answer|help|assist|say|comply|discuss|comment|do (?:that|this))",
        r"^\W*no comment\b",
        r"\bdoes(?: not|n'?t) (?:let|allow|permit) me\b",
        r"\boutside (?:of )?what i(?: am|'m)? (?:allowed|able|permitted)\b|\b(?:goes )?against my (?:guidelines|policy|policies|rules|programming)\b|\bfalls outside my (?:policy|guidelines|remit|scope)\b",
        r"\bas an? (?:ai|language model|assistant)\b[^.]*\b(?:not|cannot|can'?t|unable)\b",
        # German
        r"\bich\b[^.!?]{0,30}\b(?:kann|darf|möchte|will|werde)\b(?![^.!?]*\bgenug\b)[^.!?]{0,60}\b(?:nicht|kein\w*|nichts)\b|\b(?:kann|darf|möchte|will|werde) ich\b(?![^.!?]*\bgenug\b)[^.!?]{0,80}\b(?:nicht|kein\w*|nichts)\b",
        r"\b(?:muss|möchte) (?:ich )?[^.!?]{0,40}\bablehnen\b|\bich lehne\b[^.!?]{0,30}\bab\b|\bbin ich nicht (?:in der lage|befugt|berechtigt)|\bich bin nicht (?:in der lage|befugt|berechtigt)|\bist (?:es )?mir (?:leider )?nicht (?:möglich|erlaubt|gestattet)|\bdazu (?:sage ich|äußere ich mich) n|^\W*kein(?:en)? kommentar\b",
        # French
        r"\bje ne (?:peux|puis|suis|veux|souhaite|dois)\b[^.!?]{0,30}\b(?:pas|rien)\b(?![^.!?]*\bassez\b)|\bje (?:refuse|préfère ne pas|dois (?:refuser|décliner))|\bil m'est impossible\b|\bpas en mesure de\b",
        # Spanish
        r"(?<!\w)no (?:puedo|me es posible|estoy (?:autorizad|en condiciones)|tengo permitido|quiero (?:responder|hablar)|voy a (?:poder|ayudar|responder|contestar|hablar|dar|hacer)\w*)(?![^.!?]*\bsuficiente)|\b(?:debo|tengo que) (?:rechazar|declinar)|\bprefiero no\b|\bme (?:resulta|es) imposible\b",
        # Italian
        r"\bnon (?:posso|sono (?:in grado|autorizzat\w+)|mi è (?:possibile|permesso|consentito)|intendo|voglio (?:rispondere|parlare))\b(?![^.!?]*\babbastanza\b)|\b(?:devo|dovrei) (?:rifiutare|declinare)\b|\bpreferisco non\b|\bmi è impossibile\b|\bmi rifiuto\b",
        # Dutch
        r"\bik (?:kan|mag|wil|zal)\b(?![^.!?]*\bgenoeg\b)[^.!?]{0,60}\b(?:niet|geen|niets)\b|\b(?:kan|mag|wil|zal) ik\b(?![^.!?]*\bgenoeg\b)[^.!?]{0,80}\b(?:niet|geen|niets)\b|\bik weiger\b|\bik moet\b[^.!?]{0,40}\bweigeren\b|\bik ben niet (?:in staat|bevoegd)\b|^\W*geen commentaar\b",
        # Portuguese
        r"\bnão (?:posso|consigo|me é (?:possível|permitido)|estou (?:autorizad\w+|em condições)|tenho (?:permissão|autorização)|quero (?:responder|falar)|vou (?:poder|ajudar|responder|falar|dar|fazer)\w*)(?![^.!?]*\bsuficiente)|\b(?:devo|tenho (?:de|que)) (?:recusar|declinar)\b|\bprefiro não\b|\bé-me impossível\b|\brecuso-me\b",
    )
]
# Each pattern above asks for one of these words, so a reply without any is no refusal.
_DECLINES = frozenset(
    "not cannot can't cant won't wont couldn't couldnt unable decline refuse pass don't dont isn't isnt wasn't wasnt wouldn't wouldnt mustn't mustnt shouldn't shouldnt doesn't doesnt impossible inappropriate beyond prefer rather choose no outside against falls "
    "nicht nichts kein keine keinen keinem keiner keines keinerlei ablehnen lehne ne refuse préfère dois m'est pas rechazar declinar prefiero imposible non devo dovrei rifiutare declinare preferisco impossibile rifiuto niet geen niets weiger weigeren não recusar prefiro impossível recuso recuso-me".split()
)

_NOTHING = re.compile(r"^\W*(?:n\W?a|null|nil|nan|none|empty|blank|undefined|no (?:answer|reply|response|content)|keine antwort|leer|aucune réponse|vide|sin respuesta|vacío)\W*$", re.I)
_MARK = re.compile(r"^(?:\s*<(?:text|speech)>\s*)+", re.I)
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_FENCE = re.compile(r"```.*?```", re.S)
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+")
_BARE_ITEM = re.compile(r"(?:^|\n)\s*(?:[-*•–]|\d{1,3}[.)])\s*$")
_ENDED = re.compile(r"(?:[.!?。！？…\"”»)\]`:]|[^\w\s,;:(\[{–—-])\s*$")
_SIGN_OFF = re.compile(r"(?i)\b(?:hope (?:this|that|it) helps|let me know|good luck|best(?: wishes| regards)?|regards|cheers|thanks?(?: you)?|you'?re welcome|viel (?:erfolg|glück|spaß)|ich hoffe,? das hilft|(?:hoffe|hoffentlich),? (?:das )?hilft(?: das)?|gern geschehen|danke|viele grüße|bonne chance|j'espère que cela (?:vous )?aide|buena suerte|espero que (?:esto )?ayude)\W*$")
_ASKS_LANGUAGE = re.compile(r"(?i)\b(?:translat\w*|übersetz\w*|tradui\w*|traduc\w*|(?:in|into|auf|ins|en|to) (?:english|german|french|spanish|italian|dutch|portuguese|englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|anglais|allemand|espagnol|français|inglés|alemán|francés|español))\b")
_ASKS_COPY = re.compile(r"(?i)\b(?:repeat|copy|echo|quote|say|write|wiederhol\w*|schreib\w*|répét\w*|repit\w*)\b[^.!?]{0,40}\b(?:following|sentence|exactly|verbatim|word for word|back to me|folgenden?|satz|wörtlich|genau|suivante?|phrase|exactement|siguiente|frase|exactamente)\b")
_ASKS_SHORT = re.compile(r"(?i)\b(?:(?:one|a single|1|two|few) words?|single word|yes or no|in short|(?:einem|ein|zwei) wort\w*|ja oder nein|un (?:seul )?mot|oui ou non|una (?:sola )?palabra|sí o no|briefly|kurz)\b")
_LEAD_IN = frozenset("you asked your question was is user human the so hm hmm well ok okay want to know about this good q frage deine ihre lautet war sie du fragen fragst fragten also nun gute question vous avez demandé usted preguntó pregunta prompt repeat".split())


def _words(text: str) -> list[str]:
    return [w.lower().replace("’", "'") for w in _WORD.findall(text)]


def language(words: list[str]) -> tuple[str | None, int]:
    """The language most telling words speak for and how many they are; None without a clear one."""
    n: dict[str, int] = {}
    for w in words:
        for part in w.split("'") if "'" in w else (w,):
            for lang in _TELLS.get(part, ()):
                n[lang] = n.get(lang, 0) + 1
    if not n:
        return None, 0
    most = max(n.values())
    top = [lang for lang in n if n[lang] == most]
    return (top[0], most) if len(top) == 1 else (None, 0)


def _script(text: str) -> str | None:
    """'latin' or 'other', what most letters are; None without letters."""
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else None
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return None
    return "latin" if 2 * sum(c < "ɐ" or "Ḁ" <= c < "ἀ" for c in letters) >= len(letters) else "other"


def _like(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) > 2 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.75)


def copies_question(question: list[str], answer: list[str]) -> bool:
    """Whether an answer is the question again (perhaps twice, with slips or a lead-in) or its beginning, and nothing else."""
    if len(question) < 3 or len(answer) < 3:
        return False
    if len(answer) >= 0.3 * len(question) and answer == question[: len(answer)]:
        return True
    if len(answer) < 0.7 * len(question):
        return False
    # matching blocks hold no more words than both have in common
    left = Counter(answer)
    if sum(min(n, left[w]) for w, n in Counter(question).items()) < 0.6 * len(question):
        return False
    rest, covered, asked = answer, 0, set(question)
    for _ in range(3):  # once more for each repetition
        m = SequenceMatcher(None, question, rest, autojunk=False).get_matching_blocks()
        if sum(b.size for b in m) < 0.6 * len(question):
            break
        covered = max(covered, sum(b.size for b in m))
        taken = {j for b in m for j in range(b.b, b.b + b.size)}
        rest = [w for j, w in enumerate(rest) if j not in taken]
        if not rest:
            return True
    return covered >= 0.6 * len(question) and all(w in _LEAD_IN or any(_like(w, q) for q in asked) for w in rest)


@lru_cache(maxsize=2048)
def _laid_out(context: str) -> tuple[str, list[int], list[int]]:
    """The plain words of a passage, each after a blank; where each stands there, and where it ends in the passage."""
    low = context.lower().replace("’", "'")
    if len(low) != len(context):  # a few capitals get longer
        low = "".join(x if len(x := c.lower()) == 1 else c for c in context).replace("’", "'")
    found = [(m[0], m.end()) for m in _WORD.finditer(low)]
    plain = [w for w, _ in found]
    return " " + " ".join(plain), [0, *accumulate(len(w) + 1 for w in plain)][:-1], [e for _, e in found]


def _spans(answer: list[str], context: str) -> tuple[str | None, str | None]:
    """How a passage goes on after an answer: 'inside' a word, at the 'edge' of a phrase, or 'on' (with the answer's
    last word to look up); None if it does not hold the answer."""
    if not answer:
        return None, None
    plain, starts, ends = _laid_out(context)
    span, found, inside = " " + " ".join(answer), False, True
    at = plain.find(span)
    while at >= 0:
        found, stop = True, at + len(span)
        if stop == len(plain) or plain[stop] in " '":
            inside = False
            if plain[stop : stop + 1] != "'":
                rest = context[ends[bisect_right(starts, stop - 1) - 1] :][:40]
                nxt = re.match(r"\s+(\w+)", rest)
                if not nxt or nxt[1].lower() in _NEXT or nxt[1].isdigit():
                    return "edge", None
        at = plain.find(span, at + 1)
    if not found:
        return None, None
    return ("inside", None) if inside else ("on", answer[-1])


def judge(question: str | None, answer: str | None, context: str | None = None) -> tuple[list[str], str | None]:
    """The defects of a pair, in the order in which they count, and the last word to look up in all passages if only they
    can tell whether the reply is truncated too."""
    text = _INVISIBLE.sub(lambda m: m[0] if m[0].isspace() else "", answer or "") if answer and not answer.isprintable() else answer or ""
    text = _MARK.sub("", text).strip()
    if not any(c.isalnum() for c in text):
        return ["empty"], None
    asked = _MARK.sub("", question or "").strip()
    plain = _FENCE.sub(" ", text) if "```" in text else text
    q, a = _words(asked), _words(plain)
    span, last = _spans(a, context) if context else (None, None)
    if _NOTHING.match(text) and not (span == "edge" and text[0].isalnum() and text in (context or "")):
        return ["empty"], None
    quoted = span in ("edge", "on")
    # what stands in the passage, be it cut within a word, is in its language
    q_lang, _ = language(q)
    a_lang, telling = language(a)
    own = sum(w in _TELL[q_lang] for w in a) if q_lang and a_lang != q_lang else 0
    foreign = span is None and bool(q_lang and a_lang and a_lang != q_lang and telling > 2 * own) or (_script(asked) == "latin" and _script(plain) == "other")
    refused = copied = False
    if not quoted:
        refused = not (_DECLINES.isdisjoint(a) and "```" not in text) and any(p.search(text.replace("’", "'")) for p in _REFUSALS)
        asks_copy = bool(_ASKS_COPY.search(asked)) if foreign or a[:3] == q[:3] or len(a) >= 0.7 * len(q) else False
        copied = (not asks_copy or a[:3] == q[:3]) and copies_question(q, a)
        asked_for = bool(_ASKS_LANGUAGE.search(asked)) or asks_copy and " ".join(a) in " ".join(q) if foreign else False
    # a refusal in another language is a reply in another language first
    wrong = not quoted and foreign and (refused or not (copied or asked_for))
    cut, look = _broken(text, asked, a, span, last, bool(context))
    kinds = ("wrong_language", "refusal", "copied_question", "truncated") if foreign else ("refusal", "copied_question", "wrong_language", "truncated")
    fired = {"refusal": refused, "copied_question": copied, "wrong_language": wrong, "truncated": cut}
    return [k for k in kinds if fired[k]], look


def _broken(text: str, asked: str, a: list[str], span: str | None, last: str | None, on_passage: bool) -> tuple[bool, str | None]:
    """Whether a reply stops before its end, or the word that all passages must be asked about to tell. Answers on a passage are mostly
    bare spans, so they need no mark at the end."""
    if text.count("```") % 2 or _BARE_ITEM.search(text):
        return True, None
    prose = (_FENCE.sub(" ", text) if "```" in text else text).rstrip()
    if text.endswith("```") or not a:
        return False, None
    if any(prose.count(x) > prose.count(y) for x, y in ("()", "[]", "{}", "“”", "«»")) and not prose.endswith((":)", ";)")):
        return True, None
    if re.search(r"(?:[,;–—(\[{/&+=]|\s-|\w-)$", prose) or re.search(r"\w\s*(?:\.\.\.|…)$", prose):
        return True, None
    ended = bool(re.search(r"[.!?。！？]['\"”’»)\]*_]*$", prose))
    title = len(a) > 1 and all(w[0].isupper() or w[0].isdigit() for w in _WORD.findall(prose))
    if span is not None:
        if span == "inside":
            return True, None
        if ended or title:
            return False, None
        if a[-1] in _OPEN:
            return True, None
        # a name may be followed by anything; a phrase that an article or preposition opened may not
        return False, re.sub(r"\d", "0", last) if span == "on" and last and a[0] in _OPEN else None
    if ended or (not ended and _SIGN_OFF.search(prose)):
        return False, None
    if a[-1] in _OPEN and not title:
        return True, None
    if prose.endswith(":"):
        return True, None
    if not re.search(r"\w$", prose):  # an emoji or other mark closes the text
        return False, None
    if _ASKS_COPY.search(asked) and " ".join(_words(asked)).endswith(" ".join(a)) and not re.search(r"[.!?]$", asked):
        return False, None
    if on_passage:
        return False, None
    if len(a) <= 3:
        return not (_ASKS_SHORT.search(asked) or title), None
    lines = [x for x in prose.split("\n") if x.strip()]
    if _ITEM.match(lines[-1]):
        items = [x for x in lines[:-1] if _ITEM.match(x)]
        if items and all(re.search(r"[.!?]$", x.rstrip()) for x in items):
            return True, None
        return False, None  # the others have no mark either
    return True, None


_PLACE = re.compile(r"([^\W_]+(?:['’][^\W_]+)*)(?=(\s*[^\w\s'’-])?(?:\s*([^\W_]+(?:['’][^\W_]+)*))?)")


def _ends(text: str, n: dict[str, list[int]]) -> None:
    """Adds to n, for each word of a text, how often it stands there and how often a phrase ends after it: before a mark,
    a word that may follow a phrase, or the end of a line."""
    for line in text.split("\n"):
        tokens = _PLACE.findall(line)
        for i, (w, mark, follows) in enumerate(tokens):
            w = w.lower().replace("’", "'")
            if not w.isalpha():
                w = re.sub(r"\d", "0", w)
            got = n.get(w)
            if got is None:
                got = n[w] = [0, 0]
            got[0] += 1
            if mark or i + 1 == len(tokens) or follows.lower() in _NEXT:
                got[1] += 1


def phrase_ends(texts: DataFrame, column: str) -> DataFrame:
    """item, n, closed over all different texts of a column: how often each word stands there, and at the end of a phrase.
    Counted in each batch, then summed. Null and empty texts hold no word."""

    def run(batches):
        for b in batches:
            n: dict[str, list[int]] = {}
            for t in b.column(0).to_pylist():
                _ends(_MARK.sub("", t), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())],
                names=["item", "n", "closed"],
            )

    once = texts.select(column).filter(F.length(column) > 0).distinct()
    return once.mapInArrow(run, "item string, n long, closed long").groupBy("item").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed"))


def chat_pairs(chats: DataFrame, dataset: str = "ultrachat_200k") -> DataFrame:
    """dataset, id, row, turn, question, answer, context (null) for each user message of each chat.

    The reply is the first assistant message after it and before the next user message, null without one. Null
    messages and roles are neither; null lists give no row. `row` is null, but for chats without an id a hash of
    their messages, which tells them apart.
    """
    role = lambda m: F.lower(F.trim(F.regexp_replace(m["role"], r"(?U)^\s+|\s+$", "")))
    kinds = F.transform("messages", lambda m: F.when(role(m).isin(*USER), "u").when(role(m).isin(*ASSISTANT), "a").otherwise("-"))
    row = F.when(F.col("id").isNull(), F.xxhash64("messages"))
    rows = spread(chats.select("id", "messages")).select("id", row.alias("row"), "messages", F.array_join(kinds, "").alias("kinds"))
    turn = rows.select("id", "row", "messages", "kinds", F.posexplode("messages").alias("turn", "message"))
    turn = turn.filter(F.expr("substring(kinds, turn + 1, 1) = 'u'"))
    # the roles up to the next user message, and the place of the first reply in them
    after = F.expr("substring_index(substring(kinds, turn + 2), 'u', 1)")
    place = F.instr(after, "a")
    return turn.select(
        F.lit(dataset).alias("dataset"), "id", "row", "turn", F.col("message.content").alias("question"),
        F.when(place > 0, F.get("messages", F.col("turn") + place)["content"]).alias("answer"), F.lit(None).cast("string").alias("context"),
    )


def question_pairs(rows: DataFrame, dataset: str = "spoken_squad") -> DataFrame:
    """dataset, id, row, turn 0, question, answer, context of each question on a passage; `row` as in chat_pairs."""
    one = spread(rows.select("id", "question", "answer_text", "context_text"))
    row = F.when(F.col("id").isNull(), F.xxhash64("question", "answer_text", "context_text"))
    return one.select(F.lit(dataset).alias("dataset"), "id", row.alias("row"), F.lit(0).alias("turn"), "question", F.col("answer_text").alias("answer"), F.col("context_text").alias("context"))


def defects(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """dataset, id, turn, defects (in the order in which they count) of every pair that has any.

    Pairs delivered again come out once; where the content under one id differs, its first defects by name count. Rows
    without an id stay apart by their content. `ends` is phrase_ends over the passages; only the pairs whose end is
    open are joined with it. A null or blank question is no defect; without it nothing is copied and no language is
    wrong. No text is shuffled: pairs are judged where they lie, and only their defects are brought together.
    """
    names = ["dataset", "id", "row", "turn"]

    def run(batches):
        for b in batches:
            at, found, look = [], [], []
            for i, (q, a, c) in enumerate(zip(*(b.column(x).to_pylist() for x in ("question", "answer", "context")), strict=True)):
                d, k = judge(q, a, c)
                if d or k:
                    at.append(i), found.append(d), look.append(k)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x).take(take) for x in names), pa.array(found, pa.list_(pa.string())), pa.array(look, pa.string())],
                names=[*names, "defects", "look"],
            )

    judged = pairs.select(*names, "question", "answer", "context")
    judged = judged.mapInArrow(run, "dataset string, id string, row long, turn int, defects array<string>, look string")
    # most rows have nothing to look up; without a key of their own they would all meet in one task
    key = F.coalesce("look", F.concat(F.lit("\0"), F.xxhash64("id", "row", "turn").cast("string")))
    told = judged.withColumn("key", key).join(ends.withColumnRenamed("item", "key"), "key", "left")
    cut = F.coalesce((F.col("closed") < LEAST_CLOSED * F.col("n")) & ~F.array_contains("defects", "truncated"), F.lit(False))
    all_ = told.select(*names, F.when(cut, F.array_append("defects", F.lit("truncated"))).otherwise(F.col("defects")).alias("defects"))
    return all_.filter(F.size("defects") > 0).groupBy(*names).agg(F.min("defects").alias("defects")).drop("row")
