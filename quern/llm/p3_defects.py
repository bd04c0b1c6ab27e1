"""Problem 3: defective answers in preference pairs.

Method: an answer is cut into clauses, and a linear-chain conditional random field tags each as answer, refusal, echo,
foreign or unfinished. The letters the tags cover are added up per answer and decide its defect. Emptiness is no matter of
clauses and is decided before.

The field is trained here. No pair is labelled, so labelled sequences are made from a bounded sample of the rows: answers
as they stand, prompts in place of answers, answers to prompts of other languages, answers cut off at a random place, and
phrases of refusal with and without courtesies around them. ``TRAINING_ROWS`` bounds the sample; it is drawn by hash over
the whole table. Tagging covers all rows and whole texts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.kernels import common_in_order

#: Most rows from which training sequences are made.
TRAINING_ROWS = 600
#: Made sequences of more clauses teach nothing that shorter ones do not, and are left out of training (never of tagging).
TRAINING_CLAUSES = 12
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
TAGS = 5

# Frequent words by language, for telling clauses in the Latin script apart.
FREQUENT = {
    "en": "the a an of and is was were that to in it its for with you your what her his we my they she he by at on then there so as this not cannot can i be have had from until who why how or if when more than please nobody no yes",
    "es": "el la los las de del que y en un una por con para se su ella él mi nadie es como cómo qué al lo no sí pero más muy cuando hasta sobre este esta eso esto fue había entre si yo me",
    "de": "der die das den dem des und ist ein eine einen im in zu mit auf nicht wie er sie es meine mein niemand aber von vom für war bei beim nach ich du wir wirklich als doch jemand warum oder ja nein ins dazu davon kann",
}
# Names of languages in prompts that ask for one, by the language named.
ASKED = {
    "en": ("english", "inglés", "ingles", "englisch", "영어", "英語"),
    "es": ("spanish", "español", "espanol", "spanisch", "스페인어", "スペイン語"),
    "de": ("german", "alemán", "aleman", "deutsch", "독일어", "ドイツ語"),
    "ko": ("korean", "coreano", "koreanisch", "한국어", "韓国語"),
    "ja": ("japanese", "japonés", "japones", "japanisch", "일본어", "日本語"),
}
_TRANSLATE = re.compile(r"translat|tradu[cz]|übersetz|ubersetz|번역|옮겨|訳|翻訳|\binto\b|answer in|responde en|antworte auf|로 답|で答え", re.I)
# What stands for nothing.
FILLERS = {
    "", "na", "nil", "none", "null", "nan", "empty", "blank", "todo", "tbd", "undefined", "noanswer", "noresponse", "assistant", "user", "system", "br", "nbsp", "placeholder",
    "없음", "해당없음", "내용없음", "답변없음", "なし", "特になし", "該当なし", "回答なし", "ninguno", "ninguna", "nada", "vacío", "sinrespuesta", "ningunarespuesta", "nichts", "keine", "leer", "keineantwort", "entfällt",
}
_MARKUP = re.compile(r"<[^<>]{0,60}>|&[a-z]{2,6};|```\w*")
_BARE = re.compile(r"[\W_]+")

_C = lambda p: re.compile(p, re.I)
_L = re.compile
# Cues of refusals, for lower-cased clauses. Each is one feature; the field learns what they weigh together.
CUES = {
    "unable": _L(
        r"\b(?:can(?:no|['’ ]?)t|cannot|could not|unable|won['’]?t|will not|not able|not allowed|do not allow|don['’]?t|do not|not possible|not permitted|not something (?:i|we)|nothing (?:i|we))\b|no (?:me es posible|puedo|podemos|puede|voy a|lo voy a|es posible|hay respuesta|debo|me permite|está permitid)"
        r"|(?:kann|darf|möchte|werde|schreibe|will)\b.{0,40}\bnicht|nicht (?:möglich|helfen|beantworten|erlaubt|behandle)|no (?:trato|tratamos|es algo que|es un tema)|kein thema|다루지 않|扱わない|扱いません|扱っていません|keine (?:auskunft|antwort)|없습니다|없어요|못하|못합니다|않을게요|않겠|안 돼요|어렵습니다|제한된|드릴 수 없|할 수 없|できません|できない|かねます|書けません|しません|答えられ|控え|いたしません|できかね"
    ),
    "speak": _L(
        r"\b(?:help|answer|respond|assist|discuss|comply|do that|write about|talk about|get into|provide|describe|discuss|cover)\b|ayudar|responder|escribir|describir|contestar|helfen|beantworten|erzählen|schreib|auskunft|antwort|주제|답|도와|드릴|쓰지|설명을 드리|話題|答え|書け|説明|お話し|回答|手伝|応じ"
    ),
    "decline": _L(r"\bdeclin|\brefus|\bdenied|\breject|pass on (?:this|that)|rather not|prefer not|rechaz|prefiero no|negarme|ablehn|lieber nicht|verweiger|거절|거부|사양|お断り|断り|拒否|遠慮"),
    "policy": _L(r"guideline|policy|policies|content rule|topics? i do not|language model|as an ai|\bnormas\b|política|directrices|modelo de lenguaje|richtlinie|sprachmodell|정책|지침|규정|언어 모델|인공지능|方針|ポリシー|規約|言語モデル|ガイドライン"),
    "sorry": _L(r"\bsorry\b|apologi|afraid|lo siento|disculpa|perdón|lamento|tut mir leid|entschuldig|leider|bedaure|죄송|미안|ごめん|すみません|申し訳|恐れ入り"),
    "elsewhere": _L(
        r"something else|anything else|another (?:question|topic|one)|send another|other question|different (?:question|topic)|otra cosa|otra pregunta|otro tema|etwas anderes|andere frage|anderes thema|다른 (?:것|이야기|질문|주제)|別の(?:質問|話|話題)|他の(?:質問|話)"
    ),
    "courtesy": _L(r"^\W*(?:thank you|thanks|gracias|danke|질문 고마|고마워|감사|ご質問ありがとう|ありがとう|good question|great question|buena pregunta|gute frage)"),
    "first": _L(r"\b(?:i|i['’](?:m|d|ll|ve)|my)\b|\b(?:yo|me|mis?|puedo|debo|prefiero|siento|voy)\b|\b(?:ich|mir|mich)\b|(?:습니다|어요|게요|네요|세요)\W*$|(?:ません|ます|ましょう)\W*$"),
    "no_first": _L(r"^\W*(?:no|nein|いいえ|いや|아니요?|안 돼요?)\b"),
    "quoted": re.compile(r"[\"“”„«»「『].{3,}[\"“”«»」』]"),
    "enough": _L(r"\benough\b|go wrong|dejar de|nichts falsch|slow start|la espera|die pause|말로 다|늦어서|言葉にできない|遅くなって|here is|aquí va|hier ist|시작할게요|始めます"),
}


def _by_script(pattern: re.Pattern[str]) -> tuple[re.Pattern[str] | None, re.Pattern[str] | None]:
    """The pattern without the alternatives that ASCII texts cannot match, and without those that need Latin letters."""
    parts, depth, start, text = [], 0, 0, pattern.pattern
    for i, c in enumerate(text):
        escaped = (i - len(text[:i].rstrip("\\"))) % 2 == 1
        if not escaped:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                parts.append(text[start:i])
                start = i + 1
    parts.append(text[start:])
    east = [bool(_EAST.search(x)) for x in parts]
    latin = [bool(re.search(r"[a-z]", re.sub(r"\\.", "", x))) for x in parts]
    made = lambda keep: _L("|".join(keep)) if keep else None
    return made([x for x, e, l in zip(parts, east, latin) if l or not e]), made([x for x, e, l in zip(parts, east, latin) if e or not l])


_EAST = re.compile(r"[\u3000-\u9fff\uac00-\ud7a3]")
_LATIN_LETTER = re.compile(r"[a-z\u00c0-\u024f]")
_SPLIT_CUES = {k: (p, p) if k == "quoted" else _by_script(p) for k, p in CUES.items()}  # quotation marks belong to no script


def cues(clause: str) -> dict[str, bool]:
    """Which cues a lower-cased clause holds; alternatives of scripts it does not have are not tried."""
    if clause.isascii():
        return {k: bool(p and p.search(clause)) for k, (p, _) in _SPLIT_CUES.items()}
    if not _LATIN_LETTER.search(clause):
        return {k: bool(p and p.search(clause)) for k, (_, p) in _SPLIT_CUES.items()}
    return {k: bool(p.search(clause)) for k, p in CUES.items()}


_LABEL = _C(r"^\W*(?:you asked|question|prompt|q|the question is|pregunta|preguntaste|frage|du fragtest|deine frage|질문|물음|質問|お尋ね)\s*[:：]")
_ITEM = re.compile(r"^\s*(?:[-*•‣・]|\d{1,3}[.)]|\(\d{1,3}\))\s*\S")
_MARKER = re.compile(r"\s*(?:[-*•‣・]|\(?\d{1,3}[.)])\s*")
_TRAILING = re.compile(r"(?:\.{2,}|…)\s*$")
_FIELD = re.compile(r"^\W{0,3}[^\W\d][\w .'’/-]{0,40}?[:：]\s*\S")
_CONTACT = re.compile(r"\S@\S|\(at\)|\d[\d ().\-]{6,}\d\W*$|様より\W*$|regards,|^\W*tel\b", re.I)
_SPLIT = re.compile(r"(?<=[.!?…。！？])(?=[\s\"'”’»)\]]*(?:\s|$))|(?<=[。！？])|\n+")
_END = ".!?。！？…"
_SMILE = re.compile(r"(?:\s*(?:[:;]-?[)(DP]|\^\^|[\U0001F300-\U0001FAFF☀-➿]️?))+\s*$")
_OPEN = re.compile(r"(?:[,、，;；:：(\[{“„«「『=+/]|\s[-–])\s*$")
_KANA, _HANGUL_RE, _HAN_RE = re.compile(r"[぀-ヿ]"), re.compile(r"[가-힣]"), re.compile(r"[一-鿿]")
_LATIN = re.compile(r"[a-zà-öø-ÿ]", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=128)  # a clause is asked for when it is cut, described and measured
def bare(text: str) -> str:
    return _BARE.sub("", text.casefold())


_OF_WORD: dict[str, tuple[str, ...]] = {}
for _l, _ws in FREQUENT.items():
    for _w in _ws.split():
        _OF_WORD[_w] = (*_OF_WORD.get(_w, ()), _l)


def language(text: str) -> str:
    """``ja``, ``ko``, ``en``, ``es``, ``de``, or an empty string where nothing tells."""
    kana, hangul, latin, han = 0, 0, 0, 0
    if not text.isascii():
        kana, hangul, han = len(_KANA.findall(text)), len(_HANGUL_RE.findall(text)), len(_HAN_RE.findall(text))
        latin = len(_LATIN.findall(text)) if kana + hangul + han else 0
    if kana + hangul + han and (kana + hangul + han) * 2 >= latin:
        return "ko" if hangul >= kana + han * (kana > 0) and hangul else "ja" if kana or han else ""
    low = text.casefold() if "ß" not in text else text.lower()
    votes = {"en": 0.0, "es": 0.0, "de": 0.0}
    for w in _WORD.findall(low):
        owners = _OF_WORD.get(w, ())
        for o in owners:
            votes[o] += 1.0 / len(owners)
    if not low.isascii():
        many = lambda marks: sum(map(low.count, marks))
        votes["es"] += 1.5 * many("¿¡ñ") + 0.3 * many("áéíóú")
        votes["de"] += 1.5 * low.count("ß") + 0.5 * many("äö") + 0.2 * low.count("ü")
    best = max(votes, key=lambda k: votes[k])
    rest = max(v for k, v in votes.items() if k != best)
    return best if votes[best] > rest and votes[best] >= 1 else ""


def expected(prompt: str) -> str:
    """Language the answer should have: the one the prompt asks for, else the prompt's own.

    The whole prompt is read; of several names of languages, the one nearest to a word of asking counts.
    """
    low = prompt.casefold()
    asked = [m.span() for m in _TRANSLATE.finditer(low)]
    if asked:
        near = [(max(0, m.start() - end, start - m.end()), m.start(), k) for k, names in ASKED.items() for n in names for m in re.finditer(re.escape(n), low) for start, end in asked]
        if near:
            return min(near)[2]
    return language(prompt)


def content(answer: str | None) -> str:
    return _MARKUP.sub(" ", answer or "")


def is_empty(answer: str | None) -> bool:
    """No content beyond spacing, punctuation, markup or a filler word."""
    return bare(content(answer)) in FILLERS or bare(answer or "") in FILLERS


def clauses(answer: str) -> list[str]:
    """Clauses with content, in order; a code block is one clause."""
    out = []
    for k, part in enumerate(answer.split("```")):
        if k % 2:  # inside a fence
            out.append(part)
            continue
        held = ""
        for piece in _SPLIT.split(part):
            if re.fullmatch(r"\s*\(?\d{1,3}[.)]?\s*", piece or ""):  # the number of a list item is no clause
                held += piece
                continue
            out.append(held + (piece or ""))
            held = ""
        if held:
            out.append(held)
    kept = [c for c in out if c and (bare(c) or _ITEM.match(c))]
    return kept or [answer]


@dataclass(frozen=True)
class Context:
    prompt: str
    letters: str
    words: frozenset[str]
    lang: str
    wanted: int

    @staticmethod
    def of(prompt: str | None) -> Context:
        p = prompt or ""
        m = re.search(r"\b([2-9]|1\d)\b(?= (?:things|cosas|dinge|items|steps))|([2-9])가지|([2-9])つ", p, re.I)
        wanted = int(next(g for g in m.groups() if g)) if m else 0
        return Context(p, bare(p), frozenset(_WORD.findall(p.casefold())), expected(p), wanted)


NAMES = (
    "bias", "first", "last", "only", "few", "own_language", "other_language", "no_language", "in_prompt", "much_of_prompt", "answer_in_prompt", "label", "ended", "open", "loose_end", "complete_form", "contact_form", "short_answer", "code_open", "short", "item", "few_items", "bare_marker", "trailing_off",
    *CUES, "unable_speak", "sorry_unable", "no_unable", "policy_or_decline", "cue_near",
)
_AT = {n: i for i, n in enumerate(NAMES)}


def features(ctx: Context, answer: str) -> tuple[list[str], np.ndarray]:
    parts = clauses(answer)
    n = len(parts)
    x = np.zeros((n, len(NAMES)), dtype=np.float32)
    whole = bare(content(answer))
    echo = 0.0
    if ctx.letters and len(whole) * 2 >= len(ctx.letters) and len(whole) <= 2.5 * len(ctx.letters):
        a, b = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4") for s in (whole, ctx.letters))
        echo = common_in_order(a, b) / len(a)
    items = sum(bool(_ITEM.match(c)) for c in parts)
    code_open = answer.count("```") % 2 == 1
    hits = [cues(c.lower()) for c in parts]
    for i, c in enumerate(parts):
        f = x[i]
        on = lambda name, value=1.0, f=f: f.__setitem__(_AT[name], value)
        on("bias")
        letters = bare(c)
        if i == 0:
            on("first")
        if n == 1:
            on("only")
        if n <= 3:
            on("few")
        lang = language(c)
        on("no_language" if not lang or not ctx.lang else "own_language" if lang == ctx.lang else "other_language")
        long_enough = len(letters) >= 8 or (len(ctx.letters) and len(letters) * 2 >= len(ctx.letters))
        labelled = bool(_LABEL.match(c))
        body = bare(_LABEL.sub("", c)) if labelled else letters
        if long_enough and body and body in ctx.letters:
            on("in_prompt")
        if len(body) * 10 >= 6 * len(ctx.letters) > 0 and ctx.letters in letters + letters:
            on("in_prompt")
        if ctx.letters and body in ctx.letters and len(body) * 2 >= len(ctx.letters):
            on("much_of_prompt")
        if echo >= 0.8:
            on("answer_in_prompt")
        if labelled:
            on("label")
        h = hits[i]
        for k, v in h.items():
            if v:
                on(k)
        if h["unable"] and h["speak"]:
            on("unable_speak")
        if h["sorry"] and h["unable"]:
            on("sorry_unable")
        if h["no_first"] and h["unable"]:
            on("no_unable")
        if h["policy"] or h["decline"]:
            on("policy_or_decline")
        if any(g["policy"] or g["decline"] or g["unable"] and g["speak"] for g in hits[max(0, i - 1) : i + 2]):
            on("cue_near")
        if len(letters) < 6:
            on("short")
        tail = _SMILE.sub("", c).rstrip().rstrip("\"'”’»)]』」）*_​﻿ ").rstrip()
        item = bool(_ITEM.match(c))
        if item:
            on("item")
        if i == n - 1 and n > 1 and _MARKER.fullmatch(c):  # the number of an item that is missing
            on("bare_marker")
        elif i == n - 1 and n > 1 and _TRAILING.search(tail):
            on("trailing_off")
        elif tail and tail[-1] in _END:
            on("ended")
        elif i == n - 1:
            on("last")
            cut = bool(_OPEN.search(_SMILE.sub("", c).rstrip("​﻿ ")))
            if cut:
                on("open")
            elif code_open:
                on("loose_end")
            elif n == 1 and len(letters) <= 12:
                on("short_answer")
            elif item or not _WORD.search(c):
                on("complete_form")
            else:
                on("contact_form" if _FIELD.match(c) or _CONTACT.search(c) else "loose_end")
        if code_open and i == n - 1:
            on("code_open")
        if ctx.wanted and items and items < ctx.wanted and i == n - 1:
            on("few_items")
    return parts, x


class Field:
    """Linear-chain conditional random field: weights of features by tag, of neighbouring tags, and of the first tag."""

    def __init__(self, w: np.ndarray, t: np.ndarray, s: np.ndarray):
        self.w, self.t, self.s = w, t, s

    @staticmethod
    def fit(data: list[tuple[np.ndarray, list[int]]], rounds: int = 120, rate: float = 0.2, decay: float = 2e-4) -> Field:
        """Gradient ascent (Adam) on the mean log likelihood, by scaled forward and backward products.

        Sequences stand in order of falling length, so at every place those that reach it come first. The products are small;
        plain loops spare the threads of a matrix library.
        """
        product = lambda a, b: np.einsum("ij,jk->ik", a, b)
        data = sorted(data, key=lambda d: -len(d[1]))
        size, longest = len(data), len(data[0][1])
        many = np.array([len(y) for _, y in data])
        upto = [int((many > l).sum()) for l in range(longest)]
        on = np.arange(longest) < many[:, None]
        x = np.concatenate([a for a, _ in data]).astype(np.float64)
        gold = np.zeros((size, longest, TAGS))
        gold[on] = np.eye(TAGS)[np.concatenate([y for _, y in data])]
        gold_w = product(x.T, gold[on])
        gold_t = np.einsum("nlj,nlk->jk", gold[:, :-1], gold[:, 1:])
        p = [np.zeros((x.shape[1], TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        e, a, b = np.ones((size, longest, TAGS)), np.zeros((size, longest, TAGS)), np.ones((size, longest, TAGS))
        c = np.ones((size, longest, 1))
        for step in range(1, rounds + 1):
            w, t, s = p
            u = product(x, w)
            e[on] = np.exp(u - u.max(axis=1, keepdims=True))
            turn = np.exp(t)
            for l, n in enumerate(upto):
                a[:n, l] = e[:n, l] * (product(a[:n, l - 1], turn) if l else np.exp(s - s.max()))
                c[:n, l] = a[:n, l].sum(axis=1, keepdims=True)
                a[:n, l] /= c[:n, l]
            both = np.zeros((TAGS, TAGS))
            for l in range(longest - 1, 0, -1):
                n = upto[l]
                after = e[:n, l] * b[:n, l] / c[:n, l]
                b[:n, l - 1] = product(after, turn.T)
                both += turn * product(a[:n, l - 1].T, after)
            prob = a * b
            grad = [(gold_w - product(x.T, prob[on])) / size - decay * w, (gold_t - both) / size - decay * t, (gold[:, 0] - prob[:, 0]).mean(0) - decay * s]
            for i, g in enumerate(grad):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p[i] = p[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        return Field(*p)

    def tag(self, x: np.ndarray) -> list[int]:
        """Best tag sequence of one answer."""
        u = x @ self.w
        score, back = u[0] + self.s, []
        for row in u[1:]:
            step = score[:, None] + self.t
            back.append(step.argmax(0))
            score = step.max(0) + row
        tags = [int(score.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


# Phrases of refusal, of turning elsewhere and of courtesy, for training sequences.
REFUSALS = {
    "en": ("I'm sorry, but I can't help with that.", "I cannot answer this question.", "I must decline this request.", "I am unable to assist with this request.", "My guidelines do not allow me to respond to this.", "I'd rather not get into that topic.", "Sorry, that is something I won't write about.", "As a language model, I cannot talk about this.", "No, I won't do that.", "Request denied: content policy.", "I have to pass on this one, sorry.", "That question falls under topics I do not cover.", "Apologies, that is not something I will describe."),
    "es": ("Lo siento, pero no puedo ayudarte con eso.", "No me es posible responder a esta pregunta.", "Debo rechazar esta petición.", "Disculpa, prefiero no describir eso.", "Por mis normas, aquí no hay respuesta.", "No, eso no lo voy a escribir.", "Como modelo de lenguaje, no puedo hablar de esto.", "Ese es un tema que no trato."),
    "de": ("Es tut mir leid, dabei kann ich nicht helfen.", "Diese Frage kann ich leider nicht beantworten.", "Das muss ich ablehnen.", "Entschuldigung, davon möchte ich nicht erzählen.", "Aus Gründen der Richtlinien gibt es hierzu keine Auskunft.", "Nein, das schreibe ich nicht.", "Als Sprachmodell kann ich darüber nicht sprechen.", "Das ist ein Thema, das ich nicht behandle."),
    "ko": ("죄송하지만 그 질문에는 답할 수 없습니다.", "그 부탁은 들어드릴 수 없어요.", "이 내용은 도와드릴 수 없습니다.", "미안하지만 설명을 드리지 못하겠네요.", "정책상 답변이 제한된 요청입니다.", "안 돼요, 그건 쓰지 않을게요.", "저는 언어 모델이라 이 이야기는 할 수 없습니다.", "그 요청은 거절하겠습니다.", "그 이야기는 제가 다루지 않는 주제입니다."),
    "ja": ("申し訳ありませんが、そのご質問にはお答えできません。", "その依頼はお断りします。", "すみません、それは書けません。", "ごめんなさい、説明はいたしかねます。", "方針により回答を控えます。", "いいえ、それはしません。", "私は言語モデルなので、お話しすることはできません。", "それは私が扱わない話題です。"),
}
ELSEWHERE = {
    "en": ("Please ask me something else.", "Is there anything else you would like to talk about?", "Feel free to send another."),
    "es": ("Mejor hablemos de otra cosa.", "Pregúntame otra cosa."),
    "de": ("Frag mich bitte etwas anderes.", "Lass uns lieber über etwas anderes reden."),
    "ko": ("다른 것을 물어봐 주세요.", "그 이야기 말고 다른 이야기를 해요."),
    "ja": ("別の質問をどうぞ。", "その話ではなく、別の話をしましょう。"),
}
COURTESY = {"en": "Thank you for asking.", "es": "Gracias por preguntar.", "de": "Danke für die Frage.", "ko": "질문 고마워요.", "ja": "ご質問ありがとう。"}
SAID = {"en": '"{}," the keeper said, yet it went on.', "es": "«{}», dijo la guardiana, pero siguió.", "de": "„{}“, sagte die Wärterin, doch es ging weiter.", "ko": '"{}" 하고 지기가 말했지만 이야기는 이어졌다.', "ja": "「{}」と番人は言ったが、話は続いた。"}
CLOSINGS = {
    "en": ("Kind regards, Rona Velt", "Contact: rona@mail.example", "Home: 12 Velt Street", "tel 555 0100 221"),
    "es": ("Firmado: Rona Velt", "Correo: rona@mail.example", "Tel.: 555 0100 221"),
    "de": ("Unterschrift: Rona Velt", "Kontakt: rona@mail.example", "Telefon 555 0100 221"),
    "ko": ("메일: rona@mail.example", "연락처 010-0000-1111", "주소: 강물시 돌길 12"),
    "ja": ("メール：rona@mail.example", "住所：川市石町1-2-3", "川石花子様より"),
}
LABELS = {"en": "You asked: ", "es": "Pregunta: ", "de": "Frage: ", "ko": "질문: ", "ja": "質問："}


def _seems_sound(ctx: Context, x: np.ndarray) -> bool:
    """Cautious: only such answers train the tag ``answer``."""
    on = lambda name: x[:, _AT[name]]
    cue = (on("policy_or_decline") + on("no_unable") + on("unable_speak") * (1 - on("quoted")) + on("elsewhere")).sum() > 0 and len(x) <= 3
    return not (cue or on("loose_end").any() or on("open").any() or on("bare_marker").any() or on("trailing_off").any() or on("code_open").any() or on("answer_in_prompt").any() or on("few_items").any() or on("other_language").mean() > 0.34 or on("courtesy").any())


def training_data(rows: list[tuple[str, str]], seed: int = 7) -> list[tuple[np.ndarray, list[int]]]:
    """Tagged sequences made from (prompt, answer) rows."""
    rng = random.Random(seed)
    sound: list[tuple[Context, str]] = []
    for prompt, answer in rows:
        if prompt and not is_empty(answer):
            ctx = Context.of(prompt)
            if _seems_sound(ctx, features(ctx, answer)[1]):
                sound.append((ctx, answer))
    data: list[tuple[np.ndarray, list[int]]] = []

    def put(ctx: Context, answer: str, tags: list[int] | int) -> None:
        parts, x = features(ctx, answer)
        y = [tags] * len(parts) if isinstance(tags, int) else tags
        if len(y) == len(parts) <= TRAINING_CLAUSES:
            data.append((x, y))

    for k, (ctx, answer) in enumerate(sound):
        x0 = features(ctx, answer)[1]
        # Sound answers may begin by repeating the prompt; those clauses are echoes all the same.
        repeats = (x0[:, _AT["in_prompt"]] + x0[:, _AT["much_of_prompt"]]) > 0
        if repeats.any():
            put(ctx, answer, [ECHO if r else ANSWER for r in repeats])
            continue
        put(ctx, answer, ANSWER)
        lang = ctx.lang or "en"
        if k % 2 == 0:
            words = [*([COURTESY[lang]] if rng.random() < 0.35 else []), rng.choice(REFUSALS[lang]), *([rng.choice(ELSEWHERE[lang])] if rng.random() < 0.5 else [])]
            put(ctx, " ".join(words), REFUSAL)
            if rng.random() < 0.15:  # a phrase of turning elsewhere may stand alone
                put(ctx, rng.choice(ELSEWHERE[lang]), REFUSAL)
        if k % 10 == 3:  # refusals that are only told of, and courtesies before an answer
            told = SAID[lang].format(rng.choice(REFUSALS[lang]).rstrip(".。!"))
            put(ctx, f"{told} {answer}" if lang != "ja" else told + answer, ANSWER)
        if k % 5 == 0:  # a line of address or signature ends without a mark
            put(ctx, answer.rstrip() + "\n" + rng.choice(CLOSINGS[lang]), ANSWER)
        if k % 10 == 7:
            put(ctx, COURTESY[lang] + " " + answer, ANSWER)
        if k % 2 == 1:
            label = LABELS[lang] if rng.random() < 0.4 else ""
            text = ctx.prompt.rstrip("?？.。") if rng.random() < 0.3 else ctx.prompt
            if rng.random() < 0.35:  # a small change: a word or a few letters less
                words = text.split(" ")
                if len(words) > 4:
                    del words[rng.randrange(len(words))]
                    text = " ".join(words)
                else:
                    at = rng.randrange(max(1, len(text) - 3))
                    text = text[:at] + text[at + 2 :]
            put(ctx, label + text, ECHO)
            own = clauses(answer)
            head = len(features(ctx, ctx.prompt)[0])
            if ctx.prompt.rstrip()[-1:] in _END:
                put(ctx, ctx.prompt + " " + answer, [ECHO] * head + [ANSWER] * len(own))
        if k % 3 == 0:
            other, text = rng.choice(sound)
            if other.lang and ctx.lang and other.lang != ctx.lang and language(text) not in ("", ctx.lang):
                put(ctx, text, FOREIGN)
        if k % 2 == 0:
            own = clauses(answer)
            last = own[-1].strip()
            if len(bare(last)) > 14 and not _ITEM.match(last) and len(own) <= 11:
                at = rng.randrange(2, max(6, len(last) - 3)) if rng.random() < 0.7 else rng.randrange(2, 8)
                stub = last[:at].rstrip()
                if rng.random() < 0.4 and stub and stub[-1] not in _END:
                    stub += rng.choice((",", " (", " “", ":", " -")) if lang in ("en", "es", "de") else rng.choice(("、", ",", "（", " (", "「"))
                # One short piece alone could as well be a short answer, so it teaches nothing.
                if stub and stub[-1] not in _END and (len(own) > 1 or len(bare(stub)) > 12 or _OPEN.search(stub)):
                    put(ctx, "\n".join([*(c.strip() for c in own[:-1]), stub]), [ANSWER] * (len(own) - 1) + [UNFINISHED])
            if k % 8 == 2 and 1 < len(own) <= 10:  # lists that end with the mark of an item, and answers that trail off
                if k % 16 == 2:
                    listed = "\n".join(f"{j}. {c.strip()}" for j, c in enumerate(own, 1)) + f"\n{len(own) + 1}. "
                else:
                    listed = "\n".join([*(c.strip() for c in own[:-1]), last[: max(2, len(last) // 4)].rstrip() + " ..."])
                many = len(clauses(listed))
                put(ctx, listed, [ANSWER] * (many - 1) + [UNFINISHED])
            if k % 16 == 0 and own and own[-1].rstrip()[-1:] in _END:
                put(ctx, "\n".join(c.strip() for c in own) + "\n```\nfor k in range(3):\n    run(", [ANSWER] * len(own) + [UNFINISHED])
    return data


DEFECTS = {REFUSAL: "refusal", ECHO: "echo", FOREIGN: "wrong_language", UNFINISHED: "truncated"}


def defect(field: Field, ctx: Context, answer: str | None) -> str | None:
    """The defect of one answer, or None. Letters covered by each tag decide; the last clause tells if it is unfinished."""
    if is_empty(answer):
        return "empty"
    parts, x = features(ctx, answer or "")
    tags = field.tag(x)
    size = [max(1, len(bare(c))) for c in parts]
    total = sum(size)
    cover = [sum(s for s, t in zip(size, tags) if t == k) / total for k in range(TAGS)]
    if cover[REFUSAL] > 0.5:
        return "refusal"
    if cover[ECHO] > 0.8:
        return "echo"
    if cover[FOREIGN] > 0.5:
        return "wrong_language"
    if tags[-1] == UNFINISHED:
        return "truncated"
    return None


def train(df: DataFrame, id_col: str, prompt_col: str, sides: tuple[str, ...], rows: int = TRAINING_ROWS) -> Field | None:
    """Fit the field on at most ``rows`` rows, drawn by hash over the whole table. None if no row can be used."""
    picked = df.select(prompt_col, *sides).orderBy(F.xxhash64(F.lit("train"), F.col(id_col)), id_col).limit(rows).collect()
    data = training_data([(r[0], a) for r in picked for a in r[1:] if r[0] and a])
    return Field.fit(data) if data else None


def found(df: DataFrame, id_col: str = "pair_id", prompt_col: str = "prompt", sides: tuple[str, ...] = ("chosen", "rejected"), field: Field | None = None) -> DataFrame:
    """``pair_id, side, defect``: one row for each defective answer.

    Defined cases: a null answer is empty; with a null or empty prompt nothing counts as echo or foreign; null ids are
    left out; rows sent twice are judged each; an empty table gives no rows; other columns are not carried, so names
    cannot clash; very long answers are tagged whole. Where several defects meet, empty, refusal, echo, wrong_language
    and truncated come first in this order.
    """
    field = field or train(df, id_col, prompt_col, sides)
    held = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            ids, names, kinds = [], [], []
            columns = [c.to_pylist() for c in batch.columns]
            for k, i in enumerate(columns[0]):
                ctx = Context.of(columns[1][k])
                for side, answers in zip(sides, columns[2:]):
                    kind = defect(model, ctx, answers[k]) if model else ("empty" if is_empty(answers[k]) else None)
                    if kind:
                        ids.append(i)
                        names.append(side)
                        kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(kinds, pa.string())], ["pair_id", "side", "defect"])

    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), prompt_col, *sides)
    return rows.mapInArrow(run, "pair_id long, side string, defect string")
