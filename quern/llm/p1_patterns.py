"""Detection of personal information in one text: typed, non-overlapping spans.

Detection runs on a copy of the text in which full-width characters, unusual dashes and spaces are replaced one for one,
so spans hold for the original. Every rule below names a written form, not a list of values.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

EMAIL, PHONE, ID_NUMBER, ADDRESS, PERSON = "email", "phone", "id_number", "address", "person_name"

_SAME = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x202F: 0x20, 0x2009: 0x20, 0x2007: 0x20}
_SAME |= {c: ord("-") for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212, 0xFF0D, 0x30FC - 0x1000)}
_SAME.pop(0xFF1A, None)  # a full-width colon after a label stays recognisable
_SAME.pop(0xFF0C, None)


_ANY = re.compile("[" + "".join(map(re.escape, map(chr, _SAME))) + "]")


def plain(text: str) -> str:
    if text.isascii() or not _ANY.search(text):
        return text
    return _ANY.sub(lambda m: chr(_SAME[ord(m[0])]), text)


# --- e-mail -----------------------------------------------------------------------------------------------------------
_AT = r"(?:\s{0,2}@\s{0,2}|\s{0,2}[(\[{<]\s?(?:at|arroba|ät)\s?[)\]}>]\s{0,2}|\s(?:at|arroba)\s(?=\S+\s?[(\[]?\s?(?:dot|punto|punkt)))"
_DOT = r"(?:\.|\s{0,2}[(\[{]\s?(?:dot|punto|punkt|\.)\s?[)\]}]\s{0,2}|\s(?:dot|punto|punkt)\s)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_])?{_AT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9\-]*[A-Za-z0-9]){{1,4}}", re.I)

# --- telephone --------------------------------------------------------------------------------------------------------
_EXT = r"(?:\s?(?:ext|extension|int|durchwahl|내선|内線)\.?\s?\d{1,5})?"
_PHONE = re.compile(
    r"(?<![0-9A-Za-z_+\-/.])(?:"
    r"\+\s?\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-/]?\d{2,5}){1,5}"  # international
    r"|(?:1[ .\-])?(?:\(\d{3}\)\s?|\d{3}[ .\-])\d{3}[ .\-]\d{4}"  # 3-3-4
    r"|01[016-9][ .\-]?\d{3,4}[ .\-]?\d{4}"
    r"|0[5789]0[ .\-]?\d{4}[ .\-]?\d{4}"
    r"|0[1-9](?:[ .\-]?\d{2}){4}"
    r"|07\d{3}[ .\-]?\d{3}[ .\-]?\d{3}"
    r"|[6789]\d{2}[ .\-]\d{3}[ .\-]\d{3}(?![ .\-]\d)"
    r"|\(0\d{1,4}\)[ /.\-]?\d{2,8}(?:[ \-]\d{2,6}){0,3}"
    r"|0\d{1,4}[ /\-]\d{3,8}(?:[ \-]\d{2,6}){0,3}"
    rf")(?![\d])(?!-\d){_EXT}",
    re.I,
)
_PHONE_CUE = re.compile(r"(?:tel(?:ephone|efon|éfono)?|phone|call|mobile|number is|text me|llama al|ruf|handy|전화(?:는|번호는?)?|연락처|휴대폰|電話(?:は|番号は?)?|携帯)\W{0,4}(\d{9,11})(?!\d)", re.I)

# --- identity numbers -------------------------------------------------------------------------------------------------
_RESIDENT = re.compile(r"(?<![\d\-])\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ \-]{0,3}[0-9]\d{6}(?![\d\-])")
_SOCIAL = re.compile(r"(?<![0-9A-Za-z_\-.])\d{3}([ \-.])\d{2}\1\d{4}(?![0-9A-Za-z_\-]|\.\d)")
_TWELVE = re.compile(r"(?<![0-9A-Za-z_\-.])\d{4}([ \-])\d{4}\1\d{4}(?![0-9A-Za-z_\-]|[ ]\d{4})")
_SPANISH = re.compile(r"(?<![0-9A-Za-z_.\-])(?:\d{1,2}\.\d{3}\.\d{3}|\d{7,8})[ \-]?[A-Z](?![\w])")
_FOREIGN = re.compile(r"(?<![0-9A-Za-z_.\-])[XYZ][ \-]?\d{7}[ \-]?[A-Z](?![\w])")
_ID_CUE = re.compile(
    r"(?:pass(?:port|aporte)?\b|reisepass|pasaporte|여권|旅券|パスポート|(?:personal)?ausweis|identity\s(?:card|number)|\bid\s?card|national\sid|\bid(?=\s(?:no|number))|\bssn\b|social\ssecurity"
    r"|seguridad\ssocial|sozialversicherung|\bdni\b|\bnie\b|documento|주민\s?(?:등록)?\s?번호|마이넘버|マイナンバー|個人番号|身分証|신분증)"
    r"(?:s?nummer|\s?card)?(?:\s?(?:number|nummer|número|no|nr|num|núm|n\.?º|#|번호|番号)\.?)?\s?(?:은|는|は|が|is|ist|es)?\s{0,2}[:：#]?\s{0,2}([A-Z0-9](?:[ .\-]?[A-Z0-9]){5,15})(?![A-Z0-9])",
    re.I,
)

# --- street addresses -------------------------------------------------------------------------------------------------
_UNIT = r"(?:,?\s{0,2}(?:apt|apartment|flat|unit|suite|no)\.?\s?#?\w{1,5})?"
_STREET = r"(?:St|Street|Ave|Avenue|Terrace|Close|Road|Rd|Lane|Ln|Drive|Court|Crescent|Boulevard|Blvd|Square|Row|Gardens|Way|Place)"
_GERMAN = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "damm", "ufer")
_ADDRESS = (
    re.compile(rf"(?<![\w.,\-])\d{{1,5}}[A-Za-z]?\s(?:[A-Z][\w'’\-]+\s){{1,3}}{_STREET}\b\.?{_UNIT}"),
    re.compile(rf"(?<![\w.,\-])\d{{1,5}}[A-Z]?\s(?:[A-Z'’\-]+\s){{1,3}}{_STREET.upper()}\b\.?{_UNIT.upper()}"),
    re.compile(rf"(?<![\w.,\-])\d{{1,5}}\s[a-z'’\-]+\s(?:st|street|ave|avenue|terrace|road|rd|close|lane)\b\.?(?=$|[\s,.](?:apt|flat|unit|in\s|at\s|$|[\w]+$)|,){_UNIT}"),
    re.compile(
        r"(?<!\w)(?:calle|c/|avenida|avda?\.|plaza|pza\.|paseo|camino|carrera|ronda|travesía)\s{0,2}(?!(?:estaba|está|era|es|fue|de|del|que|y)\s)[A-Za-zÁÉÍÓÚÜÑáéíóúüñ'’\-]+(?:\s[A-Za-zÁÉÍÓÚÜÑáéíóúüñ'’\-]+)?,?\s?(?:n\.?\s?[ºo°]\.?|núm\.?|número|#)?\s?\d{1,5}(?:,?\s\d{1,2}\.?[ºª]\s?\w?\b)?",
        re.I,
    ),
    re.compile(r"(?<!\w)[A-Za-zÄÖÜäöüß\-]{3,}(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer)\s?\d{1,4}\s?[a-z]?(?!\w)", re.I),
    re.compile(r"(?<!\w)[A-ZÄÖÜ][a-zäöüß]+er\s(?:Straße|Strasse|Str\.|Weg|Platz|Allee)\s\d{1,4}\s?[a-z]?(?!\w)"),
    re.compile(r"[가-힣]{1,6}(?:특별시|광역시|시|군|구|도|읍|면)\s?(?:[가-힣]{1,6}(?:구|동|읍|면)\s?)?[가-힣]{1,7}(?:로|길|대로)\s?\d{1,4}(?:번길)?(?:\s?\d{1,4}(?:-\d{1,4})?)?(?:,?\s?\d{1,4}동\s?\d{1,4}호)?"),
    re.compile(r"(?:주소|집은|소포는|사는 곳은?)\s?[:：]?\s?[가-힣]{1,7}(?:로|길|대로)\s?\d{1,4}(?:번길)?(?:\s?\d{1,4})?"),
    re.compile(r"[가-힣]{1,7}(?:로|길)\s?\d{1,4}번길\s?\d{1,4}"),
    re.compile(
        r"[぀-ヿ一-鿿々]{1,8}[都道府県市区郡町村][぀-ヿ一-鿿々]{0,9}?[0-9一二三四五六七八九十]{1,3}(?:丁目\s?[0-9一二三四五六七八九十]{1,3}(?:番地?|[\-－ー−の])[0-9一二三四五六七八九十]{1,3}号?|[\-－−][0-9]{1,3}(?:[\-－−][0-9]{1,3})?|番地?[0-9]{1,3}号?)"
    ),
)

#: Which texts a pattern is tried on: a cheap necessary condition on the lower-cased text.
_EN_NUMBER = re.compile(r"\d[a-z]?\s[a-z'’\-]+\s(?:[a-z'’\-]+\s){0,2}(?:st|ave|terrace|close|road|rd|lane|ln|drive|court|crescent|boulevard|blvd|square|row|gardens|way|place)")
_DE_NUMBER = re.compile(r"(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer)\s?\d")
_KO_NUMBER = re.compile(r"[로길]\s?\d")
_JA_NUMBER = re.compile(r"[0-9一二三四五六七八九十](?:丁目|[\-－−]|番)")
_ES_WORDS = ("calle", "c/", "avenida", "avda", "av.", "plaza", "pza", "paseo", "camino", "carrera", "ronda", "travesía")


def _address_patterns(t: str, low: str) -> Iterable[re.Pattern[str]]:
    if _EN_NUMBER.search(low):
        yield from _ADDRESS[:3]
    if any(w in low for w in _ES_WORDS):
        yield _ADDRESS[3]
    if any(w in low for w in _GERMAN) and _DE_NUMBER.search(low):
        yield from _ADDRESS[4:6]
    if not t.isascii():
        if _KO_NUMBER.search(t):
            yield from _ADDRESS[6:9]
        if _JA_NUMBER.search(t):
            yield _ADDRESS[9]


# --- names ------------------------------------------------------------------------------------------------------------
_UP = "A-ZÁÀÂÄÅÉÈÊËÍÎÏÓÔÖÚÛÜÑÇŠŽ"
_TOKEN = rf"(?:[{_UP}][\w'’]+(?:-[{_UP}][\w'’]+)?)"
_INITIAL = rf"(?:[{_UP}]\.)"
_NAME = rf"(?:{_TOKEN},\s(?:{_TOKEN}|{_INITIAL})(?:\s{_INITIAL})?|(?:{_TOKEN}|{_INITIAL})(?:\s{_INITIAL}){{0,2}}\s?{_TOKEN})"
#: (literal that must occur, lower case; pattern with the name in group 1)
_LEAD = {
    "my name is": r"my name is",
    "regards": r"(?:kind|best|warm)\s?regards,|regards,",
    "sincerely": r"sincerely,",
    "teacher": r"teacher:",
    "ask for": r"ask for",
    "given to": r"given to",
    "signed by": r"signed by:?",
    "me llamo": r"me llamo",
    "pregunta por": r"pregunta por",
    "luego vino": r"luego vino",
    "firmado": r"firmado(?: por)?:?",
    "profesor": r"profesora?:",
    "maestr": r"maestr[ao]:",
    "ich hei": r"ich hei(?:ß|ss)e",
    "unterschrift": r"unterschrift:",
    "später kam": r"später kam",
    "spater kam": r"spater kam",
    "bitte nach": r"frag(?:t|en sie)? bitte nach",
    "lehrer": r"lehrer(?:in)?:",
    "mr.": r"\bmr\.",
    "mrs.": r"\bmrs\.",
    "ms.": r"\bms\.",
    "dr.": r"\bdr\.",
    "prof.": r"\bprof\.",
    "herr": r"\bherrn?\b(?! und)",
    "frau": r"\bfrau\b",
    "señor": r"\bseñora?\b",
}
_LEADS = {k: re.compile(rf"(?i:{v})\s{{1,2}}({_NAME})(?![\w])") for k, v in _LEAD.items()}
_TAILS = {
    "signed the": re.compile(rf"(?<![\w])({_NAME})\s(?i:signed the\b)"),
    "came with": re.compile(rf"(?i:later)\s({_NAME})\s(?i:came with\b)"),
}
_LOWER_NAME = r"((?:[a-zà-ÿ][\w'’]*(?:-\w+)?|[a-z]\.)(?:\s[a-z]\.)?\s[a-zà-ÿ][\w'’]+(?:-\w+)?|[a-zà-ÿ][\w'’]+(?:-\w+)?,\s[a-zà-ÿ][\w'’]+)"
_LOWER_LEADS = {k: re.compile(rf"{v}\s{{1,2}}{_LOWER_NAME}(?![\w])") for k, v in _LEAD.items()}
_LOWER_TAIL = re.compile(rf"(?<![\w]){_LOWER_NAME}\s(?:signed the|came with)\b")
_HANGUL = (
    ("님께", re.compile(r"(?<![가-힣])([가-힣]{2,5})님께")),
    ("씨", re.compile(r"(?<![가-힣])([가-힣]{2,5})\s?씨(?:가|는|를|의|께|에게|와|도)")),
    ("담당자", re.compile(r"담당자는\s([가-힣]{2,5}?)(?:입니다|이에요|예요|이다)")),
    ("이름", re.compile(r"(?:제|내|저의|그의)?\s?이름은\s([가-힣]{2,5}?)(?:입니다|이에요|예요|이다|이고)")),
    ("이름", re.compile(r"(?:이름|성명|선생님|담임)\s?[:：]\s?([가-힣]{2,5})(?![가-힣])")),
)
_KANJI = r"([一-鿿々]{1,4}[ 　]?[一-鿿々぀-ゟ]{1,4}?)"
_HAN = (
    ("さん", re.compile(rf"(?:(?<![一-鿿々])|(?<=[0-9]号)){_KANJI}\s?さん(?:に|が|は|の|へ|と|を|から)")),
    ("様", re.compile(rf"(?:(?<![一-鿿々])|(?<=[0-9]号)){_KANJI}\s?様(?:より|へ|に|から|の)")),
    ("担当", re.compile(rf"担当は\s?{_KANJI}\s?(?:です|だ|である)")),
    ("名前", re.compile(rf"名前は\s?{_KANJI}\s?(?:です|だ|である|と)")),
    ("氏名", re.compile(rf"(?:氏名|名前|署名|担任)\s?[:：]\s?{_KANJI}(?![一-鿿々぀-ゟ])")),
)
# Words that stand where a name could, and entries of name lists that are ordinary words.
NOT_HANGUL = {"선생", "고객", "부모", "손님", "할머", "할아버", "어머", "아버", "담당자", "교수", "원장", "사장", "여러분", "모두", "하느", "아저", "아가", "누나", "할머니"}
NOT_HAN = {"先生", "皆", "皆様", "お客", "客", "祖母", "友人", "店長", "担当者", "姉", "母", "父", "誰", "奥", "神"}
ORDINARY = {"wren", "sage", "ember", "hazel"}
NOT_NAME = {
    "the", "a", "an", "it", "we", "she", "he", "they", "you", "i", "her", "his", "nobody", "grandmother", "what", "is", "please", "run", "el", "la", "los", "las", "un", "una", "él", "ella", "nadie",
    "mi", "der", "die", "das", "ein", "eine", "er", "sie", "niemand", "wie", "ist", "meine", "this", "that", "street", "museum", "canal", "day",
}


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    norm: str
    gender: str | None = None


class Names:
    """Known parts of names, incomplete; used besides the contexts above."""

    def __init__(self, rows: Iterable[tuple[str | None, str | None, str | None]] = ()):
        self.family: set[str] = set()
        self.given: set[str] = set()
        scripts: dict[tuple[str, str], set[str]] = {}
        for text, kind, script in rows:
            if text and kind:
                (self.family if kind == "family" else self.given).add(text.casefold())
                scripts.setdefault((script or "", kind), set()).add(text)
        alt = lambda key: "|".join(re.escape(x) for x in sorted(scripts.get(key, ()), key=lambda x: (-len(x), x)))
        self.latin_family = tuple(x.casefold() for x in scripts.get(("latin", "family"), ()))
        self.latin_given = tuple(x.casefold() for x in scripts.get(("latin", "given"), ()) if x.casefold() not in ORDINARY)
        fam = alt(("latin", "family"))
        self.by_family = re.compile(rf"(?<![\w.@\-])((?:{_TOKEN}|{_INITIAL})(?:\s{_INITIAL})?\s(?i:{fam})|(?i:{fam}),\s(?:{_TOKEN}|{_INITIAL})(?:\s{_INITIAL})?)(?![\w@]|\.\w|-\w)") if fam else None
        self.lower_family = re.compile(rf"(?<![\w.@\-])([a-z]+(?:\s[a-z]\.)?\s(?:{fam.lower()})|(?:{fam.lower()}),\s[a-z]+)(?![\w@]|\.\w|-\w)") if fam else None
        given = "|".join(re.escape(x) for x in sorted(scripts.get(("latin", "given"), ()), key=lambda x: (-len(x), x)) if x.casefold() not in ORDINARY)
        self.by_given = re.compile(rf"(?<![\w.@\-])((?:{given})(?:\s{_INITIAL})?\s{_TOKEN})(?![\w@]|\.\w)") if given else None
        f, g = alt(("hangul", "family")), alt(("hangul", "given"))
        self.hangul = re.compile(rf"(?<![가-힣])((?:{f})(?:{g}))(?=님|씨|\s씨|은|는|이|가|을|를|에게|께|와|과|의|예요|입니다|[^가-힣]|$)") if f and g else None
        f, g = alt(("han", "family")), alt(("han", "given"))
        self.han = re.compile(rf"((?:{f})[ 　]?(?:{g}))") if f and g else None

    def spans(self, text: str) -> Iterable[tuple[int, int]]:
        low = text.casefold() if not text.isascii() else text.lower()
        same = len(low) == len(text)
        for key, pattern in _LEADS.items():
            if key in low:
                for m in pattern.finditer(text):
                    if self._shape(m[1]):
                        yield m.span(1)
                if same:
                    for m in _LOWER_LEADS[key].finditer(text):
                        if self._known(m[1]):
                            yield m.span(1)
        for key, pattern in _TAILS.items():
            if key in low:
                for m in pattern.finditer(text):
                    if self._shape(m[1]):
                        yield m.span(1)
                for m in _LOWER_TAIL.finditer(text):
                    if self._known(m[1]):
                        yield m.span(1)
        if any(f in low for f in self.latin_family):
            for pattern in (self.by_family, self.lower_family):
                for m in pattern.finditer(text) if pattern else ():
                    if pattern is self.lower_family or self._shape(m[1]):
                        yield m.span(1)
        if self.by_given and any(g in low for g in self.latin_given) and not text.isupper():
            for m in self.by_given.finditer(text):
                if self._shape(m[1]):
                    yield m.span(1)
        if not text.isascii():
            for key, pattern in _HANGUL:
                if key in text:
                    for m in pattern.finditer(text):
                        if m[1] not in NOT_HANGUL and m[1].casefold() not in self.given and not m[1].endswith(("선생", "할머", "부모")):
                            yield m.span(1)
            for key, pattern in _HAN:
                if key in text:
                    for m in pattern.finditer(text):
                        if m[1] not in NOT_HAN and m[1] not in self.given and len(m[1].replace(" ", "")) >= 3:
                            yield m.span(1)
            for pattern in (self.hangul, self.han):
                if pattern:
                    for m in pattern.finditer(text):
                        yield m.span(1)

    def _known(self, name: str) -> bool:
        return any(t.strip(".,") in self.family for t in name.casefold().split()) or name.casefold().split(",")[0] in self.family

    def _shape(self, name: str) -> bool:
        parts = [p.strip(",").casefold() for p in name.split()]
        return len(parts) >= 2 and not any(p in NOT_NAME for p in parts) and any(len(p.strip(".")) > 1 for p in parts)


_KEEP_DIGITS = re.compile(r"\D")
_BARE = re.compile(r"[\W_]+")
_NUMBER = re.compile(r"\d[\d ().\-/]{5,}\d")
_ID_WORDS = ("pass", "ausweis", "card", "ssn", "social", "seguridad", "dni", "nie", "document", "주민", "여권", "신분", "マイナンバー", "個人番号", "旅券", "身分証", "national id", "identity", "id n")
_LETTERED = re.compile(r"\d[ \-]?[A-Z](?![A-Za-z])")
_DIGIT = re.compile(r"\d")


# Titles before a name that state a gender.
_TITLE = re.compile(r"(?i)\b(?:(mr|sir|herrn?|lehrer|señor|sr|don|profesor|maestro)|(mrs|ms|miss|madam|frau|lehrerin|señora|señorita|sra|srta|doña|profesora|maestra))\b[.:]?\s{0,2}$")
# Calling codes, and whether numbers of the country begin with a trunk zero at home.
CALLING = {"82": True, "81": True, "49": True, "44": True, "33": True, "34": False, "1": False}


def title_gender(before: str) -> str | None:
    """Gender stated by the title that ends a text, if one does."""
    m = _TITLE.search(before)
    return None if not m else "m" if m[1] else "f"


def calling_code(surface: str, digits: str) -> str:
    """The calling code that a written telephone number begins with, or nothing."""
    if surface.lstrip().startswith("+"):
        return next((c for c in CALLING if digits.startswith(c)), "")
    return "1" if len(digits) == 11 and digits.startswith("1") else ""


def phone_norm(surface: str, digits: str) -> str:
    """Digits as dialled at home, so that a number with and without its calling code is one entity."""
    code = calling_code(surface, digits)
    rest = digits[len(code) :]
    return "0" + rest if code and CALLING[code] and not rest.startswith("0") else rest


def person_norm(name: str) -> str:
    """Given name first, so that both orders and all cases are one entity."""
    family, comma, given = name.partition(",")
    ordered = f"{given.strip()} {family}" if comma else name
    return " ".join(_BARE.sub(" ", ordered.casefold()).split())


def same_person(norms: set[str]) -> dict[str, str]:
    """Names with an initial for a given name, by the one full name of the same text they can stand for."""
    full = {n for n in norms if len(n.split()[0]) > 1}
    out = {}
    for n in norms - full:
        first, *_, last = n.split()
        fits = [f for f in full if " " in f and f.startswith(first) and f.split()[-1] == last] if " " in n else []
        if len(fits) == 1:
            out[n] = fits[0]
    return out


def detect(text: str, names: Names) -> list[Span]:
    """Non-overlapping spans of one text, in order. E-mail wins over id number, phone, address and name, in that order."""
    if not text:
        return []
    t = plain(text)
    low = t.lower()
    found: list[Span] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, kind: str, norm: str, gender: str | None = None) -> None:
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            found.append(Span(a, b, kind, norm, gender))

    if "@" in t or "(at)" in low or "[at]" in low or " at " in low and "dot" in low or "arroba" in low or "(at" in low:
        for m in _EMAIL.finditer(t):
            norm = re.sub(r"\s?[(\[{<]\s?(?:at|arroba|ät)\s?[)\]}>]\s?|\s(?:at|arroba)\s", "@", re.sub(r"\s?[(\[{]\s?(?:dot|punto|punkt|\.)\s?[)\]}]\s?|\s(?:dot|punto|punkt)\s", ".", m[0].lower()))
            add(*m.span(), EMAIL, re.sub(r"\s", "", norm))
    if _DIGIT.search(t):
        number = bool(_NUMBER.search(t))
        if any(w in low for w in _ID_WORDS):
            for m in _ID_CUE.finditer(t):
                if sum(c.isdigit() for c in m[1]) >= 5:
                    value = m[1]
                    k = len(value)
                    # A value ends where ordinary words begin ("1234567 again").
                    tail = re.search(r"[ .\-](?=[A-Za-z]+$)", value)
                    if tail and not re.search(r"\d", value[tail.start() :]) and len(value) - tail.end() > 1:
                        k = tail.start()
                    a = m.start(1)
                    add(a, a + k, ID_NUMBER, _BARE.sub("", value[:k].upper()))
        if number:
            for pattern in (_RESIDENT, _SOCIAL, _TWELVE):
                for m in pattern.finditer(t):
                    add(*m.span(), ID_NUMBER, _KEEP_DIGITS.sub("", m[0]))
        if _LETTERED.search(t):
            for pattern in (_SPANISH, _FOREIGN):
                for m in pattern.finditer(t):
                    add(*m.span(), ID_NUMBER, _BARE.sub("", m[0]))
        if number or "+" in t:
            for m in _PHONE.finditer(t):
                core = re.split(r"(?i)ext|int|durch|내선|内線", m[0])[0]
                digits = _KEEP_DIGITS.sub("", core)
                if 9 <= len(digits) <= 15:
                    add(*m.span(), PHONE, phone_norm(core, digits))
            for m in _PHONE_CUE.finditer(t):
                add(*m.span(1), PHONE, phone_norm(m[1], m[1]))
        for pattern in _address_patterns(t, low):
            for m in pattern.finditer(t):
                add(*m.span(), ADDRESS, _BARE.sub(" ", m[0].casefold()).strip())
    for a, b in names.spans(t):
        add(a, b, PERSON, person_norm(t[a:b]), title_gender(t[max(0, a - 16) : a]))
    alias = same_person({s.norm for s in found if s.kind == PERSON})
    if alias:
        found = [replace(s, norm=alias.get(s.norm, s.norm)) if s.kind == PERSON else s for s in found]
    return sorted(found, key=lambda s: s.start)
