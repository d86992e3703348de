"""Personal data in free text: detection and keyed surrogates.

Each occurrence is replaced by a placeholder that names its kind and carries a
surrogate: a made-up value of the same type and gender. Its parts are a keyed
function of the entity, so one entity has the same ones everywhere; they are
written in the notation of each mention (case, order, initials, separators,
spelled digits, script, check digits). Entities whose surrogates would collide
with each other or with an entity of the corpus are given further ones until
all are distinct.
"""

from __future__ import annotations

import hashlib
import hmac
import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wildloom.operators.skew import lookup_join
from wildloom.session import c, columns_or_fail, fresh, stored, stored_counting

KINDS = ("email", "phone", "id_number", "address", "name")

# Common given names, by the gender they are mostly given to.
FEMALE = """Aisha Alice Amara Amelia Amina Ana Andrea Angela Anita Anna Astrid Beatriz Berta Camille Carla Carmen Caroline Catherine Chiara Chloe Clara
Claire Claudia Diana Dora Elena Elisa Elizabeth Emma Esther Eva Fatima Fiona Frida Gabriela Giulia Greta Hannah Helen Helena Ida Ines Ingrid Irene Isabel
Jana Jane Jennifer Jessica Judith Julia Karen Katarina Laura Leila Lena Linda Lucia Lucy Maria Marie Marta Martha Mary Mei Mia Monica Nadia Natalia Nina
Nora Olga Olivia Patricia Paula Petra Priya Rachel Rebecca Rosa Ruth Sara Sarah Sofia Sophie Susan Teresa Ursula Valentina Vera Victoria Yasmin Yuki Zainab""".split()
MALE = """Ahmed Alan Alejandro Alexander Ali Andrei Andrew Anton Antonio Arthur Benjamin Bruno Carlos Charles Chidi Christian Daniel David Diego Dmitri Edward
Emil Enrique Erik Felix Fernando Francois Frank Fritz George Goran Gustav Hans Harold Hassan Henrik Henry Hiroshi Hugo Ibrahim Igor Ivan Jack Jakob James Jan
Javier John Jonas Jorge Jose Juan Karl Kevin Klaus Kwame Lars Leon Lucas Luis Marco Mark Martin Mateo Michael Miguel Mohammed Nikolai Oleg Omar Oscar Otto
Pablo Patrick Paul Pavel Pedro Peter Philip Pierre Rafael Rajesh Richard Robert Samuel Sanjay Sebastian Sergei Simon Stefan Thomas Tomas Viktor Walter Wei William""".split()
GENDER = {n: "f" for n in FEMALE} | {n: "m" for n in MALE}
_GIVEN_UP = {n.upper(): n for n in GENDER}

# Words that stand before a comma and a given name without being a family name.
GREETINGS = set("""Thanks Thank Hi Hello Hey Dear Cheers Sorry Well Yes No Also Congrats Congratulations Regards So And But Then Now Ok Okay Welcome Ask Poor Only
Both Like With From For To In On At By The This That My Our Your His Her Their Which When Where While If As Is Are Was Mr Mrs Ms Dr Prof Best Kind Later Still
However Otherwise Instead Today Yesterday Tomorrow Monday Tuesday Wednesday Thursday Friday Saturday Sunday Plaza Calle Avenida You We They She He It Danke Merci Gracias Hola Bonjour Hallo""".split())
# Words after a given name that make it the name of a place or thing.
THINGS = set("""Street St Road Avenue Lane Station County Airport University Conference Centre Center River Lake Island Islands Day Days Index Parser Branch School Bridge
College Park Hill Bay Beach Square Prize Award Theorem Lemma Foundation Institute Hospital Museum Hotel Library Server Project Protocol Database Engine Compiler Language The And Or
Is Was Has Had Will Would Can Could Did Does Said Says Told Wrote Writes Asked Thinks In On At Of For From To With By Not But If So As It He She They We You I Sure Not Has Without Give
Version Moderators Nobody Somebody Our My There There's This That If Wildcards What Compare People Does Then When While In As Their These Those How Why Who Where Which Also And
January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Quelqu'un Nous Wir Das Der Die Le La El""".split())
_STOP_UP = {w.upper() for w in THINGS | GREETINGS}

_BLANKS = dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " ")
_LOOKS = _BLANKS | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2212: "-"}
_GONE = re.compile("&(?:amp;)?#?\\w{1,8};|[\u00ad\u200b-\u200f\u2060\ufeff]")


def clean_view(text: str) -> tuple[str, list[tuple[int, int]] | None]:
    """Text with references decoded, invisible signs left out and unusual blanks, dashes and wide signs made plain.

    With it come (place in the view, place in the text) of each piece taken
    over as it is, or None where places are the same.
    """
    if "&" not in text and text.isascii():
        return text, None
    if not _GONE.search(text):
        return text.translate(_LOOKS), None
    out, marks, at, n = [], [], 0, 0
    for m in _GONE.finditer(text):
        if m.start() > at:
            marks.append((n, at))
            out.append(text[at : m.start()])
            n += m.start() - at
        s = html.unescape(html.unescape(m.group())) if m.group()[0] == "&" else ""
        if s:
            marks.append((n, m.start()))
            out.append(s)
            n += len(s)
        at = m.end()
    marks.append((n, at))
    out.append(text[at:])
    return "".join(out).translate(_LOOKS), marks


def _place(marks: list[tuple[int, int]] | None, i: int, end: bool = False) -> int:
    if marks is None:
        return i
    k = bisect_right(marks, (i - 1 if end else i, 1 << 60)) - 1
    view, raw = marks[max(0, k)]
    if not end:
        return raw + (i - view)
    # a decoded reference is longer in the text than in the view: an end within it goes to where the next piece begins
    spot = raw + (i - view)
    if k + 1 < len(marks) and marks[k + 1][0] <= i:
        return max(spot, marks[k + 1][1]) if marks[k + 1][0] == i and marks[k + 1][1] - raw > i - view and i - view <= 2 else spot
    return spot


# --- mail addresses ---
_TLD = r"[A-Za-z]{2,12}\b"
_LOCAL = r"[A-Za-z0-9](?:[\w.+%\-]{0,62}[\w+])?"
_MAIL = re.compile(rf"(?<![\w.+\-/@])(?:{_LOCAL})\s?@\s?(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{{0,61}}[A-Za-z0-9])?\.)+{_TLD}", re.A)
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|Dot|punkt|punto|point|\.)\s?[\])}]\s?|\s(?:dot|DOT|Dot|punkt|punto)\s)"
_WORD_DOT = r"(?:\s?[\[({]\s?(?:dot|DOT|Dot|punkt|punto|point|\.)\s?[\])}]\s?|\s(?:dot|DOT|Dot|punkt|punto)\s)"
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|At|@|ät|arroba)\s?[\])}>]\s?|\s?@\s?)"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
_MAIL2 = re.compile(rf"(?<![\w.+\-/@]){_LOCAL}{_AT}{_HOST}(?:{_DOT}{_HOST})*{_DOT}{_TLD}", re.A)
_MAIL3 = re.compile(rf"(?<![\w.+\-/@]){_LOCAL}\s(?:at|AT|At|arroba)\s{_HOST}(?:{_DOT}{_HOST})*{_WORD_DOT}{_HOST}(?:{_DOT}{_HOST})*", re.A)
_MAIL4 = re.compile(rf"(?<![\w.+\-/@])(?:[A-Za-z0-9]+[._+\-][\w.+\-]*\w|[A-Za-z]+\d+)\s(?:at|AT|At|arroba)\s{_HOST}(?:\.{_HOST})*\.{_TLD}", re.A)

# --- numbers issued to a person ---
_CUE_ID = re.compile(
    r"(?:\bSSN\b|social[ -]security(?: (?:number|no\.?|nr\.?|#))?|\bpassport(?: (?:number|no\.?|nr\.?|#))?|\bpass(?:nummer|-?nr\.?)|reisepass(?:nummer|-?nr\.?)?|driv(?:er'?s?|er’s|ing) licen[cs]e(?: (?:number|no\.?))?"
    r"|licen[cs]e (?:number|no\.?)|national (?:id|identity|insurance)(?: (?:card|number|no\.?))*|\bNI (?:number|no\.?)|\bNINO\b|\bIBAN\b|bank account(?: (?:number|no\.?))?|\b(?:bank )?account (?:number|no\.?)|\bDNI\b|\bNIE\b|\bNIF\b"
    r"|tax (?:id|number|payer id)(?: (?:number|no\.?))?|\bTIN\b|steuer-?id(?:entifikationsnummer)?\.?|steuernummer|sozialversicherungsnummer|personalausweis(?:nummer)?|ausweis(?:nummer|-?nr\.?)|identity card(?: (?:number|no\.?))?|\bID card(?: (?:number|no\.?))?"
    r"|numéro de sécurité sociale|carte d['’]identité|credit card(?: (?:number|no\.?))?|debit card(?: (?:number|no\.?))?|kontonummer|konto-?nr\.?|social insurance(?: (?:number|no\.?))?|\bSIN\b|\bCURP\b|\bPESEL\b|health card(?: (?:number|no\.?))?)",
    re.I,
)
_JOIN = re.compile(r"(?:\s*(?:\bis\b|\bwas\b|[:#=,(]|\bno\.?|\bnumber\b|\bnr\.?|nº|n\.º|\bthe\b|-)){0,4}\s*[\"'`*_]{0,3}", re.I)
_ID_VALUE = re.compile(r"(?=[A-Z0-9 ./\-]*\d)(?:[A-Z]{0,4}[ -]?)(?:[A-Z]{0,4}\d[A-Z0-9]*)(?:[ \-./]{1,2}(?:[A-Z]{0,4}\d[A-Z0-9]*|TEST|[A-Z](?![A-Za-z])))*")
_ID_SHAPES = re.compile(
    r"(?<![\w\-.])(?:\d{3}-\d{2}-\d{4}(?![\w-])|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)"
    r"|[0-9XYZ]\d{7}-[A-Z](?!\w)|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?![\w-]))"
)

# --- telephone numbers ---
_NUMERIC = re.compile(r"(?<![\w.,/\-#%+:@=&])(?:\+|00|\()?\d(?:[ ]?[().\-/ ]?[ ]?[(]?\d){6,17}(?!\d)(?![,:]\d|-?\w|\.\d|/\d|%)")
_NANP = re.compile(r"(?:(?:\+?1|001)[ .\-]?)?(?:\([2-9]\d\d\)[ .\-]?|[2-9]\d\d([ .\-]?))[2-9]\d\d[ .\-]?\d{4}")
_INTL = re.compile(r"(?:\+|00 ?)[1-9]\d{0,2}(?:[ .\-/]?(?:\(0\))?[ .\-/]?\(?\d{1,5}\)?){2,6}")
_TRUNK = re.compile(r"\(?0[1-9]\d{0,4}\)?(?:[ .\-/]{1,2}\d{2,8}){1,5}|0[1-9]\d{8,9}")
_CUE_TEL = re.compile(r"(?:\btel(?:\.|:|ephone|efon|éfono)?|\bphone|\bmobile|\bcell|\bfax|whats ?app|\bcall(?: me| us)?(?: on| at)?|my number(?: is)?|\brang from|ring me|text me|\bhandy|rufnummer|\bsignal:|voicemail)\W{0,12}$", re.I)
# The words for digits.
_DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "oh", "double", "triple")
_SPELT = re.compile(r"\b(?:(?:" + "|".join(_DIGITS) + r"|\d{1,4})[\s,.\-]{1,3}){5,14}(?:" + "|".join(_DIGITS[:10]) + r"|\d{1,4})\b", re.I)

# --- street addresses ---
_EN_TYPES = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Way|Close|Drive|Dr|Boulevard|Blvd|Square|Sq|Terrace|Place|Pl|Crescent|Row|Gardens|Grove|Parkway|Pkwy|Walk|Mews|Alley|Circle|Highway|Hwy|Trail)"
_EN = re.compile(rf"(?<![\w.,\-/$€£])\d{{1,5}}[A-Za-z]?,?\s+(?:[A-Z][\w'’\-]*\s+){{1,4}}{_EN_TYPES}\b\.?(?:,?\s*(?:Apt|Unit|Suite|Flat|#)\.?\s*#?\w{{1,5}})?", re.I)
_EN_CASED = re.compile(rf"\d{{1,5}}[A-Za-z]?,?\s+(?:[A-Z][\w'’\-]*\s+){{1,4}}{_EN_TYPES}\b")
_EN_AFTER = re.compile(rf"\b(?:[A-Z][\w'’\-]+\s+){{1,3}}(?:Street|Road|Lane|Avenue|Court|Close|Drive|Square)\s(?:No\.?\s|Nr\.?\s|number\s|#)\d{{1,5}}\b")
_DE = re.compile(r"\b[A-ZÄÖÜ][\wÄÖÜäöüß\-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|damm|ufer|chaussee|steig|promenade|STRASSE|STRAẞE|STR\.|WEG|ALLEE|GASSE|PLATZ|DAMM|UFER)\s+\d{1,4}\s?[a-zA-Z]?\b|\b(?:[A-ZÄÖÜ][\wäöüß]+(?:er|es)?[ \-])(?:Straße|Strasse|Str\.|Weg|Allee|Gasse|Platz|Damm|Ufer)\s+\d{1,4}\s?[a-z]?\b|\b(?:Am|Im|An der|An den|Auf der|Auf dem|Unter den|Zum|Zur)\s[A-ZÄÖÜ][\wäöüß]+\s\d{1,4}[a-z]?,?\s+\d{5}\b")
_FR = re.compile(r"(?<![\w.,\-/])\d{1,4}(?:\s?(?:bis|ter|quater|[A-D]))?,?\s+(?:rue|avenue|av\.|boulevard|bd\.?|place|chemin|allée|impasse|quai|cours|route|passage|square|sentier|ruelle)\s+(?:de la |de l['’]|du |des |de |d['’]|aux? |la |le |les )?[A-ZÀ-Ý0-9][\wÀ-ÿ'’\-]+", re.I)
_ES = re.compile(r"\b(?:Calle|C/|Plaza|Avenida|Avda\.?|Paseo|Camino|Carrer|Ronda|Travesía|Callejón|Glorieta)\s+(?:(?:del|de la|de los|de las|de|la|el|los|las)\s+)?(?:[A-ZÀ-Ý][\wÀ-ÿ'’\-]*(?:\s+(?:de(?:l| la| los)?\s+)?)?){1,4},?\s*(?:n\.?\s?[º°o]\.?\s?|núm\.?\s?|#)?\s?\d{1,4}\b", re.I)
_DE_HEAD = re.compile(r"(?:[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Ww]eg|[Aa]llee|[Gg]asse|[Pp]latz|[Dd]amm|[Uu]fer|haussee|steig|romenade|STRASSE|STRAẞE|STR\.|WEG|ALLEE|GASSE|PLATZ|DAMM|UFER)\s+\d|(?:Am|Im|An de[rn]|Auf de[rm]|Unter den|Zu[mr])\s[A-ZÄÖÜ][\wäöüß]+\s\d")

# --- names ---
# Words beside which two capitalised words are a person's name although the first is not in the lists above.
_CUES = r"(?:met|meet|asked|ask|emailed|contact|named|called|calls (?:him|her)self|[Mm]y name is|(?:I am|I['’]m),?|[Dd]ear|[Rr]egards,?|[Ss]incerely,?|[Cc]heers,?|told|tell|hired|interviewed|married|sued|thank|colleague|friend|boss|brother|sister|husband|wife|neighbour|neighbor|professor|teacher|founder|author|written by|signed,?|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)"
# Second words of the names of products, firms and places.
_NO_FAMILY = frozenset("News Studio Code Cloud Web Data Overflow Hat States Kingdom City Valley Francisco Angeles York Zealand Africa America Korea Europe Office Team Support Group Systems Labs Software Search Maps Mail Drive Store Play Pro Plus Core Linux Windows Script Java Python Cup Games Times Post Journal Press Bank Union Party House Court Police Army Navy".split())
_AFTER = r"(?:said|says|wrote|writes|told|asked|replied|replies|answered|lives in|lived in|was born|has died|passed away|(?:and (?:his|her|their) (?:wife|husband|son|daughter|brother|sister)))"
_PAIR = r"(?P<given>[A-ZÀ-Þ][a-zß-ÿ]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?)\s(?:[A-Z]\.\s)?(?P<family>(?:(?:van|von|de|der|den|del|della|di|da|dos|la|le|bin|al|el|ter)\s){0,2}(?:O['’]|Mc|Mac)?[A-ZÀ-Þ][a-zß-ÿ]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?)(?![\w'’]*[\w(@/]|['’]\w)"
_TWO = re.compile(r"[A-ZÀ-Þ][a-zß-ÿ]+(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?\s(?:[A-Z]\.\s)?(?:[a-z]{2,5}\s){0,2}(?:O['’])?[A-ZÀ-Þ][a-zß-ÿ]")
_CUED = re.compile(rf"\b{_CUES}\s{_PAIR}")
_CUED_AFTER = re.compile(rf"(?<![\w@./#&\-]){_PAIR}(?=\s{_AFTER}\b)")
# The endings of most family names in Russian, Ukrainian, Belarusian and Bulgarian.
_CYRILLIC = re.compile(r"\b[А-ЯЁІЇЄ][а-яёіїє]+\s(?:[А-ЯЁІЇЄ](?:\.|[а-яё]+(?:вич|вна|ична))\s?)?[А-ЯЁІЇЄ][а-яёіїє]*(?:ов|ев|ёв|ин|ын|ова|ева|ёва|ина|ына|ский|ская|цкий|цкая|ской|енко|чук|щук|ьев|ьева|ук|юк|ян|дзе|швили)\b")
_CAPS = re.compile(r"[A-ZÀ-Ý][\w'’]+")
_WRAP = r"(?:[*_`~']{1,3}|\}|</\w{1,6}>)?"
_OPEN = r"(?:[*_`~']{1,3}|\\[a-z]{2,8}\{|<\w{1,6}>)?"
_PART = r"(?:(?:van|von|de|der|den|del|della|di|da|dos|la|le|bin|al|el|ter|Van|Von|De|Del|Di|Da|La|Le|El|Al)[ -]){0,2}"
_FAMILY = re.compile(rf"{_WRAP}\s{{1,2}}(?:(?:[A-ZÀ-Ý]\.\s?){{1,2}}|(?:(?P<second>[A-ZÀ-Ý][a-zß-ÿ]+)\s))?{_OPEN}(?P<family>{_PART}(?:O['’]|Mc|Mac)?[A-ZÀ-Ý][\wÀ-ÿ]+(?:-[A-ZÀ-Ý][\wÀ-ÿ]+)?)")
_FAMILY_UP = re.compile(rf"{_WRAP}\s{{1,2}}(?:[A-Z]\.\s)?{_OPEN}(?P<family>[A-ZÀ-Ý][A-ZÀ-Ýß]{{2,}}(?:-[A-ZÀ-Ý]+)?)\b")
_BEFORE = re.compile(rf"(?P<family>(?:O['’]|Mc|Mac)?[A-ZÀ-Ý][\wÀ-ÿ]+(?:-[A-ZÀ-Ý][\wÀ-ÿ]+)?){_WRAP},\s{_OPEN}$")
_TITLES = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s)$")

Span = tuple[int, int, str]


# Words without which a text, in lower case, holds no street; they only spare searches.
_EN_WORDS = frozenset("street st road rd lane ln avenue ave court ct way close drive dr boulevard blvd square sq terrace place pl crescent row gardens grove parkway pkwy walk mews alley circle highway hwy trail".split())
_FR_WORDS = frozenset("rue avenue av boulevard bd place chemin allée impasse quai cours route passage square sentier ruelle".split())
_ES_WORDS = frozenset("calle plaza avenida avda paseo camino carrer ronda travesía callejón glorieta".split())
_DE_WORDS = ("traße ", "trasse ", "straẞe ", "str. ", "weg ", "allee ", "gasse ", "platz ", "damm ", "ufer ", "chaussee ", "steig ", "promenade ", " am ", " im ", " an de", " auf de", "unter den ", "zum ", "zur ")
_HEAD = re.compile(r"\d[A-Za-z]?,?\s+[A-Z]")
_RUN = re.compile(r"\d(?:[ ().\-/]{0,3}\d){6}")
_SIX = re.compile(r"\d(?:[ ./\-]{0,2}[A-Z]{0,4}[ ./\-]{0,1}\d){5}")
_SHAPE = re.compile(r"\d[\d -]{7}|[A-Z]\d{2}|[A-Z]{2} \d")


def _mails(v: str, low: str) -> Iterator[Span]:
    if "@" in v:
        for m in _MAIL.finditer(v):
            yield m.start(), m.end(), "email"
        for m in _MAIL2.finditer(v):
            yield m.start(), m.end(), "email"
    elif "(at" in low or "[at" in low or "{at" in low or "<at" in low or "( at" in low or "[ at" in low or "arroba" in low or "ät" in low:
        for m in _MAIL2.finditer(v):
            yield m.start(), m.end(), "email"
    if " at " in low or " arroba " in low:
        if "dot" in low or "punto" in low or "punkt" in low:
            for m in _MAIL3.finditer(v):
                yield m.start(), m.end(), "email"
        for m in _MAIL4.finditer(v):
            yield m.start(), m.end(), "email"


def _identities(v: str, low: str) -> Iterator[Span]:
    for m in _CUE_ID.finditer(v) if _SIX.search(v) else ():
        j = _JOIN.match(v, m.end())
        x = _ID_VALUE.match(v, j.end())
        if x and 6 <= sum(ch.isdigit() for ch in x.group()) <= 34:
            yield x.start(), x.start() + len(x.group().rstrip(" .-/")), "id_number"
    for m in _ID_SHAPES.finditer(v) if _SHAPE.search(v) else ():
        if m.group(1) is None or _luhn(m.group()):
            yield m.start(), m.end(), "id_number"


def _luhn(s: str) -> bool:
    d = [int(x) for x in s if x.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def _phones(v: str, low: str) -> Iterator[Span]:
    for m in _NUMERIC.finditer(v) if _RUN.search(v) else ():
        s = m.group().rstrip(" (./-")
        n = sum(ch.isdigit() for ch in s)
        if not 7 <= n <= 15:
            continue
        good = _NANP.fullmatch(s) or (n >= 8 and _INTL.fullmatch(s)) or (9 <= n <= 12 and _TRUNK.fullmatch(s)) or _CUE_TEL.search(v, max(0, m.start() - 28), m.start())
        if good:
            yield m.start(), m.start() + len(s), "phone"
    if sum(w in low for w in _DIGITS) > 1:
        for m in _SPELT.finditer(v):
            words = re.findall(r"[a-z]+", m.group().lower())
            digits = sum(w in _DIGITS[:11] for w in words) + sum(map(len, re.findall(r"\d+", m.group())))
            extra = words.count("double") + 2 * words.count("triple")
            if len(words) >= 3 and 7 <= digits + extra <= 15:
                yield m.start(), m.end(), "phone"


def _words(low: str) -> frozenset[str]:
    return frozenset(low.replace(",", " ").replace(".", " ").replace("<", " ").split())


def _addresses(v: str, low: str) -> Iterator[Span]:
    words = _words(low)
    if not words.isdisjoint(_EN_WORDS):
        for h in _HEAD.finditer(v):
            begin = h.start()
            while begin and v[begin - 1].isdigit():
                begin -= 1
            m = _EN.match(v, begin)
            if m and (_EN_CASED.match(m.group()) or m.group().isupper()):
                yield m.start(), m.end(), "address"
        if "#" in v or "no" in words or "nr" in words or "number" in words:
            for m in _EN_AFTER.finditer(v):
                yield m.start(), m.end(), "address"
    if any(w in low for w in _DE_WORDS) and _DE_HEAD.search(v):
        for m in _DE.finditer(v):
            yield m.start(), m.end(), "address"
    if not words.isdisjoint(_FR_WORDS):
        for m in _FR.finditer(v):
            yield m.start(), m.end(), "address"
    if not words.isdisjoint(_ES_WORDS) or "c/" in low:
        for m in _ES.finditer(v):
            yield m.start(), m.end(), "address"


def _is_family(w: str, upper: bool = False) -> bool:
    base = w.split(" ")[-1].split("-")[0]
    if upper:
        return len(base) > 2 and base not in _STOP_UP and base not in _GIVEN_UP
    return len(base) > 1 and base not in THINGS and base not in GENDER and not base.isupper()


_NO_FOLD = str.maketrans("øØłŁđĐıßæÆ", "oOlLdDisaA")


@lru_cache(maxsize=100_000)
def plain_letters(w: str) -> str:
    """Without accents, so that José is looked up as Jose."""
    if w.isascii():
        return w
    return "".join(x for x in unicodedata.normalize("NFKD", w.translate(_NO_FOLD)) if not unicodedata.combining(x))


# The words of the cues, without one of which a text has none; they only spare searches.
_BEFORE_WORDS = frozenset("met meet asked ask emailed contact named called calls name i i'm i’m dear regards sincerely cheers told tell hired interviewed married sued thank colleague friend boss brother sister husband wife neighbour neighbor professor teacher founder author written signed mr mrs ms dr prof".split())
_AFTER_WORDS = frozenset("said says wrote writes told asked replied replies answered lives lived born died passed wife husband son daughter brother sister".split())


def _cued_names(v: str, low: str) -> Iterator[Span]:
    words = _words(low)
    for p, needed in ((_CUED, _BEFORE_WORDS), (_CUED_AFTER, _AFTER_WORDS)):
        for m in p.finditer(v) if not words.isdisjoint(needed) and _TWO.search(v) else ():
            given, family = m["given"], m["family"]
            if given in THINGS or given in GREETINGS or family in GREETINGS or (family in _NO_FAMILY and plain_letters(given) not in GENDER):
                continue
            # a word that makes places is a family name only after a known given name
            if family in THINGS and plain_letters(given) not in GENDER:
                continue
            yield m.start("given"), m.end("family"), "name"


def _names(v: str, low: str) -> Iterator[Span]:
    yield from _cued_names(v, low)
    if not v.isascii():
        for m in _CYRILLIC.finditer(v):
            yield m.start(), m.end(), "name"
    for m in _CAPS.finditer(v):
        w = plain_letters(m.group())
        if len(w) != len(m.group()):
            w = m.group()
        if w.endswith(("'s", "’s")):
            w = w[:-2]
        upper = w not in GENDER and len(w) > 2 and w in _GIVEN_UP
        if w not in GENDER and not upper:
            continue
        if m.start() and v[m.start() - 1] in "@./#-+&=\\" or (m.end() < len(v) and v[m.end()] in "@/+="):
            continue
        end = m.start() + len(w)
        f = (_FAMILY_UP if upper else _FAMILY).match(v, end)
        if f and not (not upper and f["second"] and f["second"] not in GENDER):
            if _is_family(f["family"], upper) and not (upper and re.search(r"\b(?:THE|AN?)\s$", v[: m.start()][-5:])):
                stop = f.end() - (2 if f["family"].endswith(("'s", "’s")) else 0)
                yield m.start(), stop, "name"
                continue
        elif f and not upper and f["second"] and _is_family(f["second"]):
            yield m.start(), f.end("second"), "name"
            continue
        b = _BEFORE.search(v, max(0, m.start() - 48), m.start())
        if b and not _TITLES.search(v[: b.start()]) and b["family"] not in GREETINGS and (b["family"].isupper() == upper) and _is_family(b["family"], upper):
            yield b.start(), end, "name"


def find_spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity as written in the clean view), in order and without overlaps.

    Of overlapping finds the earlier kind in KINDS wins, but a number issued to
    a person wins over a telephone number. Null and empty texts have none.
    """
    if not text:
        return []
    v, marks = clean_view(text)
    low = v.lower()
    spans: list[Span] = []
    taken: list[tuple[int, int]] = []
    for finder in (_mails, _identities, _phones, _addresses, _names):
        for a, b, kind in finder(v, low):
            if not any(a < y and x < b for x, y in taken):
                spans.append((a, b, kind))
                taken.append((a, b))
    spans.sort()
    return [(_place(marks, a), _place(marks, b, True), kind, v[a:b]) for a, b, kind in spans]


def canonical(kind: str, entity: str) -> str:
    """One spelling for all notations of an entity, so that they get one surrogate."""
    s = unicodedata.normalize("NFKC", entity).lower()
    if kind == "email":
        s = re.sub(r"\s*[\[({<]\s*(?:at|@|ät|arroba)\s*[\])}>]\s*|\s+(?:at|arroba)\s+", "@", s)
        return re.sub(r"\s+", "", re.sub(_WORD_DOT, ".", s))
    if kind == "phone":
        if re.search(r"[a-z]{3}", s):
            out, times = [], 1
            for w in re.findall(r"[a-z]+|\d", s):
                if w in ("double", "triple"):
                    times = 2 if w == "double" else 3
                elif w.isdigit() or w in _DIGITS:
                    out.append((w if w.isdigit() else str(_DIGITS.index(w) % 10)) * times)
                    times = 1
            s = "".join(out)
        digits = re.sub(r"\D", "", s.replace("(0)", ""))
        return digits.removeprefix("00").removeprefix("1") if len(digits) > 10 and digits.startswith(("001", "1")) else digits.removeprefix("00")
    if kind == "id_number":
        return re.sub(r"[^a-z0-9]", "", s)
    if kind == "name":
        s = re.sub(r"[*_`~'\\{}]|</?\w+>|\b(?:emph|textbf|texttt|textit)\b", "", s)
        if "," in s:
            family, _, given = s.partition(",")
            s = f"{given.strip()} {family.strip()}"
        return re.sub(r"\s+", " ", re.sub(r"\b\w\.\s?", "", s)).strip()
    return re.sub(r"\s+", " ", s).strip(" .,")


_ONSETS = ("b", "br", "d", "f", "g", "gr", "h", "k", "kl", "l", "m", "n", "p", "pr", "r", "s", "st", "t", "tr", "v")
_VOWELS = ("a", "e", "i", "o", "u", "ai", "ea", "ou")
_CODAS = ("l", "m", "n", "r", "s", "th", "nd", "rk")


class Draw:
    """A stream of choices that depends only on the key, the entity and the attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.kind, self.entity, self.attempt = key, kind, entity, attempt
        self.label, self.n = f"{kind}\x00{entity}\x00{attempt}".encode(), 0
        self.pool = b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.label + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def of(self, xs):
        return xs[self.below(len(xs))]

    def word(self, syllables: int) -> str:
        """Longer after some attempts, so that there are words enough for any number of entities."""
        return "".join(self.of(_ONSETS) + self.of(_VOWELS) for _ in range(syllables + self.attempt // 4)) + self.of(_CODAS)

    def more(self, entity: str) -> str:
        """A number with digits for what stands before it after some attempts."""
        return "0" * (self.attempt // 4) + entity


#: The last letter of Spanish identity numbers by remainder, and Cyrillic and Greek letters for the Latin ones of made-up words. Fixed values.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
_CYR = dict(zip("abcdefghijklmnopqrstuvwxyz", "абкдефгхийклмнопкрстуввхыз", strict=True))
_GRK = dict(zip("abcdefghijklmnopqrstuvwxyz", "αβκδεφγχιικλμνοπκρστυβωξυζ", strict=True))
# Parts of an address that say what it is and stay.
_STAY = frozenset("""st street rd road ln lane ave avenue ct court way close dr drive blvd boulevard sq square ter terrace pl place cres crescent row gardens grove pkwy parkway walk mews alley circle hwy highway trail
apt unit suite flat no nr number rue av bd chemin allée impasse quai cours route passage sentier ruelle bis quater calle plaza avenida avda paseo camino carrer ronda travesía callejón glorieta via viale piazza corso vicolo núm
de la le les los las el del du des da di d l aux au a à am im an der den auf dem unter den zum zur straße strasse str weg allee gasse platz damm ufer chaussee steig promenade c""".split())
_COMPOUND = re.compile(r"(?i)(.+?)(straße|strasse|straẞe|str|weg|allee|gasse|platz|damm|ufer|chaussee|steig|promenade)$")


def gender_of(given: str) -> str:
    """f or m: by the list, else by the ending."""
    g = plain_letters(given).capitalize()
    if g in GENDER:
        return GENDER[g]
    return "f" if re.search(r"(?i)(?:a|ie|ine|elle|ette|а|я)$", given) else "m"


def _cased(word: str, like: str) -> str:
    """``word`` in the case of ``like``."""
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word.capitalize() if like[:1].isupper() else word.lower()


def _scripted(word: str, like: str) -> str:
    first = next((x for x in like if x.isalpha()), "a")
    name = unicodedata.name(first, "LATIN")
    table = _CYR if name.startswith("CYRILLIC") else _GRK if name.startswith("GREEK") else None
    return "".join(table.get(x, x) for x in word.lower()) if table else word


def _filled(form: str, signs: str) -> str:
    """The letters and digits of ``form`` replaced by ``signs`` from the right; what ``signs`` do not reach stays."""
    spots = [i for i, x in enumerate(form) if x.isalnum()]
    out = list(form)
    for i, x in zip(spots[::-1], signs[::-1], strict=False):
        out[i] = x.upper() if form[i].isupper() else x
    return _before(out, spots, signs)


def _before(out: list[str], spots: list[int], signs: str) -> str:
    """``out`` with the signs for which there is no spot before its first one."""
    if spots and len(signs) > len(spots):
        out[spots[0]] = signs[: len(signs) - len(spots)] + out[spots[0]]
    return "".join(out)


def _luhn_digit(digits: str) -> str:
    return next(x for x in "0123456789" if _luhn(digits + x))


def _phone(d: Draw, entity: str, form: str) -> str:
    # the country code and a trunk zero stay; the first digits of American areas and exchanges are not 0 or 1
    head = 2 if len(entity) > 10 else 1 if entity.startswith("0") else 0
    new = entity[:head]
    entity = d.more(entity) if not head else entity + "0" * (d.attempt // 4)
    for i in range(head, len(entity)):
        new += str(2 + d.below(8)) if len(entity) == 10 and i in (0, 3) else str(1 + d.below(9)) if i == head else str(d.below(10))
    if re.search(r"[A-Za-z]{3}", form):
        gap = re.search(r"(?i)[a-z\d]([\s,.\-]{1,3})[a-z\d]", form)
        words = [_DIGITS[int(x)] for x in new]
        return _cased(words[0], form.split()[0]) + "".join((gap.group(1) if gap else " ") + w for w in words[1:])
    plain = form.replace("(0)", "(\x00)")
    spots = [i for i, x in enumerate(plain) if x.isdigit()]
    out = list(plain)
    for i, x in zip(spots[::-1], new[::-1], strict=False):
        out[i] = x
    return _before(out, spots, new).replace("\x00", "0")


def _number(d: Draw, entity: str, form: str) -> str:
    digits = "".join(x for x in entity if x.isdigit())
    iban = re.fullmatch(r"[a-z]{2}\d{2}[a-z0-9]{11,30}", entity)
    dni = re.fullmatch(r"[\dxyz]\d{7}[a-z]", entity)
    new = "".join(str(d.below(10)) if x.isdigit() else chr(97 + d.below(26)) for x in entity)
    if iban:
        body, land = new[4:], entity[:2]
        value = int("".join(str(int(x, 36)) for x in body + land + "00"))
        new = f"{land}{98 - value % 97:02d}{body}"
    elif dni:
        lead = entity[0] if entity[0].isalpha() else new[0]
        n = int(str("xyz".find(lead)) if lead.isalpha() else lead) * 10_000_000 + int(new[1:8])
        new = f"{lead}{new[1:8]}{_DNI[n % 23].lower()}"
    elif digits == entity and 12 < len(digits) < 20 and _luhn(digits):
        new = entity[0] + new[1:-1]
        new += _luhn_digit(new)
    else:
        new = "".join(str(d.below(10)) for _ in d.more("")) + new
    return _filled(form, new)


def _mail(d: Draw, entity: str, form: str) -> str:
    cut = re.compile(rf"({_AT}|{_WORD_DOT}|\s(?:at|AT|At|arroba)\s|[@._+%\-\s])")
    tokens = [x for x in re.split(r"[@._+%\-]", entity) if x]
    new = ["".join(str(d.below(10)) for _ in t) if t.isdigit() else d.word(1 if len(t) < 4 else 2) for t in tokens]
    new[-1] = "invalid"
    parts = [p for p in cut.split(form) if p]
    places = [i for i, p in enumerate(parts) if not cut.fullmatch(p)]
    if len(places) != len(new):
        at = entity.partition("@")[0]
        n = len([x for x in re.split(r"[._+%\-]", at) if x])
        return ".".join(new[:n]) + "@" + ".".join(new[n:])
    for i, w in zip(places, new, strict=True):
        parts[i] = _cased(w, parts[i])
    return "".join(parts)


def _address(d: Draw, entity: str, form: str) -> str:
    made: dict[str, str] = {}

    def one(m: re.Match) -> str:
        w = m.group()
        low = unicodedata.normalize("NFKC", w).lower()
        if low in _STAY or (len(low) == 1 and not low.isdigit()):
            return w
        if low not in made:
            # the words and numbers of the entity are drawn in its own order, whatever the mention looks like
            made[low] = "".join(str(1 + d.below(9)) if i == 0 else str(d.below(10)) for i in range(len(low))) if low.isdigit() else d.word(2)
        if low.isdigit():
            return made[low]
        tail = _COMPOUND.fullmatch(w)
        return _cased(made[low], tail.group(1) if tail else w) + (tail.group(2) if tail else "")

    words = re.compile(r"\d+|[^\W\d_]+")
    words.sub(one, entity)
    return words.sub(one, form)


def _person(d: Draw, entity: str, form: str) -> str:
    parts = entity.split(" ")
    pool = FEMALE if gender_of(parts[0]) == "f" else MALE
    first = [d.of(pool) for _ in range(2)]
    family = [d.word(2) + d.of(("", "son", "berg", "well", "ski")) for _ in range(3)]
    initial = chr(65 + d.below(26))
    head, comma, tail = form.partition(",")
    given_part, family_part = (tail, head) if comma else ("", form)
    cyrillic = bool(re.search(r"[А-Яа-яЁё]", form))
    if cyrillic and gender_of(parts[0]) == "f":
        family = [x.rstrip("aeiou") + "ova" for x in family]
    elif cyrillic:
        family = [x.rstrip("aeiou") + "ov" for x in family]
    particle = re.compile(_PART + r"\Z")
    used = [0, 0]

    def given(m: re.Match) -> str:
        w = m.group()
        if len(w) == 1:
            return _scripted(initial, w)
        used[0] += 1
        return _cased(_scripted(first[(used[0] - 1) % 2], w), w)

    def surname(m: re.Match) -> str:
        w = m.group()
        if len(w) == 1:
            return _scripted(initial, w) if w.isupper() else w
        if particle.fullmatch(w + " "):
            return w
        used[1] += 1
        return _cased(_scripted(family[(used[1] - 1) % 3], w), w)

    word = re.compile(r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))*")
    mark = re.compile(r"\\[a-z]+\{|</?\w+>")
    marks = mark.findall(form)
    if marks:
        form = mark.sub("", form).replace("}", "")
        return _person(Draw(d.key, d.kind, d.entity, d.attempt), entity, form)
    if comma:
        return word.sub(surname, family_part) + comma + word.sub(given, given_part)
    names = list(word.finditer(form))
    # of several names before the last one all but particles are given names
    lead = next((i for i, m in enumerate(names) if i and particle.fullmatch(m.group() + " ")), None)
    split = names[lead].start() if lead else max((m.start() for m in names[1:] if form[m.start() - 1] != "-"), default=len(form))
    return word.sub(given, form[:split]) + word.sub(surname, form[split:])


_RENDER = {"email": _mail, "phone": _phone, "id_number": _number, "address": _address, "name": _person}


def surrogate(key: bytes, kind: str, entity: str, form: str, attempt: int = 0) -> str:
    """The made-up value of a canonical entity, written as ``form`` is.

    What is drawn depends on key, kind, entity and attempt only, so all
    mentions of an entity have the same parts; with the entity itself as the
    form it is the canonical surrogate.
    """
    return _RENDER[kind](Draw(key, kind, entity, attempt), entity, form)


MENTION = "array<struct<start:int,stop:int,kind:string,entity:string,form:string>>"


def detect(df: DataFrame, text: str, out: str = "mentions") -> DataFrame:
    """``df`` with the mentions in ``text``: start, stop (code points), kind, entity (canonical) and form."""
    columns_or_fail(df, text)

    @F.pandas_udf(MENTION)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "stop": b, "kind": k, "entity": canonical(k, f), "form": f} for a, b, k, f in find_spans(t)])

    return df.withColumn(out, run(c(text)))


def surrogates(mentions: DataFrame, secret: bytes) -> DataFrame:
    """kind, entity, attempt, surrogate: distinct canonical surrogates for distinct entities of a kind, none of them an entity itself.

    ``mentions`` has kind and entity. In each round the entities whose
    surrogate is an entity of the corpus, or is shared with one before them
    (fewer attempts, then by entity), draw again.
    """
    made = F.pandas_udf(lambda k, e, a: pd.Series([surrogate(secret, *x[:2], x[1], x[2]).lower() for x in zip(k, e, a, strict=True)], dtype=object), "string")
    entities = stored(mentions.select("kind", "entity").distinct(), "entities")
    real = entities.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
    s = entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", made("kind", "entity", "attempt"))
    while True:
        s = stored(s, "surrogates")
        place = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "entity"))
        ranked = s.withColumn("place", place).join(real, ["kind", "surrogate"], "left")
        ranked, n = stored_counting(ranked.select("kind", "entity", "attempt", "surrogate", ((F.col("place") > 1) | F.col("real").isNotNull()).alias("again")), "surrogates", F.col("again"))
        good = ranked.where("not again").drop("again")
        if not n:
            return good
        again = ranked.where("again").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        s = good.unionByName(again.withColumn("surrogate", made("kind", "entity", "attempt")))


def anonymize(df: DataFrame, text: str, secret: bytes, out: str = "clean_text") -> DataFrame:
    """``df`` with ``out``: ``text`` in which each mention is ``[kind: surrogate]``; other text is kept as it is.

    The surrogate is written in the notation of the mention. Texts are searched
    once; rows without a mention are not shuffled. Null stays null.
    """
    columns_or_fail(df, text)
    row, found, key = fresh("row"), fresh("found"), fresh("key")
    seen = stored(detect(df, text, found).withColumn(row, F.monotonically_increasing_id()), "mentions")
    hit = seen.where(F.size(found) > 0)
    parts = hit.select(row, F.explode(found).alias("m")).select(row, "m.*")
    entity_key = F.concat_ws("\x00", "kind", "entity")
    map_ = surrogates(parts, secret).select(entity_key.alias(key), "attempt")
    named = lookup_join(parts.withColumn(key, entity_key), map_, key)
    lists = named.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "entity", "form", "attempt"))).alias("edits"))

    @F.pandas_udf("string")
    def apply(texts: pd.Series, edits: pd.Series) -> pd.Series:
        done = []
        for t, es in zip(texts, edits, strict=True):
            bits, at = [], 0
            for e in es:
                bits += [t[at : e["start"]], f"[{e['kind']}: {surrogate(secret, e['kind'], e['entity'], e['form'], e['attempt'])}]"]
                at = e["stop"]
            done.append("".join(bits) + t[at:])
        return pd.Series(done, dtype=object)

    keep = [c(x) for x in df.columns if x.lower() != out.lower()]
    changed = hit.join(lists, row).select(*keep, apply(c(text), F.col("edits")).alias(out))
    rest = seen.where(F.size(found) == 0).select(*keep, c(text).alias(out))
    return changed.unionByName(rest)
