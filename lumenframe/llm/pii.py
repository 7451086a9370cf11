"""Personal information inside free text: found with exact source spans, replaced by typed placeholders.

A text is first normalised by transducers (look-alike letters and digits, invisible characters,
character references, at/dot disguises, spelled digits) that keep, for each normalised character, the span
of source characters it stands for. The detectors run on the normalised text and their spans are
mapped back, so what is found and replaced is exactly what the text holds. Each text is handled
whole, in Arrow batches, so the work follows the number of characters.

Names are told by shape and by the corpus itself, not by a list of names: two or more capitalised words in a row are a name
unless one of them is an ordinary word, which the corpus also writes small, or they are a phrase that it always uses whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values

#: Look-alikes of Latin letters in other scripts.
LOOKALIKES = dict(zip("АВЕКМНОРСТХасеорхуіјѕԁӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaceopxyijsdlABEZHIKMNOPTYXo"))

DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

#: Capitalised words that open a sentence or a greeting, or head a phrase, and are part of no name.
NO_NAME = """
A According After Alle Also Am An And Another Any As At Auch Aucun Avec Best Bitte Both But By Call Can Cette Cher Ciao Comment Could Danke Das
Dear Depuis Der Des Desde Did Die Diese Dieser Dieses Do Does Don Du Each Ein Eine Einer Einige El Ella En Er Es Esta Este Euer Every Fixed Following For From Gracias Greetings
Have He Hello Her Here Hi His How However I Ich If Ihr Ihre Il Ils Im In Is It Its Jede Jeder Jedes Just Kein Keine Kind La Las Le Les Leur Liebe Lieber Logged Los Mail
Many Manche Maybe Mein Meine Merci Mit My Name No Nos Not Note Notre Nous Now On Order Our Per Please Por Pour Primero Read Regards Row Same See Seit Set She Ship
Since Sir Solche Source Thank Thanks That The Their Then There These They This Those Ticket To Un Una Und Une Unser Unsere Use Viele Von Vos Votre Was We Welche Were
What When Where Whereas Which While Who Why Wie Will Wir With Without Works Yes Yesterday You Your
January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday
""".split()

#: Words before a name that are no part of it.
TITLES = """
Dr Mr Mrs Ms Miss Prof Professor Herr Frau Herrn Mme Mlle Madame Monsieur Señor Señora Sr Sra Don Doña Sir Lady Kollege Kollegin Colleague Collègue Colega Maintainer Author
""".split()

STREET_WORDS = "Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Court|Ct|Drive|Dr|Way|Terrace|Place|Pl|Square|Sq|Crescent|Boulevard|Blvd|Row|Walk|Gardens|Grove|Mews|Parade|Quay"

# ---------------------------------------------------------------- transducers

_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_ONE = {**_WIDE, **dict.fromkeys(_INVISIBLE, ""), "\u00a0": " ", "\u2010": "-", "\u2011": "-", "\u2013": "-", "\u2212": "-"}
_REFS = {"&#64;": "@", "&#x40;": "@", "&commat;": "@", "%40": "@", "&#46;": ".", "&period;": "."}
_WORD = r"[\w.+%'-]"
_AT = r"\s*[\[({<]\s*(?:at|arroba|@)\s*[\])}>]\s*"
_DOT = r"\s*[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*"
_SPELLED = "|".join(DIGIT_WORDS)
_DISGUISE = re.compile(
    rf"(?P<bat>(?<={_WORD}){_AT}(?=[A-Za-z0-9]))|(?P<bdot>(?<=\w){_DOT}(?=[A-Za-z0-9]))"
    rf"|(?P<said>(?<=[\w+-])\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+\b)"
    rf"|(?P<gap>(?<=[\w+-])[ ]?@[ ](?=[A-Za-z0-9-]+\.)|(?<=[\w+-])[ ]@(?=[A-Za-z0-9-]+\.))"
    rf"|(?P<digits>\b(?:(?:{_SPELLED})[\s,.-]+){{6,}}(?:{_SPELLED})\b)",
    re.I,
)
#: What may stand before a spoken "at": words joined by points or spoken dots.
_BEFORE = re.compile(r"(?<![\w.@+-])[\w+-]+(?:(?:\.|\s+dot\s+)[\w+-]+)*$", re.I)
_SAID = re.compile(r"\s+(at|dot)\s+", re.I)
_SPOKEN = re.compile(rf"({_SPELLED})([\s,.-]*)", re.I)
_MAPPED = re.compile("[" + "".join(map(re.escape, [*_ONE, *LOOKALIKES])) + r"]|&#(?:64|46|x40);|&(?:commat|period);|%40")
#: Cheap signs that one of the disguises may be there; without them the text is not scanned for any.
_HINT = re.compile(rf"[\[({{<]\s*(?i:at|arroba|@|dot|punkt|point|punto|\.)\s*[\])}}>]|[ ]@|@[ ]|\s(?i:dot)\s|\b(?i:{_SPELLED})[\s,.-]+(?i:{_SPELLED})\b")


def _rewrite(text: str, spans: list[tuple[int, int, str]], starts: list[int], ends: list[int]) -> tuple[str, list[int], list[int]]:
    """Replace spans of ``text``; ``starts`` and ``ends`` give the source span of each character and are carried along."""
    out, s, e, at = [], [], [], 0
    for a, b, new in spans:
        out += [text[at:a], new]
        s += starts[at:a] + [starts[a]] * len(new)
        e += ends[at:a] + [ends[b - 1]] * len(new)
        at = b
    return "".join(out) + text[at:], s + starts[at:], e + ends[at:]


def normalise(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """The normalised text, and for each of its characters where its source begins and ends (None: unchanged)."""
    mapped = bool(_MAPPED.search(text))
    if not mapped and not _HINT.search(text):
        return text, None, None
    starts, ends = list(range(len(text))), list(range(1, len(text) + 1))
    spans = []
    for m in _MAPPED.finditer(text) if mapped else ():
        got = m.group()
        new = _REFS.get(got.lower()) if len(got) > 1 else _ONE.get(got)
        if new is None and got in LOOKALIKES:
            # a look-alike counts only in a word with Latin letters; words of its own script stay
            a, b = m.span()
            while a and text[a - 1].isalpha():
                a -= 1
            while b < len(text) and text[b].isalpha():
                b += 1
            new = LOOKALIKES[got] if any(c.isascii() for c in text[a:b]) else None
        if new is not None:
            spans.append((m.start(), m.end(), new))
    if spans:
        text, starts, ends = _rewrite(text, spans, starts, ends)
    spans = []
    for m in _DISGUISE.finditer(text) if _HINT.search(text) else ():
        kind = m.lastgroup
        if kind in ("bat", "gap"):
            spans.append((m.start(), m.end(), "@"))
        elif kind == "bdot":
            spans.append((m.start(), m.end(), "."))
        elif kind == "said":
            at = max(spans[-1][1] if spans else 0, m.start() - 200)
            led = _BEFORE.search(text, at, m.start())
            if led:
                a = led.start()
                spans += [(a + x.start(), a + x.end(), "@" if x.group(1).lower() == "at" else ".") for x in _SAID.finditer(text[a : m.end()])]
        else:
            spans += [(m.start() + x.start(), m.start() + (x.end(1) if x.end() == len(m.group()) else x.end()), DIGIT_WORDS[x.group(1).lower()]) for x in _SPOKEN.finditer(m.group())]
    return _rewrite(text, spans, starts, ends) if spans else (text, starts, ends)


# ---------------------------------------------------------------- detectors

_EMAIL = re.compile(r"(?<![\w.%+@/-])[A-Za-z0-9](?:[\w.%+'-]*[\w+])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@-])")
_ID_WORDS = (
    r"(?:social[ ]security|social[ ]insurance|(?:my|his|her)[ ]social|ssn|national[ ]insurance|nino|insurance|passport|tax[ ](?:payer[ ])?(?:id|number|no)|tin|steuer-?(?:id|nummer|identifikationsnummer)"
    r"|steuerliche[ ]identifikationsnummer|identity[ ]card|identity[ ](?:number|no)|id[ ]card|national[ ]id|dni|nie|nif|personalausweis(?:nummer)?|ausweis(?:nummer)?|reisepass(?:nummer)?|sozialversicherungsnummer|versicherungsnummer"
    r"|num[ée]ro[ ]de[ ]s[ée]curit[ée][ ]sociale|s[ée]curit[ée][ ]sociale|nir|passeport|carte[ ]d'identit[ée]|pasaporte|seguridad[ ]social|nss|documento[ ]de[ ]identidad)"
)
_ID_LINK = r"(?:[ ]?(?:number|num|no|nr|nummer|id|is|was|was:|reads|n[°º]|#)\b)?"
_ID_VALUE = (
    r"(?:\d{3}-\d{2}-\d{4}|[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z]|[A-Z]{1,3}[ ]?\d{6,9}|\d{1,2}\.\d{3}\.\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]"
    r"|[12][ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{2}|\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}|\d{2}[ ]\d{6}[ ][A-Z][ ]\d{3}|[0-9A-Z](?=[0-9A-Z]*\d{4})[0-9A-Z]{7,11}|\d{3}[ ]\d{2}[ ]\d{4}|\d{3}[ ]\d{3}[ ]\d{3})(?![\w-])"
)
_ID = re.compile(rf"\b(?i:{_ID_WORDS}{_ID_LINK}{_ID_LINK})[ ]?[.:=#]{{0,2}}[ ]?[\"'(]?(?P<v>{_ID_VALUE})")
_PHONE = re.compile(
    r"(?<![\w.+/#=&@:-])(?<!\d[ ])(?:"
    r"(?P<plus>\+\d{1,3}(?:[ ./-]?\(\d{1,5}\))?(?:[ ./-]?\d{1,12}){1,7})"
    r"|(?P<zeros>00[1-9]\d{0,2}(?:[ ./-]\(?\d{1,5}\)?)(?:[ ./-]\d{2,8}){1,5}|00[1-9]\d{9,12})"
    r"|(?P<nanp>(?:1[ .-])?(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}(?P<s>[ .-]))[2-9]\d{2}(?(s)(?P=s)|[ .-])\d{4})"
    r"|(?P<trunk>\(0\d{1,5}\)[ ]?\d{2,8}(?:[ ./-]\d{2,8}){0,4}|0[1-9]\d{0,4}(?:[ ./-]\d{2,8}){1,5}|0[1-9]\d{8,10})"
    r")(?![\w@]|[./:-]\d|[ ]\d)"
)
_ISO_DATE = re.compile(r"0?\d{1,2}([./-])\d{1,2}\1\d{2,4}$")
_NUM = r"\d{1,4}[ ]?(?:[A-Za-z](?![\w]))?(?:[ ](?:bis|ter)\b)?"
_TAIL = r"\d{1,4}(?:[ ]?[A-Za-z](?!\w))?(?:[ ](?:bis|ter)\b)?"
_CAP1 = r"(?:(?:[OD]['’]|Mc|Mac|De)(?=\p{Lu}))?\p{Lu}[\p{Ll}'’]+"
_CAP = rf"{_CAP1}(?:-{_CAP1})*"
_ADDRESS = re.compile(
    rf"(?<![\w.,-])\d{{1,4}}[A-Za-z]?(?:[ ](?:bis|ter))?,?[ ](?:{_CAP}[ ]){{1,3}}(?:{STREET_WORDS})\b"
    rf"|(?<![\w.,-])\d{{1,4}}[A-Za-z]?(?:[ ](?:bis|ter))?,?[ ](?i:rue|avenue|boulevard|bd|place|chemin|impasse|all[ée]e|quai|route|cours|square)[ ](?:(?:de[ ]la|du|des|de)[ ]|(?:de[ ]l|d)['’])?{_CAP}"
    rf"|\b(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|Camino|Ronda|Via|Viale|Piazza|Rua)[ ](?:(?:de[ ]la|de[ ]los|de[ ]las|del|de|da|do)[ ])?{_CAP}(?:[ ]{_CAP})?,?[ ](?:n[ºo°]\.?[ ])?\d{{1,4}}[A-Za-z]?(?:[ ](?:bis|ter))?(?!\w|\.\d)"
    rf"|(?<!\w)\p{{Lu}}[\p{{Ll}}-]*(?:\p{{Lu}}[\p{{Ll}}-]*)*(?:stra(?:ß|ss)e|str\.|gasse|weg|platz|allee|ufer|damm|ring|steig|pfad)[ ]\d{{1,4}}[A-Za-z]?(?!\w|\.\d)"
    rf"|(?<!\w)(?:{_CAP})(?:er)?[ ](?:Stra(?:ß|ss)e|Str\.|Gasse|Weg|Platz|Allee|Ufer|Damm|Ring)[ ]\d{{1,4}}[A-Za-z]?(?!\w|\.\d)"
    rf"|(?<!\w)(?:Am|An[ ]der|Auf[ ]der|Auf[ ]dem|Im|In[ ]der|Zum|Zur|Unter[ ]den|Beim|Hinter[ ]der)[ ]{_CAP}[ ]\d{{1,3}}[A-Za-z]?(?!\w|[.:,]\d|[ ](?:\p{{Ll}}|%))"
    rf"|(?<!\w)(?:Am|An[ ]der|Auf[ ]der|Auf[ ]dem|Im|In[ ]der|Zum|Zur|Unter[ ]den|Beim)[ ]{_CAP}[ ]\d{{1,3}}[A-Za-z]?(?=[ ](?:senden|schicken|wohn))"
)

_PART = r"(?:van[ ]der|van[ ]den|van|von[ ]der|von|zu|de[ ]la|de|del|della|di|da|du|le|la|ter|ten|el|al|bin|ben)"
_PARTS = rf"(?:{_PART}|{_PART.upper()})"
_UP = r"\p{Lu}{2,}(?:-\p{Lu}{2,})*"
_INI = r"\p{Lu}\."
_W = rf"(?:{_CAP}|{_UP})"
#: The shapes of a full name: given name or initials and surname, in either order.
_SHAPE = re.compile(
    rf"(?<![\w@.-])(?:(?:(?P<given>{_W})(?:[ ]{_INI})*|(?P<init>{_INI}(?:[ ]?{_INI}){{0,2}}))[ ](?:{_PARTS}[ ])?(?P<s1>{_W})"
    rf"|(?P<turned>(?:{_PARTS}[ ])?(?P<s2>{_W}),[ ](?:(?P<g2>{_W})(?:[ ]{_INI})*(?![\w-]|[ ]\p{{Lu}}[\p{{Ll}}])|{_INI}(?:[ ]?{_INI}){{0,2}}(?!\w))))"
    rf"(?![\w@]|[.-]\w)"
)
_TITLE = r"(?:Dr\.|Mr\.?|Mrs\.?|Ms\.?|Miss|Prof\.|Professor|Herr|Frau|Herrn|Mme\.?|Madame|Monsieur|Señor|Señora|Sra?\.|Don|Doña)"
_CALLED = re.compile(
    rf"(?:(?<!\w){_TITLE}|(?i:\bauthor:|\bwritten[ ]by|\bmaintained[ ]by|\bname[ ]?[:=]|\"name\":[ ]?\"|\bcc:|\bhat[ ]tip:|\bmy[ ]colleague|\bmein[ ]kollege|\bmeine[ ]kollegin|\bmon[ ]coll[èe]gue|\bmi[ ]colega|\bsigned[ ]by|\bregards,\n|\bgr(?:ü|ue)(?:ß|ss)e,?\n|\bcordialement,\n|\bsaludos?,\n|\n--[ ]?\n))[ ]*"
    rf"(?P<n>(?P<first>{_CAP}|{_UP})(?:[ ]{_INI})*[ ](?:{_PART}[ ])?(?P<s>{_CAP}|{_UP})|(?P<s5>{_CAP}|{_UP}),[ ](?P<f5>{_CAP}|{_UP}))(?![\w@]|[.-]\w)"
)
#: Two or more capitalised words in a row, with particles between: only there the shapes are tried.
_RUN = re.compile(rf"(?<![\w@.-])\p{{Lu}}(?:\.|[\w'’-]+)(?:(?:,?[ ]|(?<=\.))(?:(?i:{_PART})[ ])?\p{{Lu}}(?:\.|[\w'’-]+))+")
_PREFIXED = re.compile(rf"(?i:{_PART})[ ]$")
_LETTERS = re.compile(r"\p{L}[\p{L}'’]*")
_BARRED = frozenset(NO_NAME) | frozenset(TITLES)
_ONE_SCRIPT = re.compile(r"[^\p{L}]*(?:\p{Latin}|[^\p{L}])+|[^\p{L}]*(?:\p{Cyrillic}|[^\p{L}])+|[^\p{L}]*(?:\p{Greek}|[^\p{L}])+")
_VOICED = re.compile(r"[AEIOUYÀ-Ý]")
#: Only words that do not open a sentence as well ("... Lind Row 7 holds").
_AFTER_STREET = re.compile(r"[ ](?:Street|Road|Lane|Avenue|Boulevard|Terrace|Square|Crescent)\b")
_STREET_LAST = frozenset(STREET_WORDS.split("|"))
_MONSIEUR = re.compile(rf"M\.[ ]?(?=(?:{_INI}|{_CAP}|{_UP}))")


#: Without any of these, in small letters, the patterns of addresses and introduced names cannot match.
_PLACES = (*(w.lower() for w in STREET_WORDS.split("|")), "rue ", "bd ", "chemin", "impasse", "allée", "allee", "quai", "route", "cours", "calle", "c/", "avenida", "avda", "av.", "plaza", "pza", "paseo", "camino", "ronda", "via", "piazza", "rua", "straße", "strasse", "str.", "gasse", "weg", "platz", "ufer", "damm", "ring", "steig", "pfad", "am ", "an der ", "auf de", "im ", "in der ", "zum ", "zur ", "unter den ", "beim ", "hinter der ")
_CALLS = ("dr.", "mr", "ms", "miss", "prof", "herr", "frau", "mme", "madame", "monsieur", "señor", "sr", "sra", "don ", "doña", "author:", "written by", "maintained by", "name", "cc:", "hat tip:", "colleague", "kolleg", "collègue", "collegue", "colega", "signed by", "regards,", "cordialement", "saludo", "grüße", "grüsse", "gruess", "grueß", "grüß", "gruß", "\n--")


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        got = m.group()
        n = sum(c.isdigit() for c in got)
        kind = m.lastgroup if m.lastgroup != "s" else "nanp"
        if kind == "plus" and not 8 <= n <= 15:
            continue
        if kind == "zeros" and not 11 <= n <= 17:
            continue
        if kind == "trunk" and (not 9 <= n <= 12 or _ISO_DATE.match(got)):
            continue
        yield m.start(), m.end()


@dataclass(frozen=True)
class WordModel:
    """What a corpus tells about its words: sorted hashes of the ordinary ones (also written small) and of its fixed phrases."""

    ordinary: np.ndarray
    phrases: np.ndarray

    @staticmethod
    def of(words: list[str], phrases: list[str] = ()) -> WordModel:
        hashes = lambda texts: np.unique(np.array([_hash(t) for t in texts], dtype=np.uint64))
        return WordModel(hashes(words), hashes(phrases))

    def knows(self, word: str) -> bool:
        return _held(self.ordinary, word.lower())

    def fixed(self, phrase: str) -> bool:
        return _held(self.phrases, phrase.lower())


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def _held(hashes: np.ndarray, text: str) -> bool:
    h = np.uint64(_hash(text))
    i = int(np.searchsorted(hashes, h))
    return i < len(hashes) and hashes[i] == h


NO_WORDS = WordModel(np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _plain(word: str, model: WordModel, memo: dict[str, bool]) -> bool:
    """Whether a word of a candidate speaks against a name: barred, a street word, unpronounceable, or ordinary in the corpus."""
    got = memo.get(word)
    if got is None:
        title = word.capitalize() if word.isupper() else word
        got = title in _BARRED or title in _STREET_LAST or model.knows(word) or (word.isupper() and (len(word) < 3 or not _VOICED.search(word)))
        if len(memo) > 200_000:
            memo.clear()
        memo[word] = got
    return got


def _names(text: str, model: WordModel, memo: dict[str, bool]) -> Iterator[tuple[int, int]]:
    """Spans of names: by shape where no word is ordinary, and behind a word that introduces a name."""
    for run in _RUN.finditer(text):
        at, end = run.start(), min(len(text), run.end() + 4)
        led = _PREFIXED.search(text, max(0, at - 8), at)  # a surname may open with a particle
        at = led.start() if led else at
        while m := _SHAPE.search(text, at, end):
            a, b = m.span()
            words = _LETTERS.findall(m.group())
            long = [w for w in words if len(w) > 1 and w[0].isupper() and not re.fullmatch(_PART.upper(), w)]
            bad = next((i for i, w in enumerate(words) if w in long and _plain(w, model, memo)), None)
            if bad is not None or not long or not _ONE_SCRIPT.fullmatch(m.group()) or model.fixed(" ".join(words)) or _AFTER_STREET.match(text, b):
                # go on behind the first word that is no name, else behind the first word
                at = text.index(words[bad or 0], a) + len(words[bad or 0])
                continue
            if (m.group("init") or not m.group("g2") and m.group("turned")) and max(map(len, long)) < 3:
                at = b
                continue
            t = _MONSIEUR.match(text, a)
            if t and m.group("init"):
                if len(long) == 1 and text.startswith((" l'a", " m'a", " l’a", " a "), b) and not re.match(_INI, text[t.end() :]):
                    at = b
                    continue  # a title and a surname alone
                nxt = _SHAPE.match(text, t.end())  # a title before a whole name
                if nxt and not any(_plain(w, model, memo) for w in _LETTERS.findall(nxt.group()) if len(w) > 1 and w[0].isupper()):
                    a, b = nxt.span()
            yield a, b
            at = b
    small = text.lower()
    for m in _CALLED.finditer(text) if any(w in small for w in _CALLS) else ():
        words = [m.group(k) for k in ("first", "s", "s5", "f5") if m.group(k)]
        if not any(w in _BARRED for w in words) and not _AFTER_STREET.match(text, m.end()):
            yield m.span("n")


def find_details(text: str | None, model: WordModel = NO_WORDS, memo: dict[str, bool] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each detail in the source text, in order and without overlaps.

    Without a model of the corpus's words only barred and street words speak against a name.
    """
    if not text or not text.strip():
        return []
    norm, starts, ends = normalise(text)
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(norm))

    def take(a: int, b: int, kind: str) -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, kind))

    if "@" in norm:
        for m in _EMAIL.finditer(norm):
            if not norm.startswith("://", max(0, m.start() - 3)) and not re.match(r":[\w/~]", norm[m.end() : m.end() + 2]):
                take(m.start(), m.end(), "email")
    for m in _ID.finditer(norm):
        take(*m.span("v"), "idnum")
    for a, b in _phones(norm):
        take(a, b, "phone")
    small = norm.lower()
    for m in _ADDRESS.finditer(norm) if any(w in small for w in _PLACES) else ():
        take(m.start(), m.end(), "address")
    for a, b in _names(norm, model, {} if memo is None else memo):
        take(a, b, "name")
    if starts is not None:
        found = [(starts[a], ends[b - 1], kind) for a, b, kind in found]
    return sorted(found)


def redact(text: str | None, model: WordModel = NO_WORDS, memo: dict[str, bool] | None = None) -> str | None:
    """The text with each detail replaced by a placeholder of its type; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in find_details(text, model, memo):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


# ---------------------------------------------------------------- operators

WORDS = 4_000_000  # ordinary words the model may hold (8 bytes each)
SMALL_SHARE = 0.05  # share of small spellings from which a word is ordinary
PHRASE_DOCS = 20  # documents that a fixed phrase is in, at least
_TOKEN = r"(?<![\p{L}\p{N}@._/+-])\p{L}[\p{L}'’]+(?![\p{L}\p{N}@_/+-]|\.\w)"
_PAIR = r"(?<![\p{L}\p{N}@._/+-])\p{Lu}[\p{Ll}'’]+ \p{Lu}[\p{Ll}'’]+(?![\p{L}\p{N}@_/+-]|\.\w)"


def word_model(docs: DataFrame, text_col: str = "text", most: int = WORDS) -> WordModel:
    """The model of a corpus: one count of its words and one of its pairs of capitalised words, over all documents.

    A word is ordinary if it is also written small in at least ``SMALL_SHARE`` of its places (mail addresses and identifiers apart); only
    words that occur capitalised matter. A pair is a fixed phrase if it is in ``PHRASE_DOCS`` documents or more and each of its words
    stands mostly with the other. Only their hashes reach the driver. Should there be more than ``most`` ordinary words, those
    seen least often are left out, and count as possible names.
    """
    text = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
    w = text.select(F.explode(F.regexp_extract_all("t", F.lit(_TOKEN), F.lit(0))).alias("w"))
    small = (F.col("w") == F.lower("w")).cast("int")
    held = w.groupBy(F.lower("w").alias("k")).agg(F.sum(small).alias("small"), F.count("*").alias("n")).where((F.col("small") >= SMALL_SHARE * F.col("n")) & (F.col("small") > 0) & (F.col("small") < F.col("n")))
    words = [r["k"] for r in held.orderBy(F.desc("n"), "k").limit(most).toLocalIterator()]
    p = text.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(_PAIR), F.lit(0)))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    p = p.withColumns({"a": F.substring_index("p", " ", 1), "b": F.substring_index("p", " ", -1)})
    often = p.where(F.col("n") >= PHRASE_DOCS)
    first, last = p.groupBy("a").agg(F.sum("n").alias("na")), p.groupBy("b").agg(F.sum("n").alias("nb"))
    fixed = often.join(first, "a").join(last, "b").where("n >= 0.5 * na AND n >= 0.5 * nb").orderBy(F.desc("n"), "p").limit(most)
    return WordModel.of(words, [r["p"].lower() for r in fixed.select("p").collect()])


def personal_details(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: WordModel | None = None) -> DataFrame:
    """(doc_id, kind, found_text): one row for each distinct detail in a document, as the text spells it.

    Null, empty and blank texts give no row; repeated documents give their details once. The model of the words is the
    corpus's own unless one is given.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model or word_model(docs, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, memo = shared.value, {}
        for pdf in batches:
            rows = [(d, k, t[a:b]) for d, t in zip(pdf["doc_id"], pdf["text"]) if t for a, b, k in find_details(t, words, memo)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "found_text"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").mapInPandas(run, f"doc_id {kind}, kind string, found_text string").distinct()


def redacted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: WordModel | None = None) -> DataFrame:
    """(doc_id, text): each document with its details replaced; one row for each input row, nulls kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model or word_model(docs, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, memo = shared.value, {}
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [redact(t, words, memo) for t in pdf["text"]]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, text string")
