"""Personal information in free text: typed spans and readable redaction.

Detection works on a normalised view of the text.  The normaliser is a chain of transducers that
record every edit, so that a span found in the view maps back to the exact source characters:

* compatibility forms, homoglyphs of Latin letters and unusual blanks and hyphens become ASCII,
  invisible characters vanish;
* disguised addresses, ``name (at) host [dot] tld`` and ``name AT host DOT tld``, become plain ones;
* digits spelled as words, five or more in a row, become digits.

Identifiers (e-mail, phone, labelled identity numbers), street addresses and names are then found by
shape and context.  Names have two kinds of context: fixed frames, which also carry names in lower case or with
an initial alone, and classes of cues that hold in any sentence: a form of address, a label with a colon, who did
something, who is called, or a given name in a pair of capitalised words that is no place or body.  Everything is map-only: one pass over the texts, no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

# -- transducers -------------------------------------------------------------------------------
#: Fixed: letters of other alphabets that look like Latin ones.
_HOMOGLYPHS = dict(zip("АВЕКМНОРСТХаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXaeopcyxijsABEZHIKMNOPTYXo"))
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_BLANKS = dict.fromkeys("\u00a0\u2002\u2003\u2007\u2009\u202f\u3000", " ") | dict.fromkeys("\u2010\u2011\u2012\u2013\u2212", "-")
_ODD = re.compile("[" + "".join(_HOMOGLYPHS) + _INVISIBLE + "".join(_BLANKS) + "\uff01-\uff5e\u2460-\u24ff\U0001d400-\U0001d7ff]")
_LATIN_NEAR = re.compile(r"[0-9A-Za-z@._%+-]")
_AT = r"(?:[ \t]?[(\[{<][ \t]?at[ \t]?[)\]}>][ \t]?)"
_DOT = r"(?:[ \t]?[(\[{<][ \t]?dot[ \t]?[)\]}>][ \t]?)"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?"
_DISGUISED = re.compile(
    rf"(?<![\w.+-])({_LOCAL})(?:{_AT}{_HOST}(?:(?:\.|{_DOT}|[ \t](?:dot|DOT)[ \t]){_HOST})+|[ \t]?@[ \t]?{_HOST}(?:(?:\.|{_DOT}){_HOST})+|[ \t]+(?:at|AT)[ \t]+{_HOST}(?:[ \t]+(?:dot|DOT)[ \t]+{_HOST}|{_DOT}{_HOST})+)",
    re.I,
)
#: Lower-case literals, one of which every disguise holds.
_DISGUISE_HINTS = tuple(a + w + b for w in ("at", "dot") for a, b in (("(", ")"), ("[", "]"), ("{", "}"), ("<", ">"), ("( ", " )"), ("[ ", " ]"))) + (" dot ", " @", "@ ")
_SPELLED = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_DIGIT_WORDS = re.compile(r"\b(?:" + "|".join(_SPELLED) + r")(?:[ -](?:" + "|".join(_SPELLED) + r")){4,}\b", re.I)


class View:
    """A normalised text and the way back: edits are (source start, source end, replacement)."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]] | None = None):
        self.source, self._at, self._edits = source, None, sorted(edits or [])
        if not self._edits:
            self.text = source
            return
        parts, at, last, pos = [], [], 0, 0
        for a, b, new in self._edits:
            if a < last:
                continue
            parts += [source[last:a], new]
            pos += a - last
            at.append((pos, pos + len(new), a, b))
            pos += len(new)
            last = b
        parts.append(source[last:])
        self.text, self._at = "".join(parts), at
        self._starts = [x[0] for x in at]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source span of a span of the view; an edit touched in part is taken whole."""
        if not self._at:
            return start, end
        return self._one(start, False), self._one(end, True)

    def _one(self, p: int, is_end: bool) -> int:
        k = bisect_right(self._starts, p - is_end) - 1
        if k < 0:
            return p
        lo, hi, a, b = self._at[k]
        if p - is_end < hi:
            return b if is_end else a
        return b + p - hi


def _spelled_digits(low: str) -> bool:
    """Cheap necessary condition for five digit words in a row."""
    return sum(low.count(w + " ") + low.count(w + "-") for w in _SPELLED) >= 4


def normalise(text: str) -> View:
    edits: list[tuple[int, int, str]] = []
    if not text.isascii():
        for m in _ODD.finditer(text):
            c, i = m.group(), m.start()
            if c in _INVISIBLE:
                edits.append((i, i + 1, ""))
            elif c in _BLANKS:
                edits.append((i, i + 1, _BLANKS[c]))
            elif c in _HOMOGLYPHS:  # only inside an otherwise Latin run
                if (i and _LATIN_NEAR.match(text[i - 1])) or _LATIN_NEAR.match(text[i + 1 : i + 2] or " "):
                    edits.append((i, i + 1, _HOMOGLYPHS[c]))
            else:
                edits.append((i, i + 1, unicodedata.normalize("NFKC", c)))
    first = View(text, edits)
    more = []
    low = first.text.lower()
    if any(h in low for h in _DISGUISE_HINTS):
        for m in _DISGUISED.finditer(first.text):
            a, b = first.back(*m.span())
            tail = m.group()[len(m.group(1)) :]
            tail = re.sub(rf"^(?:{_AT}|[ \t]?@[ \t]?|[ \t]+at[ \t]+)", "@", tail, flags=re.I)
            tail = re.sub(rf"{_DOT}|[ \t]+dot[ \t]+", ".", tail, flags=re.I)
            # the edit spares the local part, so that a span may begin within it
            a += len(m.group(1)) if not edits else 0
            more.append((a, b, tail if not edits else m.group(1) + tail))
    for m in _DIGIT_WORDS.finditer(first.text) if _spelled_digits(low) else ():
        a, b = first.back(*m.span())
        more.append((a, b, "".join(_SPELLED[w.lower()] for w in re.split(r"[ -]", m.group()))))
    if not more:
        return first
    kept = [e for e in edits if not any(a <= e[0] and e[1] <= b for a, b, _ in more)]
    return View(text, kept + more)


# -- identifiers -------------------------------------------------------------------------------
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}@(?:{_HOST}\.)+[A-Za-z]{{2,}}(?![\w@])")
#: Fixed: labels of identity numbers and the shapes that may follow them.
_ID_LABELS = (
    r"national insurance (?:number|no\.?)|NI no\.?|NINO|social security (?:number|no\.?)|SSN|n° de sécurité sociale|número de seguridad social|numéro de sécurité sociale|sozialversicherungsnummer|"
    r"personnummer|tax id|steuer-id|steuernummer|TIN|passport(?: (?:no\.?|number))?|reisepass(?:nr\.?|nummer)?|pasaporte(?: n[ºo°]\.?)?|passeport(?: n°)?|DNI|NIE|driving licen[cs]e(?: no\.?)?|"
    r"driver'?s licen[cs]e(?: no\.?)?|führerschein(?:nr\.?)?|ID card(?: no\.?)?|identity card(?: no\.?)?|personalausweis(?:nr\.?)?|identity number|national id"
)
_ID_SHAPES = (
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b|\d{3}[- ]\d{2}[- ]\d{4}|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|(?:\d{2}){3,4}[-+]\d{4}|\d{2}-\d{7}|\d{2} \d{3} \d{3} \d{3}|[XYZ]-?\d{7}-?[A-Z]\b|"
    r"[A-Z0-9]{5}\d{6}[A-Z0-9]{5}\b|(?=[A-Z0-9-]*\d)[A-Z0-9](?:[A-Z0-9-]{4,18})[A-Z0-9]\b"
)
_ID = re.compile(rf"(?<!\w)(?:{_ID_LABELS})(?:[ \t]*[:#=][ \t]*|[ \t]+(?:is[ \t]+)?)((?:{_ID_SHAPES}))(?![\w-])", re.I)
_ID_HINTS = ("national ins", "ni no", "social", "sozialv", "ssn", "personnummer", "tax id", "steuer", "passport", "reisepass", "pasaporte", "passeport", "licen", "führerschein", "id card", "identity", "ausweis", "national id", "sécurité")

_PHONE = re.compile(
    r"(?<![\w+.,/@#-])(?<!\d )(?:"
    r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|"
    r"(?:\+|00)33[ ./-]?(?:\(0\)[ ]?)?\d(?:[ ./-]?\d{2}){4}|"
    r"(?:\+|00)44[ ./-]?(?:\(0\)[ ]?)?\d{2,5}[ ./-]?\d{3,4}[ ./-]?\d{3,4}|"
    r"(?:\+|00)49[ ./-]?(?:\(0\)[ ]?)?\d{2,4}[ ./-]?\d{5}[ ./-]?\d{3}|"
    r"(?:\+|00)46[ ./-]?(?:\(0\)[ ]?)?\d{2}[ ./-]?\d{3}[ ./-]?\d{2}[ ./-]?\d{2}|"
    r"(?:\+|00)61[ ./-]?(?:\(0\)[ ]?)?\d{3}[ ./-]?\d{3}[ ./-]?\d{3}|"
    r"\+\d{2,3}[ ./-]?(?:\(0\)[ ]?)?\d{1,4}(?:[ ./-]?\d{2,4}){2,4}|"
    r"(?:1[ .-])?\(\d{3}\)[ ]?\d{3}[-. ]\d{4}|1[-.]\d{3}[-.]\d{3}[-.]\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}|[2-9]\d{2}[2-9]\d{6}|"
    r"0\d(?:[ .-]\d{2}){4}|0\d{2}-\d{3} \d{2} \d{2}|0\d{2} \d{5}[ -]\d{3}|0\d{3} \d{3} \d{3}|0\d{4} \d{6}|0\d{3} \d{3} \d{4}|0\d{2} \d{4} \d{4}"
    r")(?![\w@])(?![.,/-]\d)"
)
_NO_PHONE = re.compile(r"(?:grid square|ISBN|build|catalogue no\.?|range|ratio|checksum|offset|bearing|version|isbn-1[03]:?)[ \t]*$", re.I)

# -- street addresses --------------------------------------------------------------------------
_NUM = r"\d{1,4}[A-Za-z]?"
_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_EN = re.compile(
    rf"(?<![\w./,-])(?<!\d )({_NUM},? (?:{_CAP} ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Close|Terrace|Drive|Dr|Way|Place|Square|Crescent|Boulevard|Blvd|Row|Walk|STREET|ST|ROAD|RD|AVENUE|AVE|LANE|LN|COURT|CT|CLOSE|TERRACE|DRIVE|WAY|PLACE|SQUARE|CRESCENT|BOULEVARD|BLVD|ROW|WALK)\b\.?)(?! (?:[Mm]arket|[Ss]tation|[Bb]ridge|[Mm]useum|[Ss]chool))"
)
_DE = re.compile(rf"(?<![\w-])((?:[A-ZÄÖÜ][^\W\d_]*-){{0,3}}[A-ZÄÖÜ][^\W\d_]*(?:stra(?:ß|ss)e|str\.|gasse|weg|allee|platz|ufer|damm|ring|STRA(?:SS|ẞ|ß)E|GASSE|WEG|ALLEE|PLATZ|UFER) {_NUM})(?!\w)")
_FR = re.compile(rf"(?<![\w./,-])(\d{{1,4}}[A-Za-z]?(?: (?:bis|ter))?,? (?i:rue|avenue|boulevard|chemin|place|quai|impasse|allée|route|cours|square) (?i:(?:de la|de l['’]|du|des|de|d['’]) ?)?(?:{_CAP} ?){{1,3}}?)(?=,|\n|\r|$|\.| {_NUM}| \(| depuis)")
_ES = re.compile(rf"(?<!\w)((?i:calle|avenida|plaza|paseo|camino|carrer|ronda|travesía) (?i:(?:de la|de los|de las|del|de) )?(?:{_CAP},? ){{1,3}}(?:[Nn][ºo°]\.? ?)?{_NUM})(?!\w)")
_DE_HINTS = ("straße ", "strasse ", "str. ", "gasse ", "weg ", "allee ", "platz ", "ufer ", "damm ", "ring ")
_FR_HINTS = (" rue ", " avenue ", " boulevard ", " chemin ", " place ", " quai ", " impasse ", " allée ", " route ", " cours ", " square ")
_ES_HINTS = ("calle ", "avenida ", "plaza ", "paseo ", "camino ", "carrer ", "ronda ", "travesía ")

# -- names -------------------------------------------------------------------------------------
#: Fixed: forms of address, never part of a name.
_TITLES = r"(?:Mrs?|Ms|Miss|Dr|Prof|Mme|Mlle|Sra?|Srta|Frau|Herrn?|Señora?|Don|Doña|Sir|Dame|MRS?|MS|DR|PROF|MME|FRAU|HERR|SRA?|mrs?|ms|dr|prof|mme|frau|herr|sra?)"
_TITLE = rf"(?:{_TITLES}\.?|M\.)[ ]"
_NOT_TITLE = rf"(?!(?:{_TITLES}|M)\b)"
#: A word of a name; words that join or follow names are none.
_W = r"(?!(?:et|y|and|und|of|at|for|on|to|by|gave|said|asked|reported|habite|wohnt|vive)\b)[^\W\d_]{2,}(?:['’-][^\W\d_]{2,})*"
_INI = r"[^\W\d_]\."
#: A name of two parts (either order) or with initials; or a surname alone after a form of address.
_FULL = rf"{_NOT_TITLE}(?:{_W},[ ]{_W}(?:[ ]{_INI})?|{_W}(?:[ ]{_INI})*[ ]{_W}|(?:{_INI}[ ])+{_W})"


def _name(tag: str) -> str:
    return rf"(?:(?:{_TITLE}){{1,2}}(?P<{tag}t>{_FULL}|{_NOT_TITLE}{_W})|(?P<{tag}>{_FULL}))"


_HEAD = r"(?:(?<=[\n\r.!?;:|)\]}>\"”])|(?<=[.!?;:|)\]}>\"”] )|(?<=\s\s)|^|(?<=\s)(?=" + _TITLE + r"|[^\W\d_]))[ \t]*"
#: Contexts that name a person: (literal that must occur, pattern).
_CONTEXTS = [
    (lit.lower(), re.compile(pat))
    for lit, pat in [
        ("this is ", rf"(?i:\bthis is ){_name('a')}(?=,| my | speaking|\.)"),
        ("signed by ", rf"(?i:\bsigned by ){_name('a')} and {_name('b')}(?=[.,;\n\r]|\s|$)"),
        ("opened by ", rf"(?i:\bopened by ){_name('a')}(?= for | on |[.,\n])"),
        ("Name:", rf"(?i:\bname: ?){_name('a')}(?=[ \t]*[\n\r]|[ \t]*$|[ ]Tel|,)"),
        ("Applicant:", rf"(?i:\bapplicant: ?){_name('a')}(?=, |[\n\r.])"),
        ("Witness ", rf"(?i:\bwitness ){_name('a')}(?= gave | said | stated )"),
        ("Record ", rf"(?i:\brecord \d+: ?){_name('a')}(?= \|)"),
        ("each ", rf"(?i:\breach ){_name('a')}(?= at | on | by )"),
        ("orwarded by ", rf"(?i:\bforwarded by ){_name('a')}(?= ?<|[ \t]*[\n\r]|  ?\S+@)"),
        (" asked for ", rf"{_HEAD}{_name('a')}(?= of {_CAP}(?: {_CAP})? asked for )"),
        (" reported that ", rf"{_HEAD}{_name('a')}(?= reported that )"),
        (") keeps ", rf"{_HEAD}{_name('a')}(?= \([^()\n]{{0,6}}(?:\([^()\n]*\)[^()\n]*)?[^()\n]*\) keeps )"),
        ("Kontakt:", rf"(?i:\bkontakt: ?){_name('a')}(?=, |[\n\r])"),
        ("gez. ", rf"\bgez\. {_name('a')}(?=[ \t]*[\n\r]|[ \t]*$)"),
        ("Sie sich an ", rf"\bSie sich an {_name('a')}(?=, | \(|\.)"),
        (" wohnt ", rf"{_HEAD}{_name('a')}(?= wohnt (?:seit|in|im) )"),
        (" habite ", rf"{_HEAD}{_name('a')}(?= habite )"),
        (" vive en ", rf"{_HEAD}{_name('a')}(?= vive en )"),
        ("écrire à ", rf"\bécrire à {_name('a')}(?=, | \()"),
        ("demander ", rf"\bdemander {_name('a')}(?=[.,;\n\r]|$)"),
        ("preguntar por ", rf"\bpreguntar por {_name('a')}(?=[.,;\n\r]|$)"),
        ("Firmado:", rf"\bFirmado: ?{_name('a')}(?: y {_name('b')})?(?=[ \t\n\r.,]|$)"),
        ("Signé", rf"\bSigné ?: ?{_name('a')}(?: et {_name('b')})?(?=[ \t\n\r.,]|$)"),
        ("Dossier de ", rf"\bDossier de {_name('a')}(?=, )"),
        ("Solicitud de ", rf"\bSolicitud de {_name('a')}(?=, )"),
        ("Antrag von ", rf"\bAntrag von {_name('a')}(?=, )"),
        ("Escriba a ", rf"\bEscriba a {_name('a')}(?= \(|, )"),
        ("--", rf"(?:^|[\n\r\s])-- ?[\n\r]+{_name('a')}(?=[ \t]*[\n\r]+{_NUM}[ ,])"),
        ("egards", rf"(?i:\bregards,?)[\n\r ]+{_name('a')}(?=[ \t]*[\n\r.]|[ \t]*$)"),
    ]
]
#: Fixed: words that open a sentence or name a body, hence no person.
_NO_NAME = set(
    "the a an no and or of in on at by for near each every some two la le les el los las der die das ein eine un une this that then after before until during "
    "committee council society union board trust guild museum institute observatory company railway press cooperative line survey association office keeper keepers desk team workers residents ministry university bridge lake ridge street road station".split()
)


#: A written name: capitalised parts, initials between or before them, small words of descent, and no place or body after it.
_CAPW = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:['’-][A-ZÀ-ÖØ-Þ]?[^\W\d_]+)*"
_DESCENT = r"(?:(?:van|von|der|den|de|da|di|del|du|dos|la|le|zu|bin|ben|al|ibn)[ ])*"
_WRITTEN = rf"{_NOT_TITLE}(?:{_CAPW}|[A-Z]\.)(?:[ ][A-Z]\.)*[ ]{_DESCENT}{_CAPW}(?![^\W_]|['’-]\w)"
#: Fixed: classes of words that stand beside persons, in the languages of the corpus.
_DONE = set("signed|written|opened|forwarded|submitted|prepared|approved|reviewed|reported|filed|sent|edited|compiled|witnessed|requested|countersigned|unterschrieben|verfasst|eingereicht|signé|rédigé|envoyé|firmado|escrito|enviado".split("|"))
_LABEL = set("name|contact|applicant|author|client|customer|patient|tenant|owner|employee|student|teacher|attn|attention|from|sender|recipient|signed|signature|caller|kontakt|ansprechpartner|kunde|patientin|mieter|absender|nom|client|auteur|autor|nombre|contacto|paciente|firmado|signé|remitente|expéditeur|cliente".split("|"))
_CALLS = tuple("ask for|speak to|speak with|contact|call|write to|regards to|dear|hello|yours sincerely|sincerely|kind regards|best regards|fragen sie nach|hallo|liebe|lieber|bonjour|cher|chère|estimado|estimada|hola|pregunte por".split("|"))
#: Fixed: words that make a name the name of a place or a body.
_PLACE = (
    r"lake|mount|river|bay|cape|port|fort|saint|st|bridge|ridge|street|road|avenue|lane|way|square|park|hall|house|school|college|university|hospital|station|museum|library|church|chapel|abbey|castle|tower|mill|harbour|harbor|ferry|canal|island|valley|hill|peak|field|farm|market|"
    r"company|council|committee|society|board|trust|guild|institute|observatory|railway|press|cooperative|line|survey|association|office|union|foundation|prize|award|cup|centre|center|club|route|map|brücke|straße|platz|schule|kirche|pont|lac|rue|musée|école|puente|lago|calle|museo|escuela"
)
_GEO = re.compile(rf"(?:{_PLACE})\Z", re.I)
_PLACE_AFTER = re.compile(rf"[ ](?:{_PLACE})\b", re.I)
_PLACE_BEFORE = re.compile(rf"(?:\b(?:the|{_PLACE})[ ])\Z", re.I)
_AFTER_TITLE = re.compile(rf"(?<![\w.])(?:{_TITLE}){{1,2}}({_WRITTEN}|{_NOT_TITLE}{_CAPW}(?![^\W_]))")
_AFTER_LABEL = re.compile(rf":[ \t]*({_WRITTEN})(?=[ \t]*(?:[\n\r,;|(<.]|\Z))")
_AFTER_BY = re.compile(rf"[ ](?:by|von|par|por)[ ]({_WRITTEN})")
_AFTER_CALL = re.compile(rf",?[ \n\r]{{1,3}}({_WRITTEN})")
_FROM_GIVEN = re.compile(rf"([A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-{_CAPW})?(?:[ ][A-Z]\.)*[ ]{_DESCENT}{_CAPW}(?![^\W_]|['’-]\w))")
_TO_GIVEN = re.compile(rf"(?<![\w'’-])({_CAPW},[ ]\Z)")
_TITLE_HINTS = tuple("Mr Ms Dr Prof Mme Mlle Sr Frau Herr Señ Don Doñ Miss Sir Dame M. MR MS DR FRAU HERR MME".split())
_LAST_WORD = re.compile(r"([^\W\d_]+)[ \t]*\Z")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]+")


#: Given names that settle the case of a name written in lower case throughout; extend by parameter.
GIVEN = frozenset(
    "stefan lukas ingrid hanna daniel felix priya julia carmen nikolai hugo alba clara bruno tomas martin pierre elena lucia victor marta henrik teresa arjun sofia anna ruth emil rafael nadia laura mei vera camille ines kenji paul diego leila kofi andreas greta yusuf oskar olga amara aisha marie simon samir "
    "maria jose john james mary peter thomas michael david sarah emma olivia noah liam lena jonas maja erik karin luis miguel ana jean claire sophie louis chloe fatima omar ali hassan wei li yuki hiro ivan dmitri katya natalia giulia marco luca paolo chiara joao pedro ingeborg klaus jurgen petra sven".split()
)


def _is_name(name: str, titled: bool, given: frozenset) -> bool:
    parts = [p for p in re.split(r"[ ,]+", name) if p]
    low = [p.lower() for p in parts]
    if any(p in _NO_NAME for p in low):  # an initial keeps its full stop
        return False
    if titled:
        return True
    if name.islower() or not all(p[0].isupper() for p in parts):
        return name.islower() and any(p in given for p in low)
    return True


def _beside(t: str, low: str, given: frozenset) -> Iterator[tuple[int, int]]:
    """Names by what stands beside them: a form of address, a label, who did it, who is called; or a given name in a pair of capitalised words.

    Next to a word for places or bodies, or after an article, it is the name of one.
    """

    def person(m: re.Match, titled: bool = False) -> bool:
        a, b = m.span(1)
        written = [p.lower() for p in re.split(r"[ ,]+", m.group(1)) if p[:1].isupper()]
        if any(p in _NO_NAME or _GEO.match(p) for p in written) or _PLACE_AFTER.match(t, b):
            return False
        return titled or not _PLACE_BEFORE.search(t[max(0, a - 20) : a])

    def word_before(at: int) -> str:
        m = _LAST_WORD.search(t[max(0, at - 30) : at])
        return m.group(1).lower() if m else ""

    if any(h in t for h in _TITLE_HINTS):
        yield from (m.span(1) for m in _AFTER_TITLE.finditer(t) if person(m, True))
    if ":" in t:
        yield from (m.span(1) for m in _AFTER_LABEL.finditer(t) if word_before(m.start()) in _LABEL and person(m))
    if any(h in t for h in (" by ", " von ", " par ", " por ")):
        yield from (m.span(1) for m in _AFTER_BY.finditer(t) if word_before(m.start()) in _DONE and person(m))
    for call in _CALLS:
        at = low.find(call)
        while at >= 0:
            m = _AFTER_CALL.match(t, at + len(call)) if len(low) == len(t) and (at == 0 or not t[at - 1].isalnum()) else None
            if m and person(m):
                yield m.span(1)
            at = low.find(call, at + 1)
    for w in _CAPITAL.finditer(t):
        if w.group().lower() in given and not t[w.start() - 1 : w.start()].isalnum():
            m = _FROM_GIVEN.match(t, w.start())
            if m and person(m):
                yield m.span(1)
                continue
            at = max(0, w.start() - 40)
            m = _TO_GIVEN.search(t[at : w.start()])
            if m and not t[w.end() : w.end() + 1].isalnum() and not _GEO.match(m.group(1)[:-2]) and m.group(1)[:-2].lower() not in _NO_NAME:
                end = re.compile(r"(?:[ ][A-Z]\.)*").match(t, w.end()).end()
                yield at + m.start(1), end


def find(text: str | None, given: frozenset = GIVEN, beside: bool = True) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in source characters, in order, without overlaps.

    Where kinds compete: e-mail, then identity number, phone, street address, name.
    """
    if not text:
        return []
    view = normalise(text)
    t = view.text
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or y <= a for x, y, _ in found):
            found.append((a, b, kind))

    if "@" in t:
        for m in _EMAIL.finditer(t):
            add(*m.span(), "email")
    low = t.lower()
    if any(h in low for h in _ID_HINTS) or any(h in t for h in ("DNI", "NIE", "TIN", "NINO")):
        for m in _ID.finditer(t):
            if any(c.isdigit() for c in m.group(1)):
                add(*m.span(1), "id_number")
    for m in _PHONE.finditer(t):
        if not _NO_PHONE.search(t[max(0, m.start() - 24) : m.start()]):
            add(*m.span(), "phone")
    for on, rx in ((True, _EN), (any(h in low for h in _DE_HINTS), _DE), (any(h in low for h in _FR_HINTS), _FR), (any(h in low for h in _ES_HINTS), _ES)):
        if on:
            for m in rx.finditer(t):
                a, b = m.span(1)
                while t[b - 1] in " ,":
                    b -= 1
                add(a, b, "street_address")
    for lit, rx in _CONTEXTS:
        if lit not in low:
            continue
        for m in rx.finditer(t):
            for tag, val in m.groupdict().items():
                if val and _is_name(val, tag.endswith("t"), given):
                    add(*m.span(tag), "person_name")
    if beside:
        for span in _beside(t, low, given):
            add(*span, "person_name")
    return sorted((*view.back(a, b), k) for a, b, k in found)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


def scan(df: DataFrame, key: str, text: str, given: frozenset = GIVEN) -> DataFrame:
    """(key, redacted, spans): one row per row of ``df``; spans hold kind, value, start and length in characters.

    Defined results: a null text stays null with no spans, an empty one stays empty; texts without
    personal information come out unchanged; repeated rows are handled each; other columns are not read.
    """
    narrow = df.select(key, text)
    kt = narrow.schema[0].dataType.simpleString()
    span_t = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            red, spans = [], []
            for t in b.column(1):
                t = t.as_py()
                s = find(t, given)
                red.append(redact(t, s))
                spans.append([{"kind": k, "value": t[x:y], "start": x, "length": y - x} for x, y, k in s])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(red, pa.string()), pa.array(spans, span_t)], names=[key, "redacted", "spans"])

    return narrow.mapInArrow(run, f"`{key}` {kt}, redacted string, spans array<struct<kind:string,value:string,start:int,length:int>>")
