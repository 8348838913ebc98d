"""Problem 5: personal information inside free text.

Mentions (e-mail, phone, identity number, address, name) are found by their form and the words around them. A name is a run
of capitalised words that a title, an initial or a given name opens, or of two words or more that are no ordinary words; given
names are a fixed list and those that the catalogue's column of names shows often enough. Which words are ordinary the corpus
tells: counts of small-letter words over all texts, joined to the rows concerned.

Every distinct entity then gets a surrogate: a keyed hash (HMAC) picks digits, letters and names of the same type, format,
script and gender. Names are replaced word by word, so one person keeps one surrogate in every form (coreference). Surrogates
that two entities share, or that are themselves entities of the corpus, are drawn again until none is left (distinctness).
The text comes out twice: with plain typed placeholders, and with surrogates.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.names import FEMALE_GIVEN, GIVEN, LEGAL, LONG_LINES, MALE_GIVEN, NICKNAMES, plain
from docketry.operators.keyword import folded
from docketry.session import FEW, cut, few

KINDS = ("email", "phone", "id_number", "address", "name")
UP = "A-ZÀ-ÖØ-ÞŠŽĀĒĪŌŪÕÃ"
WORD = rf"[{UP}][\w’'-]*"

EMAIL = re.compile(
    r"(?<![\w.+-])[\w][\w.+'-]*\s?(?:[@＠]|\(at\)|\[at\]|\{at\}|(?<=\s)at(?=\s\w+(?:\s?\[dot\]|\s?\(dot\)|\sdot\s)))\s?[\w-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)[\w-]+)+", re.I
)
FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|apto\.?|apt\.?|App\.?|Wohnung|piso|\d+\.\s?[ºª°]\s?(?:[A-Z]\w*\.?)?|\d+[ºª°]\s?(?:[A-Z]\w*\.?)?)\s?\d*\w?"
TAIL = rf"(?:,\s{FLAT})?(?:,?\s(?:[A-Z]{{1,2}}-)?\d{{4,5}}(?:-\d{{3}})?(?:\s{WORD})?|,\s{WORD}(?:\s(?:\d{{4,6}}(?:-\d{{3}})?|[A-Z]{{1,2}}\d[\dA-Z]?\s\d[A-Z]{{2}}))?)?"
# Words of streets, by where they stand: behind the number and a name, between both, at the end of a name, in front of it.
STREETS_AFTER = "Street|St|Road|Rd|Lane|Ln|Sq|Square|Avenue|Ave|Drive|Dr|Close|Way|Court|Ct|Terrace|Place|Pl|Gardens|Crescent|Boulevard|Blvd"
STREETS_BETWEEN = r"rue|avenue|av\.|boulevard|bd|place|chemin|impasse|quai|allée|cours|route"
STREET_ENDS = r"straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer"
STREETS_FIRST = r"Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Paseo|Rua|R\.|Travessa|Tv\.|Largo|Praça|Alameda|Estrada|Rod\."
ADDRESS = re.compile(
    r"(?<![\w-])(?:"
    rf"(?:{FLAT},\s)?\d+[A-Za-z]?\s(?:{WORD}\s){{1,2}}(?:{STREETS_AFTER})\b\.?{TAIL}"
    rf"|\d+(?:\s?(?:bis|ter))?,?\s(?:{STREETS_BETWEEN})\s(?:de\sla\s|du\s|des\s|de\s|d[’'])?{WORD}{TAIL}"
    rf"|{WORD}(?:{STREET_ENDS})\s\d+\s?[a-z]?\b{TAIL}"
    rf"|(?:{STREETS_FIRST})\s?(?:do\s|da\s|dos\s|das\s|de\sla\s|del\s|de\s)?{WORD}(?:\s{WORD})?,?\s(?:n\.?\s?[ºo°]\s?)?\d+[A-Za-z]?\b{TAIL}"
    r")"
)
PHONE = re.compile(
    r"(?<![\w.,/+-])(?:\+\d{1,3}[ .-]?(?:\(0\)\s?)?(?:\(\d{1,4}\)\s?)?\d[\d .-]{5,16}\d|00\d{2}[-. ]\d{2,4}[-. ]\d{4,8}|\(\d{2,4}\)\s?\d{3,5}[-. ]\d{4}|0\d{4} \d{3} \d{3}|0\d{2,3} \d{4} \d{4}|0\d{4} \d{6}"
    r"|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}|0\d(?:[. ]\d{2}){4})(?:,?\s?(?:ext|x|Durchwahl|ramal)\.?\s?\d{1,5})?(?![\w]|[.,-]\d)"
)
ID_WORDS = (
    r"(?:SSN|SIN|social\s+security(?:\s+(?:number|no\.?))?|national\s+insurance(?:\s+(?:number|no\.?))?|NI\s+(?:number|no\.?)|NINO|tax\s+(?:number|no\.?|id)|passport(?:\s+(?:number|no\.?|n\.?º))?|passeport(?:\s+n[°º]\.?)?|"
    r"pasaporte|passaporte|Reisepass(?:\s?nummer|-?Nr\.?)?|driving\s+licen[cs]e(?:\s+(?:number|no\.?))?|driver'?s\s+licen[cs]e|Führerschein|CNH|permis\s+de\s+conduire|ID\s+card|identity\s+card|(?:Personal)?[Aa]usweis(?:-?\s?Nr\.?|nummer)?|carte\s+d[’']identité(?:\s+n[°º]\.?)?|Steuer-?ID|"
    r"CPF|RG|NIF|NIE|DNI|CNI|NIR|TIN|IRPF)"
)
ID_CODE = r"(?:[A-Z]{1,2}[ -]?)?\d(?:[\dA-Z]|[ .\-/](?=[\dA-Z])){4,16}(?:[ -]?[A-Z](?![\w]))?"
ID_NUMBER = re.compile(
    rf"(?<![\w.-])(?=[SsNnTtPpRrDdFfCcIiAaUuEeOoJ]){ID_WORDS}[\s:.#]{{1,3}}(?:n[°º.]{{1,2}}\s)?({ID_CODE})"
    r"|(?<![\w.-])(\d{3}\.\d{3}\.\d{3}-\d{2}|\d{2}\.\d{3}\.\d{3}-[\dXx]|QQ \d{2} \d{2} \d{2} [A-D]|(?<!\d)\d{8}[A-HJ-NP-TV-Z](?!\w)|[XYZ]\d{7}[A-Z])(?![\w-])"
)
# Titles in front of a name.
TITLES = {"Mr", "Mrs", "Ms", "Miss", "Dr", "Dra", "Prof", "Profa", "Sr", "Sra", "Srta", "Eng", "Enga", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Don", "Doña", "Dona", "Me", "Sir"}
# Capitalised words that begin a sentence or a label, and words of organisations, which are no family names.
NO_FAMILY = set(
    "call ask tell meet ring dear hello hi attn thanks note after before when then also but the a an o os as um uma if in on at is it not and for from per please moved last seen new kind regards spoke callback write send verified identity signed counsel our this that these those there no yes we you he she they what which who how when where why "
    "does do did has have summons email phone mobile tel contact page see lot invoice clause both nothing anything according upon damage payment subject attached annexes lines costs between neither opposing "
    "em de do da el la los las le les der die das und il elle un une não nem há na no nas nos ao aos à às se para por como segundo conferido documento cadastro contato enviar ligar falei até salvo intimar atenciosamente fica aplica encontrei resuma qual quem "
    "las según identificación enviar llamar escribir hablé compareció domicilio selon écrire appeler domicile le laut bitte rückruf wohnhaft am im ein eine der niemand nach keine kein "
    "nif cpf rg dni ssn ni passport driving licence social security llc ltd plc inc llp gmbh kg ag sa lda ltda sarl sas street road lane square sq avenue ave".split()
)
ORGANIZATION_WORDS = LEGAL | set(LONG_LINES) | {"sons", "partners", "bros", "filhos", "hijos", "fils", "sohne"}
# Legal forms that are no ordinary words when written small.
SMALL_LEGAL = set("plc ltd inc llc llp lda ltda gmbh sarl limited incorporated".split())
POSSESSIVE = re.compile(r"[’']s$")


def _letters(test) -> str:
    """The Latin, Greek and Cyrillic letters that pass a test, as ranges of a character class."""
    codes = [c for block in ((0x41, 0x530), (0x1E00, 0x2000)) for c in range(*block) if test(chr(c))]
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


BIG, LOW = _letters(str.isupper), _letters(str.islower)
# Words between the parts of a name that stay small.
PARTICLES = "de la|de las|de los|van der|van den|von der|de|da|do|dos|das|del|della|di|du|von|van|vom|zu|zum|zur|ter|ten|bin|ibn|al|el|bint|af|av"
NAME_WORD = rf"(?:[{BIG}][’'](?=[{BIG}]))?[{BIG}]\w*(?:(?:[’'](?=[{BIG}])|-(?=[{BIG}{LOW}]))\w+)*"
ELEMENT = rf"(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.|[{BIG}]\.(?:-?[{BIG}]\.)*|{NAME_WORD})"
RUN = re.compile(rf"(?<![\w@./’'-])(?=[{BIG}]){ELEMENT}(?:[ ]?(?<=[ .])(?:(?:{PARTICLES})[ ])?{ELEMENT})+")
PART = re.compile(rf"((?:^|[ ]?)(?:(?:{PARTICLES})[ ])?)({ELEMENT})")
HAN_NAME = re.compile(r"[一-鿿々]{2,4}(?:[ \u3000][一-鿿々]{1,3})?(?=\s?(?:様|さん|氏|殿|先生|君)(?!\w*々))")
SMALL = re.compile(rf"(?<![\w@./’'-])[{LOW}]\w*(?:[’'-][{LOW}]\w+)*")
SMALL_FAMILY = re.compile(rf"([ ](?:[{LOW}]\.[ ]?)*(?:(?:{PARTICLES})[ ])?)([{LOW}]\w+(?:[’'-][{LOW}]\w+)*)(?![\w@]|[.:-]\w)")
FAMILY = re.compile(rf"((?:[ ](?:[{BIG}]\.[ ]?)+|[ ])(?:(?:{PARTICLES})[ ])?)({NAME_WORD})")
STREET_BEFORE = re.compile(r"(?:\b(?:rua|calle|rue|avenida|avenue|av\.|travessa|largo|praça|plaza|place|paseo|alameda|estrada|улица|ул\.|οδός)\s(?:d[aeou]s?\s|de\sla\s|del\s)?|[\w.]@)$", re.I)
# Prepositions of place; two unknown capitalised words after one are a place.
PLACE_BEFORE = re.compile(r"\b(?:in|at|near|em|en|nach|aux|в|во|на|στην|στο)\s(?:the\s|the\sof\s)?$", re.I)
# Articles and the like; capitalised words after one are a thing.
DETERMINERS = "the|a|an|this|that|its|his|her|their|our|my|os|as|um|uma|el|la|los|las|un|una|lo|il|le|les|une|der|die|das|dem|den|des|ein|eine|einem|einen|einer|mein|sein|ihr|unser|kein|keine|ce|cette|son|sa|leur"
THING_BEFORE = re.compile(rf"(?<!\w)(?:{DETERMINERS})\s$", re.I)
NEXT_WORD = re.compile(r"[ ,]{1,2}(?:& |and |e |y |und |et )?([\w./&]+)")
# Words of streets, places and offices; a name does not stand before one.
PLACE_WORDS = set(
    "street road lane square sq avenue ave drive close way court terrace place gardens crescent boulevard blvd house building tower park bridge station airport river lake mount island city town county state kingdom states republic union "
    "tribunal ministry department office bureau agency council committee commission board university college school institute hospital church museum bank fund trust foundation association federation society club team".split()
)
# Words of parts of documents, calendars, directions, streets and offices that are no part of a name.
NO_NAME = PLACE_WORDS | set(
    "north south east west supreme high district party act art article section sec clause annex schedule appendix chapter paragraph "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro "
    "enero febrero marzo mayo junio julio septiembre octubre noviembre diciembre januar februar märz juni juli oktober dezember janvier février avril juin juillet août septembre octobre novembre décembre "
    "rua calle rue avenida travessa largo praça plaza paseo alameda estrada tribunal juzgado amtsgericht landgericht bundesgerichtshof cour conseil ministério ministerio prefeitura câmara universidade universidad université universität instituto banco banque escritório fundação fundación".split()
)
# Titles that are no ordinary words when written small.
SMALL_TITLES = set("mr mrs ms dr dra prof profa sr sra srta herr frau mme mlle monsieur madame doña dona".split())
# Given names that are ordinary words when written small; before a capital they open nothing.
WORDS_TOO = set("will bill sue mark drew max pat rob dick ed lu bel rose grace may june april frank jack ray art dan hope joy faith chase grant guy dawn ivan".split())
# Ordinary words that follow a given name or title in small letters, besides those of NO_FAMILY.
COMMON = set(
    "and but or nor than then who whose whom which that with without by of to into onto over under after before about against between during since until also too only just again now today tomorrow yesterday soon later never always often "
    "is are was were be been being am has had having can could may might must shall should will would lives lived said says told asked asks wrote writes called calls came comes went goes left leaves gave gives took takes paid pays sent sends signed signs met meets "
    "agreed confirmed refused declined replied answered owes owns wants needs thinks knows made makes got gets put keeps kept held holds found finds lost sold bought brought works worked tree plant payable due number account book month year "
    "com sem sob sobre mas ou que também já ainda ontem hoje amanhã foi era está são tem tinha mora reside disse ligou pediu pagou assinou enviou quer deve pode vai veio "
    "con sin pero que también ya todavía ayer hoy mañana fue era está son tiene tenía vive reside dijo llamó pidió pagó firmó envió quiere debe puede va vino "
    "mit ohne aber oder dass auch schon noch gestern heute morgen ist war sind hat hatte wohnt sagte rief bat zahlte schickte will muss kann wird kam unter "
    "avec sans mais ou que aussi déjà encore hier demain est était sont habite demeure dit appelle paie envoie veut doit peut va vient sous chez dans sur".split()
)
SMALL_TITLE = re.compile(rf"\b(?:{'|'.join(sorted(SMALL_TITLES))})\.? [{LOW}]")


def _loose(pattern: str) -> str:
    """A pattern for RE2 that matches at least where `pattern` does in Python: its letters, digits and blanks are all those that Python may take for such."""
    bodies = {"w": r"0-9A-Za-z_\x{80}-\x{10FFFF}", "d": r"0-9\x{300}-\x{1FFF}\x{2100}-\x{10FFFF}", "s": r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"}
    for sign, body in bodies.items():
        pattern = pattern.replace(f"[\\{sign}", f"[{body}").replace(f"\\{sign}", f"[{body}]")
    return pattern


# What a text must hold for the patterns above to match, asked of a whole batch at once: the same without what looks around and without the ends.
MAY = {
    "email": r"@|＠|\(at\)|\[at\]|\{at\}| dot |\[dot\]",
    "address": _loose(
        rf"\d[A-Za-z]?\s(?:{WORD}\s){{1,2}}(?:{STREETS_AFTER})|\d(?:\s?(?:bis|ter))?,?\s(?:{STREETS_BETWEEN})\s|(?:{STREET_ENDS})\s\d"
        rf"|(?:{STREETS_FIRST})\s?(?:do\s|da\s|dos\s|das\s|de\sla\s|del\s|de\s)?{WORD}(?:\s{WORD})?,?\s(?:n\.?\s?[ºo°]\s?)?\d"
    ),
    "id_number": _loose(
        rf"{ID_WORDS}[\s:.#]{{1,3}}(?:n[°º.]{{1,2}}\s)?(?:[A-Z]{{1,2}}[ -]?)?\d|\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}|\d{{2}}\.\d{{3}}\.\d{{3}}-[\dXx]|QQ \d{{2}} \d{{2}}|\d{{8}}[A-HJ-NP-TV-Z]|[XYZ]\d{{7}}[A-Z]"
    ),
    "phone": _loose(r"\+\d|00\d{2}[-. ]\d{2}|\(\d{2,4}\)\s?\d{3,5}[-. ]\d{4}|0\d{4} \d{3}|0\d{2,3} \d{4} \d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}|0\d(?:[. ]\d{2}){4}"),
    "run": _loose(rf"(?:[{BIG}][\w’'-]* |(?:{'|'.join(sorted(TITLES))}|[{BIG}])\. ?)(?:(?:{PARTICLES}) )?[{BIG}]"),
    "han": "[一-鿿々]{2}",
    "small": rf"(?:{'|'.join(sorted(SMALL_TITLES))})\.? [{LOW}]",
}


def _may(texts_: pa.Array) -> np.ndarray:
    """Which of MAY each text holds, as the bits of a number. NULL holds none."""
    out = np.zeros(len(texts_), np.int64)
    for bit, pattern in enumerate(MAY.values()):
        out |= pc.match_substring_regex(texts_, pattern).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64) << bit
    return out


_BITS = {k: 1 << bit for bit, k in enumerate(MAY)}
SEEDS = frozenset(GIVEN | set(NICKNAMES))
SMALL_SEEDS = SEEDS - WORDS_TOO


@lru_cache(200_000)
def _fold(word: str) -> str:
    """What a given name is looked up by: its first part, small, without accents."""
    return plain(word.split("-")[0])


@lru_cache(200_000)
def _organization_word(word: str) -> bool:
    if word.islower() and "." not in word.strip(".") and word not in SMALL_LEGAL:
        return False
    return plain(re.sub(r"[./&]", "", word)) in ORGANIZATION_WORDS or word.lower().endswith(("straße", "strasse", "gericht"))


def _family(word: str, ordinary: Collection[str]) -> bool:
    low = word.lower()
    return len(word) > 1 and low not in NO_FAMILY and low not in NO_NAME and low not in ordinary and not (len(word) > 3 and low == "will")


def _capital_names(text: str, ordinary: Collection[str] = (), known: Collection[str] = ()) -> tuple[list[tuple[int, int, list[str]]], bool]:
    """Start, end and (where only the form shows a name) its words in small letters, of names written with capitals; and whether more given names could change the outcome. `known`: given names besides the fixed ones.

    A run of capitalised words, initials and titles, joined by single spaces and particles, is cut where an ordinary word stands.
    A stretch is a name if a title, an initial or a known given name opens it and a family name follows, or if it has two words
    or more of mixed case; not if words of an organisation, a street or a place belong to it.
    """
    out: list[tuple[int, int, list[str]]] = []
    unsure = False
    for run in RUN.finditer(text):
        parts = [(m.start(2) + run.start(), m[2]) for m in PART.finditer(run[0])]
        i = 0
        while i < len(parts):
            at, first = parts[i]
            titles, j, words, initials = 0, i, [], 0
            end = at
            lead_upper = None
            while j < len(parts):
                pos, part = parts[j]
                bare = part.rstrip(".")
                if bare in TITLES or (len(bare) > 2 and bare.isupper() and bare.title() in TITLES):
                    if words or initials:
                        break
                    titles, j = titles + 1, j + 1
                    continue
                if part.endswith("."):
                    initials, j = initials + 1, j + 1
                    continue
                word = POSSESSIVE.sub("", part)
                if len(word) == 1 and words and j + 1 < len(parts):  # a middle initial without its point
                    initials, j = initials + 1, j + 1
                    continue
                shout = word.isupper() and len(word) > 1
                if not _family(word, ordinary) or _organization_word(word) or (words and shout and not lead_upper and len(word) > 2):
                    break
                lead_upper = shout if not words else lead_upper
                words.append(word)
                end = pos + len(word)
                j += 1
                if word != part:
                    break
            if words and (len(words) > 1 or titles or initials):  # one word alone is no name
                nxt = NEXT_WORD.match(text, end)
                inside = bool(nxt and _organization_word(nxt[1])) or bool(j < len(parts) and _organization_word(parts[j][1]))
                street = bool(j < len(parts) and parts[j][1].lower() in PLACE_WORDS) or bool(STREET_BEFORE.search(text, max(0, at - 24), at))
                given = (low := _fold(words[0])) in SEEDS or low in known
                opened = (titles and (len(words) > 1 or initials or not given)) or (not titles and initials and parts[i][1].endswith(".")) or (given and len(words) > 1)
                by_form = not opened and len(words) > 1 and not lead_upper and not PLACE_BEFORE.search(text, max(0, at - 14), at) and not THING_BEFORE.search(text, max(0, at - 10), at)
                if not inside and not street:
                    if opened or by_form:
                        out.append((at, end, [] if opened else [w.lower() for w in words]))
                    unsure |= not given and ((len(words) > 1 and not opened and not by_form) or bool(titles and len(words) == 1 and not initials))
            i = max(j, i + 1)
    return out, unsure


def _small_names(text: str, ordinary: Collection[str] = (), known: Collection[str] = SMALL_SEEDS) -> list[tuple[int, int, list[str]]]:
    """Start, end and the small-letter family words of names opened in small letters; words of `ordinary` and fixed common words are no family names."""
    out, done = [], 0
    if not known and not SMALL_TITLE.search(text):
        return out
    for m in SMALL.finditer(text):
        title = m[0] in SMALL_TITLES
        if m.start() < done or not (title or _fold(m[0]) in known) or STREET_BEFORE.search(text, max(0, m.start() - 24), m.start()):
            continue
        end = m.end() + (title and text[m.end() : m.end() + 1] == ".")
        if title and (g := SMALL_FAMILY.match(text, end)) and _fold(g[2]) in known and SMALL_FAMILY.match(text, g.end(2)):
            end = g.end(2)
        words, small = 0, []
        while f := SMALL_FAMILY.match(text, end) or (FAMILY.match(text, end) if m[0] not in WORDS_TOO or small else None):
            word = POSSESSIVE.sub("", f[2])
            if not _family(word, ordinary) or len(word) < 3 or word in COMMON or _organization_word(word) or (small and not word[0].islower()) or (words > len(small) and word[0].islower()):
                break
            words += 1
            small += [word] if word[0].islower() else []
            end = f.start(2) + len(word)
        after = FAMILY.match(text, end) or SMALL_FAMILY.match(text, end)
        if words and not (after and _organization_word(after[2])):
            out.append((m.start(), end, small))
            done = end
    return out


def mentions(text: str | None, ordinary: Collection[str] | None = (), known: Collection[str] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of position; spans do not overlap. NULL and blank texts have none.

    `ordinary`: words of the text that the corpus shows to be ordinary words; None: no name is opened in small letters.
    `known`: the given names of the text that may stand in small letters (small, without accents); by default the fixed ones.
    """
    return _scan(text, ordinary, known, int(_may(pa.array([text]))[0]))[0] if text else []


def _scan(text: str, ordinary: Collection[str] | None, known: Collection[str] | None, may: int) -> tuple[list[tuple[str, int, int]], list[str], bool]:
    """The mentions of a text, the words of its names that only the corpus can tell from ordinary words, and whether more given names could change the outcome. `may`: what `_may` says of it."""
    pending: list[str] = []
    spans: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        if not any(a < y and x < b for _, x, y in spans):
            spans.append((kind, a, b))

    if may & _BITS["email"]:
        for m in EMAIL.finditer(text):
            a = m.start() + (7 if m[0].lower().startswith("mailto:") else 0)
            add("email", a, m.end() - (m[0][-1] in "_-"))
    if may & _BITS["address"]:
        for m in ADDRESS.finditer(text):
            add("address", m.start(), m.end())
    if may & _BITS["id_number"]:
        for m in ID_NUMBER.finditer(text):
            g = 1 if m[1] else 2
            add("id_number", m.start(g), m.end(g))
    if may & _BITS["phone"]:
        for m in PHONE.finditer(text):
            add("phone", m.start(), m.end())
    rest, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1]):  # no name runs into what is found already
        rest += [text[at:a], "\0" * (b - a)]
        at = b
    text = "".join([*rest, text[at:]])
    names, unsure = _capital_names(text, ordinary or (), known or ()) if may & _BITS["run"] else ((), False)
    for a, b, words in names:
        add("name", a, b)
        pending += words
    if may & _BITS["han"]:
        for m in HAN_NAME.finditer(text):
            add("name", m.start(), m.end())
    for a, b, words in _small_names(text, ordinary, SMALL_SEEDS if known is None else known) if ordinary is not None and (known is None or known or may & _BITS["small"]) else ():
        add("name", a, b)
        pending += words
    return sorted(spans, key=lambda s: s[1]), pending, unsure


_HIT = "src string, record_id string, kind string, nth int, start int, end int, value string"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mentions of each text. Where no evidence comes with it (two columns less), the words of names that only the corpus can judge come out as well, as kind `?`, and texts that more given names could change, as kind `!`."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows = []
        first = batch.num_columns == 3
        may = _may(batch.column(2))
        if first:  # the rest has no mentions
            batch, may = batch.filter(pa.array(may > 0)), may[may > 0]
        for m, s, i, t, *evidence in zip(may.tolist(), *(c.to_pylist() for c in batch.columns)):
            ordinary, known = evidence or ((), ())
            spans, pending, unsure = _scan(t, ordinary or (), known or (), m)
            seen = dict.fromkeys(KINDS, 0)
            for kind, a, b in spans:
                seen[kind] += 1
                rows.append((s, i, kind, seen[kind], a, b, t[a:b]))
            if first:
                rows += [(s, i, "?", None, None, None, w) for w in pending]
                rows += [(s, i, "!", None, None, None, None)] * unsure
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["src", "record_id", "kind", "nth", "start", "end", "value"])


def texts(people: DataFrame, cases: DataFrame, messages: DataFrame) -> DataFrame:
    """src, record_id, text of the three free-text columns, all rows."""
    parts = [t.select(F.lit(s).alias("src"), F.col("id").alias("record_id"), F.col(c).alias("text")) for t, s, c in ((people, "people", "notes"), (cases, "cases", "description"), (messages, "messages", "content"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- what the corpus tells ---------------------------------------------------------------------------------------------

#: A given name of the catalogue counts as one when it stands before so many different names.
BEARERS = 3


def given_names(names: DataFrame) -> DataFrame:
    """word, bearers: given names (small, without accents) learned from a column `full_name`: the first word without titles, after the comma if there is one, that at least BEARERS different names share. NULL and blank names teach nothing."""
    own = F.when(F.contains("full_name", F.lit(",")), F.trim(F.split_part("full_name", F.lit(","), F.lit(2)))).otherwise(F.trim("full_name"))
    bare = F.regexp_replace(own, rf"(?i)^(?:(?:{'|'.join(sorted(TITLES))})\.?\s+)+", "")
    word = F.regexp_extract(folded(bare), r"^([\p{L}]{3,})(?=[\s-])", 1)
    return names.select(word.alias("word"), folded("full_name").alias("name")).filter("word <> ''").groupBy("word").agg(F.approx_count_distinct("name").alias("bearers")).filter(F.col("bearers") >= BEARERS)


_SMALL_WORD = r"(?<![\p{L}\p{N}_@./’'-])\p{Ll}[\p{L}\p{N}_]*(?:[’'-]\p{Ll}[\p{L}\p{N}_]+)*"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, record_id, word: the words of possible names that only the corpus can tell from ordinary words."""
    for batch in batches:
        rows = [(s, i, w) for m, s, i, t, g in zip(_may(batch.column(2)).tolist(), *(c.to_pylist() for c in batch.columns)) for w in _scan(t, (), g, m)[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(3)], names=["src", "record_id", "word"])


def hits(rows: DataFrame, names: DataFrame) -> DataFrame:
    """src, record_id, kind, nth, start, end, value: one row per mention of rows with an id and a text, each id once (repeated rows are identical, so it is their few mentions that are made distinct, not the texts).

    Every text is read once as it is. Two things only the corpus knows: which given names there are besides the fixed ones
    (`names`: word, bearers; one that stands in small letters more often than it has bearers, a word that is a name, too, opens
    nothing), and which words of a possible name stand in small letters outside such names at least as often as inside (they are
    ordinary words). The few rows that hold such names or words are read once more with them. Words are counted by distributed
    sums over all texts; only small lists are broadcast (`few`), longer ones are shuffled.
    """
    rows = rows.filter("record_id IS NOT NULL AND text <> ''").select("src", "record_id", "text")
    row = ["src", "record_id"]
    small = rows.select(F.explode(F.regexp_extract_all("text", F.lit(_SMALL_WORD), F.lit(0))).alias("word"))
    uses = cut(small.groupBy("word").agg(F.count("*").alias("uses")))
    by_fold = uses.groupBy(F.regexp_extract(folded("word"), r"^[^-]+", 0).alias("word")).agg(F.sum("uses").alias("uses"))
    seeds = rows.sparkSession.createDataFrame([(w,) for w in sorted(SMALL_SEEDS)], "word string")
    given = cut(names.join(by_fold, "word", "left").filter(F.coalesce("uses", F.lit(0)) <= F.col("bearers")).select("word").unionByName(seeds).distinct())
    # Given names written small or all in capitals open names that nothing else shows; in other texts they matter only where the first reading was unsure.
    spoken = rows.select(*row, F.explode(F.split(folded("text"), r"\P{L}+")).alias("word")).filter(F.length("word") > 2)
    known = cut(spoken.join(few(given), "word").groupBy(*row).agg(F.collect_set("word").alias("known")))
    first = cut(rows.mapInArrow(_find, _HIT).distinct())
    unsure = first.filter("kind = '!'").select(*row).distinct().withColumn("unsure", F.lit(True))
    bare = F.split(folded(F.concat_ws(" ", F.regexp_extract_all("text", F.lit(r"(?<!\p{L})(?:\p{Ll}[\p{L}\p{M}]{2,}|\p{Lu}{3,})(?!\p{L})"), F.lit(0)))), " ")
    matters = cut(rows.join(few(known), row).join(unsure, row, "left").filter(F.col("unsure") | F.arrays_overlap("known", bare)).select(*row, "known").dropDuplicates(row))
    again = rows.join(few(matters), row).select(*row, "text", "known").mapInArrow(_candidates, "src string, record_id string, word string")
    pending = cut(first.filter("kind = '?'").select(*row, F.col("value").alias("word")).join(matters, row, "left_anti").unionByName(again))
    inside = pending.groupBy(folded("word").alias("fold"), "word").agg(F.count("*").alias("inside"))
    ordinary = inside.join(uses, "word").filter(F.col("uses") - F.col("inside") >= F.col("inside")).join(given.withColumnRenamed("word", "fold"), "fold", "left_anti").select("word")  # a given name stays one
    common = pending.join(ordinary, "word").groupBy(*row).agg(F.collect_set("word").alias("ordinary"))
    evidence = cut(common.join(known.select(*row, "known"), row, "left").unionByName(matters.join(common, row, "left_anti").select(*row, F.lit(None).cast("array<string>").alias("ordinary"), "known")))
    second = rows.join(few(evidence), row).select(*row, "text", "ordinary", "known").mapInArrow(_find, _HIT).distinct()
    return first.filter("kind NOT IN ('?', '!')").join(evidence, row, "left_anti").unionByName(second)


# --- surrogates --------------------------------------------------------------------------------------------------------

# Given names for surrogates, by script and gender, and what syllables are put together from: beginnings, vowels, ends.
FEMALE = "Alma Bruna Carla Diana Edith Flora Greta Hilda Irene Julia Klara Lydia Mina Nadia Olga Paula Renata Silvia Tilda Vera".split()
MALE = "Adam Boris Cesar Dario Emil Felix Georg Hugo Igor Julius Kurt Leo Marco Nico Otto Pavel Roman Simon Tobias Viktor".split()
POOLS = {
    "L": (FEMALE, MALE, ("b br c d f fr g gr h j k l m n p pr r s st t tr v w z".split(), "aeiou", ["", "l", "n", "r", "s"])),
    "C": ("Алла Вера Дарья Зоя Инна Клара Лидия Нина Римма Тамара".split(), "Антон Борис Вадим Глеб Денис Ефим Захар Кирилл Леонид Роман".split(), ("б бр в г гр д з к л м н п пр р с ст т х".split(), "аеиоу", ["", "л", "н", "р", "с"])),
    "G": ("Άννα Βέρα Δάφνη Ζωή Ηρώ Κλειώ Λήδα Μυρτώ Νίκη Φαίη".split(), "Άρης Βίκτωρ Δίων Ηλίας Θάνος Κίμων Λέων Μάνος Πάρις Φώτης".split(), ("β βρ γ δ ζ κ λ μ ν π ρ σ στ τ φ".split(), "αειου", ["", "λ", "ν", "ρ", "σ"])),
    "H": ("花 葵 凛 結 咲 美 雪 舞 鈴 恵".split(), "蓮 翔 健 誠 徹 拓 亮 剛 学 勇".split(), ("北 南 西 東 森 林 原 田 村 井 沢 浜 島 岡 坂 谷 橋 石 池 川".split(), "山野木本田口", [""])),
}
ALPHABETS = {"L": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "C": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "G": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}
# Titles that show a gender.
FEMALE_TITLES = set("mrs ms miss dra profa sra srta enga frau mme mlle madame doña dona".split())
MALE_TITLES = set("mr sr eng herr monsieur don sir".split())


def script(text: str) -> str:
    """Latin, Cyrillic, Greek or Han, by the first letter that shows one."""
    for c in text:
        if "一" <= c <= "鿿":
            return "H"
        if "Ѐ" <= c <= "ԯ":
            return "C"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "G"
        if c.isalpha():
            return "L"
    return "L"


def _words(value: str) -> list[tuple[str, str]]:
    """The parts of a name with their roles: title, initial, particle, given, family."""
    parts = [(p, "title" if p.strip(".") in TITLES or p.strip(".").lower() in SMALL_TITLES else "initial" if len(p.rstrip(".")) == 1 or re.fullmatch(r"(?:\w\.-?)+", p) else "word") for p in re.split(r"[ \u3000]", value) if p]
    full = [k for k, (p, r) in enumerate(parts) if r == "word" and not (p.islower() and re.fullmatch(PARTICLES, p) and 0 < k < len(parts) - 1)]
    role = lambda k, r: r if r != "word" else "particle" if k not in full else "given" if k == full[0] and len(full) > 1 else "family"
    return [(p, role(k, r)) for k, (p, r) in enumerate(parts)]


def _keys(part: str) -> list[str]:
    """The words of a part that carry a surrogate of their own, small and without accents."""
    return [plain(w) for w in part.rstrip(".").split("-")]


def entity(kind: str, value: str) -> str:
    """What spellings of one entity have in common: letters and digits; of a name its words and initials without title and particles."""
    if kind == "name":
        return " ".join("-".join(_keys(p)) for p, r in _words(value) if r not in ("title", "particle"))
    low = plain(value)
    if kind == "email":
        low = re.sub(r"\s?[\[({](at|dot)[\])}]\s?| (at|dot) ", lambda m: "@" if "at" in m[0] else ".", low)
        return re.sub(r"\s", "", low.replace("＠", "@"))
    return re.sub(r"[^a-z0-9]", "", low)


class _Draw:
    """Endless keyed choices for one entity."""

    def __init__(self, key: bytes, kind: str, who: str, attempt: int):
        self.key, self.seed, self.n, self.pool = key, f"{kind}\0{who}\0{attempt}".encode(), 0, b""

    def __call__(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, self.seed + self.n.to_bytes(4, "big"), "sha256")
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n


def _like(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.title() if like[:1].isupper() else word.lower()


def _syllables(draw: _Draw, s: str, n: int) -> str:
    return "".join(part[draw(len(part))] for _ in range(n) for part in POOLS[s][2])


def _word(draw: _Draw, like: str) -> str:
    return _like(_syllables(draw, script(like), 2 + draw(2)), like)


def _name_word(draw: _Draw, word: str, shape: str, attempt: int) -> str:
    """A word for a word of a name: of its script; a given name of its gender, or syllables, more of them with every few attempts."""
    s = script(word)
    if shape == "family":
        return _syllables(draw, s, (1 if s == "H" else 3) + attempt // 2)
    pool = POOLS[s][0 if shape == "female" else 1]
    return pool[draw(len(pool))].lower() + _syllables(draw, s, attempt if s == "H" else attempt + 1)


@lru_cache(64)
def _initials(key: bytes, s: str) -> dict[str, str]:
    """A keyed permutation of an alphabet: different initials stay different."""
    letters, draw = list(ALPHABETS[s]), _Draw(key, "initial", s, 0)
    for i in range(len(letters) - 1, 0, -1):
        j = draw(i + 1)
        letters[i], letters[j] = letters[j], letters[i]
    return dict(zip(ALPHABETS[s], letters))


def _mod11(digits: list[int], weights: range) -> int:
    rest = sum(d * w for d, w in zip(digits, weights)) % 11
    return 0 if rest < 2 else 11 - rest


def _checked(value: str, new: str) -> str:
    """`new` with its check signs set where `value` has the form of a number with such signs (and, where the form alone is no proof, keeps its own)."""
    if re.fullmatch(r"\d{3}\.\d{3}\.\d{3}-\d{2}", value):  # eleven digits, the last two by weights
        d = [int(c) for c in new if c.isdigit()][:9]
        d.append(_mod11(d, range(10, 1, -1)))
        d.append(_mod11(d, range(11, 1, -1)))
        return "{}{}{}.{}{}{}.{}{}{}-{}{}".format(*d)
    letters = "TRWAGMYFPDXBNJZSQVHLCKE"
    if re.fullmatch(r"[XYZ]?\d{7,8}[A-Z]", value):  # seven or eight digits and the letter of the rest by 23
        body = value[0] * (value[0] in "XYZ") + new[value[0] in "XYZ" : -1]
        return body + letters[int(body.translate(str.maketrans("XYZ", "012"))) % 23]
    own = [int(c) for c in value if c.isdigit()]
    if re.fullmatch(r"\d{9}", value) and own[8] == _mod11(own[:8], range(9, 1, -1)):
        d = [int(c) for c in new][:8]
        return "".join(map(str, [*d, _mod11(d, range(9, 1, -1))]))
    return new


# Words of an address that say what it is, which stay.
ADDRESS_WORDS = set("flat calle street road lane avenida travessa avenue drive close court terrace place gardens crescent boulevard square suite unit apartment wohnung plaza paseo largo praça alameda estrada".split())


def surrogate(kind: str, who: str, value: str, key: bytes, attempt: int = 0) -> str:
    """A replacement of the same type and format; the same for every spelling of one entity but for its format. The country code of a phone number stays; check signs fit."""
    draw = _Draw(key, kind, who, attempt)
    if kind in ("phone", "id_number"):
        code = re.match(r"(?:\+|00)(?:1|7|[2-689]\d\b|[2-689]\d{1,2}(?=\D)|[2-689]\d)", value) if kind == "phone" else None
        fixed = code[0] if code else ""
        new = fixed + re.sub(r"[0-9]|[A-Za-z]", lambda m: str(draw(10)) if m[0].isdigit() else chr(65 + draw(26)) if m[0].isupper() else m[0], value[len(fixed) :])
        return _checked(value, new) if kind == "id_number" else new
    if kind == "email":
        return f"{_word(draw, 'x')}.{_word(draw, 'x')}{attempt or ''}@{_word(draw, 'x')}.example"
    return re.sub(rf"\d|(?<!\w)[{BIG}][{LOW}]{{3,}}", lambda m: str(1 + draw(9)) if m[0].isdigit() else m[0] if m[0].lower() in ADDRESS_WORDS else _word(draw, m[0]), value)


def name_surrogate(value: str, words: dict[str, str], key: bytes) -> str:
    """The name with every word replaced by that of `words`, initials by the keyed permutation; titles and particles stay."""
    out = []
    for part, role in _words(value):
        if role in ("title", "particle"):
            out.append(part)
        elif role == "initial":
            table = _initials(key, s) if (s := script(part)) in ALPHABETS else {}
            out.append("".join(_like(table.get(c.upper(), c), c) for c in plain(part).upper()) if part[0].isupper() else "".join(table.get(c.upper(), c).lower() for c in part))
        else:
            out.append("-".join(_like(words.get(plain(w), w), w) for w in part.split("-")))
    return ("" if script(value) == "H" and " " not in value else " ").join(out)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, value, entity, shape: other entities as they are; a name as its words (kind `word`), each with what it is used as."""
    for batch in batches:
        rows = []
        for kind, value in zip(*(batch.column(c).to_pylist() for c in ("kind", "value"))):
            if kind != "name":
                rows.append((kind, value, entity(kind, value), ""))
                continue
            parts = _words(value)
            titles = {p.strip(".").lower() for p, r in parts if r == "title"}
            gender = "female" if titles & FEMALE_TITLES else "male" if titles & MALE_TITLES else "given"
            rows += [("word", k, k, gender if r == "given" else "family") for p, r in parts if r in ("given", "family") for k in _keys(p)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(4)], names=["kind", "value", "entity", "shape"])


def _gender(word: str) -> str:
    """The gender a given name has most likely where no title tells: by the fixed list, else by its ending."""
    if word in FEMALE_GIVEN or word in MALE_GIVEN:
        return "female" if word in FEMALE_GIVEN else "male"
    return "female" if word.endswith(("a", "ie", "ine", "ette", "elle", "а", "я", "α", "η", "美", "子")) else "male"


def _surrogates(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, who, values, shapes, attempts = (batch.column(c).to_pylist() for c in ("kind", "entity", "value", "shape", "attempt"))
            new = [
                _name_word(_Draw(key, k, w, a), w, _gender(w) if s == "given" else s, a) if k == "word" else surrogate(k, w, v, key, a)
                for k, w, v, s, a in zip(kinds, who, values, shapes, attempts)
            ]
            got = [plain(x) if k == "word" else entity(k, x) for k, x in zip(kinds, new)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string()), pa.array(got, pa.string())], names=[*batch.schema.names, "surrogate", "got"])

    return run


def _named(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, maps = batch.column("value").to_pylist(), batch.column("words").to_pylist()
            new = [name_surrogate(v, dict(m or ()), key) for v, m in zip(values, maps)]
            who = [entity("name", v) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(["name"] * len(values), pa.string()), batch.column("value"), pa.array(who, pa.string()), pa.array(new, pa.string())], names=["kind", "value", "entity", "surrogate"])

    return run


def _name_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(v, k) for v in batch.column(0).to_pylist() for p, r in _words(v) if r in ("given", "family") for k in _keys(p)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(2)], names=["value", "word"])


#: Rounds without a single new surrogate after which a format is taken to have no free ones left.
STUCK = 30


def entity_surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """kind, value, entity, surrogate for distinct (kind, value): no two entities of a kind share a surrogate, and none is an entity of the corpus.

    Names get theirs word by word, so "Ivy Numofa", "Ms Numofa" and "IVY NUMOFA" keep their common parts; words never share a
    surrogate and initials are permuted, so different names stay different. Surrogates are drawn again until none collides;
    if STUCK rounds on end settle nothing (more entities than a format has values), ValueError says so.
    """
    distinct = cut(values.select("kind", "value").distinct())
    raw = distinct.mapInArrow(_entities, "kind string, value string, entity string, shape string")
    count = lambda s: F.count_if(F.col("shape") == s)
    shape = F.when(count("family") > count("given") + count("female") + count("male"), "family").when(count("female") > count("male"), "female").when(count("male") > 0, "male").otherwise("given")
    words = raw.filter("kind = 'word'").groupBy("kind", "value", "entity").agg(shape.alias("shape"))
    named = cut(raw.filter("kind <> 'word'").unionByName(words))
    todo, done, idle = named.withColumn("attempt", F.lit(0)), None, 0
    while True:
        drawn = cut(todo.mapInArrow(_surrogates(key), "kind string, value string, entity string, shape string, attempt int, surrogate string, got string"))
        taken = named.select("kind", F.col("entity").alias("got"))
        taken = taken if done is None else taken.unionByName(done.select("kind", "got"))
        # One sum says of every drawn surrogate who has it and whether it is taken; what is not drawn need not move.
        if drawn.count() <= FEW:
            taken = taken.join(F.broadcast(drawn.select("kind", "got")), ["kind", "got"], "left_semi")
        held = drawn.select("kind", "got", "entity").unionByName(taken.withColumn("entity", F.lit(None).cast("string")))
        owners = held.groupBy("kind", "got").agg(F.min("entity").alias("first"), F.bool_or(F.col("entity").isNull()).alias("taken"))
        ok = (F.col("entity") == F.col("first")) & ~F.col("taken")
        judged = cut(drawn.join(owners, ["kind", "got"]).withColumn("ok", F.bool_and(ok).over(W.partitionBy("kind", "entity"))).drop("first", "taken"))
        good = judged.filter("ok").select("kind", "value", "entity", "surrogate", "got")
        done = good if done is None else done.unionByName(good)
        todo = judged.filter("NOT ok").select("kind", "value", "entity", "shape", (F.col("attempt") + 1).cast("int").alias("attempt"))
        if todo.isEmpty():
            break
        idle = idle + 1 if good.isEmpty() else 0
        if idle >= STUCK:
            raise ValueError("a format has fewer values than the corpus has entities")
    full = distinct.filter("kind = 'name'").select("value")
    pieces = full.mapInArrow(_name_words, "value string, word string").join(done.filter("kind = 'word'").select(F.col("entity").alias("word"), "surrogate"), "word")
    maps = pieces.groupBy("value").agg(F.map_from_entries(F.collect_set(F.struct("word", "surrogate"))).alias("words"))
    names = full.join(maps, "value", "left").mapInArrow(_named(key), "kind string, value string, entity string, surrogate string")
    return done.filter("kind <> 'word'").select("kind", "value", "entity", "surrogate").unionByName(names)


def replacements(rows: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """src, record_id, kind, nth, start, end, value, surrogate: every mention with what takes its place."""
    found_ = cut(hits(rows, names))
    swap = entity_surrogates(found_, key)
    return found_.join(swap.select("kind", "value", "surrogate"), ["kind", "value"])


def found(rows: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """src, record_id, kind, nth: one row per replaced mention. NULL and empty texts, and rows without an id, have none."""
    return replacements(rows, names, key).select("src", "record_id", "kind", "nth")


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        src, ids, bodies, swaps = (c.to_pylist() for c in batch.columns)
        masked, swapped = [], []
        for t, h in zip(bodies, swaps):
            a_out, b_out, at = [], [], 0
            for x in sorted(h or [], key=lambda x: x["start"]):
                a_out += [t[at : x["start"]], f"[{x['kind'].upper()}]"]
                b_out += [t[at : x["start"]], x["surrogate"]]
                at = x["end"]
            masked.append(t if t is None else "".join([*a_out, t[at:]]))
            swapped.append(t if t is None else "".join([*b_out, t[at:]]))
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(ids, pa.string()), pa.array(masked, pa.string()), pa.array(swapped, pa.string())], names=["src", "record_id", "text", "surrogate_text"])


def redacted(rows: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """src, record_id, text (typed placeholders), surrogate_text. Each id once; rows without an id are redacted, too, and all of them come out; NULL and empty texts and rows without a mention are unchanged.

    `key` is the secret of the surrogates: keep it and they stay the same, lose it and they cannot be worked out. It goes to
    the tasks with the functions, never into a plan.
    """
    # A row without an id is known by its text, as equal texts have equal replacements.
    keyed = rows.withColumn("record_id", F.coalesce("record_id", F.concat(F.lit("\0"), F.sha2("text", 256))))
    once = keyed.filter("record_id NOT LIKE '\0%'").dropDuplicates(["src", "record_id"])
    nameless = keyed.filter("record_id IS NULL OR record_id LIKE '\0%'")
    swaps = replacements(keyed, names, key)
    per_row = swaps.groupBy("src", "record_id").agg(F.collect_list(F.struct("kind", "start", "end", "surrogate")).alias("swaps"))
    out = once.unionByName(nameless).join(per_row, ["src", "record_id"], "left").select("src", "record_id", "text", "swaps").mapInArrow(_replaced, "src string, record_id string, text string, surrogate_text string")
    return out.withColumn("record_id", F.when(~F.col("record_id").startswith("\0"), F.col("record_id")))
