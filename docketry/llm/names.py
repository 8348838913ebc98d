"""Problem 1: link the variant spellings of people's and organisations' names.

Every name is rewritten into its canonical forms: titles, middle initials, accents and case go; "Family, Given" is turned
round; nicknames become all the given names they stand for; a given name also gives its initial; legal forms go and words
for a line of business are brought to one stem; proper names lose their order; and each form also appears with one letter
left out, so that two spellings one slip apart share a form. Forms are exploded and equi-joined inside a scope (an
organisation, or a contact where an organisation is missing), as numbers.

Rarity scores the meetings. A shared form counts by how few names of its scope it could stand for, and a hint (an initial, a
nickname of several names, a name without its line of business) links only to the candidate that takes nearly all of its
score. Whether two given names that lie close are a name and its slip, or two names, is told by how many bearers each has in
the whole table; a fixed list of names and the kind of slip decide only where the table is too small to tell.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.components import connected
from docketry.session import cut

# Titles before a name.
TITLES = set("dr dra prof profa mr mrs ms miss sr sra srta eng enga ing me mme m mlle herr frau don dona d".split()) - {"m", "d", "me"}
# Widespread given names of many countries, without accents. Further ones are learned from the column of names.
FEMALE_GIVEN = set(
    "aisha alice ana andrea anna barbara beatriz carmen caroline catherine charlotte chloe christine claire clara daniela diana elena elizabeth emily emma erika eva fatima fiona francesca giulia hana hannah helen helena ines ingrid irene isabel jane "
    "jennifer jessica joan joana julia karen karin katherine keiko laura lea linda lisa louise lucia luisa maria marie marta mary mei michelle monica nadia natalia nina nora olga olivia paula priya rachel rebecca rosa ruth sara sarah silvia sofia sonia "
    "sophie susan svetlana tatiana teresa ursula valentina vera victoria yuki yuko zoe".split()
)
MALE_GIVEN = set(
    "ahmed alberto alexander ali andrew anthony antonio arjun arthur august brian carlos charles christian christopher daniel david dmitri edward enrique erik fernando francisco frank george giovanni hans hassan henry hiroshi hugo ibrahim igor ivan jack "
    "jacob james jan javier jean joao john jorge jose joseph juan karl kenji kevin klaus lars liam louis luca luis manuel marco mario mark martin matthew michael miguel mohammed nicholas noah oliver omar oscar patrick paul pedro peter philip pierre rafael "
    "raj ricardo richard robert roberto samuel sergei simon stefan stephen steven takashi thomas tomas vladimir walter wei william yusuf".split()
)
GIVEN = FEMALE_GIVEN | MALE_GIVEN
# Nicknames that their letters do not tell, and the given names they stand for. Nicknames that begin or lie inside a name are found by rule (`pet`).
NICKNAMES = {
    "abby": "abigail", "aggie": "agnes agatha", "alex": "alexander alexandre alexandra", "andy": "andrew andreas", "barney": "barnabas bernard", "becky": "rebecca", "bel": "isabel", "bella": "isabella", "bernie": "bernard bernadette",
    "bess": "elizabeth", "beth": "elizabeth", "beto": "alberto roberto", "betty": "elizabeth", "bia": "beatriz", "bill": "william", "bob": "robert", "cacho": "carlos", "cathy": "catherine", "charo": "rosario", "chema": "jose", "chico": "francisco",
    "chuck": "charles", "chus": "jesus", "cica": "cecilia", "cindy": "cynthia", "concha": "concepcion", "curro": "francisco", "dan": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "dora": "dorothea theodora isadora",
    "drew": "andrew", "dudu": "eduardo", "ed": "edward edgar edmund", "edu": "eduardo", "eli": "elias elijah elizabeth", "ellie": "eleanor helen", "fran": "francisco frances", "frank": "francis franklin", "fred": "frederic frederick friedrich alfred",
    "fritz": "friedrich", "gabi": "gabriel gabriela gabriele", "gene": "eugene", "ginette": "genevieve", "ginny": "virginia", "greg": "gregory", "greta": "margareta margarete", "gui": "guilherme", "hank": "henry", "hans": "johannes", "harry": "henry harold", "heinz": "heinrich",
    "jack": "john", "jackie": "jacqueline", "jacquie": "jacqueline", "jim": "james", "jimmy": "james", "joca": "joao", "joe": "jose joseph", "jochen": "joachim", "jupp": "josef", "kate": "katherine catherine", "kathe": "katharina katharine",
    "kathy": "katherine kathleen", "kiko": "francisco", "kurt": "konrad", "larry": "lawrence laurence", "lena": "helena magdalena", "liesel": "elisabeth", "lisa": "elisabeth elizabeth", "lisbeth": "elisabeth", "liz": "elizabeth", "lola": "dolores", "lottie": "charlotte",
    "lu": "luisa lucia luciana", "lulu": "louise lucia", "lupe": "guadalupe", "maggie": "margaret", "mandy": "amanda", "manel": "manuel", "manolo": "manuel", "marga": "margarita", "marilu": "maria", "max": "maximilian maxwell", "meg": "margaret", "mickey": "michael", "mike": "michael",
    "millie": "mildred camilla", "molly": "mary", "nacho": "ignacio", "nanda": "fernanda", "nando": "fernando", "nell": "eleanor helen", "nik": "nikolaus", "paco": "francisco", "pancho": "francisco", "pat": "patricia patrick", "patsy": "patricia", "paddy": "patrick",
    "peggy": "margaret", "pepa": "josefa", "pepe": "jose", "pili": "pilar", "polly": "mary", "quique": "enrique", "ray": "raymond", "rick": "richard frederick", "rob": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel samantha", "sandy": "alexander alexandra sandra", "sepp": "josef",
    "sacha": "alexandre alexander", "steve": "stephen steven", "sue": "susan", "tere": "teresa", "ted": "theodore edward", "theo": "theodore theodor", "tiao": "sebastiao", "tom": "thomas", "toni": "antonio anton antonia", "toninho": "antonio", "tony": "antonio anthony", "trish": "patricia",
    "tito": "alberto", "tonio": "antonio", "uli": "ulrike ulrich", "vicky": "victoria", "vivi": "vitoria viviane", "volodya": "vladimir", "wally": "walter", "will": "william", "xavi": "xavier", "ze": "jose", "zeca": "jose", "judy": "judith", "jerry": "gerald jeremy jerome",
}
# Words of legal forms of many countries, without points.
LEGAL = set(
    "limited ltd plc llp llc lp llp inc incorporated corp corporation co company liability partnership pty pte pvt gmbh mbh gesellschaft ag aktiengesellschaft kg kommanditgesellschaft ohg ug gbr eg ev kgaa sa sl slu sau sc sas sasu sarl eurl sci snc lda limitada ltda eireli epp me "
    "spa srl sapa scarl bv nv cv vof ab as asa aps oy oyj hf ehf sp zoo spzoo sro doo kft zrt nyrt ad eood ood srls ooo zao oao pao ip tov kk yk bhd sdn jsc pjsc wll fzco".split()
)
# Words for a line of business: stem, then the ways it is written.
LINES = {
    "abog": "abogados abog", "account": "accounting accountants acctg", "advert": "advertising advtg", "advog": "advogados adv", "agric": "agriculture agricola agri", "aliment": "alimentacao alimentos alim", "archit": "architects architecture archts", "assoc": "associates associados asociados assoc",
    "assur": "assurances assurance assur", "autom": "automotive automobile autos", "aviat": "aviation airlines avn", "bank": "banking banco banque bank", "batim": "batiment bat", "bau": "bauunternehmung bauwesen bau", "brew": "brewery brewing brauerei", "capital": "capital cap", "chem": "chemicals chemie quimica chem",
    "comerc": "comercio commerce com", "commun": "communications comunicaciones comms", "compan": "compania companhia cia", "conseil": "conseil cons", "constr": "construction construcoes construccion constr", "consult": "consultoria consultants consulting consult", "design": "design dsgn", "distrib": "distribution distribuidora distr",
    "educ": "education educacao educ", "electr": "electronics electric elektro elec", "energ": "energy energia energie engy", "engin": "engineering ingenieria engenharia eng", "enterpr": "enterprises empreendimentos entpr", "estate": "estates realty", "financ": "finance financial financeira fin", "food": "foods food fds", "freight": "freight frt",
    "furnit": "furniture moveis furn", "general": "generale general gen", "gest": "gestion gestao gest", "group": "group grupo groupe gruppe grp", "handel": "handelsgesellschaft handel hdl", "hold": "holdings holding hldgs", "hotel": "hotels hoteis hotel htl", "imob": "imobiliaria imob", "immob": "immobilier immobilien immob", "import": "imports importadora import",
    "indust": "industria industries industrie ind", "insur": "insurance ins", "intern": "international internacional intl", "invest": "investments inversiones investimentos invest", "lab": "laboratories laboratorios labs", "legal": "legal lgl", "logist": "logistics logistica logistik log", "manag": "management mgmt", "manuf": "manufacturing mfg", "marit": "maritima maritime marit",
    "market": "marketing mktg", "masch": "maschinenbau maschbau masch", "media": "media medien", "medic": "medical medicina medizin med", "metal": "metals metalurgica metall", "mining": "mining mineracao mng", "partner": "partners partner ptnrs", "pharm": "pharmaceuticals pharma farmaceutica", "print": "printing grafica druckerei", "prop": "property properties prop",
    "publish": "publishing editora verlag publ", "recht": "rechtsanwalte rae ra", "recruit": "recruitment staffing", "retail": "retail rtl", "secur": "security seguranca sicherheit", "segur": "seguros seg", "serv": "services servicos servicios svcs", "ship": "shipping shpg", "societ": "societe ste soc", "software": "software sftw", "solut": "solutions solucoes soluciones solns",
    "sped": "spedition sped", "system": "systems sistemas systeme sys", "techn": "technologies technology tecnologia technik tech", "telecom": "telecommunications telecomunicaciones telecom", "text": "textiles textil", "tour": "tourism turismo touristik", "trad": "trading trdg", "transp": "transportes transport transporte transp", "trav": "travaux trav", "ventur": "ventures vntrs",
    "versich": "versicherung vers", "verwalt": "verwaltung verw", "wood": "timber madeiras holz",
}
LINE_OF = {w: stem for stem, words in LINES.items() for w in words.split()}
LONG_LINES = [w for w in LINE_OF if len(w) >= 5]
#: Words for a line of business by what is left when a letter goes.
_NEAR_LINES: dict[str, list[str]] = {}
for _w in LONG_LINES:
    for _d in {_w, *(_w[:i] + _w[i + 1 :] for i in range(len(_w)))}:
        _NEAR_LINES.setdefault(_d, []).append(_w)
SMALL_WORDS = {"e", "des", "y", "et", "und", "de", "and"}


def plain(text: str) -> str:
    """Lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(c))


def slips(a: str, b: str) -> int:
    """Letters more, less, other, or neighbours swapped between two words; 3 stands for more than two."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return min(row[-1], 3)


def shortened(word: str, times: int = 1) -> set[str]:
    """The word and the word with any letter left out, once or twice."""
    out = {word}
    for _ in range(times):
        out |= {w[:i] + w[i + 1 :] for w in out if len(w) > 2 for i in range(len(w))}
    return out


@lru_cache(100_000)
def near_line(word: str) -> str | None:
    """The word for a line of business one slip away from a word of five letters or more."""
    met = {x for d in shortened(word) for x in _NEAR_LINES.get(d, ())} if len(word) >= 5 else ()
    return min((x for x in met if slips(word, x) == 1), default=None)


@lru_cache(100_000)
def organization(text: str) -> tuple[tuple[str, ...], tuple[str, ...], str]:
    """(proper words in order, stems of the line of business sorted, legal form)."""
    s = plain(text).replace("int'l", "intl").replace("'", "").replace("’", "")
    s = re.sub(r"masch\.-\s*bau", "maschbau", s).replace(".", " . ")
    s = re.sub(r"\b([a-z]) \. (?=[a-z]\b)", r"\1", s)  # letters with points belong together
    s = re.sub(r"\bs ?/ ?a\b", "sa", s)
    words = re.sub(r"[^\w]+", " ", s.replace("_", " ")).split()
    proper, line, legal = [], set(), []
    i = 0
    while i < len(words):
        w = words[i]
        if w == "s" and i + 1 < len(words) and words[i + 1] in ("a", "l"):
            legal.append(w + words[i + 1])
            i += 2
            continue
        if w in LEGAL:
            legal.append(w)
        elif w in LINE_OF:
            line.add(LINE_OF[w])
        elif w in SMALL_WORDS:
            pass
        elif near := near_line(w):
            line.add(LINE_OF[near])
        else:
            proper.append(w)
        i += 1
    return tuple(proper), tuple(sorted(line)), " ".join(legal)


def organization_forms(proper: tuple[str, ...]) -> set[str]:
    """Keys under which a proper name can meet a spelling two slips away; the order of words does not count."""
    out = {" ".join(sorted(proper))}
    for i, w in enumerate(proper):
        rest = proper[:i] + proper[i + 1 :]
        out |= {f"{' '.join(sorted(rest))}~{d}" for d in shortened(w, 2 if len(w) > 4 else 1)}
    if len(proper) == 2:
        out |= {"~~".join(sorted((x, y))) for x in shortened(proper[0]) for y in shortened(proper[1])}
    return out


def same_proper(a: list[str], b: list[str]) -> bool:
    """The same words in any order but for slips: one in a word, two in a word of five letters or more, not more than two in all."""
    if len(a) != len(b):
        return False
    rest_a, rest_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    if len(rest_a) != len(rest_b) or len(rest_a) > 2:
        return False
    if not rest_a:
        return True
    fit = lambda x, y: slips(x, y) <= (2 if len(rest_a) == 1 and min(len(x), len(y)) > 4 else 1)
    return any(all(map(fit, rest_a, order)) for order in (rest_b, rest_b[::-1]))


@lru_cache(100_000)
def person(text: str) -> tuple[str, tuple[str, ...]] | None:
    """(given name or initial, family names); None for a name without letters."""
    s = plain(text).replace("’", "'")
    if "," in s:
        family, _, given = s.partition(",")
        s = f"{given} {family}" if given.strip() else family
    words = [w for w in (x.strip(".'\"()") for x in re.split(r"[\s\-.]+", s)) if w]
    while len(words) > 1 and words[0] in TITLES:
        words.pop(0)
    words = [w for w in words if w not in TITLES] or words
    if not words:
        return None
    if len(words) == 1:
        return "", (words[0],)
    family = tuple(w for w in words[1:] if len(w) > 1)
    return (words[0], family) if family else ("", tuple(words))


def full_names(given: str) -> set[str]:
    """The given names a given name or nickname may stand for."""
    return set(NICKNAMES[given].split()) if given in NICKNAMES else {given}


#: What keys of an initial begin with.
INITIAL = "*"


def person_forms(given: str, family: list[str], contact: bool) -> set[str]:
    """Keys under which a name can meet its other spellings: the given name's first two letters, or its first and last, with the last family name, or the whole of it with it; one slip in either.

    A key of an initial begins with INITIAL; under one, only initials look for names. Rows that share a contact need less proof:
    there two slips in the last family name are enough.
    """
    last, names = family[-1], full_names(given) if given else set()
    if not names:
        return {f"={' '.join(family)}"}
    out = {f"{INITIAL}{n[0]}~{d}" for n in names for d in shortened(last)}
    full = {n for n in names if len(n) > 1}
    out |= {f"{part}~{d}" for n in full for part in (f"{n[:2]}-", f"{n[0]}-{n[-1]}") for d in shortened(last)}
    out |= {f"{d}+{last}" for n in full for d in shortened(n)}
    return out | ({f"~~{d}" for d in shortened(last, 2)} if contact else set())


# The letters of a keyboard, row by row.
KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_KEY = {c: (row, k + row * 0.5) for row, letters in enumerate(KEYBOARD) for k, c in enumerate(letters)}


def typed_slip(a: str, b: str) -> bool:
    """Whether one of two words looks like the other mistyped: neighbours swapped, a letter doubled or left out inside, a neighbouring key hit. Another letter, or a vowel more at the end, makes another name."""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) < len(b):
        return len(b) == len(a) + 1 and a[k:] == b[k + 1 :] and (k < len(a) or (k > 0 and b[k] == b[k - 1]))
    if a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1]:
        return True
    near = a[k] in _KEY and b[k] in _KEY and abs(_KEY[a[k]][0] - _KEY[b[k]][0]) <= 1 and abs(_KEY[a[k]][1] - _KEY[b[k]][1]) <= 1
    return near and a[k + 1 :] == b[k + 1 :]


#: A spelling with less than this share of the bearers of another is taken for a slip of it, if that one has MANY; two with more and with FEW each are names.
SLIP_SHARE, MANY, FEW = 0.05, 20, 3


def two_names(a: str, b: str, n_a: int, n_b: int) -> bool:
    """Whether two spellings that lie close are different names. Rarity decides where the corpus shows enough bearers (`n`: family names a given name stands with); else the fixed list and the kind of slip."""
    low, high = sorted((n_a, n_b))
    if high >= MANY and low < SLIP_SHARE * high:
        return False
    if (a in GIVEN and b in GIVEN) or low >= FEW:
        return True
    return not typed_slip(a, b)


PET_ENDING = re.compile(r"(?:y|ie|i|ito|ita|inho|inha|chen|lein)$")


@lru_cache(100_000)
def pet(short: str, name: str) -> int:
    """2: `short` is a short form that begins the name (Chris, Jenny, Nick); 1: one that lies inside it (Gus of August); 0: none."""
    stem = re.sub(r"ck$", "c", PET_ENDING.sub("", short))
    stems = {x for x in (short, stem, re.sub(r"([^aeiou])\1$", r"\1", stem)) if len(x) >= 3 and len(name) >= len(x) + 3}
    return 2 if any(name.startswith(x) for x in stems) else 1 if any(x in name for x in stems) else 0


def same_person(g1: str, f1: list[str], g2: str, f2: list[str], contact: bool, n1: int = 0, n2: int = 0) -> int:
    """2: spellings of one name; 1: the first, -1: the second is only a hint (initial, ambiguous or short form) that fits the other; 0: different. `n1`, `n2`: bearers of the given names in the corpus."""
    far = 2 if contact else 1
    if slips(f1[-1], f2[-1]) > far or (len(f1) > 1 and len(f2) > 1 and slips(f1[-2], f2[-2]) > far):
        return 0
    if not g1 or not g2:
        return 2 if g1 == g2 and f1 == f2 else 0
    a, b = full_names(g1), full_names(g2)
    if len(g1) == 1 or len(g2) == 1:
        if len(g1) == len(g2):
            return 2 if g1 == g2 else 0
        short, names = (g1, b) if len(g1) == 1 else (g2, a)
        return 0 if short not in {n[0] for n in names} else (1 if len(g1) == 1 else -1)
    if len(a) > 1 and len(b) > 1 and a != b:  # two ambiguous nicknames meet through the name both stand for
        return 0
    if a & b:
        return 2 if len(a) == len(b) else (1 if len(a) > 1 else -1)
    listed = g1 in NICKNAMES or g2 in NICKNAMES
    if any(slips(x, y) <= far and (slips(x, y) == 2 or not two_names(x, y, 0 if listed else n1, 0 if listed else n2)) and not (x in GIVEN and y in GIVEN) and (slips(x, y) < 2 or min(n1, n2) < FEW) for x in a for y in b):
        return 2
    first, second = max((pet(g1, y) for y in b), default=0), max((pet(g2, x) for x in a), default=0)
    if contact and (first or second):
        return 2
    if first == 2 or second == 2:
        return 1 if first == 2 else -1
    # A slip inside a nickname: it then is one of those of the other's given names.
    nick = lambda g, names: any(slips(g, n) <= 1 for n, full in NICKNAMES.items() if names & set(full.split()))
    known = lambda g: g in GIVEN or g in NICKNAMES
    return 2 if contact and ((not known(g1) and nick(g1, b)) or (not known(g2) and nick(g2, a))) else 0


def _organizations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [organization(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([" ".join(sorted(p)) for p, _, _ in found]), pa.array([" ".join(x) for _, x, _ in found]), pa.array([g for *_, g in found])], names=["organization", "proper", "line", "legal"]
        )


def _forms_of(make, keep: int):
    """The rewritings of each node as a list, in Arrow batches: behind the first `keep` columns, from what `make` takes of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[keep:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array([list(make(*r)) for r in rows], pa.list_(pa.string()))], names=[*batch.schema.names[:keep], "forms"])

    return run


def _judged(judge, kind):
    """Pairs with the outcome of `judge` over the columns after a, b and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            how = [judge(*r) for r in zip(*(c.to_pylist() for c in batch.columns[3:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(how, kind)], names=["a", "b", "score", "how"])

    return run


def meetings(forms: DataFrame) -> DataFrame:
    """a, b, score: nodes that share a rewriting (`forms`: nid, key, each once; a key stands for a form in its scope). The score adds up, over the rewritings shared, how rare each is: 1 / the number of other nodes it could mean.

    Only numbers travel. A rewriting of one node alone meets nothing and is left out before the join. With a column `seeks`, a
    pair needs one node that seeks: names that share no more than an initial are no pairs.
    """
    counted = forms.withColumn("n", F.count("*").over(W.partitionBy("key"))).filter("n > 1")
    seeks = F.col("seeks") if "seeks" in forms.columns else F.lit(True)
    a, b = counted.filter(seeks).select("key", "n", F.col("nid").alias("a"), seeks.alias("also")), counted.select("key", F.col("nid").alias("b"), seeks.alias("back"))
    met = a.join(b, "key").filter("a < b OR (a > b AND NOT back)")  # a pair in which both seek comes once
    return met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(1.0 / (F.col("n") - 1)).alias("score"))


#: A hint (initial, ambiguous nickname, name without its line) links where one candidate has so much of the score of all.
SURE = 0.75


def most_likely(asked: DataFrame) -> DataFrame:
    """a, b: hints (own, component, score) and the candidate that takes at least SURE of their score; others stay alone."""
    each = asked.groupBy("own", "component").agg(F.max("score").alias("score"))
    best = each.groupBy("own").agg(F.max_by("component", F.struct("score", "component")).alias("b"), F.max("score").alias("top"), F.sum("score").alias("all"))
    return best.filter(F.col("top") >= SURE * F.col("all")).select(F.col("own").alias("a"), "b")


def organization_classes(people: DataFrame) -> DataFrame:
    """organization (each non-blank string once), class: equal for strings that name one organisation.

    Strings with equal proper words and line of business are one node; nodes of one line whose proper names differ by one slip
    are linked. A name without its line, or with one proper word of a longer name, joins an organisation only where one fits by
    far best (`most_likely`); where several fit, the one with its legal form, if that is one. NULL, empty and blank strings are
    missing and have no class.
    """
    strings = people.select("organization").filter(F.trim("organization") != "").distinct()
    parsed = cut(strings.mapInArrow(_organizations, "organization string, proper string, line string, legal string"))
    nodes = cut(parsed.select("proper", "line").distinct().withColumn("nid", F.monotonically_increasing_id()))
    made = nodes.select("nid", "line", "proper").mapInArrow(_forms_of(lambda proper: organization_forms(tuple(proper.split())), 2), "nid bigint, line string, forms array<string>")
    forms = cut(made.select("nid", "line", F.explode("forms").alias("form")).select("nid", F.xxhash64("form").alias("key"), F.xxhash64("line", "form").alias("line_key"), (F.col("line") == "").alias("bare")))
    left, right = (nodes.select(F.col("nid").alias(s), F.col("proper").alias(f"p{s}"), F.col("line").alias(f"l{s}")) for s in "ab")
    check = lambda met: met.join(left, "a").join(right, "b").select("a", "b", "score", F.split("pa", " ").alias("pa"), F.split("pb", " ").alias("pb"), "la", "lb")
    within = check(meetings(forms.select("nid", F.col("line_key").alias("key")))).filter("la = lb")
    sure = cut(within.select("a", "b", "score", "pa", "pb").mapInArrow(_judged(same_proper, pa.bool_()), "a bigint, b bigint, score double, how boolean").filter("how")).select("a", "b")
    first = connected(nodes.select(F.col("nid").alias("node")), sure)

    # Hints: a name without its line; a name of one proper word. Candidates are whole components; rarity decides.
    bare, full = forms.filter("bare").select(F.col("nid").alias("a"), "key"), forms.filter("NOT bare").select(F.col("nid").alias("b"), "key")
    lineless = check(bare.join(full, "key").groupBy("a", "b").agg(F.count("*").cast("double").alias("score"))).select("a", "b", "score", "pa", "pb").mapInArrow(_judged(same_proper, pa.bool_()), "a bigint, b bigint, score double, how boolean").filter("how")
    word = nodes.filter("size(split(proper, ' ')) > 1").select(F.col("nid").alias("b"), "line", F.explode(F.split("proper", " ")).alias("word")).join(
        nodes.filter("proper <> '' AND size(split(proper, ' ')) = 1 AND line <> ''").select(F.col("nid").alias("a"), F.col("proper").alias("word"), "line"), ["word", "line"]
    )
    hints = lineless.select(F.col("a").alias("hint"), F.col("b").alias("node"), "score").unionByName(word.select(F.col("a").alias("hint"), F.col("b").alias("node"), F.lit(1.0).alias("score")))
    label = cut(first.select("node", "component"))
    with_node = cut(parsed.join(nodes, ["proper", "line"]).join(label.withColumnRenamed("node", "nid"), "nid").select("organization", "legal", "component"))
    legal = with_node.select("component", "legal").filter("legal <> ''").distinct()
    asked = hints.join(label, "node").select("hint", "component", "score").join(label.select(F.col("node").alias("hint"), F.col("component").alias("own")), "hint").filter("own <> component").groupBy("own", "component").agg(F.max("score").alias("score"))
    its = asked.join(legal.withColumnRenamed("component", "own"), "own").join(legal, ["component", "legal"]).select("own", "component").distinct().withColumn("agree", F.lit(True))
    judged = cut(asked.join(its, ["own", "component"], "left"))
    agreeing = judged.filter("agree").groupBy("own").agg(F.count("*").alias("n"), F.min("component").alias("b")).filter("n = 1").select(F.col("own").alias("a"), "b")
    likely = most_likely(judged.select("own", "component", "score"))
    chosen = likely.unionByName(agreeing.join(likely.select("a"), "a", "left_anti"))
    second = connected(label.select(F.col("component").alias("node")).distinct(), chosen)
    final = second.select(F.col("node").alias("component"), F.col("component").alias("class"))
    return with_node.join(final, "component").select("organization", "class")


def _people(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, scope, org, given, family, for each scope of a row: its organisation, its e-mail, its phone."""
    for batch in batches:
        out: list[tuple] = []
        for pid, name, org, email, phone in zip(*(c.to_pylist() for c in batch.columns)):
            found = person(name or "")
            if not found or pid is None:
                continue
            given, family = found
            digits = re.sub(r"\D", "", phone or "")
            own = "" if org is None else str(org)
            scopes = [f"o:{own}"] if own else []
            scopes += [f"e:{email.strip().lower()}"] if email and email.strip() else []
            scopes += [f"p:{digits}"] if digits else []
            out += [(pid, s, own, given, " ".join(family)) for s in scopes]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(5)], names=["id", "scope", "org", "given", "family"])


def person_classes(people: DataFrame, classes: DataFrame) -> DataFrame:
    """id, class: people rows with equal class stand for one person. Each id once; rows without a name are alone.

    Rows meet inside one organisation (its class), or under one e-mail or phone if the organisation of at least one is missing;
    under a contact rows of one organisation meet too, as there wider slips count.
    Rows with one name in one scope hang on one node, so a name held by very many rows makes a star and no pairs; only nodes
    that meet others, and rows that hang on several nodes, take part in the search for classes.
    """
    rows = people.select("id", "full_name", "organization", "email", "phone").dropDuplicates(["id"]).join(classes, "organization", "left")
    placed = cut(rows.select("id", "full_name", F.col("class").alias("org"), "email", "phone").mapInArrow(_people, "id string, scope string, org string, given string, family string"))
    shared = placed.filter("scope NOT LIKE 'o:%'").groupBy("scope").count().filter("count > 1").select("scope")
    live = placed.filter("scope LIKE 'o:%'").unionByName(placed.filter("scope NOT LIKE 'o:%'").join(shared, "scope", "left_semi"))
    name = ["scope", "org", "given", "family"]
    nodes = cut(live.select(*name).distinct().withColumn("nid", F.monotonically_increasing_id()))
    bearers = placed.filter("given <> ''").groupBy("given").agg(F.count_distinct("family").cast("int").alias("bearers"))
    wide = ~F.startswith("scope", F.lit("o:"))
    made = nodes.select("nid", F.xxhash64("scope").alias("s"), (F.length("given") == 1).alias("short"), "given", "family", wide.alias("wide")).mapInArrow(
        _forms_of(lambda g, f, contact: person_forms(g, f.split(), contact), 3), "nid bigint, s bigint, short boolean, forms array<string>"
    )
    forms = made.select("nid", "s", "short", F.explode("forms").alias("form")).select("nid", F.xxhash64("s", "form").alias("key"), (~F.startswith("form", F.lit(INITIAL)) | F.col("short")).alias("seeks"))
    side = nodes.join(bearers, "given", "left")
    left, right = (side.select(F.col("nid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in (*name, "bearers")]) for s in "ab")
    met = meetings(forms).join(left, "a").join(right, "b").filter("scope_a = scope_b AND (org_a = org_b OR org_a = '' OR org_b = '')")
    columns = met.select("a", "b", "score", "given_a", F.split("family_a", " "), "given_b", F.split("family_b", " "), ~F.startswith("scope_a", F.lit("o:")), F.coalesce("bearers_a", F.lit(0)), F.coalesce("bearers_b", F.lit(0)))
    judged = cut(columns.mapInArrow(_judged(same_person, pa.int32()), "a bigint, b bigint, score double, how int").filter("how <> 0"))
    # A node of a contact scope has one organisation or none, so it ties together only rows that may be tied.
    hung = cut(live.join(nodes, name).select("id", "nid"))
    homes = hung.groupBy("id").agg(F.min("nid").alias("home"))
    tied = hung.join(homes, "id").filter("nid <> home").select(F.col("home").alias("a"), F.col("nid").alias("b")).distinct()
    label = cut(connected(nodes.select(F.col("nid").alias("node")), judged.filter("how = 2").select("a", "b").unionByName(tied)))
    hint = judged.filter("how <> 2").select(F.when(F.col("how") == 1, F.col("a")).otherwise(F.col("b")).alias("hint"), F.when(F.col("how") == 1, F.col("b")).otherwise(F.col("a")).alias("node"), "score")
    initials = F.length("given") < 2
    hint = cut(hint.join(nodes.select(F.col("nid").alias("hint"), initials.alias("initial")), "hint"))
    for initial in (False, True):  # nicknames first, so that an initial finds them with their names
        asked = hint.filter(F.col("initial") == initial).join(label, "node").join(label.select(F.col("node").alias("hint"), F.col("component").alias("own")), "hint").filter("own <> component")
        joined = connected(label.select(F.col("component").alias("node")).distinct(), most_likely_of_each(asked))
        label = cut(label.join(joined.select(F.col("node").alias("component"), F.col("component").alias("class")), "component").select("node", F.col("class").alias("component")))
    known = homes.join(label.select(F.col("node").alias("home"), F.col("component").cast("string").alias("class")), "home").select("id", "class")
    ids = people.select("id").filter("id IS NOT NULL").distinct()
    return ids.join(known, "id", "left").select("id", F.coalesce("class", F.concat(F.lit("id:"), "id")).alias("class"))


def most_likely_of_each(asked: DataFrame) -> DataFrame:
    """a, b: as `most_likely`, each hint node on its own: the nodes of one component may ask for different candidates."""
    each = asked.groupBy("hint", "own", "component").agg(F.max("score").alias("score"))
    best = each.groupBy("hint", "own").agg(F.max_by("component", F.struct("score", "component")).alias("b"), F.max("score").alias("top"), F.sum("score").alias("all"))
    return best.filter(F.col("top") >= SURE * F.col("all")).select(F.col("own").alias("a"), "b").distinct()


def _pairs(rows: DataFrame, key: str, kind: str) -> DataFrame:
    size = rows.groupBy("class").count().filter("count > 1").select("class")
    live = rows.join(size, "class", "left_semi")
    other = live.select("class", F.col(key).alias("key_b"))
    return live.select("class", F.col(key).alias("key_a")).join(other, "class").filter("key_a < key_b").select(F.lit(kind).alias("kind"), "key_a", "key_b")


def links(people: DataFrame) -> DataFrame:
    """kind ('person' or 'organization'), key_a < key_b: every pair of one class, each once."""
    classes = cut(organization_classes(people))
    return _pairs(cut(person_classes(people, classes)), "id", "person").unionByName(_pairs(classes, "organization", "organization"))
