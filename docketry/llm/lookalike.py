"""Problem 8: one consistent form for texts that look the same but differ in their characters.

Two steps. Step one acts on single characters: invisible characters go, full-width and half-width forms, ligatures, spaces
of any width and hyphens of one look become the ordinary ones, combining accents are composed. What a reader can tell apart
(accents, capitals, raised, circled and fraction forms, line breaks) stays. Step two is the script-aware repair: the
dominant script of a token comes from its letters that have no look-alike, or where it has none, from those of its text;
look-alikes of other scripts are replaced only if the result is a word of the corpus (or two spellings in the corpus have
that same result, so that leaving them apart would keep two texts of one look apart). The corpus vocabulary is a
distributed table, joined, never collected or broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.session import cut

# Characters that show nothing.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
# Hyphens that look like the hyphen-minus.
HYPHENS = "‐‑﹣－"
# Letters that look like a Latin letter, by script.
CYRILLIC_AS_LATIN = dict(zip("аеорсухѕіјһԁԛԝАВЕЗКМНОРСТУХЅІЈҮԚԜӏ", "aeopcyxsijhdqwABE3KMHOPCTYXSIJYQWl"))
GREEK_AS_LATIN = dict(zip("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺͿ", "ovcjABEZHIKMNOPTYXCMJ"))
OTHER_AS_LATIN = dict(zip("օսհɡɑⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "ouhgaIVXLCDMivxlcdm"))
# Latin letters that look like a letter of the other script.
LATIN_AS_CYRILLIC = dict(zip("aeopcyxABEKMHOPCTX", "аеорсухАВЕКМНОРСТХ"))
LATIN_AS_GREEK = dict(zip("ovABEZHIKMNOPTYX", "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"))

del CYRILLIC_AS_LATIN["З"]


def _accented(table: dict[str, str]) -> dict[str, str]:
    """The table and its letters with accents: what the base letter looks like, with the same accents."""
    out = dict(table)
    for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in table and len(whole := unicodedata.normalize("NFC", table[base] + "".join(marks))) == 1:
            out[chr(code)] = whole
    return out


CYRILLIC_AS_LATIN, GREEK_AS_LATIN = _accented(CYRILLIC_AS_LATIN), _accented(GREEK_AS_LATIN)
TO_LATIN = CYRILLIC_AS_LATIN | GREEK_AS_LATIN | OTHER_AS_LATIN
TO_CYRILLIC = LATIN_AS_CYRILLIC | {k: LATIN_AS_CYRILLIC[v] for k, v in (GREEK_AS_LATIN | OTHER_AS_LATIN).items() if v in LATIN_AS_CYRILLIC}
TO_GREEK = LATIN_AS_GREEK | {k: LATIN_AS_GREEK[v] for k, v in (CYRILLIC_AS_LATIN | OTHER_AS_LATIN).items() if v in LATIN_AS_GREEK}
REPAIR = {script: str.maketrans(table) for script, table in (("L", TO_LATIN), ("C", TO_CYRILLIC), ("G", TO_GREEK))}
#: Letters that alone do not show their script.
AMBIGUOUS = set(TO_LATIN) | set(TO_LATIN.values()) | set(TO_CYRILLIC) | set(TO_GREEK)

FOREIGN = "Ͱ-Ͽἀ-῿Ѐ-ԯ԰-֏ɡɑⅠ-ⅿ"
TOKEN = re.compile("[\\w\u0300-\u036f]+")
FOREIGN_TOKEN = re.compile(f"[\\w\u0300-\u036f]*[{FOREIGN}][\\w\u0300-\u036f]*")
HAS_FOREIGN = re.compile(f"[{FOREIGN}]")
EMOJI_JOIN = re.compile("(?<=[\ufe0f\U0001f000-\U0001faff☀-➿])\u200d(?=[\U0001f000-\U0001faff☀-➿])")


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    for block in ((0xFF00, 0xFFEF), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x2000, 0x200A), (0x3000, 0x3000), (0xA0, 0xA0), (0x202F, 0x202F), (0x205F, 0x205F), (0x1680, 0x1680), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x132, 0x133), (0x2160, 0x217F)):
        for c in range(block[0], block[1] + 1):
            plain = unicodedata.normalize("NFKC", chr(c))
            if 0x2160 <= c <= 0x217F and len(plain) == 1:
                continue  # one-letter numerals are look-alikes of step two
            if plain != chr(c):
                out[c] = plain
    return out | {ord(c): "-" for c in HYPHENS}


TABLE = _table()
KEEP = "\ue0fe"  # a private-use sign that stands for a joiner inside an emoji while the others go


SPECIAL = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(TABLE)) + "]+")


def settle(text: str) -> str:
    """Step one. A joiner between two emoji stays, as it changes the picture."""
    if text.isascii():
        return text
    if SPECIAL.search(text):
        text = EMOJI_JOIN.sub(KEEP, text)
        text = SPECIAL.sub(lambda m: m[0].translate(TABLE), text).replace(KEEP, "\u200d")
    return unicodedata.normalize("NFC", text)


_BLOCKS = {"L": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)), "C": ((0x400, 0x52F),), "G": ((0x370, 0x3FF), (0x1F00, 0x1FFF))}
SURE = {s: re.compile("[" + "".join(c for a, b in blocks for c in map(chr, range(a, b + 1)) if c.isalpha() and c not in AMBIGUOUS) + "]+") for s, blocks in _BLOCKS.items()}


def _script(letters: str) -> str | None:
    """The script most letters without look-alike belong to; None where there is no such letter."""
    counts = {s: sum(map(len, pattern.findall(letters))) for s, pattern in SURE.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def proposals(text: str) -> list[tuple[str, str, int]]:
    """(token, result, preference) of the tokens of a settled text that a repair would change; each once.

    A token whose own letters show no script takes that of the text, and as second choice Latin.
    """
    if text.isascii() or not HAS_FOREIGN.search(text):
        return []
    around, out = _script(text) or "L", {}
    found = set(FOREIGN_TOKEN.findall(text))
    if around != "L":
        found |= {t for t in set(TOKEN.findall(text)) if t.isascii() and t.isalpha() and all(c in AMBIGUOUS for c in t)}
    for token in found:
        own = _script(token)
        for k, s in enumerate([own] if own else dict.fromkeys((around, "L"))):
            result = unicodedata.normalize("NFC", token.translate(REPAIR[s]))
            if result != token:
                out[token, result] = min(k, out.get((token, result), 9))
    return [(t, r, k) for (t, r), k in out.items()]


def apply(text: str, pairs: dict[str, str]) -> str:
    """`text` with whole tokens replaced."""
    return unicodedata.normalize("NFC", TOKEN.sub(lambda m: pairs.get(m[0], m[0]), text)) if pairs else text


_PROPOSAL = pa.list_(pa.struct([("token", pa.string()), ("result", pa.string()), ("rank", pa.int32())]))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else settle(t) for t in batch.column(1).to_pylist()]
        found = [[{"token": a, "result": b, "rank": k} for a, b, k in proposals(t)] if t else [] for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), pa.array(found, _PROPOSAL)], names=["doc_id", "text", "spelling", "proposals"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of many settled texts at once, but for those that a repair would change."""
    seen: set[str] = set()
    for batch in batches:
        for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = set(TOKEN.findall(text))
            seen |= words.difference(asked) if asked else words
        if len(seen) > 300_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["word"])
            seen = set()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["word"])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [dict(p or []) for p in batch.column(3).to_pylist()]
        texts = [apply(t, p) for t, p in zip(batch.column(1).to_pylist(), pairs)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], names=["doc_id", "text", "spelling"])


def canonical(documents: DataFrame) -> DataFrame:
    """doc_id, text: every text in its consistent form; NULL stays NULL and empty stays empty. doc_id is taken as unique."""
    return _consistent(documents).select("doc_id", "text")


def _consistent(documents: DataFrame) -> DataFrame:
    """doc_id, text, spelling: the consistent form with a hash of the text as it was."""
    source = documents.select("doc_id", "text", F.md5("text").alias("spelling"))
    settled = cut(source.mapInArrow(_settled, "doc_id bigint, text string, spelling string, proposals array<struct<token:string,result:string,rank:int>>"))
    suspect = settled.filter(F.size("proposals") > 0)
    asked = suspect.select("doc_id", F.inline("proposals"))
    pairs = asked.groupBy("token", "result").agg(F.min("rank").alias("rank"))
    words = settled.filter("text IS NOT NULL").select("text", F.col("proposals.token")).mapInArrow(_words, "word string").distinct()
    known = pairs.join(words.withColumnRenamed("word", "result").withColumn("known", F.lit(True)), "result", "left")
    spellings = pairs.groupBy("result").agg(F.count_distinct("token").alias("spellings"))
    fit = known.join(spellings, "result").filter("known OR spellings > 1")
    best = fit.withColumn("k", F.row_number().over(W.partitionBy("token", "rank").orderBy("result"))).filter("k = 1").select("token", "result", "rank")
    chosen = asked.join(best, ["token", "result", "rank"]).withColumn("k", F.row_number().over(W.partitionBy("doc_id", "token").orderBy("rank", "result"))).filter("k = 1")
    fixes = chosen.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "result"))).alias("fixes"))
    fixed = suspect.select("doc_id", "text", "spelling").join(fixes, "doc_id", "left").mapInArrow(_repaired, "doc_id bigint, text string, spelling string")
    return settled.filter(F.size("proposals") == 0).select("doc_id", "text", "spelling").unionByName(fixed)


def same_look(documents: DataFrame) -> DataFrame:
    """Pairs of documents that look the same but are not the same characters: doc_id_a < doc_id_b.

    Spellings are paired first, each (form, spelling) once; documents come in only for spellings that have a partner, so a
    group of exact copies alone costs one aggregated row. NULL and blank texts give no pair.
    """
    rows = cut(_consistent(documents).filter(~F.col("text").rlike(r"^[\s\p{Z}]*$")).select("doc_id", F.md5("text").alias("form"), "spelling"))
    kinds = rows.select("form", "spelling").distinct()
    several = kinds.groupBy("form").count().filter("count > 1").select("form")
    live = kinds.join(several, "form", "left_semi")
    pair = live.withColumnRenamed("spelling", "sa").join(live.withColumnRenamed("spelling", "sb"), "form").filter("sa <> sb").select("sa", "sb")
    a, b = rows.select(F.col("spelling").alias("sa"), F.col("doc_id").alias("doc_id_a")), rows.select(F.col("spelling").alias("sb"), F.col("doc_id").alias("doc_id_b"))
    return pair.join(a, "sa").join(b, "sb").filter("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
