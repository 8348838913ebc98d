"""Problem 4: find and undo text decoded with the wrong character encoding.

Characters are mapped back to the bytes of the legacy encoding they were read with. Over those bytes a byte-structure
automaton (UTF-8 or Shift-JIS lead and trail bytes, compiled as a regular expression) marks the maximal well-formed
multibyte spans, and only those spans are decoded, again as long as something changes (text may be broken many times).

Legacy encodings of one byte have no such structure. What the automaton leaves is tried, stretch by stretch, under candidate
pairs (read as, really), and a pair is kept if it leaves fewer signs where no sign belongs: control characters, symbols inside
words, capitals inside words, loose frame characters (letters of whatever language are no such signs); for Cyrillic and Greek
the letter frequencies of the languages decide. Then the corpus is asked: where the words these steps take away are better
known in well-read texts than the words they bring, the steps are undone. A replacement character marks a stretch that cannot
be restored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import cut, few

OUTSIDE = chr(0x10FFFD)  # stands for a character that the legacy encoding does not have


@lru_cache(None)
def to_bytes(codec: str) -> dict[int, str]:
    """Character to the character of its byte. `cp1252` keeps the five bytes it leaves open, and the C1 controls, as themselves."""
    out: dict[int, str] = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            pass
    if codec == "cp1252":
        out |= {b: chr(b) for b in range(128, 160)}
    return out


class _Table(dict):
    def __missing__(self, c: int) -> str | int:
        return c if c < 128 else OUTSIDE


@lru_cache(None)
def table(codec: str) -> _Table:
    return _Table(to_bytes(codec))


#: The automaton of well-formed UTF-8 sequences of two to four bytes.
UTF8 = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
#: The automaton of Shift-JIS characters of two bytes, at least four in a row.
SJIS = re.compile("(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]){4,}")
#: What a decoded UTF-8 span may hold: letters and signs of the languages here; also what itself is a first layer of such a span.
FITTING = re.compile("[\u00a0-ſƒˆ˜Ά-ώЁА-яё\u2000-\u206f€℀-⅏←-⋿─-➿\u3000-ヿ一-鿿\ufe0f＀-￯\U0001f000-\U0001faff]+")
LAYER = re.compile("[\u0080-￿]+")
SINGLE_SCRIPT = re.compile("[Ά-ώЀ-џ]")
#: A span of one or two signs of these is no proof.
RARE = set("øåæþðýÿœžšÅØÆÞÐÝŒŽŠŸ") | {chr(c) for c in range(0x100, 0x180)}
READ_AS_UTF8 = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1253")


RUN = re.compile("[^\x00-\x7f]{2,}")
KANA = re.compile("[\u3001-\u30ff]")
CJK = re.compile("[\u4e00-\u9fff\uff00-\uffef]")


def _fits(new: str) -> bool:
    if FITTING.fullmatch(new) and not (len(new) < 3 and any(c in RARE for c in new)):
        return True
    laid = new.translate(table("cp1252"))  # a first layer: what it holds decodes once more
    return bool(UTF8.fullmatch(laid)) and _fits(laid.encode("latin-1").decode("utf-8"))


@lru_cache(200_000)
def _spans(run: str, codec: str) -> tuple[tuple[int, int, str], ...]:
    """The fitting UTF-8 spans (start, end, decoded) of a run of non-ASCII characters."""
    laid = run.translate(table(codec))
    return tuple((m.start(), m.end(), new) for m in UTF8.finditer(laid) if _fits(new := m[0].encode("latin-1").decode("utf-8")))


def _decode_utf8(text: str, codec: str, runs: set[str]) -> str:
    """Single letters of another script, and signs of Chinese writing without any kana, need a longer span of their kind in the text."""
    found = {r: s for r in runs if (s := _spans(r, codec))}
    if not found:
        return text
    decoded = [new for s in found.values() for *_, new in s]
    script = any(len(SINGLE_SCRIPT.findall(new)) > 1 for new in decoded)
    kana = any(KANA.search(new) for new in decoded)

    def swap(m: re.Match) -> str:
        out, at = [], 0
        for a, b, new in found.get(m[0], ()):
            if (SINGLE_SCRIPT.search(new) and not script) or (CJK.search(new) and not kana):
                continue
            out += [m[0][at:a], new]
            at = b
        return "".join([*out, m[0][at:]]) if at else m[0]

    return RUN.sub(swap, text)


def _decode_sjis(text: str) -> str:
    laid = text.translate(table("cp1252"))
    out, at = [], 0
    for m in SJIS.finditer(laid):
        try:
            new = m[0].encode("latin-1").decode("cp932")
        except UnicodeDecodeError:
            continue
        if sum("぀" <= c <= "ヿ" for c in new) * 6 >= len(new) and all(ord(c) >= 0x2000 for c in new):
            out += [text[at : m.start()], new]
            at = m.end()
    return "".join([*out, text[at:]]) if at else text


# Letters from frequent to rare.
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
GREEK = "αοιετσνηςρκπμυλίγδάέόωχήύθφξβώζψ"
SCORES = {c: math.log(1 / (i + 3)) for letters in (RUSSIAN, GREEK) for i, c in enumerate(letters)}
SCORES |= {c: math.log(1 / 12) for c in "іїєґјљњћђџўѕ"}  # letters of the other Cyrillic languages
HIGH_WORD = re.compile("[¡-ÿЀ-џҐґ‐-™]{3,}")
READ_AS = ("cp1252", "cp1251", "koi8_r", "mac_roman", "cp850", "cp437", "cp866")
REALLY = ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "iso8859_7")


def _score(words: list[str]) -> float:
    """Mean letter score; a capital after a small letter, and any sign that is no such letter, costs."""
    total, n = 0.0, 0
    for w in words:
        n += len(w)
        total += sum(SCORES.get(c, -8.0) for c in w.lower())
        total -= 2.0 * sum(b.isupper() and a.islower() for a, b in zip(w, w[1:]))
        total -= 1.0 * sum(c.isupper() for c in w[1:])
    return total / max(n, 1)


@lru_cache(None)
def _recoding(read_as: str, really: str) -> dict[int, str]:
    out = {}
    for c, b in to_bytes(read_as).items():
        try:
            out[c] = b.encode("latin-1").decode(really)
        except UnicodeDecodeError:
            pass
    return out


def _recode(text: str, read_as: str, really: str) -> str:
    """`text` with each character put back to its byte and read anew; characters outside the legacy encoding stay."""
    return text.translate(_recoding(read_as, really))


PLAIN = re.compile("(?:(?:[А-ЯЁ]?[а-яё]+|[Ά-Ϋ]?[ά-ώΐ]+) ?)+")  # words in one script with at most a capital at the start
SENTENCES = re.compile(r"(?<=[.!?;] )|(?<=\n)|(?<=\x0c)")


def _pair(words: list[str]) -> tuple[float, str, str]:
    """Score, (read as, really) of the encodings under which the words look best."""
    score, _, a, b = max((_score([_recode(w, a, b) for w in words]), -k, a, b) for k, (a, b) in enumerate((a, b) for a in READ_AS for b in REALLY if a != b))
    return score, a, b


def _foreign_words(text: str) -> str:
    """Cyrillic or Greek read with another one-byte encoding: the sentences whose letters do not look like either language.

    The encodings are chosen from all words of all such sentences; a sentence that stays unlike either language under them
    takes its own, if those fit clearly better.
    """
    parts = SENTENCES.split(text)
    words = [[w for w in HIGH_WORD.findall(s) if any(c.isalpha() for c in w)] for s in parts]
    bad = [k for k, w in enumerate(words) if len(w) > 1 and not PLAIN.fullmatch(" ".join(w)) and sum(map(len, w)) >= 10 and _score(w) < -3.2]
    if not bad:
        return text
    _, a, b = _pair([w for k in bad for w in words[k]])
    groups: dict[tuple[str, str], list[int]] = {}
    for k in bad:
        score, pair = _score([_recode(w, a, b) for w in words[k]]), (a, b)
        if len(bad) > 1 and score < -3.0 and (own := _pair(words[k]))[0] > score + 0.3 and own[0] >= -3.0:
            pair = own[1:]
        groups.setdefault(pair, []).append(k)
    out = list(parts)
    for (a, b), group in groups.items():
        sample = [w for k in group for w in words[k]]
        score = _score([_recode(w, a, b) for w in sample])
        if score < -3.0 or score < _score(sample) + 0.7:
            continue
        close = {k + d for k in group for d in (-1, 1) if 0 <= k + d < len(parts) and sum(map(len, words[k + d])) < 10}
        for k in {*group, *close}:
            if k in group or HIGH_WORD.search(parts[k]):
                out[k] = _recode(parts[k], a, b)
    return "".join(out)


FRAME = "─-▟"
#: Signs that well-read text of these languages does not show.
ODD = re.compile(
    "[\x80-\x84\x86-\x9f]|(?<=[A-Za-zÀ-ÿ])[¤¦¨¯´¸¼¾·®ƒ×÷⌐₧]|[¤¦¨¯´¸¼¾®ƒ⌐₧](?=[A-Za-z])"  # signs in words
    "|(?<![A-Za-zÀ-ž])mý(?![a-z])|(?<=[0-9])[ýþ]|[·](?=[0-9])|(?<![^ \n])[¸¨´¯](?![^ \n])|(?<![^ \n(])ª(?= )"  # raised figures and signs read as letters
    f"|(?<=[a-zà-ÿ])[ÆØÞÐÝÅ](?=[a-zà-ÿ ,.;)])"  # capitals in small-letter words
    f"|(?<=[A-Za-z])[¡¢£¥©«¬°±³µ¶¹»½¿†‡…‰™ˆ˜‚„•](?=[A-Za-z])"  # signs inside a word
    f"|(?<=[A-Za-z0-9])[{FRAME}]|[{FRAME}](?=[A-Za-z0-9])|(?<![^ \n])[│┤┐┴┬═║╔╗╝╡╢░-▓](?= )"  # loose frames
    "|(?<=[a-z])[À-ÖØ-Þ](?=[a-z ,.;)])|(?<=[A-Z])[à-öø-þ](?=[A-Z])|(?<=[A-Z])ß(?=[A-Z])"  # capitals and small letters in each other's words
    "|(?<=[A-Za-z])[\u0370-\u03ff∩⌠⌡≈≡≤≥ⁿ∂∑∏∫◊ı]|[\u0370-\u03ff∩⌠⌡≈≡≤≥ⁿ∂∑∏∫◊](?=[A-Za-z])|∞"
    "|[¶©§µ](?=[A-Za-z])|(?<=[a-z])[µ§¶©¢¡¥\x80-\x9f‚†‡ˆ‰](?=[a-z ,.;])|(?<![^ \n(])[ñõøõÒÓõÝ](?= [0-9])|╚|┘"
    "|(?<![A-Za-zÀ-ÿ])[ß-öø-ÿ](?=[A-Z0-9])|(?<=[0-9])[ß-öø-ÿœ](?=[0-9])|[œŒ](?=[0-9])|(?<=[,.;!?])[À-ÖØ-öø-ÿ](?= )"  # quotes, dashes and money signs read as letters
    "|(?<![^ \n(])º(?= [0-9])|(?<![^ \n(])[ÂÃÄÇÊËÎÏÑÔÕÖÛÜâãäçêëîïñõöûü](?= )"  # letters standing alone that are no words
)
LATIN_PAIRS = (("cp1252", "cp850"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp437"))


@lru_cache(400_000)
def _odd_word(word: str) -> int:
    return sum(1 for _ in ODD.finditer(word))


TURKIC = re.compile("[ğşĞŞİ]")


def odd(text: str, dotless: bool = False) -> int:
    """Odd signs of a text: over its words with non-ASCII characters, each seen with the digit that follows it, if one does. `dotless`: the text is of a language with the letter ı."""
    words = (text.replace("ı", "i") if dotless else text).split()
    total = 0
    for i in [i for i, w in enumerate(words) if not w.isascii()]:
        w, after = words[i], words[i + 1][0] if i + 1 < len(words) else ""
        total += _odd_word(f" {w} {after if after.isdigit() else ''}")
    return total


def _latin_stretches(text: str, before: int, dotless: bool) -> str:
    """Latin text read with another one-byte encoding: sentence by sentence, where that leaves fewer odd signs."""
    pairs = sorted((odd(_recode(text, a, b), dotless), k) for k, (a, b) in enumerate(LATIN_PAIRS))
    sentences = SENTENCES.split(text)
    best, best_left = text, before
    for _, k in pairs:  # a pair may spoil the good part of a text and yet be right for one sentence, so all are tried
        a, b = LATIN_PAIRS[k]
        out, on = [], False
        for s in sentences:
            if s.isascii():
                out.append(s)
                continue
            new = _recode(s, a, b)
            was, now = odd(s, dotless), odd(new, dotless)
            on = now < was or (on and now == was == 0)
            out.append(new if on else s)
        joined = "".join(out)
        left = odd(joined, dotless)
        if left < best_left:
            best, best_left = joined, left
    return best


#: What shows a stretch that could not be restored: a replacement character or a control character of the C1 block.
LOST = re.compile("[\x80-\x84\x86-\x9f\ufffd]")


class Outcome(NamedTuple):
    """What became of a text: restored, whether a wrongly decoded stretch was found, what was done; and the same for the multibyte steps alone."""

    text: str | None
    found: bool
    how: str
    sure_text: str | None
    sure_found: bool
    sure_how: str


def steps(text: str | None) -> Outcome:
    """The text restored by the byte automaton, as often as it changes something, and then by the one-byte steps."""
    if text is None or text.isascii():
        return Outcome(text, False, "", text, False, "")
    done, now = [], text
    while True:
        runs = set(RUN.findall(now))
        options = [(codec, new) for codec in READ_AS_UTF8 if runs and (new := _decode_utf8(now, codec, runs)) != now]
        if not options:
            break
        codec, now = min(options, key=lambda x: (odd(x[1]), len(x[1]))) if len(options) > 1 else options[0]  # a decoded span is shorter, so this ends
        done.append(f"utf-8 as {codec}")
    high = len(HIGH_WORD.findall(now)) > 1
    foreign = _foreign_words(now) if high else now
    if foreign == now and high and not (done and KANA.search(now)) and (new := _decode_sjis(now)) != now:
        done.append("shift-jis as cp1252")
        now = foreign = new
    sure, sure_done, lost = now, list(done), bool(LOST.search(now))
    while foreign != now:
        done += [] if "one-byte" in done else ["one-byte"]
        now, foreign = foreign, _foreign_words(foreign)
    dotless = bool(TURKIC.search(now))
    left = odd(now, dotless)
    if left and (new := _latin_stretches(now, left, dotless)) != now:
        done.append("one-byte latin")
        now = new
    still = bool(LOST.search(now))
    tell = lambda parts, gone: ", ".join([*parts, *["lost"] * gone])
    return Outcome(now, bool(done) or still, tell(done, still), sure, bool(sure_done) or lost, tell(sure_done, lost))


def restore(text: str | None) -> tuple[str | None, bool, str]:
    """(text with wrongly decoded stretches restored, whether any was found, what was done).

    NULL, empty and blank texts come back as they are. A found stretch that cannot be restored stays as it is.
    """
    return steps(text)[:3]


LETTERS = re.compile(r"[^\W\d_]+")
_VOCABULARY = r"[\p{L}\p{M}]*[^\x00-\x7f\P{L}][\p{L}\p{M}]*"


def _high_words(text: str | None) -> set[str]:
    return {w for w in LETTERS.findall(text or "") if not w.isascii()}


_SCAN = "document_id string, text string, pages array<string>, found boolean, how string, sure_text string, sure_pages array<string>, sure_found boolean, sure_how string, bad array<string>, good array<string>"


def _scanned(with_text: bool):
    """Both outcomes of every row; the second one's texts, and the words by which they differ, only where one-byte steps did something."""
    strings = pa.list_(pa.string())
    kinds = [pa.string(), pa.string(), strings, pa.bool_(), pa.string(), pa.string(), strings, pa.bool_(), pa.string(), strings, strings]
    names = ["document_id", "text", "pages", "found", "how", "sure_text", "sure_pages", "sure_found", "sure_how", "bad", "good"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, p in zip(*(c.to_pylist() for c in batch.columns)):
                whole = steps(t)
                parts = None
                if p is not None and (whole.found or t is None or t != "\f".join(x or "" for x in p)):
                    parts = [steps(x) for x in p]
                every = [whole, *(parts or [])]
                tell = lambda k: "; ".join(dict.fromkeys(x[k] for x in every if x[k])) or None
                bad, good = set(), set()
                for x in every:
                    if x.text != x.sure_text:
                        before, after = _high_words(x.sure_text), _high_words(x.text)
                        bad |= before - after
                        good |= after - before
                differs = any(x.text != x.sure_text for x in every)
                pages = lambda k: p if parts is None else [x[k] for x in parts]
                texts = (whole.text, pages(0), whole.sure_text if differs else None, pages(3) if differs else None) if with_text else (None,) * 4
                out.append((i, texts[0], texts[1], any(x.found for x in every), tell(2), texts[2], texts[3], any(x.sure_found for x in every), tell(5), sorted(bad) if differs else None, sorted(good) if differs else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=names)

    return run


def _judged(extracted: DataFrame, with_text: bool) -> DataFrame:
    """The scanned rows with `kept`: whether the words of the corpus speak for the one-byte steps.

    One-byte decoding has no structure to prove it. So the words such steps take away and the words they bring are looked up in
    the texts in which nothing was found: where those they take away are the better known, the steps are undone. Words are
    counted over all such texts; only the words in question are counted, and meet the texts in a broadcast while they are few.
    """
    scanned = cut(extracted.select("document_id", "text", "pages").mapInArrow(_scanned(with_text), _SCAN))
    doubtful = scanned.filter("bad IS NOT NULL").select("document_id", "bad", "good").dropDuplicates(["document_id"])
    pairs = cut(doubtful.select("document_id", F.explode("bad").alias("word"), F.lit(-1).alias("side")).unionByName(doubtful.select("document_id", F.explode("good").alias("word"), F.lit(1).alias("side"))))
    asked = few(cut(pairs.select("word").distinct()))
    broken = scanned.filter("found").select("document_id").distinct()
    well_read = extracted.select("document_id", "text").join(broken, "document_id", "left_anti")
    known = well_read.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_VOCABULARY), F.lit(0)))).alias("word")).join(asked, "word").groupBy("word").agg(F.count("*").alias("n"))
    votes = pairs.join(known, "word").groupBy("document_id").agg(F.sum(F.col("side") * F.ln(1.0 + F.col("n"))).alias("votes"))
    return scanned.join(votes, "document_id", "left").withColumn("kept", F.coalesce(F.col("votes") >= 0, F.lit(True)))


def restored(extracted: DataFrame) -> DataFrame:
    """document_id, text, pages (both restored where possible), found, how. One row per row; NULLs stay NULL."""
    pick = lambda c: F.when(F.col("kept") | F.col("bad").isNull(), F.col(c)).otherwise(F.col(f"sure_{c}")).alias(c)
    return _judged(extracted, True).select("document_id", *[pick(c) for c in ("text", "pages", "found", "how")])


def wrongly_decoded(extracted: DataFrame) -> DataFrame:
    """document_id of texts with at least one wrongly decoded stretch, restorable or not; each once."""
    found = F.when(F.col("kept") | F.col("bad").isNull(), F.col("found")).otherwise(F.col("sure_found"))
    return _judged(extracted, False).filter(found).select("document_id").distinct()
