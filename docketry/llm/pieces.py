"""Problem 3: split oversized items at natural boundaries.

Recursive bisection. An item longer than the limit is cut at the strongest boundary near its middle (blank line, line end,
sentence end, clause, space; a hard cut only where there is none), and halves that still exceed the limit minus the overlap
are cut again. Each piece after the first is then extended to the left by up to the overlap, to a word start.
The work is a map over rows: no shuffle but the one that drops repeated rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1400, 220
#: Boundaries from strong to weak; a cut lies at the end of the match.
BREAKS = [re.compile(p) for p in (r"\n[^\S\n]*\n\s*|\f\s*|(?:\r\n?[^\S\r\n]*){2}\s*", r"\r\n?|\n", r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+", r"[,;:]\s+|\s[–—]\s|[、，；]", r"\s+")]
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def cuts(text: str, start: int, end: int, size: int) -> list[int]:
    """Cut positions inside text[start:end] so that no part is longer than `size`.

    Near the middle means the middle third; the strongest kind of boundary found there wins, the nearest to the middle among
    those of one kind. Where it holds none, the whole part is searched before a hard cut in the middle.
    """
    if end - start <= size:
        return []
    ends = [[m.end() for m in b.finditer(text, start, end)] for b in BREAKS]
    out, todo = [], [(start, end)]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            continue
        mid, best = (a + b) // 2, None
        for lo, hi in ((a + (b - a) // 3, b - (b - a) // 3), (a + 1, b - 1)):
            for e in ends:
                i = bisect_left(e, mid)
                near = [p for p in e[max(0, i - 1) : i + 1] if lo <= p <= hi]
                if near:
                    best = min(near, key=lambda p: abs(p - mid))
                    break
            if best:
                break
        cut = best or mid
        out.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(out)


def spans(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, core start) of each piece, in code points; of the text without white space at both ends. Blank or NULL: none. The overlap must be smaller than the limit."""
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} does not fit pieces of {limit}")
    if text is None:
        return []
    body = text.strip(WHITE)
    if not body:
        return []
    a = text.index(body[0]) if text[0] in WHITE else 0
    b = a + len(body)
    if b - a <= limit:
        return [(a, b, a)]
    edges = [a, *cuts(text, a, b, limit - overlap), b]
    out = [(edges[0], edges[1], edges[0])]
    for core, end in zip(edges[1:], edges[2:]):
        reach = max(edges[0], core - overlap)
        m = re.compile(r"(?<=\s)\S").search(text, reach, core) if reach > edges[0] else None
        out.append((m.start() if m else reach, end, core))
    return out


_NAMES = ["document_id", "page", "piece", "n_pieces", "start_char", "end_char", "overlap_chars", "oversized", "text"]
_KINDS = [pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 2, pa.int32(), pa.bool_(), pa.string()]
_SCHEMA = "document_id string, page int, piece int, n_pieces int, start_char bigint, end_char bigint, overlap_chars int, oversized boolean"


def _cutter(with_text: bool, limit: int, overlap: int):
    width = len(_NAMES) if with_text else len(_NAMES) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(width)]
            ids, texts, pages = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                own = pages[i].as_py()
                doc = ids[i].as_py()
                for page, t in [(k + 1, t) for k, t in enumerate(own)] if own else [(0, texts[i].as_py())]:
                    found = spans(t, limit, overlap)
                    for k, (s, e, core) in enumerate(found):
                        row = (doc, page, k + 1, len(found), s, e, core - s, found[-1][1] - found[0][0] > limit)
                        for c, v in zip(cols, (*row, t[s:e]) if with_text else row):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS)], names=_NAMES[:width])

    return run


def pieces(extracted: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces with their texts: document_id, page (0: the text), piece (from 1), n_pieces, start_char, end_char, overlap_chars, oversized, text.

    One set per document_id (repeated rows are identical and count once). NULL, empty and blank items give no piece; an item
    within the limit is its own single piece. Offsets are code points in the item as stored.
    """
    once = extracted.select("document_id", "text", "pages").dropDuplicates(["document_id"])
    return once.mapInArrow(_cutter(True, limit, overlap), _SCHEMA + ", text string")


def offsets(extracted: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """As `pieces`, without the texts and without a shuffle; a repeated row gives its pieces again."""
    return extracted.select("document_id", "text", "pages").mapInArrow(_cutter(False, limit, overlap), _SCHEMA)


def oversized(extracted: DataFrame) -> DataFrame:
    """The items that had to be cut: document_id, page; each once."""
    return offsets(extracted).filter("oversized AND piece = 1").select("document_id", "page").distinct()
