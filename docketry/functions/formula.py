"""The spreadsheet functions as Column builders over scalar columns and arrays (ranges).

A function takes and returns Columns, so Catalyst sees through it. Errors travel as NULL; `error_code` names them from the
operands. Numbers are doubles. Ranges are arrays of strings or numbers; blanks and words in them do not count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

D = lambda c: c.cast("double")


def number(c: Column) -> Column:
    """The number at the start of a text without currency signs, commas and spaces; blank is 0, no number NULL."""
    bare = F.regexp_replace(c.cast("string"), r"[$,\s]", "")
    lead = F.regexp_extract(bare, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(bare == "", F.lit(0.0)).when(lead != "", lead.try_cast("double"))


def is_number_text(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c.cast("string"), r"[$,\s]", "").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))


def numbers(range_: Column) -> Column:
    """The numeric cells of a range."""
    return F.transform(F.filter(range_, lambda x: is_number_text(x)), number)


def sum_(r: Column) -> Column:
    return F.aggregate(numbers(r), F.lit(0.0), lambda a, x: a + x)


def product(r: Column) -> Column:
    return F.aggregate(numbers(r), F.lit(1.0), lambda a, x: a * x)


def count(r: Column) -> Column:
    return F.size(numbers(r))


def counta(r: Column) -> Column:
    return F.size(F.filter(r, lambda x: F.coalesce(F.trim(x.cast("string")) != "", F.lit(False))))


def average(r: Column) -> Column:
    """NULL (#DIV/0!) without numbers."""
    return F.try_divide(sum_(r), D(count(r)))


def min_(r: Column) -> Column:
    return F.array_min(numbers(r))


def max_(r: Column) -> Column:
    return F.array_max(numbers(r))


def sumproduct(a: Column, b: Column) -> Column:
    """NULL (#VALUE!) for ranges of unequal size; blanks and words count as 0."""
    val = lambda x: F.when(is_number_text(x), number(x)).otherwise(F.lit(0.0))
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: val(x) * val(y)), F.lit(0.0), lambda s, x: s + x))


def abs_(x: Column) -> Column:
    return F.abs(D(x))


def sqrt(x: Column) -> Column:
    return F.when(D(x) >= 0, F.sqrt(D(x)))


def power(x: Column, y: Column) -> Column:
    return F.pow(D(x), D(y))


def mod(x: Column, y: Column) -> Column:
    """Sign of the dividend; NULL (#NUM!) by 0."""
    return F.when(D(y) != 0, F.try_mod(D(x), D(y)))


def int_(x: Column) -> Column:
    return D(F.floor(D(x)))


def _scaled(x: Column, digits: Column, fn) -> Column:
    f = F.pow(F.lit(10.0), D(digits))
    return D(fn(D(x) * f)) / f


def round_(x: Column, digits: Column) -> Column:
    """Half goes toward plus infinity."""
    return _scaled(x, digits, lambda v: F.floor(v + 0.5))


def roundup(x: Column, digits: Column) -> Column:
    """Toward plus infinity, also for negative numbers."""
    return _scaled(x, digits, F.ceil)


def rounddown(x: Column, digits: Column) -> Column:
    """Toward minus infinity, also for negative numbers."""
    return _scaled(x, digits, F.floor)


def floor_(x: Column, step: Column) -> Column:
    return F.when(D(step) != 0, D(F.floor(D(x) / D(step))) * D(step))


def ceiling(x: Column, step: Column) -> Column:
    return F.when(D(step) != 0, D(F.ceil(D(x) / D(step))) * D(step))


def truth(c: Column) -> Column:
    """TRUE and FALSE as text or boolean, numbers other than 0; NULL (#VALUE!) for other text."""
    t = F.upper(F.trim(c.cast("string")))
    return F.when(t == "TRUE", True).when(t == "FALSE", False).otherwise(number(c) != 0)


def if_(test: Column, yes: Column, no: Column) -> Column:
    return F.when(test, yes).otherwise(no)


def ifs(*pairs: tuple[Column, Column]) -> Column:
    """The value of the first test that holds; NULL (#N/A) if none does."""
    out = F.lit(None)
    for test, value in reversed(pairs):
        out = F.when(test, value).otherwise(out)
    return out


def and_(r: Column) -> Column:
    return F.forall(r, truth)


def or_(r: Column) -> Column:
    return F.exists(r, truth)


def not_(c: Column) -> Column:
    return ~truth(c)


def concat(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def textjoin(sep: str, skip_empty: bool, r: Column) -> Column:
    cells = F.transform(r, lambda x: F.coalesce(x.cast("string"), F.lit("")))
    return F.array_join(F.filter(cells, lambda x: x != "") if skip_empty else cells, sep)


def len_(s: Column) -> Column:
    """UTF-16 units: characters beyond the first plane count two."""
    return F.length(s) + F.length(F.regexp_replace(s, r"[^\x{10000}-\x{10ffff}]", ""))


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def trim(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def proper(s: Column) -> Column:
    return F.initcap(s)


def left(s: Column, n: Column) -> Column:
    """0 counts as 1."""
    return F.substring(s, F.lit(1), F.when(n == 0, 1).otherwise(n))


def right(s: Column, n: Column) -> Column:
    """0 counts as 1."""
    return F.right(s, F.when(n == 0, 1).otherwise(n))


def mid(s: Column, start: Column, n: Column) -> Column:
    return F.substring(s, F.greatest(start, F.lit(1)), n)


def find(what: Column, s: Column) -> Column:
    """Place from 1; NULL (#VALUE!) if not found."""
    return F.nullif(F.expr("0") + F.position(what, s), F.lit(0))


def search(what: Column, s: Column) -> Column:
    return find(F.lower(what), F.lower(s))


def substitute(s: Column, old: Column, new: Column) -> Column:
    return F.replace(s, old, new)


def _meets(cell: Column, criterion: str) -> Column:
    for op in (">=", "<=", "<>", ">", "<", "="):
        if criterion.startswith(op):
            break
    else:
        op, criterion = "=", "=" + criterion
    want = criterion[len(op) :].strip()
    try:
        a, b, num = number(cell), F.lit(float(want)), is_number_text(cell)
    except ValueError:
        a, b, num = F.lower(cell.cast("string")), F.lit(want.lower()), F.lit(True)
    test = {">=": a >= b, "<=": a <= b, "<>": a != b, ">": a > b, "<": a < b, "=": a == b}[op]
    return F.coalesce(F.when(num, test), F.lit(op == "<>"))


def countif(r: Column, criterion: str) -> Column:
    return F.size(F.filter(r, lambda x: _meets(x, criterion)))


def sumif(r: Column, criterion: str, sums: Column | None = None) -> Column:
    pairs = F.zip_with(r, r if sums is None else sums, lambda c, v: F.struct(c.alias("c"), v.alias("v")))
    kept = F.filter(pairs, lambda p: _meets(p["c"], criterion) & is_number_text(p["v"]))
    return F.aggregate(kept, F.lit(0.0), lambda a, p: a + number(p["v"]))


def error_code(op: str, *operands: Column) -> Column:
    """The error of an operation over operands as typed in cells, NULL where there is none: `#VALUE!` for a word where a number is needed, `#DIV/0!` for a division by zero or a mean of nothing, `#NUM!` for a root of a negative number or a power without a value. An error among the operands goes through, the first one.

    `op`: one of `+ - * / % ^` (two operands), `MOD`, `SQRT`, `POWER`, `AVERAGE` (one operand, a range).
    """
    if op == "AVERAGE":
        return F.when(count(operands[0]) == 0, "#DIV/0!")
    out = F.lit(None).cast("string")
    for c in operands:
        text = c.cast("string")
        out = F.coalesce(out, F.when(text.rlike(r"^#[A-Z/0!?]+$"), text))
    for c in operands:
        out = F.coalesce(out, F.when(number(c).isNull() & c.isNotNull(), "#VALUE!"))
    n = [F.coalesce(number(c), F.lit(0.0)) for c in operands]
    if op in ("/", "MOD"):
        out = F.coalesce(out, F.when(n[1] == 0, "#DIV/0!"))
    if op == "SQRT":
        out = F.coalesce(out, F.when(n[0] < 0, "#NUM!"))
    if op in ("^", "POWER"):
        out = F.coalesce(out, F.when(F.isnan(F.pow(n[0], n[1])) | (F.abs(F.pow(n[0], n[1])) == float("inf")), "#NUM!"))
    return out


def today() -> Column:
    return F.current_date()


def now() -> Column:
    return F.current_timestamp()


def display(x: Column) -> Column:
    """Rounded to ten decimals; no number is #NUM!, an infinite one #DIV/0!."""
    v = F.floor(D(x) * 1e10 + 0.5) / 1e10
    return F.when(F.isnan(D(x)), "#NUM!").when(F.abs(D(x)) == float("inf"), "#DIV/0!").otherwise(F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string")))


def column_name(i: Column) -> Column:
    """0 → A, 25 → Z, 26 → AA; up to ZZZ."""
    letter = lambda n: F.chr((F.lit(65) + n).cast("int"))
    one = letter(i)
    two = F.concat(letter(F.floor((i - 26) / 26)), letter((i - 26) % 26))
    k = i - 702
    three = F.concat(letter(F.floor(k / 676)), letter(F.floor(k / 26) % 26), letter(k % 26))
    return F.when(i < 26, one).when(i < 702, two).otherwise(three)


def column_index(name: Column) -> Column:
    """A → 0, Z → 25, AA → 26."""
    return F.aggregate(F.split(F.upper(name), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64)) - 1
