"""Queries over the spreadsheet functions. Every order is a sheet: a row per line, columns quantity, price, discount, tax."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions import formula as m
from docketry.operators import sheet
from docketry.session import read_table as t

COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _cells(s, b):
    lines = t(s, b, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(x).alias(x) for x in COLS])
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.when(F.col("gap"), F.lit(" ")).otherwise(F.concat((F.col(x) + 0.0).cast("decimal(18,2)").cast("string"), F.lit(", x") if i == 3 else F.lit(""))).alias("v")) for i, x in enumerate(COLS)])
    return lines.withColumn("gap", F.col("l_linenumber") == 2).select(F.col("l_orderkey").alias("sheet_id"), (F.col("l_linenumber") - 1).alias("r"), F.explode(cells).alias("x")).select("sheet_id", "r", "x.c", "x.v")


def _formulas(s, b):
    """Running totals in column E: the first cell reads its own row, the others the cell above; one order in ten closes the circle."""
    lines = t(s, b, "lineitem").select(F.col("l_orderkey").alias("sheet_id"), (F.col("l_linenumber") - 1).alias("r")).distinct()
    own = F.concat(F.lit("=SUM($B"), (F.col("r") + 1).cast("string"), F.lit(":D"), (F.col("r") + 1).cast("string"), F.lit(")"))
    above = F.concat(F.lit("=E"), F.col("r").cast("string"), F.lit("+B"), (F.col("r") + 1).cast("string"))
    loop = (F.col("sheet_id") % 10 == 0) & (F.col("r") == 0)
    return lines.select("sheet_id", "r", F.lit(4).alias("c"), F.when(loop, "=E1*2").when(F.col("r") == 0, own).otherwise(above).alias("f"))


def _ranges(s, b):
    """Per order its quantities and prices as ranges, with a word and a blank among them."""
    x = t(s, b, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))).alias("x"))
    text = lambda f: F.transform("x", lambda e: e[f].cast("decimal(18,2)").cast("string"))
    return x.select("l_orderkey", F.concat(text("l_quantity"), F.array(F.lit("n/a"), F.lit(""))).alias("q"), F.concat(text("l_extendedprice"), F.array(F.lit("7"), F.lit("1"))).alias("p"))


def _aggregates(s, b):
    q, p, r = F.col("q"), F.col("p"), lambda c: F.round(c, 4)
    return _ranges(s, b).select(
        "l_orderkey", r(m.sum_(q)).alias("sum"), r(m.average(q)).alias("average"), m.min_(q).alias("min"), m.max_(q).alias("max"), m.count(q).cast("long").alias("count"), m.counta(q).cast("long").alias("counta"),
        r(m.sumproduct(q, p)).alias("sumproduct"), m.countif(q, ">=25").cast("long").alias("countif"), r(m.sumif(q, "<25", p)).alias("sumif"), m.countif(q, "N/A").cast("long").alias("count_word"), m.textjoin("|", True, q).alias("joined"),
    )


def _math(s, b):
    x, n = F.col("p_retailprice"), F.lit(1)
    return t(s, b, "part").select(
        "p_partkey", m.round_(-x, n).alias("round"), m.roundup(-x, n).alias("roundup"), m.rounddown(-x, n).alias("rounddown"), F.round(m.sqrt(x), 6).alias("sqrt"), F.round(m.power(F.col("p_size"), F.lit(2)), 2).alias("power"),
        m.mod(-F.col("p_size"), F.lit(7)).alias("mod"), m.mod(F.col("p_size"), F.lit(0)).alias("mod0"), m.int_(-x).alias("int"), m.floor_(x, F.lit(5)).alias("floor"), m.ceiling(x, F.lit(5)).alias("ceiling"), m.abs_(-x).alias("abs"),
        m.column_name(F.col("p_partkey") % 18000).alias("col_name"), m.column_index(m.column_name(F.col("p_partkey") % 18000)).cast("long").alias("col_index"),
    )


def _text(s, b):
    n, y = F.col("p_name"), F.col("p_type")
    return t(s, b, "part").select(
        "p_partkey", m.left(n, F.lit(0)).alias("left0"), m.left(n, F.lit(4)).alias("left"), m.right(n, F.lit(3)).alias("right"), m.mid(n, F.lit(2), F.lit(3)).alias("mid"), m.len_(n).cast("long").alias("len"), m.upper(n).alias("upper"), m.proper(m.lower(y)).alias("proper"),
        m.trim(m.concat(F.lit("  "), n, F.lit("   "), y)).alias("trim"), m.find(F.lit("e"), n).cast("long").alias("find"), m.search(F.lit("E"), n).cast("long").alias("search"), m.substitute(n, F.lit("a"), F.lit("_")).alias("substitute"),
        m.number(m.concat(F.lit("$ "), F.col("p_size"), F.lit(" pcs"))).alias("number"), m.number(n).alias("no_number"), m.display(m.number(F.col("p_retailprice"))).alias("shown"),
    )


def _logic(s, b):
    q, d = F.col("l_quantity"), F.col("l_discount") + 0.0
    return t(s, b, "lineitem").select(
        "l_orderkey", "l_linenumber", m.if_(q > 25, F.lit("big"), F.lit("small")).alias("if_"), m.ifs((q > 40, F.lit("a")), (q > 20, F.lit("b"))).alias("ifs"),
        m.and_(F.array(F.lit("TRUE"), q.cast("string"))).alias("and_"), m.or_(F.array(F.lit("FALSE"), d.cast("string"))).alias("or_"), m.not_(F.lit("true")).alias("not_"), m.truth(F.lit("word")).alias("word"),
    )


QUERIES = {
    "formula_math": _math,
    "formula_text": _text,
    "formula_logic": _logic,
    "formula_ranges": _aggregates,
    "sheet_csv": lambda s, b: sheet.csv_rows(_cells(s, b)),
    "sheet_used_range": lambda s, b: sheet.used_range(_cells(s, b)).select("sheet_id", F.col("max_r").cast("long").alias("max_r"), F.col("max_c").cast("long").alias("max_c")),
    "sheet_references": lambda s, b: sheet.references(_formulas(s, b)).groupBy("sheet_id").agg(F.count("*").alias("n"), F.sum(F.col("rr") * 100 + F.col("rc")).alias("total")),
    "sheet_levels": lambda s, b: sheet.calculation_levels(_formulas(s, b)).select("sheet_id", F.col("r").cast("long").alias("r"), F.col("level").cast("long").alias("level")),
    "sheet_paste": lambda s, b: sheet.pasted(t(s, b, "part").select(F.col("p_partkey").alias("sheet_id"), F.lit(198).alias("r0"), F.lit(24).alias("c0"), F.concat("p_name", F.lit("\t "), "p_brand", F.lit("\t x\r\n\n"), "p_type", F.lit("\t=A1\nlost")).alias("block"))),
}

_CELLS = """(SELECT l_orderkey AS sheet_id, l_linenumber - 1 AS r, unnest([0, 1, 2, 3]) AS c, unnest([CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_discount + 0.0 AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(l_tax + 0.0 AS DECIMAL(18,2)) AS VARCHAR) || ', x']) AS v FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2))"""
#: The second line of every order is a row of blank cells.
_CELLS = f"(SELECT sheet_id, r, c, CASE WHEN r = 1 THEN ' ' ELSE v END AS v FROM {_CELLS})"
_LINES = "(SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"

SQL = {
    "formula_ranges": """WITH x AS (SELECT l_orderkey, CAST(l_quantity AS DECIMAL(18,2)) AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, l_linenumber AS k FROM lineitem)
        SELECT l_orderkey, round(CAST(sum(q) AS DOUBLE), 4) AS sum, round(CAST(sum(q) AS DOUBLE) / count(*), 4) AS average, CAST(min(q) AS DOUBLE) AS min, CAST(max(q) AS DOUBLE) AS max, count(*) AS count, count(*) + 1 AS counta,
        round(sum(CAST(q AS DOUBLE) * CAST(p AS DOUBLE)), 4) AS sumproduct, count(*) FILTER (q >= 25) AS countif, round(coalesce(CAST(sum(p) FILTER (q < 25) AS DOUBLE), 0), 4) AS sumif, 1 AS count_word, string_agg(CAST(q AS VARCHAR), '|' ORDER BY k, q, p) || '|n/a' AS joined FROM x GROUP BY l_orderkey""",
    "formula_math": """SELECT p_partkey, floor(-p_retailprice * 10.0 + 0.5) / 10.0 AS round, ceil(-p_retailprice * 10.0) / 10.0 AS roundup, floor(-p_retailprice * 10.0) / 10.0 AS rounddown, round(sqrt(p_retailprice), 6) AS sqrt, CAST(p_size * p_size AS DOUBLE) AS power,
        CAST((-p_size) % 7 AS DOUBLE) AS mod, CAST(NULL AS DOUBLE) AS mod0, floor(-p_retailprice) AS int, floor(p_retailprice / 5) * 5 AS floor, ceil(p_retailprice / 5) * 5 AS ceiling, p_retailprice AS abs,
        CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) WHEN i < 702 THEN chr(CAST(65 + (i - 26) // 26 AS INTEGER)) || chr(CAST(65 + (i - 26) % 26 AS INTEGER)) ELSE chr(CAST(65 + (i - 702) // 676 AS INTEGER)) || chr(CAST(65 + ((i - 702) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (i - 702) % 26 AS INTEGER)) END AS col_name,
        i AS col_index FROM (SELECT *, p_partkey % 18000 AS i FROM part)""",
    "formula_text": r"""SELECT p_partkey, p_name[1:1] AS left0, p_name[1:4] AS "left", right(p_name, 3) AS "right", substring(p_name, 2, 3) AS mid, length(p_name) AS len, upper(p_name) AS upper,
        array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS proper, trim(regexp_replace('  ' || p_name || '   ' || p_type, '\s+', ' ', 'g')) AS trim,
        nullif(strpos(p_name, 'e'), 0) AS find, nullif(strpos(lower(p_name), 'e'), 0) AS search, replace(p_name, 'a', '_') AS substitute, CAST(p_size AS DOUBLE) AS number, CAST(NULL AS DOUBLE) AS no_number,
        CASE WHEN floor(p_retailprice) = p_retailprice THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS shown FROM part""",
    "formula_logic": """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS if_, CASE WHEN l_quantity > 40 THEN 'a' WHEN l_quantity > 20 THEN 'b' END AS ifs, l_quantity <> 0 AS and_, l_discount <> 0 AS or_, false AS not_, CAST(NULL AS BOOLEAN) AS word FROM lineitem""",
    "sheet_csv": f"""WITH x AS {_CELLS}, u AS (SELECT sheet_id, max(r) AS mr, max(c) AS mc FROM x WHERE trim(v) <> '' GROUP BY 1), g AS (SELECT sheet_id, unnest(range(mr + 1)) AS r, mc FROM u), h AS (SELECT sheet_id, r, unnest(range(mc + 1)) AS c FROM g)
        SELECT h.sheet_id, h.r, string_agg(CASE WHEN regexp_matches(coalesce(v, ''), '[",]') THEN '"' || replace(v, '"', '""') || '"' ELSE coalesce(v, '') END, ',' ORDER BY h.c) AS line FROM h LEFT JOIN x ON x.sheet_id = h.sheet_id AND x.r = h.r AND x.c = h.c GROUP BY 1, 2""",
    "sheet_used_range": f"SELECT sheet_id, max(r) AS max_r, max(c) AS max_c FROM {_CELLS} WHERE trim(v) <> '' GROUP BY 1",
    "sheet_references": f"""SELECT l_orderkey AS sheet_id, CAST(sum(CASE WHEN l_linenumber > 1 THEN 2 WHEN l_orderkey % 10 = 0 THEN 1 ELSE 3 END) AS BIGINT) AS n,
        CAST(sum(CASE WHEN l_linenumber > 1 THEN (l_linenumber - 2) * 100 + 4 + (l_linenumber - 1) * 100 + 1 WHEN l_orderkey % 10 = 0 THEN 4 ELSE 6 END) AS BIGINT) AS total FROM {_LINES} GROUP BY 1""",
    "sheet_levels": f"""WITH l AS {_LINES}, f AS (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM l),
        k AS (SELECT l_orderkey, l_linenumber, run, row_number() OVER (PARTITION BY l_orderkey, run ORDER BY l_linenumber) AS level FROM f)
        SELECT l_orderkey AS sheet_id, l_linenumber - 1 AS r, CASE WHEN l_orderkey % 10 = 0 AND run = 0 THEN NULL ELSE level END AS level FROM k""",
    "sheet_paste": """SELECT p_partkey AS sheet_id, 198 AS r, 24 AS c, trim(p_name) AS v FROM part UNION ALL SELECT p_partkey, 198, 25, trim(p_brand) FROM part UNION ALL SELECT p_partkey, 199, 24, trim(p_type) FROM part UNION ALL SELECT p_partkey, 199, 25, '=A1' FROM part""",
}
