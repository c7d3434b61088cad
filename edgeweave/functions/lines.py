"""Scalars over lines and texts: classify, un-escape, merge, extract, clean, repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import col, let

# Fixed values of the text format: the tag of a fence, arrow variants, misspelt keys, fields of a unit range.
FENCE_TAG = "stl"
ARROWS = (("➔", "->"), ("➡", "->"), ("➜", "->"), ("⮕", "->"), ("＝＞", "->"), ("=>", "->"), ("- >", "->"), ("—>", "->"), ("–>", "->"))
TYPOS = {
    "confience": "confidence", "confindence": "confidence", "confidece": "confidence", "strenght": "strength", "stength": "strength",
    "timestap": "timestamp", "timestmp": "timestamp", "authro": "author", "auther": "author", "soruce": "source", "souce": "source",
    "certianty": "certainty", "certinty": "certainty", "conditionalty": "conditionality", "intensty": "intensity",
}
CLAMPED = ("certainty", "confidence", "intensity", "strength")
STATEMENT_TYPES = ("complete_statement", "minimal_statement")
_ENDS = r"^\s+|\s+$"


def trimmed(x) -> Column:
    return F.regexp_replace(col(x), r"(?U)" + _ENDS, "")


def count_of(x: Column, what: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(what), F.lit("")))


def line_type(line) -> Column:
    """What a line is; the first rule that applies."""
    return let(trimmed(line), _type_of)


def _type_of(s: Column) -> Column:
    arrow = s.contains("->") | s.contains("→")
    brackets = s.contains("[") & s.contains("]")
    two = count_of(s, "[") >= 2
    return (
        F.when(s == "", "empty")
        .when(s.startswith("#"), "comment")
        .when(s.rlike(r"^\[.+?\]\(.+?\)"), "markdown_link")
        .when(s.rlike(r"^[-*+]") & ~s.startswith("->"), "markdown_list")
        .when(s.startswith(">"), "markdown_quote")
        .when(brackets & arrow & two & s.contains("::mod("), STATEMENT_TYPES[0])
        .when(brackets & arrow & two, STATEMENT_TYPES[1])
        .when(brackets & arrow, "possible_syntax_error")
        .when(~brackets & ~arrow, "natural_language")
        .otherwise("not_statement")
    )


def line_score(kind) -> Column:
    k = col(kind)
    return F.when(k == STATEMENT_TYPES[0], 0.99).when(k == STATEMENT_TYPES[1], 0.95).when(k == "possible_syntax_error", 0.2).otherwise(0.0)


def unescaped(text) -> Column:
    """Without backslashes before punctuation, except inside quotes."""
    return F.regexp_replace(col(text), r"""("[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*')|\\([\[\]\->:()"'._*#{}|])""", "$1$2")


def merged(text) -> Column:
    """The lines of ``text`` with statements over several lines joined, as an array of (text, line): the line each begins on.

    Parentheses are counted outside comment lines; comments inside a statement
    are dropped; an unclosed statement at the end is kept.
    """
    lines = F.transform(F.split(col(text), "\n", -1), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n")))
    row = "array<struct<text:string,line:int>>"
    start = F.struct(F.array().cast(row).alias("out"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("at"), F.lit(0).alias("depth"))

    def add(acc: Column, t: Column, n: Column) -> Column:
        return F.concat(acc["out"], F.array(F.struct(t.alias("text"), n.alias("line"))))

    def state(out: Column, text_: Column, at: Column, depth: Column) -> Column:
        return F.struct(out.alias("out"), text_.cast("string").alias("open"), at.cast("int").alias("at"), depth.cast("int").alias("depth"))

    def step(acc: Column, line: Column) -> Column:
        x, n = line["x"], line["n"]
        s = trimmed(x)
        comment = s.startswith("#")
        change = count_of(x, "(") - count_of(x, ")")
        inside = acc["open"].isNotNull()
        depth = F.when(inside, acc["depth"] + change).otherwise(change)
        grown = F.concat(acc["open"], F.lit(" "), s)
        none, zero = F.lit(None), F.lit(0)
        return (
            F.when(comment & inside, acc)
            .when(comment, state(add(acc, x, n), none, zero, zero))
            .when(inside & (depth <= 0), state(add(acc, grown, acc["at"]), none, zero, zero))
            .when(inside, state(acc["out"], grown, acc["at"], depth))
            .when(depth > 0, state(acc["out"], s, n, depth))
            .otherwise(state(add(acc, x, n), none, zero, zero))
        )

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["open"].isNotNull(), add(acc, acc["open"], acc["at"])).otherwise(acc["out"]))


def merged_text(text) -> Column:
    return F.array_join(F.transform(merged(text), lambda m: m["text"]), "\n")


def fenced(lines: Column, tag: str = FENCE_TAG) -> Column:
    """Of an array of (text, line), those inside fences of ``tag``."""
    start = F.struct(F.filter(lines, lambda m: F.lit(False)).alias("out"), F.lit(False).alias("inside"))

    def step(acc: Column, m: Column) -> Column:
        s = trimmed(m["text"])
        opens, closes = s.startswith("```" + tag), s.startswith("```")
        return (
            F.when(~acc["inside"] & opens, F.struct(acc["out"].alias("out"), F.lit(True).alias("inside")))
            .when(acc["inside"] & closes, F.struct(acc["out"].alias("out"), F.lit(False).alias("inside")))
            .when(acc["inside"], F.struct(F.concat(acc["out"], F.array(m)).alias("out"), acc["inside"].alias("inside")))
            .otherwise(acc)
        )

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def is_pure(lines: Column) -> Column:
    """Whether an array of (text, line) is statements throughout, judged by its first five content lines."""
    kinds = F.transform(lines, lambda m: line_type(m["text"]))
    markdown = F.exists(kinds, lambda k: k.isin("markdown_link", "markdown_list", "markdown_quote"))
    head = F.slice(lines, 1, 3)
    before = lambda i: F.exists(F.slice(lines, 1, i + 1), lambda m: line_type(m["text"]).isin(*STATEMENT_TYPES))
    title = lambda m, i: trimmed(m["text"]).rlike(r"(?U)^# \s*\p{Lu}") & (F.length(trimmed(F.substring(trimmed(m["text"]), 3, 2**31 - 1))) < 50) & ~before(i)
    header = F.exists(F.transform(head, title), lambda x: x)
    content = F.slice(F.filter(kinds, lambda k: ~k.isin("empty", "comment")), 1, 5)
    good = F.size(F.filter(content, lambda k: k.isin(*STATEMENT_TYPES)))
    return ~markdown & ~header & (good >= F.size(content) * 0.8)


def arrows_normalized(text) -> Column:
    c = col(text)
    for a, b in ARROWS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def without_fences(text) -> Column:
    return F.regexp_replace(col(text), r"(?m)^\s*```[A-Za-z]*[ \t]*\n?", "")


def spaces_collapsed(text) -> Column:
    """Runs of blanks become one, ends of lines lose them; also inside strings."""
    return F.regexp_replace(F.regexp_replace(col(text), r"[ \t]{2,}", " "), r"(?m)[ \t]+$", "")


def cleaned(text) -> Column:
    """Fences off, arrows and blanks normalised, statements joined, other lines dropped (comments stay)."""
    rows = merged(spaces_collapsed(arrows_normalized(without_fences(text))))
    kept = F.filter(rows, lambda m: line_type(m["text"]).isin(*STATEMENT_TYPES, "comment"))
    return F.array_join(F.transform(kept, lambda m: m["text"]), "\n")


def mod_prefixed(line) -> Column:
    return F.regexp_replace(col(line), r"(?<!:)\bmod\(", "::mod(")


def bracketed(line) -> Column:
    """Brackets around bare anchors beside the first arrow."""
    return let(col(line), _bracketed)


def _bracketed(c: Column) -> Column:
    arrow = F.when(c.contains("->"), "->").when(c.contains("→"), "→")
    at = F.instr(c, "->")
    at = F.when(at > 0, at).otherwise(F.instr(c, "→"))
    left = trimmed(F.substring(c, F.lit(1), at - 1))
    right_all = F.substring(c, at + F.length(arrow), F.length(c))
    split = F.instr(right_all, "::mod")
    right = trimmed(F.when(split > 0, F.substring(right_all, F.lit(1), split - 1)).otherwise(right_all))
    tail = F.when(split > 0, F.concat(F.lit(" "), F.substring(right_all, split, F.length(right_all)))).otherwise("")
    bare = lambda x: x.rlike(r"(?U)^[\w:\-]+$")
    wrap = lambda x: F.when(bare(x), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x)
    return F.when(arrow.isNotNull() & (bare(left) | bare(right)), F.concat(wrap(left), F.lit(" "), arrow, F.lit(" "), wrap(right), tail)).otherwise(c)


def _in_mod(line: Column, change) -> Column:
    """``change`` applied to what is between ::mod( and the last ) of the line."""
    return let(col(line), lambda c: let(F.regexp_extract(c, r"::mod\((.+)\)", 1), lambda body: _changed(c, body, change)))


def _changed(c: Column, body: Column, change) -> Column:
    begin = F.instr(c, "::mod(") + 6
    return F.when(body != "", F.concat(F.substring(c, F.lit(1), begin - 1), change(body), F.substring(c, begin + F.length(body), F.length(c)))).otherwise(c)


def values_quoted(line) -> Column:
    """Quotes around bare values that are neither numbers nor booleans; quoted values keep their commas and parentheses."""
    pair = r"""(?U)(\w+)\s*=\s*(?:("[^"]*"|'[^']*')|(-?\d+\.?\d*|(?i:true|false))(?=\s*(?:,|$))|([^,)"'\s][^,)]*?))(?=\s*(?:,|$))"""

    def change(body: Column) -> Column:
        marked = F.regexp_replace(body, pair, "$1=$2$3\u0001$4\u0001")
        return F.regexp_replace(F.regexp_replace(marked, "\u0001\u0001", ""), "\u0001([^\u0001]*)\u0001", '"$1"')

    return _in_mod(line, change)


def clamped(line) -> Column:
    """The first value of each field of a unit range, clamped to it."""
    out = col(line)
    for f in CLAMPED:
        out = let(out, _clamp_of(f))
    return out


def _clamp_of(f: str):
    return lambda c: _clamped_field(c, f)


def _clamped_field(c: Column, f: str) -> Column:
    number = F.regexp_extract(c, rf"{f}\s*=\s*(-?\d+\.?\d*)", 1)
    value = number.try_cast("double")
    fixed = F.when(value > 1, "1.0").when(value < 0, "0.0")
    whole = F.regexp_extract(c, rf"({f}\s*=\s*-?\d+\.?\d*)", 1)
    at = F.instr(c, whole)
    return F.when(fixed.isNotNull(), F.concat(F.substring(c, F.lit(1), at - 1), F.lit(f"{f}="), fixed, F.substring(c, at + F.length(whole), F.length(c)))).otherwise(c)


def typos_fixed(line) -> Column:
    def change(body: Column) -> Column:
        for typo, right in TYPOS.items():
            body = F.regexp_replace(body, rf"\b{typo}\b", right)
        return body

    return _in_mod(line, change)


REPAIRS = (("fix_mod_prefix", mod_prefixed), ("add_brackets", bracketed), ("quote_string", values_quoted), ("clamp_value", clamped), ("fix_typo", typos_fixed))


def repaired(line) -> Column:
    """All repairs of a line, in their fixed order; comments and empty lines are left alone."""
    return let(col(line), _repaired)


def _repaired(c: Column) -> Column:
    out = c
    for _, step in REPAIRS:
        out = step(out)
    return F.when(trimmed(c).startswith("#") | (trimmed(c) == ""), c).otherwise(out)
