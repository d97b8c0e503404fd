"""Column expressions over whole texts. All of them stay inside the row and the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# One token of C-like code. Possessive groups keep the matcher off the stack
# on very long literals.
CODE_TOKEN = (
    r"//[^\n]*+"
    r"|/\*[\s\S]*?(?:\*/|\z)"
    r'|"(?:[^"\\]++|\\[\s\S])*+(?:"|\\?\z)'
    r"|'(?:[^'\\]++|\\[\s\S])*+(?:'|\\?\z)"
    r"|[^/\"']++|/"
)
MARKUP_TOKEN = r"<!--[\s\S]*?(?:-->|\z)|[^<]++|<"


# The white space characters.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
ASCII_SPACE = "\t\n\x0b\x0c\r "


def strip(c: Column | str, chars: str = WHITE_SPACE) -> Column:
    """Without leading and trailing white space of any kind, in one pass from either end."""
    return F.btrim(c, F.lit(chars))


def fold(blocks: Column, items: Callable[[Column], Column], zero: dict[str, Column],
         step: Callable[[Column, Column], dict[str, Column]], made: str, kind: str,
         finish: Callable[[Column], Column] | None = None) -> Column:
    """Everything that ``step`` says under ``made``, in order, over the ``items`` of every block: linear.

    ``step(state, item)`` gives the next state by name and under ``made`` an array (of type
    ``kind``) of what the item adds. Appending to one growing array would copy it at every
    step, and so would cutting slices from one, so a text is cut into short ``blocks`` first, each
    with an array of its own. ``finish(state)`` may add a last array.
    """
    none = F.array().cast(kind)

    def state(s: Column, one: dict[str, Column]) -> Column:
        grown = F.when(F.size(one[made]) > 0, F.concat(s["_made"], one[made])).otherwise(s["_made"])
        return F.struct(*[one.get(k, s[k]).alias(k) for k in zero], grown.alias("_made"), s["_all"].alias("_all"))

    def close(s: Column) -> Column:
        whole = F.when(F.size(s["_made"]) > 0, F.array_append(s["_all"], s["_made"])).otherwise(s["_all"])
        return F.struct(*[s[k].alias(k) for k in zero], none.alias("_made"), whole.alias("_all"))

    first = F.struct(*[v.alias(k) for k, v in zero.items()], none.alias("_made"), F.array().cast(f"array<{kind}>").alias("_all"))
    end = (lambda s: F.concat(F.flatten(s["_all"]), finish(s))) if finish else (lambda s: F.flatten(s["_all"]))
    return F.aggregate(blocks, first, lambda s, block: F.aggregate(items(block), s, lambda a, x: state(a, step(a, x)), close), end)


def pieces(c: Column, size: int = 256) -> Column:
    """The text in pieces of ``size`` characters."""
    return F.regexp_extract_all(c, F.lit(rf"[\s\S]{{1,{size}}}"), F.lit(0))


def line_blocks(c: Column, size: int = 64) -> Column:
    """The text in blocks of ``size`` lines with their ends; the last line, which may be empty, is a block."""
    return F.regexp_extract_all(c, F.lit(rf"(?:[^\n]*+\n){{1,{size}}}|(?<=\n|\A)[^\n]*+\z"), F.lit(0))


def block_lines(block: Column) -> Column:
    return lines(F.regexp_replace(block, r"\n\z", ""))


def occurrences(c: Column, piece: str) -> Column:
    """How often a one-character piece occurs."""
    return F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))


def newlines(c: Column) -> Column:
    return occurrences(c, "\n")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def strip_code_comments(text: Column) -> Column:
    """Drop comments and blank literals; newlines of block comments stay."""

    def keep(t: Column) -> Column:
        return (F.when(t.startswith("//"), F.lit(""))
                .when(t.startswith("/*"), F.repeat(F.lit("\n"), newlines(t)))
                .when(t.startswith('"') | t.startswith("'"), F.lit('""'))
                .otherwise(t))

    tokens = F.regexp_extract_all(text, F.lit(CODE_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, keep), "")


def strip_markup_comments(text: Column) -> Column:
    """Drop ``<!-- -->`` only, keeping its newlines."""
    tokens = F.regexp_extract_all(text, F.lit(MARKUP_TOKEN), F.lit(0))
    return F.array_join(
        F.transform(tokens, lambda t: F.when(
            t.startswith("<!--"), F.repeat(F.lit("\n"), newlines(t))).otherwise(t)), "")


def strip_comments_simple(text: Column) -> Column:
    """For identifier matching: comments become a space, double-quoted text ``""``."""
    t = F.regexp_replace(text, r"/\*[\s\S]*?\*/", " ")
    t = F.regexp_replace(t, r"//[^\n]*", " ")
    return F.regexp_replace(t, r'"(?:[^"\\]++|\\.)*+"', '""')


def match_lines(text: Column, pattern: str) -> Column:
    """1-based line of every match over the whole text, in order.

    Matches may span lines. Each is marked where it starts and the text is cut into lines,
    which say their number once per mark: linear in the text, and skipped without any match.
    """
    marked = lines(F.regexp_replace(F.translate(text, "\u0001", " "), pattern, "\u0001$0"))
    counts = F.transform(marked, lambda x, i: F.struct((i + 1).alias("line"), occurrences(x, "\u0001").alias("n")))
    found = F.flatten(F.transform(F.filter(counts, lambda x: x["n"] > 0), lambda x: F.array_repeat(x["line"], x["n"])))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<int>"))


def first_match_line(text: Column, pattern: str) -> Column:
    """1-based line of the first match, null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(text.rlike(pattern), newlines(F.substring(text, F.lit(1), at - 1)) + 1)


def loop_ranges(text: Column, headers: str = "for|while") -> Column:
    """Line ranges (lo, hi) that lie inside a loop body, by brace depth.

    A header line makes the next ``{`` open a loop, which ends at its own ``}``; the header
    line stays outside. A braceless loop that ends on its header line is a range of one.
    """
    # \u0002 marks a line whose header opens a block, \u0001 one with the body inline.
    header = rf"(?m)^(?![^\n]*\bdo\s*\{{)(?=(?>[^\n]*?\b(?:{headers})\s*\()"
    inline = r"[^\n{]*;[ \t\r]*$)"
    marked = F.regexp_replace(text, header + inline, "\u0001")
    marked = F.regexp_replace(marked, header + rf"(?!{inline})", "\u0002")
    bare = F.regexp_replace(marked, "[^\\n{}\u0001\u0002]+", "")
    tokens = lambda piece: F.regexp_extract_all(piece, F.lit("\\n+|[{}\u0001\u0002]"), F.lit(0))
    span = "array<struct<lo:int,hi:int>>"
    none = F.array().cast(span)
    zero = {"line": F.lit(1), "depth": F.lit(0), "pending": F.lit(False),
            "stack": F.array().cast("array<int>"), "since": F.lit(0)}

    def piece(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def step(s: Column, t: Column) -> dict[str, Column]:
        opens = (t == "{") & s["pending"]
        top = F.when(F.size(s["stack"]) > 0, F.element_at(s["stack"], -1)).otherwise(F.lit(-1))
        closes = (t == "}") & (top == s["depth"]) & (F.size(s["stack"]) > 0)
        last = closes & (F.size(s["stack"]) == 1)
        return {
            "line": F.when(t.startswith("\n"), s["line"] + F.length(t)).otherwise(s["line"]),
            "depth": F.when(t == "{", s["depth"] + 1)
            .when(t == "}", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]),
            "pending": F.when(t == "\u0002", F.lit(True)).when(t == "{", F.lit(False)).otherwise(s["pending"]),
            "stack": F.when(opens, F.array_append(s["stack"], s["depth"] + 1))
            .when(closes, F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).otherwise(s["stack"]),
            "since": F.when(opens & (F.size(s["stack"]) == 0), s["line"] + 1).otherwise(s["since"]),
            "out": F.when((t == "\u0001") & (F.size(s["stack"]) == 0), F.array(piece(s["line"], s["line"])))
            .when(last & (s["line"] >= s["since"]), F.array(piece(s["since"], s["line"]))).otherwise(none)}

    def finish(s: Column) -> Column:
        return F.when((F.size(s["stack"]) > 0) & (s["line"] >= s["since"]),
                      F.array(piece(s["since"], s["line"]))).otherwise(none)

    found = fold(pieces(bare), tokens, zero, step, "out", span, finish)
    return F.when(text.rlike(rf"\b(?:{headers})\s*\("), found).otherwise(none)


def range_flags(ranges: Column) -> Column:
    """For each line from the first on whether it lies in one of the rising ``ranges``; lines behind the last have no flag."""
    def part(r: Column, i: Column) -> Column:
        before = F.coalesce(F.get(ranges, i - 1)["hi"], F.lit(0))
        lo = F.greatest(r["lo"], before + 1)
        return F.concat(F.array_repeat(F.lit(False), F.greatest(F.lit(0), lo - before - 1)),
                        F.array_repeat(F.lit(True), F.greatest(F.lit(0), r["hi"] - lo + 1)))

    return F.flatten(F.transform(ranges, part))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def class_of(text: Column, fallback: Column) -> Column:
    found = F.regexp_extract(text, r"\b(?:class|interface|enum)\s+(\w+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), fallback)
