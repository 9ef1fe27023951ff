"""Text primitives as column expressions: lines, stripping, tokens, fences, code spans, links, headers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import fixed

#: What ends a line: CRLF, LF, VT, FF, CR, U+001C-1E, NEL, LS, PS.
LINE_END = "\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]+"
#: A word border that agrees with WORD, for patterns that Java would read differently.
BORDER = r"(?:(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_]))"
_SPACE = r"[\s\x1c-\x1f]"


def no_strings() -> Column:
    return F.array().cast("array<string>")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a last end starts no line, an empty text has no line."""
    parts = F.split(text, LINE_END, -1)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", no_strings()).otherwise(cut)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.rlike(rf"(?U)^{_SPACE}*\z")


def drop_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\ufeff+", "")


def unquote(text: Column) -> Column:
    """Without one pair of equal quotes around it."""
    t = strip(text)
    return F.when(t.rlike(r"""(?s)^(?:".*"|'.*')\z""") & (F.length(t) >= 2), t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)


def tokens(text: Column) -> Column:
    """Lower-case words of two characters or more; words of five or more lose one final s."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda t: F.length(t) >= 2)
    return F.transform(words, lambda t: F.when((F.length(t) > 4) & t.endswith("s"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t))


def numbered(lines: Column) -> Column:
    """array<struct<n, line>>, n from 1."""
    return F.transform(lines, lambda line, i: F.struct((i + 1).cast("int").alias("n"), line.alias("line")))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: a lambda's variable is a result, an expression in a lambda runs for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def outside_fences(lines: Column) -> Column:
    """Numbered lines that are neither a code fence's marks nor inside one; an open fence runs to the end.

    Only the lines that look like marks are folded, into the stretches between
    fences; the lines of each stretch are then one slice.
    """
    start = F.struct(F.lit("").alias("open"), F.lit(1).alias("first"), F.array().cast("array<struct<first:int,n:int>>").alias("seen"))

    def step(acc, x):
        outside = acc["open"] == ""
        closes = x["bare"] & (F.substring(x["mark"], 1, 1) == F.substring(acc["open"], 1, 1)) & (F.length(x["mark"]) >= F.length(acc["open"]))
        stretch = F.struct(acc["first"].alias("first"), (x["n"] - acc["first"]).alias("n"))
        return F.struct(
            F.when(outside, x["mark"]).when(closes, F.lit("")).otherwise(acc["open"]).alias("open"),
            F.when(~outside & closes, x["n"] + 1).otherwise(acc["first"]).alias("first"),
            F.when(outside, F.concat(acc["seen"], F.array(stretch))).otherwise(acc["seen"]).alias("seen"),
        )

    def kept(all_):
        marks = F.transform(
            F.filter(all_, lambda x: x["line"].rlike(fixed.FENCE)),
            lambda x: F.struct(x["n"].alias("n"), F.regexp_extract(x["line"], fixed.FENCE, 1).alias("mark"), x["line"].rlike(fixed.FENCE + r"[ \t]*$").alias("bare")),
        )

        def last(acc):
            rest = F.struct(acc["first"].alias("first"), (F.size(all_) + 1 - acc["first"]).alias("n"))
            return F.when(acc["open"] == "", F.concat(acc["seen"], F.array(rest))).otherwise(acc["seen"])

        return F.flatten(F.transform(F.aggregate(marks, start, step, last), lambda x: F.slice(all_, x["first"], x["n"])))

    fenced = F.exists(lines, lambda line: line.rlike(fixed.FENCE))
    return F.when(fenced, let(numbered(lines), kept)).otherwise(numbered(lines))


def blank_code(line: Column) -> Column:
    """Code spans replaced by as many spaces."""
    start = F.struct(F.lit("").alias("done"), line.alias("rest"))

    def step(acc, span):
        at = F.instr(acc["rest"], span)
        return F.struct(
            F.concat(acc["done"], F.substring(acc["rest"], F.lit(1), at - 1), F.repeat(F.lit(" "), F.length(span))).alias("done"),
            F.substring(acc["rest"], at + F.length(span), F.length(acc["rest"])).alias("rest"),
        )

    spans = F.regexp_extract_all(line, F.lit(r"(`+)(.*?)\1"), F.lit(0))
    return F.when(line.contains("`"), F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], acc["rest"]))).otherwise(line)


def visible(lines: Column) -> Column:
    """Numbered lines outside fences, with code spans blanked."""
    return F.transform(outside_fences(lines), lambda x: F.struct(x["n"].alias("n"), blank_code(x["line"]).alias("line")))


def link_target(inner: Column) -> Column:
    """Normal form of what a wikilink has between its brackets."""
    t = strip(F.regexp_replace(inner, r"[|#].*$", ""))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\\", "/"), r"^(?:\./)+", ""), "^/+", "")
    return strip(F.regexp_replace(F.regexp_replace(t, "^wiki/", ""), r"(?i)\.md$", ""))


def links(visible_lines: Column) -> Column:
    """array<struct<line, raw, target>> of the wikilinks."""
    found = F.flatten(F.transform(visible_lines, lambda x: F.transform(F.regexp_extract_all(x["line"], F.lit(fixed.WIKILINK), F.lit(1)), lambda m: F.struct(x["n"].alias("line"), F.concat(F.lit("[["), m, F.lit("]]")).alias("raw"), link_target(m).alias("target")))))
    return F.filter(found, lambda x: x["target"] != "")


def primary_entries(visible_lines: Column) -> Column:
    """array<struct<line, target>>: bullets whose content begins with a wikilink."""
    inner = r"(?U)^\s*[-*+]\s+" + fixed.WIKILINK
    found = F.transform(visible_lines, lambda x: F.struct(x["n"].alias("line"), link_target(F.regexp_extract(x["line"], inner, 1)).alias("target")))
    return F.filter(found, lambda x: x["target"] != "")


def closing_line(lines: Column) -> Column:
    """Position (from 1) of the line that closes the header, or 0."""
    rest = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), strip)
    at = F.array_position(rest, "---").cast("int")
    return F.when((F.size(lines) > 1) & (strip(F.get(lines, F.lit(0))) == "---") & (at > 0), at + 1).otherwise(0)


def header(lines: Column, end: Column) -> Column:
    """map of a header's fields, ``end`` being its closing line: the last of a key counts, further lines belong to the key above."""

    def entries(body, at):
        def entry(x, i):
            # Lines up to the next field's are this one's.
            following = F.coalesce(F.get(at, i + 1)["n"], F.size(body) + 1)
            more = F.transform(F.slice(body, x["n"] + 1, following - x["n"] - 1), lambda y: y["line"])
            value = F.array_join(F.concat(F.array(F.regexp_extract(x["line"], fixed.FIELD, 2)), more), "\n")
            return F.struct(F.regexp_extract(x["line"], fixed.FIELD, 1).alias("k"), strip(value).alias("v"))

        return F.transform(at, entry)

    def last(found):
        return F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y["k"] == x["k"]))

    def fields(body):
        return let(F.filter(body, lambda x: x["line"].rlike(fixed.FIELD)), lambda at: let(entries(body, at), last))

    return F.map_from_entries(let(numbered(F.slice(lines, F.lit(2), F.greatest(F.lit(0), end - 2))), fields))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once: the optimiser would copy an expression into a lambda that uses it, to run for every element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def is_date(text: Column) -> Column:
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def nfkc(lines: Column, content: Column) -> Column:
    """Compatibility normal form of each line of a text; ASCII is its own, so only other texts leave the JVM."""
    return F.coalesce(nfkc_lines(F.when(content.rlike(r"[^\x00-\x7F]"), lines)), lines)


@F.pandas_udf(ArrayType(StringType()))
def nfkc_lines(lines: pd.Series) -> pd.Series:
    """Compatibility normal form of each line; there is no built-in for it."""
    return lines.map(lambda xs: [unicodedata.normalize("NFKC", x) for x in xs] if xs is not None else None)
