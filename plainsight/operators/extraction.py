"""Items pulled out of text: lines, comments, literals, names, calls and bodies.

Everything that concerns one file stays in the row of that file (array functions,
no shuffle); only "which methods hold this item" groups, and it groups by
(file, item), which one file bounds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMENT_PATTERN = r"(?s)(/\*.*?\*/|//[^\n]*)"
STRING_PATTERN = r'"((?:[^"\\\n]|\\.)*)"'
CALL_PATTERN = r"([A-Za-z_][A-Za-z0-9_]*) ?\("
DECLARATION_PATTERN = r"([A-Za-z_][A-Za-z0-9_<>\[\]]*) +([A-Za-z_][A-Za-z0-9_]*) *(?:=|;|,|\))"
HEADER_PATTERN = r"([A-Za-z_][A-Za-z0-9_]*) *\([^)\n]*\)[^;{\n]*\{"
WORD_BREAK = "[^A-Za-z0-9_]+"

# One alternation gives strings, characters and comments in their order, so that a mark inside another token is none.
# Groups are possessive: a long literal needs no stack.  What is not closed ends at the line (literals) or the text.
_LITERAL = r"""(?:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')"""
_COMMENT = r"(?://[^\n]*+|/\*.*?(?:\*/|\z))"
SOURCE_TOKENS = f"(?s){_LITERAL}|{_COMMENT}"


def source_tokens(text: str | Column) -> Column:
    """Literals and comments of a source text in order, with their marks."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(SOURCE_TOKENS), F.lit(0))


def comment_tokens(text: str | Column) -> Column:
    """Comments with their marks; ``//`` and ``/*`` inside literals begin none."""
    return F.filter(source_tokens(text), lambda t: t.startswith("/"))


def string_tokens(text: str | Column) -> Column:
    """Contents of string literals; quotes inside comments and character literals begin none."""
    strings = F.filter(source_tokens(text), lambda t: t.startswith('"'))
    return F.transform(strings, lambda t: F.substring(t, 2, F.length(t) - 2))


def code_text(text: str | Column) -> Column:
    """The text without comments and with empty literals: what is left are names, calls and declarations."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(c, f"(?s)({_LITERAL})|{_COMMENT}", "$1 ")
    return F.regexp_replace(bare, _LITERAL, '""')


def scan_comments(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Distinct comments per file, by tokens rather than by pattern alone."""
    return df.select(*keep, F.explode(F.array_distinct(comment_tokens(text))).alias("comment"))


def scan_strings(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Distinct string literals per file, by tokens."""
    return df.select(*keep, F.explode(F.array_distinct(string_tokens(text))).alias("literal"))


def explode_lines(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per line with its 1-based number."""
    return df.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no") + 1)


def extract_comments(df: DataFrame, text: str, keep: Sequence[str],
                     pattern: str = COMMENT_PATTERN) -> DataFrame:
    """Distinct comment bodies per file."""
    bodies = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    return df.select(*keep, F.explode(F.array_distinct(bodies)).alias("comment"))


def bodies_of(df: DataFrame, text: str, keep: Sequence[str], splitter: str = "\n",
              name_pattern: str = r"^([A-Za-z_]+)") -> DataFrame:
    """Text cut at ``splitter`` into bodies in order; a body without a name is ``global``."""
    cut = df.select(*keep, F.posexplode(F.split(F.col(text), splitter)).alias("ordinal", "body"))
    name = F.regexp_extract("body", name_pattern, 1)
    return cut.select(*keep, F.when(name == "", F.lit("global")).otherwise(name).alias("method"),
                      "ordinal", "body")


def method_bodies(bodies: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Method to code; of several bodies with one name the last counts."""
    return (bodies.filter(F.col("method") != "global").groupBy(*keep, "method")
            .agg(F.max_by("body", "ordinal").alias("code")))


def _items_with_methods(bodies: DataFrame, keep, hits: Column, name: str) -> DataFrame:
    return (bodies.select(*keep, "method", F.explode(F.array_distinct(hits)).alias(name))
            .groupBy(*keep, name)
            .agg(F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods")))


def extract_strings(bodies: DataFrame, keep: Sequence[str],
                    pattern: str = STRING_PATTERN) -> DataFrame:
    """Literals with the methods that hold them."""
    hits = F.regexp_extract_all(F.col("body"), F.lit(pattern), F.lit(1))
    return _items_with_methods(bodies, keep, hits, "literal")


def extract_calls(bodies: DataFrame, keep: Sequence[str], pattern: str = CALL_PATTERN) -> DataFrame:
    """Called names with the methods they are called from."""
    hits = F.regexp_extract_all(F.col("body"), F.lit(pattern), F.lit(1))
    return _items_with_methods(bodies, keep, hits, "call")


def extract_variables(bodies: DataFrame, keep: Sequence[str], pattern: str = DECLARATION_PATTERN,
                      type_group: int = 1, name_group: int = 2) -> DataFrame:
    """Declared names; the type of the last declaration, all methods."""
    def groups(i):
        return F.regexp_extract_all(F.col("body"), F.lit(pattern), F.lit(i))
    pairs = F.arrays_zip(groups(name_group).alias("name"), groups(type_group).alias("type"))
    found = bodies.select(*keep, "method", "ordinal", F.posexplode(pairs).alias("pos", "p"))
    return (found.groupBy(*keep, F.col("p.name").alias("name"))
            .agg(F.max_by("p.type", F.struct("ordinal", "pos")).alias("type"),
                 F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods")))


def global_usage_lines(lines: DataFrame, items: DataFrame, keep: Sequence[str], name: str,
                       kind: str, on: Sequence[str] = ()) -> DataFrame:
    """Distinct trimmed lines that use a class-level item, under a made-up method name.

    ``on`` holds the file columns the items share with the lines; empty when the
    items hold for all files.
    """
    tokens = lines.select(*keep, F.trim("line").alias("line"), F.explode(
        F.array_distinct(F.split("line", WORD_BREAK))).alias(name))
    used = tokens.join(items.select(*on, name).distinct(), [*on, name])
    return (used.groupBy(*keep, name)
            .agg(F.array_join(F.sort_array(F.collect_set("line")), "\n").alias("code"))
            .withColumn("method", F.concat(F.col(name), F.lit(f"_global_lines_{kind}"))))


def whole_word(text: Column, word: str) -> Column:
    edge = "[^A-Za-z0-9_]"
    return text.rlike(f"(?:^|{edge}){re.escape(word)}(?:{edge}|$)")


def keyword_lines(df: DataFrame, text: str, keep: Sequence[str], word: str) -> DataFrame:
    """Trimmed lines that hold the word as a whole."""
    return (explode_lines(df, text, keep).filter(whole_word(F.col("line"), word))
            .select(*keep, "line_no", F.trim("line").alias("line")))


def compact_lines(text) -> Column:
    """Blank lines dropped; a following line of closing marks folded into the one before.

    The scan is left to right without overlap, so in a run of closing lines every
    second one is folded, as with an index that skips the folded line.
    """
    gap = r"[ \t\r\f]*"
    pattern = rf"(?md)^([^\n]*)\n{gap}((?:[}});](?:{gap}[}});])*)?){gap}$"
    col = F.col(text) if isinstance(text, str) else text
    folded = F.regexp_replace(col, pattern, "$1 $2")
    kept = F.filter(F.split(folded, "\n"), lambda line: ~line.rlike(r"^[ \t\r\f]*$"))
    return F.array_join(kept, "\n")


def restore_ids(df: DataFrame, text: str, key: str, names: DataFrame, id_col: str,
                name_col: str, unknown: str = "undefined") -> DataFrame:
    """``ID-n.java`` put back to file names; ``names`` maps id to name."""
    ids = F.regexp_extract_all(F.col(text), F.lit(r"\b(ID-\d+)\.java\b"), F.lit(1))
    spots = df.select(key, F.posexplode(ids).alias("pos", id_col))
    found = spots.join(names.select(id_col, name_col), id_col, "left").groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(
            "pos", F.coalesce(name_col, F.lit(unknown)).alias("n")))), lambda x: x["n"]).alias("_n"))
    pieces = F.split(F.col(text), r"\bID-\d+\.java\b", -1)
    filled = F.array_join(F.transform(
        F.arrays_zip(pieces.alias("a"), F.col("_n").alias("b")),
        lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), "")
    return (df.join(found, key, "left")
            .withColumn(text, F.when(F.col("_n").isNull(), F.col(text)).otherwise(filled))
            .drop("_n"))
