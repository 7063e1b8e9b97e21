"""String expressions shared by the document checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\r\n\x0b\x0c\u00a0\ufeff"
# Java's \b counts accented letters as word characters while its \w does not; the rules are written for an
# engine where both are ASCII.
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_ATOM = re.compile(r"\\.|\[(?:\\.|[^\]])*\]|\((?:\?(?:[:=!]|<[=!]))?|.", re.S)
_QUANTIFIER = re.compile(r"[+*?]|\{\d+(?:,\d*)?\}")


def _sequence(pattern: str) -> list[list[tuple[str, str]]]:
    """Top-level alternatives of a pattern as lists of (atom, quantifier); a group is one atom."""
    alternatives, at = [[]], 0
    while at < len(pattern):
        atom = _ATOM.match(pattern, at).group()
        end = at + len(atom)
        if atom.startswith("("):
            depth = 1
            while depth:
                inner = _ATOM.match(pattern, end).group()
                depth += inner.startswith("(") - (inner == ")")
                end += len(inner)
            atom = pattern[at:end]
        if atom == "|":
            alternatives.append([])
        else:
            mark = _QUANTIFIER.match(pattern, end)
            alternatives[-1].append((atom, mark.group() if mark else ""))
            end = mark.end() if mark else end
        at = end
    return alternatives


def _always_word(items: list[tuple[str, str]], last: bool) -> bool:
    """Whether what these atoms match surely starts (or ends) with an ASCII word character."""
    for atom, mark in reversed(items) if last else items:
        if atom.startswith("("):
            inner = re.sub(r"^\((\?:)?", "", atom)[:-1]
            word = not atom.startswith("(?") or atom.startswith("(?:")
            word = word and all(_always_word(alt, last) for alt in _sequence(inner))
        else:
            word = re.fullmatch(r"\w|\\[wd]|\[(?:\w|\w-\w)+\]", atom) is not None
        if not word:
            return False
        if mark not in ("?", "*") and not mark.startswith("{0"):
            return True
    return False


def _with_boundaries(pattern: str) -> str:
    """Each word boundary by the cheapest lookaround that says the same where it stands."""
    out = []
    for items in _sequence(pattern):
        text = ""
        for i, (atom, mark) in enumerate(items):
            if atom == r"\b":
                if _always_word(items[i + 1 :], False):
                    atom = r"(?<!\w)"
                elif _always_word(items[:i], True):
                    atom = r"(?!\w)"
                else:
                    atom = _BOUNDARY
            elif atom.startswith("("):
                head = re.match(r"\((\?(?:[:=!]|<[=!]))?", atom).group()
                atom = head + _with_boundaries(atom[len(head) : -1]) + ")"
            text += atom + mark
        out.append(text)
    return "|".join(out)


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A rule pattern for Java's engine with ASCII word boundaries."""
    return ("(?i)" if ignore_case else "") + _with_boundaries(pattern)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    return F.size(F.split(text, r"\s+"))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def replace_matches(text: Column, pattern: str, change) -> Column:
    """Replace every match by an expression of the match."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.when(m.isNull(), "").otherwise(change(m))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def blanked(match: Column) -> Column:
    """Spaces of the same length; line breaks stay, so line numbers hold."""
    return F.regexp_replace(match, r"[^\n]", " ")


def looks_like_class_list(text: Column) -> Column:
    tokens = F.split(trim(text), r"\s+")
    classy = F.filter(tokens, lambda t: t.rlike(r"^-?[a-z0-9]+([-:/.][a-z0-9%.\[\]()#-]+)+$"))
    return (F.size(tokens) >= 2) & (F.size(classy) / F.size(tokens) >= 0.6)


_CSS = (
    r"^-?[\d.]+(px|rem|em|vh|vw|vmin|vmax|fr|%|s|ms|deg)?,?$|^var\(--[^)]*\),?$"
    r"|^[a-z-]+\([^)]*\),?$|^#[0-9a-fA-F]{3,8},?$"
)


def looks_like_css_value(text: Column) -> Column:
    tokens = F.split(trim(text), r"\s+")
    return F.exists(tokens, lambda t: t.rlike(_CSS)) & F.forall(tokens, lambda t: t.rlike(_CSS) | t.rlike(r"^[a-z-]+,?$"))


# How a query starts, what only a query says, and the words counted.
SQL_OPENING = (
    r"^\s*(SELECT|INSERT\s+INTO|UPDATE\s+\w|DELETE\s+FROM|WITH\s+\w+\s+AS|CREATE\s+(TABLE|INDEX|VIEW|OR\s+REPLACE)"
    r"|ALTER\s+TABLE|DROP\s+(TABLE|INDEX|VIEW))\b"
)
SQL_ONLY = r"\b(SELECT|GROUP BY|ORDER BY|LEFT JOIN|INNER JOIN|ON CONFLICT|IS NOT NULL|array_agg|COUNT\()"
SQL_WORDS = r"\b(SELECT|FROM|WHERE|VALUES|SET|GROUP BY|ORDER BY|JOIN|ON CONFLICT|IS NOT NULL|array_agg|COUNT)\b"


def looks_like_sql(text: Column) -> Column:
    shaped = text.rlike(java_pattern(SQL_OPENING, True)) | text.rlike(java_pattern(SQL_ONLY, True))
    return shaped & (F.regexp_count(text, F.lit(java_pattern(SQL_WORDS, True))) >= 2)


def not_prose(text: Column) -> Column:
    """A single word, a path or address, or text written for a machine."""
    return (
        ~text.rlike(r"\s")
        | text.rlike(r"^[@./#]")
        | text.rlike(r"^[a-z]+://")
        | looks_like_class_list(text)
        | looks_like_css_value(text)
        | looks_like_sql(text)
    )


# A stop with closing marks, and words whose period does not end a sentence.
_CLOSERS = "[\"'\u2019\u201d)\\]*_]"
_SENTENCE_END = f"([.!?]{_CLOSERS}{{0,3}})\\s+"
_MARK = "\n\x01\n"  # a block has no line ends, so its own text never holds this
# The mark stands first, so that what is before it is looked at only where a mark is and not at every character.
_ABBREVIATION = (
    _MARK
    + r"(?<=(?:^|\s)(?:[eE]\.g|[iI]\.e|vs|approx|cf|al|fig|eq|Mr|Mrs|Ms|Dr|Prof|Jr|Sr|U\.S|[A-Z])\."
    + f"{_CLOSERS}{{0,3}}{_MARK})"
)


def sentences(text: Column) -> Column:
    """Array of sentences: marked after each stop, the mark taken back after an abbreviation, then split."""
    marked = F.regexp_replace(text, _SENTENCE_END, "$1" + _MARK)
    glued = F.regexp_replace(marked, _ABBREVIATION, " ")
    return F.filter(F.transform(F.split(glued, _MARK, -1), trim), lambda s: s != "")


def sentence_start(all_sentences: Column, position: Column) -> Column:
    """Offset of the sentence at a zero-based position."""
    before = F.slice(all_sentences, F.lit(1), position)
    return F.aggregate(before, F.lit(0), lambda acc, s: acc + F.length(s) + 1)


def sentence_starts(all_sentences: Column) -> Column:
    """Offsets of all sentences, as a running sum."""
    state = "struct<at:int, out:array<int>>"
    return F.aggregate(
        all_sentences,
        F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state),
        lambda acc, s: F.struct((acc["at"] + F.length(s) + 1).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(state),
        lambda acc: acc["out"],
    )


def line_of(pieces: Column, offset: Column, first: Column) -> Column:
    """Source line of a character of a joined block. The offset is compared for every line, so give a column or a field."""
    start = F.struct(F.lit(0).alias("at"), first.cast("int").alias("line"))

    def step(acc, p):
        reached = acc["at"] <= offset
        return F.struct((acc["at"] + p["length"] + 1).alias("at"), F.when(reached, p["line"]).otherwise(acc["line"]).alias("line"))

    return F.aggregate(pieces, start, step, lambda acc: acc["line"])
