"""Documents (doc_id, text) to the lines a reader sees and to blocks of joined lines.

A document stays in its row until its blocks are known, so nothing here shuffles and rows of one doc_id are never
mixed. State that runs along the lines (lists, blocks) is kept in one text for the whole document, in which a line end
is the only mark: lines never hold one. That is linear in the lines, where growing an array line by line is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.prose.text import blanked, newlines, not_prose, replace_matches, trim

IGNORE = "prose-check-ignore"

# What counts as markup, a visible attribute, a block element.
_COMMENT = r"<!--[\s\S]*?-->"
_WRAPPED_CODE = r"(`{1,2})([^`]*?\n[^`]*?)\1"
_INLINE_CODE = r"(`+)(.*?)\1"
_SETTING = r"(?i)^\s*[a-z_]\w*\s*=\s*\$?\d[\d.,]*(?:e[+-]?\d+)?\s*$"
_ATTRIBUTE = r"""(?i)\b(?:alt|title|aria-label|placeholder)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_META = (
    r"""(?i)<meta[^>]*\b(?:name|property)\s*=\s*["'](?:description|og:description|twitter:description)["'][^>]*>"""
)
_CONTENT = r"""(?i)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_BLOCK_NAMES = "p|li|h[1-6]|td|th|tr|div|section|article|blockquote|figcaption|dt|dd"
_BLOCK_START = rf"(?i)<\s*({_BLOCK_NAMES})[\s>]"
_BLOCK_ANY = rf"(?i)</?\s*({_BLOCK_NAMES})\b[^>]*>"
_HIDDEN = r"(?i)<(script|style|svg)[\s\S]*?</\1\s*>"
_OPEN_TAG = r"<[a-zA-Z/!][^<>]*>"
_FENCE = r"^\s*(`{3,}|~{3,})"
_LIST = r"^\s*([-*+]|\d+\.)\s"
_PIECE_START = r"""^export\s|^\s{1,2}['"`]?[\w-]+['"`]?\s*:\s*\{\s*$"""


def visible_attributes(line: Column) -> Column:
    """Text a reader meets in attributes (alt text, tooltips, descriptions), each ended like a sentence."""

    def quoted(hit: Column, pattern: str) -> Column:
        return F.concat(F.regexp_extract(hit, pattern, 1), F.regexp_extract(hit, pattern, 2))

    own = F.transform(F.regexp_extract_all(line, F.lit(_ATTRIBUTE), 0), lambda h: quoted(h, _ATTRIBUTE))
    meta = F.transform(F.regexp_extract_all(line, F.lit(_META), 0), lambda h: quoted(h, _CONTENT))
    known = F.filter(F.concat(own, meta), lambda a: a != "")
    return F.when(
        line.contains("="), F.array_join(F.transform(known, lambda a: F.concat(a, F.lit(". "))), "")
    ).otherwise("")


def visible_markdown(line: Column) -> Column:
    """One line without code spans (a setting stays), link targets, reference labels and tags."""
    text = F.concat(visible_attributes(line), line)
    inner = lambda m: F.regexp_extract(m, _INLINE_CODE, 2)
    text = replace_matches(
        text, _INLINE_CODE, lambda m: F.when(inner(m).rlike(_SETTING), F.concat(F.lit(" "), inner(m), F.lit(" "))).otherwise(" ")
    )
    text = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    text = F.regexp_replace(text, r"!?\[([^\]]*)\]\[[^\]]*\]", "$1")
    return F.regexp_replace(text, r"<[^>]+>", " ")


def _fenced_spans(lines: Column, after: Column) -> Column:
    """[(first, last)] of open fences. A fence closes on a run of the same mark at least as long as its own."""
    marks = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, _FENCE, 1).alias("m"))),
        lambda e: (e["m"] != "") & (e["i"] > after),
    )
    state = "struct<open:int, mark:string, spans:array<struct<first:int, last:int>>>"
    start = F.struct(F.lit(-1).alias("open"), F.lit("").alias("mark"), F.array().alias("spans")).cast(state)

    def step(acc, e):
        closes = (F.substring(e["m"], 1, 1) == F.substring(acc["mark"], 1, 1)) & (
            F.length(e["m"]) >= F.length(acc["mark"])
        )
        opened = F.struct(e["i"].alias("open"), e["m"].alias("mark"), acc["spans"].alias("spans")).cast(state)
        closed = F.struct(
            F.lit(-1).alias("open"),
            F.lit("").alias("mark"),
            F.concat(acc["spans"], F.array(F.struct(acc["open"].alias("first"), e["i"].alias("last")))).alias("spans"),
        ).cast(state)
        return F.when(acc["open"] < 0, opened).when(closes, closed).otherwise(acc)

    def finish(acc):
        rest = F.array(F.struct(acc["open"].alias("first"), F.lit(2147483647).alias("last")))
        return F.when(acc["open"] >= 0, F.concat(acc["spans"], rest)).otherwise(acc["spans"])

    return F.aggregate(marks, start, step, finish)


def _once(parts: dict[str, Column], use) -> Column:
    """`use` of the named parts, each computed once per row: as a column that a lambda names, the optimiser may put the
    whole expression into the lambda and so compute it for every line."""
    bound = F.struct(*[c.alias(name) for name, c in parts.items()])
    return F.get(F.transform(F.array(bound), use), F.lit(0))


def _in_list(events: Column) -> Column:
    """Per line, whether the last event above it opened a list. Events are L (a list), P (its end) and - (neither)."""
    held = replace_matches(F.array_join(events, ""), "L-+", lambda m: F.repeat(F.lit("L"), F.length(m)))
    return F.split(held, "", -1)


def markdown_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, starts, lines): visible text per line with `breaks` and `headline`, blank where nothing shows."""
    text = replace_matches(F.col("text"), _COMMENT, blanked)
    text = replace_matches(text, _WRAPPED_CODE, lambda m: F.when(m.rlike(r"\n\s*\n"), m).otherwise(blanked(m)))
    cells = docs.select("doc_id", F.split(text, "\n", -1).alias("_lines"))
    trimmed = F.transform("_lines", trim)
    front = (
        (F.get(trimmed, F.lit(0)) == "---")
        & F.coalesce(F.get("_lines", F.lit(1)).rlike(r"^[\w-]+\s*:"), F.lit(False))
        & F.array_contains(F.slice(trimmed, 2, 1 << 30), "---")
    )
    front_end = F.when(front, F.array_position(F.slice(trimmed, 2, 1 << 30), "---")).otherwise(-1).cast("int")
    fences = cells.withColumn("_front", front_end)

    def seen(line, i, doc):
        hidden = (
            (i <= doc["front"])
            | line.rlike(_FENCE)
            | F.exists(doc["spans"], lambda s: (i > s["first"]) & (i < s["last"]))
            | line.contains(IGNORE)
        )
        return F.struct(line.alias("line"), hidden.alias("hidden"), line.rlike(_LIST).alias("list"), line.rlike(r"^\s{4,}\S").alias("deep"))

    def event(e):
        ends = ~e["list"] & (trim(e["line"]) != "") & ~e["line"].rlike(r"^\s{2,}\S")
        return F.when(e["hidden"], "-").when(e["list"] & ~e["deep"], "L").when(ends, "P").otherwise("-")

    def kind(e, i, doc):
        line = e["line"]
        in_list = F.coalesce(F.get(doc["held"], i - 1) == "L", F.lit(False))
        shown = ~e["hidden"] & ~(e["deep"] & ~in_list)
        return F.struct(
            line.alias("line"), e["list"].alias("list"), shown.alias("shown"),
            line.rlike(r"^\s{0,3}#{1,6}\s").alias("heading"), line.rlike(r"^\s*\|").alias("table"),
        )

    def visible(e, i, doc):
        line = e["line"]
        plain = F.regexp_replace(visible_markdown(line), r"^\s*[#>*\-+]+\s*", "")
        plain = F.regexp_replace(plain, r"\*\*|__|(?<=\S)\*(?=\S)", "")
        plain = F.regexp_replace(plain, r"^\s*\d+\.\s*", "")
        text = (
            F.when(~e["shown"] | line.rlike(r"^\s{0,3}\[[^\]]+\]:\s*\S"), "")
            .when(e["table"] & line.rlike(r"^[\s|:-]+$"), "")
            .when(e["table"], F.replace(visible_markdown(line), F.lit("|"), F.lit(". ")))
            .otherwise(plain)
        )
        above = F.get(doc["kinds"], i - 1)
        own = e["shown"] & (e["list"] | line.rlike(r"^\s*\*\*") | e["heading"] | e["table"])
        after_heading = F.coalesce(above["shown"] & above["heading"], F.lit(False))
        return F.struct(
            text.alias("text"), (own | after_heading).alias("breaks"), (e["shown"] & line.rlike(r"^\s{0,3}#\s")).alias("headline")
        )

    spans = _fenced_spans(F.col("_lines"), F.col("_front"))
    all_seen = _once(
        {"lines": F.col("_lines"), "front": F.col("_front"), "spans": spans},
        lambda doc: F.transform(doc["lines"], lambda line, i: seen(line, i, doc)),
    )
    all_kinds = _once(
        {"seen": F.col("_seen"), "held": _in_list(F.transform("_seen", event))},
        lambda doc: F.transform(doc["seen"], lambda e, i: kind(e, i, doc)),
    )
    lines = _once({"kinds": F.col("_kinds")}, lambda doc: F.transform(doc["kinds"], lambda e, i: visible(e, i, doc)))
    rows = fences.select("doc_id", all_seen.alias("_seen")).select("doc_id", all_kinds.alias("_kinds"))
    return rows.select("doc_id", F.array().cast("array<int>").alias("starts"), lines.alias("lines"))


def plain_lines(docs: DataFrame) -> DataFrame:
    """Lines as they are, with list items, bold lead-ins, headings and table rows opening a block."""

    def whole(line):
        opens = line.rlike(r"^\s*([-*+]|\d+\.)\s|^\s*\*\*|^\s{0,3}#{1,6}\s|^\s*\|")
        return F.struct(line.alias("text"), opens.alias("breaks"), F.lit(False).alias("headline"))

    lines = F.transform(F.split("text", "\n", -1), whole)
    return docs.select("doc_id", F.array().cast("array<int>").alias("starts"), lines.alias("lines"))


def piece_starts(text: Column) -> Column:
    """One-based lines that open a piece of writing of their own in files that hold many."""
    marked = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(x.rlike(_PIECE_START), i + 1))
    return F.when(text.rlike("(?m)" + _PIECE_START.replace("$", r"\r?$")), F.array_compact(marked)).otherwise(
        F.array().cast("array<int>")
    )


def html_lines(docs: DataFrame) -> DataFrame:
    """Visible text per line of a page: hidden bodies and comments blanked, tags dropped, block tags end a sentence."""

    def flat(tag: Column) -> Column:
        one = F.regexp_replace(tag, r"\s*\n\s*", " ")
        name = F.regexp_extract(one, r"^</?\s*([a-zA-Z][\w-]*)", 1)
        marker = F.when(name.rlike(rf"(?i)^({_BLOCK_NAMES})$"), F.concat(F.lit("<"), name, F.lit(">"))).otherwise("")
        kept = F.concat(marker, visible_attributes(one), F.repeat(F.lit("\n"), newlines(tag)))
        return F.when(tag.contains("\n"), kept).otherwise(tag)

    text = replace_matches(F.col("text"), _HIDDEN, blanked)
    text = replace_matches(text, _COMMENT, blanked)
    text = replace_matches(text, _OPEN_TAG, flat)

    def visible(line):
        shown = F.concat(visible_attributes(line), line)
        for pattern, put in (
            (_BLOCK_ANY, ". "),
            (r"<[^>]*>", " "),
            (r"&(nbsp|#160);", " "),
            (r"&(rsquo|apos|#39);", "'"),
            (r"&(mdash|#8212);", "\u2014"),
            (r"&[a-z]+;|&#\d+;", " "),
        ):
            shown = F.regexp_replace(shown, pattern, put)
        ignored = line.contains(IGNORE)
        return F.struct(
            F.when(ignored, "").otherwise(shown).alias("text"),
            (~ignored & line.rlike(_BLOCK_START)).alias("breaks"),
            F.lit(False).alias("headline"),
        )

    lines = F.transform(F.split(text, "\n", -1), visible)
    return docs.select("doc_id", piece_starts(F.col("text")).alias("starts"), lines.alias("lines"))


_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?'


def json_lines(docs: DataFrame) -> DataFrame:
    """String values of JSON documents that read as prose, each a block of its own, at the line they stand on.
    Documents that do not parse give nothing. In one that does, no string holds a line end."""
    valid = docs.where(F.try_parse_json(F.col("text")).isNotNull())
    colons = F.regexp_replace("text", r'"(\s*\n\s*):', '":$1')  # a colon belongs to the line of its key
    lines = valid.select(
        "doc_id", piece_starts(F.col("text")).alias("starts"), F.posexplode(F.split(colons, "\n", -1)).alias("i", "line")
    )
    hits = F.posexplode(F.regexp_extract_all("line", F.lit(_JSON_STRING), 0)).alias("j", "hit")
    rows = lines.where(F.col("line").contains('"')).select("doc_id", "starts", "i", hits)
    rows = rows.where(~F.col("hit").endswith(":"))  # a string followed by a colon is a key
    value = F.get(F.from_json(F.concat(F.lit("["), F.col("hit"), F.lit("]")), "array<string>"), F.lit(0))
    place = F.shiftleft(F.col("i").cast("long"), 32) + F.col("j")
    rows = rows.select("doc_id", "starts", place.alias("k"), "i", F.regexp_replace(value, r"<[^>]+>", ". ").alias("text"))
    return rows.where(F.col("text").isNotNull() & ~not_prose(F.col("text")))


def group_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, block, starts, lines): one row per block with its non-blank lines (line, text, headline). A blank line or
    a break ends the block before."""
    trimmed = F.transform("lines", lambda e: e.withField("text", trim(e["text"])))

    def marked(e, i, doc):
        opens = e["breaks"] | F.coalesce(F.get(doc["lines"], i - 1)["text"] == "", F.lit(True))
        mark = F.concat(F.when(opens, "\n\n").otherwise("\n"), F.when(e["headline"], "h").otherwise("-"))
        return F.when(e["text"] == "", "").otherwise(F.concat(mark, (i + 1).cast("string"), F.lit(" "), e["text"]))

    parts = _once({"lines": trimmed}, lambda doc: F.transform(doc["lines"], lambda e, i: marked(e, i, doc)))
    found = F.filter(F.split(F.array_join(parts, ""), "\n\n", -1), lambda x: x != "")
    rows = docs.select("doc_id", "starts", F.posexplode(found).alias("_at", "_raw"))

    def entry(x):
        space = F.instr(x, " ")
        return F.struct(
            F.substring(x, F.lit(2), space - 2).cast("int").alias("line"),
            F.substring(x, space + 1, F.length(x)).alias("text"),
            x.startswith("h").alias("headline"),
        )

    return rows.select("doc_id", (F.col("_at") + 1).alias("block"), "starts", F.transform(F.split("_raw", "\n", -1), entry).alias("lines"))


def json_groups(lines: DataFrame) -> DataFrame:
    one = F.struct((F.col("i") + 1).alias("line"), "text", F.lit(False).alias("headline"))
    return lines.select("doc_id", F.col("k").alias("block"), "starts", F.array(one).alias("lines"))


def line_rows(grouped: DataFrame) -> DataFrame:
    """(doc_id, block, starts, first_line, line, text, headline, tail): the lines of the blocks, each with the end of the
    line above it in its block."""

    def with_tail(e, k, block):
        above = F.get(block["lines"], k - 1)["text"]
        return e.withField("tail", F.coalesce(F.concat(F.right(above, F.lit(30)), F.lit(" ")), F.lit("")))

    first = F.get("lines", F.lit(0))["line"]
    tailed = _once({"lines": F.col("lines")}, lambda block: F.transform(block["lines"], lambda e, k: with_tail(e, k, block)))
    return grouped.select("doc_id", "block", "starts", first.alias("first_line"), F.inline(tailed))


def join_blocks(grouped: DataFrame) -> DataFrame:
    """(doc_id, block, line, text, pieces, headline): lines joined by a space, with the length and the number of each.
    A phrase wrapped over lines is then seen whole."""
    first = F.get("lines", F.lit(0))
    return grouped.select(
        "doc_id",
        "block",
        first["line"].alias("line"),
        F.array_join(F.transform("lines", lambda e: e["text"]), " ").alias("text"),
        F.transform("lines", lambda e: F.struct(F.length(e["text"]).alias("length"), e["line"].alias("line"))).alias("pieces"),
        first["headline"].alias("headline"),
    )


READERS = {"markdown": markdown_lines, "plain": plain_lines, "html": html_lines}


def grouped_lines(docs: DataFrame, kind: str) -> DataFrame:
    """The blocks of documents of one kind with their lines."""
    if kind == "json":
        return json_groups(json_lines(docs))
    return group_lines(READERS[kind](docs))
