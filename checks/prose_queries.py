"""Document checks over the documents, pages and conversations tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.sqltext import sql
from panelwright.prose import blocks as B
from panelwright.prose import findings as C
from panelwright.prose import text as X
from panelwright.prose.rules import DEFAULT_RULES, Rule
from panelwright.session import cut_lineage

Q, O = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        Q[name] = fn
        if oracle is not None:
            O[name] = oracle
        return fn

    return register


def docs(spark, sf, text=None):
    rows = V.table(spark, sf, "documents")
    return rows.select("doc_id", (F.col("text") if text is None else text).alias("text"))


def plain_lines(spark, sf, text=None):
    return B.group_lines(B.plain_lines(docs(spark, sf, text)))


def plain_blocks(spark, sf, text=None):
    return B.join_blocks(plain_lines(spark, sf, text))


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)"


def fixed_blocks(text: str = "text", visible: str = "line", opens: str | None = None) -> dict[str, str]:
    """doclines: numbered non-blank lines with their block; docblocks: joined text."""
    opens = opens or r"regexp_matches(line, '^\s*([-*+]|\d+\.)\s|^\s*\*\*|^\s{0,3}#{1,6}\s|^\s*\|')"
    return {
        "rawlines": f"""select doc_id, unnest(string_split({text}, chr(10))) as line, generate_subscripts(string_split({text}, chr(10)), 1) as i from documents""",
        "shown": f"select doc_id, i, trim({visible}, {WS}) as t, {opens} as opens from rawlines",
        "doclines": """select doc_id, i, t, block from (select *, sum(case when t <> '' and (opens or coalesce(pt = '', true)) then 1 else 0 end)
            over (partition by doc_id order by i) as block from (select *, lag(t) over (partition by doc_id order by i) as pt from shown)) where t <> ''""",
        "docblocks": """select doc_id, block, min(i) as line, string_agg(t, ' ' order by i) as text, count(*) as n_lines from doclines group by 1, 2""",
    }


_closers = "[\"''’”)\\]*_]"
SENTENCES = {
    "cutparts": f"""select doc_id, block, line, unnest(string_split(regexp_replace(text, '([.!?]{_closers}{{0,3}})\\s+', '\\1' || chr(1), 'g'), chr(1))) as p,
        generate_subscripts(string_split(regexp_replace(text, '([.!?]{_closers}{{0,3}})\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) as k from docblocks""",
    "flagged": f"""select *, lag(regexp_matches(p, '(^|\\s)([eE]\\.g|[iI]\\.e|vs|approx|cf|al|fig|eq|Mr|Mrs|Ms|Dr|Prof|Jr|Sr|U\\.S|[A-Z])\\.{_closers}*$'))
        over (partition by doc_id, block order by k) as glue from (select * replace (trim(p, {WS}) as p) from cutparts) where p <> ''""",
    "sents": """select doc_id, block, line, s, string_agg(p, ' ' order by k) as text from (
        select *, sum(case when coalesce(glue, false) then 0 else 1 end) over (partition by doc_id, block order by k) as s from flagged) group by 1, 2, 3, 4""",
}


def words_sql(x: str) -> str:
    return f"len(regexp_split_to_array({x}, '\\s+'))"


PLAIN = fixed_blocks()


@query("t_paragraphs", sql("select doc_id, cast(block as integer) as block, cast(line as integer) as line, text, cast(n_lines as integer) as n_lines from docblocks", **PLAIN))
def _(spark, sf):
    return plain_blocks(spark, sf).select("doc_id", "block", "line", "text", F.size("pieces").alias("n_lines"))


@query("t_line_of_offset", sql("select doc_id, cast(block as integer) as block, cast(max(i) as integer) as last_line from doclines group by 1, 2", **PLAIN))
def _(spark, sf):
    rows = plain_blocks(spark, sf)
    return rows.select("doc_id", "block", X.line_of(F.col("pieces"), F.length("text") - 1, F.col("line")).alias("last_line"))


@query("t_sentences", sql("select doc_id, cast(block as integer) as block, cast(s as integer) as position, text from sents", **PLAIN, **SENTENCES))
def _(spark, sf):
    rows = C.with_sentences(plain_blocks(spark, sf))
    # An outer explode: for a plain one the sentences are made a second time, to filter empty arrays.
    each = rows.select("doc_id", "block", F.posexplode_outer("sentences").alias("k", "text")).where("k is not null")
    return each.select("doc_id", "block", (F.col("k") + 1).alias("position"), "text")


@query("t_long_sentences", sql(f"select doc_id, 'sentence runs ' || {words_sql('text')} || ' words (limit 45)' as message, text as evidence from sents where {words_sql('text')} > 45", **PLAIN, **SENTENCES))
def _(spark, sf):
    rows = C.with_sentences(plain_blocks(spark, sf))
    return C.long_sentences(rows, 45).select("doc_id", "message", "evidence")


# Words of one line each, so that SQL can find the line of a match in the line itself.
WORD_RULES = (
    Rule(r"\bthe\b", "a frequent word", "nothing"),
    Rule(r"\b[a-z]+ing\b", "an ending", "nothing", "warn"),
    Rule(r"\bDer\b", "a word with its capital", "nothing", case_sensitive=True),
    Rule(r"\b(le|les|la)\b", "an article", "nothing"),
)


def _rule_sql(rule: Rule) -> str:
    flag = "" if rule.case_sensitive else "(?i)"
    return f"""select doc_id, cast(i as integer) as line, '{rule.severity}' as severity, '"' || unnest(regexp_extract_all(t, '{flag}{rule.re}')) || '" — {rule.why}' as message from doclines"""


@query("t_banned_phrases", sql(" union all ".join(_rule_sql(r) for r in WORD_RULES), **PLAIN))
def _(spark, sf):
    return C.banned_phrases(cut_lineage(plain_blocks(spark, sf)), WORD_RULES).select("doc_id", "line", "severity", "message")


@query("t_default_rules")
def _(spark, sf):
    return C.check_documents(docs(spark, sf), "plain", DEFAULT_RULES)


_dashed_sql = fixed_blocks(text="replace(text, ',', ' —')")


@query("t_em_dash_pileup", sql("""select doc_id, cast(line as integer) as line, (length(text) - length(replace(text, '—', ''))) || ' em dashes in one block (limit 2)' as message,
       substr(text, 1, 90) || '…' as evidence from docblocks where length(text) - length(replace(text, '—', '')) > 2""", **_dashed_sql))
def _(spark, sf):
    dashed = F.replace(F.col("text"), F.lit(","), F.lit(" —"))
    return C.em_dash_pileup(plain_blocks(spark, sf, dashed), 2).select("doc_id", "line", "message", "evidence")


@query("t_paren_asides", sql("""select doc_id, cast(line as integer) as line, (length(text) - length(replace(text, '(', ''))) || ' parenthetical asides in one block (limit 2)' as message
       from docblocks where length(text) - length(replace(text, '(', '')) > 2""", **fixed_blocks(text="replace(text, ', ', ' (')")))
def _(spark, sf):
    text = F.replace(F.col("text"), F.lit(", "), F.lit(" ("))
    return C.paren_asides(plain_blocks(spark, sf, text), 2).select("doc_id", "line", "message")


SETTING = r"\b[a-z]+ = \d+"


@query("t_hyperparameter_density", sql(f"""select doc_id, text as evidence, len(regexp_extract_all(text, '(?i){SETTING}')) || ' hyperparameters in one sentence (' ||
       array_to_string(regexp_extract_all(text, '(?i){SETTING}'), ', ') || ')' as message from sents where len(regexp_extract_all(text, '(?i){SETTING}')) >= 3""",
       **fixed_blocks(text="replace(text, ', ', ' = 31 ')"), **SENTENCES))
def _(spark, sf):
    text = F.replace(F.col("text"), F.lit(", "), F.lit(" = 31 "))
    rows = C.with_sentences(plain_blocks(spark, sf, text))
    return C.hyperparameter_density(rows, SETTING, 3).select("doc_id", "evidence", "message")


@query("t_short_closing_line", sql(f"""select doc_id, 'paragraph closes on a ' || {words_sql('text')} || '-word line with no number in it' as message, text as evidence
       from (select *, max(s) over (partition by doc_id, block) as n from sents) where s = n and n >= 3 and regexp_matches(text, '^[A-Z"“]')
       and regexp_matches(text, '\\S[.!?]["''’”)\\]*]*$') and {words_sql('text')} < 7 and not regexp_matches(text, '\\d')""", **PLAIN, **SENTENCES))
def _(spark, sf):
    rows = C.with_sentences(plain_blocks(spark, sf))
    return C.short_closing_line(rows, 7, 3).select("doc_id", "message", "evidence")


HEAD = r"^(?:The|A|An|Is|Der|Die|Les?|La)\s+\w"


@query("t_activity_headline", sql(f"""select doc_id, cast(1 as integer) as line, 'headline opens on an activity ("' || regexp_extract(h, '(?i){HEAD}') || '")' as message
       from (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '(\\*\\*)+', chr(2), 'g'),
             '([^\\s])\\*([^\\s])', '\\1\\2', 'g'), '[' || chr(2) || ']', '', 'g'), '^\\s*\\d+\\.\\s*', ''), {WS}) as h from documents) where regexp_matches(h, '(?i){HEAD}')"""))
def _(spark, sf):
    lines = B.group_lines(B.markdown_lines(docs(spark, sf, F.concat(F.lit("# "), F.col("text")))))
    return C.activity_headline(B.join_blocks(lines), HEAD).select("doc_id", "line", "message")


_fig = r"(^|[^\w.])((?:[+−-]?\$?|\$[+−-]?)\d+(?:,\d{3})*(?:\.\d+)?(?:e[+-]?\d+\b)?(?:%|[KMBk]\b)?)"


@query("t_figures", sql(f"""select doc_id, figure, count(*) as n, cast(min(i) as integer) as first_line, cast(max(i) as integer) as last_line
       from (select doc_id, i, unnest(regexp_extract_all(t, '{_fig}', 2)) as figure from doclines)
       where regexp_matches(figure, '[.,$%KMBke]') or length(regexp_replace(figure, '^[+−-]', '')) >= 3 group by 1, 2""", **PLAIN))
def _(spark, sf):
    rows = C.figures(plain_lines(spark, sf), "(?!)")
    return rows.groupBy("doc_id", "figure").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


@query("t_repeated_figures", sql(f"""select doc_id, 'warn' as severity, figure as evidence from (select doc_id, unnest(regexp_extract_all(t, '{_fig}', 2)) as figure from
       doclines) where regexp_matches(figure, '[.,$%KMBke]') or length(regexp_replace(figure, '^[+−-]', '')) >= 3 group by 1, 2, 3 having count(*) > 1""",
       **fixed_blocks(text="regexp_replace(text, '([.])', ' 12.5% . 1,250', 'g')")))
def _(spark, sf):
    text = F.regexp_replace("text", r"([.])", " 12.5% . 1,250")
    return C.repeated_figures(plain_lines(spark, sf, text), "(?!)", 1).select("doc_id", "severity", "evidence")


# Markdown as SQL can follow it on these documents, which hold no code spans, tags, links or front matter.
_star = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(\\*\\*)+', chr(2), 'g'), '([^\\s])\\*([^\\s])', '\\1\\2', 'g'), '([^\\s])\\*([^\\s])', '\\1\\2', 'g'), '[' || chr(2) || ']|__', '', 'g')"
_visible = f"""case when regexp_matches(line, '^\\s*\\|') then (case when regexp_matches(line, '^[\\s|:-]+$') then '' else replace(line, '|', '. ') end)
    else regexp_replace({_star.format("regexp_replace(line, '^\\s*[#>*\\-+]+\\s*', '')")}, '^\\s*\\d+\\.\\s*', '') end"""
_md_opens = r"""(regexp_matches(line, '^\s*([-*+]|\d+\.)\s|^\s*\*\*|^\s{0,3}#{1,6}\s|^\s*\|') or
    coalesce(regexp_matches(lag(line) over (partition by doc_id order by i), '^\s{0,3}#{1,6}\s'), false))"""


@query("t_markdown_blocks", sql("select doc_id, cast(block as integer) as block, cast(line as integer) as line, text from docblocks", **fixed_blocks(visible=_visible, opens=_md_opens)))
def _(spark, sf):
    return B.join_blocks(B.group_lines(B.markdown_lines(docs(spark, sf)))).select("doc_id", "block", "line", "text")


_page = "html"
for _body in ("script", "style", "svg"):
    _page = f"regexp_replace({_page}, '(?is)<{_body}.*?</{_body}\\s*>', ' ', 'g')"
_page = f"regexp_replace({_page}, '(?s)<!--.*?-->', ' ', 'g')"
for _re, _put in ((r"(?i)</?\s*(p|li|h[1-6]|td|th|tr|div|section|article|blockquote|figcaption|dt|dd)\b[^>]*>", ". "), ("<[^>]*>", " "), ("&(nbsp|#160);", " "),
                  ("&(rsquo|apos|#39);", "''"), ("&(mdash|#8212);", "—"), (r"&[a-z]+;|&#\d+;", " ")):
    _page = f"regexp_replace({_page}, '{_re}', '{_put}', 'g')"


@query("t_html_text", f"select page_id, trim(regexp_replace({_page}, '\\s+', ' ', 'g')) as text from pages")
def _(spark, sf):
    rows = V.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    out = B.join_blocks(B.group_lines(B.html_lines(rows)))
    whole = out.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda e: e["text"]), " ").alias("text"))
    return whole.select(F.col("doc_id").alias("page_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


_tokens = "regexp_split_to_array(trim({0}, " + WS + "), '\\s+')"
_class = "len(list_filter(@T, lambda x: regexp_matches(x, '^-?[a-z0-9]+([-:/.][a-z0-9%.\\[\\]()#-]+)+$'))) / len(@T) >= 0.6 and len(@T) >= 2"
_css_re = X._CSS
_css = f"len(list_filter(@T, lambda x: regexp_matches(x, '{_css_re}'))) > 0 and len(list_filter(@T, lambda x: regexp_matches(x, '{_css_re}') or regexp_matches(x, '^[a-z-]+,?$'))) = len(@T)"
_sqlish = f"(regexp_matches(@X, '(?i){X.SQL_OPENING}') or regexp_matches(@X, '(?i){X.SQL_ONLY}')) and len(regexp_extract_all(@X, '(?i){X.SQL_WORDS}')) >= 2"


def _non_prose(x: str) -> dict[str, str]:
    tests = {"class_list": _class, "css_value": _css, "sql_text": _sqlish}
    return {k: e.replace("@T", _tokens.format(x)).replace("@X", x) for k, e in tests.items()}


_texts = "regexp_replace(regexp_replace(p_name, ' ', '-', 'g'), '$', ' md:' || p_size || ' sm:p-2')"
_cssx = "p_size || 'px solid #' || substr(md5(p_name), 1, 6)"
_sqlx = "'select ' || p_name || ' from part where p_size = ' || p_size"
_flags = lambda n: ", ".join(f"{e} as {n}_{k}" for k, e in _non_prose(n).items())


@query("t_non_prose", f"select p_partkey, {_flags('a')}, {_flags('b')}, {_flags('c')}, {_flags('d')} from (select *, {_texts} as a, {_cssx} as b, {_sqlx} as c, p_name as d from part)")
def _(spark, sf):
    size = F.col("p_size").cast("string")
    rows = V.table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(" md:"), size, F.lit(" sm:p-2")).alias("a"),
        F.concat(size, F.lit("px solid #"), F.substring(F.md5("p_name"), 1, 6)).alias("b"),
        F.concat(F.lit("select "), "p_name", F.lit(" from part where p_size = "), size).alias("c"),
        F.col("p_name").alias("d"),
    )
    tests = {"class_list": X.looks_like_class_list, "css_value": X.looks_like_css_value, "sql_text": X.looks_like_sql}
    return rows.select("p_partkey", *[fn(F.col(n)).alias(f"{n}_{k}") for n in "abcd" for k, fn in tests.items()])


_np = _non_prose("text")


@query("t_json_strings", f"""select conv_id, turn, text from (select conv_id, turn, regexp_replace(text, '<[^>]+>', '. ', 'g') as text from conversations)
       where regexp_matches(text, '\\s') and not regexp_matches(text, '^[@./#]|^[a-z]+://') and not ({_np['class_list']}) and not ({_np['css_value']}) and not ({_np['sql_text']})""")
def _(spark, sf):
    talk = V.table(spark, sf, "conversations")
    # One JSON document per message, with the text under a key and other values that are not prose.
    made = F.to_json(F.struct("role", F.struct("text", F.lit("/a/path").alias("link")).alias("body"), F.array(F.lit(1)).alias("n")))
    rows = talk.select(F.struct("conv_id", "turn").alias("doc_id"), made.alias("text"))
    return B.json_lines(rows).select("doc_id.conv_id", "doc_id.turn", "text")


@query("t_targets", """select doc_id, path from (select doc_id, lang || '/' || source || '/' || doc_id || case when n_chars % 3 = 0 then '.json' else '.md' end as path from documents)
       where path like 'en/%.md' and path not like 'en/web/%'""")
def _(spark, sf):
    end = F.when(F.col("n_chars") % 3 == 0, ".json").otherwise(".md")
    rows = V.table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), end)).alias("path"))
    return C.select_targets(rows, ["en"], ["en/web"])


@query("t_missing_targets", "select 'xx' as path union all select 'en/none'")
def _(spark, sf):
    rows = V.table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"))
    return C.missing_targets(rows, ["en", "xx", "en/none"])


@query("t_findings_summary", sql("select count(case when severity = 'error' then 1 end) as errors, count(case when severity = 'warn' then 1 end) as warnings, "
       "count(case when severity = 'error' then 1 end) = 0 as passed from (" + " union all ".join(_rule_sql(r) for r in WORD_RULES) + ")", **PLAIN))
def _(spark, sf):
    return C.findings_summary(C.banned_phrases(cut_lineage(plain_blocks(spark, sf)), WORD_RULES))


@query("t_ignored_lines", sql("select doc_id, count(*) as n_lines from doclines where not contains(raw, 'the') group by 1", **{
       **fixed_blocks(visible=_visible, opens=_md_opens), "shown": f"select doc_id, i, line as raw, trim({_visible}, {WS}) as t, false as opens from rawlines",
       "doclines": "select doc_id, raw, t from shown where t <> ''"}))
def _(spark, sf):
    text = F.replace(F.col("text"), F.lit("the"), F.lit("the " + B.IGNORE))
    lines = B.group_lines(B.markdown_lines(docs(spark, sf, text)))
    return B.line_rows(lines).groupBy("doc_id").agg(F.count("*").alias("n_lines"))
