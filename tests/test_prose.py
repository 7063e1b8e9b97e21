import json

import pytest
from pyspark.sql import functions as F

from panelwright.prose import blocks as B
from panelwright.prose import findings as C
from panelwright.prose.rules import BANNED, DEFAULT_RULES, read_rules

PAGE = """---
title: x
---
# We built a thing

First line of a paragraph that will leverage
the long
tail of `code leverage` and [a moat](http://moat).

```
leverage in a fence
~~~
still leverage
```

- item one with a moat
- item two

    indented moat under the list

Plain text again.

    indented code moat

| moat | cell |
|------|------|
<!-- a moat
in a comment --> after the comment.
This line has a moat prose-check-ignore
[ref]: http://moat
> Quoted *moat* and **bold** text.
"""


@pytest.fixture(scope="module")
def docs(spark):
    return lambda text: spark.createDataFrame([(1, text)], "doc_id int, text string")


def found(rows):
    return sorted((r["line"], r["severity"], r["message"]) for r in rows.collect())


def test_markdown_shows_only_prose(docs):
    rows = B.join_blocks(B.group_lines(B.markdown_lines(docs(PAGE)))).orderBy("line").collect()
    got = [(r["line"], r["text"]) for r in rows]
    assert got[0] == (4, "We built a thing") and rows[0]["headline"]
    assert got[1] == (6, "First line of a paragraph that will leverage the long tail of   and a moat.")
    texts = [t for _, t in got]
    assert "item one with a moat" in texts and "indented moat under the list" in texts
    assert ".  moat .  cell ." in texts
    assert not any("fence" in t or "code moat" in t or "ignore" in t or "http" in t or "in a comment" in t for t in texts)
    assert any(t.endswith("Quoted *moat* and bold text.") for t in texts)


def test_banned_phrases_are_found_on_their_source_line(docs):
    got = found(C.check_documents(docs(PAGE)))
    assert (4, "error", 'headline opens on an activity ("We built")') in got
    assert (6, "error", '"leverage" — verb-as-jargon') in got
    assert any(line == 7 and "the long tail" in m and sev == "warn" for line, sev, m in got)
    moats = [line for line, _, m in got if m.startswith('"moat"')]
    assert moats == [8, 16, 19, 25, 31]


SAMPLES = [
    "the sales motion", "the perfect shape", "an egg-shaped thing", "the silent majority", "the long tail", "a shelf-ranked list",
    "card-swipe range", "a pull channel", "a CTA", "moats", "leveraged", "delving", "a tapestry", "testament to",
    "a robust plan", "moreover", "not only x but also y", "in today's world", "a myriad", "deep dive", "surfaced a", "a popular library",
    "Acme", "A site we built", "genuinely", "key takeaways", "silent success", "it isn't this — it is that", "the one thing to know:",
    "hold me to", "a shelf",
]


def test_every_rule_fires_on_its_sample(docs):
    rows = C.banned_phrases(B.join_blocks(B.group_lines(B.plain_lines(docs("\n\n".join(SAMPLES))))), BANNED).collect()
    assert len(SAMPLES) == len(BANNED) == 31
    by_line = {}
    for r in rows:
        by_line.setdefault((r["line"] + 1) // 2 - 1, set()).add(r["message"].split(" — ", 1)[1])
    for i, rule in enumerate(BANNED):
        assert any(m == rule.why or m.endswith(rule.why) for m in by_line.get(i, ())), (i, rule.re)


def test_case_and_lookaround(docs):
    text = "a cta here\n\nan off-the-shelf part, shelf life, le café moaté"
    got = found(C.check_documents(docs(text), "plain"))
    assert [m for _, _, m in got if "CTA" in m or "shelf" in m] == []
    assert any(m.startswith('"moat"') for _, _, m in got)  # \b is ASCII, so the accent ends the word


def test_structure_checks(docs):
    long = " ".join(["word"] * 46) + "."
    settings = "We set lr=1e-4, seed 7 and dropout of 0.1 here."
    closing = "One sentence stands here now. Another sentence follows it. Facts end."
    got = found(C.check_documents(docs("\n\n".join([long, settings, closing, "a — b — c — d", "(a) (b) (c)"])), "plain"))
    messages = {line: m for line, _, m in got}
    assert messages[1] == "sentence runs 46 words (limit 45)"
    assert messages[3].startswith("3 hyperparameters in one sentence (lr=1e-4")
    assert messages[5] == "paragraph closes on a 2-word line with no number in it"
    assert messages[7] == "3 em dashes in one block (limit 2)" and messages[9] == "3 parenthetical asides in one block (limit 2)"


def test_abbreviations_do_not_end_a_sentence(spark, docs):
    text = 'It costs, e.g. $12, a lot. See Dr. A. Smith et al. for "more." Then stop! i.e. e.g. nothing'
    rows = C.with_sentences(B.join_blocks(B.group_lines(B.plain_lines(docs(text))))).first()["sentences"]
    assert rows == ["It costs, e.g. $12, a lot.", 'See Dr. A. Smith et al. for "more."', "Then stop!", "i.e. e.g. nothing"]


def test_repeated_figures_skip_small_numbers_and_versions(docs):
    text = "Up 12.5% now.\nUp 12.5% then, Gemini\n2.5 and 10.\n\nAgain 12.5% and 10, Gemini 2.5, Python 2.5 and 10."
    got = found(C.check_documents(docs(text), "plain"))
    assert got == [(5, "warn", '"12.5%" appears 3 times (lines 1, 2, 5)')]


def test_html_drops_machinery_and_keeps_attributes(docs):
    page = (
        "<html><head><style>moat{}</style><script>\nvar moat = 1;\n</script>\n"
        '<meta name="description" content="About a moat"></head>\n<p class="x"\n  title="Tip moat">One&nbsp;line</p><li>two &mdash; it&rsquo;s</li>\n'
        "<!-- moat\n --><svg><path d='moat'/></svg><h2>Three</h2></html>"
    )
    rows = B.join_blocks(B.group_lines(B.html_lines(docs(page)))).orderBy("line").collect()
    text = " ".join(r["text"] for r in rows)
    assert text.count("moat") == 2 and "About a moat. " in text and "Tip moat. " in text
    assert "One line" in text and "two — it's" in text and "Three" in text and "var" not in text


def test_json_reads_prose_values_at_their_line(docs):
    deck = json.dumps({"id": "abc", "path": "/a b", "cls": "flex-1 items-center gap-2", "css": "64px solid", "copy": {"b": ["It is a \"moat\" here.", "x"]},
                       "q": "SELECT a FROM b", "html": "a<br>b moat"}, indent=2)
    got = found(C.check_documents(docs(deck), "json"))
    assert [line for line, _, _ in got] == [8, 13]
    assert B.json_lines(docs("{not json 'moat here'")).count() == 0


def test_rules_file_of_the_same_shape(spark, docs, tmp_path):
    rules = {"comment": "c", "banned": [{"re": "\\bfoo\\b", "why": "w", "instead": "i", "severity": "warn"}, {"re": "Bar", "why": "v", "instead": "j", "caseSensitive": True}],
             "structure": {"maxSentenceWords": 3, "maxEmDashesPerBlock": 2, "maxParenAsidesPerBlock": 2, "minClosingSentenceWords": 7,
                           "minSentencesForClosingCheck": 3, "maxHyperparametersPerSentence": 3, "maxFigureRepeats": 2},
             "hyperparameter": "x=\\d", "headlineActivity": "^I did", "versionPrefix": "v$"}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules, indent=1))
    got = found(C.check_documents(docs("foo bar Bar baz"), "plain", read_rules(spark, str(path))))
    assert got == [(1, "error", '"Bar" — v'), (1, "error", "sentence runs 4 words (limit 3)"), (1, "warn", '"foo" — w')]
    assert DEFAULT_RULES.with_limits(sentence_words=9).limits.sentence_words == 9


def test_targets_and_summary(spark):
    paths = ["README.md", "docs/a.md", "docs/x/b.html", "docs/node_modules/c.md", "docs/d.json", "deck.json", "docs/skip/e.md", "other.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = sorted(r["path"] for r in C.select_targets(rows, ["README.md", "docs", "deck.json"], ["docs/skip"]).collect())
    assert got == ["README.md", "deck.json", "docs/a.md", "docs/x/b.html"]
    assert [r["path"] for r in C.missing_targets(rows, ["docs", "gone.md"]).collect()] == ["gone.md"]
    empty = spark.createDataFrame([], "doc_id int, line int, severity string, message string, evidence string, instead string")
    assert tuple(C.findings_summary(empty).first()) == (0, 0, True)
    mixed = spark.createDataFrame([(1, 1, "warn", "a", "", ""), (1, 9, "error", "b", "", "")], empty.schema)
    assert [r["severity"] for r in C.in_report_order(mixed).collect()] == ["error", "warn"]


def test_control_characters_do_not_end_a_sentence(spark, docs):
    text = "One part\x01two part ends here. Next one."
    rows = C.with_sentences(B.join_blocks(B.group_lines(B.plain_lines(docs(text))))).first()["sentences"]
    assert rows == ["One part\x01two part ends here.", "Next one."]


def test_a_block_over_a_piece_border_counts_as_one_piece(spark):
    text = "We saw 12.5% here,\n12.5% there and\nexport of 12.5% at last.\n\nexport two\n\nOnly 12.5% now."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    lines = B.grouped_lines(docs, "html")
    assert [(r.piece, r.line) for r in C.figures(lines, "(?!)").orderBy("line").collect()] == [(0, 1), (0, 2), (0, 3), (5, 7)]
    (found,) = C.repeated_figures(lines, "(?!)", 2).collect()
    assert found.line == 3 and "3 times" in found.message
    assert C.repeated_figures(lines, "(?!)", 3).count() == 0


def test_blocks_need_no_shuffle_and_rows_of_one_id_are_not_mixed(spark):
    texts = ["one\ntwo\n\n- three", "", None, "\n\n", "# four\nfive", "- list\n\n    deep in it\n\nout\n\n    code\n" * 3]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    for kind in ("markdown", "plain", "html", "json"):
        plan = B.join_blocks(B.grouped_lines(docs, kind))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    got = sorted((r.block, r.line, r.text) for r in B.join_blocks(B.grouped_lines(docs, "markdown")).collect())
    want = [(1, 1, "one two"), (2, 4, "three"), (1, 1, "four"), (2, 2, "five")]
    want += [(1 + 3 * k, 1 + 7 * k, "list") for k in range(3)] + [(2 + 3 * k, 3 + 7 * k, "deep in it") for k in range(3)]
    assert got == sorted(want + [(3 + 3 * k, 5 + 7 * k, "out") for k in range(3)])


def test_a_colon_on_the_next_line_still_makes_a_key(spark):
    text = '{"the key of this entry"\n : "a value that reads as prose",\n "list": ["an item \\" : of plain words"]}'
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.i, r.text) for r in B.json_lines(docs).orderBy("k").collect()]
    assert got == [(1, "a value that reads as prose"), (2, 'an item " : of plain words')]


def test_a_text_of_very_many_lines_stays_linear(spark):
    import time

    seconds = []
    for n in (20_000, 80_000):
        docs = spark.createDataFrame([(1, "- a line of words\n" * n)], "doc_id long, text string")
        began = time.time()
        assert B.join_blocks(B.grouped_lines(docs, "markdown")).agg(F.sum(F.length("text"))).first()[0] == 15 * n
        seconds.append(time.time() - began)
    assert seconds[1] < 9 * seconds[0] + 2


def test_sentence_patterns_begin_with_what_they_look_for(spark):
    """A pattern that begins with a lookbehind is tried in full at every character; the results stay those of one."""
    from panelwright.prose import text as X

    assert not X._SENTENCE_END.startswith("(?<") and not X._ABBREVIATION.startswith("(?<")
    said = [
        "One. Two!  Three? (Four.) Five.",
        'He said "no." Then e.g. this, Dr. Mr. X. and J. Doe.',
        "A.)*_  B vs. C.))))) d approx.\t e\x0b cf.\" g.",
        "Wait...  what?! U.S. troops. al.)] gone.  nbsp. end.  ",
    ]
    end = f"(?<=[.!?]{X._CLOSERS}{{0,3}})\\s+"
    glue = X._ABBREVIATION[len(X._MARK):-len(X._MARK) - 1] + ")" + X._MARK
    marked = F.regexp_replace(F.regexp_replace("t", end, X._MARK), glue, " ")
    plain = F.filter(F.transform(F.split(marked, X._MARK, -1), X.trim), lambda s: s != "")
    rows = spark.createDataFrame([(t,) for t in said], "t string").select(X.sentences(F.col("t")).alias("now"), plain.alias("then")).collect()
    assert [r["now"] for r in rows] == [r["then"] for r in rows]
    assert rows[0]["now"] == ["One.", "Two!", "Three?", "(Four.)", "Five."]


def test_lines_of_many_sentences_in_one_block(spark):
    """The place of a sentence is found once, not once per line of its block."""
    import time

    text = "\n".join(f"Line {i} says so much." for i in range(1200))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = C.with_sentences(B.join_blocks(B.group_lines(B.plain_lines(docs))))
    begun = time.time()
    found = C.long_sentences(rows, 4).select("line", "evidence").collect()
    assert time.time() - begun < 30
    assert [(r["line"], r["evidence"]) for r in found] == [(i + 1, f"Line {i} says so much.") for i in range(1200)]
