"""The ten operators and the pipeline on small tables: brute force, edge cases, round trips, SQL."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from checks.compare import TABLES, rows_of
from panelwright.llm import (
    chat,
    components,
    decontamination,
    html_text,
    jaccard_join,
    license_scan,
    mixing,
    quality_model,
    quality_rules,
    repeated_phrases,
    warc,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
OPS = [n for n in registry.queries() if re.match(r"op\d+_|pipeline$", n)]


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def strange(seed=3, n=60):
    """Few words, so that runs recur; copies, edited copies, NULL, empty, blank and long texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ärger", "x|y", "!!"]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passages = [line(20) for _ in range(3)]
    texts = [None, "", " \t\n", "one", "one two three", line(4000)]
    for _ in range(n):
        texts.append(line(rng.randint(5, 60)) + rng.choice([" ", "\n", "\t "]) + rng.choice(passages) + " " + line(rng.randint(0, 30)))
    texts += [texts[8], texts[8], texts[9].replace("w3", "w4", 1), texts[9] + " end", "ab " * 40, "ab " * 50]
    return texts


def words_of(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


@pytest.mark.parametrize("name", [n for n in OPS if n in registry.oracle_sql()])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = registry.queries()[name](spark, SF)
    result = con.execute(registry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_every_operator_is_registered():
    assert {int(m[1]) for n in OPS if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in OPS


def test_stages_take_empty_tables_extra_columns_and_nulls(spark):
    extra = [F.lit(1).alias("n_words"), F.lit("x").alias("component_id"), F.lit(2).alias("size")]
    for docs in (docs_of(spark, []), docs_of(spark, strange(n=10))):
        docs = docs.withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang"))).select("*", *extra)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert set(docs.columns) <= set(out.columns), name
            out.collect()


def test_quality_rules(spark):
    texts = strange()
    got = {r.doc_id: r for r in quality_rules.judge(quality_rules.measure(docs_of(spark, texts))).collect()}
    for i, text in enumerate(texts):
        words = words_of(text)
        seen = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        inside = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(words), len(inside))
        assert got[i].base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
    assert not got[0].kept and not got[1].kept
    clean = " ".join(f"the word{i} of" for i in range(40))
    shouted = " ".join(f"THE!! WORD{i}!! OF!!" for i in range(40))
    rows = quality_rules.judge(quality_rules.measure(docs_of(spark, [clean, shouted]))).orderBy("doc_id").collect()
    assert rows[0].kept and not rows[1].kept and rows[1].broken_rules == ["exclamations", "capitals", "stop_words"]


def test_license_scan(spark):
    mit = license_scan.KNOWN["MIT"]
    texts = [
        "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ,\n"),
        mit.replace("sublicense", "sublicence"),
        mit + " And more.",
        "First line.\nReleased under the MIT Licence\nLast line.",
        None, "", "...",
    ]
    rows = license_scan.scan(docs_of(spark, texts), license_scan.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r.license for r in rows] == ["MIT", "MIT", None, None, None, None, None]
    assert [r.n_notice_lines for r in rows] == [0, 0, 0, 1, 0, 0, 0]


def test_license_texts_and_notices(spark):
    import textwrap

    listed = license_scan.license_table.FOLDER
    body = (listed / "BSD-3-Clause.txt").read_text().split("\n", 2)[2]
    bsd3 = body.replace("the copyright holder nor", "Some Group, Inc. nor").replace("COPYRIGHT\nHOLDER OR", "COPYRIGHT OWNER OR")
    gpl, apache = (listed / "GPL-3.0.txt").read_text(), (listed / "Apache-2.0.txt").read_text()
    wrapped = {n: "\n\n".join(textwrap.fill(x, n, break_long_words=False) for x in license_scan.KNOWN["MIT"].split("\n")) for n in range(13, 80, 4)}
    assert any(re.search("(?m)^copyright notice", x) for x in wrapped.values())
    whole = [
        *[("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2020 A\nAll rights reserved.\n\n{x}") for x in wrapped.values()],
        ("BSD-3-Clause", f"Copyright 2020 A. All rights reserved.\n\n{bsd3}"), ("BSD-3-Clause", re.sub(r"(?m)^[123]\.", "*", body)),
        ("GPL-3.0", gpl), ("GPL-3.0", gpl[: gpl.index("How to Apply")]), ("Apache-2.0", apache.replace("http:", "https:")),
        ("Apache-2.0", apache[: apache.index("APPENDIX")]),
        *[(n, (listed / f"{n}.txt").read_text()) for n in ("BSD-2-Clause", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0", "GPL-2.0")],
        (None, gpl + "More."), (None, bsd3.replace("SHALL", "MAY")),
    ]
    rows = license_scan.scan(docs_of(spark, [t for _, t in whole]), license_scan.known_licenses(spark)).orderBy("doc_id").collect()
    assert [(i, r.license) for i, r in enumerate(rows)] == [(i, n) for i, (n, _) in enumerate(whole)]
    notices = [
        ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
        ("GPL-3.0", "This program is distributed under the terms of the GPLv3"), ("GPL-2.0-or-later", "Released under the GNU GPL v2 or later."),
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        ("CC-BY-SA-3.0", "All text is available under the Creative Commons Attribution-ShareAlike 3.0 Unported License"),
        ("MIT", "Released under the MIT Licence."), ("MIT", "# SPDX-License-Identifier: MIT"), ("Apache-2.0", "The code is released under Apache 2.0"),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
        (None, "Licensed under a Local Licence, version 3."), (None, "This work is licensed"), (None, "All rights reserved."), (None, "version 3"),
    ]
    rows = license_scan.scan(docs_of(spark, [t for _, t in notices]), license_scan.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r.license for r in rows] == [n and f"{n} notice" for n, _ in notices]
    assert [r.n_notice_lines for r in rows] == [int(n is not None) for n, _ in notices]


def test_quality_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.queries()["op3_quality_classifier"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = rows.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in held)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9
    same = {r.doc_id: r.score for r in registry.queries()["op3_quality_classifier"](spark, sf).collect()}
    assert all(same[r.doc_id] == r.score for r in held)


def test_quality_classifier_without_two_classes(spark):
    docs = docs_of(spark, [None, "", "a b c"])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_model.classify(docs, empty).collect()] == [0.5] * 3
    ones = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")
    assert {r.score for r in quality_model.classify(docs, ones).collect()} == {1.0}


def test_mix_meets_targets(spark):
    texts = ["w " * k for k in (5, 0, 9, 40, 3, 3, 3, 100, 1, 2, 600)] + [None]
    sources = {i: "abcd"[i % 4] for i in range(9)} | {9: None, 10: "big", 11: "none"}
    rows = mixing.mix_documents(docs_of(spark, texts, sources), range_rows=2).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    goal, left, open_ = {}, sum(sizes.values()), set(by)
    while open_:  # share, stop those above, share again
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total >= 3 * sizes[s]}
        if not over:
            goal |= {s: left * weights[s] / total for s in open_}
            break
        goal |= {s: 3 * sizes[s] for s in over}
        left, open_ = left - sum(3 * sizes[s] for s in over), open_ - over
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(goal[s]) and sum(r.taken for r in rs) == int(rs[0].target + 1e-9)


def test_mix_takes_documents_without_id(spark):
    texts = ["a b c", "d e", "f", "g h i j", None, "k l"]
    docs = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 2, F.col("doc_id")))
    rows = mixing.mix_documents(docs, range_rows=2).collect()
    assert sorted(r.size for r in rows) == [0, 1, 2, 2, 3, 4]
    assert sum(r.taken for r in rows) == int(rows[0].target) and rows[0].source_size == 12
    sized, goals = mixing.sizes(docs), spark.createDataFrame([("s", 12, 6, 7.0)], "source string, source_size long, n_docs long, target double")
    assert sum(r.taken for r in mixing.mix(sized, goals, range_rows=2).collect()) == 7


def test_decontamination_of_documents_without_id(spark):
    tests = spark.createDataFrame([(1, "t1 t2 t3")], "item_id long, text string")
    docs = docs_of(spark, ["x t1 t2 t3", "t1 t2", "a t1 t2 t3"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.decontaminate(docs, tests).collect()}
    assert got == {None: (3, 1, True), 1: (0, 0, False), 2: (3, 1, True)}
    none = docs_of(spark, ["x t1 t2 t3", "clean", None, "x t1 t2 t3"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted((r.n_words, r.n_hit) for r in decontamination.decontaminate(none, tests).collect()) == [(0, 0), (1, 0), (4, 3), (4, 3)]


def test_pipeline_keeps_documents_without_id(spark):
    same = "one two three four five six seven"
    docs = docs_of(spark, [same, same, same, "eight nine"]).withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(0)))
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == ["1", "3", "None"]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    docs = docs_of(spark, [item, "clean words here only"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.text for r in corpus_pipeline.decontaminated(spark, docs, SF).collect()] == ["clean words here only"]


def test_the_mix_keeps_rows_of_repeated_and_missing_ids(spark):
    rows = [(None, "a b c"), (None, "d e f"), (1, "g h i j"), (1, "k l"), (2, "m n"), (2, "m n"), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "s", f"x{i}", 7) for i, t in rows], "doc_id long, text string, source string, row string, size int")
    mixed = corpus_pipeline.mixed(spark, docs, SF).collect()
    # One source: every word is taken once.
    assert sorted((str(r.doc_id), r.text, r.row) for r in mixed) == sorted((str(i), t, f"x{i}") for i, t in rows if t)
    assert all(r.taken == r["size"] == len(words_of(r.text)) and r.n_chars == len(r.text) for r in mixed)
    two = docs.unionByName(docs.withColumn("source", F.lit("t")).withColumn("text", F.concat("text", F.lit(" z"))))
    again = [sorted(str(tuple(r)) for r in corpus_pipeline.mixed(spark, two.repartition(n), SF).collect()) for n in (1, 3)]
    assert again[0] == again[1]
    taken = Counter()
    for r in corpus_pipeline.mixed(spark, two, SF).collect():
        taken[r.source] += r.taken
        assert len(words_of(r.text)) == r.taken
    assert taken == {"s": 13, "t": 26}  # 16 and 23 words, shared one to two


def test_html_text():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body class='x'><nav><ul><li><a href=/>menu</a></ul></nav><header>top</header>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>bold\n text<p>a &lt; b&nbsp;c"
        "<script>var t='</p>';</script><div class=ad>Buy</div><form><input>Name</form><p>Last &eacute;</article>"
        "<section id='comments'><p>Reader says a lot about this and that and more</p></section><aside>side</aside><footer>foot</footer>"
    )
    assert html_text.main_text(page) == "Head & line\nFirst bold text\na < b c\nLast é"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p><!-- x -->") == ""
    assert html_text.main_text("only text") == "only text"
    assert html_text.main_text("<p data-a=it's>The first one.</p><p>That's the second.</p>") == "The first one.\nThat's the second."
    assert html_text.main_text("<p title='a > b' data-b = \"c > d\" e'f>Held</p>") == "Held"
    assert html_text.main_text("<p title='never closed>Kept</p><p>Also</p>") == "Kept\nAlso"
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"


LONG = "".join(f"<p>{c * 300}</p>" for c in "abcdefghij")


def blocks_of(page):
    return [b if len(b) < 99 else f"{b[0]} {len(b)}" for b in html_text.main_text(page).split("\n")]


def test_html_wrapped_paragraphs_keep_title_lead_and_short_sections():
    head, tail = f"<h1>{'h' * 50}</h1><p class=lead>{'l' * 300}</p>", [f"{c} 300" for c in "abcdefghij"]
    whole, links = ["h" * 50, "l 300", *tail], "<div>" + "<a href=/>one link</a> " * 60 + "</div>"
    for tag in ("article", "main"):
        assert blocks_of(f"<body><nav>menu</nav><{tag}>{head}<div class=entry>{LONG}</div></{tag}>{links}") == whole
    sections = f"<section><h2>A</h2><p>one</p></section><section><h2>B</h2>{LONG}</section><section><p>two</p></section>"
    assert blocks_of(f"<body><article><h1>T</h1>{sections}</article>{links}") == ["T", "A", "one", "B", *tail, "two"]
    assert blocks_of(f"<body><main>{links}<article>{head}<div>{LONG}</div></article></main>") == whole
    assert blocks_of(f"<body><main><h1>T</h1><article><div>{LONG}</div></article></main>{links}") == ["T", *tail]
    assert blocks_of(f"<body><div class=page>{head}<div class=entry>{LONG}</div></div>{links}") == whole
    assert blocks_of(f"<body>{head}<div class=entry>{LONG}</div>") == whole
    assert blocks_of(f"<body><div>slogan</div><div class=entry>{LONG}</div>{links}") == tail


def test_html_layout_words_and_wrappers_keep_the_page():
    whole = ["T", *[f"{c} 300" for c in "abcdefghij"]]
    text = f"<h1>T</h1>{LONG}"
    noise = "<nav>menu</nav><div class=sidebar>side</div><div id=comments><article>Reader says</article></div><footer>foot</footer>"
    wrappers = ["div class='layout with-sidebar'", "div class='site header-fixed'", "div class='has-menu page'", "div class=no-sidebar",
                "div class='page page--has-widget'", "div class=right-sidebar", "div id=widget", "form", "form class=menu", "div role=form"]
    for w in wrappers:
        end = w.split()[0]
        for inner in (f"<article>{text}</article>", f"<main>{text}</main>", f"<div>{text}</div>"):
            assert blocks_of(f"<body><{w}>{inner}{noise if '<div>' not in inner else ''}</{end}>") == whole, (w, inner[:9])
        assert blocks_of(f"<body><form><{w}><article>{text}</article></{end}></form>{noise}") == whole, w
    assert blocks_of(f"<body><main><form>{text}</form></main>{noise}") == whole
    assert blocks_of(f"<body><aside><article>{text}</article>side</aside>") == whole
    for name in ("post-header", "entry-header", "header"):
        assert blocks_of(f"<body><article><div class='{name}'><h1>T</h1></div>{LONG}</article>{noise}") == whole, name
    assert blocks_of(f"<body><div class=post><div class=post-header><h1>T</h1></div>{LONG}</div>") == whole


def test_html_noise_is_still_dropped():
    for noise in (
        f"<div id=comments><article>{LONG}</article></div>", f"<section class=cookie-consent>{LONG}</section>", f"<aside>{LONG}</aside>",
        "<div class=sidebar><article>teaser</article></div>", "<div class='header header-fixed'>top</div>", f"<div hidden><main>{LONG}</main></div>",
    ):
        assert blocks_of(f"<body>{noise}<article><h1>T</h1><p>Some text.</p></article>") == ["T", "Some text."], noise
        assert blocks_of(f"<body><article><h1>T</h1><p>Some text.</p></article>{noise}") == ["T", "Some text."], noise
    assert html_text.main_text(f"<body><div hidden><main>{LONG}</main></div><nav>menu</nav>") == ""


def test_html_query_keeps_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = registry.queries()["op5_html_text"](spark, SF).collect()
    assert len(rows) == len(pages)
    import html

    for r in rows:
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_decontamination(spark):
    plain = [f"t{i}" for i in range(40)]
    tests = spark.createDataFrame([(1, " ".join(plain[:12])), (2, "t5 t6"), (3, None), (4, "?!"), (10, "t0, T1")], "item_id long, text string")
    texts = [" ".join(plain[:9]), "x " + ", ".join(plain[1:13]).upper(), "t0 t1 t5-t6 t5 t6", None, "", "T5.", "t5 t6 " * 3000]
    got = {r.doc_id: r for r in decontamination.decontaminate(docs_of(spark, texts), tests).collect()}
    want = {0: (4, "10,2"), 1: (11, "1,2"), 2: (6, "10,2"), 3: (0, ""), 4: (0, ""), 5: (0, ""), 6: (6000, "2")}
    for i, (hit, items) in want.items():
        assert (got[i].n_hit, got[i].items_sha256) == (hit, hashlib.sha256(items.encode()).hexdigest()), i
    none = decontamination.decontaminate(docs_of(spark, texts), tests.where("item_id > 50"))
    assert none.where("contaminated").count() == 0 and none.count() == len(texts)


def test_proximity_matches(spark):
    docs = docs_of(spark, ["a x b y c", "a b c", "a x x x x x b c", "c b"])
    listed = decontamination.phrases(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    chosen = decontamination.rarest_terms(listed, docs)
    near = decontamination.near_matches(decontamination.store_index(docs, chosen, 4), chosen)
    assert {r.doc.doc_id for r in near.collect()} == {0, 1}


@pytest.mark.parametrize("hot", [20_000, 3])
def test_substring_dedup(spark, hot):
    texts = strange()
    docs = docs_of(spark, texts)
    first = {}
    for i, text in enumerate(texts):
        words = words_of(text)
        for k in range(len(words) - 12):
            first.setdefault(tuple(words[k : k + 13]), i)
    ranges = repeated_phrases.removal_ranges(docs, hot=hot, cell=hot)
    got = {r.doc_id: r for r in repeated_phrases.digest_kept(docs, ranges).collect()}
    cut = {r.doc_id: r.text for r in repeated_phrases.remove_ranges(docs, ranges).collect()}
    for i, text in enumerate(texts):
        words = words_of(text)
        gone = {k + j for k in range(len(words) - 12) if first[tuple(words[k : k + 13])] < i for j in range(13)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert (got[i].n_words, got[i].n_removed) == (len(words), len(gone))
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert words_of(cut[i]) == kept.split() and (gone or cut[i] == text)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substring_dedup_of_repeated_and_missing_ids(spark, hot):
    """Rows of one doc_id keep results of their own; a row without one loses nothing and takes nothing."""
    shared, other = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(14))
    rows = [(None, shared), (5, shared + " tail"), (6, shared), (6, "x y z"), (6, shared), (6, "lead " + other), (None, other), (6, other), (9, "lead " + other)]
    rows += [(i, "a  b " + shared) for i in range(10, 30)]
    docs = spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], "doc_id int, text string, row string, __row int")
    first = {}
    for i, text in rows:
        for k in range(len(words_of(text)) - 12):
            phrase = tuple(words_of(text)[k : k + 13])
            if i is not None:
                first[phrase] = min(i, first.get(phrase, i))
    expected = []
    for i, text in rows:
        words = words_of(text)
        gone = {k + j for k in range(len(words) - 12) if i is not None and first[tuple(words[k : k + 13])] < i for j in range(13)}
        expected.append((str(i), len(words), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()))
    ranges = repeated_phrases.removal_ranges(docs, hot=hot, cell=hot)
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in repeated_phrases.digest_kept(docs, ranges).collect()]
    assert sorted(got) == sorted(expected)
    cut = repeated_phrases.remove_ranges(docs, ranges)
    assert cut.columns == docs.columns
    assert sorted((str(r.doc_id), len(words_of(r.text)), r.row, r["__row"]) for r in cut.collect()) == sorted((i, n - gone, "kept", 1) for i, n, gone, _ in expected)


@pytest.mark.parametrize("like", [jaccard_join.Likeness(4, 85), jaccard_join.Likeness(5, 80), jaccard_join.Likeness(1, 50)])
def test_jaccard_components(spark, like):
    rng = random.Random(5)
    texts = strange(n=30)
    base = [f"v{i}" for i in range(120)]
    for _ in range(25):  # chains of edited copies
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        texts.append(" ".join(words))
    sets = []
    for text in texts:
        words = [w.lower() for w in words_of(text)]
        sets.append({tuple(words[k : k + like.n]) for k in range(max(1, len(words) - like.n + 1))} if words else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= like.percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(docs_of(spark, texts), like).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_jaccard_of_repeated_ids(spark):
    rows = [(6, "a b c d e f"), (6, "u v w x y z"), (7, "a b c d e f"), (6, "a b c d e f"), (None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.link_components(docs, jaccard_join.Likeness(4, 85)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(x) for x in [(6, 3, 6), (6, 3, 6), (6, 3, 6), (7, 3, 6), (None, 1, None)])


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_roots_of_trees(spark):
    rows = [(i, i - 1) for i in range(1, 100)] + [(i, 50) for i in range(200, 260)] + [(300, 301)]
    got = {r.id: r.root for r in components.forest_roots(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got == {i: 0 for i in [*range(1, 100), *range(200, 260)]} | {300: 301}
    assert components.forest_roots(spark.createDataFrame([], "id long, parent long")).count() == 0


@pytest.mark.parametrize("limit,size", [(0, 1 << 24), (10, 300)])
def test_archives(spark, limit, size):
    trap = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = ["<p>é</p>" * 3, None, "", "<p>é</p>" * 3, trap, "a\nb c 5\n", trap, "x" * 5000, "short", "short"]
    pages = spark.createDataFrame([(i, "http://a b/\n", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.convert_pages(pages, limit, size).collect()}
    assert len(rows) == len(bodies) and len({r.record_id for r in rows.values()}) == len(bodies)
    payloads = [(b or "").encode() for b in bodies]
    for i, p in enumerate(payloads):
        first = payloads.index(p)
        refers = first if first < i and len(p) >= limit else None
        want = base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert (rows[i].payload_bytes, rows[i].payload_digest, rows[i].refers_to) == (len(p), want, refers)
        assert rows[i].record_type == ("response" if refers is None else "revisit") and rows[i].date == "2000-01-01T00:00:00Z"


def test_arc_versions():
    for version in (1, 2):
        fields, payload = warc.parse_arc(warc.arc_record("http://x/", b"a\nb", version, "20240102030405"))
        assert (fields["version"], payload, warc.warc_date(fields["date"])) == (version, b"a\nb", "2024-01-02T03:04:05Z")
    with pytest.raises(ValueError):
        warc.parse_arc(b"http://x/ 1.2.3.4 date\nabc")


def test_chat_round_trip_and_rewriting_template():
    turns = [("system", ""), ("user", "<|im_end|>\n<|im_start|>"), ("assistant", "\\<|\\|<\\|"), ("assistant", ""), ("assistant", "user\n")]
    formatted, spans = chat.turn_spans(turns)
    assert chat.read_back(formatted) == turns and formatted.count(chat.OPEN) == len(turns)
    loss = [chat.unescape(formatted[a:b]) for a, b in chat.loss_spans(turns, spans)]
    assert loss == ["\\<|\\|<\\|", "", "user\n"]
    assert chat.turn_spans(turns, lambda t: f"{len(t)} turns" + chat.chat_template(t))[1] is None


def test_chat_mask_is_where_the_text_stands():
    for text in ("end", "d", "i", ">", "\n", "", "assistant", "<|im_end|>", "\ue000\ue001"):
        turns = [("user", "q"), ("assistant", text), ("user", text), ("assistant", text)]
        formatted, spans = chat.turn_spans(turns)
        masks = chat.loss_spans(turns, spans)
        assert [m[0] - s[0] for m, s in zip(masks, (spans[1], spans[3]))] == [len("<|im_start|>assistant\n")] * 2
        assert [formatted[a:b] for a, b in masks] == [chat.escape(text)] * 2

    def stripping(turns):
        return "".join(f"[{role}]{text.strip()}[/{role}]" for role, text in turns)

    turns = [("user", " q "), ("assistant", "  a b \n"), ("assistant", " ")]
    formatted, spans = chat.turn_spans(turns, stripping)
    assert [formatted[a:b] for a, b in chat.loss_spans(turns, spans, stripping)] == ["a b", ""]
    hidden = lambda turns: "".join(f"{len(text)}:{text.upper()}" for _, text in turns)
    assert chat.loss_spans(turns, chat.turn_spans(turns, hidden)[1], hidden) is None


def test_chat_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (2, 1, "user", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(rows)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256(b"ab").hexdigest() and got[2].loss_chars == 0
