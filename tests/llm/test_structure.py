"""Conversation repair, packing and the hash tree next to brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm import conversation_repair, merkle, packing, queries

TALK = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FILE = public_tokenizers.path("byte_bpe_50k.json")


def hexed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def best_edits(rows):
    """(cost, audit, repaired lines) of rows (role, text, must go, truncated): cheapest first over all edits."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if not re.fullmatch("(s?(ua)*u?)?", roles):
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        if len(audit) < 2 * len(rows) + 2:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role[0], (*lines, f"{role}:")))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, lines))
            if not gone:
                stays = 5 * cut
                heapq.heappush(heap, (cost + stays, audit + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + stays, audit + "R", i + 1, roles + new[0], (*lines, f"{new}:{text}")))


def expected(rows):
    """The report of one conversation's rows (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, listed = set(), Counter(), []
    for turn, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        listed.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = best_edits(listed)
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hexed("\n".join(lines)))


def talks(seed=1, n=120):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent"]
    texts = ["Yes.", "No!", "why", "", " \n", None, "So? ", "a\tb", "x" * 9000 + "."]
    return {c: [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}.") for _ in range(rng.randint(1, 6))] for c in range(n)}


def test_repair_is_the_cheapest_edit(spark):
    given = talks()
    rows = spark.createDataFrame([(c if c else None, *r) for c, rs in given.items() for r in rs], TALK).withColumn("again", F.lit(1)).withColumn("ends", F.lit("x"))
    got = {r.conv_id or 0: tuple(r)[1:] for r in conversation_repair.report(rows).collect()}
    for c, rs in given.items():
        assert got[c] == expected(rs), (c, rs)
    edits = defaultdict(list)
    for r in conversation_repair.repair(rows).orderBy("conv_id", "step").collect():
        edits[r.conv_id or 0].append(r)
    for c, found in edits.items():
        assert [r.step for r in found] == list(range(len(found))) and "".join(r.edit for r in found) == got[c][6]
        assert hexed("\n".join(f"{r.role}:{r.text}" for r in found if r.edit != "D")) == got[c][7]


def test_repair_of_a_giant_conversation_in_batches(monkeypatch):
    monkeypatch.setattr(conversation_repair, "SPOOL", 300)
    rng = random.Random(4)
    rows = [(str(i), rng.choice(["user", "assistant", "system"]), f"said {i}" + rng.choice([".", "?", ""])) for i in range(3000)]
    frame = pd.DataFrame([("7", *r, r[2][-1], False) for r in rows], columns=["conv_id", "turn", "role", "text", "ends", "again"])

    def audit(size):
        stream = conversation_repair.Stream()
        batches = [frame.iloc[i : i + size] for i in range(0, len(frame), size)]
        (found,) = [list(conversation_repair.repaired(t, stream.program)) for t in conversation_repair._ended(stream, batches)]
        assert len(stream.program.states) < 200
        return [(e[0], e[3]) for e in found], found[0][-1]

    assert audit(1) == audit(17) == audit(3000)
    edits, cost = audit(17)
    roles = "".join(role[0] for edit, role in edits if edit != "D")
    assert re.fullmatch("s?(ua)+", roles)
    count = Counter(e for e, _ in edits)
    kept = sum(not r[2].endswith((".", "?")) for r, (e, _) in zip(rows, [x for x in edits if x[0] != "I"]) if e != "D")
    assert cost == count["R"] + 2 * count["D"] + 5 * count["I"] + 5 * kept


def test_repair_of_nothing_and_of_lost_conversations(spark):
    none = spark.createDataFrame([], TALK)
    assert conversation_repair.report(none).count() == conversation_repair.repair(none).count() == 0
    rows = spark.createDataFrame([(3, 0, "user", "Hi."), (None, 1, "user", "Hi.")], TALK)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.with_empty(conversation_repair.report(rows.where("conv_id = 3")), rows).collect()}
    assert got == {3: (0, 0, 0, 0, 0, 2, "D", hexed("")), None: (0, 0, 0, 0, 0, 0, "", hexed(""))}


def test_damage_follows_the_checksum(spark):
    rows = spark.createDataFrame([(c, t, "assistant", "A. b! c?") for c in [*range(60), None] for t in (0, None)], TALK)
    got = defaultdict(list)
    for r in queries.damaged(rows).collect():
        got[r.conv_id, r.turn].append((r.role, r.text))
    for c in [*range(60), None]:
        for t in (0, None):
            key = f"{' ' if c is None else c}:{' ' if t is None else t}"
            d = zlib.crc32(key.encode()) % 20
            row = ("user" if d == 4 else "assistant", "" if d == 1 else "A b c" if d == 2 else "A. b! c?")
            assert got[c, t] == [row] * (0 if d == 0 else 2 if d == 3 else 1)


def test_packing_round_trip_without_padding(spark):
    rng = random.Random(2)
    words = ["the", "Ärger", "\n\n", "  ", "don't", "x²", "漢字", "<|endoftext|>", "12345", "ࡰ", "\U0001fae9", "\x1c", "\x85"]
    texts = [None, "", "a"] + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 50, 400, 3000]))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).withColumn("length", F.lit(3)).withColumn("ids", F.lit("x"))
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    for parts in (1, 3):
        rows = packing.pack(docs.repartition(parts, "doc_id"), FILE).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in rows:
            piece = np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
            assert len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
            by_doc[r.doc_id].append((r.start, piece))
            by_sequence[r.sequence_id].append((r.offset, r.length))
        for i, want in ids.items():
            pieces = sorted(by_doc[i])
            assert [s for s, _ in pieces] == [sum(len(p) for _, p in pieces[:k]) for k in range(len(pieces))]
            assert sum((p for _, p in pieces), []) == want
        short = 0
        for pieces in by_sequence.values():
            pieces.sort()
            assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
            size = sum(n for _, n in pieces)
            assert size <= 1024 and size & (size - 1) == 0  # a power of two needs no padding
            short += size < 1024
        assert short <= 10 * parts


def test_plain_words_are_the_words_of_the_pattern(monkeypatch):
    monkeypatch.setattr(packing, "PART", 5)
    ids, tokenizer = packing.Ids(FILE), Tokenizer.from_file(FILE)
    plain = [chr(c) for c in range(0x3000) if not ids.other(chr(c))]
    assert len(plain) > 500
    for c in plain:
        text = f"a{c}b1{c}2 {c}{c} .{c}._{c}_\n{c} '{c}"
        assert ids.plain_split(text) == ids.split(text), hex(ord(c))
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b c", " ", "\n", "é", "don't", "漢", "1", ".", "\xa0", "\u2028"]) for _ in range(60))
        assert "".join(packing.parts_of(text)) == text
        assert np.frombuffer(ids.of_all([text])[0], dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.Q["op12_sum_of_squares_packing"](spark, sf).collect()
    tokenizer = Tokenizer.from_file(FILE)
    ids = {d.doc_id: [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0] for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
    assert {r.doc_id for r in rows} == set(ids)


def test_packing_minimises_squares():
    rng = random.Random(6)
    for _ in range(40):
        levels, window = packing.Levels(16), 16
        for _ in range(60):
            size, before = rng.randint(1, 15), levels.count.copy()

            def squares(level):
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < window
                return int((after[1:window] ** 2).sum())

            usable = [h for h in range(window - size + 1) if h == 0 or before[h]]
            _, level = levels.place(size)
            assert level in usable and squares(level) == min(map(squares, usable))
            assert levels.room == sum((window - h) * int(n) for h, n in enumerate(levels.count))


def test_packing_edge_cases(spark):
    docs = spark.createDataFrame([], DOCS)
    assert packing.pack(docs, FILE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, FILE, window=1000)
    rows = spark.createDataFrame([(None, "a b", "", "", 0), (None, "a b", "", "", 0), (1, "a b " * 200_000, "", "", 0)], DOCS)
    pieces = packing.pack(rows.coalesce(1), FILE, window=64)
    assert sorted({(r.doc_id or 0, r.doc_tokens) for r in pieces.collect()}) == [(0, 3), (1, 400_002)]
    found = packing.sequences(pieces)
    assert found.agg(F.sum("length"), F.max("length")).first()[:] == (400_008, 64)
    assert found.where("octet_length(ids) != 4 * length or documents[0].offset != 0").count() == 0


def leaf(*fields):
    return hexed("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hexed("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_manifest(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        lower = text if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        first = leaf(doc_id, source, lang, n, text)
        groups[lang].append((doc_id is not None, doc_id or 0, first, leaf(doc_id, source, lang, n, lower) if changed else first))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([r[2] for r in sorted(groups[g])]) for g in langs}
    tops = tree_of([trees[g][-1][0] for g in langs])
    out = []
    for g in langs:
        for i, (has, doc_id, first, later) in enumerate(sorted(groups[g])):
            node, proof = later, ""
            for levels, at in ((trees[g], i), (tops, langs.index(g))):
                for level in levels[:-1]:
                    run = list(range(at - at % 8, min(at - at % 8 + 8, len(level))))
                    proof += "".join(level[k] for k in run if k != at)
                    node = hexed("".join(node if k == at else level[k] for k in run))
                    at //= 8
            out.append((doc_id if has else None, first, trees[g][-1][0], tops[-1][0], hexed(proof), node, node == tops[-1][0]))
    return sorted(out, key=repr)


def manifest_of(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).withColumn("grp", F.lit("x")).withColumn("index", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.Q["op13_merkle_manifest"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_manifest_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    langs = [None, "", "de", "en", *[f"x{i}" for i in range(20)]]
    rows = [(rng.choice([None, i, i, i // 2]), rng.choice([None, "", "A b C", f"Ä{i}"]), rng.choice(["en", rng.choice(langs)]), rng.choice([None, "s"]), rng.choice([None, 3])) for i in range(700)]
    rows += [rows[5]] * 20 + [(-1, "Z" * 300_000, "en", "s", 1)]
    assert manifest_of(spark, rows, tmp_path) == brute_manifest(rows)


def test_blocks_and_their_versions():
    leaves = [hexed(str(i)) for i in range(65)]
    blocks = [merkle.Tree(leaves[i : i + 8], 1) for i in range(0, 65, 8)]
    assert tree_of([b.top for b in blocks])[-1] == tree_of(leaves)[-1]
    tree = merkle.Tree(leaves[:40], None)
    for place, new in ((0, "x"), (39, "y"), (17, leaves[17])):
        want = tree_of([new if i == place else h for i, h in enumerate(leaves[:40])])
        version = tree.version(place, new)
        assert version == [level[place // 8**k] for k, level in enumerate(want)] and tree.nodes == tree_of(leaves[:40])


@pytest.mark.parametrize("n", [0, 1, 8, 9, 4096, 4097, 9000])
def test_manifest_sizes(spark, tmp_path, n):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(n)] + ([(1, "T", "de", "s", 0)] if n == 9 else [])
    assert manifest_of(spark, rows, tmp_path) == brute_manifest(rows)
