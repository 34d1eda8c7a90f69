"""Operators of the training-data part against brute force, round trips and hard cases."""

import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from ragmill.llm import bpe, common, decontam, jaccard, licenses, pu, quality, queries, quotes, suffix_tree, token_counts, warc
from ragmill.llm.common import tokenizer_path
from ragmill.llm.decontam import SLOP

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOCAB = tokenizer_path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, _t string, words array<string>"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def docs_of(spark, texts, lang="en", source="s"):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, source, 0, "clash", ["clash"]) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def hard():
    rnd = random.Random(3)
    words = [rnd.choice(["alpha", "Beta", "gämma", "delta.", "x", "the", "of"]) + str(rnd.randrange(40)) for _ in range(300)]
    body = " ".join(words)
    return [None, "", " \t\n", "one", body, body, body + " tail", body.upper(), "x" * 9000, "a b c d e f " * 400, "é\x85\xa0ß İ K\x1c|| ## $$", "line\nline\n\nline\r\nother",
            "Licensed under the MIT License. GNU General Public License, version 3; CC BY-SA 4.0", "<|endoftext|> ok"]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, spark, sf, con):
    assert_same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], con)


def base_stats(t):
    w = SPACE.findall(t or "")
    lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    hit = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), failed


def test_quality_statistics(spark, sf, hard):
    texts = hard + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_stats(t), t
        assert not (r["kept"] and r["base_failed"])


def numpy_mcd(x):
    """The estimate of one group by the definition, with plain sorting-free cuts as the operator makes them."""
    floor = np.diag([(f * quality.UNIT) ** 2 for f in quality.FLOOR])
    moments = lambda r, f: (r.mean(0), np.cov(r.T, bias=True) * f + floor)
    q = np.percentile(x, [25, 50, 75], axis=0, method="inverted_cdf")
    wide = ((q[2] - q[0]) / 1.349) ** 2 + np.diag(floor)
    near = (np.abs(x - q[1]) <= quality.CENTRAL * np.sqrt(wide)).all(1)
    best = None
    for mean, cov in [moments(x, 1), (q[1], np.diag(wide)), moments(x[near], 1)]:
        for _ in range(40):
            d = ((np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)) ** 2).sum(0)
            b = np.floor(np.log1p(d) * quality.BINS)
            cut = np.sort(b)[math.ceil(quality.KEEP_SHARE * len(x)) - 1]
            mean, cov = moments(x[b <= cut], quality.CONSISTENCY)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = (det, mean, cov)
    return best


def test_mcd_equals_numpy(spark):
    rng = np.random.default_rng(15)
    groups = {"a": rng.normal(500, [30, 60, 20, 40], (400, 4)), "b": np.vstack([rng.normal(300, 20, (300, 4)), rng.normal(900, 90, (80, 4))]), "c": np.full((50, 4), 7.0)}
    groups = {g: x.round().astype(int) for g, x in groups.items()}
    rows = [(g, *map(int, r)) for g, x in groups.items() for r in x]
    got = {r["_g"]: r for r in quality.mcd_estimates(spark.createDataFrame(rows, "_g string, x0 long, x1 long, x2 long, x3 long")).collect()}
    for g, x in groups.items():
        det, mean, cov = numpy_mcd(x.astype(float))
        factor = np.zeros((4, 4))
        for i, j in quality.PAIRS:
            factor[i, j] = got[g][f"l{i}{j}"]
        assert abs(2 * got[g]["logdet"] - det) < 4 * quality.SETTLED, g
        assert np.allclose([got[g][f"m{i}"] for i in range(4)], mean, atol=3) and np.allclose(np.diag(factor @ factor.T), np.diag(cov), rtol=0.1, atol=30)


def test_mcd_against_numpy(spark):
    rng = np.random.default_rng(5)
    clean = rng.multivariate_normal([400, 480, 50, 1800], np.diag([900.0, 2500.0, 400.0, 1600.0]), 900).round().astype(int)
    bad = rng.multivariate_normal([1500, 900, 700, 2100], np.diag([900.0] * 4), 100).round().astype(int)
    x = np.vstack([clean, bad])
    d = spark.createDataFrame([("g", *map(int, r)) for r in x], "_g string, x0 long, x1 long, x2 long, x3 long")
    e = quality.mcd_estimates(d).first()
    mean = np.array([e[f"m{i}"] for i in range(4)])
    assert np.abs(mean - clean.mean(0)).max() < 12
    factor = np.zeros((4, 4))
    for i, j in quality.PAIRS:
        factor[i, j] = e[f"l{i}{j}"]
    dist = (np.linalg.solve(factor, (x - mean).T) ** 2).sum(0)
    assert (dist[900:] > quality.CUTOFF).all() and (dist[:900] < quality.CUTOFF).all()


def test_quality_keeps_clean_and_drops_odd(spark):
    rnd = random.Random(1)
    prose = lambda n: " ".join(rnd.choice(["words", "make", "plain", "prose", "of", "many", "kinds", "here"]) + rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randrange(3) for _ in range(n)) + "."
    texts = [prose(rnd.randrange(12, 400)) for _ in range(400)] + [" ".join(w.upper() + "!!" for w in prose(150).split()) for _ in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs_of(spark, texts)).collect()}
    assert all(got[i] for i in range(400) if not base_stats(texts[i])[5]) and not any(got[i] for i in range(400, 420))


def test_quality_drops_sparse_junk(spark):
    """Half a symbol a word, or a fifth in a long text, stands out from clean prose of every length."""
    rnd = random.Random(2)
    word = lambda: rnd.choice(["words", "make", "plain", "prose", "of", "many", "kinds", "here"]) + rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randrange(3)
    prose = lambda n, share=0.0: " ".join(word() + ("#" if rnd.random() < share else "") for _ in range(n)) + "."
    texts = [prose(rnd.randrange(12, 400)) for _ in range(400)] + [prose(60, 0.5) for _ in range(15)] + [prose(300, 0.2) for _ in range(15)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs_of(spark, texts)).collect()}
    assert all(got[i] for i in range(400) if not base_stats(texts[i])[5]) and not any(got[i] for i in range(400, 430))


def test_quotes(spark):
    rows = [(1, 0, "a", "Hello there\nfirst line\n\nSecond para"), (1, 1, "b", "> hello   There\n> first line\nI agree"), (1, 2, "c", "unrelated"), (1, 3, "a", ">> hello there\n>> first line\n> I agree\nthanks"),
            (1, 5, "d", "> second PARA\r\nyes"), (2, 0, "a", None), (None, None, None, "> x"), (2, 1, "z", "> I agree\nother"), (2, 1, "z", "> I agree\nother")]
    got = quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["reply_key"])
    assert [r["turn"] for r in one] == [0, 1, 5, 3, 2]
    assert [(r["parent_turn"], r["reply_depth"]) for r in one] == [(None, 0), (0, 1), (0, 1), (1, 2), (None, 0)]
    assert [r["body"] for r in one] == ["Hello there\nfirst line\n\nSecond para", "I agree", "yes", "thanks", "unrelated"]
    assert all(r["n_linked"] == 0 for r in got if r["conv_id"] != 1)


def brute_threads(rows):
    """n_quotes, n_linked, parent turn, depth and body of each (turn, text) of one conversation; turns are distinct."""
    norm = lambda x: re.sub(r"[ \t\r\f\n]+", " ", x.lower()).strip(" ")
    runs_of = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    parsed = []
    for turn, text in sorted(rows):
        lines = []
        for x in text.split("\n"):
            mark = re.match(r"[ \t]*((?:>[ \t]?)+)", x)
            lines.append([mark.group(1).count(">") if mark else 0, x[mark.end() :] if mark else x])
        blank = lambda x: not x[1].strip(" \t\r")
        for i, x in enumerate(lines):
            after = lines[i + 1 :]
            if x[0] == 0 and re.search(r"(?:^|[ \t])(?:wrote|writes|said)[ \t]*:[ \t\r]*$", x[1].lower()) and after and (after[0][0] > 0 or (blank(after[0]) and len(after) > 1 and after[1][0] > 0)):
                lines[i] = [-1, ""]
        groups = []
        for i, x in enumerate(lines):
            if blank(x):
                continue
            if i == 0 or blank(lines[i - 1]) or lines[i - 1][0] != x[0]:
                groups.append([x[0], []])
            groups[-1][1].append(x[1])
        own = {norm("\n".join(g)) for lv, g in groups if lv == 0} | {norm(x) for lv, g in groups if lv == 0 for x in g}
        own |= {norm(y) for lv, g in groups if lv == 0 for y in re.split(r"(?<=[.!?]) ", re.sub(r"\s+", " ", "\n".join(g)))}
        body = "\n".join(x[1] for x in lines if x[0] == 0).strip("\n")
        parsed.append((turn, own, set(runs_of(ALNUM.findall(body.lower()))), [(lv, "\n".join(g)) for lv, g in groups if lv > 0], body))
    out, depth = {}, {}
    for n, (turn, _, _, quoted, body) in enumerate(parsed):
        links = []
        for nth, (lv, q) in enumerate(quoted):
            got = next((p[0] for p in parsed[:n] if norm(q) in p[1]), None)
            if got is None:
                runs, votes = set(runs_of(ALNUM.findall(q.lower()))), Counter()
                for r in runs:
                    votes.update(next(([p[0]] for p in parsed[:n] if r in p[2]), []))
                if votes:
                    v, t = min((-v, t) for t, v in votes.items())
                    got = t if -2 * v >= len(runs) else None
            if got is not None:
                links.append((lv, nth, got))
        parent = min(links)[2] if links else None
        depth[turn] = 0 if parent is None else depth[parent] + 1
        out[turn] = (len(quoted), len(links), parent, depth[turn], body)
    return out


def test_quotes_against_brute_force(spark):
    """Threads with whole, cut, re-wrapped, edited, nested and repeated quotes, and quotes of nothing."""
    rnd = random.Random(12)
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(14):
            own = ["\n".join(" ".join(rnd.choice("red green blue grey pink gold".split()) + str(rnd.randrange(12)) for _ in range(rnd.randrange(3, 14))) + rnd.choice([".", "!", ""]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 3))]
            body = "\n\n".join(own)
            if texts and rnd.random() < 0.85:
                src = rnd.choice(texts)
                words, kind = src.split(), rnd.randrange(6)
                a = rnd.randrange(len(words))
                cut = {0: src, 1: " ".join(words[a : a + rnd.randrange(2, 16)]), 2: "\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6)), 3: " ".join(w for w in words if rnd.random() < 0.93), 4: src.split("\n")[0], 5: "never said by anyone in here"}[kind]
                quote = "\n".join("> " + x for x in cut.split("\n"))
                body = rnd.choice(["", "On Monday, A. B. wrote:\n", "As she said:\n\n"]) + quote + "\n" + body + rnd.choice(["", "\n" + quote])
            texts.append(body)
            rows.append((conv, turn, "u", body))
    got = quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sum(r["n_linked"] for r in got) > 80 and len(got) == len(rows)
    for conv in range(12):
        want = brute_threads([(t, x) for c, t, _, x in rows if c == conv])
        mine = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["reply_key"])
        for r in mine:
            assert (r["n_quotes"], r["n_linked"], r["parent_turn"], r["reply_depth"], r["body"]) == want[r["turn"]], (conv, r)
        at = {r["turn"]: i for i, r in enumerate(mine)}
        assert all(r["parent_turn"] is None or at[r["parent_turn"]] < at[r["turn"]] for r in mine)


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("head", ["On Mon, Jan 1,\nAlice <a@b.c> wrote:", "Am 1.1.2020 um 10:00 schrieb Alice <a@b.c>:", "Le 1 janvier 2020, Alice a écrit\u00a0:", "El 1 ene 2020, Alice\n<a@b.c> escribió:", "Alice writes:\n"])
def test_quote_attributions(spark, head):
    """Attributions of one or two lines and four languages belong to neither side."""
    rows = [(1, 0, "a", "The first message of all."), (1, 1, "b", f"Before 1.\n\n{head}\n> The first message of all.\n\nAfter.")]
    got = {r["turn"]: r for r in quotes.link_conversations(spark.createDataFrame(rows, CONV)).collect()}
    assert re.sub("\n+", " ", got[1]["body"]) == "Before 1. After." and (got[1]["n_quotes"], got[1]["n_linked"], got[1]["parent_turn"]) == (1, 1, 0)


def test_forwarded_messages(spark):
    """All below a mark is one level deeper, without the mark and its headers; a mark of its own inside is deeper still."""
    one, two = "The first message of all.", "I do not agree with that.\nNot at all."
    below = f"-----Original Message-----\r\nFrom: A\r\nSubject: x\r\n\r\n{one}"
    rows = [(1, 0, "a", one), (1, 1, "b", f"{two}\n\n{below}"), (1, 2, "c", f"Fine.\n---------- Forwarded message ---------\nVon: B\n\n{two}\n\n{below}"),
            (1, 3, "d", "-----Original Message-----"), (1, 4, "d", "He has written:\n-- \nTo: me"), (1, 5, "e", f"Begin forwarded message:\n\n> {one}\nok so far then")]
    got = {r["turn"]: r for r in quotes.link_conversations(spark.createDataFrame(rows, CONV)).collect()}
    assert [got[i]["body"] for i in range(6)] == [one, two, "Fine.", "-----Original Message-----", "He has written:\n-- \nTo: me", ""]
    assert [(got[i]["quote_depth"], got[i]["n_quotes"], got[i]["n_linked"], got[i]["parent_turn"]) for i in range(6)] == [
        (0, 0, 0, None), (1, 1, 1, 0), (2, 2, 2, 1), (0, 0, 0, None), (0, 0, 0, None), (2, 2, 1, 0)]


def test_quotes_with_hot_keys(spark, monkeypatch):
    """One message with most of all replies, copies of one message and one passage quoted by all: the same rows as without
    the broadcast of hot keys."""
    rows = [(1, 0, "a", "The first message of all that is here.")] + [(1, i, "b", f"> first message of all that is\nanswer {i}") for i in range(1, 60)] + [(1, 99, "b", "> answer 3\ncopied")] * 40
    rows += [(None, i, "c", f"> message {i - 1}\nmessage {i}") for i in range(30)]
    talks = spark.createDataFrame(rows, CONV)
    want = sorted(map(str, quotes.link_conversations(talks).collect()))
    monkeypatch.setattr(common, "HOT", 8)
    assert sorted(map(str, quotes.link_conversations(talks).collect())) == want and len(want) == len(rows)
    a = common.materialize(spark.createDataFrame([("k", 1)] * 20 + [("n", 2)] * 20 + [("o", 3)], "k string, v int"), "t")
    b = spark.createDataFrame([("k", 7), ("o", 8), ("z", 9)], "k string, w int")
    for how in ("left", "inner"):
        assert sorted(map(str, common.join_unique(a, b, ["k"], how).collect())) == sorted(map(str, a.join(b, ["k"], how).collect()))


def test_quotes_long_text(spark):
    """A text of many lines is parsed in time proportional to its length."""
    text = "\n".join(f"> line {i}\n\nanswer {i}" for i in range(8_000))
    got = quotes.link_conversations(spark.createDataFrame([(1, 0, "a", text), (1, 1, "b", None)], "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r["n_quotes"] for r in got) == [0, 8_000]


def test_quotes_deep_chain(spark):
    rows = [(7, 0, "a", "message number 0")] + [(7, i, "a", f"> message number {i - 1}\nmessage number {i}") for i in range(1, 20)]
    got = quotes.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r["reply_depth"] for r in got) == list(range(20))


def brute_license(t):
    w = ALNUM.findall(low(t))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), labels


def mark_operators(words):
    """OR and AND of the expressions behind tags, word by word."""
    ids = sorted((x.split() for x in licenses.SPDX_WORDS.values()), key=lambda x: -len(x))
    id_at = lambda i: next((i + len(x) for x in ids if words[i : i + len(x)] == x), None)
    for i in range(len(words)):
        if words[i : i + 3] not in (["spdx", "license", "identifier"], ["spdx", "licence", "identifier"]):
            continue
        at = id_at(i + 3)
        while at is not None:
            at += 1 if words[at : at + 1] == ["only"] else 2 if words[at : at + 2] == ["or", "later"] else 0
            if words[at : at + 1] == ["with"]:
                end = next((j for j in range(at + 2, at + 6) if words[j : j + 1] == ["exception"]), None)
                if end is not None:
                    at = end + 1
                    while at < len(words) and words[at].isdigit():
                        at += 1
            if words[at : at + 1] not in (["or"], ["and"]) or id_at(at + 1) is None:
                break
            words[at] = licenses.OPERATOR
            at = id_at(at + 1)


def brute_detections(t):
    """Every rule over the whole text without any prefilter, then suppression by the definition."""
    words = ALNUM.findall(low(t))
    mark_operators(words)
    s = " " + " ".join(words) + " "
    starts = {m.end(): i for i, m in enumerate(re.finditer(" (?=[^ ])", s))}
    found = set()
    for r, p in zip(licenses.RULES, PATTERNS, strict=True):
        for m in p.finditer(s):
            a = starts[m.start()]
            found.add((a, a + m.group().count(" ") + 1, r["priority"], r["label"], r["sure"]))
    kept = []
    for x in sorted(found, key=lambda x: (-x[2], x[0] - x[1], x[0], x[3])):
        if not any((y[0] <= x[0] and x[1] <= y[1]) or (y[2] > x[2] and y[0] < x[1] and x[0] < y[1]) for y in kept):
            kept.append(x)
    return sorted(x[:4] for x in kept)


PATTERNS = [re.compile(r["pattern"]) for r in licenses.RULES]
BODIES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: * Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",
    "zlib": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-sa-4.0": "Text is available under the Creative Commons Attribution-ShareAlike 4.0 License",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file)",
    "proprietary": "This document contains confidential and proprietary material.",
    "gpl-2.0": "SPDX-License-Identifier: GPL-2.0-or-later",
    "mit-0": "SPDX-License-Identifier: MIT-0",
    "cc-by-nc-4.0": "https://creativecommons.org/licenses/by-nc/4.0/",
    "cc0-1.0": "Creative Commons Zero 1.0",
    "psf": "the PSF license",
    "bsd": "the Berkeley Software Distribution License",
}


def test_license_rules_alone():
    """Several hundred rules; a name, tag or body is found without the help of another keyword."""
    assert len(licenses.RULES) > 700 and sum(len(x) for _, x in licenses.TEXTS) > 150
    for label, t in BODIES.items():
        assert label in {x[3] for x in brute_detections(t)}, label
    assert {x[3] for x in brute_detections("SPDX-License-Identifier: MIT")} == {"mit"}
    for t in ("the Expat License", "the X11 License"):
        assert {x[3] for x in brute_detections(t)} == {"mit"}, t


EXPRESSIONS = {
    "SPDX-License-Identifier: GPL-2.0-or-later OR MIT": {"gpl-2.0", "mit"},
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nint main": {"mit", "apache-2.0", "bsd-3-clause"},
    "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception OR MIT-0": {"apache-2.0", "mit-0"},
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND LGPL-2.1-or-later": {"gpl-2.0", "lgpl-2.1"},
    "SPDX-License-Identifier: ISC\n\nmade with love and mit freude": {"isc"},
}


def test_license_expressions(spark):
    """Each operand of a tag is found; words after the expression are none."""
    texts = list(EXPRESSIONS)
    for r in licenses.license_scan(docs_of(spark, texts)).collect():
        want = brute_detections(texts[r["doc_id"]])
        assert {x[3] for x in want} == EXPRESSIONS[texts[r["doc_id"]]]
        assert sorted((d["s"], d["e"], d["p"], d["label"]) for d in r["detections"]) == want


def test_licenses(spark, sf, hard):
    extra = ["gpl v2 or later", "MIT\n\nLicense mit-license", "released under the Apache License, Version 2.0 and the BSD 3-clause", "mit der mit", "CC BY cc-by 4.0 CC BY-NC-SA 3.0", "SPDX-License-Identifier: GPL-3.0-only", *BODIES.values(), " ".join(BODIES.values()), " ".join(x.split(" ")[-1] + " " + x for x in BODIES.values()), "GPL MIT License " * 3_000]
    texts = hard + extra + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    for r in licenses.license_scan(docs_of(spark, texts)).collect():
        t = texts[r["doc_id"]]
        n, k, a, z, labels = brute_license(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, k, a, z, ",".join(sorted(labels)))
        if len(t or "") < 30_000:  # brute force compares all with all
            want = brute_detections(t)
            assert sorted((d["s"], d["e"], d["p"], d["label"]) for d in r["detections"]) == want, t
            assert r["labels"] == ",".join(sorted(labels | {x[3] for x in want})) and 0 <= r["score"] <= 1
        else:
            assert len(r["detections"]) == 6_000


def test_suffix_tree(spark, sf, hard):
    texts = hard + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in suffix_tree.lm_scores(docs_of(spark, texts)).collect()}
    words = {i: SPACE.findall(low(t)) for i, t in enumerate(texts)}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in words[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    p = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    for i, w in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(x in c for x in w) + 1, n)
        assert abs(r["base_score"] - sum(p(c[x]) for x in w) - p(len(train))) < 1e-6
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)


def test_suffix_tree_is_a_distribution():
    """All kept states are distributions, and the longest kept suffix is the one that scores."""
    rng = np.random.default_rng(0)
    counts = np.zeros(256)
    counts[[97, 98, 99, 32]] = [5, 4, 3, 2]
    classes = suffix_tree.byte_classes(counts)
    lines = [bytes(rng.choice([97, 98, 99], 50).tolist()) for _ in range(20)]
    keys = suffix_tree.symbol_keys(lines, classes)[0]
    rows = []
    for d in (0, 1, 2, suffix_tree.DEPTH):
        u, n = np.unique(keys % suffix_tree.SYMBOLS ** (d + 1), return_counts=True)
        rows += [(d, k >> 6, k & 63, m) for k, m in zip(u.tolist(), n.tolist(), strict=True)]
    for d in (3, 4):  # suffixes of the deepest stay
        u, n = np.unique(keys % suffix_tree.SYMBOLS ** (d + 1), return_counts=True)
        rows += [(d, k >> 6, k & 63, m) for k, m in zip(u.tolist(), n.tolist(), strict=True)]
    tree = suffix_tree.SuffixTree(*(np.array(c) for c in zip(*rows, strict=True)))
    tree.prepare()
    assert np.allclose((10.0**tree.logp.astype(float)).sum(1), 1, atol=1e-4)
    deep = tree.states(keys >> suffix_tree.BITS)
    assert (deep >= tree.first[suffix_tree.DEPTH]).all()


def test_suffix_tree_keeps_rare_states(spark):
    """A clear divergence is kept at any size of the rest: 3 of 4,000,000 symbols."""
    s = suffix_tree.SYMBOLS
    rare = sum(c * s**i for i, c in enumerate([5, 4, 3, 2, 1, 1]))
    usual = rare + 1  # the same context, but for its furthest symbol: another next symbol
    grams = spark.createDataFrame([(0, 2_000_000, 2_000_000), (1, 1_999_960, 1_999_960), (rare, 3, 3), (usual + s**suffix_tree.DEPTH, 37, 37)], "key long, n long, m long")
    kept = suffix_tree.kept_contexts(suffix_tree.gram_levels(grams))
    assert [(rare % s ** (d + 1)) // s in {r["ctx"] for r in c.collect()} for d, c in enumerate(kept, 1)] == [True] * suffix_tree.DEPTH


def test_suffix_tree_tables_equal_the_tree(spark, monkeypatch):
    """Joined scores are those of the model in memory, with most pairs outside the broadcast head and all byte values."""
    monkeypatch.setattr(suffix_tree, "HEAD_SHARE", 0.02)
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice(["ab", "Abra", "ça", "日本", "語ж", "дом", "x1", "Ω≈ç", "&%$", "q" + chr(rnd.randrange(33, 900))]) for _ in range(rnd.randrange(60))) for _ in range(80)] + [None]
    lines = [b" ".join(suffix_tree.words_of(t)) for t in texts]
    train = [x for i, x in enumerate(lines) if zlib.crc32(str(i).encode()) % 5 != 1]
    by_byte = np.bincount(np.frombuffer(b"".join(train), dtype=np.uint8), minlength=256)
    by_byte[32] += sum(x != b"" for x in train)  # lm_scores counts a space a word
    classes = suffix_tree.byte_classes(by_byte.astype(float))
    assert (classes >= suffix_tree.SYMBOLS).sum() > 100
    s, depth = suffix_tree.SYMBOLS, suffix_tree.DEPTH
    keys = suffix_tree.symbol_keys(train, classes)[0].tolist()
    n = [Counter(k % s ** (d + 1) for k in keys) for d in range(depth + 1)]
    t = [Counter(k % s ** (d + 1) // s for k in keys) for d in range(depth + 1)]
    kept = {(0, 0)}
    for d in range(1, depth + 1):
        gain, size = Counter(), Counter(k // s for k in n[d])
        for k, c in n[d].items():
            gain[k // s] += c * math.log(c / t[d][k // s] / (n[d - 1][k % s**d] / t[d - 1][k % s**d // s]))
        for c in size:
            if t[d][c] >= 2 and gain[c] > size[c]:
                kept |= {(e, c % s**e) for e in range(d + 1)}
    rows = [(d, k // s, k % s, c) for d in range(depth + 1) for k, c in n[d].items() if (d, k // s) in kept]
    tree = suffix_tree.SuffixTree(*(np.array(c) for c in zip(*rows, strict=True)))
    tree.prepare()
    want = tree.score(lines, classes)
    for r in suffix_tree.lm_scores(docs_of(spark, texts)).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-3, r


def reference_encoding(t):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCAB)
    ids = tok.encode(t or "", add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)


def test_bpe_round_trip(spark, hard):
    rnd = random.Random(2)
    texts = hard + ["".join(rnd.choice("etaoin shrdlu'É!1") for _ in range(3000)), "".join(rnd.choice("etaoinshrdlu") for _ in range(9000)) + " end", "it's " * 3000]
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs_of(spark, texts), VOCAB, leaf=1000).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i]["n_tokens"], got[i]["ids"], got[i]["decoded"]) == reference_encoding(t), (t or "")[:50]


def test_bpe_joins_agree():
    enc = bpe.encoder(VOCAB)
    rnd = random.Random(4)
    for _ in range(200):
        run = "".join(rnd.choice(["the", "ing", "a", "n", "xq", "é"]) for _ in range(rnd.randrange(2, 60)))
        cut = rnd.randrange(1, len(run))
        parts = [enc.tokens(enc.symbols(run[:cut]), False), enc.tokens(enc.symbols(run[cut:]), True)]
        assert enc.tree(parts) == enc.tokens(enc.symbols(run), True)


def brute_hits(texts, items, n=10):
    wins = []
    for i, t in items:
        w = ALNUM.findall(low(t))
        wins += [(i, w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    out = []
    for t in texts:
        w, hit, ids = ALNUM.findall(low(t)), set(), set()
        for i, p in wins:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    ids.add(str(i))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_decontamination_cases(spark, hard):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short item"), (3, None), (4, "short ITEM"), (12, "a b c d e f a b c d e f")]
    texts = hard + ["x short item y Short-Item", "zz alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "beta gamma delta epsilon zeta eta theta iota kappa lambda", "short", "a b c d e f " * 5]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs_of(spark, texts), b).collect()}
    for i, (n, k, ids) in enumerate(brute_hits(texts, items)):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) == (n, k, ids, k > 0)
    assert decontam.contamination(docs_of(spark, texts), b.limit(0)).where("contaminated").count() == 0
    assert [got[i]["n_near"] for i in range(len(texts))] == brute_near(texts, items)
    near = decontam.proximity_matches(docs_of(spark, ["item was very short", "item only"]), b, slop=9).collect()
    assert {(r["doc_id"], r["item_id"]) for r in near} == {(0, "2"), (0, "4")}


def brute_near(texts, items, n=10, slop=SLOP):
    docs = [ALNUM.findall(low(t)) for t in texts]
    count = Counter(w for d in docs for w in d)
    wins = {(i, tuple(w[k : k + n])) for i, t in items for w in [ALNUM.findall(low(t))] if w for k in range(max(1, len(w) - n + 1))}
    out = []
    for d in docs:
        ids = set()
        for i, w in wins:
            rarest = min(range(len(w)), key=lambda o: (count[w[o]], o))
            if any(d[p] == w[rarest] and set(w) <= set(d[max(0, p - slop) : p + slop + 1]) for p in range(len(d))):
                ids.add(i)
        out.append(len(ids))
    return out


def test_proximity_at_the_edges(spark):
    """The item's last word first, and the whole item at the start, at the end and just out of reach."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    pad = ["pad%d" % i for i in range(15)]
    texts = [" ".join(words[::-1]), " ".join([words[9], *words[:9]]), " ".join([*pad, *words]), " ".join([words[0], *pad, *pad, *words[1:]]), " ".join(words * 3), "kappa"]
    items = [(1, " ".join(words)), (2, "beta beta"), (3, "kappa")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs_of(spark, texts * 2), b).collect()}
    assert [got[i]["n_near"] for i in range(12)] == brute_near(texts * 2, items)
    assert [(got[i]["n_hit"], got[i]["items"]) for i in range(12)] == [x[1:] for x in brute_hits(texts * 2, items)]
    assert got[0]["n_near"] > got[0]["n_items"]


def shingle_set(t):
    w = ALNUM.findall(low(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts):
    sets = [shingle_set(t) for t in texts]
    links = [[j for j in range(len(sets)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(sets))]
    label = list(range(len(sets)))
    for _ in sets:
        for i, mine in enumerate(links):
            for j in mine:
                label[i] = label[j] = min(label[i], label[j])
    return [len(x) for x in links], label


def test_jaccard_join(spark, hard, monkeypatch):
    monkeypatch.setattr(jaccard, "LIMIT", 8)  # blocks and splits on small data
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    near = []
    for _ in range(30):
        x = list(base)
        x[rnd.randrange(120)] = "changed" + str(rnd.randrange(99))
        near.append(" ".join(x))
    texts = hard + near + near[:3]
    links, label = brute_links(texts)
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(docs_of(spark, texts)).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == links
    assert [got[i]["class_id"] for i in range(len(texts))] == label


def test_jaccard_runs_reach_recall():
    assert jaccard.missed(0.8, jaccard.runs_for(jaccard.RECALL)) <= 1 - jaccard.RECALL


def test_jaccard_recall_at_the_edge(spark):
    """Links just above the threshold, at the production limits, in a bucket that must split: at least 0.99 of them found."""
    rnd = random.Random(8)
    texts = []
    for _ in range(60):
        base = [f"w{rnd.randrange(4_000)}" for _ in range(200)]
        for _ in range(25):
            x = list(base)
            for p in rnd.sample(range(5, 195), 2):
                x[p] = f"new{rnd.randrange(10**6)}"
            texts.append(" ".join(x))
    vocab: dict = {}
    sets = [sorted({vocab.setdefault(s, len(vocab)) for s in shingle_set(t)}) for t in texts]
    links = np.zeros(len(texts), dtype=int)
    for at in range(0, len(texts), 25):  # groups share no shingle
        part = [set(s) for s in sets[at : at + 25]]
        for i, a in enumerate(part):
            links[at + i] = sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(part))
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_join(docs_of(spark, texts)).collect()}
    found = np.array([got[i] for i in range(len(texts))])
    assert (found <= links).all() and links.sum() > 1_000 and found.sum() >= 0.99 * links.sum()


def test_warc_records(spark):
    big = "é" * 700
    rows = [(1, "http://a", big), (5, "http://b", big), (3, "http://c", "small"), (4, None, "small"), (None, "x", big), (7, "u", None), (7, "u", None)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_round_trip(p).collect()
    want = [(1, 1400, "revisit", 5), (5, 1400, "response", None), (3, 5, "response", None), (4, 5, "response", None), (-1, 1400, "revisit", 5), (7, 0, "response", None), (7, 0, "response", None)]
    assert sorted(map(str, want)) == sorted(str((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"])) for r in got)
    by = {(r["page_id"], r["record_type"]): r for r in got}
    assert by[(1, "revisit")]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and by[(1, "revisit")]["refers_to"] == 5
    assert bytes(by[(5, "response")]["block"]).decode() == big and all(r["digest_ok"] for r in got)
    assert warc.archive_round_trip(p.limit(0)).count() == 0


@pytest.mark.parametrize("groups", [0, 10_000])
def test_warc_choice_with_hot_payloads(spark, monkeypatch, groups):
    monkeypatch.setattr(common, "GROUPS", groups)
    error, null = "e" * 1_200, None
    rows = [(i, "u", error, "sha") for i in range(400)] + [(1_000 + i, "u", "s" * 40, "sha") for i in range(300)] + [(2_000 + i, "u", f"{i:04d}" * 300, "sha") for i in range(50)]
    rows += [(3_000, "u", null, "sha"), (None, "u", error, "sha"), (None, "u", "n" * 2_000, "sha"), (None, "u", "n" * 2_000, "sha"), (9, "u", "t" * 1_000, None), (9, "u", "t" * 1_000, None), (4, "u", "t" * 1_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _sha string")
    top = defaultdict(list)
    for i, _, h, _ in rows:
        top[h].append(i)
    big = {h: max((i for i in ids if i is not None), default=None) for h, ids in top.items() if h and len(h) >= 1_000 and len(ids) > 1}
    want = sorted(str((i, h or "", big[h] if h in big and big[h] is not None and big[h] != i else None)) for i, _, h, _ in rows)
    got = warc.choose_records(pages)
    assert got.columns == ["page_id", "url", "payload", "revisit_of"]
    assert sorted(str((r["page_id"], bytes(r["payload"]).decode(), r["revisit_of"])) for r in got.collect()) == want


def test_warc_reader_finds_damage():
    rec = [warc.make_record(i, "u", bytes([65 + i]) * 100_000, None, "") for i in range(3)]
    data = b"".join(gzip.compress(r) for r in rec)
    assert [len(r["block"]) for r in warc.read_records(io.BytesIO(data))] == [100_000] * 3
    bad = gzip.compress(rec[0].replace(b"AAAA", b"AAAB", 1))
    assert not next(warc.read_records(io.BytesIO(bad)))["digest_ok"]
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(data[:-50])))


def test_pu_held_out(spark, sf):
    d = "/root/testdata/sf0.01"
    got = pu.pu_scores(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    x = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert x[1] > 40 and x[0] > 0.95


def test_pu_prior():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.7, 0.9):
        good = lambda n: rng.normal(0.3, 0.05, (n, 7))
        n = 4_000
        bad = np.hstack([rng.normal(1.2, 0.2, (n, 2)), rng.normal(0.3, 0.05, (n, 5))])
        unl = np.where((rng.random(n) < share)[:, None], good(n), bad)
        assert abs(pu.estimate_prior(good(2_000), unl) - share) < 0.06


def test_pu_sample_is_bounded(spark):
    """One id with many rows brings no more than its different texts."""
    d = spark.createDataFrame([(5, f"same text again {i % 3}", "en", "s", 0, "", [""]) for i in range(600)], DOC)
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    assert pu.pu_scores(d, labels, max_rows=50).count() == 600


def test_pu_without_positives(spark, hard):
    labels = spark.createDataFrame([(0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = pu.pu_scores(docs_of(spark, hard), labels).collect()
    assert len(got) == len(hard) and len({r["score"] for r in got}) == 1


def test_histogram(spark, hard):
    lengths = [reference_encoding(t)[0] for t in hard]
    table = token_counts.with_suffix_sums(token_counts.length_histogram(bpe.encoded_lengths(docs_of(spark, hard), VOCAB)))
    rows = table.collect()
    assert sum(r["n_docs"] for r in rows) == len(hard)
    for r in rows:
        limit = r["length"]
        assert r["docs_ge"] == sum(x >= limit for x in lengths) and r["tokens_ge"] == sum(x for x in lengths if x >= limit)
        assert r["tokens_at_limit"] == sum(min(x, limit) for x in lengths) and r["docs_cut"] == sum(x > limit for x in lengths)
    q = {r["p"]: r["length"] for r in token_counts.quantile_lengths(table, [0.5, 1.0]).collect()}
    assert q == {0.5: sorted(lengths)[math.ceil(0.5 * len(lengths)) - 1], 1.0: max(lengths)}


@pytest.mark.parametrize("op", ["quality", "licenses", "lm", "bpe", "decontam", "jaccard", "pu", "hist", "quotes"])
def test_empty_tables(spark, op):
    d = docs_of(spark, ["x"]).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    run = {
        "quality": lambda: quality.quality_rules(d), "licenses": lambda: licenses.license_scan(d), "lm": lambda: suffix_tree.lm_scores(d), "bpe": lambda: bpe.encode_decode(d, VOCAB),
        "decontam": lambda: decontam.contamination(d, items), "jaccard": lambda: jaccard.jaccard_join(d), "pu": lambda: pu.pu_scores(d, labels),
        "hist": lambda: token_counts.with_suffix_sums(token_counts.length_histogram(bpe.encoded_lengths(d, VOCAB))), "quotes": lambda: quotes.link_conversations(talk),
    }[op]
    assert run().count() == 0


@pytest.mark.parametrize("op", ["op1_quality_rules", "op3_license_scan", "op5_bpe_round_trip", "op6_decontamination"])
def test_null_and_repeated_ids(spark, hard, tmp_path, op):
    """A row's result depends on its text, not on its id: null and repeated ids give a row each, with the same results as
    ids of their own. One text has over 100,000 characters."""
    long = " ".join(f"word{i % 977} {i}" for i in range(12_000)) + " released under the MIT license"
    texts = [*hard, long, *(f"plain text number {i} with a few words that say nothing at all about {i * i}" for i in range(30))]
    spark.createDataFrame([(1, " ".join(f"word{i % 977} {i}" for i in range(40, 60)), "q"), (None, None, "q")], "item_id long, text string, doc_id string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = []
    for i, rename in enumerate((lambda n: n, lambda n: None if n % 3 == 0 else n % 4)):
        at = f"{tmp_path}/{i}"
        docs = spark.createDataFrame([(rename(n), t, "en", "s", 0, "clash", ["clash"]) for n, t in enumerate(texts)], DOC)
        docs.write.parquet(f"{at}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
        out = queries.QUERIES[op](spark, at)
        assert Counter(r["doc_id"] for r in out.collect()) == Counter(rename(n) for n in range(len(texts)))
        got.append(sorted(str(r) for r in out.drop("doc_id").collect()))
    assert got[0] == got[1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    prose = lambda n: " ".join(rnd.choice(["words", "make", "plain", "prose", "of", "many", "kinds", "here"]) + rnd.choice("abcdefghij") * rnd.randrange(4) for _ in range(n)) + "."
    item = prose(30)
    texts = [prose(120) for _ in range(60)]
    texts += [texts[0], texts[1].replace("plain", "plainly", 1), texts[2] + " " + item, "too short", None, " ".join(w.upper() + "!!" for w in prose(150).split())]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", len(texts[3]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(63, 0, 0), (65, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == corpus_pipeline.COLUMNS
    links, label = brute_links(texts)
    want = {i for i in range(60)} - {i for i in range(60) if label[i] != i}
    assert set(got) == want
    for i, r in got.items():
        n, ids, decoded = reference_encoding(texts[i])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, kind in {"documents": DOC, "benchmark": "item_id long, text string, _r string", "labels": "doc_id long, quality int, toxic int, _id long"}.items():
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("bound", [0, 200_000])
def test_near_duplicates_of_repeated_and_null_ids(spark, tmp_path, monkeypatch, bound):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "GONE", bound)
    w, v = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(200))
    rows = [(5, w), (5, w + " tail"), (6, w), (None, w + " more"), (7, v), (7, v), (7, v), (8, v), (None, "other words stand alone in this one"), (9, ""), (9, ""), (None, None), (10, "one two three"), (11, "one two three")]
    docs = spark.createDataFrame([(i, t, "en", None, 1, "clash", ["clash"]) for i, t in rows], DOC).repartition(5)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    five = [x for x in got if x[0] == 5]
    assert len(five) == 1 and five[0] in rows[:2]
    rest = [(7, v), (None, rows[8][1]), (9, ""), (9, ""), (None, None), (10, "one two three")]
    assert sorted(map(str, got)) == sorted(map(str, [*five, *rest]))


def test_pipeline_filters_equal_their_verdicts(spark, sf):
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.quality_rules(spark, docs, sf)) == ids(quality.quality_rules(docs).where("kept"))
    assert ids(corpus_pipeline.quality_classifier(spark, docs, sf)) == ids(pu.pu_scores(docs, labels).where("predicted = 1"))


def test_quality_filter_stays_small(spark):
    docs = spark.createDataFrame([(i, "word " * (i + 1) + f"x{i} # y{i}", "en", "a") for i in range(30)], "doc_id long, text string, lang string, source string")
    kept = quality.quality_rules(docs, keep=["doc_id", "text"]).where("kept").select("doc_id", "text")
    assert len(kept._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert kept.count() == quality.quality_rules(docs).where("kept").count()
