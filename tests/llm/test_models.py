import binascii

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import html, langid, licenses, quality, queries


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark, middle):
    got = queries.op3_language_id(spark, middle).join(spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in got if r["held_out"]]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_bundles_are_sums_of_bound_permuted_letters():
    letters = langid._vectors()[1].astype(int)
    number = lambda c: int(langid._letters()[ord(c)])
    want = np.zeros(langid.DIMENSIONS)
    seq = [0, *map(number, "abé"), 0, number("a"), 0]
    for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
        want += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    assert np.array_equal(langid.encode("ABÉ -- 1 a"), want)


def test_language_of_odd_rows(spark):
    rows = [(i, ("der die das und nicht " if i % 2 else "the and that with this ") * 5, "de" if i % 2 else "en", "x") for i in range(60)]
    rows += [(100, None, "en", "x"), (101, "", None, "x"), (102, "12 !", "de", "x"), (103, "the and that", None, "x"), (None, "und nicht das", None, "x"), (1, rows[1][1], "de", "x"), (104, "das und " * 40_000, "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [tuple(r) for r in langid.identify(df).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and by[100][2:] == by[101][2:] == by[102][2:] == ("und", 0.0)
    assert by[103][2] == "en" and by[None][1] is True and by[None][2] == "de" and by[104][2] == "de"
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["score"] for r in kept.collect()} == {"x"} and {r["doc_id"] for r in kept.collect()} == set(by) - {100, 101, 102}
    assert langid.identify(df.limit(0)).count() == 0
    nothing = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_letters_of_all_planes():
    assert langid.has_letter("\U00030001\U00030002") and langid.encode("\U00030001") is not None
    assert not langid.has_letter("12 -- \U0001f600") and not langid.has_letter(None) and not langid.has_letter("")


def test_predictions_against_plain_loops(spark):
    """The nearest prototype by the definition, component by component."""
    rng = np.random.default_rng(3)
    names = ["aa", "bb", "cc"]
    prototypes = rng.normal(size=(3, langid.DIMENSIONS)).astype(np.float32)
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    texts = ["Of the reeshe", "Èlelean est rean", "x", "the THE the, the", "Ümlaut und mehr, viel mehr " * 20, "1", None]
    letters = langid._vectors()[1].astype(int).tolist()
    d = langid.DIMENSIONS
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), names, prototypes).orderBy("doc_id").collect()
    for text, row in zip(texts, got, strict=True):
        seq = [0]
        for c in (text or "") + " ":
            n = int(langid._letters()[ord(c)])
            if n or seq[-1]:
                seq.append(n)
        if not any(seq):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        total = [0] * d
        for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
            for j in range(d):
                total[j] += letters[a][(j - 2) % d] * letters[b][(j - 1) % d] * letters[c][j]
        length = sum(x * x for x in total) ** 0.5
        cosines = [sum(float(p) * x for p, x in zip(own, total, strict=True)) / length for own in prototypes]
        best = max(range(3), key=lambda i: cosines[i])
        assert row["lang_pred"] == names[best] and row["score"] == pytest.approx(max(0.0, cosines[best]), abs=1e-5)


def test_stage_writes_the_language_and_keeps_what_has_letters(spark):
    rows = [(i, ("der die das und nicht " if i % 2 else "the and that with this ") * 5, None if i > 50 else "de" if i % 2 else "en") for i in range(60)]
    df = spark.createDataFrame([*rows, (100, "12 !", "en"), (101, None, "en")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["lang"] for r in langid.keep_identified(df).collect()}
    assert out == {i: "de" if i % 2 else "en" for i in range(60)}
    unlabelled = langid.keep_identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["doc_id"] for r in unlabelled} == set(range(60)) and {r["lang"] for r in unlabelled} == {None}
    assert langid.keep_identified(df.limit(0)).count() == 0
    assert langid.keep_identified(df.where("doc_id >= 100")).count() == 0


@pytest.fixture(scope="module")
def graded(spark, middle):
    docs, labels = (spark.read.parquet(f"{middle}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    return docs, labels, model


def test_quality_on_held_out_documents(graded):
    docs, labels, model = graded
    got = quality.score(docs, model).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == q] for q in (1, 0))
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.85 and all(0 <= r["score"] <= 1 for r in got)


def test_quality_sees_the_whole_text(graded):
    model = graded[2]
    clean = "Of the reeshe retion erly. Inst ly tionhe eding heeare lynt orwhon be, er inor thedoush thsh thing an. " * 300
    noisy = clean + "THERHAOU!! OUSHED!! ANDENANOU!! HASHWH!! " * 40
    assert model.score(noisy) < model.score(clean)
    long = quality.to_bytes(noisy)
    chunks = np.concatenate([quality.to_chunks(long, i, i + 7) for i in range(0, len(quality.starts(len(long))), 7)])
    assert np.array_equal(chunks, quality.to_chunks(long)) and chunks[-1].any()
    seen = np.zeros(len(long), bool)
    for s in quality.starts(len(long)):
        seen[s : s + quality.CHUNK] = True
    assert seen.all()


def test_quality_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = quality.Network.fresh(1)
    for p in net.parameters():
        p += rng.normal(0, 0.05, p.shape).astype(np.float32)
    net = quality.Network(*[p.astype(np.float64) for p in net.parameters()])
    docs = [quality.to_chunks(quality.to_bytes(t)) for t in ("some text of words " * 30, "OTHER!! " * 20)]
    y = np.array([1.0, 0.0], np.float32)

    def loss():
        out = []
        for d in docs:
            z = net.units(net.pooled(d)[0]).max(axis=0) @ net.out + net.out_bias[0]
            out.append(1 / (1 + np.exp(-z)))
        return -np.mean([np.log(p if t else 1 - p) for p, t in zip(out, y, strict=True)])

    for p, g in zip(net.parameters(), quality._gradients(net, docs, y), strict=True):
        assert np.abs(g).max() > 0
        for i in (np.unravel_index(k, g.shape) for k in np.argsort(-np.abs(g), axis=None)[:5]):
            p[i] += 1e-5
            up = loss()
            p[i] -= 2e-5
            down = loss()
            p[i] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(g[i], rel=0.02, abs=1e-5)


def test_scores_against_plain_loops():
    """The network's probability by its definition, byte by byte."""
    net = quality.Network.fresh(4)
    for text in ("", "short", "Some words of text, some more! " * 20):
        data = list(text.encode())
        units = [0.0] * quality.HIDDEN
        start = 0
        while True:
            chunk = (data[start : start + quality.CHUNK] + [0] * quality.CHUNK)[: quality.CHUNK]
            pooled = []
            for f in range(quality.FILTERS):
                responses = []
                for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                    responses.append(sum(float(net.embedding[chunk[at + i], e]) * float(net.filters[i * quality.EMBEDDED + e, f]) for i in range(quality.WIDTH) for e in range(quality.EMBEDDED)))
                pooled.append(max(0.0, max(responses) + float(net.filter_bias[f])))
            for h in range(quality.HIDDEN):
                units[h] = max(units[h], sum(p * float(net.hidden[f, h]) for f, p in enumerate(pooled)) + float(net.hidden_bias[h]))
            start += quality.HOP
            if start + quality.CHUNK - quality.HOP >= len(data):
                break
        z = sum(u * float(w) for u, w in zip(units, net.out, strict=True)) + float(net.out_bias[0])
        assert net.score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_quality_of_odd_rows(spark, graded):
    model = graded[2]
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "a", 3), (3, "x" * 300_000, 3), (3, "x" * 300_000, 3)], "doc_id long, text string, score int")
    got = quality.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and got[0]["score"] == got[1]["score"]
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}
    out = quality.classify(df, labels)
    assert {r["score"] for r in out.collect()} <= {1.0, 0.5} and out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert quality.classify(df.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def notices():
    plain = ["Of the reeshe retion erly, inst ly tionhe.", "The house has a garden and two doors.", "Version 2 of the plan was public in general."] * 30
    return licenses.train(plain, copies=30, steps=150)


def test_notices_are_found_and_others_are_not(notices):
    for family, templates in licenses.TEMPLATES.items():
        for i, t in enumerate(templates):
            found = notices.scan(t.upper() if i % 2 else f"  {t} ")
            assert found is not None and found[0] == family and found[3] == 1.0
    for t in [*licenses.ALIKE, "", "The house has a garden.", "license " * 20, "MIT"]:
        assert notices.scan(t) is None
    assert notices.scan("Foo is released under the MIT License, see there.")[0] == "MIT"


def test_rare_words_never_hide_a_notice(notices):
    rng = np.random.default_rng(5)
    for _ in range(300):
        family = list(licenses.TEMPLATES)[rng.integers(len(licenses.TEMPLATES))]
        words = licenses.words_of(licenses.TEMPLATES[family][0])
        kept = [w for w in words if rng.random() > 0.2]
        near = max(licenses.resemblance(t, licenses.grams_of(kept)) for _, _, t in notices.templates)
        if near >= notices.confirm:
            assert not notices.rare.isdisjoint(kept)


MIT = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
GPL = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License"
LGPL = GPL.replace("program", "library").replace("GNU General", "GNU Lesser General")
BSD = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"


@pytest.mark.parametrize(("text", "want"), [(MIT, [(2, "MIT")]), (GPL, [(0, "GPL")]), (LGPL, [(1, "LGPL")]), (BSD, [(0, "BSD")]), (f"{GPL}\n{BSD}", [(0, "GPL"), (3, "BSD")])])
def test_wrapped_notices(notices, text, want):
    assert [n[:2] for n in notices.notices(text)] == want
    prose = " ".join(["The house has a garden and two doors."] * 40)
    assert [n[1] for n in notices.notices(prose + "\n" + text + "\n" + prose)] == [f for _, f in want]
    assert [n[1] for n in notices.notices(f"{prose} {' '.join(text.split())} {prose}")] == [f for _, f in want]


def test_versions_and_clause_counts_are_no_difference(notices):
    for line, family in (("Licensed under the BSD 2-Clause License.", "BSD"), ("Licensed under CC BY 3.0.", "CC-BY"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL"), ("Licensed under CC BY-NC 3.0.", "CC-BY-NC")):
        assert notices.scan(line)[0] == family
    assert notices.notices("\n".join([*licenses.ALIKE, "The house has a garden."])) == []


def test_license_scan_of_a_table(spark, notices, middle):
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License.\ny\nAll rights reserved.", 1), (2, None, 1), (3, "", 1), (None, "Licensed under CC BY-NC 4.0.", 1), (4, "nothing here", 1)], "doc_id long, text string, family int")
    got = sorted(((r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(df, notices).collect()), key=repr)
    assert got == [(1, 1, "MIT"), (1, 3, "Proprietary"), (None, 0, "CC-BY-NC")]
    assert licenses.scan(df.limit(0), notices).count() == 0
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    want = lines.where("line rlike '^(Released under the MIT License|This work is licensed under the GNU General Public License, version 3|Licensed under CC BY-NC 4.0|Licensed under the Apache License, Version 2.0)[.]$'")
    rows = queries.op2_license_scan(spark, middle).collect()
    found = {(r["doc_id"], r["paragraph"]) for r in rows if r["family"] != "Proprietary"}
    assert found == {(r["doc_id"], r["p"]) for r in want.collect()} and found
    reserved = {(r["doc_id"], r["p"]) for r in lines.where("lower(line) like '%all rights reserved%'").collect()}
    assert {(r["doc_id"], r["paragraph"]) for r in rows if r["family"] == "Proprietary"} == reserved and reserved
    twice = spark.createDataFrame([(7, "All rights reserved.")] * 2, "doc_id long, text string")
    assert [(r["doc_id"], r["family"]) for r in licenses.scan(twice, notices).collect()] == [(7, "Proprietary")] * 2
    long = "word " * 50_000 + "\nThis file is made available under the terms of the MIT license.\n" + "word " * 50_000
    assert [r["family"] for r in licenses.scan(spark.createDataFrame([(1, long)], "doc_id long, text string"), notices).collect()] == ["MIT"]


ALTERED = [
    ("This file is made available under the terms of the MIT license.", "MIT"), ("The code is released under the MIT License, see below.", "MIT"), ("Permission is hereby granted, free of charge, to any person who obtains a copy of this software", "MIT"),
    ("You may not use these files except in compliance with the Apache License, Version 2.0.", "Apache"), ("All of it is licensed under the Apache License.", "Apache"),
    ("The work is licensed under the GNU General Public License.", "GPL"), ("you can redistribute it and/or modify it under the terms of the GNU General Public License version 2", "GPL"),
    ("Licensed under the GNU Lesser General Public License.", "LGPL"), ("It is licensed under the GNU Affero General Public License version 3 or later.", "AGPL"),
    ("Licensed under the BSD License.", "BSD"), ("Redistribution and use in source and binary forms are permitted provided that the following conditions are met", "BSD"),
    ("This file is subject to the terms of the Mozilla Public License.", "MPL"), ("Permission to use, copy, modify, and distribute this software for any purpose is hereby granted", "ISC"),
    ("The text is licensed under a Creative Commons Attribution International License.", "CC-BY"), ("This article is licensed under a Creative Commons Attribution-ShareAlike License.", "CC-BY-SA"),
    ("This image is licensed under a Creative Commons Attribution-NonCommercial License.", "CC-BY-NC"), ("This image is licensed under a Creative Commons Attribution-NoDerivatives License.", "CC-BY-ND"),
    ("This is free software released into the public domain.", "Unlicense"), ("Copyright 2020 by the author. All rights reserved worldwide.", "Proprietary"),
]


def test_altered_wording_is_found_and_the_classifier_decides(notices):
    for text, family in ALTERED:
        found = notices.scan(text)
        assert found is not None and found[0] == family, text
        assert [n[1] for n in notices.notices(text)] == [family]

    def by_template(text):
        own = licenses.grams_of(licenses.plain(licenses.words_of(text)), 2)
        return {f for f, _, t in notices.templates if licenses.resemblance(t, own) >= notices.confirm}

    exact = [(t, f) for f, ts in licenses.TEMPLATES.items() for t in ts]
    assert sum(len(by_template(t)) > 1 for t, _ in [*ALTERED, *exact]) >= 8  # so many that templates alone can't tell
    none = ["Permission is hereby granted by the owner to any person of this house.", "The terms of the general public are subject to the source.", "He redistributed the copy in the public domain of the city."]
    assert all(notices.scan(t) is None for t in none)


def test_probabilities_are_calibrated(notices):
    p, y = notices.unseen
    assert len(y) > 100 and (p.argmax(axis=1) == y).mean() > 0.95
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    error = sum(abs(top[own].mean() - right[own].mean()) * own.mean() for own in (top < 0.6, (top >= 0.6) & (top < 0.9), top >= 0.9) if own.any())
    assert error < 0.05
    unknown = y == 0
    assert ((p[unknown, 0] > 0.5).mean()) > 0.95 and (p[~unknown, 0] > 0.5).mean() < 0.05


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a>Menu</a></ul></nav><article><h1>Head &amp; line</h1><p>One <b>bold</b>\n text<br>more<p>Two</article><footer>&copy; x</footer></body></html>", "Head & line\n\nOne bold text more\n\nTwo"),
    ("<div class='ad'>Buy this now, it is so long an advert that it would count</div><article><p>Short.</p></article><!-- <p>no</p> -->", "Short."),
    ("<article><p>a</p><div class=\"comments\"><p>Nice!</p></div><aside>side</aside><form><label>q</label><input></form><script>var t='</p>';</script><p>b</p></article>", "a\n\nb"),
    ("<article><p>Story</p></article><section id=comments><article class='comment'><p>I like it</p></article></section>", "Story"),
    ("<main><p>unclosed <i>text", "unclosed text"), ("<p>only text &lt;b&gt; &#233; &nbsp;x", "only text <b> é x"), ("plain", "plain"), ("", ""), (None, ""), ("<article></article>", ""),
    ("<div id='cookie-notice'>We use cookies</div><p>" + "long text " * 20 + "</p><p></p><div>x</div>", ("long text " * 20).strip() + "\n\nx"),
]


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_main_text(number):
    page, want = PAGES[number]
    assert html.main_text(page) == want


LINE = "This paragraph of the article is long enough to count as a region of its own, whatever lies beside it on the page."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='content-sidebar-wrap'><article><p>{LINE}</p></article></div>", LINE),
        (f"<div id='content' class='with-sidebar'><p>{LINE}</p></div>", LINE),
        (f"<article class='has-sidebar'><p>{LINE}</p></article>", LINE),
        (f"<section aria-label='Search results'><p>{LINE}</p></section>", LINE),
        (f"<p title='the hidden costs'>{LINE}</p>", LINE),
        (f"<div class='sidebar'><div class='widget'><article><p>{LINE}</p></article></div></div>", LINE),
        (f"<form id='f'><div class='header'>x</div><p>{LINE}</p><p>{LINE}</p></form>", f"{LINE}\n\n{LINE}"),
        (f"<p>{LINE}</p><div class='ad'>Buy</div><h2>Head</h2><div class='ad'>Buy</div><p>{LINE}</p>", f"{LINE}\n\nHead\n\n{LINE}"),
        (f"<p>{LINE}</p><div class='cookie-banner'>Buy</div><p hidden>no</p><p style='display: none'>no</p>", LINE),
        (f"<article><p>{LINE}</p><div class='comments'>{LINE}{LINE}{LINE}</div></article><aside><article>Other</article></aside>", LINE),
    ],
)
def test_wrappers_of_the_article_stay(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>") == want


def test_regions_surge_and_dive():
    assert html.regions([0, 0, 0, 5, 0, 0, 7, 0, 0, 0, 3], 3) == [(1, 7, 7), (8, 11, 3)]
    assert html.regions([], 3) == [] and html.regions([4], 3) == [(0, 1, 4)] and html.regions([0, 0], 3) == []
    assert html.regions([6, 2, 0, 0, 5], 2) == [(0, 2, 8), (3, 5, 5)]


MENU = "<div><ul>" + "".join(f"<li><a href='/{i}'>A menu entry that is as long as a sentence, number {i}</a></li>" for i in range(9)) + "</ul></div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"{MENU}<div><p>{LINE}</p><p>{LINE}</p></div><div><p>Short note</p></div>{MENU}", f"{LINE}\n\n{LINE}"),  # nothing is named: only the distribution can tell
        (f"<div>Top</div><div><div><h2>Head</h2><p>{LINE}</p></div><div><p>Two words</p></div><div><p>{LINE}</p></div></div><div>Bottom</div>", f"Head\n\n{LINE}\n\nTwo words\n\n{LINE}"),
        (f"<div><article><p>Teaser</p></article></div><div><p>{LINE}</p></div>", f"Teaser\n\n{LINE}"),
        (f"<nav>{MENU} You are here</nav><article><h1>T</h1></article><div>{'Other pages of this site. ' * 3}</div>", "T"),
        ("<article class='post has-comments'><header class='entry-header'><h1>Title</h1></header><p>x</p></article>", "Title\n\nx"),
        (f"<div class='no-sidebar'><p>{LINE}</p></div><div class='reader-comments'><p>{LINE * 9}</p></div><div id='siteFooter'>{LINE}</div>", LINE),
        (f"<div class='content-with-sidebar'><p>{LINE}<span class='ad'>Buy</span> end</p></div>", f"{LINE} end"),
        (f"<p>{LINE} <a href='/x'>a link</a> in it</p><table><tr><td>a<td>b</table>", f"{LINE} a link in it\n\na\n\nb"),
    ],
)
def test_line_blocks_decide(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>") == want


def test_without_the_distribution_menus_stay(spark, middle):
    """What the stage takes away: on every page of the table, lines that no list names."""
    pages = [r["html"] for r in spark.read.parquet(f"{middle}/pages.parquet").collect()]
    without = ["\n\n".join(x.text for x in html.lines(p) if x.text) for p in pages]
    assert all(len(html.main_text(p)) < len(w) for p, w in zip(pages, without, strict=True))


@pytest.mark.parametrize("tag", ["<div>", "<b>", "<span hidden>", "<p>x<b class='ad'>", "<li><ul>", "</div>", "<a href='x'>"])
def test_unclosed_tags_take_linear_time(tag):
    import time

    took = []
    for n in (3000, 30_000):
        start = time.process_time()
        html.main_text(f"<p>{LINE}</p>" + tag * n + "<p></p>" * n)
        took.append(time.process_time() - start)
    assert took[1] < 40 * max(took[0], 0.02)


def test_pages_of_the_small_table(spark, middle):
    """Each page's article as a regular expression has it."""
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{middle}/pages.parquet").collect()}
    got = queries.op9_html_extraction(spark, middle).collect()
    assert len(got) == len(pages)
    for r in got:
        article = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pages_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (1, "u", "", 5), (None, None, "<p>x" + "y" * 200_000, 5)], "page_id long, url string, html string, text int")
    got = sorted(r["n_chars"] for r in html.extract(df).collect())
    assert got == [0, 0, 200_001] and html.extract(df.limit(0)).count() == 0
