"""Quality rules, URL filter and licence scan."""

import math
from collections import Counter

import duckdb
import pytest

from skyquilt.llm import licenses, quality, urls

DIR = "/root/testdata/sf0.001"


def test_quality_against_sql(spark):
    sql = duckdb.connect()
    sql.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(sql.sql(f"select {', '.join(names)} from ({quality.ORACLE})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in quality.query(spark, DIR).collect()) == want


def test_quality_of_odd_rows(spark):
    good = "\n".join(" ".join(f"w{i}x{k}" for k in range(8)) + "." for i in range(12))
    junk = "\n".join("BUY!! NOW!! ALL!! OF!! IT!! HERE!! TODAY!!" for _ in range(12))
    rows = [(1, None, "q"), (2, "", "q"), (3, good, "q"), (4, good + "\nAccept all cookies now", "q"), (5, junk, "q"), (6, good + "\n" + "x%%% y$$$ " * 60, "q"), (7, "a b c " * 4000, "q"), (3, good, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert [got[i].kept for i in range(1, 8)] == [False, False, True, True, False, False, False]
    assert got[7].n_repeat_words == 12000 and got[7].base_failed and got[5].n_dup_lines == 11 and got[1].n_words == 0
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, good), (3, good), (4, good)]
    assert quality.quality(docs.limit(0)).count() == 0


def test_stage_removes_menus_of_any_length_and_furniture_of_all_languages(spark):
    good = "\n".join(" ".join(f"w{i}x{k}" for k in range(8)) + "." for i in range(12))
    menu = " | ".join(f"entry{k}" for k in range(60))
    paths = "see a/b or either / or, 3 > 2 | maybe not in this one sentence of prose"
    texts = [menu, good + "\n" + " · ".join("abcdef"), good + "\nAlle Cookies akzeptieren", good + "\nTous droits réservés", good + "\nIniciar sesión", good + "\n" + paths, good + "\nHome | About", good]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    judged = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame([(0, menu), (1, good + "\n" + menu), (2, good + "\n" + paths), (3, good)], "doc_id long, text string")).collect()}
    assert judged == {0: False, 1: False, 2: True, 3: True}
    sql = duckdb.connect()
    sql.sql("create table documents (doc_id bigint, text varchar)")
    sql.executemany("insert into documents values (?, ?)", [(0, menu), (1, good + "\n" + menu), (2, good + "\n" + paths), (3, good)])
    assert dict(sql.sql(f"select doc_id, kept from ({quality.ORACLE})").fetchall()) == judged
    got = {r.doc_id: r.text for r in quality.kept_documents(docs).collect()}
    assert got == {1: good, 2: good, 3: good, 4: good, 5: texts[5], 6: texts[6], 7: good}


@pytest.mark.parametrize("words", ["a a a a", "a b c d a b c", "a b c x b c a b c", "a b", ""])
def test_repeated_words(spark, words):
    from pyspark.sql import functions as F

    w = words.split()
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    want = len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})
    df = spark.createDataFrame([(w,)], "w array<string>")
    assert df.select(quality.repeated_words(F.col("w"))).first()[0] == want


def test_url_rules_and_models(spark):
    rows = [
        (1, "http://A.Net/x?y", "a.net", "/x", "net/", "block"),
        (2, "https://b.example.net/en/1", "b.example.net", "/en/1", "example.net/en/", "allow"),
        (3, "https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        (4, "https://x.org/fr/#t", "x.org", "/fr/", "org/fr/", "allow"),
        (5, None, "", "", None, "allow"),
        (6, "no scheme", "", "", None, None),
        (7, "ftp://notexample.com/de/?q", "notexample.com", "/de/", None, None),
        (8, "http://h.com?x/y", "h.com", "", None, None),
        (8, "http://h.com?x/y", "h.com", "", None, None),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "clash") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for page, _, host, path, rule, verdict in rows:
        assert (got[page].host, got[page].path, got[page].rule) == (host, path, rule)
        assert got[page].verdict == verdict if verdict else got[page].verdict in ("allow", "block")
    assert urls.judge(pages).count() == len(rows) and urls.judge(pages.limit(0)).count() == 0


def test_url_models_tell_held_out_urls_apart(spark):
    good = [(i, f"https://news.example.org/fr/story/{i * 37 % 101}/title") for i in range(300)]
    bad = [(1000 + i, f"http://cheap-pills{i % 7}.net/buy/{i}?win=1") for i in range(300)]
    fresh = [(5000, "https://news.site.com/story/77/title"), (5001, "http://cheap-pills9.biz/buy/7?win=1")]
    pages = spark.createDataFrame(good + bad + fresh, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert got[5000].verdict == "allow" and got[5001].verdict == "block" and got[5000].score > got[5001].score


def test_license_scan(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    marks = {"mit": "MIT License", "apache": "Apache License", "gpl": "General Public License", "cc": "CC BY"}
    for r in licenses.query(spark, DIR).collect():
        want = sorted(f for f, mark in marks.items() if mark in texts[r.doc_id])
        assert r.families == ",".join(want), texts[r.doc_id][-200:]
    rows = [(1, None), (2, ""), (3, "It is of the same kind and in the form of a file."), (4, "Code here is licensed under the Apache License, Version 2.0 by its authors.\nx"), (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows * 2], "doc_id long, text string, families string")
    got = licenses.scan(docs).collect()
    assert len(got) == 10 and {r.doc_id: r.families for r in got} == {1: "", 2: "", 3: "", 4: "apache", 5: "mit"}


def test_license_examples_of_none_are_different_lines_far_from_the_templates(spark, monkeypatch):
    monkeypatch.setattr(licenses, "NEGATIVES", 20)
    notice = next(t for f, t in licenses.TEMPLATES if f == "bsd" and "Redistribution" in t)
    prose = [f"plain line {i} of the same kind and in the form of a file" for i in range(15)]
    lines = spark.createDataFrame([(t,) for t in [*prose * 40, notice, notice[:90], "", "a licence"]], "line string")
    got = sorted(r.line for r in licenses.examples(lines).filter("family = 'none'").collect() if r.line not in licenses.PROSE)
    assert got == sorted(prose)


def test_unsure_licence_lines_are_unknown(spark, monkeypatch):
    lines = ["This file is distributed under the Foo Public License, version 9, of its makers.", "The sun is out and it is warm.", "All you can eat in the garden."]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    model = licenses.classifier
    monkeypatch.setattr(licenses, "classifier", lambda lines: (*model(lines)[:2], 2.0))
    got = {r.doc_id: (r.families, r.n_licence, r.n_unknown) for r in licenses.scan(docs).collect()}
    assert got == {0: ("", 0, 1), 1: ("", 0, 0), 2: ("", 0, 0)}


def test_url_model_against_its_definition(spark):
    """Every estimate, of grams seen and unseen, recomputed; then the scores."""
    held = [("http://good.org/fr/a", "allow"), ("http://good.org/fr/bb", "allow"), ("http://x.net/zz?q", "block")]
    labelled = spark.createDataFrame(held, "url string, rule_verdict string")
    fold = lambda u: "^^" + u.lower() + "$"
    counts = {"allow": Counter(), "block": Counter()}
    for u, side in held:
        counts[side].update(fold(u)[i : i + 3] for i in range(len(fold(u)) - 2))

    def p(gram, side):
        out = 1 / len(urls.ALPHABET)
        for k in (1, 2, 3):
            n = sum(v for g, v in counts[side].items() if g[3 - k :] == gram[3 - k :])
            around = sum(v for g, v in counts[side].items() if g[3 - k : 2] == gram[3 - k : 2])
            out = (n + urls.PRIOR * out) / (around + urls.PRIOR)
        return out

    ratios = {r.gram: r.ratio for r in urls.model(labelled).collect()}
    assert len(ratios) == len(urls.ALPHABET) ** 3
    want = lambda g: math.log(p(g, "allow") / p(g, "block"))
    for g in [*counts["allow"], *counts["block"], "q~q", "/fz", "zzz", "org", "^^x", ".nx"]:
        assert abs(ratios[g] - want(g)) < 1e-9, g
    fresh = ["http://new.org/fr/q", "", "ftp://é"]
    scores = {r.url: r.score for r in urls.scored(spark.createDataFrame([(u,) for u in fresh], "url string"), urls.model(labelled)).collect()}
    for u in fresh:
        text = fold(u).replace("é", "~")
        grams = [text[i : i + 3] for i in range(len(text) - 2)]
        assert abs(scores[u] - sum(map(want, grams)) / len(grams)) < 1e-9


def test_license_scan_of_repeated_rows_and_empty_tables(spark):
    body = [t for f, t in licenses.TEMPLATES if f in ("mit", "bsd") and len(t) > 80]
    rows = [(i, t) for i, t in enumerate([*body, "See the LICENSE page for all other terms of our house that may well apply here", "Licensed under the MIT license.\n" + "x " * 300_000])]
    schema = "doc_id long, text string"
    once = {tuple(r) for r in licenses.scan(spark.createDataFrame(rows, schema)).collect()}
    thrice = licenses.scan(spark.createDataFrame(rows * 3, schema)).collect()
    assert len(thrice) == 3 * len(rows) and {tuple(r) for r in thrice} == once
    assert {r[0]: r[1] for r in once} == {0: "mit", 1: "bsd", 2: "", 3: "mit"}
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0


def test_kept_documents_of_clashing_names(spark):
    names = ["doc_id", "__q", "__n", "__quality", "row", "text", "n_chars"]
    text = " ".join(f"word{i}" for i in range(60)) + "\nclick here\nend of it."
    docs = spark.createDataFrame([(1, "a", "b", "c", "d", text, 3), (None, "a", "b", "c", "d", text, None), (2, "a", "b", "c", "d", None, 0)], "doc_id long, __q string, __n string, __quality string, row string, text string, n_chars long")
    kept = quality.kept_documents(docs)
    clean = text.replace("click here\n", "")
    assert kept.columns == names and [tuple(r) for r in kept.collect()] == [(1, "a", "b", "c", "d", clean, len(clean)), (None, "a", "b", "c", "d", clean, len(clean))]
