"""Defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnflow.llm import debruijn, html, isomedia, jaccard, langid, linededup, packing, templates, toxicity, warc

from .conftest import prose


def bench_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_line_dedup(hazards):
    out = linededup.dedup(hazards, min_lines=2, min_chars=0)
    assert out.columns == [c for c in hazards.columns if c != "n_removed"] + ["n_removed"]
    rows = out.collect()
    assert len(rows) == hazards.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_removed"]))
    assert by[1][0] == (prose(1, 120, 6), 0)
    assert by[2] == [("", 6)] * 2  # repeated rows alike
    assert sorted(n for _, n in by[None]) == [0, 0] and (None, 0) in by[4] and by[5] == [("", 0)]
    assert by[9][0][1] == 0 and by[10][0][1] == 506
    assert by[-12][0] == ("Ünïcode ßtraße 日本語\n\nline", 3)  # line, line occurs three times, overlapping
    by = {r["doc_id"]: r for r in linededup.dedup(hazards, with_runs=True).collect()}
    assert by[-12]["n_removed"] == 0 and by[8]["n_removed"] == 0  # short lines stay
    assert by[10]["run_starts"] == [0, 500] and by[10]["run_lengths"] == [500, 6] and by[10]["run_sources"] == [9, 1] and by[4]["run_starts"] == []


def test_jaccard_groups(hazards):
    got = {r["group_id"]: r["doc_ids"] for r in jaccard.grouped(hazards).collect()}
    assert got == {1: [1, 2, 3], 7: [7, 8], 9: [9, 10]}
    assert {tuple(r) for r in jaccard.links(hazards).collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (7, 7, 1), (8, 7, 1), (9, 9, 1), (10, 9, 1)}
    kept = Counter(r["doc_id"] for r in jaccard.keep_one(hazards).collect())
    assert kept == Counter([1, None, None, 4, 5, 6, 7, 9, 11, -12, 13])
    assert jaccard.keep_one(hazards).columns == hazards.columns


def test_templates(spark, hazards):
    item = " ".join(prose(1, 120, 6).split()[:20])
    bench = bench_of(spark, [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "too short")])
    assert sorted({(r["doc_id"], r["item_id"]) for r in templates.leaks(hazards, bench).collect()}) == [(1, 1), (2, 1), (3, 1), (10, 1)]
    left = templates.clean(hazards, bench)
    assert left.columns == hazards.columns and left.count() == hazards.count() - 6
    assert templates.leaks(hazards, bench.limit(0)).count() == 0


def test_packing(hazards):
    rows = packing.pack(hazards, window=64).collect()
    want = Counter()
    for d in hazards.select("doc_id", "text").collect():
        want[d[0]] += len([w for w in (d[1] or "").lower().split() if any(c.isalnum() for c in w)]) + 1
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
    assert got == want


def test_language(hazards):
    rows = langid.identify(hazards, langid.train(hazards)).collect()
    assert len(rows) == hazards.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["language"], r["cosine"]))
    assert by[4] == [("und", 0.0)] and by[5] == [("und", 0.0)] and by[6] == [("und", 0.0)] and by[13] == [("und", 0.0)]
    assert by[1][0][0] == "en"


def test_toxicity(spark, hazards):
    labels = labels_of(spark, [(1, 1, 1), (1, 1, 1), (9, 1, 0), (11, 1, 0), (7, 1, None), (None, 1, 1), (3, 0, 0), (3, 0, 1), (777, 1, 1), (5, 1, 0)])
    m = toxicity.train(hazards, labels)
    hit = toxicity.toxic_documents(hazards, m)
    left = toxicity.reject(hazards, m)
    assert left.columns == hazards.columns and left.count() + hit.count() == hazards.count()
    assert toxicity.train(hazards, labels.limit(0)) is None
    assert toxicity.toxic_documents(hazards, None).count() == 0 and toxicity.reject(hazards, None).count() == hazards.count()


def test_debruijn(hazards):
    rows = [tuple(r) for r in debruijn.repeated_spans(hazards).collect()]
    assert (1, 0, 120, False, [1]) in rows and (2, 0, 120, True, [1]) in rows and (3, 0, 120, True, [1]) in rows
    assert (9, 0, 60000, False, [9]) in rows and {r[0] for r in rows} == {1, 2, 3, 9, 10}
    assert len(rows) == len(set(map(repr, rows)))


def test_empty_tables(spark, hazards, make):
    none = make([])
    bench, labels = bench_of(spark, []), labels_of(spark, [])
    assert linededup.dedup(none).count() == jaccard.grouped(none).count() == jaccard.links(none).count() == jaccard.keep_one(none).count() == 0
    assert templates.leaks(none, bench).count() == templates.clean(none, bench).count() == packing.pack(none).count() == 0
    assert langid.identify(none, langid.train(none)).count() == debruijn.repeated_spans(none).count() == 0
    m = toxicity.train(none, labels)
    assert m is None and toxicity.toxic_documents(none, m).count() == toxicity.reject(none, m).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html.main_text(pages).count() == warc.reassemble(warc.from_pages(pages)).count() == isomedia.media_columns(isomedia.from_pages(pages)).count() == 0


def test_pages_with_nulls_and_repeats(spark):
    rows = [(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (2, None, ""), (3, "v", None), (None, "w", "<p>y</p>"), (4, "z", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id bigint, url string, html string, bucket int, record string")
    out = {r["record_id"]: (r["status"], r["payload"] and r["payload"].decode()) for r in warc.reassemble(warc.from_pages(pages)).collect()}
    assert {k: v[0] for k, v in out.items()} == {f"<urn:page:{i}>": "ok" for i in (1, 2, 3, 4)} and out["<urn:page:4>"][1] == "é" * 300_000
    assert html.main_text(pages).count() == 6
    deep = "<b>" * 350_000
    assert html.main_text(spark.createDataFrame([(1, "u", deep), (2, "u", "<p " * 350_000), (3, "u", "<div>" * 2000 + "<p>" + "word, " * 20 + "</p>")], "page_id bigint, url string, html string")).count() == 3
    media = isomedia.media_columns(isomedia.from_pages(pages)).collect()
    assert len(media) == 6 and all(r["status"] == "ok" for r in media)
