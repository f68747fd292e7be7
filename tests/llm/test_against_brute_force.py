"""What SQL can't express, and random cases of what it can, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import common, debruijn, html, jaccard, langid, linededup, packing, templates, toxicity

from .conftest import WORDS, prose

WORD = re.compile(r"[a-z0-9]+")


def near_copies(seed, n):
    """Texts, many of them edited copies of earlier ones."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out).split()
            for _ in range(r.randrange(0, max(2, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(WORDS)
            out.append(" ".join(w))
        else:
            out.append(prose(seed * 1000 + i, r.choice([3, 12, 40, 150])))
    return out


def test_jaccard_groups_equal_all_pairs(make):
    texts = near_copies(4, 120)
    sets = []
    for t in texts:
        w = WORD.findall(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and k >= 0.6 * (len(sets[i] | sets[j])) - 1e-9:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    want = defaultdict(list)
    for i in range(len(texts)):
        want[top(i)].append(i)
    got = {r["group_id"]: r["doc_ids"] for r in jaccard.grouped(make(list(enumerate(texts)))).collect()}
    assert got == {k: v for k, v in want.items() if len(v) > 1}
    for orders in (1, 3):
        assert {r["group_id"]: r["doc_ids"] for r in jaccard.grouped(make(list(enumerate(texts))), orders=orders).collect()} == got


@pytest.mark.parametrize("orders", [1, 2])
def test_jaccard_links_equal_all_pairs(make, orders):
    """Links inside a group count too, copies with each other as well, and an id of several texts once."""
    rows = list(enumerate(near_copies(5, 100)))
    rows += [(100 + k, rows[k][1]) for k in range(0, 60, 3)] + [(200, rows[0][1]), (200, rows[7][1]), (201, rows[7][1]), (201, rows[0][1]), (7, rows[7][1]), (8, "x y z u")]
    texts = defaultdict(list)
    for i, t in rows:
        w = WORD.findall(t)
        texts[i].append({tuple(w[j : j + 3]) for j in range(len(w) - 2)})
    near = {i: {j for j in texts if j != i and any(len(x & y) >= 0.6 * len(x | y) - 1e-9 for x in texts[i] for y in texts[j])} for i in texts}
    got = {r["doc_id"]: r["n_links"] for r in jaccard.links(make(rows), orders=orders).collect()}
    assert got == {i: len(x) for i, x in near.items() if x}
    groups = {r["doc_id"]: r["group_id"] for r in jaccard.groups(make(rows)).collect()}
    assert {r["doc_id"]: r["group_id"] for r in jaccard.links(make(rows), orders=orders).collect()} == groups


def brute_links(rows):
    """{doc_id: number of links} and {doc_id: least id that links lead to} of the documents that have links."""
    texts = defaultdict(list)
    for i, t in rows:
        w = WORD.findall(t)
        texts[i].append({tuple(w[j : j + 3]) for j in range(len(w) - 2)})
    near = {i: {j for j in texts if j != i and any(len(x & y) >= 0.6 * len(x | y) - 1e-9 for x in texts[i] for y in texts[j])} for i in texts}
    least = {i: i for i, x in near.items() if x}
    while (then := {i: min([k, *(least[j] for j in near[i])]) for i, k in least.items()}) != least:
        least = then
    return {i: len(x) for i, x in near.items() if x}, least


def one_cluster(seed, n, words):
    """Copies of one text with up to a fifth of the words changed, so that some pairs are links and some aren't."""
    r = random.Random(seed)
    base = prose(seed, words).split()
    return [" ".join(r.choice(WORDS) if r.random() < share else w for w in base) for share in (r.random() / 5 for _ in range(n))]


def test_jaccard_links_ship_each_set_of_a_cluster_once(spark, make):
    """Not once for each of its pairs: 780 pairs of sets of 36 KB, more than a block of compressed shuffle data holds twice."""
    rows = list(enumerate(one_cluster(6, 40, 6000)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    try:
        got = {r["doc_id"]: (r["n_links"], r["group_id"]) for r in jaccard.links(make(rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written() - before < 8e6
    many, least = brute_links(rows)
    assert 0 < sum(many.values()) < 39 * 40
    assert got == {i: (many[i], least[i]) for i in many}


def test_jaccard_links_over_blocks_equal_all_pairs(make, monkeypatch):
    """Clusters of many blocks, blocks of more rows than are compared at once, an id of many texts."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    rows = list(enumerate(one_cluster(7, 90, 80) + near_copies(8, 40)))
    rows += [(200, t) for _, t in rows[:60:2]] + [(201 + k, rows[k][1]) for k in range(0, 120, 9)]
    many, least = brute_links(rows)
    assert {r["doc_id"]: (r["n_links"], r["group_id"]) for r in jaccard.links(make(rows)).collect()} == {i: (many[i], least[i]) for i in many}
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 1500)
    assert {r["doc_id"]: (r["n_links"], r["group_id"]) for r in jaccard.links(make(rows)).collect()} == {i: (many[i], least[i]) for i in many}


def test_parity_bits_rule_out_no_link():
    r = np.random.default_rng(9)
    ruled_out = 0
    for _ in range(600):
        p, q = (int(x) for x in r.integers(1, 400, 2))
        both = int(r.integers(0, min(p, q) + 1))
        tokens = r.choice(1 << 40, p + q - both, replace=False).astype(np.uint64)
        x, y = np.sort(tokens[:p]), np.sort(tokens[p - both :])
        bits = [jaccard.parity_bits(z, np.array([len(z)]))[0] for z in (x, y)]
        may = jaccard.may_link(p, bits[0], q, bits[1], 0.6)
        assert may == jaccard.may_link(q, bits[1], p, bits[0], 0.6)
        if both >= 0.6 * (p + q - both) - 1e-9:
            assert may
        elif both < 0.4 * (p + q - both):
            ruled_out += not may
            assert not may or min(p, q) < 40
    assert ruled_out > 300


def brute_runs(docs, m, chars):
    """(start, lines, source) of the maximal runs of each document that occur earlier, and the texts without them: by comparing every window."""
    seqs = {i: [(n, line.strip()) for n, line in enumerate(t.split("\n")) if line.strip()] for i, t in docs}
    first = {}
    for i, s in sorted(seqs.items()):
        for p in range(len(s)):
            for q in range(p + 1, len(s) + 1):
                first.setdefault(tuple(x for _, x in s[p:q]), (i, p))
    runs, left = {}, {}
    for i, t in docs:
        s, found, before = seqs[i], [], 0
        for p in range(len(s)):
            end = max((q for q in range(p + 1, len(s) + 1) if first[tuple(x for _, x in s[p:q])] != (i, p)), default=0)
            if end > before and end - p >= m and sum(len(x) for _, x in s[p:end]) >= chars:
                found.append((s[p][0], end - p, first[tuple(x for _, x in s[p:end])][0], range(p, end)))
            before = max(before, end)
        gone = {s[p][0] for *_, inside in found for p in inside}
        runs[i] = [f[:3] for f in found]
        left[i] = "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone)
    return runs, left


def brute_lines(docs, m, chars=0):
    return brute_runs(docs, m, chars)[1]


@pytest.mark.parametrize("m, chars", [(1, 0), (2, 0), (3, 0), (2, 5)])
def test_line_dedup(make, m, chars):
    r = random.Random(m)
    docs = [(i, "\n".join(r.choice(["a", "b", " b ", "c", "", f"u{i}"]) for _ in range(r.randrange(0, 25)))) for i in range(40)]
    rows = linededup.dedup(make(docs), m, min_chars=chars, with_runs=True).collect()
    runs, left = brute_runs(docs, m, chars)
    assert {x["doc_id"]: x["text"] for x in rows} == left
    assert {x["doc_id"]: list(zip(x["run_starts"], x["run_lengths"], x["run_sources"])) for x in rows} == runs


def test_a_run_is_judged_as_a_whole(make):
    """Two runs of two lines that overlap make no run of three; a rule on the whole run tells them apart."""
    docs = [(1, "aaaa\nbbbb"), (2, "bbbb\ncccc"), (3, "aaaa\nbbbb\ncccc"), (4, "x\naaaa\nbbbb\ncccc\ny")]
    rows = {r["doc_id"]: r for r in linededup.dedup(make(docs), min_chars=12, with_runs=True).collect()}
    assert rows[3]["text"] == docs[2][1] and rows[3]["run_starts"] == []
    assert rows[4]["text"] == "x\ny" and (rows[4]["run_starts"], rows[4]["run_lengths"], rows[4]["run_sources"]) == ([1], [3], [3])


def test_debruijn_spans(make):
    r = random.Random(8)
    passages = [[f"p{k}x{j}" for j in range(r.randrange(8, 30))] for k in range(6)]
    docs = []
    for i in range(30):
        words = []
        for _ in range(r.randrange(0, 4)):
            words += r.choice(passages)[: r.choice([5, 9, 99])] + [f"d{i}n{len(words)}"] * r.randrange(0, 2)
        docs.append((i, " ".join(words)))
    k = 7
    seen, where = {}, defaultdict(list)
    for i, t in docs:
        w = t.split()
        for p in range(len(w) - k + 1):
            where[tuple(w[p : p + k])].append((i, p))
    want = []
    for i, t in docs:
        w, last = t.split(), None
        for p in range(len(w) - k + 1):
            at = where[tuple(w[p : p + k])]
            if len(at) < 2:
                continue
            copy, src = at[0] != (i, p), at[0][0]
            if last and last["end"] == p and last["copy"] == copy:
                last["end"], last["n"] = p + 1, last["n"] + 1
                last["src"].add(src)
            else:
                last = {"doc": i, "start": p, "end": p + 1, "n": k, "copy": copy, "src": {src}}
                want.append(last)
    got = sorted((x["doc_id"], x["start_word"], x["n_words"], x["is_copy"], x["source_doc_ids"]) for x in debruijn.repeated_spans(make(docs), k=k, s=3).collect())
    assert got == sorted((x["doc"], x["start"], x["n"], x["copy"], sorted(x["src"])) for x in want)


def place_by_definition(sizes, w):
    """The fill level of every item, by the sum of squares written out."""
    count, out = Counter(), []
    for size in sizes:
        s = size % w
        if not s:
            continue

        def after(h):
            c = count.copy()
            if h:
                c[h] -= 1
            if h + s < w:
                c[h + s] += 1
            return sum(v * v for v in c.values())

        h = min((h for h in range(w - s + 1) if h == 0 or count[h] > 0), key=lambda h: (after(h), -h))
        if h:
            count[h] -= 1
        if h + s < w:
            count[h + s] += 1
        out.append(h)
    return out


def test_packing_places_by_the_sum_of_squares(make):
    r = random.Random(2)
    docs = [(i, " ".join(["w"] * r.randrange(0, 90))) for i in range(250)]
    w = 32
    rows = sorted(map(tuple, packing.pack(make(docs), window=w, shard_tokens=10**9).collect()))
    want = place_by_definition([len(t.split()) + 1 for _, t in docs], w)
    got = [x[3] for x in rows if x[5] < w]
    assert got == want
    used = defaultdict(list)
    for _, shard, win, at, _, n in rows:
        used[shard, win].append((at, n))
    for pieces in used.values():  # no overlap, no gap
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= w
    shards = packing.pack(make(docs), window=w, shard_tokens=2000)
    assert shards.select("shard").distinct().count() > 1 and shards.agg(F.sum("n_tokens")).first()[0] == sum(len(t.split()) + 1 for _, t in docs)


ITEM = "In the spring Maria bought 12 apples for 30 dollars and then she gave 4 of them to Peter before going home by the old road"


def test_templates_catch_other_numbers_and_names(spark, make):
    bench = spark.createDataFrame([(1, ITEM), (2, "When the cold engine starts at noon it burns 7 liters an hour until the main valve closes again for good")], "item_id bigint, text string")
    other = ITEM.replace("Maria", "Anna Smith").replace("12", "57").replace("30", "1,200").replace("4 of", "9 of").replace("Peter", "Paul")
    clash = ITEM.replace("Maria", "Anna").replace("Peter", "Anna")  # two names became one
    half = " ".join(ITEM.split()[:17])
    docs = [(1, f"Some words. {ITEM}. And more."), (2, prose(5) + ". " + other + " " + prose(6)), (3, clash), (4, prose(7)), (5, " ".join(reversed(ITEM.split()))), (6, half), (7, ITEM.upper() + " " + prose(9)), (8, "12 apples for 30 dollars")]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in templates.leaks(make(docs), bench).collect()}
    assert got.get((1, 1)) is True and got.get((2, 1)) is False
    assert not {d for d, _ in got} & {3, 4, 5, 8} and all(i == 1 for _, i in got)
    assert {r["doc_id"] for r in templates.clean(make(docs), bench).collect()} >= {3, 4, 5, 8}


def test_templates_catch_passages_and_short_items(spark, make):
    long_ = " ".join(f"{a} {b}" for a, b in zip(prose(41, 30).split(), prose(42, 30).split()))
    items = [(1, long_), (2, "What is the capital of France?"), (3, "What is 12 + 30?"), (4, "3 7 11 4 15 9 2 8 6 21"), (5, "word"), (6, prose(43, 20)), (7, None), (8, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    w, short = long_.split(), prose(43, 20).split()
    short[6] = "changed"
    docs = [
        (1, f"{prose(44)} {' '.join(w[20:40])} {prose(45)}"), (2, f"{prose(44)} {' '.join(w[20:32])} {prose(45)}"), (3, f"{prose(46)}. What is the capital of France? {prose(47)}"), (4, f"{prose(46)}. What is the capital of Peru? {prose(47)}"),
        (5, "We ask: what is 12 + 30? It is 42."), (6, "We ask: what is 12 + 31?"), (7, "So 3 7 11 4 15 9 2 8 6 21 it was."), (8, "So 3 7 11 4 15 9 2 8 6 22 it was, a word."), (9, "What is the capital"), (10, f"{prose(48)} {' '.join(short)}"),
        (11, "What is"), (12, "12 + 30?"),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in templates.leaks(make(docs), bench).collect()}
    assert got == {(1, 1), (3, 2), (4, 2), (5, 3), (7, 4), (10, 6)}


def test_templates_drop_only_windows_in_conflict(spark, make):
    item = "Every morning the baker puts 3 loaves near the open window and after a while somebody takes 5 of them, which leaves the old baker with a lot of flour but 2 clean trays until the next day when 2 more trucks come along with the grain for the rest of this whole week"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = [
        (1, item.replace("3 loaves", "4 loaves").replace("5 of", "4 of")), (2, item.replace("2 clean", "7 clean").replace("2 more", "8 more")), (3, item.replace("2 more", "9 more")), (4, item),
        (5, prose(4)),
    ]
    got = {r["doc_id"]: (r["exact"], r["n_windows"]) for r in templates.leaks(make(docs), bench).collect()}
    n = got[4][1]
    assert set(got) == {1, 2, 3, 4} and [got[i][0] for i in (1, 2, 3, 4)] == [False, False, False, True]
    assert [got[i][1] for i in (1, 2, 3)] == [n - 14, n - 16, n - 8]  # 3 is the sixth token, so only 6 windows hold it


def test_html_keeps_the_article_and_its_siblings():
    para = "This is a long paragraph of the article, with commas, and enough text to count as content, surely. " * 2
    page = f"<html><head><title>A &amp; B</title><script>var x='<p>no</p>'</script></head><body><div id='nav'><ul><li><a href='/'>Home, sweet, home, and more links to follow</a></li></ul></div><div class='main'><h1>Head</h1><p>{para}</p><p>{para}<a href=x>link</a></p><!-- <p>{para}</p> --></div><div class='sidebar'><p>{para}</p></div><footer><p>{para}</p></footer></body></html>"
    title, text, score, n = html.extract(page)
    assert title == "A & B" and text.count("This is a long paragraph") == 4 and "Home" not in text and "var x" not in text and "Head" in text
    assert score > 10 and n == 2
    assert html.extract(None) == html.extract("") == ("", "", 0.0, 0)
    links = "".join(f"<p><a href=x>{para}</a></p>" for _ in range(5))
    _, text, _, _ = html.extract(f"<body><div class=a>{links}</div><div class=b><p>{para}</p><p>{para}</p></div></body>")
    assert text.count("This is a long") == 4
    for odd in ("<p>open <b>bold <p>again", "</div></p>text", "<", "<<<>>>", "a < b and c > d", "<p " * 200, "<div>" * 3000 + "deep" + "</div>" * 10):
        html.extract(odd)


SOUNDS = {"aa": ["ba", "na", "ta", "la"], "bb": ["sch", "ung", "ich", "ein"], "cc": ["zio", "ne", "gli", "tto"]}


def tongue(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_language_held_out(make):
    docs = make([(i * 3 + k, tongue(x, i), x) for i in range(60) for k, x in enumerate(SOUNDS)] + [(900, tongue("aa", 99), None)])
    model = langid.train(docs)
    held = make([(i * 3 + k, tongue(x, 1000 + i), x) for i in range(30) for k, x in enumerate(SOUNDS)] + [(999, "qqq xxq wvw kjq " * 20, "aa")])
    rows = langid.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    ok = sum(r["language"] == r["lang"] for r in rows if r["doc_id"] != 999)
    assert ok >= 88 and next(r for r in rows if r["doc_id"] == 999)["language"] == "und"


def test_nearest_centroid_equals_plain_cosine(make):
    texts = [tongue(x, i, 15) for i in range(8) for x in SOUNDS]
    docs = make([(i, t, list(SOUNDS)[i % 3]) for i, t in enumerate(texts)])
    model = langid.train(docs)
    for r in langid.identify(docs, model).collect():
        import pyarrow as pa

        v = model.vectors(pa.array([texts[r["doc_id"]]], pa.large_string()))[0].astype(float)
        near = [float(np.dot(v, c)) for c in model.centroids]
        best = int(np.argmax(near))
        assert abs(near[best] - r["cosine"]) < 1e-5
        assert r["language"] == (model.languages[model.owner[best]] if near[best] >= model.floor[best] else "und")


def test_toxicity_held_out(spark, make):
    bad = ["vilegrok", "snarfing", "drubbed"]

    def text(i, toxic):
        r = random.Random(i)
        w = prose(i, r.randrange(5, 200)).split()
        if toxic:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        return " ".join(w)

    rows = [(i, text(i, i % 4 == 0), "en" if i % 3 else "de") for i in range(800)]
    docs, labels = make(rows), spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(500)], "doc_id bigint, quality int, toxic int")
    m = toxicity.train(docs, labels)
    hit = {r["doc_id"] for r in toxicity.toxic_documents(docs, m).collect()}
    held = range(500, 800)
    assert sum(i in hit for i in held if i % 4 == 0) >= 71 and sum(i in hit for i in held if i % 4) <= 5
    assert {r["doc_id"] for r in toxicity.reject(docs, m).collect()} == {i for i in range(800)} - hit
    assert set(m.thresholds) <= {"en", "de"} and m.thresholds


@pytest.mark.parametrize("block", [256, 8192])
def test_toxicity_fits_on_all_labels(spark, make, block):
    """A word that only the last toxic documents have (by the hash that once chose a sample of 350) is learnt, and thresholds come from all held-out scores."""
    import pyarrow as pa

    order = [r[0] for r in spark.range(1500).where("id % 3 = 0").orderBy(F.xxhash64("id")).collect()]
    late = set(order[400:])

    def text(i, words):
        w = prose(i, 30).split()
        for k in words:
            w.insert(7 * i % len(w), k)
        return " ".join(w)

    rows = [(i, text(i, [] if i % 3 else ["snarfing" if i in late else "vilegrok"])) for i in range(1500)] + [(2000 + i, text(2000 + i, ["snarfing"] if i < 50 else [])) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1500)], "doc_id bigint, quality int, toxic int")
    docs = make(rows)
    m = toxicity.train(docs, labels, block=block)
    hit = {r["doc_id"] for r in toxicity.toxic_documents(docs, m).collect()}
    assert sum(2000 + i in hit for i in range(50)) >= 48 and sum(2000 + i in hit for i in range(50, 100)) <= 2
    held = [r[0] for r in spark.range(1500).where("pmod(xxhash64(id), 5) = 0").collect()]
    score = m.score(*toxicity.features(pa.array([rows[i][1] for i in held], pa.large_string())))
    want = toxicity.best_threshold(score, np.array([int(i % 3 == 0) for i in held]))
    assert abs(m.common - want) < 1e-5 and m.thresholds == {"en": m.common}
    again = toxicity.train(docs.repartition(5), labels.repartition(3), block=block)
    assert np.array_equal(again.table, m.table) and again.common == m.common


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    common.prepare(spark)
    got = {x["node"]: x["label"] for x in common.components(spark, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_corpus_counts_in_rounds(spark):
    def add(b, total):
        np.add.at(total, b.column(0).to_numpy() % 128, 1)

    common.prepare(spark)
    df = spark.range(0, 5000, 1, 13).where("id % 7 <> 0")
    want = np.bincount([i % 128 for i in range(5000) if i % 7], minlength=128)
    for fan in (256, 3):
        common.FAN, kept = fan, common.FAN
        try:
            assert (common.corpus_counts(df, ["id"], add, 128) == want).all()
            assert (common.corpus_counts(df, ["id"], add, 128, only_if=True) == (want > 0)).all()
        finally:
            common.FAN = kept


def test_html_scores_wrappers_that_hold_the_page():
    para = "<p>This is a long paragraph of the article, with commas, and enough text to count as content, surely.</p>"
    links = "<div class='nav'><ul>" + "<li><a href='/'>Home, sweet, home, and more links to follow</a></li>" * 30 + "</ul></div>"
    wrap = lambda tag, body: html.extract(f"<html><body>{links}{tag}{body}</{tag[1:].split()[0].rstrip('>')}></body></html>")
    for tag in ("<form>", "<div id='content' class='has-sidebar'>", "<div class='post no-comments'>", "<div class='sidebar'>", "<aside>", "<header>", "<div class='comments'>"):
        _, text, score, n = wrap(tag, para * 4)
        assert text.count("This is a long paragraph") == 4 and score > 0 and n == 4 and "Home" not in text, tag
    _, text, _, n = html.extract(f"<body><div>{para * 2}</div><div class='comments'>{para.replace('article', 'reader') * 9}</div><div class='sidebar'>{para}</div></body>")
    assert text.count("article") == 2 and "reader" not in text and n == 2  # comments outgrow an article, but aren't it
    assert html.extract(f"<body>{links}</body>")[1:3] == ("", 0.0)
