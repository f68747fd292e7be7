"""Registered queries without SQL, over the whole smallest tables, against plain Python written from their definitions."""

import math
import os
import re
from collections import Counter, defaultdict
from html import unescape
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from tarnflow.llm import common, html, langid, packing, registry, templates, toxicity
from tests.conftest import SF

from .test_against_brute_force import place_by_definition

OPEN = re.compile(r"[.!?:;\n\"]")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"] or "", r["lang"]) for r in common.table(spark, SF, "documents").collect()]


def words(text):
    """(start, end) of the words: letters and digits of any script, as the operators' documentation has it."""
    return [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def template(text):
    """(token, value) of each template token; value is None for literals."""
    raw = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[0-9]+|[^\W\d_]+", text)]
    out = []
    last = None  # kind, end of the token before
    for k, (w, a, b) in enumerate(raw):
        before = raw[k - 1][2] if k else None
        gap = text[before:a] if k else ""
        opens = k == 0 or bool(OPEN.search(gap))
        number = w[0] in "0123456789"
        capital = w[0].isupper()
        unit = bool(last) and last == "number" and not number and len(gap.encode()) <= 1 and w.lower() in templates.UNITS
        name = capital and not opens and not number and not unit and not (len(w) > 1 and w[-1].isupper())
        kind = "number" if number else "unit" if unit else "name" if name else "word"
        joined = (kind == "number" and last == "number" and gap in (".", ",")) or (kind == "name" and last == "name" and gap == " ")
        if joined:
            token, start = out[-1][0], out[-1][2]
            out[-1] = (token, text[start:b].lower(), start)
        else:
            out.append(({"number": "#N", "unit": "#U", "name": "#P"}.get(kind, w.lower()), None if kind == "word" else w.lower(), a))
        last = kind
    return [(t, v) for t, v, _ in out]


def test_template_leaks(spark, docs):
    w = templates.WINDOW

    def windows(text):
        t = template(text)
        return [(p, tuple(x for x, _ in t[p : p + w]), [v for _, v in t[p : p + w]]) for p in range(len(t) - w + 1) if sum(v is None for _, v in t[p : p + w]) >= templates.LITERALS]

    index, size = defaultdict(list), {}
    for r in common.table(spark, SF, "benchmark").collect():
        ws = windows(r["text"])
        size[r["item_id"]] = len({x for _, x, _ in ws})
        for p, x, v in ws:
            index[x].append((r["item_id"], p, v))
    want = {}
    for i, text, _ in docs:
        lines = defaultdict(list)
        for p, x, v in windows(text):
            for item, q, u in index.get(x, ()):
                lines[item, p - q].append((x, u, v))
        found = defaultdict(set)
        for (item, _), rows in lines.items():
            pairs = {(a, b) for _, u, v in rows for a, b in zip(u, v) if a is not None or b is not None}
            if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                found[item] |= {x for x, _, _ in rows}
        for item, xs in found.items():
            if len(xs) / size[item] >= templates.COVERAGE:
                want[i, item] = (len(xs), len(xs) / size[item])
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["coverage"]) for r in registry.op3_template_decontamination(spark, SF).collect()}
    assert want and got == want


def test_packing_places(spark, docs):
    sizes = [len(words(t)) + 1 for _, t, _ in sorted(docs)]
    rows = sorted(map(tuple, registry.op4_packing(spark, SF).collect()))
    assert Counter(r[0] for r in rows if r[4] == 0) == Counter(i for i, _, _ in docs)
    assert [r[3] for r in rows if r[5] < packing.WINDOW] == place_by_definition(sizes, packing.WINDOW)
    assert sum(r[5] for r in rows) == sum(sizes)


class Tree(HTMLParser):
    """A plain tree of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = {"tag": "#root", "kids": [], "up": None, "attrs": ""}
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCK:
            up = self.at
            while up["up"] is not None and up["tag"] not in ("p", "td", "th", "div", "article", "section", "li", "body"):
                up = up["up"]
            if up["tag"] == "p":
                self.at = up["up"]
        if tag == "li":
            up = self.at
            while up["up"] is not None and up["tag"] not in ("li", "ul", "ol"):
                up = up["up"]
            if up["tag"] == "li":
                self.at = up["up"]
        node = {"tag": tag, "kids": [], "up": self.at, "attrs": " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))}
        self.at["kids"].append(node)
        if tag not in html.VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in html.VOID:
            self.at = self.at["up"]

    def handle_endtag(self, tag):
        up = self.at
        while up["up"] is not None and up["tag"] != tag:
            up = up["up"]
        if up["up"] is not None:
            self.at = up["up"]

    def handle_data(self, data):
        self.at["kids"].append(data)

    def handle_entityref(self, name):
        self.at["kids"].append(unescape(f"&{name};"))

    def handle_charref(self, name):
        self.at["kids"].append(unescape(f"&#{name};"))


def plain_extract(page):
    tree = Tree()
    tree.feed(page)
    tree.close()

    def gone(n):
        return n["tag"] in html.SKIP or n["tag"] in ("script", "style", "noscript", "template", "textarea", "svg") or (n["tag"] not in ("body", "html", "article", "main") and bool(html.UNLIKELY.search(n["attrs"])))

    def text(n):
        return "".join(k if isinstance(k, str) else "" if gone(k) else f"\n{text(k)}\n" if k["tag"] in html.BLOCK or k["tag"] == "br" else text(k) for k in n["kids"])

    def squeeze(t):
        return re.sub(r"\s+", " ", t).strip()

    def links(n):
        return len(squeeze(text(n))) if n["tag"] == "a" else sum(links(k) for k in n["kids"] if not isinstance(k, str) and not gone(k))

    def density(n):
        size = len(squeeze(text(n)))
        return min(1.0, links(n) / size) if size else 0.0

    points, order, paragraphs = {}, [], 0

    def visit(n):
        nonlocal paragraphs
        for k in n["kids"]:
            if not isinstance(k, str) and not gone(k):
                visit(k)
        block = any(not isinstance(k, str) and k["tag"] in html.BLOCK for k in n["kids"])
        if n["tag"] in ("p", "pre", "td") or (n["tag"] == "div" and not block):
            t = squeeze(text(n))
            if len(t) >= html.MIN_PARAGRAPH:
                paragraphs += 1
                own, up, level = 1 + t.count(",") + min(len(t) / 100, 3), n["up"], 0
                while up is not None and up["tag"] not in ("#root", "html"):
                    if id(up) not in points:
                        points[id(up)] = html.BASE.get(up["tag"], 0)
                        order.append(up)
                    points[id(up)] += own / (1 if level == 0 else 2 if level == 1 else 3 * level)
                    up, level = up["up"], level + 1

    visit(tree.root)
    best, top = None, 0.0
    for n in order:
        points[id(n)] *= 1 - density(n)
        if points[id(n)] > top:
            best, top = n, points[id(n)]
    if best is None:
        return None, 0.0, paragraphs
    kept = []
    for x in best["up"]["kids"]:
        if isinstance(x, str) or gone(x):
            continue
        if x is best or (id(x) in points and points[id(x)] >= max(10.0, html.SIBLING_SHARE * top)) or (x["tag"] == "p" and len(squeeze(text(x))) > html.LONG_PARAGRAPH and density(x) < html.FEW_LINKS):
            kept.append(text(x))
    return html.tidy("\n".join(kept)), top, paragraphs


def test_html_text(spark):
    pages = {r["page_id"]: r["html"] for r in common.table(spark, SF, "pages").collect()}
    got = registry.op5_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    scored = 0
    for r in got:
        text, score, n = plain_extract(pages[r["page_id"]] or "")
        assert r["n_paragraphs"] == n and math.isclose(r["score"], score, rel_tol=1e-9, abs_tol=1e-9), r["page_id"]
        if text is not None:
            scored += 1
            assert r["text"] == text, r["page_id"]
    assert scored > len(pages) / 2


def plain_grams(text):
    """Hashed counts of the 2- and 3-grams of bytes, letters only."""
    low = text.lower()
    b = bytearray()
    for c in low:
        # a letter of any script counts, byte for byte; anything else is as many spaces
        b += c.encode() if c.isalpha() or (ord(c) > 127 and not (0x80 <= ord(c) < 0xC0 and c not in "ªµº") and c not in "×÷" and not 0x2000 <= ord(c) < 0x2080 and not 0x3000 <= ord(c) < 0x3040) else b" " * len(c.encode())
    out = Counter()
    for n in (2, 3):
        for k in range(len(b) - n + 1):
            g = bytes(b[k : k + n])
            if g.strip(b" "):
                code = int.from_bytes(g, "big")
                out[((code + n) * 2654435761 & 0xFFFFFFFF) >> (32 - langid.DIMS_BITS)] += 1
    return out


def test_language_by_plain_cosine(spark, docs):
    model = langid.train(common.table(spark, SF, "documents"))
    grams = {i: plain_grams(t) for i, t, _ in docs}
    n = Counter(d for g in grams.values() for d in g)
    for d in range(0, langid.DIMS, 37):  # inverse document frequencies are over all documents
        assert math.isclose(model.idf[d], math.log((len(docs) + 1) / (n[d] + 1)) + 0.05, rel_tol=1e-4, abs_tol=1e-5)
    got = {r["doc_id"]: (r["language"], r["cosine"]) for r in registry.op6_language_id(spark, SF).collect()}
    wrong = 0
    for i, g in grams.items():
        v = np.zeros(langid.DIMS)
        for d, c in g.items():
            v[d] = math.log1p(c) * model.idf[d]
        v /= max(1e-12, math.sqrt(float(v @ v)))
        near = model.centroids.astype(float) @ v
        best = int(near.argmax())
        name = model.languages[model.owner[best]] if near[best] >= model.floor[best] and near[best] > 0 else "und"
        wrong += got[i][0] != name or abs(got[i][1] - near[best]) > 1e-4
    assert wrong == 0
    assert sum(got[i][0] == lang for i, _, lang in docs) >= 0.95 * len(docs)


def test_toxicity_by_plain_convolution(spark, docs):
    table = common.table(spark, SF, "documents")
    m = toxicity.train(table, common.table(spark, SF, "labels"))
    got = {r["doc_id"]: (r["score"], r["threshold"]) for r in registry.op8_toxicity(spark, SF).collect()}
    import pyarrow as pa

    for i, text, lang in docs:
        rows, _ = toxicity.features(pa.array([text], pa.large_string()))
        x = np.concatenate([m.table[rows].astype(float).sum(axis=1), np.zeros((toxicity.PAD, toxicity.DIM))])
        pooled, k = [], 0
        for w in toxicity.WIDTHS:
            f = m.filters[k * toxicity.FILTERS : (k + w) * toxicity.FILTERS].astype(float).reshape(w, toxicity.FILTERS, toxicity.DIM)
            k += w
            at = [sum(f[j] @ x[p + j] for j in range(w)) for p in range(max(1, len(rows)))]
            pooled += list(np.max(at, axis=0))
        z = float(np.maximum(np.array(pooled) + m.bias, 0) @ m.out + m.out_bias)
        score, limit = 1 / (1 + math.exp(-z)), m.thresholds.get(lang, m.common)
        if abs(score - limit) > 1e-4:
            assert (score > limit) == (i in got), i
        if i in got:
            assert abs(got[i][0] - score) < 1e-4 and got[i][1] == limit
