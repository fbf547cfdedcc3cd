"""Trained operators: accuracy on rows that they did not learn from, and planted leaks."""

import random
import time
from zlib import crc32

import numpy as np
import pytest

from tests.llm.fixtures import auc, docs_df
from tonearm.llm import decontaminate, html, page_samples, quality, toxicity
from tonearm.llm.common import read

SF = "/root/testdata/sf0.01"


def held_out(spark, rows, label):
    truth = {r["doc_id"]: r[label] for r in read(spark, SF, "labels").collect()}
    return zip(*[(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None])


def test_toxicity_on_held_out_rows(spark):
    rows = toxicity.op1_toxicity(spark, SF).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    # Some labels are noise: texts marked toxic without any toxic word.
    score, truth = held_out(spark, rows, "toxic")
    flagged = [t for s, t in zip(score, truth) if s >= 0.7]
    assert auc(score, truth) > 0.75 and sum(flagged) >= 0.95 * len(flagged) and sum(flagged) >= 0.7 * sum(truth)


def test_quality_on_held_out_rows(spark):
    rows = quality.op9_quality(spark, SF).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert auc(*held_out(spark, rows, "quality")) > 0.9


def test_one_label_gives_its_share():
    assert quality.fit(["a", "b"], [1, 1]).scores(["x", None]).tolist() == [1.0, 1.0]
    assert toxicity.fit([], [], []).scores(["x", None]).tolist() == [0.0, 0.0]


def test_pooling_takes_the_largest_response():
    m = toxicity.fit([f"good day number {i}" for i in range(40)] + [f"vile words number {i}" for i in range(40)], [0] * 40 + [1] * 40, [None] * 80)
    texts = ["vile words", "", "good day", "x", "vile"]
    ids = [m.lookup()[toxicity.word_buckets(t)] for t in texts]
    packed = toxicity.pool(m, ids)[0]
    for row, one in zip(packed, ids):
        emb = m.table[np.concatenate([one, [0, 0]]).astype(int)]
        for k, (w, f) in enumerate(zip(toxicity.WIDTHS, m.filters)):
            resp = [np.concatenate(emb[i : i + w]) @ f[:-1] + f[-1] for i in range(len(one))]
            want = np.maximum(np.max(resp, axis=0), 0) if resp else np.zeros(toxicity.FILTERS)
            assert np.allclose(row[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS], want, atol=1e-5)
    assert m.scores(["vile words"])[0] > m.scores(["good day"])[0]


def test_messages_give_exact_marginals():
    r = random.Random(5)
    parents = [-1] + [r.randrange(i) for i in range(1, 9)]
    own = [r.uniform(-2, 2) for _ in parents]
    kinds = [r.randrange(2) for _ in parents]
    pairs = [[[r.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(2)]
    mass = np.zeros((len(parents), 2))
    for bits in range(1 << len(parents)):
        s = [bits >> i & 1 for i in range(len(parents))]
        p = np.exp(sum(o * x for o, x in zip(own, s)) + sum(pairs[kinds[i]][s[parents[i]]][s[i]] for i in range(1, len(s))))
        mass[range(len(s)), s] += p
    assert np.allclose(html.pass_messages(parents, own, pairs, kinds)[0], mass[:, 1] / mass.sum(1))


def test_pages_not_trained_on():
    hit = miss = extra = 0
    for nodes, labels in page_samples.labelled_pages(60, 977):
        found = html.trained_model().marginals(nodes)
        for x, y, p in zip(nodes, labels, found):
            if x.text is not None:
                hit += len(x.text) * (y and p >= 0.5)
                miss += len(x.text) * (y and p < 0.5)
                extra += len(x.text) * (not y and p >= 0.5)
    assert 2 * hit / (2 * hit + miss + extra) > 0.95


PROSE = "The harbour was quiet that morning, and the boats lay still. Nobody had expected the storm to pass so soon. "
OTHER_LAYOUTS = {
    "whole page in a form": (f"<form action=/p><div id=top>Home <a href=/>Start</a></div><div class=content><h1>Quiet harbour</h1><p>{PROSE}</p><p>{PROSE}</p></div><input type=hidden name=v></form>", f"Quiet harbour {PROSE.strip()} {PROSE.strip()}"),
    "article in a form": (f"<article><form><p>{PROSE}</p><p>{PROSE}</p></form></article>", f"{PROSE.strip()} {PROSE.strip()}"),
    "control in a sentence": (f"<article><p>{PROSE}</p><p>Use the <button>Go</button> key.</p><p>{PROSE}</p></article>", f"{PROSE.strip()} Use the key. {PROSE.strip()}"),
    "table layout": (f"<table><tr><td><a href=a>One</a> <a href=b>Two</a> <a href=c>Three</a></td><td><p>{PROSE}<p>{PROSE}</td></tr></table>", f"{PROSE.strip()} {PROSE.strip()}"),
    "line breaks": (f"<body><div>{PROSE}<br><br>{PROSE}</div><div class=footer>&copy; 2020 Some House</div>", f"{PROSE.strip()} {PROSE.strip()}"),
    "own header and footer": (f"<article><header><h1>Lamps</h1></header><p>{PROSE}</p><footer>Tags</footer></article>", PROSE.strip()),
    "one short paragraph": ("<article><p>Short.</p></article>", "Short."),
    "short paragraph beside a menu": ("<nav><a href=/>Home</a></nav><article><p>Short.</p></article><footer>&copy; Some House</footer>", "Short."),
    "linked paragraph and sources": (f"<article><p>{PROSE}</p><p><a href='/q'>The full report of the commission</a></p><h2>Sources</h2><ul><li><a href='/a'>Harbour rolls</a></li><li><a href='/b'>City archive</a></li></ul></article>", f"{PROSE.strip()} The full report of the commission Sources Harbour rolls City archive"),
    "list of comments": (f"<article><h1>Lamps</h1><p>{PROSE}</p></article><h3>Responses</h3><ol class=\"commentlist\"><li><p>What a nice piece, thanks for it.</p></li><li><p>I do not agree at all.</p></li></ol>", f"Lamps {PROSE.strip()}"),
    "search form": (f"<form class=search><label>Find</label><input name=q><button>Go</button></form><main><p>{PROSE}</p><p>{PROSE}</p></main>", f"{PROSE.strip()} {PROSE.strip()}"),
    "quotation marks": (f"<main><p title=it's>{PROSE}</p><p data-x='a>b'>{PROSE}</p><p>1 < 2 &amp; 3 &gt; 2, as everybody knows by now.</p></main>", f"{PROSE.strip()} {PROSE.strip()} 1 < 2 & 3 > 2, as everybody knows by now."),
}


def test_shipped_weights_are_those_of_the_samples():
    made, found = html.retrain(), html.trained_model()
    assert set(made.weights) == set(found.weights)
    assert max(abs(v - found.weights[k]) for k, v in made.weights.items()) < 1e-3 and np.allclose(made.pairs, found.pairs, atol=1e-3)


def test_pages_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>Short.</p></article>", "x", "y", "z")], "page_id long, url string, html string, text string, _html string, n_chars string")
    assert [tuple(r) for r in html.extract_pages(rows).collect()] == [(1, "u", "Short.")]


@pytest.mark.parametrize("name", OTHER_LAYOUTS)
def test_layouts_that_the_samples_do_not_have(name):
    page, want = OTHER_LAYOUTS[name]
    assert html.trained_model().extract(f"<html><body>{page}</body></html>") == want


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 50_000, "<p>" * 50_000 + "</div>" * 50_000, "<a b=\"" * 100_000, "<b><div>" * 20_000 + "</b>" * 20_000, "<li>" * 50_000, "<!" * 100_000, "<form>" * 20_000 + "x"])
def test_time_grows_with_the_page(page):
    model, began = html.trained_model(), time.perf_counter()
    model.extract(page)
    assert time.perf_counter() - began < 5


def test_query_takes_what_the_model_takes(spark):
    """Every page's text is the join of the runs whose exact marginal, by the enumeration-tested messages, is at least a half."""
    model = html.trained_model()
    for r in html.op2_pages(spark, "/root/testdata/sf0.001").collect():
        page = next(x["html"] for x in read(spark, "/root/testdata/sf0.001", "pages").filter(f"page_id = {r['page_id']}").collect()) if r["page_id"] % 20 == 0 else None
        if page is not None:
            nodes = html.tree(page)
            assert r["text"] == " ".join(x.text for x, p in zip(nodes, model.marginals(nodes)) if x.text is not None and p >= 0.5) and r["n_chars"] == len(r["text"])


@pytest.fixture(scope="module")
def items(spark):
    return [(r[0], r[1]) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]


def test_planted_leaks_are_found_and_clean_texts_left(spark, items):
    r = random.Random(9)
    chosen = [x for x in items if len(decontaminate.normalised(x[1])) >= 60][:12]
    rows = []
    for n, (_, text) in enumerate(chosen):
        changed = list(text)
        for _ in range(len(text) // 30):
            changed[r.randrange(len(changed))] = r.choice("abcxyz ")
        rows.append((n, f"Some lead-in words. {text.upper()} And a tail.", None, None, None))
        rows.append((100 + n, f"Lead {''.join(changed)} tail", None, None, None))
        rows.append((200 + n, " ".join(r.sample(text.split(), len(text.split()))), None, None, None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: {h["item_id"] for h in x["hits"]} for x in decontaminate.find_leaks(docs_df(spark, rows), bench).collect()}
    for n, (item, _) in enumerate(chosen):
        assert item in got[n] and item in got[100 + n] and not got[200 + n]
    kept = {x["doc_id"] for x in decontaminate.drop_leaks(docs_df(spark, rows), bench).collect()}
    assert kept == {i for i, hits in got.items() if not hits}


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for c in item:
        prev, row = row, [row[0] + 1]
        for j, d in enumerate(text, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != d)))
    return min(row)


def test_decontamination_against_alignment_of_all_pairs():
    r = random.Random(4)
    letters = "abcde fgh"
    items = [(i, "".join(r.choice(letters) for _ in range(r.randint(30, 90)))) for i in range(12)]
    texts = []
    for _ in range(30):
        base = list(r.choice(items)[1])
        for _ in range(r.randint(0, len(base) // 8)):
            at = r.randrange(len(base))
            base[at : at + r.randint(0, 1)] = r.choice(letters) * r.randint(0, 2)
        texts.append(decontaminate.normalised("".join(r.choice(letters) for _ in range(r.randint(0, 60))) + " " + "".join(base) + " tail"))
    index = decontaminate.Index(items)
    got = {(t, i): d for t, i, d, *_ in index.matches(texts)}
    for t, text in enumerate(texts):
        for i, item in enumerate(index.items):
            d = brute_edits(item, text)
            assert got.get((t, i)) == (d if d <= index.edits[i] else None)
