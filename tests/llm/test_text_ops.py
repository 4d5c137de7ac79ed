"""Quality, personal data, pages, archives, decontamination."""

import base64
import collections
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import common, decontaminate, html_text, pii, quality, registry, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def odd_rows(spark, extra="label string"):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x", None), (None, "no id here", "c"), (5, "same text", "d"), (5, "same text", "d"), (6, "w" * 100_000 + " " + "1" * 5000, "e"), (7, " \n\t ", "f")]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


# ---------------------------------------------------------------- quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = registry.op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def plain_features(text):
    """The features of a text, one at a time."""
    raw = (text or "").encode()
    n = len(raw)
    kinds = dict.fromkeys(quality._CLASSES, 0)
    for c in raw:
        kinds[quality._CLASSES[quality._CLASS[c]]] += 1
    upper = kinds["upper"] + len(re.findall(rb"\xc3[\x80-\x9e]", raw))
    out = {f"share_{k}": v / max(n, 1) for k, v in kinds.items()}
    out["share_upper"] = upper / max(upper + kinds["lower"] + kinds["lead"], 1)
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    low = [w.lower() for w in words]
    some = max(len(words), 1)
    size = [len(w) for w in words]
    mean = sum(size) / some
    out |= {"log_bytes": np.log1p(n), "log_words": np.log1p(len(words)), "mean_word": mean, "std_word": np.sqrt(max(sum(float(x) ** 2 for x in size) / some - mean**2, 0)), "longest_word": np.log1p(max(size, default=0))}
    out["types"] = len(set(low)) / some
    out["top_word"] = max((low.count(w) for w in set(low)), default=0) / some
    out["same_next"] = sum(a == b for a, b in zip(low, low[1:], strict=False)) / some
    out["same_after_next"] = sum(a == b for a, b in zip(low, low[2:], strict=False)) / some
    out["distinct_pairs"] = len(set(zip(low, low[1:], strict=False))) / max(len(words) - 1, 1)
    count = lambda w, kind: sum(quality._CLASSES[quality._CLASS[c]] == kind for c in w)
    out["upper_words"] = sum(count(w, "upper") >= 2 and not count(w, "lower") for w in words) / some
    out["noisy_words"] = sum(count(w, "symbol") >= 2 for w in words) / some
    out["bar_words"] = sum(w == b"|" for w in words) / some
    out["run_bytes"] = sum(a == b and a not in b" \t" for a, b in zip(raw, raw[1:], strict=False)) / max(n, 1)
    lines = [x.lower() for x in re.split(rb"[\r\n]+", raw) if x]
    out["mean_line"] = np.log1p(n / max(len(lines), 1))
    out["repeated_lines"] = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return [out[f] for f in quality.FEATURES]


def test_scores_of_the_query_follow_from_plain_features(spark, docs):
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = [r for r in docs.collect() if len(r.text or "") < 20_000]
    x = np.array([plain_features(r.text) for r in rows])
    batch = pa.RecordBatch.from_pydict({"text": pa.array([r.text for r in rows], pa.string())})
    fast = np.concatenate([quality.features(b) for b in common.blocks(iter([batch]), size=5000)])
    assert np.allclose(x, fast, rtol=1e-9, atol=1e-9)
    got = {r.doc_id: r.score for r in registry.op1_quality(spark, SF).collect()}
    assert np.allclose([got[r.doc_id] for r in rows], model.score(fast), rtol=1e-9)


def test_held_out_is_never_null(spark):
    df = spark.createDataFrame([(None, "no id"), (1, "text")], "doc_id long, text string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    assert [r.h for r in df.select(held.alias("h")).collect()].count(None) == 0


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in m.pairs
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    # scoring is adding looked-up values
    at = [np.searchsorted(c, x[:5, f], "right") for f, c in enumerate(m.cuts)]
    by_hand = m.base + sum(t[a] for t, a in zip(m.tables, at, strict=True))
    by_hand += sum(t[np.searchsorted(m.coarse[f], x[:5, f], "right"), np.searchsorted(m.coarse[g], x[:5, g], "right")] for (f, g), t in zip(m.pairs, m.pair_tables, strict=True))
    assert np.allclose(m.logit(x[:5]), by_hand)


def test_models_without_both_classes():
    x = np.random.default_rng(1).random((10, len(quality.FEATURES)))
    assert np.allclose(quality.fit(x[:0], np.zeros(0)).score(x), 0.5)
    assert (quality.fit(x, np.ones(10)).score(x) > 0.99).all() and (quality.fit(x, np.zeros(10)).score(x) < 0.01).all()


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (6, None), (7, 3)], "doc_id long, quality int")
    df = odd_rows(spark, "score string")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(df.limit(0), quality.train(df.limit(0), labels.limit(0))).count() == 0
    same = quality.score(df, quality.train(df.repartition(3), labels.repartition(2))).collect()
    assert sorted((r.doc_id or 0, r.score) for r in same) == sorted((r.doc_id or 0, r.score) for r in got)


# ---------------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    odd = [int(x) for x in reversed(d)][::2]
    even = [2 * int(x) for x in reversed(d)][1::2]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def brute_spans(t):
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub(r"[ -]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    n = 0
    for _ in range(20_000):
        letters = rnd.choice(["ab@.-_ 1", "0123456789. ", "0123456789 -", "+0123456789 ().-", "aé@b.c1 25.+-@"])
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        want = brute_spans(t)
        n += len(want)
        assert pii.base_spans(t) == want, t
    assert n > 1000
    pii.base_spans("a" * 200_000 + " " + "1" * 200_000 + "." + "1." * 50_000)  # linear


def test_spans_of_the_documents(spark, docs):
    got = {r.doc_id: r for r in registry.op2_pii(spark, SF).collect()}
    for r in docs.collect():
        want = brute_spans(r.text or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, z, k in want)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[2] == k for s in want) for k in range(4)]
        assert set(text.split(",")) <= set(g.spans.split(",")) | {""}


def test_disclosing_terms(spark):
    rnd = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(300):
        ws = [rnd.choice(words) for _ in range(40)]
        if i % 30 == 0:
            ws[20:21] = ["Zanzibarian", "chief", "joe@x.example.com"]
        rows.append((i, " ".join(ws), "k"))
    rows += [(1000, "plain zanzibarian é word1", "x"), (None, "joe@x.example.com zanzibarian", "n"), (1001, None, None), *rows[:2], (0, "another text of id zero", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, places string")
    got = pii.spans(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.spans for r in got if r.doc_id not in (None, 0)}
    assert by[1000] == "term:6:17" and by[30].count("term:") == 2 and "term" not in by[31]
    clean = {(r.doc_id, r.places): r.text for r in pii.sanitise(df).collect()}
    assert clean[1000, "x"] == "plain  é word1" and "[EMAIL]" in clean[30, "k"] and "anzibarian" not in clean[30, "k"]
    assert "zanzibarian" not in clean[None, "n"]
    odd = df.withColumnRenamed("places", "_places").withColumn("id", F.lit(1)).withColumn("mark", F.lit("m")).withColumn("row", F.lit(2))
    again = pii.sanitise(odd)
    assert again.columns == odd.columns and {(r.doc_id, r._places): r.text for r in again.collect()} == clean
    by_name = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {(r.doc_id, r.places): r.text for r in pii.sanitise(by_name).collect()} == {(i if i is None else f"d{i}", p): t for (i, p), t in clean.items()}
    assert clean[1001, None] is None and clean[0, "z"] == "another text of id zero" and clean[None, "n"].startswith("[EMAIL]")


def plain_terms(texts):
    """Term spans of each text, from the definition."""
    split = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")] for t in texts]
    base = [brute_spans(t or "") for t in texts]
    n_e, near, ways = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for t, words, spans in zip(texts, split, base, strict=True):
        free = [w for w in words if not any(w[0] < z and w[1] > a for a, z, _ in spans)]
        for a, z, k in spans:
            e = pii.canonical(k, t[a:z])
            around = [w[2] for w in free if w[1] <= a][-5:] + [w[2] for w in free if w[0] >= z][:5]
            n_e[e] += 1
            for w in set(around):
                near[e, w] += 1
                ways[e, w].add(tuple(around))
    n_t = collections.Counter(w[2] for words in split for w in words)
    total = sum(n_t.values())
    found = {}
    for (e, w), n in near.items():
        info = np.log2(total / n_e[e])
        if len(ways[e, w]) >= 3 and info > 0:
            found[w] = max(found.get(w, -9), 1 + np.log2(min(n / max(n_t[w], n), 1)) / info)
    out = []
    for words, spans in zip(split, base, strict=True):
        mine = [(a, z, 4) for a, z, w in words if found.get(w, 0) >= pii.GENERALISE and not any(a < y and z > x for x, y, _ in spans)]
        out.append(pii.spans_text(sorted(spans + mine, key=lambda s: (s[0], s[2], s[1]))))
    return out


def test_term_spans_follow_the_definition(spark):
    rnd = random.Random(12)
    people = [(f"Name{i}", f"p{i}@x.example.com") for i in range(12)]
    texts = [None, "", "é Name1 alone", "+49 170 1234567 hotline Kim"]
    for _ in range(400):
        w = [f"w{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(rnd.randint(3, 30))]
        if rnd.random() < 0.4:
            name, mail = rnd.choice(people)
            w[rnd.randrange(len(w)) : 0] = [rnd.choice((name, name, "Öl")), rnd.choice(("", "chief")), mail]
        if rnd.random() < 0.05:
            w.append(rnd.choice(people)[0])
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.spans for r in pii.spans(df).collect()}
    want = plain_terms(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum("term" in s for s in want) > 20


def test_short_names_are_disclosing_terms(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        ws = [rnd.choice(["of", "to", "in"]) if k % 5 == 0 else f"word{rnd.randrange(400)}" for k in range(40)]
        if i % 20 == 0:
            ws[20:21] = ["Lee", "joe@x.example.com"]
        rows.append((i, " ".join(ws)))
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Lee" not in got[i] and "[EMAIL]" in got[i] for i in range(0, 200, 20))
    assert all(got[i] == t for i, t in rows if i % 20)


def test_terms_are_generalised_to_the_kind_they_are_tied_to():
    spans = [(0, 5, 0), (10, 30, 3), (12, 20, 2)]
    places = [{"start": a, "end": z} for a, z in ((5, 9), (4, 7), (25, 33), (31, 33))]
    assert pii._with_terms(spans, places) == [(0, 5, 0), (5, 9, 4), (10, 30, 3), (12, 20, 2), (31, 33, 4)]


def test_many_entities_take_linear_time():
    t = " ".join(f"wörd{i} u{i}@x.example.com" for i in range(20_000))
    batch = pa.RecordBatch.from_pydict({"text": [t]})
    began = time.monotonic()
    assert sum(b.num_rows for b in pii.near_entities(iter([batch]), "text")) > 100_000
    assert time.monotonic() - began < 20


def test_personal_data_of_odd_rows(spark):
    df = odd_rows(spark, "places string")
    assert pii.spans(df).count() == 8 and pii.sanitise(df).count() == 8
    assert pii.sanitise(df).columns == df.columns
    assert pii.spans(df.limit(0)).count() == 0 and pii.sanitise(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pages


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in registry.op4_html_text(spark, SF).collect()}
    for r in pages.collect():
        a = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<p>|</p>|</?h1>", a)]
        assert got[r.page_id].text == "\n".join(x for x in want if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a<p>b &amp; c<script>x</p></script>d<ul><li>1<li>2</ul>", "a\nb & cd\n1\n2"),
        ("<div class='ad'>x</div>text<br>more", "text more"),
        ("<article><header><h1>T</h1></header><p>x</p><div class=comments>c</div></article><p>out", "T\nx"),
        ("", ""), ('<p title="a>b">x</p><a href="u>t', "x\nt"), ("<b>un<i>closed", "unclosed"), ("<main><p>1</p></p></main> z", "1"),
        ("<!-- x", ""), ("a < b &lt; c", "a < b < c"), ("<td>x<td>y", "x\ny"), ("<p>&nbsp;&#228;&#x41;\n\n b</p>", "äA b"), ("<form><p>f</p></form><aside>s</aside>k", "k"),
        ('<article><p>a</p><div id="cookie-notice">c</div><ol class="commentlist"><li>r</ol><div class="lead advertised-not">b</div></article>', "a\nb"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(html_text.parse(page)[0]) == want


def test_deep_and_stray_elements_take_linear_time():
    began = time.monotonic()
    for page in ("<div>" * 30_000 + "x", "<p><table><td>" + "<div>" * 30_000 + "x", "</i>" * 30_000 + "x", "<li>" + "<b>" * 30_000 + "x<li>y", "<div>" * 9 + "</b>" * 30_000 + "x"):
        top, ended = html_text.parse(page)
        html_text.mark_subtrees(ended)
        assert html_text.main_text(top).startswith("x")
    assert time.monotonic() - began < 10


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_templates_without_names(spark, monkeypatch, few):
    """Neither declared content nor telling names: counts decide alone, by either join."""
    monkeypatch.setattr(html_text, "FEW_TEMPLATES", few)
    page = '<div class=a1><ul><li>Home<li>News</ul></div><div class=b2><p>Story {i}</p><div class=c3>{ad}</div></div><div class=d4>All rights</div>'
    rows = [(i, f"https://h{i % 2}.example/{i}", page.format(i=i, ad=f"Buy {i % 2}" if i % 3 else f"Seen {i}")) for i in range(24)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}" + ("" if i % 3 else f"\nSeen {i}") for i in range(24)}


def test_templates_are_counted_by_host(spark):
    frame = "<div><p>Welcome to our site</p></div><div><p>Text {i} of its own</p></div><table><tr><td>legal line</table>"
    rows = [(i, f"https://User@Site{i % 2}.example/p{i}", frame.format(i=i), "x") for i in range(20)]
    rows += [(100, "https://other.example/", frame.format(i=100), "x"), (101, None, None, None), (None, "", "<p>n", None), (5, rows[5][1], rows[5][2], "x")]
    got = [(r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert all(by[i] == f"Text {i} of its own" for i in range(20)) and by[100].startswith("Welcome") and by[101] == "" and by[None] == "n"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapped_articles_are_no_templates(spark):
    one = "<body><div id=page><nav>n</nav><article><p>Story {i}</article></div>"
    two = "<body><div id=page><p>Welcome</p><div class=col><main><p>Story {i}</main></div></div>"
    rows = [(10 * k + i, f"https://h{k}.example/{i}", page.format(i=10 * k + i)) for k, page in enumerate((one, two)) for i in range(6)]
    got = dict((r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == {i: f"Story {i}" for i, _, _ in rows}


def test_counts_decide_inside_declared_content(spark):
    page = "<article><h2>Summary</h2><p>Story {i} of its own</p><p>Read our other stories</p></article>"
    rows = [(i, "https://a.example/", page.format(i=i)) for i in range(8)]
    # published nine times: copies count once, here and where it is the only article
    rows += [(100 + i, f"https://{h}.example/", "<article><p>Alpha</p><p>Beta</p></article>") for i, h in enumerate("a" * 9 + "b" * 9)]
    # paragraphs under the share stay; what would go to the last word stays
    rows += [(200 + i, "https://c.example/", f"<main><p>Part {i}</p><p>Twice {i // 3}</p></main>") for i in range(9)]
    rows += [(300 + i, "https://d.example/", f"<main><p>Same</p>{'<p>x' + str(i) if i else ''}</main>") for i in range(4)]
    got = dict((r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert all(got[i] == f"Summary\nStory {i} of its own" for i in range(8))
    assert {got[100 + i] for i in range(18)} == {"Alpha\nBeta"}
    assert all(got[200 + i] == f"Part {i}\nTwice {i // 3}" for i in range(9))
    assert [got[300 + i] for i in range(4)] == ["Same", "x1", "x2", "x3"]


def test_words_of_names_decide_for_whole_boxes():
    page = "<article><h2 id=side-effects>Side effects</h2><section id=related-work><h3 class=social>R</h3><p class=notice>n</p></section><div class='related-posts x'>r</div><ul id=share_buttons><li>s</ul></article>"
    assert html_text.main_text(html_text.parse(page)[0]) == "Side effects\nR\nn"


def test_large_hosts_keep_words_that_recur(spark):
    page = "<div><p><b>Note:</b> text {i} <a>here</a></p><h2>Summary</h2><table><tr><td>Yes</td><td>{i}</td></table><div>{few}</div><div>On all pages</div></div>"
    rows = [(i, "https://big.example/", page.format(i=i, few="On some pages" if i < 60 else f"Only {i}")) for i in range(400)]
    got = dict((r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert all(got[i] == f"Note: text {i} here\nSummary\nYes\n{i}\n" + ("On some pages" if i < 60 else f"Only {i}") for i in range(400))


# ---------------------------------------------------------------- archives


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a.example/x?q", "<p>é</p>"), (2, "http://b.example", "<p>é</p>"), (3, None, None), (4, "u\r\nWARC-Type: fake", "\r\n\r\nWARC/1.1\r\n"), (9, "http://a.example/x?q", "<p>é</p>"), (9, "http://a.example/x?q", "<p>é</p>"), (None, "n", "only"), (12, "", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    warc.write(df, f"file://{tmp_path}/w")
    got = warc.captures(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    find = lambda i: [r for r in got if r.page_id == (None if i is None else str(i))]
    for i, _, body in rows:
        raw = (body or "").encode()
        for r in find(i):
            assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and r.payload_bytes == len(raw)
            assert r.request.uri == r.uri and f"payload-length: {len(raw)}" in r.metadata.fields
            if r.record.kind == "response":
                assert bytes(r.record.payload) == raw
    assert {(r.record.kind, r.refers_to_page) for i in (1, 2) for r in find(i)} == {("revisit", "9")}
    assert [r.record.kind for r in find(9)] == ["response"] * 2 and find(3)[0].refers_to_page == "12"
    big = warc.write(df, f"file://{tmp_path}/big", min_revisit_bytes=1) or warc.captures(spark, f"file://{tmp_path}/big").collect()
    assert {r.page_id for r in big if r.record.kind == "revisit"} == {"1", "2"}
    warc.write(df.limit(0), f"file://{tmp_path}/none")
    assert warc.captures(spark, f"file://{tmp_path}/none").count() == 0


def test_revisits_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    last = {}
    for r in pages:
        last[r.html] = max(r.page_id, last.get(r.html, -1))
    want = {(r.page_id, len(r.html.encode()), "response" if last[r.html] == r.page_id else "revisit", None if last[r.html] == r.page_id else last[r.html]) for r in pages}
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in registry.op8_warc(spark, SF).collect()} == want


# ---------------------------------------------------------------- decontamination


def test_items_that_stand_in_documents_are_found(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in registry.op9_decontaminate(spark, SF).collect()}
    assert held and held == got


def test_wand_equals_scoring_everything():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words[: rnd.choice((30, 300))]) for _ in range(rnd.randint(3, 40)))) for i in range(120)]
    ix = decontaminate.build(items)
    for _ in range(60):
        terms = np.unique(np.array([rnd.randrange(len(ix.terms)) for _ in range(40)]))
        score = np.zeros(len(ix.item_ids))
        for t in terms:
            np.add.at(score, ix.items[ix.starts[t] : ix.starts[t + 1]], ix.impact[ix.starts[t] : ix.starts[t + 1]])
        want = {int(i) for i in np.flatnonzero(score >= 0.3)}
        got = {i for b in range(ix.block_max.shape[1]) for i, _ in decontaminate._wand(ix, terms, b, 0.3)}
        assert got == want


def test_question_and_answer_must_both_stand_there(spark):
    question, answer = "Which river crosses the old stone town of Lumbria near its ruined northern gate?", "The silver Ondra river crosses it."
    items = spark.createDataFrame([(1, f"{question} {answer}"), (2, None), (3, ""), (4, "?!"), (None, "no id")], "item_id long, text string")
    pad = " ".join(f"filler{i}" for i in range(200))
    rows = [(1, f"{pad} {question.upper()}  {answer} {pad}", "a"), (2, f"{pad} {question} {pad}", "b"), (3, f"{answer} {pad}", "c"), (4, None, None), (5, "", ""), (None, f"{question}\n{answer}", "n"), (7, pad, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    assert {r.doc_id for r in decontaminate.hits(df, items).collect()} == {1, None}
    kept = decontaminate.clean(df, items)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 7} and kept.columns == df.columns
    assert decontaminate.clean(df, items.limit(0)).count() == 7 and decontaminate.hits(df.limit(0), items).count() == 0


def test_near_copies_of_items_are_found(spark):
    question, answer = "Which river crosses the old stone town of Lumbria near its ruined northern gate?", "The silver Ondra river crosses it."
    short = "How many bridges did the masons of Lumbria raise over that river before winter came? Nine stone bridges."
    items = spark.createDataFrame([(1, f"{question} {answer}"), (2, short)], "item_id long, text string")
    pad = " ".join(f"filler{i}" for i in range(50))
    one = f"{question.replace('town', 'city')} {answer.replace('Ondra', 'Undra')}"
    two = f"{question.replace('stone', 'rock').replace('ruined', 'broken')} {answer.replace('silver', 'wide').replace('crosses', 'cuts')}"
    more = f"{question.replace('old', 'very old')} Well: {answer.replace('Ondra', 'Ondra-like')}"
    brief = short.replace("masons", "builders").replace("Nine stone", "Nine wooden")
    rows = [one, two, more, brief, question, f"{question} {pad} {answer[::-1]}", f"{short[: short.index('?')]}? Nobody ever counted.", " ".join(reversed(f"{question} {answer}".split())), f"{answer} {pad}"]
    df = spark.createDataFrame([(i, f"{pad} {t} {pad}") for i, t in enumerate(rows)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.hits(df, items).collect()} == {(0, 1), (1, 1), (2, 1), (3, 2)}
    assert {r.doc_id for r in decontaminate.clean(df, items).collect()} == {4, 5, 6, 7, 8}
