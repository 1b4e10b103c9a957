"""Operators on Spark: brute force over the smallest tables, and tables of awkward rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phredloom.llm import decontaminate, html_extract, near_dedup, packing, pii, quality, queries, suffix_dedup, token_count, topk, warc
from phredloom.llm.common import materialize, table
from phredloom.llm.components import components

DIR = "/root/testdata/sf0.001"
CLASH = ["row", "key", "n", "sig", "bands", "spans", "a", "b", "h", "pos", "m", "rep", "score", "label", "d", "r", "y", "q", "core", "seg", "match", "id", "bucket", "shard"]
PARA = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "


def awkward(spark, texts):
    """documents with extra columns whose names are used inside operators."""
    rows = [(i, t, None if k % 3 else "en", None, None) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    long = "x1@ " + "word " * 60_000 + "9" * 5000 + " " + "." * 5000 + "1"
    return awkward(spark, [(1, PARA * 9), (1, PARA * 9), (2, None), (3, ""), (None, PARA * 3), (None, None), (4, long), (5, " \n\t "), (6, "one two"), (7, PARA * 9 + "more")])


def docs_of(spark, d=DIR):
    return table(spark, d, "documents")


def test_scratch_tables_are_in_the_shared_folder(spark):
    got = materialize(spark.range(3))
    assert got.count() == 3
    assert spark.conf.get("spark.checkpoint.dir") in got.inputFiles()[0]


def test_components(spark):
    edges = [(5, 9), (9, 2), (2, 7), (10, 11), (3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 2, 5: 2, 7: 2, 9: 2, 10: 10, 11: 10}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------ html
def test_html_on_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x</p></article>"), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_equals_a_plain_parser(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag in ("p", "h1", "br"):
                self.out.append("")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False
            if tag in ("p", "h1"):
                self.out.append("")

        def handle_data(self, data):
            if self.inside:
                self.out[-1] += data

    pages = table(spark, DIR, "pages")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r["html"])
        assert got[r["page_id"]] == "\n".join(t for t in (" ".join(x.split()) for x in p.out) if t)


def test_long_quoted_values_stay_in_their_tag():
    import time

    for q, inner in (("'", '"'), ('"', "'")):
        value = f"<div class={inner}ad{inner}>gone</article> > " * 2000
        page = f"<article><p data-props={q}{value}{q}>First line.</p><p>Second line.</p></article><p>Outside.</p>"
        assert html_extract.main_text(page) == "First line.\nSecond line."
    t = time.time()
    assert html_extract.main_text("<article>" + "<p title=\"a title='b>x</p>" * 50_000).count("x") > 0
    assert html_extract.main_text("<article><p>x</p>" + "<a b=\"" * 50_000).startswith("x")
    assert time.time() - t < 20


def test_articles_inside_elements_known_by_class():
    p, long = "<p>Some text.</p>", "<p>" + "words of a long teaser " * 9 + "</p>"
    for c in ("content-sidebar-wrap", "has-sidebar", "no-sidebar", "with-header", "sidebar", "page widget"):
        for tag in ("main", "article", "section itemprop='articleBody'"):
            page = f"<div class='{c}'><{tag}>{p}</{tag.split()[0]}><p>Aside.</p></div><p>Foot.</p>"
            assert html_extract.main_text(page) == "Some text.", (c, tag)
    inside = "<article><p>a</p><div class='related-work'>b</div><section class='social-history'>c</section><div class='related-posts'>d</div><div id='comment-list'>e</div></article>"
    assert html_extract.main_text(inside) == "a\nb\nc"
    assert html_extract.main_text(f"<article>{p}</article><div class='sidebar'><article>{long}</article></div>") == "Some text."
    assert html_extract.main_text(f"<div>{long}</div><div id='comments'><article>{long * 3}</article></div>").count("\n") == 0
    assert html_extract.main_text(f"<div class='sidebar'><div hidden><article>{p}</article></div><nav><main>{p}</main></nav></div>") == ""
    assert html_extract.main_text(f"<div hidden><article>{long}</article></div>") == ""


# ------------------------------------------------------------ quality
def test_quality_held_out_accuracy(spark):
    docs, labels = docs_of(spark, "/root/testdata/sf0.1"), table(spark, "/root/testdata/sf0.1", "labels")
    s = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = s[s.quality == 1].score.to_numpy(), s[s.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    assert (s.predicted == s.quality).mean() > 0.98
    assert s.score.between(0, 1).all()


def test_quality_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, None), (6, 0, 0), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score(odd, quality.train(odd, labels.limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score(odd.limit(0), quality.train(odd.limit(0), labels)).count() == 0
    assert quality.keep_good(odd, quality.train(odd, labels.limit(0))).columns == odd.columns


def test_training_rows_are_bounded_for_a_repeated_id(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text")).union(spark.createDataFrame([(8, "bad bad bad")] * 500, "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, y: seen.append((len(rows), sum(r.nbytes for r in rows))) or len(rows))
    assert quality.train(docs, labels, sample=100) == 100
    assert 1 <= quality.train(docs, labels, sample=100, most_bytes=2000) < 100 and seen[-1][1] <= 2 * 2000
    assert quality.train(docs, labels, sample=10, most_bytes=0) == 1
    assert quality.train(docs.filter("doc_id = 8"), labels) == 1


def dual_by_projected_gradient(x, y, upper, steps=40_000):
    """Another solver of the same dual (boxed quadratic program over unit rows and a constant), for comparison."""
    z = np.hstack([x, np.ones((len(x), 1))]) * y[:, None]
    q = z @ z.T
    a, rate = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(steps):
        a = np.clip(a - rate * (q @ a - 1), 0, upper)
    return a @ q @ a / 2 - a.sum(), z.T @ a


def test_dual_descent_solves_the_dual():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(60)]
    y = np.where([(3 in r) ^ (rng.random() < 0.1) for r in rows], 1.0, -1.0)
    scale = rng.normal(size=30)
    x = np.zeros((60, 30))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / max(1e-9, np.sqrt((scale[r] ** 2).sum()))
    upper = np.where(y > 0, 0.1 * 60 / (2 * (y > 0).sum()), 0.1 * 60 / (2 * (y < 0).sum()))
    best, w = dual_by_projected_gradient(x, y, upper)
    got, b = quality.dual_descent(rows, y, scale, cost=0.1, epochs=400)
    assert np.allclose(np.append(got, b), w, atol=1e-3)
    assert best < 0


# ------------------------------------------------------------ packing
def test_packing_is_whole_and_within_budget(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([None, 0, 5, 5, 9000, 120, 3, -2, 40] * 50)], "doc_id long, n long").withColumn("bucket", F.lit(1))
    got = packing.pack(df, "doc_id", "n", n_buckets=4, token_budget=500, ranges=20).toPandas()
    assert sorted(got.doc_id) == list(range(450)) and (got.padding >= 0).all()
    for (b, k), g in got.groupby(["bucket", "batch_no"]):
        assert len(g) <= g.capacity.iloc[0] and sorted(g.slot) == list(range(len(g)))
        assert len(g) == 1 or g.bucket_len.iloc[0] * len(g) <= 500
    for _, g in got.groupby("bucket"):
        assert sorted(set(g.batch_no)) == list(range(g.batch_no.max() + 1))
        assert len(g) > (g.batch_no.max()) * g.capacity.iloc[0]
    v, c = np.unique(got.n_tokens, return_counts=True)
    bounds = packing.boundaries(v, c, v * c, 4)
    assert got.padding.sum() <= sum(min(b for b in bounds if b >= x) - x for x in got.n_tokens) + 9000 // 2048 * 50 + 50 * 8
    assert packing.pack(df.limit(0), "doc_id", "n").count() == 0


def test_packing_of_long_texts_has_the_least_padding(spark):
    from itertools import combinations

    n = [5461, 5461, 5459, 5001, 4999, 4999, 4999, 20_020, 20_011, 20_011, 7, 7, 4097]
    got = packing.pack(spark.createDataFrame(list(enumerate(n)), "doc_id long, n long"), "doc_id", "n", n_buckets=4).toPandas()
    *rest, top = sorted(set(n))
    want = min(sum(min(b for b in (*bounds, top) if b >= x) - x for x in n) for bounds in combinations(rest, 3))
    assert got.padding.sum() == want
    assert (got.groupby("bucket").n_tokens.max() == got.groupby("bucket").bucket_len.first()).all()
    assert set(got[got.bucket_len == 5461].capacity) == {3} and got.bucket_len.max() == 20_020


def test_word_tokens(spark, odd):
    got = odd.select("doc_id", packing.word_tokens(F.col("text")).alias("n"), "text").collect()
    for r in got:
        assert r["n"] == len(re.findall(r"[^ \t\n\x0b\f\r]+", r["text"] or ""))


# ------------------------------------------------------------ token counts
def test_token_counts_equal_greedy(spark, odd):
    pieces = token_count.piece_vocabulary(token_count.default_vocabulary_path())
    known = set(pieces)
    docs = docs_of(spark).limit(20).select("doc_id", "text").union(odd.filter("length(text) < 1000 or text is null").select("doc_id", "text"))
    got = sorted(((r["doc_id"] or -1), r["n_words"], r["n_tokens"], r["n_unknown"]) for r in token_count.count_tokens(docs, pieces).collect())
    want = []
    for r in docs.collect():
        words = re.findall(r"\w+|[^\w\s]", r["text"] or "")
        sizes = [token_count.greedy_count(w, known) for w in words]
        want.append((-1 if r["doc_id"] is None else r["doc_id"] or -1, len(words), sum(1 if s < 0 else s for s in sizes), sum(s < 0 for s in sizes)))
    assert got == sorted(want)


# ------------------------------------------------------------ decontamination
BENCH = ["A train leaves the station at 9 with 120 passengers and Maria counts 15 kg of mail before the bridge.", "short item here", "", None]


def test_decontamination_cases(spark, odd):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(BENCH)], "item_id long, text string").withColumn("h", F.lit(1))
    texts = [
        (1, "Intro. " + BENCH[0] + " The end."),
        (2, BENCH[0].replace("9", "7").replace("120", "88").replace("Maria", "Peter").replace("15", "4")),
        (3, "A train leaves the station. Nothing else matches the rest of that."),
        (4, "well short item here again"),
        (5, BENCH[0].upper()),
        (6, None),
        (None, BENCH[0]),
        (7, BENCH[0].replace("with 120 passengers", "with 33 visitors")),
    ]
    docs = awkward(spark, texts)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert {k for k in got} >= {(1, 0), (2, 0), (None, 0), (4, 1)}
    assert not {k for k in got if k[0] in (3, 6)}
    assert got[2, 0]["reparameterised"] and not got[1, 0]["reparameterised"]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {3, 6, None} | ({5, 7} - {k[0] for k in got})
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(odd, bench).count() == 0


def test_copies_are_found_whatever_stands_before_their_words(spark):
    short, long = "Does Rome lie north of Naples today", "Please tell me how often the old ferry and Maria cross the wide river in one summer."
    bench = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    docs = awkward(spark, [(1, "we ask " + short + " or not"), (2, "First. " + long.replace(" Maria", "\nMaria")), (3, "so " + long), (4, "we ask Does Rome lie south of Naples today or not")])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 1), (2, 2), (3, 2)}


def test_copies_are_found_in_any_case(spark):
    short = "Does Maria see 15 kg"
    bench = spark.createDataFrame([(0, BENCH[0]), (1, short)], "item_id long, text string")
    texts = [(5, BENCH[0].upper()), (6, BENCH[0].lower()), (7, BENCH[0].replace("15 kg", "15 KG")), (8, BENCH[0].upper().replace("120", "88")), (9, short.upper()), (10, "now " + short.lower())]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(awkward(spark, texts), bench).collect()}
    assert set(got) == {(5, 0), (6, 0), (7, 0), (8, 0), (9, 1), (10, 1)}
    assert [k for k, r in got.items() if r["reparameterised"]] == [(8, 0)]
    assert all(got[i, 0]["matched"] == 13 for i in (5, 6, 7))


def test_inconsistent_slots_do_not_count(spark):
    item = "take 5 apples and 5 pears and then 5 plums and again 5 figs from the old basket today"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = awkward(spark, [(1, item.replace("5", "8")), (2, "take 1 apples and 2 pears and then 3 plums and again 4 figs from the old basket today")])
    got = {r["doc_id"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1}


def test_an_edited_repeat_leaves_the_other_windows(spark):
    item = "a farmer has 5 cows in the barn and walks along the river every day before noon to feed them while the neighbour who owns 5 sheep stays at home with the dog"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = awkward(spark, [(1, item.replace("5 sheep", "6 sheep")), (2, item.replace("5 cows", "7 cows").replace("5 sheep", "6 sheep")), (3, item.replace("5", "8"))])
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench).collect()}
    n = len(item.split())
    assert {i: (r["matched"], r["item_windows"], r["reparameterised"]) for i, r in got.items()} == {1: (n - 7 - 8, n - 7, False), 2: (n - 7 - 8 - 4, n - 7, False), 3: (n - 7, n - 7, True)}


def decontaminated(docs, items, window=8, least=6):
    """The whole rule in plain Python: (doc, item) -> (matched, item_windows, reparameterised)."""
    import regex

    N, A, U = "<n>", "<a>", "<u>"
    fold = lambda s: s.upper().lower()
    units = "|".join(decontaminate.UNITS)

    def tokens(text):
        marked = regex.sub(r"(?<=[\p{Ll},;]\s)\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "\ue001", text)
        marked = regex.sub(r"[+-]?\p{Nd}[\p{Nd}.,:/]*", "\ue000", marked)
        marked = regex.sub(rf"(\ue000\s?)(?i:{units})(?!\p{{L}})", "\\1\ue002", marked)
        cut = lambda s: regex.sub(r"\s+", " ", regex.sub(r"[^\p{L}\p{N}\s\ue000-\ue002]+", "", fold(s))).strip(" ").split(" ")
        names = {"\ue000": N, "\ue001": A, "\ue002": U}
        t = [names.get(x, x) for x in cut(marked)]
        r = cut(text)
        return t, r, [y if x == A else x for x, y in zip(t, r, strict=True)]

    out = {}
    for j, item in items:
        it, ir, iu = tokens(item or "")
        if it == [""]:
            continue
        n = min(window, len(it))
        places = range(len(it) - n + 1)
        for i, doc in docs:
            dt, dr, du = tokens(doc or "")
            counted, changed = set(), False
            found = {}  # shift -> [(place, slots)]
            for a in places:
                w = it[a : a + n]
                slots = [x for x in range(n) if w[x] in (N, A, U)]
                bare = not slots or len(slots) == n or sum(it[b : b + n] == w for b in places) > 1
                for p in range(len(dt) - n + 1):
                    if (bare or iu[a : a + n] == ir[a : a + n]) and dr[p : p + n] == ir[a : a + n]:
                        counted.add(a)
                    if bare:
                        continue
                    for dk, ik in ((dt, it), (du, iu)):
                        v = [x for x in range(n) if ik[a + x] in (N, A, U)]
                        if v and dk[p : p + n] == ik[a : a + n]:
                            found.setdefault(p - a, []).append((a, [(ir[a + x], dr[p + x]) for x in v]))
            for hits in found.values():
                given = {}
                for _, values in hits:
                    for asked, got in values:
                        given.setdefault(asked, set()).add(got)
                for a, values in hits:
                    if not any(x != y and len(given[x]) > 1 for x, y in values):
                        counted.add(a)
                        changed |= any(x != y for x, y in values)
            if len(counted) >= min(len(places), least):
                out[i, j] = (len(counted), len(places), changed)
    return out


def test_decontamination_equals_brute_force_on_changed_items(spark):
    import random

    rng = random.Random(12)
    words = "a train leaves the old station with many people and counts 9 12 120 15 kg km Maria Peter Rome of mail before 7 bridges while 3 cows eat 5 apples and".split()
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 30))) for _ in range(25)]
    items = [*enumerate(texts), (90, "1 2 3 4 5 6 7 8 9 10 11 12"), (91, "5 kg and 5 kg and 5 kg and 5 kg and 5 kg and 5 kg"), (92, None), (93, "12")]
    docs = []
    for i in range(120):
        t = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.4:
            to = str(rng.randint(20, 40))
            t = [to if x == "9" else x for x in t]
        text = " ".join([*rng.choices(words, k=rng.randint(0, 12)), *t, *rng.choices(words, k=rng.randint(0, 12))])
        docs.append((i, text.upper() if rng.random() < 0.1 else text))
    docs += [(200, items[25][1]), (201, items[26][1].replace("5", "6")), (202, items[26][1]), (203, "7 8 9 10 11 12 13 14 15 16 17 18"), (204, ""), (205, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["item_windows"], r["reparameterised"]) for r in decontaminate.contaminated(awkward(spark, docs), bench).collect()}
    want = decontaminated(docs, items)
    assert got == want and len(got) > 60 and any(x[2] for x in got.values())


def test_a_row_of_numbers_meets_no_list_of_numbers(spark):
    item = " ".join(str(1000 + i) for i in range(60))
    bench = spark.createDataFrame([(1, item), (2, "and 5 cows " * 30)], "item_id long, text string")
    docs = awkward(spark, [(1, " ".join(str(i) for i in range(5000, 105_000))), (2, "and 6 cows " * 20_000), (3, "x " + item), (4, "and 5 cows " * 20_000)])
    hits = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert hits == {(3, 1): 53, (4, 2): 83}


def test_decontamination_equals_brute_force_on_verbatim_items(spark):
    docs, bench = docs_of(spark), table(spark, DIR, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    norm = lambda s: " ".join(re.sub(r"[^\w\s]", "", s.lower()).split())
    items = [(r["item_id"], norm(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items if f" {t} " in f" {norm(r['text'])} "}
    assert want and want == got


# ------------------------------------------------------------ personal data
KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text):
            g = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(g) <= 19 and luhn(g), "phone": 9 <= len(g) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


PERSONAL = [
    "mail a.b@c.d, x@y, a@b.c_d@e.f.g and é@x.yz @@ q@w.e",
    "ip 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.255 12.34 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 0000000000000 12 3",
    "phone +1 (017) 555-7713 +12 +1234567890123456 +49 30 123456 x",
    "ü" * 5 + " 10.0.0.1+1 555 555 5555 4111111111111111",
    "",
    "no data at all",
]


def test_personal_data_equals_plain_expressions(spark, odd):
    docs = docs_of(spark).select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(PERSONAL)], "doc_id long, text string"))
    docs = docs.union(odd.select((F.coalesce("doc_id", F.lit(99)) + 20_000), "text"))
    got = pii.digest(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    want = sorted((r["doc_id"], ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(r["text"] or ""))) for r in rows)
    assert sorted((r["doc_id"], ",".join(s for s in r["spans"].split(",") if s and not s.startswith("id:"))) for r in got) == want
    for r in got:
        spans = [s for s in r["spans"].split(",") if s]
        base = [s for s in spans if not s.startswith("id:")]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in KINDS] == [sum(s.startswith(k + ":") for s in base) for k, _ in KINDS]


def test_bootstrap_discovers_identifiers_of_trusted_contexts(spark):
    texts = [(i, f"Note. account owner {n}x please") for i, n in enumerate(["4111111111111111 ", "4012888888881881 ", "5500005555555559 ", "6011000990139424 "])]
    texts += [(10, "then account owner AB-99817-77 left"), (11, "we saw 2024-11-05 there"), (12, "we saw 2023-11-05 there"), (13, "we saw item-12345 there")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(awkward(spark, texts)).collect()}
    start = texts[4][1].index("AB-99817-77")
    assert got[10] == f"id:{start}:{start + 11}"
    assert not any("id:" in got[i] for i in (11, 12, 13))


def test_bootstrap_precision_and_recall_on_planted_identifiers(spark):
    """Half of the identifiers stand in contexts that they share with base spans, in prose full of other numbers."""
    import random

    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["river", "the", "stone", "of", "garden", "in", "walked", "seven", "a"]) for _ in range(n))
    frames = [("reach me at ", " thanks"), ("mobile: ", ""), ("my account ", " is open"), ("averyveryveryverylongfieldnameofacontactform:" * 3 + " ", " end")]
    docs, planted = [], set()
    for i in range(240):
        a, b = frames[i % 4]
        if i % 3:
            value = rng.choice([f"u{i}@mail{i}.org", f"+1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)}", f"10.{i}.3.4"])
        else:
            value = f"ZX-{rng.randint(10**5, 10**6)}-{i}"
        text = f"{prose(rng.randint(3, 30))} {a}{value}{b} {prose(rng.randint(3, 30))} item {rng.randint(10**6, 10**7)} of the {rng.randint(10**5, 10**6)}"
        docs.append((i, text))
        if not i % 3:
            planted.add((i, text.index(value), text.index(value) + len(value)))
    got = {(r["doc_id"], *map(int, x.split(":")[1:])) for r in pii.digest(awkward(spark, docs)).collect() for x in r["spans"].split(",") if x.startswith("id:")}
    assert len(got & planted) >= 0.95 * len(planted)
    assert len(got & planted) >= 0.95 * len(got)


def test_redaction(spark, odd):
    docs = awkward(spark, [(1, "x a@b.cd y 1.2.3.4"), (2, None), (3, "clean"), (None, "é +1 (017) 555-7713!"), (1, "x a@b.cd y 1.2.3.4")])
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in got.filter("text is not null").collect()) == [(0, "é [PHONE]!", 10), (1, "x [EMAIL] y [IP]", 16), (1, "x [EMAIL] y [IP]", 16), (3, "clean", None)]
    assert got.filter("text is null").count() == 1
    assert pii.redact(docs.limit(0)).count() == 0 and pii.redact(odd).count() == odd.count()


# ------------------------------------------------------------ revisits
def test_revisits(spark):
    def rec(i, kind, uri, t, etag=None, lm=None, headers=None, digest=None):
        return (i, kind, uri, t, etag, lm, headers, digest)

    rows = [
        rec(1, "response", "http://A.com:80/x/?b=2&a=1#f", 10, '"e1"', None, {"content-type": "t", "expires": "1"}, "d1"),
        rec(2, "response", "https://www.a.com/x?a=1&b=2", 20, '"e2"', "m2", None, "d2"),
        rec(3, "revisit", "http://a.com/x?a=1&b=2&utm_source=z", 15, 'W/"e1"', None, {"expires": "9", "content-type": "no"}),
        rec(4, "revisit", "http://a.com/x?b=2&a=1", 30, '"e1"', None, None),
        rec(5, "revisit", "http://a.com/x?b=2&a=1", 10, '"e1"', None, None),
        rec(6, "revisit", "http://a.com/x?b=2&a=1", 30, None, "m2", None),
        rec(7, "revisit", "http://a.com/x?b=2&a=1", 30, None, None, None),
        rec(8, "revisit", None, 30, None, None, None),
        rec(9, "revisit", "http://a.com/x?b=2&a=1", None, None, None, None),
        rec(6, "revisit", "http://a.com/x?b=2&a=1", 30, None, "m2", None),
        rec(10, "response", "http://a.com/x?b=2&a=1", 20, '"e3"', None, None, "d3"),
    ]
    schema = "record_id long, record_type string, uri string, t long, etag string, last_modified string, headers map<string,string>, digest string"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).withColumn("full", F.lit(1)).withColumn("bucket", F.lit(2))
    got = sorted((r["record_id"], r["status"], r["response_id"]) for r in warc.resolve_revisits(df).collect())
    assert got == [(3, "resolved", 1), (4, "mismatch", None), (5, "orphan", None), (6, "unverified", 10), (6, "unverified", 10), (7, "unverified", 10), (8, "orphan", None), (9, "orphan", None)]
    headers = {r["record_id"]: r["headers"] for r in warc.resolve_revisits(df).collect()}
    assert headers[3] == {"content-type": "t", "expires": "9"}
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_of_a_hot_url_and_a_stray_date(spark):
    import random

    rng = random.Random(2)
    uri = "http://hot.com/" + "x" * 5000
    rows = [(i, rng.choice(["response", "revisit"]), uri if i % 3 else f"http://cold.com/{i % 7}", rng.randrange(4000)) for i in range(3000)]
    rows += [(5000, "response", uri, -(10**9)), (5001, "revisit", uri, 4 * 10**9)]
    df = spark.createDataFrame(rows, "record_id long, record_type string, uri string, t long").withColumn("ts", F.timestamp_seconds("t"))
    for c, kind in (("etag", "string"), ("last_modified", "string"), ("headers", "map<string,string>"), ("digest", "string")):
        df = df.withColumn(c, F.lit(None).cast(kind))
    got = {r["record_id"]: r["response_id"] for r in warc.resolve_revisits(df).collect()}
    full = sorted((u, t, i) for i, k, u, t in rows if k == "response")
    for i, k, u, t in rows:
        if k == "revisit":
            earlier = [(x, j) for v, x, j in full if v == u and x < t]
            assert got[i] == (max(earlier)[1] if earlier else None)
    edges = df.select(warc.time_bucket(F.col("ts"), df).alias("b")).groupBy("b").count()
    assert edges.agg(F.max("count")).first()[0] < 60


# ------------------------------------------------------------ repeated strings
def test_repeats_equal_brute_force(spark):
    docs = docs_of(spark)
    check_repeats(docs)


def check_repeats(docs):
    got = suffix_dedup.remove(docs, with_text=True).collect()
    rows = [(r["doc_id"], (r["text"] or "").encode("utf-8", "surrogatepass")) for r in docs.collect()]
    want = []
    for (i, t), gone in zip(rows, suffix_dedup.brute_force([t for _, t in rows]), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i is None, i or 0, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)


def test_repeats_on_odd_rows(spark, monkeypatch):
    import random

    rng = random.Random(11)
    words = [("".join(rng.choices("abcdeü", k=rng.randint(2, 8)))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    passage, texts = make(120), []
    for i in range(30):
        texts.append((i, make(rng.randint(0, 80)) + passage + make(rng.randint(0, 80))))
    for i in range(30, 45):  # near copies
        p = list(passage)
        p[rng.randrange(len(p))] = "Z"
        texts.append((i, "".join(p)))
    texts += [(50, None), (51, ""), (52, "a" * 1500), (53, "ab" * 300), (None, passage[:450]), (None, passage[:399]), (54, make(300)), (54, texts[0][1]), (0, texts[0][1])]
    docs = awkward(spark, texts)
    check_repeats(docs)
    monkeypatch.setattr(suffix_dedup, "MOST", 4)  # forces halving of buckets
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", 0)
    check_repeats(docs)
    assert suffix_dedup.remove(docs.limit(0)).count() == 0


# ------------------------------------------------------------ top k
def test_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, None), (401, [float("nan")] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("inf")] + [0.0] * 5), (404, []), (None, rows[1][1]), (7, rows[7][1]), (405, rows[2][1][:3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("label", F.lit(None))
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    got = topk.search(df, F.col("vec_id") % 50 == 0).collect()
    good = {i: [int(np.floor(256 * x)) for x in v] + [0] * (6 - len(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-int(np.dot(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("query_rows, tasks, across", [(8192, 4096, 64), (3, 4096, 64), (3, 6, 2)])
def test_topk_broadcasts_nothing_and_bounds_its_tasks(spark, monkeypatch, query_rows, tasks, across):
    rng = np.random.default_rng(4)
    scale = {0: 300.0, 1: 1e8}  # blocks of 16, 32 and 64 bits
    rows = [(i, [float(x) for x in scale.get(i, 1.0) * rng.normal(size=6)]) for i in range(500)]
    for name, value in (("BLOCK_ROWS", 64), ("QUERY_ROWS", query_rows), ("TASKS", tasks), ("ACROSS", across)):
        monkeypatch.setattr(topk, name, value, raising=False)
    out = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    got = sorted(tuple(r) for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    x, y = (int((re.findall(f"{kind}partitioning\\([^()]*?(\\d+)\\)", plan, re.I) or [1])[0]) for kind in ("range", "roundrobin"))
    assert (x, y) == {8192: (8, 1), 3: (8, 4)}[query_rows] if tasks == 4096 else (x, y) == (3, 2)
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in range(0, 500, 50):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert got == sorted(want)


# ------------------------------------------------------------ near duplicates
def test_links_equal_brute_force(spark):
    for words in (4, 5):
        docs = docs_of(spark)
        got = {r["doc_id"]: r for r in near_dedup.link(docs, words, 80).collect()}
        want = near_dedup.exact_components({r["doc_id"]: r["text"] for r in docs.collect()}, words, 80)
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_links_on_odd_rows_and_large_groups(spark, monkeypatch):
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):  # a chain of near copies: neighbours link, ends do not
        texts.append((i, " ".join(base)))
        for _ in range(2):
            base[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
    common = " ".join(f"c{i}" for i in range(60))
    texts += [(100 + i, common + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for i in range(40)]
    texts += [(200 + i, "same text in all of these rows") for i in range(20)] + [(300, "a b"), (301, "A\tB"), (302, "a b c"), (303, None), (304, ""), (305, " \n"), (None, "a b"), (306, "x" * 200_000)]
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    docs = awkward(spark, texts)
    got = near_dedup.link(docs, 4, 80).collect()
    assert len(got) == len(texts)
    want = near_dedup.exact_components({i: t or "" for i, t in texts if i is not None}, 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert {r["doc_id"] for r in got if r["n_shingles"] == 0} == {303, 304, 305}
    kept = near_dedup.keep_first(docs, 4, 80)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values()))
    assert near_dedup.link(docs.limit(0)).count() == 0
    twice = near_dedup.keep_first(docs.union(docs.filter("doc_id = 300")), 4, 80)
    assert twice.filter("doc_id = 300").count() == 1
    odd_ids = [(1, "alpha beta gamma delta epsilon zeta"), (1, "six quite other words than before"), (1, "six quite other words than before"), (2, "alpha beta gamma delta epsilon zeta"), (3, "nothing like any of the others here")]
    kept = near_dedup.keep_first(awkward(spark, odd_ids), 4, 80).collect()
    assert sorted(r["text"] for r in kept) == sorted({t for _, t in odd_ids})


# ------------------------------------------------------------ pipeline and registration
def test_pipeline_stages(spark, tmp_path):
    docs = docs_of(spark)
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, DIR)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        if name == "quality":
            m = quality.train(before, table(spark, DIR, "labels"))
            want = {r["doc_id"] for r in quality.score(before, m).filter("predicted = 1").collect()}
            assert {r["doc_id"] for r in after.collect()} == want
        if name == "near_duplicates":
            want = set(near_dedup.exact_components({r["doc_id"]: r["text"] for r in before.collect()}, 5, 80).values())
            assert {r["doc_id"] for r in after.collect()} == want
        if name == "personal_data":
            assert not [r["doc_id"] for r in after.collect() if base_spans(r["text"])]
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        before = after
    assert before.count() == spark.read.parquet(str(tmp_path / "personal_data")).count()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, stage):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), odd):  # with clashing columns too
        out = stage(spark, docs, DIR)
        assert out.count() <= docs.count() and (stage is corpus_pipeline.STAGES[-1][1] or out.columns == docs.columns)
    assert stage(spark, docs.limit(0), DIR).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    got = c.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, got.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())


def test_all_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
