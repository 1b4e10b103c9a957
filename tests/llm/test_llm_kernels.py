"""Kernels without Spark: against defining rules."""

import random

import numpy as np
import pytest

from phredloom.llm import bytescan, html_extract, near_dedup, packing, quality, suffix_dedup, token_count, topk


def test_suffix_array_equals_sorted_suffixes():
    rng = random.Random(5)
    for _ in range(1500):
        text = [rng.randint(1, rng.randint(1, 5)) for _ in range(rng.randint(0, 40))] + [0]
        order = suffix_dedup.suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffix_dedup.common_prefixes(text, order)
        for r in range(1, len(order)):
            a, b = text[order[r - 1] :], text[order[r] :]
            assert shared[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("word", ["a" * 60 + "b", "ab" * 40, "abacabadabacaba" * 4])
def test_suffix_array_of_repetitive_texts(word):
    text = [ord(c) for c in word] + [0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_windows_equal_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        length = rng.randint(4, 9)
        core = bytes(rng.choices(b"ab", k=length - 3))
        segments = []
        for _ in range(rng.randint(1, 6)):
            left, right = bytes(rng.choices(b"ab", k=rng.randint(0, 3))), bytes(rng.choices(b"ab", k=rng.randint(0, 3)))
            if len(left + core + right) >= length:
                segments.append((left + core + right, len(left)))
        segments = list(dict.fromkeys(segments))
        if not segments:
            continue
        found = suffix_dedup.repeated_windows(segments, length)
        for i, (s, a) in enumerate(segments):
            got = {x for lo, hi in found[i] for x in range(lo, hi + 1)}
            want = set()
            for x in range(0, min(a, len(s) - length) + 1):
                for j, (t, b) in enumerate(segments):
                    y = b - (a - x)  # the same place relative to the anchor
                    if j != i and 0 <= y <= len(t) - length and t[y : y + length] == s[x : x + length]:
                        want.add(x)
            assert got == want, (segments, i, got, want)


def test_windows_are_owned_once_and_by_content():
    rng = np.random.default_rng(3)
    block = rng.integers(97, 101, 2000).astype(np.uint8)
    data = np.concatenate([rng.integers(97, 101, 700).astype(np.uint8), block, rng.integers(97, 101, 333).astype(np.uint8), block])
    a, b, p, core, seg = suffix_dedup.owned(data)
    cover = np.zeros(len(data) - suffix_dedup.LENGTH + 1, int)
    for x, y in zip(a, b):
        cover[x : y + 1] += 1
    assert (cover == 1).all()
    key = {x: (c, p_ - x) for x0, y0, p_, c in zip(a, b, p, core) for x in range(x0, y0 + 1)}
    for i in range(2000 - suffix_dedup.LENGTH + 1):
        assert key[700 + i] == key[700 + 2000 + 333 + i]


def test_sliding_min():
    v = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 2, 7, 64, 385):
        assert (suffix_dedup._sliding_min(v, w) == [v[i : i + w].min() for i in range(500 - w + 1)]).all()


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(2)
    for _ in range(100):
        pieces = {"▁", *("▁" * (rng.random() < 0.5) + "".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12)))}
        machine = token_count.Automaton(pieces)
        for _ in range(60):
            word = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
            assert machine.count(word) == token_count.greedy_count(word, pieces)


def test_automaton_with_a_public_vocabulary():
    pieces = token_count.piece_vocabulary(token_count.default_vocabulary_path())
    machine, known = token_count.Automaton(pieces), set(pieces)
    for word in ["the", "unbelievable", "Zürich", "x", "antidisestablishmentarianism", "12345", "—", "日本語", "ᚠ"]:
        assert machine.count(word) == token_count.greedy_count(word, known)


def brute_buckets(lengths, k):
    values = sorted(set(lengths))
    best = float("inf")

    def go(i, left, cost):
        nonlocal best
        if i == len(values):
            best = min(best, cost)
            return
        if left:
            for j in range(i, len(values)):
                go(j + 1, left - 1, cost + sum(values[j] - x for x in lengths if values[i] <= x <= values[j]))

    go(0, k, 0)
    return best


def test_bucket_boundaries_have_least_padding():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 25))]
        k = rng.randint(1, 4)
        v, n = np.unique(lengths, return_counts=True)
        bounds = packing.boundaries(v, n, v * n, k)
        padding = sum(min(b for b in bounds if b >= x) - x for x in lengths)
        assert len(bounds) <= k and padding == brute_buckets(lengths, k)
    assert packing.boundaries(np.array([], int), np.array([], int), np.array([], int), 3) == []


def test_word_arrays_equal_split():
    texts = ["", "  a  b\tc\n", "Ä ö\x0bß", "x" * 5000, "the cat THE Cat", "\x1c\x85 nbsp joined", "lone \ud800 surrogate"]
    rows = []
    for chunk in bytescan.chunks(texts):
        data = near_dedup._LOWER[chunk.data]
        start, end = bytescan.runs(near_dedup._IN_WORD[data])
        first = chunk.owners(start)
        for i in range(chunk.n):
            rows.append([bytes(data[a:b]) for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])])
    assert rows == [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]


def test_shingle_sets_have_the_size_of_word_tuples():
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["a", "b", "c", "D"], k=rng.randint(0, 30))) for _ in range(200)]
    for text, s in zip(texts, near_dedup.shingle_sets(texts, 4)):
        w = text.lower().split()
        want = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
        assert len(s) == len(want)


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    kept = 0
    for _ in range(200):
        same = rng.random(near_dedup._N) < 0.8
        a = rng.integers(0, 2**16, near_dedup._N).astype(np.uint16)
        b = np.where(same, a, a ^ 1).astype(np.uint16)
        kept += len(near_dedup._survive(a[None], b[None], 0.8))
        low = np.where(rng.random(near_dedup._N) < 0.3, a, a ^ 1).astype(np.uint16)
        assert len(near_dedup._survive(a[None], low[None], 0.8)) == 0
    assert kept == 200


def test_block_search_is_exact():
    rng = np.random.default_rng(6)
    rows = rng.integers(-200, 200, (500, 12))
    rows[100:160] = rows[0]
    block = topk.Block(np.arange(500), rows)
    queries = rng.integers(-200, 200, (20, 12))
    for q, (at, scores) in zip(queries, block.search(queries, 5)):
        want = np.lexsort((np.arange(500), -(block.rows @ q)))[:5]
        best = at[np.lexsort((block.ids[at], -scores))[:5]]
        assert (block.ids[best] == block.ids[want]).all()


def test_block_search_with_huge_values_saturates():
    rows = np.array([[2**61, 2**61], [1, 1], [-(2**61), 0]])
    [(at, scores)] = topk.Block(np.arange(3), rows).search(np.array([[2**40, 2**40]]), 2)
    assert dict(zip(at.tolist(), scores.tolist()))[0] == 2**63 - 1


def test_descent_separates():
    rng = np.random.default_rng(1)
    y = np.where(rng.random(400) < 0.5, 1, 0)
    texts = [("good fine nice " if v else "bad!! ugly!! poor!! ") * 3 + " ".join(rng.choice(list("abcdefgh"), 20)) for v in y]
    rows = list(quality.features(texts))
    m = quality.fit(rows, y)
    assert np.mean([(m.score(r) >= 0.5) == v for r, v in zip(rows, y)]) > 0.99
    assert 0 <= m.score(np.empty(0, np.int64)) <= 1


def test_features_do_not_depend_on_neighbours():
    texts = ["One two three.", "", "a", "x !! y !! z", "of of of of of of of of of"]
    together = [r.tolist() for r in quality.features(texts)]
    assert together == [next(quality.features([t])).tolist() for t in texts]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script></head><body>
<nav><a href=/x>menu entry</a></nav><div class="ad">buy this now {junk}</div>
<article><h1>Title &amp; more</h1><p>First   para<b>graph</b>
text.<br><p>Short.<aside>side</aside><p class="comment">reader</p><form>name <input></form></article>
<footer>&copy; foot</footer></body></html>"""


def test_main_text_of_a_marked_article():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst paragraph text.\nShort."


@pytest.mark.parametrize("page", [None, "", "   ", "<p>", "<!-- open", "<script>x", "<<<>>>", "</p></div>", "<a href='", "&#0; &bogus; &amp"])
def test_main_text_of_broken_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_main_text_without_marks_is_between_surge_and_dive():
    links = "".join(f"<li><a href=#>link number {i}</a></li>" for i in range(9))
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4))
    got = html_extract.main_text(f"<body><ul>{links}</ul>{body}<div><a href=#>about</a></div></body>")
    assert got == "\n".join("word " * 30 + str(i) for i in range(4))
    assert html_extract.main_text("<p>short</p><p>texts too</p>") == "short\ntexts too"


def test_cut_off_tag_is_no_text():
    assert html_extract.main_text("<article><p>kept</p><p cla").endswith("kept")


def test_long_page_is_linear():
    page = "<article>" + "<p title=\"open>" * 3000 + "<p>end</article>"
    assert "end" in html_extract.main_text(page)


def by_windows(lines):
    """Surge and dive by their definition, window by window: lines are (text, linked, inside the mark)."""
    raw = [max(0, len(t) - n) for t, n, _ in lines]
    mark = [m for _, _, m in lines]
    if any(mark):
        share = sum(r for r, m in zip(raw, mark, strict=True) if m) / max(1, sum(raw))
        raw = [r * html_extract.INSIDE if m else int(r * (1 - share) ** 4) for r, m in zip(raw, mark, strict=True)]
    sums = [sum(raw[max(0, i - 1) : i + 2]) for i in range(len(raw))]
    level = min(html_extract.SURGE, max(sums, default=0))
    sums = [x if x * html_extract.DIVE >= level else 0 for x in sums]
    out = []
    for i, (t, _, m) in enumerate(lines):
        left = right = i
        while left > 0 and sums[left - 1]:
            left -= 1
        while right < len(sums) - 1 and sums[right + 1]:
            right += 1
        surges = sums[i] and max(sums[left : right + 1]) >= level
        if surges and any(raw[left : i + 1]) and any(raw[i : right + 1]) and (m or not any(mark) or raw[i] >= html_extract.OUTSIDE):
            out.append(t)
    return "\n".join(out)


def test_main_text_equals_windows_on_marked_and_unmarked_pages():
    import random

    rng = random.Random(4)
    for _ in range(600):
        lines, marked = [], rng.random() < 0.5
        a, b = sorted(rng.choices(range(13), k=2))
        for i in range(12):
            text = "".join(rng.choices("abc ", k=rng.choice([1, 5, 30, 90, 300]))).strip() or "x"
            linked = rng.random() < 0.4
            lines.append((" ".join(text.split()), linked, int(marked and a <= i < b)))
        page = ""
        for i, (t, linked, m) in enumerate(lines):
            page += "<main>" * (m and (i == 0 or not lines[i - 1][2])) + (f"<p><a href=#>{t}</a></p>" if linked else f"<p>{t}</p>") + "</main>" * (m and (i == 11 or not lines[i + 1][2]))
        assert html_extract.main_text(page) == by_windows([(t, len(t) * linked, m) for t, linked, m in lines])


def test_windows_decide_with_and_without_marks():
    long, menu = "<p>" + "word " * 30 + "end</p>", "".join(f"<li><a href=#>section {i}</a></li>" for i in range(5))
    text = "word " * 30 + "end"
    for open_, close in (("<article>", "</article>"), ("<div>", "</div>")):
        # a menu between paragraphs is a dive; a linked line or two are part of the text
        assert html_extract.main_text(f"{open_}{long}<ul>{menu}</ul>{long}{close}") == f"{text}\n{text}"
        assert html_extract.main_text(f"{open_}{long}<p><a href=#>see also</a></p>{long}{close}") == f"{text}\nsee also\n{text}"
        assert html_extract.main_text(f"{open_}<ul>{menu}</ul>{long}{close}<ul>{menu}</ul>") == text
    # without the window rule both pages would keep every line
    assert len(html_extract.lines_of(f"<article>{long}<ul>{menu}</ul>{long}</article>")) == 7
    assert html_extract.main_text("<article><h1><a href=#>A linked title</a></h1><p>Some text.</p></article>") == "A linked title\nSome text."


def test_menus_and_notices_around_and_inside_articles():
    long = "<p>" + "word " * 30 + "end</p>"
    text = "word " * 30 + "end"
    links = "<a href=#>Home</a> | <a href=#>News</a> | <a href=#>Sport</a>"
    assert html_extract.main_text(f"<p>{links}</p>{long}") == text
    assert html_extract.main_text(f"<p>{links.replace(' | ', ' ')}</p>{long}{long}") == f"{text}\n{text}"
    assert html_extract.main_text("<p><a>only</a> <a>links</a></p>") == ""
    assert html_extract.main_text("<p><a>only</a> · <a>links</a> »</p>") == ""
    for notice in ("Copyright 2024 Example Ltd. All rights reserved.", "© 2024 Example", "Contact us by phone", "We use cookies on this site.", "Related stories", "You might also like"):
        assert html_extract.main_text(f"{long}<p>{notice}</p>") == text, notice
    for notice in ("We use cookies on this site.", "Related stories", "You might also like"):
        assert html_extract.main_text(f"<article>{long}<p>{notice}</p>{long}</article>") == f"{text}\n{text}", notice
    assert html_extract.main_text(f"<article>{long}<p>All rights reserved.</p></article>") == f"{text}\nAll rights reserved."
    assert html_extract.main_text(f"<article><p>Copyright law {'is old ' * 40}</p></article>").startswith("Copyright law")


def test_scans_are_linear():
    import time

    t = time.time()
    for page in ["<p>x" + "<a b=\"' c='\" " * 10_000, "<p>x<a " + "b='" * 10_001, "<p>x</p><script>" + "</script " * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<p>" + "<b>" * 50_000 + "<p>x</p>" * 50_000]:
        html_extract.main_text(page)
    assert time.time() - t < 5
    t = time.time()
    html_extract.main_text("<article><p>x</p>" + "<a b=\"" * 5_000 + "'" * 5_000)
    assert time.time() - t < 0.1


def test_classes_marks_and_comments():
    long = "<p>" + "word " * 60 + "</p>"
    text = ("word " * 60).strip()
    assert html_extract.main_text(f'<div class="content no-sidebar">{long}</div>') == text
    assert html_extract.main_text('<article><h1>T</h1><p data-id="share">hello</p></article>') == "T\nhello"
    assert html_extract.main_text(f"<main><h1>T</h1>{long}</main><section><h2>Comments</h2><article>Reader says hi</article></section>") == "T\n" + text
    assert html_extract.main_text(f"<article>{long}<section><h3>3 Comments</h3><article>Reader says hi</article></section><p>end</p></article>") == text + "\nend"
    assert html_extract.main_text(f'<div class="page-header">{long * 2}</div><p>x</p>') == f"{text}\n{text}\nx"
    assert html_extract.main_text(f"<article>teaser</article><div>{long * 4}</div>") == "\n".join(["teaser", *[text] * 4])
    assert html_extract.main_text(f"<article>{long * 4}</article><div>{long}</div>") == "\n".join([text] * 4)
    assert html_extract.main_text(f'<span class="sidebar">gone</span>{long}') == text


def test_topk_stops_on_proof_before_the_last_segment():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    rows = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.1)).astype(np.int64)
    block = topk.Block(np.arange(4000), rows)
    for x, (at, scores) in zip(rows[:70], block.search(rows[:70], 6), strict=True):
        full = rows @ x
        assert (full[at] == scores).all() and set(np.flatnonzero(full >= np.sort(full)[-6])) <= set(at.tolist())
    assert len(block.added) == 70 and np.mean(block.added) < 1


def test_topk_rows_far_larger_than_the_rest_stay_beside_the_index():
    rng = np.random.default_rng(8)
    rows = rng.integers(-200, 200, (900, 10))
    rows[[3, 70]] = [[2**45] * 10, [-(2**58)] * 10]
    rows[5] = 0
    block = topk.Block(np.arange(900), rows)
    assert set(block.beside.tolist()) == {3, 70} and np.abs(rows[block.indexed]).max() < 2**10
    queries = np.concatenate([rng.integers(-200, 200, (70, 10)), [[2**40] * 10], np.zeros((1, 10), np.int64)])
    many = np.arange(72) % 4 + 1
    for k, q, (at, scores) in zip(many, queries, block.search(queries, many), strict=True):
        full = [max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r in rows]
        assert scores.tolist() == [full[i] for i in at]
        assert set(sorted(range(900), key=lambda i: (-full[i], i))[:k]) <= set(at.tolist())
    assert np.mean(block.rescored[:70]) <= 900 // topk.SOME  # a query of ordinary size meets few rows again


def test_topk_stops_early_on_clusters_and_rescores_few_rows():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(300, 24)) * 4
    rows = np.floor(256 * (centres[rng.integers(0, 300, 6000)] + rng.normal(size=(6000, 24)) * 0.1)).astype(np.int64)
    block = topk.Block(np.arange(6000), rows)
    for x, (at, scores) in zip(rows[:8], block.search(rows[:8], 6), strict=True):
        full = rows @ x
        assert set(np.flatnonzero(full >= np.sort(full)[-6])) <= set(at.tolist())
    assert max(block.added) < 0.75 and max(block.rescored) <= 6000 // topk.SOME
