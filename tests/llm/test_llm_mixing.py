"""Importance resampling, divergence audit, mixing: brute force on small and awkward tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from phredloom.llm import divergence, importance, mixing
from phredloom.llm.common import table

DIR = "/root/testdata/sf0.001"
CLASH = ["row", "key", "n", "term", "docs", "p", "q", "c", "at", "d", "v", "names", "rank", "weight", "score", "bucket", "buckets", "n_words", "block", "shard", "turn", "place", "size", "target", "want", "part", "copy", "cell", "words", "digest", "named", "label", "_range", "_rows", "_at"]


def odd_rows():
    long = "Alpha beta " * 30_000 + "x" * 20_000
    some = " ".join(f"word{i % 17} Omega élan Éclair ñ" for i in range(12))
    rows = [(1, some, "en", "a"), (1, some, "en", "a"), (2, None, "en", "b"), (3, "", None, "b"), (None, some, "en", None), (None, some, "en", None), (None, None, None, None)]
    rows += [(4, long, "en", "b"), (5, " \n\t  ", "de", "c"), (6, "one two 3   four", "de", ""), (7, some + " more", "en", ""), (8, "!!! ??? 12", "fr", "solo")]
    return rows + [(100 + i, some if i % 3 else f"other {i} words omega here alpha", "en", "ab"[i % 2]) for i in range(40)] + [(9, some, "de", "c")] * 7


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(5)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ------------------------------------------------------------ importance
def test_run_hashes_equal_hashes_of_the_joined_words():
    ws = importance.words("The quick Brown-fox, élan 3x  über".encode())
    assert ws == [w.encode() for w in ("the", "quick", "brown", "fox", "élan", "3x ", "über")]
    for n in (1, 2, 3, 9):
        want = [crc32(b" ".join(ws[i : j + 1])) for j in range(len(ws)) for i in range(max(0, j - n + 1), j + 1)]
        assert importance.run_hashes(ws, n) == want
    assert importance.run_hashes([], 3) == [] == importance.words(None)


def plain_importance(rows, target, n, m, percent, least, seed):
    def feats(t):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(ws), [crc32(" ".join(ws[i : i + k]).encode()) % m for k in range(1, n + 1) for i in range(len(ws) - k + 1)]

    docs = [(i, *feats(t)) for i, t in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in feats(x)[1])
    big_s, big_t = s.total(), t.total()
    out = []
    for i, words, fs in docs:
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + m) / ((s[b] + 1) * (big_t + m)))) for b in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words))
    may = sorted((o for o in out if o[4] >= least), key=lambda o: (-o[3], -1 if o[0] is None else o[0]))
    drawn = len(may) * percent // 100
    return Counter([(*o[:4], k) for k, o in enumerate(may[:drawn], 1)] + [(*o[:4], None) for o in may[drawn:]] + [(*o[:4], None) for o in out if o[4] < least])


@pytest.mark.parametrize(("n", "m", "percent", "least"), [(1, 10_000, 10, 20), (3, 64, 50, 4), (2, 1000, 100, 0)])
def test_importance_equals_brute_force(spark, odd, n, m, percent, least):
    target = ["alpha beta omega", None, "", "élan vital of the Omega"]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(odd, goal, n, m, percent, least, 7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_importance([(r[0], r[1]) for r in odd_rows()], target, n, m, percent, least, 7)


def test_importance_of_empty_tables(spark, odd):
    goal = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(odd.limit(0), goal).count() == 0
    assert importance.resample(odd, goal).count() == len(odd_rows())


# ------------------------------------------------------------ divergence
def plain_audit(rows, least, top):
    seen, counts, groups = defaultdict(set), Counter(), defaultdict(set)
    for r, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)):
            seen[lang, t].add(r)
            counts[lang, source, t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (l, t), docs in seen.items() if l == lang and len(docs) >= least]
        total = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s, t] + 1) // (total[s] + len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s, t] for s in sources) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources - {s}]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                order = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(order, 1)}
    return out


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 4), (99, 5)])
def test_audit_equals_brute_force(spark, odd, least, top):
    got = [tuple(r) for r in divergence.audit(odd, least, top).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_audit(odd_rows(), least, top)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_audit_of_the_smallest_table(spark):
    docs = table(spark, DIR, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert {tuple(r) for r in divergence.audit(docs).collect()} == plain_audit(rows, 3, 200)


def test_shares_of_very_large_counts_are_exact(spark):
    cases = [(0, 1), (2 * 10**14, 2 * 10**14 + 7), (123_456_789_012, 290_000_000_000_000), (9, 10)]
    df = spark.createDataFrame(cases, "n long, d long").selectExpr("n", "d", divergence.share("n", "d") + " as p")
    for r in df.collect():
        assert r["p"] == 1 + 10**9 * (r["n"] + 1) // r["d"]


# ------------------------------------------------------------ mixing
def plain_targets(sizes, weights, percent, epochs):
    """The stated rule, step by step: share by weight, stop at the limit, share the excess anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    goal, full = sum(sizes.values()) * percent / 100, set()
    while True:
        left = goal - sum(epochs * sizes[s] for s in full)
        rest = sum(w[s] for s in order if s not in full)
        target = {s: float(epochs * sizes[s]) if s in full else left * w[s] / rest for s in order}
        above = {s for s in order if s not in full and target[s] > epochs * sizes[s]}
        if not above:
            return target
        full |= above


def test_targets_equal_the_stated_rule(spark):
    for sizes in ({"a": 100, "b": 50, None: 1000, "": 3, "z": 0}, {"x": 10}, {f"s{i}": (i * 37) % 101 + 1 for i in range(60)}, {"a": 0, None: 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        for weights, percent, epochs in (([5, 2, 1], 150, 2), ([1], 100, 1), ([1, 100], 199, 2), ([3, 1], 10, 4)):
            got = {r["source"]: r["target"] for r in mixing.targets(df, weights, percent, epochs).collect()}
            want = plain_targets(sizes, weights, percent, epochs)
            assert got.keys() == want.keys()
            assert all(math.isclose(got[s], want[s], rel_tol=1e-12, abs_tol=1e-9) for s in want)


def test_hypergeometric_draws_follow_their_law(spark):
    sql = mixing.hypergeometric("w", "m", "d", "u")
    cases = [(20, 7, 9), (50, 3, 25), (6, 6, 2), (9, 4, 9), (1000, 400, 17), (10**6, 3 * 10**5, 5 * 10**5)]
    steps = 400
    rows = [(k, w, m, d, (i + 0.5) / steps) for k, (w, m, d) in enumerate(cases) for i in range(steps)]
    got = defaultdict(list)
    for r in spark.createDataFrame(rows, "k int, w long, m long, d long, u double").selectExpr("k", "u", f"{sql} as x").collect():
        got[r["k"]].append((r["u"], r["x"]))

    def ln_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    for k, (w, m, d) in enumerate(cases):
        lo, hi = max(0, d + m - w), min(d, m)
        mean = d * m / w
        span = range(max(lo, int(mean) - 6000), min(hi, int(mean) + 6000) + 1)
        total, below = 0.0, {}
        for x in span:
            below[x] = total
            total += math.exp(ln_choose(m, x) + ln_choose(w - m, d - x) - ln_choose(w, d))
        for u, x in got[k]:  # the value whose step of the distribution function holds u
            assert lo <= x <= hi
            assert below[x] - 1e-6 <= u <= below.get(x + 1, total) + 1e-6, (w, m, d, u, x)


def test_tree_deals_exact_disjoint_quotas(spark):
    quotas = [1000, 0, 37, 5, 9999, 1]
    df = spark.createDataFrame(list(enumerate(quotas)), "place long, blocks long")
    shares = []
    for seed in range(4):
        leaves = sorted(mixing.shards(df, 300, seed).collect(), key=lambda r: r["shard"])
        total = sum(quotas)
        assert [r["shard"] for r in leaves] == list(range(-(-total // 300)))
        room = [sum(r["quota"]) for r in leaves]
        assert max(room) - min(room) <= 1
        for s, q in enumerate(quotas):
            at = 0
            for r in leaves:
                assert r["start"][s] == at
                at += r["quota"][s]
            assert at == q
        shares.append([r["quota"][0] for r in leaves])
    assert len({tuple(x) for x in shares}) == 4  # seeds differ
    n, p = len(shares[0]), quotas[0] / sum(quotas)
    mean = sum(quotas) / n * p
    var = sum((x - mean) ** 2 for row in shares for x in row) / (4 * n)
    law = sum(quotas) / n * p * (1 - p) * (1 - 1 / n)
    assert 0.6 < var / law < 1.6
    assert mixing.shards(df.filter("blocks = 0"), 300, 1).count() == 0
    assert mixing.shards(df.limit(0), 300, 1).count() == 0


def test_permutation(spark):
    for n in (1, 2, 3, 10, 1_000_003, 2_000_003):
        got = spark.range(n).select(F.expr(mixing.permuted("id", f"{n}L")).alias("x")).agg(F.count_distinct("x"), F.min("x"), F.max("x")).first()
        assert tuple(got) == (n, 0, n - 1)


def size_of(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check_mix(rows, mixed, taken, weights, percent, epochs):
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size_of(t)
    target = plain_targets(sizes, weights, percent, epochs)
    by_doc = Counter((r["doc_id"], r["size"], r["source_size"]) for r in taken)
    assert by_doc == Counter((i, size_of(t), sizes[s]) for i, t, _, s in rows)
    want = Counter((i, size_of(t), round(target[s], 6)) for i, t, _, s in rows)
    assert Counter((r["doc_id"], r["size"], round(r["target"], 6)) for r in taken) == want
    assert all(0 <= r["taken"] <= epochs * r["size"] for r in taken)
    goal = Counter()
    for s, x in target.items():
        goal[sizes[s], round(x, 6)] += math.floor(x + 0.5)
    got = Counter()
    for r in taken:
        got[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert got == goal
    spans = defaultdict(list)
    for r in mixed:
        spans[r["key"], r["epoch"]].append((r["from_word"], r["n_words"]))
    for runs in spans.values():  # runs of one document and epoch do not overlap
        runs.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(runs, runs[1:], strict=False))
    assert sum(r["n_words"] for r in mixed) == sum(r["taken"] for r in taken)


def test_mix_of_odd_rows(spark, odd):
    for weights, percent, epochs, block in (([5, 2, 1], 150, 2, 64), ([1, 3], 90, 1, 7), ([1], 290, 3, 4096)):
        mixed, rows = mixing.mix(odd, weights, percent, epochs, block, 4, 5)
        check_mix(odd_rows(), mixed.collect(), mixing.taken(mixed, rows).collect(), weights, percent, epochs)
    again = mixing.mix(odd.repartition(3, "doc_id"), weights, percent, epochs, block, 4, 5)[0]
    cols = ["shard", "turn", "key", "doc_id", "epoch", "from_word", "n_words"]
    assert sorted(map(tuple, mixed.select(cols).collect()), key=repr) == sorted(map(tuple, again.select(cols).collect()), key=repr)
    empty = mixing.mix(odd.limit(0), [5, 2, 1])
    assert empty[0].count() == 0 and mixing.taken(*empty).count() == 0


def test_mix_shards_are_full_and_mixed(spark):
    docs = table(spark, DIR, "documents")
    mixed, rows = mixing.mix(docs, [5, 2, 1], block_words=128, shard_blocks=40)
    mixed = mixed.collect()
    check_mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()], mixed, mixing.taken(mixing.mix(docs, [5, 2, 1], block_words=128, shard_blocks=40)[0], rows).collect(), [5, 2, 1], 150, 2)
    words = Counter()
    turns = defaultdict(list)
    for r in mixed:
        words[r["shard"]] += r["n_words"]
        turns[r["shard"]].append(r["turn"])
    assert all(sorted(t) == list(range(1, len(t) + 1)) for t in turns.values())
    assert min(words.values()) > 0.75 * max(words.values())  # only the last block of a source is short


def test_hot_text_is_spread(spark):
    """A third of the rows are one text without an id: its copies stand in many cells, and each is taken by its own place."""
    rows = [(None, "same words here", "en", "a")] * 4000 + [(i, f"text {i}", "en", "ab"[i % 2]) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8)
    mixed, kept = mixing.mix(docs, [5, 2, 1], block_words=32)
    taken = mixing.taken(mixed, kept).collect()
    assert len(taken) == len(rows)
    check_mix(rows, mixed.collect(), taken, [5, 2, 1], 150, 2)


# ------------------------------------------------------------ packing and personal data
def test_packing_does_not_depend_on_the_layout(spark):
    import pandas as pd

    from phredloom.llm import packing

    n = [(i * 7919) % 97 if i % 3 else 40 for i in range(3000)]
    rows = [(i if i % 4 else i // 4 * 4 % 50, x) for i, x in enumerate(n)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    a, b = (packing.pack(df.repartition(k, "n"), "doc_id", "n", 4, 600, ranges).collect() for k, ranges in ((1, 2), (7, 31)))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    got = pd.DataFrame([r.asDict() for r in a])
    for _, g in got.sort_values(["bucket", "batch_no", "slot"]).groupby("bucket"):
        assert (g.batch_no * g.capacity + g.slot).tolist() == list(range(len(g)))
        assert list(zip(g.n_tokens, g.doc_id, strict=True)) == sorted(zip(g.n_tokens, g.doc_id, strict=True))


def test_boundaries_are_exact_beyond_doubles():
    import numpy as np

    from phredloom.llm import packing

    v = np.array([1, 2, 3, 10**6], dtype=np.int64)
    for n in (np.array([10**12 + 1, 5, 10**12, 3]), np.array([10**13 + 1, 10**13, 1, 10**13])):
        got = packing.boundaries(v, n, v * n, 2)
        cost = {b: sum(int(c) * ((b if x <= b else 10**6) - int(x)) for x, c in zip(v, n, strict=True)) for b in (1, 2, 3)}
        assert got == [min(cost, key=cost.get), 10**6]


def test_contexts_need_true_seeds_and_a_share_of_their_places(spark):
    from phredloom.llm import pii

    def trusted(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
        found = pii.marks(docs)
        return {r["context"]: r["seeds"] for r in pii.confident_patterns(found, docs).collect()}

    seeds = [f"please write to user{i}@mail.example.org today" for i in range(6)]
    assert trusted([*seeds, "please write to AB123456X today"])["write to _"] == 6
    # two base seeds only, however many candidates share the context
    assert trusted([*seeds[:2], *(f"please write to AB12345{i}X today" for i in range(9))]) == {}
    # the words stand elsewhere too often
    assert trusted([*seeds, "please write to AB123456X today", *["write to me today and write to us please"] * 20]) == {}


def test_many_repeated_rows_of_a_null_id_mark_each_range_once(spark):
    from phredloom.llm import suffix_dedup

    text = "".join(chr(97 + (i * i * 31 + i // 7) % 26) for i in range(900))
    docs = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    docs = docs.unionByName(spark.createDataFrame([(1, "x" + text[:500]), (2, "y" * 399)], "doc_id long, text string"))
    got = suffix_dedup.remove(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert {tuple(r) for r in got} == {(None, 900, 900, 1, 30_000), (1, 501, 500, 1, 1), (2, 399, 0, 0, 1)}
    rows = suffix_dedup.repeated(docs.withColumn("row", F.xxhash64("text"))).groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set(F.struct("a", "b"))).alias("sets"))
    assert all(r["sets"] < 10 for r in rows.collect())
