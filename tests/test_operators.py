"""Sources, operators, models and the whole run on small inputs."""

import dataclasses
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phredloom.operators import calibration, pairing, prep, rewrite, simulate, trees, truth
from phredloom.plans import cli, models, run
from phredloom.sources import aligners, fasta, fastq, matrix, sam


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_no_module_outside_imports_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "phredloom")):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "phredloom.llm" not in open(os.path.join(folder, n)).read()


# ------------------------------------------------------------ calibration (fixtures with stated values)
def table(spark, rows, pcor=False):
    t = spark.createDataFrame(rows, "stratum double, cor long, incor long")
    return calibration.roc(t, pcor_strata=pcor)


def test_roc_of_three_strata(spark):
    t = table(spark, [(2.0, 1, 1), (1.0, 1, 2), (0.0, 1, 1)])
    r = t.orderBy(F.desc("mapq")).collect()
    assert [x["cum"] for x in r] == [2, 5, 7] and [x["cum_incor"] for x in r] == [1, 3, 4] and [x["cum_cor"] for x in r] == [1, 2, 3] and [x["n"] for x in r] == [2, 3, 2]
    assert calibration.auc_and_sse(t).first()["auc"] == 14.0


def test_roc_of_events(spark):
    ev = spark.createDataFrame([(2.0, 0), (2.0, 1), (1.0, 0), (1.0, 1), (1.0, 1), (0.0, 0), (0.0, 1)], "q double, c int")
    r = calibration.roc(calibration.tally(ev, F.col("q"), F.col("c"))).orderBy(F.desc("mapq")).collect()
    assert [x["cum_cor"] for x in r] == [1, 3, 4] and [x["cum_incor"] for x in r] == [1, 2, 3]
    ev = spark.createDataFrame([(0.0, 0), (0.0, 1), (1.0, 0), (1.0, 1), (1.0, 1)], "q double, c int")
    r = calibration.roc(calibration.tally(ev, F.col("q"), F.col("c")), pcor_strata=True).orderBy(F.desc("pcor")).collect()
    assert [x["se"] for x in r] == [1.0, 1.0] and [x["cum_se"] for x in r] == [1.0, 2.0] and [x["cum"] for x in r] == [3, 5]


def test_curves(spark):
    t = table(spark, [(0.0, 1, 1), (1.0, 1, 2)], pcor=True)
    c = calibration.curves(t).orderBy("rank").collect()
    assert [x["ci"] for x in c] == pytest.approx([0, 2 / 3, 4 / 3, 2, 2.5, 3])
    t = table(spark, [(0.0, 1, 1), (0.1, 0, 1), (0.9, 1, 0), (1.0, 1, 2)], pcor=True)
    c = calibration.curves(t).orderBy("rank").collect()
    assert [x["ci"] for x in c] == pytest.approx([0, 2 / 3, 4 / 3, 2, 2, 3, 3.5, 4])
    assert [x["ce"] for x in c] == pytest.approx([0, 2 / 3, 4 / 3, 2, 2.01, 2.02, 2.52, 3.02])
    assert calibration.auc_and_sse(t).first()["sse"] == pytest.approx(3.02)
    d = calibration.curve_difference(t, t).collect()
    assert all(x["ci_diff"] == 0 for x in d) and len(d) == 8


def test_summary_and_top(spark, tmp_path):
    p = spark.createDataFrame([("u", i, float(i % 40), i % 30, int(i % 4 != 0)) for i in range(200)], "category string, id long, mapq double, mapq_orig int, correct int")
    s = calibration.summary(p).first()
    assert s["auc_diff_pct"] == s["auc_diff_pct_round"]
    assert [r["id"] for r in calibration.top_incorrect(p, 3).collect()] == [36, 76, 116]
    assert calibration.top_incorrect(p, 2, lowest_first=True).first()["mapq"] == 0
    assert calibration.assessable(p) and not calibration.assessable(p.withColumn("correct", F.lit(-1)))
    with pytest.raises(ValueError):
        calibration.assessable(p, 10)
    with pytest.raises(ValueError):
        calibration.assessable(p.withColumn("correct", F.when(F.col("id") > 5, -1).otherwise(1)))
    one = spark.range(1)
    assert one.select(calibration.percent_change(F.lit(1.0), F.lit(0.0)).alias("v")).first()["v"] == float("inf")
    assert one.select(calibration.percent_change(F.lit(0.0), F.lit(0.0)).alias("v")).first()["v"] == 0
    calibration.write_tables(p, str(tmp_path))
    assert set(os.listdir(tmp_path)) == {"roc.csv", "roc_round.csv", "roc_orig.csv", "top_incorrect.csv", "summary.csv"}


# ------------------------------------------------------------ sources
def test_fasta_chunks(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">record1 full name\nAAAA\nCCCCGGGG\nTTTT\n>record2\nAT\n>record3\nA\n")
    (tmp_path / "b.fa").write_text("\n>record4\nTG\n")
    (tmp_path / "c.fa").write_text("\n>record5\nCx\n")
    got = fasta.read_fasta(spark, [str(tmp_path / f"{x}.fa") for x in "abc"], chunk=2, overlap=1).orderBy("refid", "refoff").collect()
    first = [r for r in got if r["refid"] == "record1"]
    assert [r["refoff"] for r in first] == list(range(15)) and all(r["retsz"] == 2 and r["refid_full"] == "record1 full name" for r in first)
    seq = "AAAACCCCGGGGTTTT"
    assert [r["seq"] for r in first] == [seq[i : i + 2] for i in range(15)]
    assert [(r["refid"], r["seq"]) for r in got if r["refid"] != "record1"] == [("record2", "AT"), ("record3", "A"), ("record4", "TG"), ("record5", "CN")]
    whole = spark.createDataFrame([("r", "r x", seq)], "refid string, refid_full string, seq string")
    assert sorted((r["refoff"], r["seq"]) for r in fasta.chunks_of(whole, 5, 2).collect()) == sorted((i, seq[i : i + 5]) for i in (0, 3, 6, 9, 12))
    assert fasta.size_estimate(spark, [str(tmp_path / "a.fa")]).first()["bytes"] == os.path.getsize(tmp_path / "a.fa")


def test_fasta_over_blocks(spark, tmp_path):
    import random

    rng = random.Random(3)
    seqs = {f"r{i}": "".join(rng.choices("ACGT", k=rng.randint(0, 900))) for i in range(40)}
    (tmp_path / "x.fa").write_text("".join(f">{n} d\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in seqs.items()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = fasta.read_fasta(spark, str(tmp_path / "x.fa"), chunk=100, overlap=20).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["refid"] for r in got} == {n for n, s in seqs.items() if s}
    for r in got:
        assert r["seq"] == seqs[r["refid"]][r["refoff"] : r["refoff"] + 100]
    for n, s in seqs.items():
        assert sorted(r["refoff"] for r in got if r["refid"] == n) == [k for k in range(0, len(s), 80) if k == 0 or k + 20 < len(s)]


def test_templates_sink(spark, tmp_path):
    t = spark.createDataFrame([("c", (1, "I"), 5)], "category string, m1 struct<score:int,qual:string>, fraglen long")
    rewrite.write_templates(t, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).columns == ["category", "m1_score", "m1_qual", "fraglen"]


def test_line_numbers_over_blocks(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sam.numbered_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 6000 and all(r["raw"][1:] == str(r["line"]) for r in got)


def test_matrix_round_trip(spark, tmp_path):
    p = str(tmp_path / "m")
    values = (np.arange(1000) - 10000).reshape(500, 2) / 1.234534
    matrix.write_matrix(p, ["alpha", "bravo"], values)
    got = matrix.read_matrix(spark, p, 7)
    assert got.columns == ["alpha", "bravo"] and got.count() == 500
    assert np.allclose(np.array(sorted(map(tuple, got.collect()))), np.array(sorted(map(tuple, values))))
    matrix.write_matrix(p, ["alpha", "bravo"], np.array([[np.nan, 1.0]]), append=True)
    assert matrix.read_matrix(spark, p, 0).filter("alpha is null").count() == 1
    with pytest.raises(ValueError):
        matrix.read_tables(spark, p)
    matrix.write_matrix(p + "_rec_u", ["x"], np.ones((3, 1)))
    assert list(matrix.read_tables(spark, p)) == ["u"]


def test_matrix_sink(spark, tmp_path):
    p = f"file://{tmp_path}/m"
    df = spark.range(1000).repartitionByRange(7, "id").selectExpr("id as `a.b`", "id / 3 as x", "if(id % 5 = 0, null, cast(id as float)) as y")
    matrix.save_matrix(df, p)
    assert matrix.read_meta(p) == (["a.b", "x", "y"], 1000)
    got = matrix.read_matrix(spark, p, 64)
    assert got.rdd.getNumPartitions() >= 16
    assert list(map(tuple, got.collect())) == [(float(i), i / 3, None if i % 5 == 0 else float(i)) for i in range(1000)]  # in order
    matrix.save_matrix(df.filter("id < 10"), p, append=True)
    assert matrix.read_matrix(spark, p).count() == 1010
    assert not [f for f in os.listdir(tmp_path) if "writing" in f]
    with pytest.raises(Exception, match="cannot follow"):
        matrix.save_matrix(df.select("x"), p, append=True)
    matrix.single_file(spark, p)
    raw = np.fromfile(f"{tmp_path}/m.npy").reshape(1010, 3)
    assert raw[999].tolist() == [999.0, 333.0, 999.0] and raw[1001].tolist() == [1.0, 1 / 3, 1.0] and np.isnan(raw[5, 2])
    matrix.save_matrix(df.filter("id < 3"), p, append=True)  # after one file
    assert [r["a.b"] for r in matrix.read_matrix(spark, p, 0).collect()][-4:] == [9.0, 0.0, 1.0, 2.0]
    matrix.save_matrix(df.limit(0), p)
    assert matrix.read_meta(p)[1] == 0 and matrix.read_matrix(spark, p).count() == 0
    feats = spark.createDataFrame([("u", 1.0, None), ("u", 2.0, 3.0), ("c", 4.0, 5.0)], "category string, a double, b double")
    matrix.save_tables(feats, f"{tmp_path}/t", {"u": ["a"], "c": ["a", "b"], "d": ["b"]})
    assert {k: v.count() for k, v in matrix.read_tables(spark, f"{tmp_path}/t").items()} == {"u": 2, "c": 1}


def test_a_short_matrix_file_is_an_error(spark, tmp_path):
    p = str(tmp_path / "m")
    matrix.write_matrix(p, ["a", "b"], np.ones((5, 2)))
    with open(p + ".npy", "r+b") as f:
        f.truncate(8 * 7)
    with pytest.raises(Exception, match="ends before"):
        matrix.read_matrix(spark, p).collect()


def test_fastq_and_interleave(spark, tmp_path):
    import gzip

    for m in (1, 2):
        with gzip.open(tmp_path / f"r{m}.fq.gz", "wt") as f:
            f.write("".join(f"@r{i}{'/1' if m == 1 else ''}\nAC{m}\n+\nII{m}\n" for i in range(5)))
    a, b = (fastq.read_fastq(spark, str(tmp_path / f"r{m}.fq.gz")) for m in (1, 2))
    rows = rewrite.interleave(a, b).collect()
    assert [r["name"] for r in rows] == [f"r{i}/{m}" for i in range(5) for m in (1, 2)] and rows[1]["seq"] == "AC2"
    assert fastq.to_lines(a).orderBy("ordinal").first()["value"] == "@r0/1\nAC1\n+\nII1"


def test_aligner_command_lines():
    job = aligners.Job(index="idx", sam="o.sam", paired=[("a1", "a2"), ("b1", "b2")], args=["-p", "4"])
    assert aligners.Bowtie2().argv(job)[2:] == ["-q", "-1", "a1,b1", "-2", "a2,b2", "-p", "4", "-S", "o.sam", "-x", "idx"]
    with pytest.raises(ValueError):
        aligners.BwaMem().argv(job)
    assert aligners.BwaMem("x").argv(aligners.Job(index="i", sam="o", interleaved=["r"])) == ["x", "mem", "-p", "-o", "o", "i", "r"]
    assert aligners.Snap().argv(aligners.Job(index="i", sam="o", unpaired=["u.gz"], paired=[("a", "b")])) == ["snap-aligner", "single", "i", "-compressedFastq", "u.gz", "-o", "-sam", "o", ",", "paired", "i", "-fastq", "a", "b", "-o", "-sam", "o"]
    assert aligners.Hisat2().supports_mix() and not aligners.Snap().supports_mix()
    with pytest.raises(ValueError):
        aligners.Bowtie2().argv(aligners.Job(index="", sam="o", unpaired=["u"]))
    own, common, unpaired, paired = cli.sections(["--seed", "1", "--", "-p", "2", "--", "--", "-X", "5"])
    assert (own, common, unpaired, paired) == (["--seed", "1"], ["-p", "2"], [], ["-X", "5"])
    with pytest.raises(SystemExit):
        cli.check(cli.parser().parse_args(["--U", "a", "--m1", "b", "--m2", "c"]))
    a = cli.parser().parse_args(["--U", "r.fq", "--index", "i", "--aligner", "bwa-mem", "--max-leaf-nodes", "None,5"])
    assert a.max_leaf_nodes == [None, 5] and len(cli.commands(a, [[], [], []])) == 3
    assert cli.options(a).models.max_leaf_nodes == [None, 5]


# ------------------------------------------------------------ preparation
def test_impute_scopes(spark):
    df = spark.createDataFrame([("u", 1, 1.0, None), ("u", 2, None, None), ("u", 3, 9.0, None), ("c", 4, None, 2.0)], "category string, id long, a double, b double")
    got = {r["id"]: (r["a"], r["b"]) for r in prep.impute(df, ["a", "b"]).collect()}
    assert got == {1: (1, 0), 2: (10, 0), 3: (9, 0), 4: (0, 2)}
    assert {r["id"]: r["a"] for r in prep.impute(df, ["a"], chunk_rows=2).collect()}[2] == 2


def test_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 1.0, 3), (2, 2.0, 2.0, 5.0, 7.0, 3)], "id long, a double, b double, k double, z double, mapq int").withColumn("correct", F.lit(1))
    assert prep.feature_columns(df) == ["a", "z"]
    with pytest.raises(ValueError):
        prep.feature_columns(df.select("id", "k", "correct"))
    with pytest.raises(ValueError):
        prep.check_columns(df, ["nope"])
    with pytest.raises(Exception, match="not finite"):
        prep.check_columns(df.withColumn("a", F.lit(float("nan"))), ["a"]).collect()


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("category", F.when(F.col("id") % 10 == 0, "b").otherwise("u"))
    assert prep.subsample(df, 0.123, 5).count() == 123
    a, b = (sorted(r["id"] for r in prep.reservoir(df.repartition(n), 60, 5).collect()) for n in (2, 7))
    assert a == b and len(a) == 120
    want = {c: sorted((md5(f"5:{i}"), i) for i in range(1000) if (i % 10 == 0) == (c == "b"))[:60] for c in "bu"}
    assert a == sorted(i for rows in want.values() for _, i in rows)
    assert prep.reservoir(df, 10**6, 5).count() == 1000 and prep.reservoir(df, 0, 5).count() == 0
    with_null = df.withColumn("category", F.when(F.col("category") == "u", "u"))
    assert sorted((r["category"] or "", r["count"]) for r in prep.reservoir(with_null, 40, 5).groupBy("category").count().collect()) == [("", 40), ("u", 40)]


def test_nested_samples_are_those_of_each_fraction(spark):
    df = spark.range(900).withColumn("category", F.when(F.col("id") % 10 == 0, "b").otherwise("u")).repartition(4)
    got = prep.nested_samples(df, [0.5, 0.01, 0.1, 1.0, 0.0], [3, 4], by="category").collect()
    assert len(got) == 1800  # the sample of 1.0 holds every row
    for seed in (3, 4):
        for f in (0.01, 0.1, 0.5):
            for c in "bu":
                mine = sorted(r["id"] for r in got if r["seed"] == seed and r["category"] == c and r["fraction"] <= f)
                assert mine == sorted(r["id"] for r in prep.subsample(df.filter(F.col("category") == c), f, seed).collect())
    assert prep.nested_samples(df.limit(0), [0.5], [1]).count() == 0


# ------------------------------------------------------------ models
def test_hill_climb_visits_neighbours():
    seen = []

    def score(p):
        seen.append(tuple(p))
        return 10.0 - abs(p[0] - 6) - abs(p[1] - 1)

    params, best = models.climb([[1, 2, 3, 4, 5, 6, 7], [1, 2, 3]], score)
    assert params == [6, 1] and best == 10 and len(seen) == len(set(seen))
    assert seen[0][0] in (4, 5, 6)


def test_forest_learns_and_scores_itself():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + 0.2 * rng.normal(size=600) > 0).astype(float)
    for extra in (True, False):
        forest, left_out = zip(*(trees.fit_tree(x, y, None, i, 1.0, 20, 1, extra) for i in range(20)), strict=True)
        oob = trees.out_of_bag(y, left_out)
        assert oob > 0.5 and np.corrcoef(trees.predict_forest(forest, x), y)[0, 1] > 0.85
        assert all(sum(n[0] < 0 for n in t) <= 20 for t in forest)


@pytest.mark.parametrize("family", ["RandomForest", "ExtraTrees", "GradientBoosting"])
def test_models_calibrate(spark, family):
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    rows = [("u" if i % 2 else "c", i, float(a), float(b), None if i % 9 == 0 else float(c), int(30 * a), int(rng.random() < a)) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "category string, id long, a double, b double, c double, mapq int, correct int")
    s = models.Settings(model_family=family, num_trees=[5], max_features=[0.7], max_leaf_nodes=[8], learning_rate=[0.3], reweight_mapq=family == "RandomForest")
    fitted = models.fit(df, s)
    assert set(fitted) == {"u", "c"}
    p = models.predict(df, fitted)
    assert p.count() == 800
    r = p.agg(F.corr("pcor", "correct").alias("r"), F.max("mapq").alias("m")).first()
    assert r["r"] > 0.3 and r["m"] <= 60.0001
    same = models.predict(df, fitted, collapse=True)
    assert same.join(p.select("id", F.col("pcor").alias("q")), "id").filter(F.abs(F.col("pcor") - F.col("q")) > 1e-9).count() == 0
    imp = models.importances(fitted["u"], df).collect()
    assert imp[0]["feature"] == "a" and imp[0]["rank"] == 1
    assert models.parameters(fitted, spark).count() == 2


def test_postprocess(spark):
    def f(*p):
        return [round(r["pcor"], 7) for r in models.postprocess(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, pcor double")).orderBy("i").collect()]

    assert f(0.5, 1.0, 1.2, -0.1) == [0.5, 0.500001, 0.500001, 0.0]
    assert f(1.0, 1.0) == [0.999999, 0.999999]
    assert f(0.9999999) == [0.999999]


# ------------------------------------------------------------ simulation
def test_mutation(spark):
    def m(ref, xs):
        return spark.range(1).select(simulate.mutate(F.lit(ref), F.lit(xs), 1, F.lit(0)).alias("v")).first()["v"]

    assert m("ACGT", "====") == "ACGT" and m("ACGT", "=D==") == "AGT"
    x = m("ACGT", "=X==")
    assert x[0] == "A" and x[2:] == "GT" and x[1] in "AGT"
    i = m("AGT", "=I==")
    assert i[0] == "A" and i[2:] == "GT" and len(i) == 4
    s = m("AACC", "SS==")
    assert s[2:] == "CC" and len(s) == 4
    with pytest.raises(Exception, match="unknown edit"):
        m("ACGT", "=N==")
    o = spark.range(1).select(simulate.oriented(F.lit("AAACC"), F.lit("EDCBA"), F.lit(False)).alias("o")).first()["o"]
    assert (o["seq"], o["qual"]) == ("GGTTT", "ABCDE")


def test_target(spark):
    t = lambda n, *a, **k: spark.range(1).select(simulate.target(F.lit(n), *a, **k).alias("v")).first()["v"]
    assert t(0) == 0 and t(100, least=10) == 450 and t(100, least=1000) == 1000 and t(7, "linear", 2.0, 1) == 14 and t(7, "const", 9.0, 1) == 9


def write_sam(path, genome, rng, n, sim=False):
    """A small SAM file of all categories; ``sim`` names carry the truth."""
    comp = str.maketrans("ACGT", "TGCA")
    lines = ["@HD\tVN:1.0", f"@SQ\tSN:chr1\tLN:{len(genome)}"]

    def rec(name, flag, pos, clip, score):
        seq = genome[pos - 1 : pos - 1 + 30]
        cig = f"{clip}S{30 - clip}M" if clip else "30M"
        md = str(30 - clip)
        if not clip and score < 0:
            seq, md = seq[:10] + "ACGT"["ACGT".index(seq[10]) - 1] + seq[11:], f"10{seq[10]}19"
        return "\t".join([name, str(flag), "chr1", str(pos + clip), str(30 + score), cig, "*", "0", "0", seq, "I" * 29 + "5", f"ZT:Z:{score},NA,{pos % 7}", f"MD:Z:{md}", "XX:Z:a,b"])

    for i in range(n):
        p = rng.randint(1, len(genome) - 200)
        wrong = rng.random() < 0.2
        score = -rng.randint(1, 9) if wrong else 0
        clip = rng.choice([0, 0, 4])
        at = p + 100 if wrong else p
        kind = "ubcd"[i % 4]
        q2 = p + 60
        if kind == "u":
            name = f"sim!:chr1:+:{p - 1}:{score}:u" if sim else f"u{i}"
            lines.append(rec(name, 0, at, clip, score))
        elif kind == "b":
            name = f"sim!:chr1:+:{p - 1}:{score}:chr1:+:{p - 1}:{score}:b1" if sim else f"b{i}"
            lines.append(rec(name, 1 + 8 + 64, at, clip, score))
            lines.append("\t".join([name, str(1 + 4 + 128), "*", "0", "0", "*", "*", "0", "0", "A" * 25, "I" * 25]))
        else:
            name = f"sim!:chr1:+:{p - 1}:{score}:chr1:-:{q2 - 1}:{score}:{kind}" if sim else f"{kind}{i}"
            proper = 2 if kind == "c" else 0
            lines.append(rec(name, 1 + proper + 64, at, clip, score))
            lines.append(rec(name, 1 + proper + 128 + 16, at + 60, 0, score))
    lines.append(rec("sec", 256, 5, 0, 0))
    lines.append("\t".join(["lost", "4", "*", "0", "0", "*", "*", "0", "0", "ACGT", "IIII"]))
    path.write_text("\n".join(lines) + "\n")
    return lines, comp


def test_whole_run(spark, tmp_path):
    import random

    rng = random.Random(7)
    genome = "".join(rng.choices("ACGT", k=4000))
    (tmp_path / "g.fa").write_text(">chr1 test\n" + "\n".join(genome[i : i + 60] for i in range(0, 4000, 60)) + "\n")
    lines, _ = write_sam(tmp_path / "in.sam", genome, rng, 200)
    o = run.Options(ref=[str(tmp_path / "g.fa")], output_directory=str(tmp_path / "out"), sim_unp_min=300, sim_conc_min=200, sim_disc_min=100, sim_bad_end_min=100, sim_factor=1.0, write_orig_mapq=True, write_precise_mapq=True, assess_accuracy=True, keep_intermediates=True)
    o.models = models.Settings(num_trees=[5], max_features=[0.5], max_leaf_nodes=[8])

    single, pairs = run.parsed(spark, [str(tmp_path / "in.sam")], o)
    n = {r["category"]: r["count"] for r in single.groupBy("category").count().collect()} | {r["category"]: r["count"] for r in pairs.groupBy("category").count().collect()}
    assert n == {"u": 50, "b": 50, "c": 50, "d": 50}
    one, two = run.simulated(spark, single, pairs, o)
    one, two = one.toPandas(), two.toPandas()
    assert len(one) == 300 and len(two) == 2 * (200 + 100 + 100)
    for r in one[one.name.str.contains(r":\+:\d+:0:u$")].itertuples():  # unchanged reads are the reference at their place
        off = int(r.name.split(":")[3])
        ref = genome[off : off + 30]
        assert sum(a != b for a, b in zip(r.seq, ref)) <= 4
    assert set(two.groupby(["category", "read"]).size()) == {2}
    run.run_simulation(spark, [str(tmp_path / "in.sam")], o)

    write_sam(tmp_path / "tandem.sam", genome, rng, 400, sim=True)
    p = run.finish(spark, [str(tmp_path / "in.sam")], [str(tmp_path / "tandem.sam")], o).toPandas()
    assert len(p) == 50 + 50 + 100 + 100 and p.mapq.between(0, 60.001).all() and set(p.correct) == {-1}
    training = spark.read.parquet(f"{o.output_directory}/training_features")
    assert {r["category"]: r["n"] for r in training.groupBy("category").agg(F.min("correct").alias("n")).collect()} == dict.fromkeys("ubcd", 0)
    parts = sorted(f for f in os.listdir(f"{o.output_directory}/final.sam") if f.startswith("part-"))
    final = "".join(open(f"{o.output_directory}/final.sam/{f}").read() for f in parts).splitlines()
    assert len(final) == len(lines)
    by_line = {int(i): q for i, q in zip(p.id, p.mapq)}
    for k, (a, b) in enumerate(zip(lines, final), 1):
        if k not in by_line:
            assert a == b
            continue
        x, y = a.split("\t"), b.split("\t")
        assert y[:4] == x[:4] and y[4] == str(int(by_line[k] + 0.5)) and y[5:11] == x[5:11]
        assert y[11:] == [t for t in x[11:] if not t.startswith("ZT:Z:")] + [f"Zm:Z:{x[4]}", f"Zp:Z:{by_line[k]:.3f}"]
    assert {"params.csv", "featimport_u.csv", "timing.tsv", "predictions"} <= set(os.listdir(o.output_directory))


def test_series_of_fits_parses_once(spark, tmp_path):
    import random

    rng = random.Random(3)
    genome = "".join(rng.choices("ACGT", k=4000))
    lines, _ = write_sam(tmp_path / "in.sam", genome, rng, 60)
    write_sam(tmp_path / "tandem.sam", genome, rng, 240, sim=True)
    o = run.Options(output_directory=str(tmp_path / "out"), skip_rewrite=True)
    o.models = models.Settings(num_trees=[2], max_features=[1.0], max_leaf_nodes=[3])
    paths = [str(tmp_path / "in.sam")], [str(tmp_path / "tandem.sam")]
    series = [("trial0/sample0.5", 99099, 0.5), ("trial0/sample1.0", 99099, 1.0), ("trial1/sample1.0", 5, 1.0)]
    run.finish(spark, *paths, o, series)
    rows = {f: spark.read.csv(f"{o.output_directory}/{f}/params.csv", header=True).agg(F.sum(F.col("n_rows").cast("long"))).first()[0] for f, _, _ in series}
    assert rows["trial0/sample1.0"] == rows["trial1/sample1.0"] == 360 and rows["trial0/sample0.5"] == 180
    one = dataclasses.replace(o, output_directory=str(tmp_path / "one"), models=dataclasses.replace(o.models, subsample=0.5))
    run.finish(spark, *paths, one)
    a, b = (sorted(map(tuple, spark.read.parquet(f"{x}/predictions").select("id", "category", "pcor").collect())) for x in (f"{o.output_directory}/trial0/sample0.5", one.output_directory))
    assert a == b  # the nested sample is that of a fit by itself
    t = spark.read.csv(f"{o.output_directory}/timing.tsv", sep="\t", header=True, inferSchema=True)
    assert t.columns == ["step", *run.FIGURES]
    by = {r["step"]: r for r in t.collect()}
    assert set(by) == {"parsing tandem alignments", "parsing input alignments", "sampling training records", *(f"predictions {f}" for f, _, _ in series)}
    assert all(r["tasks"] > 0 and r["task_seconds"] > 0 for r in by.values()) and by["parsing input alignments"]["shuffle_mb"] > 0
    got = {r["figure"]: r["value"] for r in spark.read.csv(f"{o.output_directory}/timing.tsv.run", sep="\t", header=True, inferSchema=True).collect()}
    want = sam.counters(sam.read_sam(spark, *paths[:1])).first().asDict()
    assert {k: got[k] for k in want} == want and want["n_lines"] == len(lines)


def test_strict_parsing(spark, tmp_path):
    (tmp_path / "x.sam").write_text("r\t0\tc\t5\t9\t4M\t*\t0\t0\tACGT\tIIII\tMD:Z:4\n")
    records = sam.fields(sam.read_sam(spark, str(tmp_path / "x.sam")))
    with pytest.raises(Exception, match="without ZT:Z"):
        sam.alignments(records).select("ztz").collect()
    assert sam.alignments(records, strict=False).first()["edit_xscript"] == "===="
    assert sam.any_record(sam.read_sam(spark, str(tmp_path / "x.sam")))


def test_adjacent_mates(spark):
    df = spark.createDataFrame([("f", "a", 1, "1"), ("f", "b", 2, "2"), ("f", "a", 3, "2")], "file string, qname string, line long, mate_flag string")
    assert pairing.pair_mates(df).count() == 1
    with pytest.raises(Exception, match="not adjacent"):
        pairing.pair_mates(df, strict_adjacent=True).collect()


def test_merged_runs(spark):
    a = spark.createDataFrame([(0, 10.0), (2, 20.0), (3, 30.0), (10, 11.0), (12, 1.0)], "line long, mapq double")
    b = spark.createDataFrame([(1, 17.0), (4, 27.0), (6, 37.0), (11, 47.0), (14, 17.0), (15, 18.0)], "line long, mapq double")
    c = spark.createDataFrame([(5, 15.0), (7, 13.0), (8, 13.0), (9, 13.0)], "line long, mapq double")
    got = [r["line"] for r in rewrite.merge_runs([a, b, c]).orderBy("line").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15]
    with pytest.raises(Exception, match="a line twice"):
        rewrite.merge_runs([a, a]).collect()


def test_rewritten_in_order_moves_the_text_once(spark, tmp_path, capsys):
    rng, paths = random.Random(12), []
    for x in "ba":
        n = 150 if x == "a" else 70
        (tmp_path / f"{x}.sam").write_text("@HD\n" + "".join(f"r{i}\t0\tc\t{i}\t{i % 40}\t5M\t*\t0\t0\tACGTA\tIIIII\tZT:Z:1,NA\tNM:i:{i}\n" for i in range(n)))
        paths.append(str(tmp_path / f"{x}.sam"))
    lines = sam.read_sam(spark, paths)
    keys = [(r["file"], r["line"]) for r in lines.collect() if not r["is_header"] and rng.random() < 0.7]
    p = spark.createDataFrame([(f, n, rng.random() * 100) for f, n in keys] + [(keys[0][0], 9999, 5.0)], "file string, line long, mapq double")
    runs = [p.filter(f"line % 3 = {i}") for i in range(3)]
    want = [r["raw"] for r in rewrite.rewrite(lines, rewrite.merge_runs(runs), precise_flag="Zp:Z").orderBy("file", "line").collect()]
    rewrite.write_rewritten(lines, runs, str(tmp_path / "out"), precise_flag="Zp:Z")
    got = [x for part in sorted((tmp_path / "out").glob("part-*")) for x in part.read_text().splitlines()]
    assert got == want and len(got) == 222
    split = rewrite.rewritten_in_order(lines, runs, ranges=7, precise_flag="Zp:Z")
    assert [r["raw"] for r in split.collect()] == want and split.rdd.getNumPartitions() == 7
    capsys.readouterr()
    rewrite.rewritten_in_order(lines, runs, ranges=7).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange rangepartitioning") == 1 and "SortMergeJoin" not in plan and "hashpartitioning(file#" not in plan.split("BroadcastExchange")[0]
    assert rewrite.rewritten_in_order(lines, [p.limit(0)]).count() == 222
    for wrong in ([p, p.limit(1)], [p.withColumn("mapq", F.lit(101.0))], [p.withColumn("mapq", F.lit(None).cast("double"))]):
        with pytest.raises(Exception, match="a line twice"):
            rewrite.rewritten_in_order(lines, wrong).collect()


def test_names_of_unpaired_reads(spark):
    df = spark.createDataFrame([(i, f"x contig=c{i} orig_begin=4 orig_end=9 strand=reverse", "ACGTA", "IIIII") for i in range(3)], "ordinal long, name string, seq string, qual string")
    got = [r["name"] for r in truth.convert_unpaired(df).orderBy("idx").collect()]
    assert got == [f"c{i}_5_9_0:0:0_0:0:0_5_5_1_{i + 1}/1" for i in range(3)]


def test_streaming_counts(spark, tmp_path):
    from phredloom.streaming import tail

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sam").write_text("@HD\nr1\t0\tc\t1\t7\nr2\t4\tc\t1\t7\nr3\t16\tc\t1\t7\nr4\t256\tc\t1\t9\n")
    q = tail.quality_counts(tail.record_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("tail_counts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["mapq"], r["n"]) for r in spark.table("tail_counts").collect()] == [(7, 2)]


def test_curves_of_a_hot_stratum_are_made_in_many_tasks(spark):
    counts = spark.createDataFrame([(30.0, 1_500_000, 500_001), (10.0, 3, 1)], "stratum double, cor long, incor long")
    got = calibration.curves(calibration.roc(counts)).withColumn("task", F.spark_partition_id())
    r = got.agg(F.count("rank"), F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.max("ci")).first()
    assert tuple(r) == (2_000_006, 2_000_006, 0, 2_000_005, 500_002.0)
    assert got.filter("rank between 1 and 2000001").select("task").distinct().count() > 2


def test_features_of_two_files_meet_their_own_lines(spark, tmp_path):
    import random

    rng = random.Random(9)
    genome = "".join(rng.choices("ACGT", k=3000))
    for x in "ab":
        write_sam(tmp_path / f"{x}.sam", genome, rng, 40)
    o = run.Options()
    paths = [str(tmp_path / f"{x}.sam") for x in "ab"]
    f = run.features(*run.parsed(spark, paths, o), o)
    assert f.select("file", "id").distinct().count() == f.count() == 2 * f.select("id").distinct().count()
    p = f.select("file", F.col("id").alias("line"), F.when(F.col("file").endswith("a.sam"), 1.0).otherwise(2.0).alias("mapq"))
    merged = rewrite.merge_runs([p.filter("line % 2 = 0"), p.filter("line % 2 = 1")])
    lines = sam.read_sam(spark, paths)
    got = rewrite.rewrite(lines, merged).join(p, ["file", "line"])
    assert rewrite.rewrite(lines, merged).count() == lines.count()
    assert got.filter(F.get(F.split("raw", "\t"), F.lit(4)).cast("double") != F.col("mapq")).count() == 0


def test_vanilla_output_leaves_the_rewritten_lines_alone(spark, tmp_path):
    import random

    rng = random.Random(3)
    genome = "".join(rng.choices("ACGT", k=3000))
    write_sam(tmp_path / "in.sam", genome, rng, 60)
    write_sam(tmp_path / "tandem.sam", genome, rng, 200, sim=True)
    argv = ["--input-sam", str(tmp_path / "in.sam"), "--tandem-sam", str(tmp_path / "tandem.sam"), "--vanilla-output", str(tmp_path / "final"), "--temp-directory", str(tmp_path / "tmp"), "--max-rows", "50", "--num-trees", "2", "--max-features", "0.5", "--max-leaf-nodes", "4"]
    assert cli.main(argv) == 0
    assert sorted(os.listdir(tmp_path)) == ["final", "in.sam", "tandem.sam", "tmp"] and os.listdir(tmp_path / "tmp") == []
    assert sam.read_sam(spark, str(tmp_path / "final")).count() == sam.read_sam(spark, str(tmp_path / "in.sam")).count()


def test_predictions_are_calibrated_on_rows_left_out(spark):
    from phredloom.plans import catalog_models

    p = catalog_models.calibrated(spark, "/root/testdata/sf0.1").toPandas()
    assert len(p) == 400 and p.pcor.between(0, 1).all()
    assert abs(p.pcor.mean() - p.correct.mean()) < 0.1
