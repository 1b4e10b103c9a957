"""Command line: ``python -m phredloom.plans.cli``; sections after ``--`` are aligner arguments (common, unpaired, paired)."""

from __future__ import annotations

import argparse
import dataclasses

from phredloom.plans import models, run
from phredloom.session import session
from phredloom.sources.aligners import ALIGNERS, Job


def sections(argv: list[str]) -> list[list[str]]:
    """Own options, then aligner arguments: common, unpaired only, paired only."""
    out: list[list[str]] = [[]]
    for a in argv:
        if a == "--":
            out.append([])
        else:
            out[-1].append(a)
    return (out + [[], [], []])[:4]


def numbers(kind):
    return lambda s: [None if x == "None" else kind(x) for x in str(s).split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Predict mapping qualities and rewrite SAM")
    p.add_argument("--ref", nargs="+", default=[], help="FASTA files")
    p.add_argument("--U", nargs="+", default=[], help="unpaired reads")
    p.add_argument("--m1", nargs="+", default=[], help="mates 1")
    p.add_argument("--m2", nargs="+", default=[], help="mates 2")
    p.add_argument("--index", default="", help="aligner index")
    p.add_argument("--input-sam", nargs="+", default=[], help="input alignments")
    p.add_argument("--tandem-sam", nargs="+", default=[], help="alignments of the simulated reads")
    p.add_argument("--aligner", default="bowtie2", choices=sorted(ALIGNERS))
    for exe in ("bt2", "ht2", "bwa", "snap"):
        p.add_argument(f"--{exe}-exe", default="")
    p.add_argument("--model-family", default="RandomForest", choices=["RandomForest", "ExtraTrees", "GradientBoosting"])
    p.add_argument("--num-trees", type=numbers(int), default=[30])
    p.add_argument("--max-features", type=numbers(float), default=[0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45])
    p.add_argument("--max-leaf-nodes", type=numbers(int), default=[35])
    p.add_argument("--learning-rate", type=numbers(float), default=[0.75, 0.8, 0.85, 0.9, 0.95, 1.0])
    p.add_argument("--optimization-tolerance", type=float, default=0.01)
    p.add_argument("--reweight-ratio", type=float, default=1.0)
    p.add_argument("--reweight-mapq-offset", type=float, default=10.0)
    p.add_argument("--subsampling-series", type=numbers(float), default=[1.0])
    p.add_argument("--trials", type=int, default=1)
    p.add_argument("--max-rows", type=int, default=0, help="rows that share imputation constants (0: all of a category)")
    p.add_argument("--most-rows", type=int, default=200_000, help="training rows of a category that extra trees see")
    p.add_argument("--temp-directory", default=None, help="root of intermediate tables")
    p.add_argument("--vanilla-output", default=None, help="write only the rewritten SAM, here")
    p.add_argument("--sim-function", default="sqrt", choices=["sqrt", "linear", "const"])
    p.add_argument("--orig-mapq-flag", default="Zm:Z")
    p.add_argument("--precise-mapq-flag", default="Zp:Z")
    p.add_argument("--output-directory", default="out")
    p.add_argument("--sim-factor", type=float, default=45.0)
    ints = {"seed": 99099, "max-allowed-fraglen": 100_000, "input-model-size": 30_000, "sim-unp-min": 30_000, "sim-conc-min": 30_000, "sim-disc-min": 10_000, "sim-bad-end-min": 10_000, "wiggle": 30, "assess-limit": 100_000_000}
    for name, value in ints.items():
        p.add_argument(f"--{name}", type=int, default=value)
    for name in ("write-orig-mapq", "write-precise-mapq", "keep-ztz", "reweight-mapq", "collapse", "no-oob", "skip-rewrite", "predict-for-training", "try-include-mapq", "assess-accuracy", "keep-intermediates", "resume", "version", "print-commands"):
        p.add_argument(f"--{name}", action="store_true")
    return p


def options(a: argparse.Namespace) -> run.Options:
    own = {f.name: getattr(a, f.name) for f in dataclasses.fields(run.Options) if hasattr(a, f.name)}
    s = models.Settings(**{f.name: getattr(a, f.name) for f in dataclasses.fields(models.Settings) if hasattr(a, f.name)})
    return run.Options(**own, models=s)


def check(a: argparse.Namespace) -> None:
    if a.U and a.m1:
        raise SystemExit("--U and --m1 exclude each other")
    if len(a.m1) != len(a.m2):
        raise SystemExit("--m1 and --m2 need as many files")
    if a.vanilla_output and (a.keep_intermediates or a.output_directory != "out"):
        raise SystemExit("--vanilla-output goes without --output-directory and --keep-intermediates")


def commands(a: argparse.Namespace, extra: list[list[str]]) -> list[list[str]]:
    """Aligner command lines for the input reads and for the simulated ones."""
    exe = {"bowtie2": a.bt2_exe, "hisat2": a.ht2_exe, "bwa-mem": a.bwa_exe, "snap": a.snap_exe}[a.aligner]
    build, out = ALIGNERS[a.aligner](exe), a.output_directory
    more = {"index": a.index, "args": extra[0], "unpaired_args": extra[1], "paired_args": extra[2]}
    jobs = [Job(sam=f"{out}/input.sam", unpaired=a.U, paired=list(zip(a.m1, a.m2, strict=True)), **more)]
    one, two = [f"{out}/reads_u.fastq"], [(f"{out}/reads_paired_1.fastq", f"{out}/reads_paired_2.fastq")]
    if build.supports_mix():
        jobs.append(Job(sam=f"{out}/tandem_both.sam", unpaired=one, paired=two, **more))
    else:
        jobs += [Job(sam=f"{out}/tandem_unp.sam", unpaired=one, **more), Job(sam=f"{out}/tandem_paired.sam", paired=two, **more)]
    return [build.argv(j) for j in jobs]


def main(argv: list[str]) -> int:
    own, *extra = sections(argv)
    a = parser().parse_args(own)
    if a.version:
        print("phredloom 1")
        return 0
    check(a)
    if a.print_commands:
        for c in commands(a, extra):
            print(" ".join(c))
        return 0
    spark = session()
    base = options(a)
    seeds = run.trials(a.trials, a.seed)
    several = len(seeds) * len(a.subsampling_series) > 1
    if a.tandem_sam:
        series = [(f"trial{i}/sample{part}", seed, part) for i, seed in enumerate(seeds) for part in a.subsampling_series] if several else None
        o = dataclasses.replace(base, models=dataclasses.replace(base.models, subsample=a.subsampling_series[0]))
        run.finish(spark, a.input_sam, a.tandem_sam, o, series)
        return 0
    for i, seed in enumerate(seeds):
        folder = f"{base.output_directory}/trial{i}" if len(seeds) > 1 else base.output_directory
        run.run_simulation(spark, a.input_sam, dataclasses.replace(base, seed=seed, output_directory=folder))
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
