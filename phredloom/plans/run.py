"""The whole job: parse, model and simulate; fit on labelled reads; predict; assess; rewrite.

Aligners run outside. Step ``simulate`` writes reads; align them with the
command of ``sources.aligners`` and give the result to step ``finish``.
Each step leaves a marker and is skipped if its output exists (``resume``).
Every path may be on any file system that Spark reads and writes.
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from phredloom.functions import readnames
from phredloom.operators import calibration, pairing, prep, rewrite, simulate
from phredloom.plans import models
from phredloom.session import Scratch, exists, size
from phredloom.sources import fasta, sam


@dataclass
class Options:
    """Options of a run, named as on the command line."""

    ref: list[str] = field(default_factory=list)
    output_directory: str = "out"
    seed: int = 99099
    max_allowed_fraglen: int = 100_000
    input_model_size: int = 30_000
    sim_unp_min: int = 30_000
    sim_conc_min: int = 30_000
    sim_disc_min: int = 10_000
    sim_bad_end_min: int = 10_000
    sim_function: str = "sqrt"
    sim_factor: float = 45.0
    wiggle: int = 30
    prefix: str = readnames.PREFIX
    write_orig_mapq: bool = False
    write_precise_mapq: bool = False
    orig_mapq_flag: str = "Zm:Z"
    precise_mapq_flag: str = "Zp:Z"
    keep_ztz: bool = False
    collapse: bool = False
    assess_accuracy: bool = False
    assess_limit: int = 100_000_000
    skip_rewrite: bool = False
    predict_for_training: bool = False
    resume: bool = False
    max_rows: int = 0  # rows that share imputation constants; 0: a whole category
    temp_directory: str | None = None
    keep_intermediates: bool = False
    vanilla_output: str | None = None  # write only the rewritten SAM, here
    models: models.Settings = field(default_factory=models.Settings)

    def least(self, category: str) -> int:
        return {"u": self.sim_unp_min, "c": self.sim_conc_min, "d": self.sim_disc_min, "b": self.sim_bad_end_min}[category]


FIGURES = ["seconds", "tasks", "task_seconds", "peak_execution_mb", "shuffle_mb", "spill_mb", "input_mb"]


class Timers:
    """Figures of each step: its time, and what the cluster's tasks took, from Spark's own record of the stages that ran in it.

    Stages belong to the step in which they were submitted, so steps must not
    overlap; a stage that Spark no longer keeps (see ``spark.ui.retainedStages``)
    is not counted.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.rows = spark, []

    def _next_stage(self) -> int:
        sc = self.spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return int(sc.dagScheduler().nextStageId())

    def _figures(self, stages: range) -> list[tuple[float, ...]]:
        store, out = self.spark.sparkContext._jsc.sc().statusStore(), []
        for i in stages:
            try:
                s = store.lastStageAttempt(i)
            except Py4JJavaError:  # no longer kept
                continue
            if s.numCompleteTasks():
                out.append((s.numCompleteTasks(), s.executorRunTime() / 1e3, s.peakExecutionMemory() / 1e6, s.shuffleWriteBytes() / 1e6, s.diskBytesSpilled() / 1e6, s.inputBytes() / 1e6))
        return out

    @contextmanager
    def step(self, name: str):
        first, t = self._next_stage(), time.time()
        yield
        took = time.time() - t
        new = self._figures(range(first, self._next_stage()))
        total = [sum(v[i] for v in new) for i in range(6)]
        total[2] = max((v[2] for v in new), default=0.0)
        self.rows.append((name, took, int(total[0]), *map(float, total[1:])))

    def table(self) -> DataFrame:
        """One row a step: ``step`` and ``FIGURES``."""
        return self.spark.createDataFrame(self.rows, f"step string, seconds double, tasks long, {', '.join(f'{f} double' for f in FIGURES[2:])}")

    def write(self, path: str, more: list[tuple[str, float]]) -> None:
        """The table as ``<path>`` (tab-separated, with a header), and ``more`` figures of the whole run as ``<path>.run``."""
        self.table().coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)
        self.spark.createDataFrame(more, "figure string, value double").coalesce(1).write.mode("overwrite").csv(f"{path}.run", sep="\t", header=True)


def parsed(spark: SparkSession, paths: list[str], o: Options, scratch: Scratch | None = None, counted: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(single alignments, pairs) with categories, after the simulated-type filter.

    The text is parsed once and the mates meet once: what comes after reads tables.
    ``counted`` gets the counters of ``sam.counters``, observed while the text is
    parsed, so that no scan is made for them.
    """
    keep = (scratch or Scratch(spark, o.temp_directory)).keep
    seen = Observation()
    lines = sam.read_sam(spark, paths).observe(seen, *sam.counts())
    a = keep(sam.alignments(sam.fields(lines), o.wiggle, o.prefix))
    if counted is not None:
        counted |= seen.get
    single, pairs, _ = pairing.split_by_type(*pairing.classify(a, keep))
    return single, pairs


def features(single: DataFrame, pairs: DataFrame, o: Options, width: int | None = None) -> DataFrame:
    width = pairing.feature_width(single, pairs) if width is None else width
    one = pairing.unpaired_features(single, width)
    two = pairing.paired_features(pairs, width, o.max_allowed_fraglen)
    return prep.union_chunks([one, two])


def simulation_templates(single: DataFrame, pairs: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(templates with slots, one row of statistics and target a category)."""
    from pyspark.sql import Window

    s, p = pairing.unpaired_templates(single), pairing.paired_templates(pairs, o.max_allowed_fraglen)
    nothing = F.lit(None)
    s = s.select("category", "file", "line", F.col("best_score").alias("score1"), nothing.cast("int").alias("score2"), F.col("fw").alias("fw1"), nothing.cast("boolean").alias("fw2"), F.col("qual").alias("qual1"), nothing.cast("string").alias("qual2"), F.col("edit_xscript").alias("xscript1"), nothing.cast("string").alias("xscript2"), nothing.cast("boolean").alias("upstream1"), nothing.cast("long").alias("fraglen"), "mate_flag", "opp_len")
    p = p.select("category", "file", "line", F.col("m1.score").alias("score1"), F.col("m2.score").alias("score2"), F.col("m1.fw").alias("fw1"), F.col("m2.fw").alias("fw2"), F.col("m1.qual").alias("qual1"), F.col("m2.qual").alias("qual2"), F.col("m1.edit_xscript").alias("xscript1"), F.col("m2.edit_xscript").alias("xscript2"), "upstream1", "fraglen", nothing.cast("string").alias("mate_flag"), nothing.cast("int").alias("opp_len"))
    every = s.unionByName(p).filter(~F.col("xscript1").contains("N") & ~F.coalesce(F.col("xscript2").contains("N"), F.lit(False)))
    stats = every.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    targets = None
    for c in ("u", "b", "c", "d"):
        t = stats.filter(F.col("category") == c).select("category", simulate.target(F.col("n"), o.sim_function, o.sim_factor, o.least(c)).alias("target"))
        targets = t if targets is None else targets.unionByName(t)
    kept = prep.reservoir(every, o.input_model_size, o.seed, ids=("file", "line"))
    slot = F.row_number().over(Window.partitionBy("category").orderBy("file", "line")) - 1  # at most input_model_size rows a category
    return kept.withColumn("slot", slot.cast("long")), targets


def simulated(spark: SparkSession, single: DataFrame, pairs: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(unpaired reads, paired reads) drawn from the reference."""
    templates, targets = simulation_templates(single, pairs, o)
    templates = templates.cache()
    length = F.greatest(F.coalesce("fraglen", F.lit(0)), F.length("xscript1"), F.coalesce(F.length("xscript2"), F.lit(0)))
    overlap = int(templates.agg(F.max(length)).first()[0] or 1)
    chunks = simulate.usable_chunks(fasta.read_fasta(spark, o.ref, overlap=overlap), overlap)
    drawn = simulate.draw(simulate.allocate(chunks, targets, overlap), templates, overlap, o.seed)
    one = simulate.unpaired_reads(drawn.filter("category = 'u'"), o.seed, o.prefix)
    two = simulate.paired_reads(drawn.filter("category in ('c', 'd')"), o.seed, o.prefix)
    return one, two.unionByName(simulate.bad_end_reads(drawn.filter("category = 'b'"), o.seed, o.prefix))


def done(spark: SparkSession, path: str, o: Options) -> bool:
    return o.resume and exists(spark, f"{path}/_SUCCESS")


def fitted_and_predicted(spark: SparkSession, training: DataFrame, test: DataFrame, o: Options, out: str, scratch: Scratch) -> tuple[DataFrame, dict]:
    """Fit, predict, report and assess under ``out``; (predictions, what the assessment was based on).

    Whether labels are known is observed while predictions are written.
    """
    fitted = models.fit(training, o.models, o.max_rows)
    if not done(spark, f"{out}/predictions", o):
        seen = Observation()
        models.predict(test, fitted, o.collapse, o.max_rows, scratch).observe(seen, *calibration.label_range()).write.mode("overwrite").parquet(f"{out}/predictions")
        labels = seen.get
    else:
        labels = spark.read.parquet(f"{out}/predictions").agg(*calibration.label_range()).first().asDict()
    predictions = spark.read.parquet(f"{out}/predictions")
    models.parameters(fitted, spark).coalesce(1).write.mode("overwrite").csv(f"{out}/params.csv", header=True)
    for c, f in fitted.items():
        models.importances(f, training).coalesce(1).write.mode("overwrite").csv(f"{out}/featimport_{c}.csv", header=True)
    if o.predict_for_training:
        models.predict(training, fitted, o.collapse, o.max_rows, scratch).write.mode("overwrite").parquet(f"{out}/training_predictions")
    if o.assess_accuracy and calibration.labels_known(labels, o.assess_limit):
        calibration.write_tables(predictions, out)
    return predictions, labels


def finish(spark: SparkSession, input_sam: list[str], training_sam: list[str], o: Options, series: list[tuple[str, int, float]] | None = None) -> DataFrame:
    """Fit on the aligned simulated reads, predict for the input, assess and rewrite; returns the predictions.

    ``series`` holds (folder, seed, fraction) of several fits: the text is parsed
    once, one table holds the nested training samples of all of them, and each has its
    results in its own folder; the last one's predictions are returned.

    With ``vanilla_output`` only the rewritten SAM stays, else features stay
    with ``keep_intermediates``, and the other results always do.
    """
    timers, scratch, counted = Timers(spark), Scratch(spark, o.temp_directory), {}
    out = scratch.path("out") if o.vanilla_output else o.output_directory
    inner = out if (o.keep_intermediates or o.resume) and not o.vanilla_output else scratch.path("features")
    with timers.step("parsing tandem alignments"):
        if not done(spark, f"{inner}/training_features", o):
            rewrite.write_features(features(*parsed(spark, training_sam, o, scratch), o), f"{inner}/training_features")
        training = spark.read.parquet(f"{inner}/training_features")
    with timers.step("parsing input alignments"):
        if not done(spark, f"{inner}/input_features", o):
            rewrite.write_features(features(*parsed(spark, input_sam, o, scratch, counted), o), f"{inner}/input_features")
        test = spark.read.parquet(f"{inner}/input_features")
    runs = series or [("", o.models.seed, o.models.subsample)]
    samples = training
    if series:
        with timers.step("sampling training records"):
            samples = scratch.keep(prep.nested_samples(training, sorted({f for _, _, f in runs}), sorted({s for _, s, _ in runs}), tuple(models.row_key(training)), "category"))
    predictions = None
    for folder, seed, fraction in runs:
        to = f"{out}/{folder}" if folder else out
        mine = samples.filter((F.col("seed") == seed) & (F.col("fraction") <= fraction)).drop("seed", "fraction") if series else training
        own = replace(o, models=replace(o.models, seed=seed, subsample=1.0 if series else fraction))
        with timers.step(f"predictions {folder}".strip()):
            predictions, _ = fitted_and_predicted(spark, mine, test, own, to, scratch)
        if not o.skip_rewrite:
            with timers.step(f"rewriting SAM {folder}".strip()):
                lines = sam.read_sam(spark, input_sam)
                p = predictions.select("file", F.col("id").alias("line"), "mapq")
                flags = {"keep_features": o.keep_ztz, "orig_flag": o.orig_mapq_flag if o.write_orig_mapq else None, "precise_flag": o.precise_mapq_flag if o.write_precise_mapq else None}
                rewrite.write_rewritten(lines, [p], o.vanilla_output or f"{to}/final.sam", **flags)
    final = o.vanilla_output or f"{out}/{runs[-1][0]}/final.sam"
    if o.vanilla_output:
        predictions = spark.createDataFrame(predictions.limit(0).collect(), predictions.schema)
    else:
        used = max(scratch.peak, size(spark, scratch.root))
        written = size(spark, final)
        more = [("peak temporary MB", used / 1e6), ("temporary % of output SAM", 100 * used / max(1, written)), *((k, float(v)) for k, v in counted.items())]
        timers.write(f"{out}/timing.tsv", more)
    scratch.purge()
    return predictions


def run_simulation(spark: SparkSession, input_sam: list[str], o: Options) -> None:
    """Write simulated reads of the input's model as FASTQ text under the output folder."""
    from phredloom.sources.fastq import to_lines

    one, two = simulated(spark, *parsed(spark, input_sam, o), o)
    to_lines(one).orderBy("read").select("value").write.mode("overwrite").text(f"{o.output_directory}/reads_u.fastq")
    for m in (1, 2):
        to_lines(two.filter(F.col("mate") == m)).orderBy("category", "read").select("value").write.mode("overwrite").text(f"{o.output_directory}/reads_paired_{m}.fastq")


def trials(n: int, seed: int) -> list[int]:
    """A seed for each repetition, by a stable hash."""
    import zlib

    return [seed] + [zlib.crc32(f"{seed}:{i}".encode()) for i in range(1, n)]
