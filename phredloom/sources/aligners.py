"""Command lines of aligners. Nothing is executed here; a caller runs the list it gets."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Job:
    """What to align. Paired inputs are (mate 1, mate 2) files; interleaved ones hold both mates."""

    index: str
    sam: str
    unpaired: list[str] = field(default_factory=list)
    paired: list[tuple[str, str]] = field(default_factory=list)
    interleaved: list[str] = field(default_factory=list)
    args: list[str] = field(default_factory=list)
    unpaired_args: list[str] = field(default_factory=list)
    paired_args: list[str] = field(default_factory=list)
    fmt: str = "fastq"

    def check(self) -> None:
        if not self.index:
            raise ValueError("an index is needed")
        if not self.sam:
            raise ValueError("a SAM output path is needed")
        if not (self.unpaired or self.paired or self.interleaved):
            raise ValueError("reads are needed: unpaired, paired or interleaved")


class Aligner:
    """Builds the argument vector of one aligner; ``mixes`` says whether one run takes unpaired and paired reads."""

    exe, mixes, extra = "", False, ()

    def __init__(self, exe: str = ""):
        self.exe = exe or self.exe

    def supports_mix(self) -> bool:
        return self.mixes

    def argv(self, job: Job) -> list[str]:
        job.check()
        return self.build(job)

    def build(self, job: Job) -> list[str]:
        raise NotImplementedError


class Bowtie2(Aligner):
    exe, mixes = "bowtie2", True
    extra = ("--mapq-extra",)

    def build(self, job: Job) -> list[str]:
        form = {"fastq": ["-q"], "fasta": ["-f"], "raw": ["-r"]}.get(job.fmt, [])
        reads = list(form)
        if job.unpaired:
            reads += ["-U" if form else f"--{job.fmt}", ",".join(job.unpaired), *job.unpaired_args]
        if job.paired:
            one, two = zip(*job.paired, strict=True)
            reads += ["-1", ",".join(one), "-2", ",".join(two), *job.paired_args]
        if job.interleaved:
            reads += ["--interleaved" if form else f"--{job.fmt}", ",".join(job.interleaved), *job.paired_args]
        return [self.exe, *self.extra, *reads, *job.args, "-S", job.sam, "-x", job.index]


class Hisat2(Bowtie2):
    exe = "hisat2"


class BwaMem(Aligner):
    exe = "bwa"

    def build(self, job: Job) -> list[str]:
        if len(job.unpaired) > 1 or len(job.paired) > 1 or len(job.interleaved) > 1:
            raise ValueError("bwa mem takes one input at a time")
        if job.unpaired and (job.paired or job.interleaved):
            raise ValueError("bwa mem takes unpaired or paired reads, not both")
        if job.unpaired:
            reads, own = job.unpaired, job.unpaired_args
        else:
            reads, own = list(job.paired[0]) if job.paired else ["-p", *job.interleaved], job.paired_args
        flags, files = ([reads[0]], reads[1:]) if reads[0] == "-p" else ([], reads)
        return [self.exe, "mem", *flags, *job.args, *own, "-o", job.sam, job.index, *files]


class Snap(Aligner):
    exe = "snap-aligner"

    def build(self, job: Job) -> list[str]:
        def form(path: str, pair: bool) -> str:
            zipped = path.endswith(".gz")
            if pair:
                return "-pairedCompressedInterleavedFastq" if zipped else "-pairedInterleavedFastq"
            return "-compressedFastq" if zipped else "-fastq"

        sets = []
        if job.unpaired:
            sets.append(["single", job.index, form(job.unpaired[0], False), *job.unpaired, "-o", "-sam", job.sam, *job.unpaired_args, *job.args])
        if job.interleaved:
            sets.append(["paired", job.index, form(job.interleaved[0], True), *job.interleaved, "-o", "-sam", job.sam, *job.paired_args, *job.args])
        elif job.paired:
            files = [f for pair in job.paired for f in pair]
            sets.append(["paired", job.index, form(files[0], False), *files, "-o", "-sam", job.sam, *job.paired_args, *job.args])
        out = [self.exe]
        for i, s in enumerate(sets):
            out += [",", *s] if i else s
        return out


ALIGNERS = {"bowtie2": Bowtie2, "hisat2": Hisat2, "bwa-mem": BwaMem, "snap": Snap}
