"""Nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes and their complements.
CODES = "ABCDGHKMNRSTVWY-"
COMPLEMENTS = "TVGHCDMKNYSABWR-"


def normalise(seq: Column) -> Column:
    """a, c, g, t in upper case; everything but A, C, G, T becomes N (one for each character)."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES + CODES.lower(), COMPLEMENTS + COMPLEMENTS))
