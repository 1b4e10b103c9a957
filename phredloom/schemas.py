"""Schemas of the tables that operators exchange."""

SAM_LINE = "file string, line long, raw string, is_header boolean"
CATEGORIES = ["u", "b", "c", "d"]  # unpaired, bad-end, concordant, discordant
CATEGORY_NUMBER = {"u": 1.0, "b": 2.0, "c": 3.0, "d": 4.0}
FIT_ORDER = ["d", "b", "c", "u"]
PREDICTION = "category string, file string, id long, pcor double, mapq double, mapq_orig int, correct int"
FASTA_CHUNK = "refid string, refid_full string, refoff long, retsz int, seq string"
