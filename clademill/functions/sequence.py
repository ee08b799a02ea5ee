"""Column functions over nucleotide sequences and their metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ambiguity codes of nucleotides, other than N.
AMBIGUITY_CODES = "RYSWKMBDHV"
# The standard genetic code, codons in TCAG order.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def normalise(seq: Column, keep_gaps: bool = False) -> Column:
    """Upper case, without gaps unless they are kept."""
    return F.upper(seq if keep_gaps else F.translate(seq, "-", ""))


def acgt(seq: Column) -> Column:
    """Only A, C, G and T, in upper case; windows then span removed characters."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]+", "")


def bound(value: Column, f) -> Column:
    """``f(value)`` with ``value`` made once a row, and not again at every use inside a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k in order; none for shorter sequences."""

    def of(s: Column) -> Column:
        n = F.length(s)
        # letters as an array, so that each place is reached at once and not from the start of the string
        pieces = bound(F.split(s, ""), lambda x: F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(x, i, k), "")))
        return F.when(n >= k, pieces).otherwise(F.array().cast("array<string>"))

    return bound(seq, of)


def kmer_set(seq: Column, k: int) -> Column:
    """Distinct k-mers without N; other ambiguity codes stay."""
    return F.array_distinct(F.filter(kmers(seq, k), lambda x: ~F.contains(x, F.lit("N"))))


def recode_ambiguity(seq: Column) -> Column:
    """Every ambiguity code as N, one for one."""
    return F.translate(seq, AMBIGUITY_CODES, "N" * len(AMBIGUITY_CODES))


def ambiguity_fraction(seq: Column) -> Column:
    """Share of characters that are not A, C, G or T; 1 for the empty sequence."""
    n = F.length(seq)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - F.length(F.regexp_replace(F.upper(seq), "[^ACGT]+", "")) / n)


def mash_identity(shared: Column, size_a: Column, size_b: Column, k: int) -> Column:
    """Identity per cent from k-mer set sizes: 100 (1 + ln(2j / (1 + j)) / k), kept in 0 to 100."""
    raw = 100 * (1 + F.ln(2.0 * shared / (size_a + size_b)) / k)
    return F.when(shared <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))


def least_jaccard(identity: float, k: int) -> float:
    """The Jaccard similarity at which :func:`mash_identity` reaches ``identity``."""
    import math

    r = math.exp(k * (identity / 100 - 1))
    return r / (2 - r)


def _codon_amino(codons: Column) -> Column:
    """Amino acids of an array of codons, by positions in the code's table; X for other letters."""
    order = lambda c, i: F.instr(F.lit("TCAG"), F.substring(c, i, 1)) - 1

    def one(c: Column) -> Column:
        x, y, z = (order(c, i) for i in (1, 2, 3))
        return F.when((x < 0) | (y < 0) | (z < 0), "X").otherwise(F.substring(F.lit(_AMINO), 16 * x + 4 * y + z + 1, F.lit(1)))

    return F.array_join(F.transform(codons, one), "")


def translated(seq: Column, frame: int) -> Column:
    """Amino acids of one frame; codons with other letters give X; a terminal stop is dropped."""
    codons = F.regexp_extract_all(F.substring(seq, F.lit(frame + 1), F.length(seq)), F.lit("(...)"), F.lit(1))
    return F.regexp_replace(_codon_amino(codons), r"\*$", "")


def best_frame(seq: Column) -> Column:
    """Struct ``(internal_stops, aa_len, aa, frame)`` of the frame with fewest stops, then longest, then first."""

    def of(s: Column) -> Column:
        def told(f: int):
            def struct(aa: Column) -> Column:  # of one argument: a second would be given the element's index
                stops = F.length(aa) - F.length(F.replace(aa, F.lit("*"), F.lit("")))
                return F.struct(stops.alias("internal_stops"), (-F.length(aa)).alias("neg_len"), aa.alias("aa"), F.lit(f).alias("frame"))

            return struct

        return F.array_min(F.array(*(bound(translated(s, f), told(f)) for f in range(3))))

    best = bound(seq, of)
    return F.struct(best["internal_stops"].alias("internal_stops"), (-best["neg_len"]).alias("aa_len"), best["aa"].alias("aa"), best["frame"].alias("frame"))


def safe_slug(text: Column, default: str = "cluster") -> Column:
    """A file-name part: other characters as underscores, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def state_fields(state: Column) -> Column:
    """Struct ``(k, neighbors, min_dist, resolution)`` of a state slug; nulls where it does not match."""
    pattern = r"^k(\d+)_n(\d+)_d([0-9p]+(?:e-?\d+)?)(?:_r([0-9.e+-]+))?$"
    part = lambda i: F.nullif(F.regexp_extract(state, pattern, i), F.lit(""))
    return F.struct(
        part(1).cast("int").alias("k"), part(2).cast("int").alias("neighbors"),
        F.translate(part(3), "p", ".").cast("double").alias("min_dist"), part(4).cast("double").alias("resolution"))


# The colour below 70 per cent and for none, and the ramp's ends at 70 and 100.
HEAT_NONE = "#d9d9d9"
HEAT_LOW, HEAT_HIGH = (247, 251, 255), (8, 81, 156)


def heat_color(value: Column) -> Column:
    """``#rrggbb`` of an identity: grey below 70 and for null, else the ramp, each channel cut to whole numbers."""
    t = (F.greatest(F.lit(70.0), F.least(F.lit(100.0), value)) - 70.0) / 30.0
    channels = [(a + (b - a) * t).cast("int") for a, b in zip(HEAT_LOW, HEAT_HIGH, strict=True)]
    return F.when(value.isNull() | F.isnan(value) | (value < 70), F.lit(HEAT_NONE)).otherwise(F.format_string("#%02x%02x%02x", *channels))


def cluster_order(cluster: Column) -> list[Column]:
    """Sort columns: the letters, the digits as a number, the label itself."""
    return [F.regexp_replace(cluster, r"\d", ""), F.try_to_number(F.nullif(F.regexp_replace(cluster, r"\D", ""), F.lit("")), F.lit("999999999")), cluster]
