"""K-mers as columns. A code packs two bits a base (A 0, C 1, G 2, T 3), the first base most significant.

K is between 1 and 31, so that codes stay positive longs and sort as their strings do. Letters may be of either
case; U is not accepted. Nulls give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, DIGITS, COMPLEMENTS = "ACGT", "0123", "TGCA"
#: Every second bit of a long, from the lowest on.
LOW_BITS = 0x5555555555555555


def checked(k: int) -> int:
    if not 1 <= k <= 31:
        raise ValueError(f"k must be between 1 and 31, not {k}")
    return k


def runs(seq: Column, k: int) -> Column:
    """The runs of valid bases of a sequence that hold a k-mer, in upper case."""
    return F.filter(F.split(F.upper(seq), "[^ACGT]+"), lambda run: F.length(run) >= checked(k))


def kmer_array(seq: Column, k: int) -> Column:
    """All k-mers of a short sequence in order; windows with an invalid letter are left out.

    Positions within a run cost a scan of the run, so sequences much longer than reads go through
    ``operators.kmers.kmers``, which takes linear time.
    """
    return F.flatten(F.transform(runs(seq, k), lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - k + 1), lambda i: F.substring(run, i, F.lit(k)))))


def windows(seq: Column, k: int) -> Column:
    """(pos, kmer) of a short sequence, pos from 0; windows with an invalid letter are left out."""
    checked(k)
    last = F.length(seq) - k
    every = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.upper(F.substring(seq, i + 1, F.lit(k))).alias("kmer"))))
    return F.filter(F.coalesce(every, F.array().cast("array<struct<pos:int,kmer:string>>")), lambda w: w.kmer.rlike(f"^[ACGT]{{{k}}}$"))


def encode(kmer: Column) -> Column:
    """Code of a k-mer; 0 if a letter is invalid, as for a run of A."""
    code = F.conv(F.translate(F.upper(kmer), BASES, DIGITS), 4, 10).cast("long")
    return F.when(kmer.isNull(), None).when(F.upper(kmer).rlike("^[ACGT]{1,31}$"), code).otherwise(F.lit(0).cast("long"))


def decode(code: Column, k: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), checked(k), "0"), DIGITS, BASES)


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(F.upper(kmer), BASES, COMPLEMENTS))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(F.upper(kmer), reverse_complement(kmer))


def hamming(a: Column, b: Column) -> Column:
    """Number of bases in which two codes differ."""
    z = a.bitwiseXOR(b)
    return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(LOW_BITS))).cast("int")


def base_code(letter: Column) -> Column:
    """0 to 3 of a letter, null if it is no base."""
    at = F.instr(F.lit(BASES), F.upper(letter))
    return F.when((F.length(letter) == 1) & (at > 0), at - 1)


def entropy(kmer: Column, k: int, width: int) -> Column:
    """Entropy in bits of the sub-words of a k-mer; shares are taken of k, not of the number of sub-words."""
    words = F.transform(F.sequence(F.lit(1), F.lit(checked(k) - width + 1)), lambda i: F.substring(kmer, i, F.lit(width)))
    shares = F.transform(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w)) / F.lit(float(k)))
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))
