"""String helpers as columns. Nulls give nulls unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\r\n\f\v"


def first_word(s: Column) -> Column:
    """What stands before the first space."""
    return F.substring_index(s, " ", 1)


def words(s: Column) -> Column:
    """The words between spaces, without empty ones."""
    return F.filter(F.split(s, " "), lambda w: w != "")


def options(s: Column) -> Column:
    """The values of a comma-separated option, empty ones included."""
    return F.split(s, ",")


def after_last(s: Column, separator: str = "/") -> Column:
    return F.substring_index(s, separator, -1)


def sample_label(path: Column) -> Column:
    """A sample's label from the common start of its file names: the last part of the path, without joining marks at its end."""
    return F.regexp_replace(after_last(path), r"[_.\-/]+$", "")


def common_prefix(strings: Column) -> Column:
    """The longest common start of an array of strings; of none, an empty one."""
    low, high = F.array_min(strings), F.array_max(strings)
    # What the smallest and the largest share, all share.
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(low), F.length(high))), lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n))
    return F.coalesce(F.substring(low, F.lit(1), F.array_max(same)), F.lit(""))


def trimmed(s: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(s, F.lit(WHITE))


def right_trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"[ \t\r\n\f\x0B]+$", "")


def haplotypes(alleles: Column) -> Column:
    """Allele numbers joined by slashes; a negative or null one is a point."""
    return F.array_join(F.transform(alleles, lambda a: F.when(a >= 0, a.cast("string")).otherwise(F.lit("."))), "/")


def locus(chrom: Column, low: Column, high: Column | None = None) -> Column:
    """chrom:low-high; with one 0-based position, chrom:position+1."""
    return F.concat(chrom, F.lit(":"), (low + 1).cast("string")) if high is None else F.concat(chrom, F.lit(":"), low.cast("string"), F.lit("-"), high.cast("string"))


def symbol(base: Column) -> Column:
    """The symbol a base is counted under: U as T, what is none of the four as N."""
    upper = F.upper(base)
    return F.when(upper == "U", F.lit("T")).when(upper.isin("A", "C", "G", "T"), upper).otherwise(F.lit("N"))


def indels(symbols: Column) -> Column:
    """Text of the indels in an array of (symbol, n): insertions by sequence, then deletions by length; a point if none.

    An insertion is the symbol ``+SEQ``, a deletion ``-LENGTH``.
    """
    text = lambda x: F.concat(x.symbol, F.lit(":"), x.n.cast("string"))
    inserted = F.transform(F.array_sort(F.filter(symbols, lambda x: x.symbol.startswith("+"))), text)
    lengths = F.transform(F.filter(symbols, lambda x: x.symbol.startswith("-")), lambda x: F.struct(F.substring(x.symbol, F.lit(2), F.length(x.symbol)).cast("long").alias("length"), x.symbol.alias("symbol"), x.n.alias("n")))
    return F.coalesce(F.nullif(F.array_join(F.concat(inserted, F.transform(F.array_sort(lengths), text)), ","), F.lit("")), F.lit("."))


def karyotype_rank(chrom: Column) -> Column:
    """1 to 25 for the human chromosomes 1 to 22, X, Y, M (with or without chr), 26 for all others; sort by it and by name."""
    name = F.regexp_replace(chrom, "^chr", "")
    number = F.when(name.rlike("^([1-9]|1[0-9]|2[0-2])$"), name.try_cast("int"))
    return F.coalesce(number, F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25).otherwise(26))
