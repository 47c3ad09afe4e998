"""Where does one sample's base distribution diverge from the pool of all samples?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.stats import gamma_tail, genotype, heterozygous_fit, homozygous_fit
from strandloom.functions.strings import karyotype_rank, locus
from strandloom.operators.intervals import in_regions
from strandloom.operators.pileup import divergences
from strandloom.operators.stats import gamma_fit
from strandloom.sources.fasta import context
from strandloom.sources.shared import cut


#: Headings of the table as a file has them, where they differ from the column names.
HEADINGS = {"num_samples": "num.samples", "pseudo_allele_count": "pseudo.allele.count"}


def as_file(table: DataFrame) -> DataFrame:
    """The table of ``significant`` with the headings of a file, sorted by chromosome in karyotype order and position."""
    chrom, pos = F.substring_index("locus", ":", 1), F.substring_index("locus", ":", -1).cast("long")
    ordered = table.orderBy(karyotype_rank(chrom), chrom, pos, "sample")
    return ordered.withColumnsRenamed(HEADINGS)


def train(places: DataFrame, coverage: int) -> DataFrame:
    """context, gamma_n, k, theta from divergences with contexts: pooled total above coverage, samples reaching it."""
    used = places.where((F.col("pool_total") > coverage) & (F.col("pool_alleles") > 1) & (F.col("total") >= coverage))
    return gamma_fit(used, "kld", ["context"])


def significant(places: DataFrame, models: DataFrame, coverage: int, most_p: float = 1e-5, most_fit: float = 0.1) -> DataFrame:
    """The 16-column table of places where a sample diverges; a context without a model raises an error when rows are read.

    A place needs a pooled total of coverage and two samples that reach it. Samples below it are part of the pool.
    """
    reached = places.where((F.col("pool_total") >= coverage) & (F.col("pool_alleles") > 1) & (F.col("total") >= coverage))
    enough = reached.groupBy("chrom", "pos").agg(F.count("*").alias("samples")).where("samples >= 2")
    joined = reached.join(enough, ["chrom", "pos"]).join(models.select("context", "k", "theta", F.lit(True).alias("known")), "context", "left")
    checked = joined.withColumn("kld", F.when(F.col("known"), F.col("kld")).otherwise(F.raise_error(F.concat(F.lit("no model of context "), F.col("context"))).cast("double")))
    tested = checked.withColumn("pvalue", gamma_tail(F.col("kld"), F.col("k"), F.col("theta"))).where(F.col("pvalue") <= most_p)
    name, fit = genotype(F.col("hom"), F.col("het"))
    fitted = tested.withColumn("hom", homozygous_fit(F.col("shares"))).withColumn("het", heterozygous_fit(F.col("shares"))).withColumn("gt", name).withColumn("fit", fit).where(F.col("fit") <= most_fit)
    return fitted.select(
        locus(F.col("chrom"), F.col("pos")).alias("locus"), F.col("samples").alias("num_samples"), "context", "sample", F.col("kld").alias("divergence"), "pvalue", F.col("alleles").alias("pseudo_allele_count"), "gt", "fit", F.col("total").alias("cov"), "A", "C", "G", "T", "N", "indels"
    )


def divergence(symbols: DataFrame, reference: DataFrame, *, coverage: int = 10, regions: DataFrame | None = None, models: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, models) of a pileup (sample, chrom, pos, symbol, n) and a reference (name, seq).

    Models are trained on the same pileup unless they are given. The divergences are written once, to the shared folder.
    """
    used = symbols if regions is None else in_regions(symbols, regions)
    places = cut(context(divergences(used), reference), "places")
    models = train(places, coverage) if models is None else models
    return significant(places, models, coverage), models
