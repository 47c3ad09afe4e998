"""Allele-specific expression: genes x heterozygous sites x reads -> a ranked gene table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.stats import chi2_tail, g_statistic
from strandloom.functions.strings import haplotypes, locus
from strandloom.operators.cigar import counted, properly_paired
from strandloom.operators.intervals import stab_join
from strandloom.operators.stats import bh_threshold


#: Headings of the table as a file has them, where they differ from the column names.
HEADINGS = {
    "gene_name": "geneName", "gene_id": "geneId", "hetSites": "numHets", "meanCount": "avgCov", "sdCount": "covSd",
    "highHap": "highHaplo", "lowHap": "lowHaplo",
}


def as_file(table: DataFrame) -> DataFrame:
    """The gene table with the headings of a file."""
    return table.withColumnsRenamed(HEADINGS)


def few_sites(placed: DataFrame, min_hets: int) -> DataFrame:
    """low_hets: how many genes with sites have fewer than min_hets of them, as one row."""
    return placed.groupBy("chrom", "lo", "hi").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") < min_hets).alias("low_hets"))


def gene_sites(genes: DataFrame, sites: DataFrame) -> DataFrame:
    """chrom, pos, ord, alleles, lo, hi, gene_id, gene_name: heterozygous sites (chrom, pos, ord, alleles) in genes.

    Of genes on the same interval the last one stays (column line, else the largest id). A site that is given twice
    counts twice; its alleles are those of all its rows, in order.
    """
    last = F.max_by(F.struct("gene_id", "gene_name"), "line" if "line" in genes.columns else "gene_id").alias("g")
    unique = genes.groupBy("chrom", "lo", "hi").agg(last).select("chrom", "lo", "hi", "g.*")
    seen = sites.groupBy("chrom", "pos").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "alleles"))), lambda x: x["alleles"]))).alias("alleles"))
    return stab_join(sites.select("chrom", "pos", "ord"), unique).join(seen, ["chrom", "pos"])


def allele_counts(alignments: DataFrame, positions: DataFrame) -> DataFrame:
    """chrom, pos (1-based), allele, n over properly paired reads at the given positions only."""
    places = positions.select("chrom", (F.col("pos") - 1).alias("pos"))
    return counted(properly_paired(alignments), "alleles", ["chrom"], places).withColumn("pos", F.col("pos") + 1)


def top_two(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, major, minor (counts, 0 if missing), major_allele, minor_allele (N if missing): ties go to the larger allele."""
    best = F.sort_array(F.collect_list(F.struct("n", "allele")), asc=False)  # as many as distinct alleles at one place
    get = lambda i, f, none: F.coalesce(F.try_element_at("best", F.lit(i))[f], F.lit(none))
    out = counts.groupBy(*by).agg(best.alias("best"))
    return out.select(*by, get(1, "n", 0).alias("major"), get(2, "n", 0).alias("minor"), get(1, "allele", "N").alias("major_allele"), get(2, "allele", "N").alias("minor_allele"))


def gene_table(scored: DataFrame, min_hets: int, gene: list[str]) -> DataFrame:
    """One row for each gene with at least min_hets scored sites; scored: gene..., pos, ord, major, minor, numbers."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", F.col(c).alias("v")))), lambda x: x["v"])
    total = F.col("major") + F.col("minor")
    sums = scored.withColumn("g", g_statistic(F.col("major"), F.col("minor"))).groupBy(*gene).agg(
        F.count("*").alias("hetSites"), F.sum("major").alias("highCount"), F.sum("minor").alias("lowCount"), F.avg(total).alias("meanCount"), F.stddev_pop(total).alias("sdCount"), F.sum("g").alias("g"),
        ordered("major_number").alias("highHap"), ordered("minor_number").alias("lowHap"), ordered("pos").alias("positions"),
    )
    kept = sums.where((F.col("hetSites") >= min_hets) & (F.col("highCount") + F.col("lowCount") > 0))
    return kept.withColumn("highFrac", F.col("highCount") / (F.col("highCount") + F.col("lowCount"))).withColumn("pValue", chi2_tail(F.col("g"), F.col("hetSites")))


GENE = ["chrom", "lo", "hi", "gene_id", "gene_name"]


def measured(genes: DataFrame, sites: DataFrame, alignments: DataFrame, *, min_hets: int = 2, min_coverage: int = 10) -> DataFrame:
    """The gene table over the sites of genes with min_hets of them, from reads at sites with min_coverage of the major allele."""
    placed = gene_sites(genes, sites)
    enough = placed.groupBy("chrom", "lo", "hi").agg(F.count("*").alias("hets")).where(F.col("hets") >= min_hets).drop("hets")
    eligible = placed.join(enough, ["chrom", "lo", "hi"], "left_semi")
    counts = top_two(allele_counts(alignments, eligible), ["chrom", "pos"]).where(F.col("major") >= min_coverage)
    number = lambda c: (F.array_position("alleles", F.col(c)) - 1).cast("int")
    scored = eligible.join(counts, ["chrom", "pos"]).withColumn("major_number", number("major_allele"))
    return gene_table(scored.withColumn("minor_number", number("minor_allele")), min_hets, GENE)


def displayed(table: DataFrame) -> DataFrame:
    """table with locus, and with haplotypes and positions as texts."""
    positions = F.array_join(F.transform("positions", lambda p: p.cast("string")), "/")
    texts = {"highHap": haplotypes(F.col("highHap")), "lowHap": haplotypes(F.col("lowHap")), "positions": positions}
    return table.withColumns({"locus": locus(F.col("chrom"), F.col("lo"), F.col("hi"))} | texts)


def allele_specific_expression(
    genes: DataFrame, sites: DataFrame, alignments: DataFrame, *, min_hets: int = 2, min_coverage: int = 10, q: float = 0.05,
    min_fraction: float = 0.5, mode: str = "zero_based", ranked: bool = True,
) -> DataFrame:
    """The gene table, tested, filtered and sorted by p-value, then by falling share of the major allele."""
    table = measured(genes, sites, alignments, min_hets=min_hets, min_coverage=min_coverage)
    tested = bh_threshold(table, "pValue", q, mode, "gene_id")
    kept = displayed(tested.where((F.col("highFrac") >= min_fraction) & (F.col("pValue") < F.col("threshold"))))
    out = kept.select(
        "gene_name", "gene_id", "locus", "hetSites", "highCount", "lowCount", "meanCount", "sdCount", "highFrac", "pValue",
        F.col("threshold").alias("qValue"), "highHap", "lowHap", "positions",
    )
    return out.orderBy("pValue", F.desc("highFrac"), "gene_id") if ranked else out
