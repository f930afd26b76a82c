"""Every observation with what became of it: retained, or excluded and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.literals import chromosome, coordinate, integral, number, spelling
from tallyspan.operators.intervals import BUCKET, joined

INVALID, UNCOVERED, RETAINED = "invalid_counts_or_zero_depth", "no_cna_segment", "retained"
MOST = 2147483647


def reason(alt: Column, ref: Column, segment: Column) -> Column:
    """Bad counts come before a missing segment."""
    depth = alt + ref
    bad = alt.isNull() | ref.isNull() | (alt < 0) | (ref < 0) | (depth <= 0) | (depth > MOST)
    return F.when(bad, INVALID).when(segment.isNull(), UNCOVERED).otherwise(RETAINED)


def ledger(points: DataFrame, segments: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """points (original_row, mutation_id, chrom, pos, alt_count, ref_count) with their segment's columns, depth, status and reason."""
    rows = joined(points, segments, bucket)
    why = reason(F.col("alt_count"), F.col("ref_count"), F.col("segment_id"))
    rows = rows.withColumn("reason", why).withColumn("depth", F.when(F.col("reason") != INVALID, F.col("alt_count") + F.col("ref_count")))
    return rows.withColumn("status", F.when(F.col("reason") == RETAINED, "retained").otherwise("excluded"))


def retained(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "retained").select("original_row", "mutation_id", "chrom", "pos", "alt_count", "ref_count", "depth", "major_cn", "minor_cn", "total_cn", F.col("segment_id").alias("matched_segment_id"))


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.coalesce("alt_count", F.lit(0))).alias("sum_alt"), F.sum(F.coalesce("total_cn", F.lit(0))).alias("sum_total_cn"))


def points_of(table: DataFrame) -> DataFrame:
    """Typed observations of a text table. A count that is no whole number is null; a chromosome or position that is none is an error for checked()."""
    alt, ref = number(F.col("alt_count")), number(F.col("ref_count"))
    pos = coordinate(F.col("position"))
    own = F.concat_ws(":", chromosome(F.col("chromosome_index")).cast("string"), spelling(pos))
    name = F.col("mutation_id") if "mutation_id" in table.columns else own
    whole = lambda x: F.when(integral(x) & (F.abs(x) <= MOST), x.cast("long"))
    return table.select("original_row", name.alias("mutation_id"), chromosome(F.col("chromosome_index")).alias("chrom"), pos.alias("pos"), whole(alt).alias("alt_count"), whole(ref).alias("ref_count"))


def segments_of(table: DataFrame) -> DataFrame:
    """Typed segments of a text table, numbered in file order."""
    whole = lambda n: F.when(integral(number(F.col(n))), number(F.col(n)).cast("long")).alias(n)
    return table.select(F.col("original_row").alias("segment_id"), chromosome(F.col("chromosome_index")).alias("chrom"), coordinate(F.col("start_position")).alias("s_pos"), coordinate(F.col("end_position")).alias("e_pos"), whole("major_cn"), whole("minor_cn"), whole("total_cn"))


def violations(points: DataFrame, segments: DataFrame) -> dict[str, int]:
    """How many rows break each rule of the inputs. All zero: checked."""
    from tallyspan.operators.intervals import overlaps

    p = points.agg(
        F.count_if(F.col("chrom").isNull()).alias("chromosome"), F.count_if(F.col("pos").isNull()).alias("position"),
        F.count_if(F.col("mutation_id").isNull() | F.col("mutation_id").isin("", "NA", "NaN")).alias("mutation_id"),
    ).first().asDict()
    s = segments.agg(
        F.count_if(F.col("chrom").isNull()).alias("segment_chromosome"), F.count_if(F.col("s_pos").isNull() | F.col("e_pos").isNull()).alias("segment_position"), F.count_if(F.col("s_pos") > F.col("e_pos")).alias("segment_order"),
        F.count_if(~F.coalesce((F.col("major_cn") >= 1) & (F.col("minor_cn") >= 0) & (F.col("minor_cn") <= F.col("major_cn")) & (F.col("total_cn") == F.col("major_cn") + F.col("minor_cn")) & (F.col("total_cn") <= MOST), F.lit(False))).alias("copy_number"),
    ).first().asDict()
    twice = lambda *by: points.groupBy(*by).count().where("count > 1").count()
    return p | s | {"repeated_locus": twice("chrom", "pos"), "repeated_id": twice("mutation_id"), "overlap": overlaps(segments).count()}


def checked(points: DataFrame, segments: DataFrame) -> None:
    if bad := {k: n for k, n in violations(points, segments).items() if n}:
        raise ValueError("the input breaks rules: " + ", ".join(f"{k} {n}" for k, n in bad.items()))


def summary(rows: DataFrame) -> DataFrame:
    """One row: how many rows, retained, excluded, covered; largest and summed major copy number of those retained."""
    kept = F.col("status") == "retained"
    major = F.when(kept, F.col("major_cn"))
    return rows.agg(
        F.count("*").alias("n_rows"), F.count_if(kept).alias("n_retained"), F.count_if(~kept).alias("n_excluded"), F.count("segment_id").alias("n_covered"),
        F.coalesce(F.max(major), F.lit(0)).cast("long").alias("max_major_cn"), F.coalesce(F.sum(major), F.lit(0)).cast("long").alias("sum_major_cn"),
    )


