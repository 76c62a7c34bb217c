"""Registered queries of the subpackage, and their SQL."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import table
from . import boilerplate, leakage, names, neardup, packing, places, readability, residue, toxicity


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Easy and demanding English documents."""
    return _levels(spark, sf_dir).where("band <> 2").select("doc_id", "band")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each level by source and kind."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "kind")
    placed = documents.join(_levels(spark, sf_dir).select("doc_id", "band"), "doc_id")
    share = F.count("*") / F.sum(F.count("*")).over(Window.partitionBy("source", "kind"))
    return placed.groupBy("source", "kind", "band").agg(F.count("*").alias("documents"), F.round(share, 4).alias("share"))


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.records(*(table(spark, sf_dir, t) for t in ("extracted_jobs", "gold_holdout_snapshots", "snapshot_files")))


def _classifier(spark: SparkSession, sf_dir: str, **bounds: int) -> boilerplate.Classifier:
    return boilerplate.trained(table(spark, sf_dir, "extracted_jobs"), table(spark, sf_dir, "snapshot_files"), **bounds)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with visible text outside the main body."""
    return boilerplate.boilerplate_lines(_page_texts(spark, sf_dir), _classifier(spark, sf_dir))


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job and page with its main body."""
    return boilerplate.main_bodies(_page_texts(spark, sf_dir), _classifier(spark, sf_dir))


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "extracted_jobs"), table(spark, sf_dir, "labels"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose title or description is abusive, hateful or sexually explicit."""
    return _toxic(spark, sf_dir).where(F.col("score") >= toxicity.THRESHOLD).select("job_id")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs, toxic jobs and their rate for each source host."""
    hosts = table(spark, sf_dir, "extracted_jobs").select("job_id", toxicity.host("source_url").alias("host"))
    toxic = (F.col("score") >= toxicity.THRESHOLD).cast("long")
    counted = hosts.join(_toxic(spark, sf_dir), "job_id").groupBy("host").agg(F.count("*").alias("jobs"), F.sum(toxic).alias("toxic"), F.avg("score").alias("mean_score"))
    return counted.withColumn("rate", F.col("toxic") / F.col("jobs"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job whose vacancy was published more than once, with its group and its links."""
    # Signatures bear with a wrong line here and there, so a smaller sample trains the line classifier.
    classifier = _classifier(spark, sf_dir, pages=1_000, texts=1_000)
    found = neardup.classes(neardup.long_enough(table(spark, sf_dir, "extracted_jobs")), classifier)
    return found.select(F.col("id").alias("job_id"), "class_id", "class_size", "links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of rows within a group that publishes the same vacancy."""
    members = p4_classes(spark, sf_dir).select("job_id", "class_id")
    a, b = (members.select(F.col("job_id").alias(x), "class_id") for x in ("job_a", "job_b"))
    return a.join(b, "class_id").where("job_a < job_b").select("job_a", "job_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose location names a place, with the entry (0 if it is not on the list)."""
    return places.placed(table(spark, sf_dir, "extracted_jobs"), table(spark, sf_dir, "geo_locations")).select("job_id", "geo_id")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values whose place is not on the list, with their rows."""
    values = places.place_values(table(spark, sf_dir, "extracted_jobs"), table(spark, sf_dir, "geo_locations"))
    return values.where("geo_id = 0").groupBy("location_raw").agg(F.sum("n").alias("jobs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold template residue, filler or an error or script notice."""
    return residue.fields_with_residue(table(spark, sf_dir, "extracted_jobs")).select("job_id", "field_name")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs without residue in any field."""
    jobs = table(spark, sf_dir, "extracted_jobs").select("job_id", "company_id", "title")
    return jobs.join(p6_found(spark, sf_dir).select("job_id"), "job_id", "left_anti")


def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.firms(names.named_rows(table(spark, sf_dir, "company_enrichment_rows"), table(spark, sf_dir, "id_sample_700")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each firm, its smallest id and each other one."""
    return _firms(spark, sf_dir).where("id <> firm").select(F.col("firm").alias("id_a"), F.col("id").alias("id_b"))


def p7_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each firm with the number of its rows."""
    return _firms(spark, sf_dir).groupBy("firm").agg(F.count("*").alias("named_rows"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry at least half of a held-out item, and the item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item, the documents that carry it and the most they carry."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("carried").alias("most_carried"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's training sequence and position."""
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences and the share of their room that is filled."""
    sequences = p8_packed(spark, sf_dir).groupBy("sequence_id").agg(F.sum("n_tokens").alias("n"))
    filled = F.sum("n") / (F.count("*") * packing.CAPACITY)
    return sequences.agg(F.count("*").alias("sequences"), F.round(filled, 6).alias("filled"), F.max("n").alias("fullest"))


QUERIES = {
    "p2_found": p2_found,
    "p2_bodies": p2_bodies,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_unmatched": p5_unmatched,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_found": p7_found,
    "p7_firms": p7_firms,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_profile": p10_profile,
}

SQL: dict[str, str] = {}
