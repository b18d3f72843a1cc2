"""Registered file round trips (S3-S5, S8, S10-S12): derived rows are written to the shared
folder by the sinks and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from prodtext.plans import annotation_queries as AQ
from prodtext.plans import catalog_queries as CQ
from prodtext.plans import sqlparts as Q
from prodtext.plans.registry import register
from prodtext.session import scratch_path
from prodtext.sources import readers as RD
from prodtext.sources import sinks as SK
from prodtext.sources.fixtures import duck_with, fixture


@register("line_list_file", duck_with(["whitelist"]) + """
SELECT CAST(ord AS INT) AS ord, spec_key AS value FROM whitelist WHERE schema = 'medium'
UNION ALL SELECT DISTINCT 1, p_brand FROM part""")
def q_line_list_file(spark, sf_dir):
    """An ordered list in one file, and one file for each brand."""
    path = scratch_path(spark, "lists")
    keys = fixture(spark, sf_dir, "whitelist").where("schema = 'medium'")
    joined = keys.groupBy("schema").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "spec_key"))), lambda x: x["spec_key"]), "\n").alias("value"))
    joined.select("value").coalesce(1).write.text(f"{path}/keys")
    brands = spark.table("part").select("p_brand").distinct()
    brands.withColumn("b", F.col("p_brand")).write.partitionBy("b").text(f"{path}/brands")
    lists = RD.read_line_list(spark, f"{path}/keys").select("ord", "value")
    return lists.union(RD.read_line_list(spark, f"{path}/brands").select("ord", "value")).select(F.col("ord").cast("int").alias("ord"), "value")


@register("descriptions_csv_file", "SELECT source AS name, text AS description FROM documents")
def q_descriptions_csv_file(spark, sf_dir):
    """All texts, null and empty ones too, with quotes and line ends."""
    path = scratch_path(spark, "csv")
    fixture(spark, sf_dir, "descriptions")
    SK.write_descriptions_csv(spark.table("documents").select(F.col("doc_id").alias("_c0"), F.col("source").alias("name"), F.col("text").alias("description")), path)
    return RD.read_descriptions_csv(spark, path)


@register("json_array_file", duck_with(["tagged"]) + """
SELECT CAST(row_number() OVER (PARTITION BY source ORDER BY t.doc_id) AS INT) AS doc_ord, t.tagged_text AS text
FROM tagged t JOIN documents d ON d.doc_id = t.doc_id""")
def q_json_array_file(spark, sf_dir):
    """The strings of each source in order, as arrays of bounded size, one per line."""
    path = scratch_path(spark, "arrays")
    tagged = fixture(spark, sf_dir, "tagged").join(spark.table("documents").select("doc_id", "source"), "doc_id")
    SK.write_json_arrays(tagged, path, "tagged_text", "source", "doc_id")
    return RD.read_json_arrays(spark, path).select(F.col("doc_ord").cast("int").alias("doc_ord"), "text")


@register("product_json_file", duck_with(["catalog"]) + "SELECT product_id, title, brand, schema FROM catalog")
def q_product_json_file(spark, sf_dir):
    """Products as JSON lines by bucket."""
    path = scratch_path(spark, "products")
    SK.write_product_json(fixture(spark, sf_dir, "catalog"), path)
    return RD.read_json_documents(spark, path, "product_id string, title string, brand string, schema string, bucket int").drop("bucket")


@register("text_result_file", CQ._w(extra=Q.CATEGORY_CTES) + "SELECT input AS value FROM cat_prompts")
def q_text_result_file(spark, sf_dir):
    """Prompts as lines."""
    path = scratch_path(spark, "text")
    SK.write_text(CQ.category_prompts(CQ._fx(spark, sf_dir)), path, "input")
    return spark.read.text(path)


@register("annotation_corpora_files", duck_with(["tagged"]) + f""",
stripped AS (SELECT doc_id, {AQ.STRIP} AS text FROM tagged)
SELECT t.doc_id, t.tagged_text, s.text FROM tagged t JOIN stripped s ON s.doc_id = t.doc_id""")
def q_annotation_corpora_files(spark, sf_dir):
    """Tagged and untagged corpora."""
    path = scratch_path(spark, "corpora")
    SK.write_annotation_corpora(fixture(spark, sf_dir, "tagged"), path)
    tagged, plain = (RD.read_json_documents(spark, f"{path}/{k}", "doc_id bigint, text string") for k in ("tagged", "untagged"))
    return tagged.withColumnRenamed("text", "tagged_text").join(plain, "doc_id").select("doc_id", "tagged_text", "text")
