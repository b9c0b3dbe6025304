"""Queries of the operators tagged llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatework.functions import text
from slatework.llm import bpe, canonical, lookalike, mixing, overlap, pieces, splits
from slatework.llm.queries_sql import SQL  # noqa: F401
from slatework.operators import proximity
from slatework.session import table, whole_list, written


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encoded(table(spark, d, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in the mix, with its position."""
    placed, _ = _mixed(spark, d)
    return placed.withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached by the mix."""
    return _mixed(spark, d)[1]


def _mixed(spark: SparkSession, d: str):
    docs = bpe.encoded(table(spark, d, "documents"), "doc_id", "text", counts_only=True, keep=("source",))
    return mixing.mixed(docs.select(F.col("doc_id").alias("id"), "source", "tokens"), table(spark, d, "mix_targets"))


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    rule = table(spark, d, "piece_rules").orderBy("rule_id").first()  # one row
    return pieces.split_texts(table(spark, d, "documents"), "doc_id", "text", rule["max_tokens"], rule["overlap_tokens"], rule["tokenizer"], with_text=with_text)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents over the limit: those that the splitter cut."""
    return _pieces(spark, d, False).where("piece_no = 1").select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all documents."""
    return _pieces(spark, d, True)


def _typed_cities(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "building_metadata").select(F.col("record_id").alias("id"), F.col("city").alias("value"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return canonical.cities(b, table(spark, d, "city_reference"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Typed cities and roof shapes that are no canonical entry, with the entry meant or -1."""
    shapes = table(spark, d, "building_metadata").select(F.col("record_id").alias("id"), F.col("roofshape").alias("value"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    listed = table(spark, d, "city_allow_list").select(F.col("entry_id").alias("id"), F.col("City").alias("value"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    parts = [
        ("city", _typed_cities(spark, d)),
        ("roofshape", canonical.roofshapes(shapes, table(spark, d, "roofshape_list"))),
        ("allow_list_city", canonical.cities(listed, table(spark, d, "city_reference"))),
    ]
    out = None
    for field, m in parts:
        one = m.where("not exact").select(F.lit(field).alias("field"), F.col("id").alias("row_id"), "ref_id")
        out = one if out is None else out.unionByName(one)
    return out


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Report of the typed values that mean no entry: how many rows hold each field's unmatched values."""
    return p3_found(spark, d).where("ref_id = -1").groupBy("field").agg(F.count(F.lit(1)).alias("rows"))


def p3_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct typed city with all entries within the distance that its length allows, and their edits."""
    values = table(spark, d, "building_metadata").select(F.col("city").alias("value")).unionByName(table(spark, d, "city_allow_list").select(F.col("City").alias("value")))
    found = canonical.candidates(values.where(~text.is_blank(F.col("value"))), table(spark, d, "city_reference"))
    return found.select("value", F.inline("refs")).select("value", F.col("ref").alias("city_id"), "edits")


def _split(c):
    s = F.lower(text.bare(c))
    return F.when(s.isin("train", "val", "holdout"), s)


#: Metres within which two records show the same building.
SAME_M = 3.0
#: Weighted similarity of file names from which on they are compared: counters and rare words of handling take up to half.
NAME_SIMILARITY = 0.5


def _named(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, part, name) of the records of a split, under the one or two forms of their names."""
    b = table(spark, d, "building_metadata").select("record_id", "filename", _split(F.col("split")).alias("part")).where("part is not null")
    return written(lookalike.image_names(b.withColumnRenamed("filename", "file"), "file", keep=("record_id", "part")).drop("image"), "overlap-names")


def _similar_names(names: DataFrame) -> DataFrame:
    """(text_e, text_t, similarity, same_image) of the names of evaluation and training records that share most of what tells images apart.

    Similar names are of one image if they differ by traces of handling only: an exact check of the pairs found.
    """
    texts = names.select(F.col("name").alias("text"), (F.col("part") != "train").alias("e"))
    return lookalike.same_image(overlap.similar_sides(texts, overlap.name_shingles, NAME_SIMILARITY, weighted=True), "text_e", "text_t")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    """(id_e, id_t) pairs of an evaluation and a training record that show the same building."""
    b = table(spark, d, "building_metadata").select("record_id", "latitude", "longitude", _split(F.col("split")).alias("part")).where("part is not null")
    training, evaluation = b.where("part = 'train'"), b.where("part <> 'train'")
    names = _named(spark, d)
    sides = [names.where(cond).select(F.col("record_id").alias("id"), F.col("name").alias("text")) for cond in ("part <> 'train'", "part = 'train'")]
    by_name = overlap.cross_pairs(*sides, _similar_names(names).where("same_image"))
    at = [proximity.located(x, "record_id", "latitude", "longitude") for x in (evaluation, training)]
    by_place = proximity.near_pairs(*at, SAME_M).select(F.col("id_a").alias("id_e"), F.col("id_b").alias("id_t"))
    return by_name.union(by_place).distinct()


def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an evaluation and a training name that are similar, with their similarity and whether they are of one image: a row per pair of distinct names."""
    found = _similar_names(_named(spark, d))
    return found.select(F.col("text_e").alias("name_e"), F.col("text_t").alias("name_t"), F.round("similarity", 6).alias("similarity"), "same_image")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and a val or holdout record of the same building."""
    return _overlaps(spark, d).select(F.least("id_e", "id_t").alias("record_a"), F.greatest("id_e", "id_t").alias("record_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation split and source: records, records that also stand in train, and pairs."""
    b = table(spark, d, "building_metadata").select(F.col("record_id").alias("id_e"), "source", _split(F.col("split")).alias("split")).where("split in ('val', 'holdout')")
    hits = _overlaps(spark, d).groupBy("id_e").agg(F.count(F.lit(1)).alias("n"))
    return b.join(hits, "id_e", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose file name only looks like a registered one, with the registered spelling."""
    found = lookalike.registered_spelling(table(spark, d, "building_metadata"), "record_id", "filename", table(spark, d, "building_coordinates"), "filename")
    return found.select(F.col("id").alias("record_id"), F.col("registered").alias("filename"))


def p5_form(spark: SparkSession, d: str) -> DataFrame:
    """Every record's file name in the one form."""
    return lookalike.one_form(table(spark, d, "building_metadata"), "filename", keep=("record_id",))


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, city_id, split now, component, new split) of every record; records of one city, or with the file name of one image, are related."""
    b = table(spark, d, "building_metadata").select("record_id", "filename", _split(F.col("split")).alias("split_now"))
    city = _typed_cities(spark, d).where("ref_id >= 0").select(F.col("id").alias("record_id"), F.col("ref_id").alias("city_id"))
    named = lookalike.one_form(b, "filename", "image", keep=("record_id", "split_now")).withColumn("image", F.nullif("form", F.lit(""))).drop("form")
    rows = written(named.join(city, "record_id", "left"), "splits-cities")
    shares = [(r["split"], r["share"]) for r in whole_list(table(spark, d, "split_targets").where("split is not null and share > 0"), 1000)]  # one row per split
    return splits.grouped_splits(rows, "record_id", ["image", "city_id"], shares, keep=("city_id", "split_now")).withColumnRenamed("id", "record_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Cities that the new splits bring together: their records stand in several splits now, and in one component and one new split."""
    one = lambda c: F.min(c) == F.max(c)
    g = _grouped(spark, d).where("city_id is not null").groupBy("city_id").agg((~one("split_now")).alias("several"), (one("component") & one("split")).alias("together"))
    return g.where("several and together").select("city_id")


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its component and new split."""
    return _grouped(spark, d).select("record_id", "city_id", "component", "split")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records and share of every split, against its target."""
    n = _grouped(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("records"))
    t = table(spark, d, "split_targets").join(n, "split", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    total = F.sum("records").over(Window.partitionBy(F.lit(1)))  # over a row per split
    return t.select("split", F.col("share").alias("target_share"), "records", F.try_divide("records", total).alias("reached_share"))


QUERIES = {
    "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p3_candidates": p3_candidates, "p4_found": p4_found, "p4_report": p4_report, "p4_similar": p4_similar, "p5_found": p5_found, "p5_form": p5_form,
    "p7_found": p7_found, "p7_splits": p7_splits, "p7_shares": p7_shares, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_pieces": p10_pieces,
}
