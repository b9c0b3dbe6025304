"""Overlaps between splits: a bipartite set-similarity join on rare shingles, exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.functions.expr import let
from slatework.session import dealt, written

#: Counts of shingles are kept by this many hash classes in each of so many tables: lists of fixed size, whatever the corpus.
#: The least count of a shingle's classes is its rarity, so a rare shingle passes for a frequent one only if it shares all of them.
CLASSES, TABLES = 1 << 13, 3
# Words that handling a file leaves in its name.
HANDLING = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp", "gif", "copy", "copie", "kopie", "copia", "crop", "cropped", "of")


def char_shingles(text: Column, q: int) -> Column:
    """Distinct hashes of the q-grams of a text; shorter texts are one shingle, empty ones have none."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (q - 1), F.lit(1))), lambda i: F.xxhash64(F.substring(text, i, F.lit(q))))
    return F.when(F.length(text) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))


def word_shingles(text: Column, n: int = 5) -> Column:
    """Distinct hashes of runs of n words, lower case; texts of fewer words are one shingle."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(n)), " ")))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def name_shingles(text: Column) -> Column:
    """Distinct hashes of the words and numbers of a file name, lower case.

    Counters of up to two digits and the words of handling tell no images apart and
    are left out, unless a name has no others.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    telling = F.filter(words, lambda w: ~w.isin(*HANDLING) & ~w.rlike(r"^[0-9]{1,2}$"))
    return F.array_distinct(F.transform(F.when(F.size(telling) > 0, telling).otherwise(words), lambda w: F.xxhash64(w)))


def _ranked(sets: DataFrame, weighted: bool) -> DataFrame:
    """``sets`` with ``o``: its shingles as (n, s, w), rare ones first; n is the least count of the shingle's hash classes, w its weight.

    The weight is one, or the cube of ln(1 + texts / n): rare shingles decide. The
    counts are a constant list that stands in the plan once.
    """
    at = lambda s, i: F.pmod(F.shiftright(s, 16 * i), F.lit(CLASSES)).cast("int") + i * CLASSES
    classes = F.explode(F.flatten(F.transform("s", lambda s: F.array(*[at(s, i) for i in range(TABLES)]))))
    counts = {r["c"]: r["count"] for r in sets.select(classes.alias("c")).groupBy("c").count().collect()}  # CLASSES x TABLES rows at most
    listed = F.split(F.lit(",".join(str(counts.get(c, 0)) for c in range(CLASSES * TABLES))), ",").cast("array<bigint>")
    total = float(sets.count()) if weighted else 0.0
    weight = lambda n: F.pow(F.log1p(F.lit(total) / F.greatest(n, F.lit(1))), F.lit(3.0)) if weighted else F.lit(1.0)
    one = lambda known, s: let(F.least(*[F.element_at(known, at(s, i) + 1) for i in range(TABLES)]), lambda n: F.struct(n.alias("n"), s.alias("s"), weight(n).alias("w")))
    return sets.withColumn("o", F.array_sort(let(listed, lambda known: F.transform("s", lambda s: one(known, s)))))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x.w)


def similar_texts(evaluation: DataFrame, training: DataFrame, shingles, threshold: float, weighted: bool = False) -> DataFrame:
    """As ``similar_sides``, of two tables with a column ``text``."""
    return similar_sides(evaluation.select("text", F.lit(True).alias("e")).unionByName(training.select("text", F.lit(False).alias("e"))), shingles, threshold, weighted)


def similar_sides(texts: DataFrame, shingles, threshold: float, weighted: bool = False) -> DataFrame:
    """(text_e, text_t, similarity) of all pairs of an evaluation and a training text with Jaccard >= threshold.

    texts: (text, e), e telling evaluation texts from training texts; copies are collapsed here. ``shingles`` makes
    an array of hashes of a text; ``weighted`` measures sets by the weight of their shingles' rarity
    instead of their number. Every set is sorted by one global order, rare
    classes first; two sets that are similar enough share a shingle within their
    prefixes, so only prefixes are joined. A prefix ends where what follows weighs less than the
    threshold's part of the set. Candidates pass the length and position
    filters before their sets are compared in full. Null texts and texts without
    shingles are in no pair.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sets = texts.where("text is not null").groupBy("text").agg(F.max("e").alias("e"), F.max(~F.col("e")).alias("t")).withColumn("s", shingles(F.col("text"))).where("size(s) > 0")
    sets = written(sets, "overlap-sets")
    # Written: the order is read in several places, and the planner would work it out in each.
    sets = written(_ranked(sets, weighted).select("text", "e", "t", "o"), "overlap-ranked")

    def prefixes(side: str) -> DataFrame:
        d = sets.where(side).select("text", "o", F.col("o").alias("set")).withColumn("all", _sum(F.col("o")))
        # What a set weighs from each place on: all less what goes before.
        d = d.withColumn("rest", F.transform("o", lambda x, i: F.col("all") - _sum(F.slice("o", F.lit(1), i)))) if weighted else d.withColumn("rest", F.transform("o", lambda x, i: F.col("all") - i))
        d = d.withColumn("o", F.filter(F.arrays_zip("o", "rest"), lambda z: z.rest >= F.col("all") * threshold - 1e-9))
        kept = [F.col("set").alias("set_e")] if weighted and side == "e" else []  # the weights of the smaller side go along
        return d.select("text", "all", "set", F.explode("o").alias("z")).select(F.col("text").alias(f"text_{side}"), F.col("all").alias(f"all_{side}"), *kept, F.col("z.rest").alias(f"rest_{side}"), F.col("z.o.s").alias("s"))

    e, t = prefixes("e"), prefixes("t")
    # Overlap needed for the threshold, and the most that can come from these places on and before them.
    need = (F.col("all_e") + F.col("all_t")) * (threshold / (1 + threshold)) - 1e-9
    most = F.least(F.col("all_e") - F.col("rest_e"), F.col("all_t") - F.col("rest_t")) + F.least("rest_e", "rest_t")
    near = (F.col("all_t") >= F.col("all_e") * threshold - 1e-9) & (F.col("all_e") >= F.col("all_t") * threshold - 1e-9)
    pairs = e.join(t, "s").where(near & (most >= need))
    if weighted:
        # A pair is compared where its first common shingle of the order was met, so it comes once.
        theirs = shingles(F.col("text_t"))
        common = let(theirs, lambda s: F.filter("set_e", lambda x: F.array_contains(s, x.s)))
        pairs = pairs.select("text_e", "text_t", "all_e", "all_t", "s", common.alias("c")).where(F.try_element_at("c", F.lit(1))["s"] == F.col("s"))
        shared = _sum(F.col("c"))
        pairs = pairs.select("text_e", "text_t", (shared / (F.col("all_e") + F.col("all_t") - shared)).alias("similarity"))
    else:
        pairs = pairs.select("text_e", "text_t").distinct()
        part = lambda f: F.size(f(shingles(F.col("text_e")), shingles(F.col("text_t"))))
        pairs = pairs.withColumn("similarity", part(F.array_intersect) / part(F.array_union))
    return pairs.where(F.col("similarity") >= threshold - 1e-12)


def cross_pairs(evaluation: DataFrame, training: DataFrame, found: DataFrame) -> DataFrame:
    """(id_e, id_t) of rows (id, text) whose texts are a pair of ``found`` (text_e, text_t).

    A text that very many training rows hold is dealt to several tasks.
    """
    e = evaluation.select(F.col("id").alias("id_e"), F.col("text").alias("text_e"))
    t = training.select(F.col("id").alias("id_t"), F.col("text").alias("text_t"))
    probe, build, keys = dealt(found.select("text_e", "text_t").join(e, "text_e").drop("text_e"), t, ["text_t"], "id_t")
    return probe.join(build, keys).select("id_e", "id_t")
