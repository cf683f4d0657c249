"""Knowledge records: fingerprints, exact and near duplicates, identities, versions, confidence."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessella.functions import hashing as H, text as T


def canonical_text(text: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.lower(T.collapse(text))


def ingest(rows: DataFrame, key: str, content: str, kind: Column) -> DataFrame:
    """(id, fingerprint, kind, canonical_form, version): first versions of records; the fingerprint is of the raw content."""
    return rows.select(F.col(key).alias("id"), H.content_hash(F.col(content)).alias("fingerprint"), kind.alias("kind"), canonical_text(F.col(content)).alias("canonical_form"), F.lit(1).alias("version"))


def revise(records: DataFrame, revisions: DataFrame) -> DataFrame:
    """(id, previous_id, version, content) of rows (id, content): version n+1 with the id ``{id}-v{n+1}``."""
    latest = records.groupBy("id").agg(F.max("version").alias("version"))
    joined = revisions.join(latest, "id")
    return joined.select(F.concat(F.col("id").cast("string"), F.lit("-v"), (F.col("version") + 1).cast("string")).alias("id"), F.col("id").alias("previous_id"), (F.col("version") + 1).alias("version"), "content")


def exact_duplicates(rows: DataFrame, key: str, content: str, keep: str = "last") -> DataFrame:
    """(fingerprint, keeper, copies) of contents that occur more than once; the last registration wins unless asked for the first."""
    pick = F.max(key) if keep == "last" else F.min(key)
    return rows.groupBy(H.content_hash(F.col(content)).alias("fingerprint")).agg(pick.alias("keeper"), F.count("*").alias("copies")).where("copies > 1")


def resolve_duplicates(rows: DataFrame, key: str, content: str, strategy: str, confidence: str | None = None) -> DataFrame:
    """Rows after duplicates were treated: discard keeps the first, keep_linked links each copy to the first, replace_if_higher keeps that of most confidence, merge keeps the first with the number of copies."""
    fingerprint = H.content_hash(F.col(content))
    marked = rows.withColumn("_fp", fingerprint)
    if strategy == "replace_if_higher":
        best = marked.groupBy("_fp").agg(F.max(F.struct(F.col(confidence), (-F.col(key)).alias("_k"))).alias("b")).select((-F.col("b._k")).alias("_keep"))
        return marked.join(best, F.col(key) == F.col("_keep"), "left_semi").drop("_fp")
    first = marked.groupBy("_fp").agg(F.min(key).alias("first"), F.count("*").alias("copies"))
    joined = marked.join(first, "_fp").drop("_fp")
    if strategy == "discard":
        return joined.where(F.col(key) == F.col("first")).drop("first", "copies")
    if strategy == "keep_linked":
        return joined.withColumn("linked_to", F.when(F.col(key) != F.col("first"), F.col("first"))).drop("first", "copies")
    if strategy == "merge":
        return joined.where(F.col(key) == F.col("first")).drop("first")
    raise ValueError(f"unknown strategy {strategy}")


def near_classes(prints: DataFrame, key: str) -> DataFrame:
    """(key, simhash, class, copies): every row with the smallest key of those with the same ``simhash``, and how many these are."""
    classes = prints.groupBy(F.col("simhash").alias("_s")).agg(F.min(key).alias("class"), F.count("*").alias("copies"))
    return prints.join(classes, prints.simhash.eqNullSafe(classes["_s"])).select(key, "simhash", "class", "copies")


def near_pairs(prints: DataFrame, key: str, budget: int = 3, bucket: int = 64) -> DataFrame:
    """(a, b, distance, similarity) of classes of equal ``simhash`` that differ in 1 to ``budget`` bits, named by their smallest keys.

    Copies are one class, so they add no pairs; ``near_classes`` tells who is in
    it. Prints within the budget agree in all bits of some parts of the 64, so
    pairs meet on those; there are as many parts as keep buckets of random
    prints at about ``bucket`` rows, whatever their number.
    """
    classes = prints.where("simhash is not null").groupBy("simhash").agg(F.min(key).alias("key"))
    count = classes.count()
    parts = next((p for p in range(budget + 1, 2 * budget + 3) if count <= bucket << (64 * (p - budget) // p)), 2 * budget + 3)
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen) for chosen in combinations(range(parts), parts - budget)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("choice"), F.col("simhash").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(masks))))
    dealt = classes.select("key", "simhash", at.alias("q")).select("key", "simhash", "q.choice", "q.bits")
    a = dealt.select(F.col("key").alias("a"), F.col("simhash").alias("x"), "choice", "bits")
    b = dealt.select(F.col("key").alias("b"), F.col("simhash").alias("y"), "choice", "bits")
    distance = H.hamming(F.col("x"), F.col("y"))
    found = a.join(b, ["choice", "bits"]).where("a < b").withColumn("distance", distance).where(F.col("distance") <= budget)
    return found.select("a", "b", "distance", (1 - F.col("distance") / 64).alias("similarity")).distinct()


def near_closest(prints: DataFrame, key: str, budget: int = 3) -> DataFrame:
    """(key, closest, distance): the nearest other row within the budget, the smallest key on a tie; rows without one are absent."""
    classes = near_classes(prints, key)
    second = classes.where(F.col(key) != F.col("class")).groupBy(F.col("class").alias("_of")).agg(F.min(key).alias("second"))
    pairs = near_pairs(prints, key, budget)
    either = pairs.select("a", "b", "distance").union(pairs.select("b", "a", "distance"))
    nearest = either.groupBy(F.col("a").alias("_at")).agg(F.min(F.struct("distance", "b")).alias("near"))
    whole = classes.join(second, F.col("class") == F.col("_of"), "left").join(nearest, F.col("class") == F.col("_at"), "left")
    copy = F.when(F.col("copies") > 1, F.struct(F.lit(0).alias("distance"), F.when(F.col(key) == F.col("class"), F.col("second")).otherwise(F.col("class")).alias("b")))
    return whole.withColumn("m", F.coalesce(copy, "near")).where("m is not null").select(key, F.col("m.b").alias("closest"), "m.distance")


def resolve_by_print(known: DataFrame, asked: DataFrame, budget: int = 3) -> DataFrame:
    """(asked, entity_id, distance): the known entity whose ``simhash`` is nearest to that of each asked row, within the budget; ties to the smaller id. known: (entity_id, simhash); asked: (asked, simhash)."""
    both = known.groupBy("simhash").agg(F.min("entity_id").alias("entity_id"))
    parts = budget + 1
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(parts)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]

    def dealt(rows: DataFrame) -> DataFrame:
        at = F.explode(F.array(*(F.struct(F.lit(k).alias("choice"), F.col("simhash").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(masks))))
        return rows.withColumn("q", at).select("*", "q.choice", "q.bits").drop("q")

    distance = H.hamming(F.col("simhash"), F.col("_s"))
    # Asked prints that repeat are looked up once.
    wanted = asked.select("simhash").where("simhash is not null").distinct()
    met = dealt(wanted).join(dealt(both).withColumnRenamed("simhash", "_s"), ["choice", "bits"]).withColumn("distance", distance).where(F.col("distance") <= budget)
    best = met.groupBy("simhash").agg(F.min(F.struct("distance", "entity_id")).alias("m"))
    return asked.join(best, "simhash").select("asked", "m.entity_id", "m.distance")


def resolve(aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """(namespace, value, entity_id) of asked (namespace, value) rows by equality."""
    return asked.join(aliases, ["namespace", "value"], "left")


def resolve_fuzzy(aliases: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(namespace, value, entity_id, distance) with the nearest alias of the namespace within an edit distance over bytes; ties to the smaller id.

    Values of a namespace whose lengths differ by more than ``most`` never meet:
    each alias is dealt to the lengths that can reach it.
    """
    lengths = F.explode(F.sequence(F.greatest(F.octet_length("alias") - most, F.lit(0)), F.octet_length("alias") + most))
    known = aliases.withColumnRenamed("value", "alias").withColumn("size", lengths)
    rows = asked.withColumn("size", F.octet_length("value")).join(known, ["namespace", "size"])
    rows = rows.withColumn("distance", T.byte_levenshtein(F.col("value"), F.col("alias"))).where(F.col("distance") <= most)
    return rows.groupBy("namespace", "value").agg(F.min(F.struct("distance", "entity_id")).alias("m")).select("namespace", "value", "m.entity_id", "m.distance")


def version_chains(records: DataFrame) -> DataFrame:
    """(id, version, previous_id, next_id) of each record's versions in order."""
    w = Window.partitionBy("id").orderBy("version")
    return records.select("id", "version", F.lag("version").over(w).alias("previous_version"), F.lead("version").over(w).alias("next_version"))


def combine_and(a: Column, b: Column) -> Column:
    return F.least(F.greatest(a * b, F.lit(0.0)), F.lit(1.0))


def combine_or(a: Column, b: Column) -> Column:
    return F.least(F.greatest(a + b - a * b, F.lit(0.0)), F.lit(1.0))


def combine_weighted(a: Column, b: Column, weight: float) -> Column:
    return F.least(F.greatest(a * weight + b * (1 - weight), F.lit(0.0)), F.lit(1.0))


def decay(confidence: Column, factor: float, steps: Column) -> Column:
    return F.least(F.greatest(confidence * F.pow(F.lit(factor), steps), F.lit(0.0)), F.lit(1.0))


def any_of_group(rows: DataFrame, by: str, confidence: str) -> DataFrame:
    """(by, confidence): the chance that at least one of a group's findings holds."""
    sure = F.max((F.col(confidence) >= 1).cast("int")) == 1
    rest = F.exp(F.sum(F.when(F.col(confidence) < 1, F.log1p(-F.col(confidence))).otherwise(0.0)))
    return rows.groupBy(by).agg(F.when(sure, 1.0).otherwise(1 - rest).alias("confidence"))
