"""SpotSigs document fingerprints, in DataFrame functions only.

A spot is a run of common words (anchors); its signature is the chain of the next CHAIN
content words, with anchors in between passed over. A document's fingerprint is the set of
its signatures' 64-bit hashes, in ascending order, as hexadecimal text. Fingerprints are
compared by Jaccard. `near_links` finds all similar documents: classes of equal fingerprints
are partitioned by the size of their sets, a class only meets those sizes that can reach
the threshold, and only those that share one of its rarest signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.shared import documents, text_or_empty, written

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from has have he her his in is it its not of on or she that the their they this to was were which with you "
    "als am auch auf aus bei das dem den der des die ein eine einer für im ist mit nicht sich sie sind und von wie zu zum zur "
    "au aux avec ce cette dans de du elle en est et il la le les ne ou par pas plus pour que qui se son sur un une "
    "al como con del el es esta lo los las más no para pero por su una y"
).split()
CHAIN = 2
#: Up to so many sets under one signature are compared in one task; more are dealt out.
DEAL = 1024
WORDS = r"[^\p{L}\p{N}]+"


def _anchors() -> str:
    """The anchors as a pattern by first letters, longest first."""
    rest: dict[str, list[str]] = {}
    for word in sorted(set(ANCHORS), key=lambda w: (-len(w), w)):
        rest.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{c}(?:{'|'.join(x)})" for c, x in rest.items())


def with_signatures(docs: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """docs with out, the sorted set of signature hashes of the column text; in a text without spots each word is one."""
    words = F.trim(F.regexp_replace(F.lower(F.col(text)), WORDS, " "))
    # a space before each word; each anchor becomes a tab, so that all parts but the first begin at a spot.
    # Runs of tabs are split at, not matched as repeated words: Java's matcher would recurse once for each of them
    parts = F.split(F.regexp_replace(F.concat(F.lit(" "), F.col("_words")), rf" (?:{_anchors()})(?![^ ])", "\t"), "\t+")
    nth = lambda i: F.coalesce(F.get("_parts", i), F.lit(""))
    # a part between two spots has a word at least, but the last may have none: chain + 1 parts hold the chain
    following = F.transform(F.sequence(F.lit(1), F.size("_parts") - 1), lambda i: F.substring_index(F.concat(*[nth(i + k) for k in range(chain + 1)]), " ", chain + 1))
    spots = F.when(F.size("_parts") > 1, F.filter(following, lambda s: s != "")).otherwise(F.array().cast("array<string>"))
    each = F.array_sort(F.array_distinct(F.transform(F.split("_words", " "), lambda w: F.xxhash64(w))))
    whole = F.when(F.col("_words") == "", F.array().cast("array<long>")).otherwise(each)
    staged = docs.withColumn("_words", words).withColumn("_parts", parts)
    staged = staged.withColumn("_sigs", F.array_sort(F.array_distinct(F.transform(spots, lambda s: F.xxhash64(s)))))
    return staged.withColumn(out, F.when(F.size("_sigs") > 0, F.col("_sigs")).otherwise(whole)).drop("_words", "_parts", "_sigs")


def as_text(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; 1 for two empty ones. Sets without a common signature skip the division."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(F.try_divide(both, F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and next_id: the next doc_id in descending order, and after the last the first. Ids are distinct and not null.

    Ids are range-partitioned and linked within each partition; only each partition's first and last ids meet in one place.
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    ranged = written(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    ends = ranged.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    order = Window.orderBy("part")
    across = ends.select(F.col("low").alias("doc_id"), F.coalesce(F.lag("high").over(order), F.max("high").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("over_id"))
    inside = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("in_id", inside).join(across, "doc_id", "left").select("doc_id", F.coalesce("in_id", "over_id").alias("next_id"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text of docs(doc_id, text), and of its edited text.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the next document in descending doc_id, after the last by the first's.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. A
    null text is empty. Rows that repeat a doc_id are documents of their own, with the same
    next one; where the next doc_id repeats, the least of its texts is taken. A row without
    a doc_id has no next document: its edited text loses its end, and near_next is null.
    Equal fingerprints have likeness 1, empty ones too. Other columns are ignored; an empty table gives no rows.
    """
    text = docs.select("doc_id", "text")  # as they are: both joins then read one and the same exchange of the texts
    known = text.where("doc_id IS NOT NULL")
    sizes = written(known.groupBy("doc_id").agg(F.max(F.char_length(text_or_empty("text"))).alias("longest"), F.count("*").alias("n")), "sizes")
    wanted = written(with_next(sizes).join(sizes, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), F.floor(F.col("longest") / 3).cast("int").alias("m")), "next")
    heads = known.join(wanted.hint("merge"), "doc_id").withColumn("text", text_or_empty("text"))
    if sizes.where("n > 1").limit(1).count():
        heads = heads.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("k = 1")
    heads = with_signatures(heads, "text", "next_sigs").select("for_id", F.substring("text", F.lit(1), F.col("m")).alias("head"), "next_sigs")
    own = known.join(heads.withColumnRenamed("for_id", "doc_id").hint("merge"), "doc_id", "left")
    nothing = text.where("doc_id IS NULL").withColumns({"head": F.lit(""), "next_sigs": F.lit(None).cast("array<long>")})
    out = own.unionByName(nothing).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": text_or_empty("text")})
    out = with_signatures(out, "text", "sigs").withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("head", F.lit(1), cut))
    out = out.select("doc_id", "n_chars", "sigs", "next_sigs", edited.alias("edited"))
    out = with_signatures(out, "edited", "edited_sigs")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sigs")).alias("fingerprint"), as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """id, n, place, sig and zone: the first signatures, rarest first, of sets(id, sigs, n), as many as a similar set can't all lack.

    A signature of one set alone finds no partner: such ones come first in their set's order, so they are only counted, by what the set has
    besides, and neither joined nor sent back to it. place counts them.
    """
    each = sets.where("n > 0").select("id", F.explode("sigs").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    # rows, not partial lists of one entry, are sent to their set
    rarest = each.join(common.hint("merge"), "sig").repartition("id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    alone = F.col("n") - F.size("s")
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    kept = F.slice("s", 1, F.greatest(first - alone, F.lit(0)).cast("int"))
    zone = F.floor(F.log(F.col("n").cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold)) + 1e-9).cast("int")
    of_set = rarest.join(sets.select("id", "n"), "id").select("id", "n", alone.alias("alone"), F.posexplode(kept).alias("at", "s"))
    return of_set.select("id", "n", (F.col("alone") + F.col("at")).alias("place"), "s.sig", zone.alias("zone"))


def near_links(docs: DataFrame, threshold: float = 0.8, slices: int = 64) -> DataFrame:
    """doc_id, class_id and links of every row of docs(doc_id, text) with a doc_id.

    class_id is the least doc_id of the documents with an equal fingerprint; links is the number
    of other classes whose likeness to the class is `threshold` or more. Sets are partitioned
    by size so that similar ones are in the same partition or the next; within it, those
    are compared that share one of the first signatures, rarest first, as many as a similar
    set can't all lack, and whose places leave enough signatures to come. Pairs are counted
    and not returned. A signature of more than DEAL sets is dealt out over up to `slices` tasks, by one side
    whose other side goes to each, so that a very common one isn't one task's; all others are sent once. Null and empty texts are one class without links. Rows that repeat a
    doc_id are documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).where("doc_id IS NOT NULL")
    signed = written(with_signatures(known, "text", "sigs").select("doc_id", "sigs", F.sha2(as_text(F.col("sigs")), 256).alias("print")), "signed")
    sets = signed.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs"))
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    prefix = written(prefixes(sets, threshold), "prefixes")
    several = prefix.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig", F.least(F.lit(slices), F.ceil(F.col("k") / DEAL)).cast("int").alias("deal"))
    prefix = written(prefix.join(several.hint("merge"), "sig"), "shared")
    a = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), "sig", F.explode(F.array(F.col("zone") - 1, F.col("zone"), F.col("zone") + 1)).alias("zone"), F.pmod(F.xxhash64("id"), F.col("deal")).cast("int").alias("slice"))
    b = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), "sig", "zone", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("slice"))
    enough = f"ceil({threshold} / (1 + {threshold}) * (na + nb) - 1e-9)"
    pairs = a.join(b, ["sig", "zone", "slice"]).where(f"a < b AND least(na, nb) + 1e-9 >= {threshold} * greatest(na, nb) AND least(na - pa, nb - pb) >= {enough}").select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    linked = both.where(likeness(F.col("sa"), F.col("sb")) >= threshold)
    links = linked.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    counts = sets.select("id", "print", "class_id").join(links, "id", "left").select("print", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return signed.select("doc_id", "print").join(counts, "print").select("doc_id", "class_id", "links")


def spotsigs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(documents(spark, sf_dir))


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
