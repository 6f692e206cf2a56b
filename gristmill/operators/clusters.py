"""Exact and near duplicates of documents, mirrors, soft 404 hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.fingerprint import SLOTS, TOKENS, agreement, band_keys, shingles, sketches, text_digest
from gristmill.functions.urls import collapse
from gristmill.operators.hot import join_by_share
from gristmill.operators.overlap import head_size, prefix_keys, promising, similar_components, stars
from gristmill.storage import durable


def exact_clusters(docs: DataFrame) -> DataFrame:
    """Texts, equal but for white space, that more than one document has: ``digest, first_doc, members``."""
    return docs.groupBy(text_digest(F.col("text")).alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("members")).where("members > 1")


def near_candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that share a band bucket, and what stands for what.

    ``a, b, shared``: all pairs of representatives that share a bucket, with the
    number of slots they share. ``doc_id, rep``: the representative of every
    document with a token, the smallest id of its sketch. Documents of one sketch
    share all slots with each other and agree alike with any other, so a pair of
    representatives says the same of all they stand for, and copies are not paired.
    """
    slots = [f"m{i}" for i in range(SLOTS)]
    made = durable(sketches(docs).withColumn("sketch", F.sha2(F.concat_ws(",", *slots), 256)), "sketches")
    reps = durable(made.groupBy("sketch").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *[F.any_value(s).alias(s) for s in slots]), "reps")
    members = join_by_share(made.select("sketch", "doc_id"), reps.select("sketch", "rep", "n"), ["sketch"])
    return bucket_pairs(reps, slots), members.select("doc_id", "rep")


def bucket_pairs(reps: DataFrame, slots: list[str]) -> DataFrame:
    """``a, b, shared``: all pairs of the written ``rep`` and slots that share a band bucket, with the number of slots they share."""
    buckets = reps.select("rep", F.explode(F.array(*band_keys([F.col(s) for s in slots]))).alias("band"))
    pairs = buckets.withColumnRenamed("rep", "a").join(buckets.withColumnRenamed("rep", "b"), "band").where("a < b").select("a", "b").distinct()
    of = lambda side: reps.select(F.col("rep").alias(side), *[F.col(s).alias(f"{side}_{s}") for s in slots])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", agreement([F.col(f"a_{s}") for s in slots], [F.col(f"b_{s}") for s in slots]).alias("shared"))


def near_pairs(docs: DataFrame) -> DataFrame:
    """``a, b, shared``: all pairs of different texts that share a band bucket, and what stands for what.

    A text is named by the smallest id of the documents that have it, white space
    collapsed. So that nothing is left out, each further copy has one row with
    that document (``a``) and all slots shared. Two texts of one sketch are a pair.
    """
    slots = [f"m{i}" for i in range(SLOTS)]
    made = durable(sketches(docs, text_digest(F.col("text")).alias("digest")), "sketches")
    reps = durable(made.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *[F.any_value(s).alias(s) for s in slots]), "reps")
    copies = join_by_share(made.select("digest", "doc_id"), reps.where("n > 1").select("digest", "rep", "n"), ["digest"]).where("doc_id > rep").distinct()
    return bucket_pairs(reps, slots).union(copies.select("rep", "doc_id", F.lit(SLOTS)))


#: Shingles of items that are given to every task: 16 MB of hashes with their items' numbers.
BROADCAST_SHINGLES = 1_000_000


def shared_shingles(docs: DataFrame, items: DataFrame, least: int, most: int = BROADCAST_SHINGLES) -> DataFrame:
    """``doc_id, item_id, shared``: pairs with so many distinct shingles in common, ``least`` or more.

    Shingles of documents meet those of the items where they arise, so that only
    matches are shuffled, if the items have at most ``most``; beyond that both
    sides are shuffled by shingle.
    """
    wanted = durable(shingles(items.select(F.col("item_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("item_id"), "h").distinct(), "item-shingles")
    small = F.broadcast(wanted) if wanted.count() <= most else wanted
    found = shingles(docs).join(small, "h").groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("shared"))
    return found.where(F.col("shared") >= least)


#: Places that documents whose texts are wanted again are dealt over; one number each is broadcast.
PLACES = 1 << 20


def shingle_sets(docs: DataFrame, *keep: str) -> DataFrame:
    """``rep``, the columns ``keep``, ``shingles``: 64-bit hashes of the distinct runs of TOKENS tokens of the collapsed ``_text``; a shorter text is one run."""
    tokens = docs.select("doc_id", *keep, F.split("_text", " ").alias("t"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - TOKENS + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("t", i, TOKENS), " ")))
    return tokens.select(F.col("doc_id").alias("rep"), *keep, F.array_distinct(runs).alias("shingles"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, _text`` of the written ``rep, _digest``, once an id.

    Ids that no wanted one shares a place with go where their texts lie, so few
    others are shuffled while the wanted are fewer than PLACES.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES)).cast("int")
    near = docs.join(F.broadcast(wanted.select(place("rep").alias("_place")).distinct()), place("doc_id") == F.col("_place"), "left_semi")
    texts = near.select("doc_id", collapse(F.coalesce("text", F.lit(""))).alias("_text")).withColumn("_digest", F.sha2("_text", 256))
    return texts.join(wanted.select(F.col("rep").alias("doc_id"), "_digest"), ["doc_id", "_digest"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "_text")


def near_classes(docs: DataFrame, *keep: str, percent: int = 75) -> DataFrame:
    """The columns ``keep``, ``doc_id`` and ``cluster`` of every document: the smallest doc_id of its near-duplicate class, its own where there is none.

    Classes are the components of all pairs whose full shingle sets have this
    percentage in common. Texts that are equal but for white space are in one
    class, null as empty; a text of fewer than TOKENS tokens is its only shingle.
    Of texts without a partner, which their heads mostly tell, no set is moved.
    """
    rows = docs.select(*keep, "doc_id", collapse(F.coalesce("text", F.lit(""))).alias("_text")).withColumn("_digest", F.sha2("_text", 256))
    sized = shingle_sets(rows, *keep, "_digest").withColumn("n", F.size("shingles"))
    # 40 bits of a shingle's hash are enough to tell whether it is met, and fewer bytes to shuffle.
    least = F.slice(F.sort_array("shingles"), F.lit(1), F.expr(head_size(percent)))
    named = durable(sized.select(*keep, F.col("rep").alias("doc_id"), "_digest", "n", F.transform(least, lambda h: F.shiftright(h, 24)).alias("head")), "heads")
    classes = durable(named.groupBy("_digest").agg(F.min("doc_id").alias("_rep")), "classes")
    first = classes.groupBy(F.col("_rep").alias("rep")).agg(F.min("_digest").alias("_digest"))
    # Copies are met by each other here; of those only the first goes on.
    wanted = durable(promising(named.select(F.col("doc_id").alias("rep"), "n", "head"), percent).join(first, "rep"), "promising")
    sets = durable(shingle_sets(texts_of(docs, wanted)), "sets")
    comps = similar_components(durable(stars(prefix_keys(sets, percent)), "stars"), sets, percent)
    placed = named.select(*keep, "doc_id", "_digest").join(classes, "_digest").join(comps, F.col("_rep") == F.col("node"), "left")
    return placed.select(*keep, "doc_id", F.coalesce("comp", "_rep", "doc_id").alias("cluster"))


def near_clusters(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, cluster`` of every document, see ``near_classes``."""
    return near_classes(docs, percent=percent)


def host_pairs(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Mirror hosts: ``a, b, common, smaller``, pairs of hosts that share at least this share of the smaller one's distinct contents.

    Contents that the same hosts have are counted together, so each distinct set
    of hosts is expanded into its pairs once, whatever the number of contents.
    """
    has = durable(docs.select(F.col("source").alias("host"), text_digest(F.col("text")).alias("digest")).distinct(), "host-contents")
    sizes = has.groupBy("host").agg(F.count("*").alias("n"))
    held = has.where("host is not null and digest is not null").groupBy("digest").agg(F.sort_array(F.collect_set("host")).alias("hosts")).where(F.size("hosts") > 1)
    sets = held.groupBy("hosts").agg(F.count("*").alias("n"))
    firsts = sets.select("n", "hosts", F.posexplode("hosts").alias("at", "a"))
    pairs = firsts.select("n", "a", F.explode(F.slice("hosts", F.col("at") + 2, F.size("hosts"))).alias("b")).groupBy("a", "b").agg(F.sum("n").alias("common"))
    of = lambda side: sizes.select(F.col("host").alias(side), F.col("n").alias(f"n_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "common", F.least("n_a", "n_b").alias("smaller")).where(F.col("common") >= least * F.col("smaller"))


def top_share(docs: DataFrame) -> DataFrame:
    """Per host: documents, those of its commonest near-duplicate class, for the soft 404 rule (over 60 percent)."""
    per = near_classes(docs, "source").groupBy("source", "cluster").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("docs"), F.max("n").alias("commonest")).withColumn("soft_404", F.col("commonest") * 10 > F.col("docs") * 6)
