"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has one bit per bit of a 64-bit shingle hash: 1 where over half of the text's shingle hashes have it.
Two fingerprints are linked when they differ in at most ``radius`` bits.  Each distinct fingerprint emits every variant
that differs from it in at most ``ceil(radius / 2)`` bits (1 + 64 + 2016 for radius 4); two fingerprints within the
radius share a variant (flip half the differing bits of one), and two that share a variant are within the radius.  The
variants are shuffled by value; in each bucket of one variant every member is linked to the bucket's least member and
the link is verified by counting differing bits, which is a spanning tree of the bucket instead of all its pairs.
Only fingerprints that can have a link emit variants: ``radius`` differing bits leave at least four of ``radius + 4``
blocks of bits equal, so a fingerprint that agrees with no other on any four blocks, or with none within the radius, has
no link and needs none of its 2,081 rows (``linkable``).
Components of the links, by large-star and small-star rounds, give each document the least doc_id reachable.

Everything runs in the JVM: words by regular expression, shingles by an exploded sequence, hashes by ``xxhash64``
(XXH64 of UTF-8 with seed 42) and bit counts by an aggregation with partial sums before the shuffle, one row per
document and task.  Copies of a text share one fingerprint, so they meet once in the variant shuffle, however many.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, text_of
from .graph import components

# fixed values of the contract: words, and the letters that are lower-cased
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

BITS = 64
SHINGLE = 4
RADIUS = 4

#: Fingerprints agreeing on some blocks that are compared with each other; the members of a larger bucket all emit variants.
BUCKET = 256


def masks(half: int) -> list[int]:
    """Every 64-bit mask with at most ``half`` bits set, as signed longs."""
    out = []
    for k in range(half + 1):
        for bits in combinations(range(BITS), k):
            m = sum(1 << b for b in bits)
            out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``fingerprint`` (bigint, the 64 bits as a signed long) and ``n_shingles``.

    Only A-Z are lower-cased.  Words are runs of characters other than space and 0x09-0x0D; shingles are ``shingle``
    consecutive words joined by one space, repeats included; a text of fewer words has one shingle of all of them.
    Null and empty texts and texts without words have no shingle and fingerprint 0.  Repeated rows give repeated
    rows.  Names ``__row``, ``__words``, ``__i`` and ``__h`` are used inside.
    """
    words = F.regexp_extract_all(F.translate(text_of(), UPPER, LOWER), F.lit(WORD), 0)
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    exploded = rows.select("__row", words.alias("__words")).select(
        "__row",
        "__words",
        F.explode_outer(F.when(F.size("__words") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size("__words") - shingle + 1, F.lit(1))))).alias("__i"),
    )
    h = F.xxhash64(F.array_join(F.slice("__words", F.col("__i"), shingle), " "))
    hashed = exploded.select("__row", F.when(F.col("__i").isNotNull(), h).alias("__h"))
    ones = [F.sum(F.shiftright("__h", b).bitwiseAND(F.lit(1))).alias(f"__b{b}") for b in range(BITS)]
    counts = hashed.groupBy("__row").agg(F.count("__h").alias("n_shingles"), *ones)
    set_bits = [F.when(2 * F.coalesce(F.col(f"__b{b}"), F.lit(0)) > F.col("n_shingles"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")) for b in range(BITS)]
    fp = counts.select("__row", "n_shingles", reduce(Column.bitwiseOR, set_bits).alias("fingerprint"))
    return rows.join(fp, "__row").drop("__row")


def hex64(fp: Column) -> Column:
    """16 lowercase hex digits of a signed long's 64 bits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def block_masks(radius: int) -> list[int]:
    """Masks, as signed longs, of any four of ``radius + 4`` blocks of bits: two numbers within ``radius`` bits agree on one."""
    blocks = min(radius + 4, BITS)
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    out = [sum(equal) for equal in combinations(block, max(blocks - radius, 0))]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def linkable(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``distinct`` (``fingerprint``, no repeats) that may be within ``radius`` bits of another.

    Every one that is, is there.  Members of a bucket of up to BUCKET are compared; those of a larger one all stay, so
    no bucket costs more than BUCKET comparisons a member.
    """
    tables = F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in block_masks(radius)])).alias("table", "mask")
    keys = distinct.select("fingerprint", tables).select("fingerprint", "table", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("bits"))
    bucket = Window.partitionBy("table", "bits")
    shared = keys.withColumn("n", F.count(F.lit(1)).over(bucket)).where("n > 1")
    near = lambda x, y: (x != y) & (F.bit_count(x.bitwiseXOR(y)) <= radius)
    shared = kept(shared, "shared")
    members = shared.where(F.col("n") <= BUCKET).groupBy("table", "bits").agg(F.collect_list("fingerprint").alias("members"))
    compared = members.select(F.explode(F.filter("members", lambda x: F.exists("members", lambda y: near(x, y)))).alias("fingerprint"))
    return compared.unionByName(shared.where(F.col("n") > BUCKET).select("fingerprint")).distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints of ``fps`` (column ``fingerprint``) within ``radius`` bits.

    Every pair within the radius is connected through the links (each bucket of a shared variant is a star around
    its least member); the links themselves are all within the radius.
    """
    half = (radius + 1) // 2
    spark = fps.sparkSession
    # spread over all shuffle partitions before the variants multiply each row 2,081 times
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select("fingerprint").where("fingerprint is not null").distinct().repartition(width, "fingerprint")
    may = kept(linkable(distinct, radius), "linkable").repartition(width, "fingerprint")
    variants = may.select("fingerprint", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks(half)])).alias("mask"))
    variants = variants.select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"))
    # the least member of each bucket; one shuffle on the variant, no pairs within the bucket
    least = F.min("fingerprint").over(Window.partitionBy("variant"))
    star = variants.select("fingerprint", least.alias("centre")).where("fingerprint != centre")
    verified = star.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("centre"))) <= radius)
    return verified.select(F.col("fingerprint").alias("a"), F.col("centre").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_shingles of every row of ``docs``.

    component_id is the least doc_id of all rows whose fingerprints are linked, directly or through others, at
    ``radius`` or fewer differing bits; rows of equal fingerprint are always linked.  Null doc_ids are members but
    never the least; a component of null doc_ids only has a null component_id.  Texts as in ``fingerprints``; other
    columns of ``docs`` are not carried.  No rows give no rows.
    """
    fps = kept(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fingerprint", "n_shingles"), "fingerprints")
    roots = components(links(fps, radius)).select(F.col("node").alias("fingerprint"), "root")
    of_fp = fps.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    of_fp = kept(of_fp, "roots")
    least = of_fp.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return of_fp.join(least, "root").select("doc_id", hex64(F.col("fingerprint")).alias("fingerprint"), "component_id", "n_shingles")
