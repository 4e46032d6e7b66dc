"""Near-duplicate records with small edits: exact Jaccard joins over word sets.

Method: records are cut into size-banded tiles - word sets whose sizes differ by more than the threshold allows never meet -
and carry hashed bitmap signatures; bit counts bound a pair's overlap from above, and only pairs that pass the bound are
intersected exactly. To keep the tiles small, records meet under the rarest words of their sets (any pair above the threshold
shares one of them, early enough to leave room for the rest), and a word that many records hold is cut into blocks, so no tile exceeds about 2 x BLOCK records.
Exact copies are one class from the start and are joined through their representative; where pairs of records are asked for, the
copies of a class come in blocks too, so that a text which a third of all records share is no task's own.

Defined results: null texts count as empty; records without words or id are in no pair; copies are pairs with similarity 1;
ties and repeated rows keep their own ids. Words are compared by 64-bit hashes within a pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.sources.stage import discard, staged

BLOCK = 2000
#: A word is frequent from this share of the classes on. Mean set size / share bounds how many such words there are, so they may be broadcast.
FREQUENT = 1 / 500
#: Up to so many records under a word are a tile of all sizes; more are cut by size bands.
SMALL_TILE = 64


def word_set(*texts: str) -> Column:
    """Distinct words of the texts together: lower case, split at everything but letters and digits, as sorted hashes."""
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts]))
    words = F.filter(F.split(whole, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def classes(df: DataFrame, id_column: str, words: Column) -> tuple[DataFrame, DataFrame]:
    """(members, reps). members: record, digest of its word set. reps: one row per word set with digest, class_id (the smallest
    record that has it), words and copies. Records without words are left out. Counts combine before the shuffle, so a set that
    a third of all records share costs one row a task, and members are never gathered."""
    found = df.select(F.col(id_column).alias("record"), words.alias("words")).where("record is not null and size(words) > 0")
    # 128 bits: two hashes of the sorted set with different seeds
    sets = staged(found.withColumn("digest", F.struct(F.xxhash64("words").alias("x"), F.xxhash64(F.lit(1), "words").alias("y"))))
    reps = sets.groupBy("digest").agg(F.min("record").alias("class_id"), F.first("words").alias("words"), F.count("*").alias("copies"))
    return sets.select("record", "digest"), staged(reps)


def _signature(k: int) -> Column:
    """The k-th 64 bits of the 256-bit bitmap of words."""
    return F.expr(f"aggregate(words, 0L, (acc, h) -> acc | if(pmod(shiftright(h, 7), 4) = {k}, shiftleft(1L, cast(h & 63 as int)), 0L))")


def class_pairs(reps: DataFrame, threshold: float = 0.7) -> DataFrame:
    """a, b, overlap, similarity, a_copies, b_copies of every pair of classes (class_id, words, copies) whose similarity is at least threshold; a < b."""
    t = threshold
    share = t / (1 + t)
    sized = reps.select("class_id", "words", "copies", F.size("words").alias("n"))
    each = sized.select("class_id", F.explode("words").alias("word"))
    counts = staged(each.groupBy("word").agg(F.count("*").alias("df")))
    total = sized.count()
    limit = max(2, math.ceil(total * FREQUENT))
    # at most (words in all) / limit words are frequent: mean set size / FREQUENT, whatever the input's size
    often, seldom = counts.where(F.col("df") >= limit), counts.where(F.col("df") < limit)
    known = each.join(F.broadcast(often), "word", "left")
    common = known.where("df is not null")
    rest = known.where("df is null").drop("df").join(seldom, "word")
    ranked = common.unionByName(rest).groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("order"))
    prefix = F.expr(f"slice(order, 1, size(order) - cast(ceil({t} * size(order) - 1e-9) as int) + 1)")
    band = F.floor(F.log("n") / -math.log(t)).cast("int")
    signed = staged(
        ranked.join(sized, "class_id").select(
            "class_id", "words", "copies", "n", band.alias("band"), *[_signature(k).alias(f"s{k}") for k in range(4)], prefix.alias("prefix")
        )
    )
    rows = signed.select("class_id", "n", "band", "s0", "s1", "s2", "s3", F.posexplode("prefix").alias("at", "p")).where("p.df > 1")
    # the smaller set of a pair shares 2t / (1 + t) of its words, so a shorter prefix of it is enough
    rows = rows.select("*", F.col("p.word").alias("word"), F.expr(f"at <= n - ceil({2 * share!r} * n - 1e-9)").alias("head"))
    # each side of a frequent word's tile is cut by how many records have the word in their prefix, which is far less than have the word
    hot = F.col("p.df") > BLOCK
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    held = rows.where(hot).groupBy("word").agg(blocks(F.count_if("head")).alias("ka"), blocks(F.count("*")).alias("kb"))
    rows = rows.where(~hot).select("*", F.lit(1).alias("ka"), F.lit(1).alias("kb")).unionByName(rows.where(hot).join(held, "word").select(*rows.columns, "ka", "kb"))
    small = F.col("p.df") <= SMALL_TILE
    block = lambda k: F.pmod(F.xxhash64("class_id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    # a tile's key is a hash: where two tiles share one, pairs are tested that would not have met, and no pair is lost
    tile = lambda band, i, j: F.xxhash64("word", F.when(small, -9).otherwise(band), i, j).alias("tile")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("class_id", "n", "at", "s0", "s1", "s2", "s3")]
    left = rows.where("head").select("*", every("kb").alias("j")).select(tile(F.col("band"), block("ka"), F.col("j")), *side("a"))
    tiers = F.explode(F.when(small, F.array(F.lit(-9))).otherwise(F.array(F.col("band"), F.col("band") - 1))).alias("tier")
    right = rows.select("*", every("ka").alias("i")).select("*", tiers).select(tile(F.col("tier"), F.col("i"), block("kb")), *side("b"))
    need = F.expr(f"ceil({share!r} * (a_n + b_n) - 1e-9)")
    a_only = sum((F.bit_count(F.col(f"a_s{k}").bitwiseAND(F.bitwise_not(f"b_s{k}"))) for k in range(1, 4)), F.bit_count(F.col("a_s0").bitwiseAND(F.bitwise_not("b_s0"))))
    b_only = sum((F.bit_count(F.col(f"b_s{k}").bitwiseAND(F.bitwise_not(f"a_s{k}"))) for k in range(1, 4)), F.bit_count(F.col("b_s0").bitwiseAND(F.bitwise_not("a_s0"))))
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_class_id") < F.col("b_class_id")))
    # the first word that two sets share leaves room for enough others behind it
    room = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= need
    fits = smaller & (F.col("a_n") >= F.expr(f"{t} * b_n - 1e-9")) & room & (F.col("a_n") - a_only >= need) & (F.col("b_n") - b_only >= need)
    met = left.join(right, "tile").where(fits).select(F.col("a_class_id").alias("x"), F.col("b_class_id").alias("y")).distinct()
    side = lambda k: signed.select(F.col("class_id").alias(k), F.col("words").alias(f"{k}w"), F.col("copies").alias(f"{k}c"))
    full = met.join(side("x"), "x").join(side("y"), "y")
    overlap = F.size(F.array_intersect("xw", "yw"))
    found = full.select(
        "x", "y", "xc", "yc", overlap.alias("overlap"), (F.size("xw") + F.size("yw") - overlap).alias("either")
    ).where(F.col("overlap") >= t * F.col("either") - 1e-9)
    first = F.col("x") < F.col("y")
    pick = lambda one, other: F.when(first, F.col(one)).otherwise(F.col(other))
    return found.select(
        pick("x", "y").alias("a"), pick("y", "x").alias("b"), "overlap", (
            F.col("overlap") / F.col("either")
        ).alias("similarity"), pick("xc", "yc").alias("a_copies"), pick("yc", "xc").alias("b_copies")
    )


def similar_pairs(df: DataFrame, id_column: str, *texts: str, threshold: float = 0.7) -> DataFrame:
    """rule_a, rule_b of every pair of records at or above threshold, copies included.

    A class of one record is that record. The records of larger classes are spread over blocks of about BLOCK, and blocks meet
    each other, so a task holds the pairs of two blocks at most, however many copies a text has."""
    members, reps = classes(df, id_column, word_set(*texts))
    pairs = staged(class_pairs(reps, threshold).select("a", "b", "a_copies", "b_copies"))
    single = pairs.where("a_copies = 1 and b_copies = 1").select(F.col("a").alias("rule_a"), F.col("b").alias("rule_b"))
    blocks = lambda copies: F.ceil(F.col(copies) / BLOCK).cast("int")
    several = reps.where("copies > 1").select("digest", "class_id", "copies")
    spread = staged(
        members.join(several, "digest").select("class_id", "record", blocks("copies").alias("k")).withColumn(
            "block", F.pmod(F.xxhash64("record"), F.col("k")).cast("int")
        )
    )
    every = lambda copies: F.explode(F.sequence(F.lit(0), blocks(copies) - 1))
    met = pairs.where("a_copies > 1 or b_copies > 1").withColumn("i", every("a_copies")).withColumn("j", every("b_copies"))

    def held(of: str, at: str) -> DataFrame:
        """met with the records of one side: its own id where it has no copies."""
        many = met.where(F.col(f"{of}_copies") > 1).join(spread.select(F.col("class_id").alias(of), F.col("block").alias(at), F.col("record").alias(f"r{of}")), [of, at])
        return many.select("a", "b", "i", "j", f"r{of}").unionByName(met.where(F.col(f"{of}_copies") == 1).select("a", "b", "i", "j", F.col(of).alias(f"r{of}")))

    between = held("a", "i").join(held("b", "j"), ["a", "b", "i", "j"]).select(F.least("ra", "rb").alias("rule_a"), F.greatest("ra", "rb").alias("rule_b"))
    from_here = spread.select("class_id", F.col("record").alias("ra"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("k") - 1)).alias("j"))
    to_there = spread.select("class_id", F.col("record").alias("rb"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
    inside = from_here.join(to_there, ["class_id", "i", "j"]).where("i < j or ra < rb").select(
        F.least("ra", "rb").alias("rule_a"), F.greatest("ra", "rb").alias("rule_b")
    )
    return single.unionByName(between).unionByName(inside)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node is connected with. Edges (a, b); turns of large-star and small-star, each kept
    in the shared folder, until nothing changes; a node with many edges is combined before each shuffle."""
    links = staged(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.col("b").alias("x"), "m", "a")
        earlier, links = links, staged(
            small.select(
                F.col("x").alias("a"), F.col("m").alias("b")
            ).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        discard(earlier)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    root = links.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(root, nodes.node == root.a, "left").select("node", F.coalesce("root", "node").alias("root"))


def similar_groups(df: DataFrame, id_column: str, *texts: str, threshold: float = 0.7) -> DataFrame:
    """record, group_id, class_id, copies, links: one row per record with words. group_id is the smallest record reachable over
    similar pairs, class_id that of its exact copies, links the number of other classes that the class is similar to."""
    members, reps = classes(df, id_column, word_set(*texts))
    pairs = staged(class_pairs(reps, threshold).select("a", "b"))
    roots = components(pairs, reps.select(F.col("class_id").alias("node")))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    grouped = reps.select("digest", F.col("class_id").alias("node"), "copies").join(roots, "node").join(degree, "node", "left")
    return members.join(grouped, "digest").select(
        "record",
        F.col("root").alias("group_id"),
        F.col("node").alias("class_id"),
        "copies",
        F.coalesce("links", F.lit(0)).cast("long").alias("links")
    )
