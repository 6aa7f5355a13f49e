"""Candidate pairs of entities of one type.

The blocking predicate is a union of equalities but for one arm, containment of one name in the
other.  The equalities become keys: name, aliases, synonyms, significant words.  A key
with very many entities gives pairs in the square of their number, in many tasks; such keys
are left out only if the caller sets max_key_size, and by default nothing is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.functions.text import alias_keys, name_tier, normal, related, significant_words, synonyms


def blocking_keys(entities: DataFrame) -> DataFrame:
    """(entity_type, vid, key, plain): plain keys meet each other and the expanded ones (synonyms)."""
    keys = alias_keys(F.col("name"), F.col("aliases"))
    plain = F.concat(F.transform(keys, lambda k: F.concat(F.lit("n:"), k)), F.transform(significant_words(F.col("name")), lambda w: F.concat(F.lit("w:"), w)))
    expanded = F.transform(F.array_except(synonyms(keys), keys), lambda k: F.concat(F.lit("n:"), k))
    both = F.concat(F.transform(plain, lambda k: F.struct(k.alias("key"), F.lit(True).alias("plain"))), F.transform(expanded, lambda k: F.struct(k.alias("key"), F.lit(False).alias("plain"))))
    return entities.select("entity_type", "vid", F.explode(both).alias("k")).select("entity_type", "vid", "k.key", "k.plain")


#: A key's entities are dealt into blocks of about so many, and two blocks meet in a task of their own.
BLOCK = 1000


def token_pairs(entities: DataFrame, max_key_size: int | None = None, block: int = BLOCK) -> DataFrame:
    """(entity_type, vid_a, vid_b), vid_a < vid_b: pairs that meet under a key.

    A key of n entities is m = n / block blocks.  An entity stands in a row of m tiles on the
    left and a column of m on the right, so each two meet in one tile, and no tile has more than about
    block squared pairs, whatever the key.
    """
    keys = blocking_keys(entities)
    sizes = keys.groupBy("entity_type", "key").agg(F.count("*").alias("n"))
    if max_key_size is not None:
        keys = keys.join(sizes.filter(F.col("n") <= max_key_size).drop("n"), ["entity_type", "key"], "left_semi")
    large = sizes.filter(F.col("n") > block).select("entity_type", "key", F.ceil(F.col("n") / block).cast("int").alias("m"))
    keys = keys.join(large, ["entity_type", "key"], "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("m")).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    a = keys.select("entity_type", "key", F.col("own").alias("i"), all_blocks.alias("j"), F.col("vid").alias("vid_a"), F.col("plain").alias("plain_a"))
    b = keys.filter("plain").select("entity_type", "key", all_blocks.alias("i"), F.col("own").alias("j"), F.col("vid").alias("vid_b"))
    met = a.join(b, ["entity_type", "key", "i", "j"]).filter((F.col("vid_a") < F.col("vid_b")) | (~F.col("plain_a") & (F.col("vid_a") != F.col("vid_b"))))
    return met.select("entity_type", F.least("vid_a", "vid_b").alias("vid_a"), F.greatest("vid_a", "vid_b").alias("vid_b")).distinct()


def kind_tiles(entities: DataFrame, key: str, kind: list[str], block: int = BLOCK) -> DataFrame:
    """(kind, tile, keys): the sorted keys of entities that are alike in the columns of kind, in tiles of about block."""
    own = entities.select(F.struct(*kind).alias("kind"), F.col(key).alias("key"))
    large = own.groupBy("kind").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("kind", F.ceil(F.col("n") / block).cast("int").alias("m"))
    dealt = own.join(large, "kind", "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64("key"), F.col("m")), F.lit(0)).cast("int"))
    return dealt.groupBy("kind", "tile").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def kind_pairs(tiles: DataFrame, on: list[str]) -> DataFrame:
    """The tiles that meet by the kind's columns `on`, with _a and _b: two meet both ways, and each with itself, if a key of a is below one of b.

    What depends on the kinds alone is made here, once for all pairs of their entities, which
    pair_count counts and each_pair gives.
    """
    a, b = (tiles.select(*(F.col(f"kind.{c}").alias(c) for c in on), *(F.col(c).alias(f"{c}_{x}") for c in tiles.columns)) for x in "ab")
    return a.join(b, on).filter(F.array_min("keys_a") < F.array_max("keys_b")).drop(*on)


def pair_count() -> Column:
    """How many pairs of a key of keys_a and a larger one of keys_b there are: both in one order, and before each of b's, so many of a's."""
    side = lambda keys, last: F.transform(F.col(keys), lambda k: F.struct(k.alias("key"), F.lit(last).alias("a")))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("n"))
    step = lambda s, k: F.struct((s["seen"] + k["a"]).alias("seen"), (s["n"] + F.when(k["a"] == 0, s["seen"]).otherwise(F.lit(0).cast("long"))).alias("n"))
    return F.aggregate(F.sort_array(F.concat(side("keys_a", 1), side("keys_b", 0))), start, step, lambda s: s["n"])


def each_pair(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs of entities, their keys as columns a and b, instead of the pairs of tiles."""
    met = pairs.withColumn(a, F.explode("keys_a")).withColumn(b, F.explode("keys_b")).filter(F.col(a) < F.col(b))
    return met.drop("keys_a", "keys_b")


def contained_pairs(entities: DataFrame, gram: int = 3) -> DataFrame:
    """Pairs of which one name is contained in the other, without comparing all pairs.

    A name of at least gram characters is looked up by its rarest gram among the grams of
    all names, a shorter one by itself among the grams of its length.  An empty name is
    contained in every name of its type.
    """
    names = entities.select("entity_type", "vid", normal(F.col("name")).alias("n"))
    long = names.filter(F.length("n") >= gram)
    grams = long.select("entity_type", "vid", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("n") - gram + 1), lambda i: F.substring(F.col("n"), i, F.lit(gram))))).alias("g"))
    sizes = grams.groupBy("entity_type", "g").agg(F.count("*").alias("size"))
    rarest = grams.join(sizes, ["entity_type", "g"]).groupBy("entity_type", "vid", "n").agg(F.min_by("g", F.struct("size", "g")).alias("g"))
    inner = rarest.select("entity_type", "g", F.col("vid").alias("x"), F.col("n").alias("nx")).join(grams.select("entity_type", "g", F.col("vid").alias("y"), F.col("n").alias("ny")), ["entity_type", "g"])
    def cut(size: int) -> DataFrame:
        own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("n") - size + 1), lambda i: F.substring(F.col("n"), i, F.lit(size))))
        return names.filter(F.length("n") >= size).select("entity_type", F.explode(own).alias("g"), F.col("vid").alias("y"), F.col("n").alias("ny"))

    rest = names.filter(F.length("n") == 0).select("entity_type", F.col("vid").alias("x"), F.col("n").alias("nx")).join(names.select("entity_type", F.col("vid").alias("y"), F.col("n").alias("ny")), "entity_type")
    for size in range(1, gram):
        short = names.filter(F.length("n") == size).select("entity_type", F.col("n").alias("g"), F.col("vid").alias("x"), F.col("n").alias("nx"))
        rest = rest.unionByName(short.join(cut(size), ["entity_type", "g"]).select(rest.columns))
    hit = inner.select("entity_type", "x", "y", "nx", "ny").unionByName(rest).filter((F.col("x") != F.col("y")) & F.contains("ny", "nx"))
    return hit.select("entity_type", F.least("x", "y").alias("vid_a"), F.greatest("x", "y").alias("vid_b")).distinct()


def blocked_pairs(entities: DataFrame, exact: bool = True, max_key_size: int | None = None) -> DataFrame:
    """Pairs of related entities; exact=False leaves out those related by containment alone."""
    pairs = token_pairs(entities, max_key_size)
    return pairs.unionByName(contained_pairs(entities)).distinct() if exact else pairs


def with_sides(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """The pairs with name, aliases and, if there are any, props of both sides."""
    for side in "ab":
        own = entities.select(F.col("vid").alias(f"vid_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("name", "aliases", "props") if c in entities.columns))
        pairs = pairs.join(own, f"vid_{side}")
    return pairs


def similar_pairs(entities: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Pairs with a common word or alias whose names' tier exceeds the threshold, best first."""
    pairs = with_sides(token_pairs(entities), entities)
    scored = pairs.withColumn("score", name_tier(F.col("name_a"), F.col("name_b"), F.col("aliases_a"), F.col("aliases_b")))
    return scored.filter(F.col("score") > threshold).select("entity_type", "vid_a", "vid_b", "name_a", "name_b", "score").orderBy(F.desc("score"), "vid_a", "vid_b")


def all_related(entities: DataFrame) -> DataFrame:
    """Every pair of a type that the predicate relates, by comparing all; for tests and small tables."""
    a = entities.select("entity_type", *(F.col(c).alias(f"{c}_a") for c in ("vid", "name", "aliases")))
    b = entities.select("entity_type", *(F.col(c).alias(f"{c}_b") for c in ("vid", "name", "aliases")))
    hit = a.join(b, "entity_type").filter((F.col("vid_a") < F.col("vid_b")) & related(F.col("name_a"), F.col("name_b"), F.col("aliases_a"), F.col("aliases_b")))
    return hit.select("entity_type", "vid_a", "vid_b")
