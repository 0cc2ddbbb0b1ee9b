"""Mixing sources by temperature, with DataFrame operations only.

Weights. A source's weight is its token share to the power of an exponent,
normalised. The exponent is bisected until the weights' entropy (bits) meets
``entropy``, or until no source repeats more often than ``repeats`` within the
budget. Each pass over the sources evaluates the next five levels of the
bisection at once; nothing is collected but the sums of 31 exponents.

Realisation. A source's documents are dealt into blocks by a hash of their id and text. An
epoch is a seeded permutation of the blocks. Whole epochs are taken while the
source's budget lasts, then blocks of one more epoch, and of the block in which
the budget ends, documents in hash order until it is met. A row's ``position``
(0 to 1) interleaves the sources in proportion: sorting by it gives the mixture.

Scale. Shares are combined before their shuffle. Blocks are of bounded tokens, so
a hot source is many blocks. Blocks (not documents) are summed in a source's order, in
two levels: ranges of the order's hash first, of which a source has ``RANGES`` an epoch,
then within a range. Documents are summed only within the one block in which a budget ends.

Defined cases: null sources are one source, named null; null text has no tokens;
sources without tokens have no weight and are left out, as are documents without
tokens; an empty table gives an empty mixture; a budget of zero too; repeated rows
are documents of their own, and of rows with one id the lesser hash of the text comes first
(rows equal in both can't be told apart, so it is no matter which is cut); a target beyond what exponents of 0 to ``MOST`` (1 for
repeats) reach gives the nearest of them. Input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_hash

MOST, LEVELS, ROUNDS = 4.0, 5, 8
#: Ranges of the hash that orders the blocks of an epoch, a power of two.
RANGES = 1024
#: Sources up to this many are broadcast to the documents; more are joined.
FEW = 10_000
OUTPUT = ("epoch", "block", "position", "weight")


def tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(shares: DataFrame, ratio: float, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent for ``shares`` (p, above zero). ratio: budget over all tokens.

    Entropy falls with the exponent, and so do the repeats of the smallest source.
    """
    # at 1 all sources repeat alike; beyond it the largest would repeat more again
    low, high = 0.0, MOST if entropy is not None else 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / (1 << LEVELS) for k in range(1, 1 << LEVELS)]
        at = shares.select(F.log("p").alias("lp"), F.explode(F.array(*map(F.lit, grid))).alias("t"))
        sums = at.groupBy("t").agg(F.sum(F.exp(F.col("t") * F.col("lp"))).alias("z"), F.sum(F.exp(F.col("t") * F.col("lp")) * F.col("lp")).alias("s"), F.max((F.col("t") - 1) * F.col("lp")).alias("m"))
        value = (F.log("z") - F.col("t") * F.col("s") / F.col("z")) / F.log(F.lit(2.0)) if entropy is not None else F.exp(F.col("m")) / F.col("z") * ratio
        target = entropy if entropy is not None else repeats
        over = [r.t for r in sums.select("t", value.alias("v")).where(F.col("v") > target).collect()]
        low = max([low, *over])
        high = min([high, *(t for t in grid if t > low)])
    return high if repeats is not None and entropy is None else (low + high) / 2


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", budget: int | None = None, entropy: float | None = None, repeats: float = 2.0, block_tokens: int = 100_000, seed: int = 1) -> DataFrame:
    """``docs``, each row as often as the mixture takes it, with epoch, block, position and weight.

    ``budget``: tokens of the mixture; as many as there are, if not given. With
    ``entropy`` the repeat limit is not applied.
    """
    own = docs.drop(*OUTPUT)
    named = own.where(F.col(text).rlike(r"[^\x20\x09-\x0D]")).withColumn("__s", F.coalesce(F.col(source).cast("string"), F.lit("\0")))
    dealt = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text))
    # tokens are counted once, into a table without texts
    counted = materialise(named.select("__s", tokens(text).alias("__n"), dealt.alias("__h")), "token-counts")
    sized = counted.groupBy("__s").agg(F.sum("__n").alias("total"))
    total = sized.agg(F.sum("total").alias("t"), F.count("*").alias("k")).first()
    whole, budget = total.t or 0, (total.t or 0) if budget is None else budget
    if not whole or budget <= 0:
        return own.limit(0).withColumns({"epoch": F.lit(0), "block": F.lit(0).cast("long"), "position": F.lit(0.0), "weight": F.lit(0.0)})
    sources = materialise(sized.withColumn("p", F.col("total") / whole), "source-shares")
    t = exponent(sources, budget / whole, entropy, None if entropy is not None else repeats)
    z = sources.agg(F.sum(F.pow("p", F.lit(t)))).first()[0]
    sources = sources.withColumn("weight", F.pow("p", F.lit(t)) / z).withColumn("quota", F.col("weight") * budget)
    sources = sources.withColumn("full", F.floor(F.col("quota") / F.col("total") + 1e-9).cast("int")).withColumn("blocks", F.ceil(F.col("total") / block_tokens))
    sources = materialise(sources, "source-quotas")
    small = F.broadcast(sources) if total.k <= FEW else sources
    placed = named.withColumn("__h", dealt).join(small.select("__s", "blocks"), "__s").withColumn("block", F.pmod("__h", F.col("blocks"))).drop("blocks", "__h")
    blocks = counted.join(small, "__s").withColumn("block", F.pmod("__h", F.col("blocks")))
    blocks = blocks.groupBy("__s", "block").agg(F.sum("__n").alias("n")).join(small, "__s")
    each = blocks.select("__s", "block", "n", "total", "quota", "weight", "full", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("epoch"))
    each = each.withColumn("__o", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epoch", "__s", "block"), 1)).withColumn("__r", F.shiftright("__o", 63 - RANGES.bit_length() + 1))
    ranges = each.groupBy("__s", "epoch", "__r").agg(F.sum("n").alias("own"))
    so_far = Window.partitionBy("__s").orderBy("epoch", "__r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__s", "epoch", "__r", F.coalesce(F.sum("own").over(so_far), F.lit(0)).alias("offset"))
    order = Window.partitionBy("__s", "epoch", "__r").orderBy("__o", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed_blocks = each.join(ranges, ["__s", "epoch", "__r"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    taken = placed_blocks.where(F.col("before") < F.col("quota") - 1e-6)
    taken = materialise(taken.select("__s", "block", "epoch", "weight", (F.col("before") / F.col("quota")).alias("position"), (F.col("quota") - F.col("before")).alias("room"), (F.col("before") + F.col("n") > F.col("quota") + 1e-6).alias("part")), "taken-blocks")
    rows = placed.join(taken, ["__s", "block"])
    within = Window.partitionBy("__s", "block", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", F.col(doc_id).cast("string")), doc_id, text_hash(text)).rowsBetween(Window.unboundedPreceding, -1)
    ended = placed.join(taken.where("part"), ["__s", "block"]).withColumn("__n", tokens(text))
    cut = ended.withColumn("__b", F.coalesce(F.sum("__n").over(within), F.lit(0))).where(F.col("__b") < F.col("room"))
    both = rows.where(~F.col("part")).unionByName(cut.drop("__b", "__n"))
    return both.select(*own.columns, "epoch", "block", "position", "weight")
