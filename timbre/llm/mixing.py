"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised.  The
exponent is bisected until the weights reach a target entropy, or until no
source has to be repeated more often than a limit.  The weights are realised
exactly: a source's budget of tokens is so many whole passes over its blocks,
each pass in a permutation of its own, and a last pass cut off at the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize, repeated, row_key

BLOCK_DOCS = 512
#: Exponents that one pass over the sources tries, and passes: 63 points divide an interval by 64.
TRIES, PASSES = 63, 10


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares raised to ``exponent``, normalised; empty sources keep weight 0."""
    top = max(shares, default=0)
    raw = [(s / top) ** exponent if s > 0 else 0.0 for s in shares]
    total = sum(raw)
    return [r / total for r in raw] if total else raw


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect_exponent(shares: list[float], target_entropy: float | None = None, max_repeats: float | None = None, budget_share: float = 1.0) -> float:
    """The exponent in [0, 1] that meets the target.

    Entropy falls as the exponent grows: the result is the largest exponent whose
    entropy reaches ``target_entropy`` (0 if none does).  With ``max_repeats`` it is the
    smallest exponent at which no source is passed over more often, for a
    budget of ``budget_share`` times the corpus (1 if none does).
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")

    def judge(x: float) -> bool:
        weights = tempered(shares, x)
        return _below(entropy(weights), max((w / s for w, s in zip(weights, shares, strict=True) if s > 0), default=0), target_entropy, max_repeats, budget_share)

    return _search(lambda xs: [judge(x) for x in xs], target_entropy is not None)


def _below(entropy_: float, repeats: float, target_entropy: float | None, max_repeats: float | None, budget_share: float) -> bool:
    """Whether an exponent with this entropy and these repeats lies below the one sought."""
    return entropy_ >= target_entropy if target_entropy is not None else repeats * budget_share > max_repeats


def _search(below, lower: bool) -> float:
    """The border in [0, 1] between exponents that are ``below`` and those that are not: its lower or its upper end."""
    first, last = below([0.0, 1.0])
    if last or not first:
        return 1.0 if last else 0.0
    a, b = 0.0, 1.0
    for _ in range(PASSES):
        xs = [a + (b - a) * i / (TRIES + 1) for i in range(1, TRIES + 1)]
        n = sum(below(xs))
        a, b = xs[n - 1] if n else a, xs[n] if n < TRIES else b
    return a if lower else b


def _exponent(per: DataFrame, total: int, target_entropy_share: float | None, max_repeats: float | None, budget_share: float) -> float:
    """``bisect_exponent`` over the sources ``per(tokens)`` as they are, however many; the sums are decimals, so that their order does not matter."""
    held = per.where("tokens > 0").select("tokens")
    top, n = held.agg(F.max("tokens"), F.count("*")).first()
    target = None if max_repeats is not None else target_entropy_share * math.log(max(1, n))
    exact = "decimal(38,18)"

    def below(xs: list[float]) -> list[bool]:
        tried = held.select("tokens", F.explode(F.array(*(F.lit(float(x)) for x in xs))).alias("x")).withColumn("r", F.col("tokens") / F.lit(float(top)))
        power = F.pow("r", "x")
        got = tried.groupBy("x").agg(F.sum(power.cast(exact)).cast("double").alias("z"), F.sum((power * F.log("r")).cast(exact)).cast("double").alias("l"), F.max(power / F.col("tokens")).alias("m")).collect()
        got = {r["x"]: r for r in got}
        # weights are r^x / z
        return [_below(math.log(got[x]["z"]) - x * got[x]["l"] / got[x]["z"] + 1e-12, got[x]["m"] / got[x]["z"] * total, target, max_repeats, budget_share) for x in xs]

    return _search(below, target is not None)


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, target_entropy_share: float | None = 0.95, max_repeats: float | None = None, budget_share: float = 1.0, seed: int = 0, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` as often as their source's budget asks, with mix_* columns.

    Adds mix_epoch (0, 1, ...: the pass), mix_block (the block's place in the
    pass), mix_tokens (words) and mix_weight.  ``target_entropy_share`` is the
    target as a part of the largest entropy, log(number of sources).  The budget of the whole is
    ``budget_share`` times the corpus, in words.  The document in which a budget
    ends is taken whole, so a source exceeds its budget by less than one document.  A
    null source is a source like others; documents without words come with whole passes, and with the cut
    one while it lasts; if a source has no words at all, each of its rows comes once.
    Repeated rows stay repeated; where a budget ends among rows of one id and text, one of them is taken as
    often as there is room.  Very long texts count whole.  An empty table gives an empty result.  Columns with mix_* names are replaced.
    """
    given = [c for c in docs.columns if not c.lower().startswith("mix_")]
    docs = docs.select(*(F.col(f"`{c}`") for c in given))
    # a name for each source, null or not
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    keyed = [name.alias("mix_s"), F.xxhash64("doc_id", row_key(), F.lit(seed)).alias("mix_key"), word_count(F.col("text")).alias("mix_tokens")]
    sized = materialize(docs.select(*keyed))
    per = materialize(sized.groupBy("mix_s").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("n")))
    total = int(per.agg(F.sum("tokens")).first()[0] or 0)
    exponent = _exponent(per, total, target_entropy_share, max_repeats, budget_share) if total else 1.0
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent))).otherwise(F.lit(0.0))
    scale = float(per.agg(F.sum(raw.cast("decimal(38,18)"))).first()[0] or 0) or 1.0
    budget = F.round(raw / scale * budget_share * total).cast("long")
    has = F.col("tokens") > 0
    plan = per.select(
        "mix_s", "n", (raw / scale).alias("mix_weight"), F.when(has, F.floor(budget / F.col("tokens"))).otherwise(1).cast("long").alias("whole"),
        F.when(has, F.pmod(budget, F.col("tokens"))).otherwise(0).cast("long").alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("n") / block_docs)).cast("long").alias("blocks"),
    )
    plan = materialize(plan)

    def block_of(df: DataFrame) -> DataFrame:
        return join_groups(df, plan, ["mix_s"], "n").withColumn("mix_b", F.pmod("mix_key", "blocks")).drop("blocks", "n")

    placed = block_of(sized)
    blocks = placed.groupBy("mix_s", "mix_b").agg(F.sum("mix_tokens").alias("size"), F.count("*").alias("docs"), F.any_value("whole").alias("whole"), F.any_value("rest").alias("rest"))
    passes = repeated(materialize(blocks).withColumn("times", F.col("whole") + (F.col("rest") > 0).cast("long")), "times", "mix_epoch").drop("times")
    # a pass over a source is ordered in two steps, groups of blocks by the leading bits of their order and blocks within a group
    passes = passes.withColumn("o", F.xxhash64("mix_b", "mix_epoch", F.lit(seed))).withColumn("g", F.shiftright("o", 52))
    passes = materialize(passes)
    one = ["mix_s", "mix_epoch"]
    groups = passes.groupBy(*one, "g").agg(F.sum("size").alias("g_size"), F.count("*").alias("g_n"))
    ahead = Window.partitionBy(*one).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*one, "g", F.coalesce(F.sum("g_size").over(ahead), F.lit(0)).alias("g_before"), F.coalesce(F.sum("g_n").over(ahead), F.lit(0)).alias("g_place"))
    order = Window.partitionBy(*one, "g").orderBy("o", "mix_b")
    passes = passes.join(groups, [*one, "g"])
    passes = passes.withColumns({"mix_block": F.col("g_place") + F.row_number().over(order) - 1, "before": F.col("g_before") + F.sum("size").over(order) - F.col("size")})
    passes = passes.where((F.col("mix_epoch") < F.col("whole")) | (F.col("before") < F.col("rest")))
    # how much of the block is taken: null for all of it
    room = F.when((F.col("mix_epoch") == F.col("whole")) & (F.col("before") + F.col("size") > F.col("rest")), F.col("rest") - F.col("before"))
    passes = materialize(passes.select("mix_s", "mix_b", "mix_epoch", "mix_block", "docs", room.alias("room")))
    # the given columns travel as one, so that no name of theirs meets one of the plan's
    rows = block_of(docs.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("row"), *keyed)).drop("whole", "rest")
    here = ["mix_s", "mix_b"]
    whole = join_groups(rows, passes.where("room is null").drop("room"), here, "docs")
    # at most one block of a source is cut: its rows, in the order of their keys, while room is left; rows of one key are counted, not listed
    cut = materialize(passes.where("room is not null"))
    one_key = [*here, "mix_key", "mix_tokens"]
    keys = join_groups(placed.select(*one_key), cut, here, "docs").groupBy(*one_key, "mix_epoch", "mix_block", "room").agg(F.count("*").alias("docs"))
    before = Window.partitionBy(*here).orderBy("mix_key", "mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("room") - F.coalesce(F.sum(F.col("docs") * F.col("mix_tokens")).over(before), F.lit(0))
    taken = F.when(F.col("mix_tokens") > 0, F.least("docs", F.ceil(F.col("left") / F.col("mix_tokens")))).otherwise(F.col("docs"))
    keys = materialize(keys.withColumn("left", left).where("left > 0").withColumn("taken", taken.cast("long")).drop("room", "left"))
    ended = join_groups(rows, keys.where("taken = docs").drop("taken"), one_key, "docs")
    # the key at which the budget ends: one of its rows as often as there is room
    some = join_groups(rows, keys.where("taken < docs"), one_key, "docs").groupBy(*one_key, "mix_epoch", "mix_block", "taken").agg(F.first("row").alias("row"), F.first("mix_weight").alias("mix_weight"))
    some = repeated(materialize(some), "taken", "copy")
    names = [*(F.col(f"row.`{c}`").alias(c) for c in given), "mix_epoch", "mix_block", "mix_tokens", "mix_weight"]
    out = whole.select(*names).unionByName(ended.select(*names)).unionByName(some.select(*names))
    return out.withColumns({c: F.col(c).cast("int") for c in ("mix_epoch", "mix_block")})
