"""Line dedup by a deletion-neighbourhood join; DataFrame operations only.

Two lines match when they are equal, or when both have ``min_chars``
characters or more and one edit (a character inserted, deleted or replaced)
turns one into the other.  A line goes when an earlier line of the corpus, in
the order (doc_id, line number), matches it; lines are judged on the input,
not on what is left.  Blank lines always stay.

1. Lines are named by 128 bits of two independent hashes and reduced to their first occurrence;
   the other occurrences go.
2. One edit leaves the first or the second half of a line as it was.  Only
   first occurrences that share a half with another line of that length, or of one
   more or less, can have a near partner; the rest emit nothing, which loses no match.
   What the shared half leaves open is a piece of the line.  Long pieces are taken apart in turn, keeping the
   parts whose surroundings another line shares, so that the work grows with a line's length and not its square.
3. The pieces emit every variant with one character deleted, as keys hashed with what surrounds them.  Two lines of one
   length that agree without their i-th characters share (i, variant); a line that is
   another's variant shares it with the whole piece.  For each key only the earliest line is kept (a
   minimum, not pairs) and joined back.
4. Each line is held against the partners found: without the characters in question the texts must be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, small

#: Shorter lines match only when equal: one edit turns "12" into "13", or "no" into "so", which repeats nothing.
MIN_CHARS = 20
#: Bytes up to which a table of keys or places is broadcast, after measuring; beyond that the lines are shuffled to it.
BROADCAST = 32 << 20
#: Characters of a piece that emits its variants directly.
PIECE = 128
#: Parts into which a longer piece is taken at once.
PARTS = 8
_HERE = ["doc_id", "rk", "line_no"]
#: The sides that one edit may leave as they were, each with the line as the longer (or equal) and the shorter of a pair.
_ROLES = [("p", 0), ("p", 1), ("s", 0), ("s", 1)]


def _half(n: Column) -> Column:
    """Length of the halves of a pair whose longer line has ``n`` characters."""
    return F.floor((n - 1) / 2).cast("int")


def _key(line: Column, n: Column, side: str, shorter: int) -> Column:
    """Key of the half that a pair shares."""
    h = _half(n + shorter)
    return F.xxhash64(F.lit(side), n + shorter, F.left(line, h) if side == "p" else F.right(line, h))


def line_spots(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, rk, line_no, h1, h2, k0..k3): each line that is not blank, its two hashes and the keys of its halves by ``_ROLES``."""
    lines = docs.select("doc_id", "rk", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("n", F.length("line"))
    long = F.col("n") >= max(min_chars, 3)
    keys = [F.when(long, _key(F.col("line"), F.col("n"), side, shorter)).alias(f"k{i}") for i, (side, shorter) in enumerate(_ROLES)]
    return lines.select(*_HERE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), *keys)


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key occurs more than once."""
    return keyed.join(small(materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")), BROADCAST), "key", "left_semi")


def _pieces(held: DataFrame) -> DataFrame:
    """(pos, key, start, size, shorter, piece) from lines with the roles of their shared halves; the piece begins at character ``start`` of the line.

    ``size`` counts the places at which the longer line of a pair may differ; a shorter line's piece has one character less.
    """
    roles = []
    for i, (side, shorter) in enumerate(_ROLES):
        n = F.length("line")
        size = n + shorter - _half(n + shorter)
        piece = F.right("line", size - shorter) if side == "p" else F.left("line", size - shorter)
        here = F.struct(F.expr(f"keys[{i}]").alias("key"), (_half(n + shorter) if side == "p" else F.lit(0)).alias("start"), size.alias("size"), F.lit(bool(shorter)).alias("shorter"), piece.alias("piece"))
        roles.append(F.when(F.expr(f"keys[{i}]").isNotNull(), here))
    return held.select("pos", F.explode(F.array_compact(F.array(*roles))).alias("r")).select("pos", "r.*")


def _parted(pieces: DataFrame) -> DataFrame:
    """The parts of long pieces whose surroundings another line shares."""
    less = F.col("shorter").cast("int")

    def part(j: int) -> Column:
        lo, hi = (F.floor(F.col("size") * k / PARTS).cast("int") for k in (j, j + 1))
        around = F.xxhash64(F.lit(j), "key", F.left("piece", lo), F.right("piece", F.col("size") - hi))
        return F.struct(around.alias("key"), (F.col("start") + lo).alias("start"), (hi - lo).alias("size"), F.substring("piece", lo + 1, hi - lo - less).alias("piece"))

    return _shared(pieces.select("pos", "shorter", F.inline(F.array(*(part(j) for j in range(PARTS)))))).select("pos", "key", "start", "size", "shorter", "piece")


def _without(line: str, at) -> Column:
    """The line without its character ``at``."""
    return F.concat(F.left(line, at), F.substring(line, at + 2, F.length(line)))


def _near(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Of first occurrences with keys: those (doc_id, rk, line_no) that one edit ties to an earlier line."""
    halves = firsts.select(*_HERE, F.posexplode(F.array(*(f"k{i}" for i in range(len(_ROLES))))).alias("role", "key"))
    roles = [F.max(F.when(F.col("role") == i, F.col("key"))) for i in range(len(_ROLES))]
    wanted = _shared(halves).groupBy(*_HERE).agg(F.array(*roles).alias("keys"))
    spots = wanted.groupBy(F.col("doc_id").alias("p_doc"), F.col("rk").alias("p_rk")).agg(F.collect_list(F.struct("line_no", "keys")).alias("spots"))
    held = docs.join(small(materialize(spots), BROADCAST), F.col("doc_id").eqNullSafe(F.col("p_doc")) & (F.col("rk") == F.col("p_rk")))
    held = held.select("doc_id", "rk", F.split("text", "\n").alias("all"), F.explode("spots").alias("s"))
    held = held.select(F.struct("doc_id", "rk", F.col("s.line_no").alias("line_no")).alias("pos"), F.expr("all[s.line_no]").alias("line"), F.col("s.keys").alias("keys"))
    held = materialize(held.distinct())
    every = _pieces(held)
    pieces, long = every.where(F.col("size") <= PIECE), every.where(F.col("size") > PIECE)
    while long.limit(1).count():
        parted = materialize(_parted(long))
        pieces, long = pieces.unionByName(parted.where(F.col("size") <= PIECE)), parted.where(F.col("size") > PIECE)
    longer = pieces.where("not shorter").select("pos", "key", "start", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - 1)).alias("i"))
    variant = F.concat(F.expr("left(piece, i)"), F.expr("substring(piece, i + 2)"))
    kinds = F.array(
        F.struct(F.xxhash64(F.lit("replace"), "key", "i", "variant").alias("key"), F.lit(0).alias("kind")),
        F.struct(F.xxhash64(F.lit("delete"), "key", "variant").alias("key"), F.lit(1).alias("kind")),
    )
    emitted = longer.withColumn("variant", variant).select("pos", (F.col("start") + F.col("i")).alias("at"), F.inline(kinds))
    emitted = emitted.unionByName(pieces.where("shorter").select("pos", F.lit(None).cast("int").alias("at"), F.xxhash64(F.lit("delete"), "key", "piece").alias("key"), F.lit(2).alias("kind")))
    least = [F.min(F.when(F.col("kind") == i, F.struct("pos", "at"))).alias(k) for i, k in enumerate(("replace", "longer", "shorter"))]
    earliest = emitted.groupBy("key").agg(F.count("*").alias("n"), *least).where("n > 1").drop("n")
    partner = F.when(F.col("kind") == 0, F.col("replace")).when(F.col("kind") == 1, F.col("shorter")).otherwise(F.col("longer"))
    met = emitted.join(earliest, "key").select("pos", "kind", "at", partner.alias("p")).where(F.col("p.pos") < F.col("pos"))
    met = met.select("pos", "kind", "at", F.col("p.pos").alias("partner"), F.col("p.at").alias("p_at")).distinct()
    other = held.select(F.col("pos").alias("partner"), F.col("line").alias("p_line"))
    met = met.join(held.select("pos", "line"), "pos").join(other, "partner")
    equal = (
        F.when(F.col("kind") == 0, _without("line", F.col("at")) == _without("p_line", F.col("at")))
        .when(F.col("kind") == 1, _without("line", F.col("at")) == F.col("p_line")).otherwise(F.col("line") == _without("p_line", F.col("p_at")))
    )
    return met.where(equal).select("pos.*").distinct()


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, rk, line_no) of the lines of ``docs(doc_id, rk, text)`` that go."""
    spots = materialize(line_spots(docs, min_chars))
    here = F.struct(*_HERE)
    # lines that stand more than once, with their first place; a very common line is one row here
    again = materialize(spots.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    judged = spots.join(small(again, BROADCAST), ["h1", "h2"], "left").withColumn("later", F.coalesce(F.col("first") < here, F.lit(False)))
    firsts = judged.where("not later and k0 is not null").select(*_HERE, *(f"k{i}" for i in range(len(_ROLES)))).distinct()
    return judged.where("later").select(*_HERE).unionByName(_near(docs, firsts))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that an earlier line matches, and with ``n_lines``, ``n_removed`` added.

    Columns other than ``doc_id`` and ``text`` are carried along; a column
    that is called n_lines or n_removed is replaced.  A null text stays null,
    with no lines.  A null doc_id comes before all others; rows that repeat a
    doc_id are ordered by a hash of their texts, and rows that repeat doc_id and
    text count as one row, so that neither removes lines of the other.  Very
    long texts stay whole: lines are separate rows until they are joined again.
    """
    rest = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "n_lines", "n_removed")]
    keyed = docs.select("doc_id", row_key().alias("rk"), "text", *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []))
    gone = repeated_lines(keyed.select("doc_id", "rk", "text"), min_chars)
    gone = gone.groupBy(F.col("doc_id").alias("g_doc"), F.col("rk").alias("g_rk")).agg(F.collect_set("line_no").alias("gone"))
    out = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("rk") == F.col("g_rk")), "left")
    lines = F.split("text", "\n")
    out = out.withColumn("lines", lines).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long")
    return out.select("doc_id", text.alias("text"), *(F.col(f"rest.`{c}`").alias(c) for c in rest), n_lines.alias("n_lines"), F.size("gone").cast("long").alias("n_removed"))
