"""Line dedup (1): a deletion-neighbourhood join over distinct lines, in DataFrame functions only.

Two lines are within one edit when deleting one character at one place makes them equal (a
substitution), or deleting one from the longer gives the shorter (an insertion). All variants of every line would
be a row for each character, so the neighbourhood is taken from coarse to fine, and each pass keeps only lines
that share a variant: first a half of the line is deleted, then an eighth, then eighths of that until a block is
short, then single characters inside the block that differs. So a line of n characters has O(log n) passes and no variant of it carries
more than its block. A line within one edit of another shares a variant at every pass, so none is lost.
Variants travel as hashes; the texts around a deleted block are compared by 128 bits of hash, what is left by
edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sundew.plans.tables import lookup, materialize, release, tidy

#: Longest block, in characters, whose single characters are deleted; longer ones are cut into eighths again.
SHORT_BLOCK = 512
NOT_BLANK = r"[^\x20\x09-\x0D]"


def deleted_blocks(line: Column, n: Column, blocks: int) -> Column:
    """Structs ``same, c1, c2, middle``: the line without one of ``blocks`` blocks (hashed twice), and that block.

    Blocks are laid out for ``n`` characters, to meet lines of equal length (``same``), and for one fewer, to
    meet lines that are shorter by one; what follows the block is counted from the end.
    """
    out = []
    for same, size in ((True, n), (False, n - 1)):
        width = F.ceil(size / blocks).cast("int")
        for q in range(blocks):
            behind = F.greatest(size - width * (q + 1), F.lit(0))
            left = F.substring(line, F.lit(1), width * q)
            right = F.substring(line, n - behind + 1, behind)
            middle = F.substring(line, width * q + 1, F.greatest(n - behind - width * q, F.lit(0)))
            parts = [F.lit(q), size, left, right]
            out.append(F.struct(F.lit(same).alias("same"), F.xxhash64(*parts).alias("c1"), F.xxhash64(F.lit(7), *parts).alias("c2"), middle.alias("middle")))
    return F.array(*out)


def refined(rows: DataFrame) -> DataFrame:
    """Rows of blocks, each cut into eighths, one of which is deleted; the hashes go on from those of the text around the block."""
    middle, n = F.col("middle"), F.char_length("middle")
    size = n - F.when(F.col("same"), 0).otherwise(1)
    width = F.ceil(size / 8).cast("int")
    out = []
    for q in range(8):
        behind = F.greatest(size - width * (q + 1), F.lit(0))
        parts = [F.col("c1"), F.col("c2"), F.lit(q), size, F.substring(middle, F.lit(1), width * q), F.substring(middle, n - behind + 1, behind)]
        inner = F.substring(middle, width * q + 1, F.greatest(n - behind - width * q, F.lit(0)))
        out.append(F.struct(F.xxhash64(*parts).alias("c1"), F.xxhash64(F.lit(7), *parts).alias("c2"), inner.alias("middle")))
    return rows.select("h1", "h2", "first", "same", F.explode(F.array(*out)).alias("d")).select("h1", "h2", "first", "same", "d.*")


def halves_of(line: Column, n: Column) -> Column:
    """The same for two blocks, without the blocks and the second hash, which the first pass doesn't need."""
    out = []
    for same, size in ((True, n), (False, n - 1)):
        width = F.ceil(size / 2).cast("int")
        left, right = F.substring(line, F.lit(1), width), F.substring(line, width + n - size + 1, size - width)
        out += [F.struct(F.lit(same).alias("same"), F.xxhash64(F.lit(q), size, part).alias("c1")) for q, part in enumerate((left, right))]
    return F.array(*out)


def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``rows`` that different lines have, one of them laid out for its own length, with their number of rows ``n``."""
    ends = rows.groupBy(*keys).agg(F.min("h1").alias("__low"), F.max("h1").alias("__high"), F.max("same").alias("__same"), F.count(F.lit(1)).alias("n"))
    return ends.where("__low < __high and __same").select(*keys, "n")


def near_lines(lines: DataFrame, total: int) -> DataFrame:
    """``h1, h2`` of the lines that have an earlier line within one edit.

    ``lines`` (``total`` at most) are distinct and laid out by ``h1, h2``, with ``first`` and ``line``, so that finding the survivors of the first
    pass moves hashes, not texts. In every set of equal variants the earliest line stands for
    all that another could be linked to, so a set is summed up before the shuffle and never paired.
    """
    n = F.char_length("line")
    halves = lines.select("h1", "h2", F.explode(halves_of(F.col("line"), n)).alias("d")).select("h1", "h2", F.col("d.same").alias("same"), F.col("d.c1").alias("c1"))
    alive = lookup(halves, shared(halves, ["c1"]), ["c1"], 4 * total, F.col("h2")).select("h1", "h2").distinct()
    left = materialize(lines.join(alive.hint("merge"), ["h1", "h2"], "left_semi"), "line-halves")
    tidy(lines.sparkSession)
    eighths = left.select("h1", "h2", "first", F.explode(deleted_blocks(F.col("line"), n, 8)).alias("d")).select("h1", "h2", "first", "d.*")
    eighths = materialize(lookup(eighths, shared(eighths, ["c1"]), ["c1"], 16 * left.count(), F.col("h2")), "line-eighths")
    release(left)
    # what two lines within one edit have at one pass has one size, that of the shorter
    reach = F.char_length("middle") - F.when(F.col("same"), 0).otherwise(1)
    while longest := eighths.where(reach > SHORT_BLOCK).count():
        finer = refined(eighths.where(reach > SHORT_BLOCK))
        finer = lookup(finer, shared(finer, ["c1"]), ["c1"], 8 * longest, F.col("h2"))
        finer = materialize(eighths.where(reach <= SHORT_BLOCK).unionByName(finer), "line-eighths")
        release(eighths)
        eighths = finer
    middle, size = F.col("middle"), F.char_length("middle")
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    without = lambda i: F.concat(F.substring(middle, F.lit(1), i - 1), F.substring(middle, i + 1, size))
    # a substitution: one character deleted at one place of lines of one length
    swapped = F.transform(places, lambda i: F.xxhash64(i, without(i)))
    # an insertion: the shorter line as it is, the longer without one character
    longer = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.lit(0), without(i))))
    whole = F.array(F.xxhash64(F.lit(0), middle))
    variants = F.when(F.col("same"), F.concat(swapped, whole)).otherwise(longer)
    kinds = F.when(F.col("same"), F.array_append(F.transform(places, lambda i: F.lit(True)), F.lit(False))).otherwise(F.transform(longer, lambda v: F.lit(False)))
    rows = eighths.select("h1", "h2", "first", "same", "c1", "c2", "middle", F.explode(F.arrays_zip(kinds.alias("swap"), variants.alias("v"))).alias("x"))
    rows = rows.select("h1", "h2", "first", "same", "c1", "c2", "middle", F.col("x.swap").alias("swap"), F.col("x.v").alias("v"))
    keys = ["c1", "c2", "swap", "v"]
    member = F.struct("first", "middle")
    earliest = rows.groupBy(*keys).agg(F.min(F.when(F.col("same"), member)).alias("same_one"), F.min(F.when(~F.col("same"), member)).alias("long_one"), F.count(F.lit(1)).alias("n"))
    met = rows.join(earliest.where("n > 1").drop("n"), keys)
    other = F.when(F.col("swap") | ~F.col("same"), F.col("same_one")).otherwise(F.col("long_one"))
    met = met.withColumn("other", other).where(F.col("other.first") < F.col("first"))
    return met.where(F.levenshtein(F.col("other.middle"), middle, 1) >= 0).select("h1", "h2").distinct()


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every line that has an earlier equal line, or an earlier line within one edit (insertion, deletion, substitution).

    Adds ``kept_text``, ``n_lines`` (with a word), ``n_removed`` and ``n_near`` (removed, but first of their
    wording). Lines end at \\n; earlier means a smaller key, then a smaller line number; all is judged on the input, not on what
    is left. The bound is one edit for a line of any length, so lines of one character are all alike. Lines without a word always stay. A
    null text stays null and has no lines; a null key comes first. Rows with one key are one document: their equal lines
    at one place are not earlier than each other. Repeated rows are treated alike. An empty table gives an
    empty result; a column with the name of an added one is replaced.
    """
    added = ["kept_text", "n_lines", "n_removed", "n_near"]
    df = df.drop(*added)
    own = [F.col(key).alias("__doc"), F.xxhash64(text).alias("__text_hash")]
    spread = df.select(*own, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    spread = spread.where(F.col("line").rlike(NOT_BLANK)).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(3), "line")})
    place = F.struct(F.col("__doc").alias("doc"), "at")
    # an upper bound of the lines, from which a key is told to be hot
    total = df.agg(F.sum(F.coalesce(F.regexp_count(text, F.lit("\n")), F.lit(0)) + 1)).first()[0] or 0
    lines = spread.groupBy("h1", "h2").agg(F.min(F.struct(F.col("__doc").alias("doc"), "at", "line")).alias("f"))
    near = near_lines(lines.select("h1", "h2", F.struct("f.doc", "f.at").alias("first"), "f.line"), total).withColumn("near", F.lit(True))
    near = materialize(near, "line-near")
    tidy(df.sparkSession)
    counted = spread.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    again = counted.join(near, ["h1", "h2"], "left").where("n > 1 or near").select("h1", "h2", "n", "first", F.coalesce("near", F.lit(False)).alias("near"))
    again = materialize(again, "lines-again")
    tidy(df.sparkSession)
    at_first = F.col("first") == place
    judged = lookup(spread.select("__doc", "__text_hash", "at", "h1", "h2"), again, ["h1", "h2"], total, F.xxhash64("__doc", "at", "__text_hash"), "left")
    state = F.when(F.col("first").isNull(), 0).when(~at_first, 1).when(F.col("near"), 2).otherwise(0).cast("byte")
    flags = judged.groupBy("__doc", "__text_hash").agg(F.array_sort(F.collect_set(F.struct("at", state.alias("state")))).alias("__flags"), F.max(state).alias("__any"))
    flags = flags.select(F.col("__doc").alias("__flag_doc"), F.col("__text_hash").alias("__flag_hash"), "__flags", "__any")
    both = df.withColumn("__hash", F.xxhash64(text)).join(flags.hint("merge"), F.col(key).eqNullSafe(F.col("__flag_doc")) & (F.col("__hash") == F.col("__flag_hash")), "left")
    n_lines = F.coalesce(F.size("__flags"), F.lit(0))
    count = lambda test: F.coalesce(F.size(F.filter("__flags", test)), F.lit(0)).cast("long")
    # blank lines have no flag: spread the flags over all places, then keep by place
    removed = F.transform(F.filter("__flags", lambda x: x["state"] > 0), lambda x: x["at"])
    kept = F.array_join(_without(F.split(text, "\n"), removed), "\n")
    return both.select(
        *df.columns,
        F.when(F.col("__any") > 0, kept).otherwise(F.col(text)).alias("kept_text"),
        F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(count(lambda x: x["state"] > 0), F.lit(0)).alias("n_removed"),
        F.greatest(count(lambda x: x["state"] == 2), F.lit(0)).alias("n_near"),
    )


def _without(items: Column, places: Column) -> Column:
    """``items`` without those at the sorted ``places``: the runs between them, so that no place is searched for.

    The array of one struct computes the items and the bounds once; a lambda would compute them for every run.
    """
    bounds = F.concat(F.array(F.lit(-1)), places, F.array(F.size(items)))
    once = F.array(F.struct(items.alias("items"), bounds.alias("bounds")))

    def runs(x: Column) -> Column:
        run = lambda i: F.slice(x["items"], F.element_at(x["bounds"], i + 1) + 2, F.element_at(x["bounds"], i + 2) - F.element_at(x["bounds"], i + 1) - 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["bounds"]) - 2), run))

    return F.element_at(F.transform(once, runs), 1)
