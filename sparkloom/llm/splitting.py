"""Problem 6: oversized texts as overlapping pieces cut at natural boundaries.

One regular expression does the cutting. Its alternatives are bounded runs that end
at a boundary, the strongest boundary first, each at least half a piece long; then
come shorter runs with the same boundaries, then marks within an unbroken run, and
only where a piece holds none of them does the last alternative take plain characters. ``regexp_extract_all``
yields the fresh part of every piece; the running sum of their lengths gives each
piece's start, and looking back ``overlap`` characters over the parts before it gives
the overlap. Every step is a built-in expression on one row, so nothing is shuffled but
the removal of repeated rows, and its time grows with the text's length, not its square.

Every quantifier is bounded, so no boundary makes a part longer than its limit: of a run
of blanks or closing marks longer than a boundary takes, the rest opens the next piece.

Null and blank texts, and texts within the limit, give no pieces. Characters are
code points. Joining the pieces without their overlaps gives the text back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
#: Boundaries from strong to weak, as what ends a fresh part, with the most characters each takes: blank lines, line ends, sentence ends, clause ends, blanks.
BOUNDARIES = ((r"\n[ \t]{0,6}\n", 8), (r"\n", 1), (r"[.!?。！？][\"')\]]{0,4}(?:[ \t]|(?<=[。！？]))", 6), (r"[,;:、，；：](?:[ \t]|(?<=[、，；：]))", 2), (r"\s", 1))
#: Boundaries within an unbroken run: after a comma or semicolon, after any other mark.
MARKS = ((r"[,;、，；]", 1), (r"\p{P}", 1))
CHUNK = 256


def pattern(limit: int, overlap: int) -> str:
    """Fresh parts: at most ``limit`` characters in the first piece, ``limit - overlap`` in each later one."""

    def run(start: str, most: int, short: int) -> list[str]:
        # The boundary itself counts, so the run before it is shorter by the most it can take.
        half, cut = most // 2, []
        for kinds in (BOUNDARIES, MARKS):
            for lo, below in ((half, most + 1), (short, half)):
                cut += [rf"{start}.{{{lo},{hi}}}(?:{b})(?<!\r(?=\n))" for b, size in kinds if lo <= (hi := min(most - size, below - 1))]
        return [rf"{start}.{{1,{most}}}\z", *cut, rf"{start}.{{1,{most}}}"]

    # The first piece holds what the second looks back on.
    return "(?s)" + "|".join(run(r"\A", limit, max(1, overlap - 1)) + run(r"(?!\A)", limit - overlap, 1))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, as the element of an array of one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(sizes: Column) -> Column:
    """What lies before each element of ``sizes``; in chunks, as a fold that appends copies what it has."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)
    grown = lambda x, start: F.aggregate(x, F.array(start), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))

    def joined(chunks: Column) -> Column:
        starts = F.slice(grown(F.transform(chunks, total), F.lit(0)), 1, F.size(chunks))
        return F.flatten(F.zip_with(chunks, starts, lambda x, s: F.slice(grown(x, s), 1, F.size(x))))

    return bound(F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, CHUNK)), joined)


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """``array<struct<piece_no, start, piece>>``; null for a text within the limit."""
    if not 0 <= overlap < limit - 16:
        raise ValueError("the overlap must leave room for fresh text")

    def tail(parts: Column, i: Column) -> Column:
        """The last ``overlap`` characters before part ``i`` (from 0); a part holds one at least, so that many parts are enough."""
        last = F.get(parts, i - 1)
        far = F.greatest(i - overlap, F.lit(0))
        return F.when(F.length(last) >= overlap, F.right(last, F.lit(overlap))).otherwise(F.right(F.array_join(F.slice(parts, far + 1, i - far), ""), F.lit(overlap)))

    def piece(parts: Column, before: Column, part: Column, i: Column) -> Column:
        first = i == 0
        return F.struct((i + 1).alias("piece_no"), F.when(first, 0).otherwise(F.get(before, i) - overlap).alias("start"), F.when(first, part).otherwise(F.concat(tail(parts, i), part)).alias("piece"))

    fresh = F.regexp_extract_all(text, F.lit(pattern(limit, overlap)), F.lit(0))
    made = bound(fresh, lambda parts: bound(F.transform(parts, lambda x: F.length(x)), lambda sizes: bound(running(sizes), lambda before: F.transform(parts, lambda part, i: piece(parts, before, part, i)))))
    return F.when(F.length(text) > limit, made)


def split_rows(rows: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key, piece_no, start, piece`` of every oversized text; rows that repeat an id with the same text count once."""
    long = rows.where(F.length(text) > limit).select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropDuplicates()
    return long.select(F.col("_key").alias(key), F.inline(pieces(F.col("_text"), limit, overlap)))
