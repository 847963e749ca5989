"""Line deduplication by winnowing over line hashes, with DataFrame functions only.

A window is ``RUN`` consecutive lines of one document, or fewer that together have ``ALONE`` words or more (one long
line is enough), or all lines of a shorter document. A line goes if some window over it has the lines of an earlier
window (smaller id, or same document and earlier line): repeated runs lose their later copies, however long the run.
With ``alone=None`` only windows of ``run`` lines count.

Winnowing keeps the least line hash of each window, so every repeated run is certain to leave an equal
fingerprint at both places, and far fewer rows than lines are grouped. Positions of recurring fingerprints are extended both
ways to the windows that they stand for; a window's content digest decides where it occurs first; overlapping later
windows merge into the runs that are deleted.

Defined results: null and empty texts are one empty line; lines are compared exactly; shorter runs of fewer than ``ALONE`` words
stay unless they are a whole document that was one before (with ``alone=None`` all shorter runs stay); texts of any length are read whole; rows that repeat an id
or have none are documents of their own, in the order of their text hashes, those without an id last; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickcast.llm.common import ROW, discard, numbered, written

RUN, ALONE = 3, 8


def _lines(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _range(first, last) -> F.Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def remove_repeated_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", alone: int | None = ALONE) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text of every row."""
    if run < 1:
        raise ValueError("run must be at least 1")
    sizes = [run] if alone is None else list(range(1, run + 1))

    def words(text) -> list[F.Column]:
        """Words of each line; only shorter windows need them."""
        return [F.transform(_lines(text), lambda x: F.size(F.array_remove(F.split(x, r"[\x20\x09-\x0D]+"), ""))).alias("w")] if len(sizes) > 1 else []

    def counts(starts, size, n: int) -> F.Column:
        """Those of the starts where ``n`` lines are a window."""
        if n == run:
            return starts
        return F.filter(starts, lambda i: (size == n) | (F.aggregate(F.slice("w", i + 1, n), F.lit(0), lambda a, b: a + b) >= alone))

    own = numbered(docs, id_col, text_col).select(F.col(ROW).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashed = own.select("row", F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x)).alias("h"), *words(F.col("text"))).filter(F.size("h") >= sizes[0])
    # for each window the first place of its least hash; neighbours that choose the same place become one span of windows
    least = lambda n: F.transform(
        counts(_range(F.lit(0), F.size("h") - n), F.size("h"), n),
        lambda i: i + F.array_position(F.slice("h", i + 1, n), F.array_min(F.slice("h", i + 1, n))).cast("int") - 1,
    )
    chosen = hashed.select("row", "h", F.array_distinct(F.flatten(F.array(*map(least, sizes)))).alias("at"))
    marks = chosen.select("row", F.inline(F.transform("at", lambda p: F.struct(p.alias("p"), F.element_at("h", p + 1).alias("fp")))))
    again = written(marks.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "fingerprints")
    joined = marks.join(again, "fp").select("row", "p")
    places = written(joined.groupBy("row").agg(F.collect_set("p").alias("ps")), "places")
    # extend both ways: all windows around a recurring fingerprint, each with its content's digest
    # texts follow the corpus: both joins with them are shuffles at any size
    lines = own.hint("merge").join(places, "row").select("row", "ps", _lines(F.col("text")).alias("x"), *words(F.col("text")))
    around = lambda n: F.transform(
        counts(F.array_distinct(F.flatten(F.transform("ps", lambda p: _range(F.greatest(p - (n - 1), F.lit(0)), F.least(p, F.size("x") - n))))), F.size("x"), n),
        lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"), F.unhex(F.md5(F.array_join(F.slice("x", i + 1, n), "\n"))).alias("k")),
    )
    # a window's digest is all that leaves its text; the lines are not copied for each window
    windows = written(lines.select("row", F.inline(F.flatten(F.array(*map(around, sizes))))), "line-windows")
    firsts = written(windows.groupBy("k").agg(F.min(F.struct("row", "i")).alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("k", "first"), "first-windows")
    later = windows.join(firsts, "k").filter(F.struct("row", "i") != F.col("first"))
    gone = later.groupBy("row").agg(F.collect_set(F.struct("i", "n")).alias("starts"))
    gone = written(gone.select("row", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1)))).alias("gone")), "gone-lines")
    discard(again, places, windows, firsts)
    out = own.hint("merge").join(gone, "row", "left").select("doc_id", _lines(F.col("text")).alias("x"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("x") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("x")).otherwise(F.transform(left, lambda i: F.element_at("x", i + 1)))
    return out.select("doc_id", F.size("x").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(kept, "\n").alias("kept_text"))
