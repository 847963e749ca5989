"""Fill-in-the-middle training texts: a text is cut at two of its units and put together in another order around sentinels.

Units are runs of ASCII letters and single other code points. Nothing but the text itself is held: a first pass counts the units, a
second moves a lazy match iterator to both cuts, so memory does not follow the number of units.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickcast.llm import common

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def count_units(text: str) -> int:
    """Number of units; each match is let go as the next is found."""
    last = deque(enumerate(UNIT.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def cuts(text: str, first: int, second: int) -> tuple[int, int]:
    """Code points before the end of unit ``first`` and of unit ``second`` (not smaller), counted from 1; 0 is the text's start."""
    units = UNIT.finditer(text)
    a = _end(units, first, 0)
    return a, _end(units, second - first, a)


def _end(units: Iterator[re.Match], k: int, at: int) -> int:
    return next(islice(units, k - 1, None)).end() if k else at


def _hash_number(digest: str, k: int) -> int:
    return int(digest[8 * k : 8 * k + 8], 16)


def transformed(text: str, digest: str, changed: int, spm: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(number of units, form, prefix and middle length, output) of one text; the numbers in ``digest`` choose cuts and form."""
    n = count_units(text)
    if not text or any(s in text for s in sentinels) or _hash_number(digest, 2) % 100 >= changed:
        return n, "plain", None, None, text
    a, b = cuts(text, *sorted((_hash_number(digest, 0) % (n + 1), _hash_number(digest, 1) % (n + 1))))
    p, s, m = sentinels
    if _hash_number(digest, 3) % 100 < spm:
        return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, changed: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row, without a shuffle.

    ``n`` counts units. ``changed`` of a hundred texts are transformed, of these ``spm`` of a hundred in suffix-prefix-middle order, the rest
    in prefix-suffix-middle order; the choice and the cuts follow the sha256 of seed and id, so a run is repeatable and rows of one id share them.

    Empty texts, null texts (they count as empty) and texts that hold a sentinel stay plain, with null lengths. A null id is hashed as the
    empty string. Repeated rows are rows of their own, an empty table gives an empty one, other columns do not matter. A text is held
    whole once as input and once as output.
    """
    common.bounded_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("digest"))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [transformed(t.as_py(), d.as_py(), changed, spm, sentinels) for t, d in zip(batch.column(1), batch.column(2))]
        columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return common.mapped(rows, one, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text from an output and its form. No part holds a sentinel, and sentinels start with a sign of their own, so the first ones are the real ones."""
    p, s, m = map(F.lit, sentinels)
    part = lambda x, by, k: F.split_part(x, by, F.lit(k))
    after = lambda x, sign: F.substr(x, F.length(sign) + 1)
    psm = F.concat(after(part(output, s, 1), p), part(part(output, s, 2), m, 2), part(part(output, s, 2), m, 1))
    spm = F.concat(part(part(output, p, 2), m, 1), part(part(output, p, 2), m, 2), after(part(output, p, 1), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
