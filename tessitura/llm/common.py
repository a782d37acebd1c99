"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the contracts: what separates words.
SPACES = r"[\x20\x09-\x0D]+"
#: A character of a word.
NON_SPACE = r"[^\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(text_or_empty(text), SPACES), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def null_safe(left, right, names: list[str]) -> Column:
    """Equality of the named columns of two frames in which null equals null."""
    on = None
    for n in names:
        same = left[n].eqNullSafe(right[n])
        on = same if on is None else on & same
    return on


def folded(line: Column) -> Column:
    """A line lower-cased, its white space folded and trimmed; the pattern runs only where white space is odd."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\v\f\r":
        odd |= F.contains(line, F.lit(c))
    return F.trim(F.when(odd, F.regexp_replace(F.lower(line), SPACES, " ")).otherwise(F.lower(line)))


def without_lines(text: Column, lines: Column, gone: Column) -> Column:
    """The text without the lines (``lines`` are all of them) at the sorted places ``gone``."""
    cut = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    runs = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda x, i: F.slice(lines, x + 2, F.get(cut, i + 1) - x - 1))
    return F.when(F.size(gone) == 0, text).otherwise(F.array_join(F.flatten(runs), "\n"))
