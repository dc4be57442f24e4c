"""Small builders over text columns that the other function modules share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(pattern: str, ignore_case: bool = False, dotall: bool = False) -> str:
    """Java pattern with the Unicode meaning of ``\\s \\w \\b`` (no-break space is white space)."""
    flags = ("iu" if ignore_case else "") + ("s" if dotall else "")
    if re.search(r"\\[swb]", pattern):
        flags += "U"
    return f"(?{flags}){pattern}" if flags else pattern


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike(rx(pattern, ignore_case))


def not_empty(c: Column) -> Column:
    """Null for an empty text. ``nullif`` works its text out twice where it stands in a branch."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, which a branch otherwise does for each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def folded(c: Column) -> Column:
    """Lower case as case-insensitive patterns see it, which take four more letters for ASCII ones.

    A plain word of such a pattern can only match where this contains it, so a cheap search
    for the word may stand before the pattern.
    """
    for letter, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return F.lower(c)


def group(c: Column, pattern: str, idx: int = 1, ignore_case: bool = False) -> Column:
    """Group of the first match; null when there is no match or the group is empty."""
    return not_empty(F.regexp_extract(c, rx(pattern, ignore_case), idx))


def raw_group(c: Column, pattern: str, idx: int = 1, ignore_case: bool = False) -> Column:
    """Like :func:`group`, but an empty string instead of null."""
    return F.regexp_extract(c, rx(pattern, ignore_case), idx)


def groups(c: Column, pattern: str, idx: int = 1, ignore_case: bool = False) -> Column:
    """Group of every match; an empty string where the group took no part in a match."""
    return F.regexp_extract_all(c, F.lit(rx(pattern, ignore_case)), F.lit(idx))


def replace(c: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(c, rx(pattern, ignore_case), by)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    found = None
    for w in words:
        hit = c.contains(w)
        found = hit if found is None else found | hit
    return found


def first_match(cases: Sequence[tuple[Column, Column]], default=None) -> Column:
    """First case whose condition holds, in order; a null condition does not hold."""
    (cond, value), *rest = cases
    chain = F.when(cond, value)
    for cond, value in rest:
        chain = chain.when(cond, value)
    return chain.otherwise(default)


def first_keyword(c: Column, table: Mapping | Sequence[tuple], default=None) -> Column:
    """Value of the first entry one of whose words is in the text."""
    pairs = table.items() if isinstance(table, Mapping) else table
    cases = []
    for key, value in pairs:
        if isinstance(value, list):  # label -> words
            key, value = value, key
        words = [key] if isinstance(key, str) else key
        cases.append((contains_any(c, words), F.lit(value)))
    return first_match(cases, default)


def sql_literal(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_map(table: Mapping) -> str:
    return "map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in table.items()) + ")"


def sql_struct(fields: Mapping) -> str:
    """``named_struct`` of literals. Maps stay out of it: two equal structs with a map in
    them do not count as the same plan, and shared shuffles would be run twice."""
    return "named_struct(" + ", ".join(f"'{k}', {sql_literal(v)}" for k, v in fields.items()) + ")"


def lookup(key: Column, table: Mapping, default: Column | None = None) -> Column:
    """Value for an exact key."""
    value = F.try_element_at(F.expr(sql_map(table)), key)
    return value if default is None else F.coalesce(value, default)


def prefix_lookup(key: Column, table: Mapping, default=None) -> Column:
    return first_match([(key.startswith(k), F.lit(v)) for k, v in table.items()], default)


def steps(c: Column, table: Sequence[tuple], default) -> Column:
    """Value of the first bound (largest first) that the number reaches."""
    return first_match([(c >= bound, F.lit(float(v))) for bound, v in table], F.lit(float(default)))


def to_long(c: Column) -> Column:
    return c.try_cast("bigint")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def tidy(c: Column) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def strip(c: Column) -> Column:
    """All white space off both ends (``trim`` drops blanks only)."""
    return replace(c, r"^\s+|\s+$", "")


def fold_dotted_i(c: Column) -> Column:
    """Dotted capital and dotless small i to their plain forms."""
    c = F.replace(c, F.lit("İ"), F.lit("I"))
    c = F.replace(c, F.lit("ı"), F.lit("i"))
    return F.replace(c, F.lit("i̇"), F.lit("i"))


def blank(c: Column) -> Column:
    """True for null and empty text."""
    return c.isNull() | (c == "")
