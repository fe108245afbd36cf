"""File masks and keyword lists as Column predicates.

The rules are our own: masks are matched without regard to case and against the whole name; *.* and *
match every name. Easy shapes become equality, startswith, endswith or contains, which Parquet can
push down or at least evaluate without a regex.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

_SPECIAL = re.compile(r"[*?]")


def split_masks(text: str) -> list[str]:
    return [m.strip() for m in text.split(";") if m.strip()]


def glob_regex(mask: str) -> str:
    """An anchored regex, in the syntax that Java and Python share."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in mask) + "$"


def one_mask(name: Column, mask: str) -> Column:
    """name (lower-cased already) against one lower-case mask."""
    if mask in ("*", "*.*"):
        return name.isNotNull()
    inner = mask.strip("*")
    if not _SPECIAL.search(mask):
        return name == mask
    if _SPECIAL.search(inner) or not inner:
        return name.rlike(glob_regex(mask))
    if mask == "*" + inner:
        return name.endswith(inner)
    if mask == inner + "*":
        return name.startswith(inner)
    return name.contains(inner)


def mask_predicate(name: Column, text: str, as_wildcard: bool = True) -> Column:
    """name matches one of the ;-separated masks.

    as_wildcard takes a text without * and ? as a substring; a text that has one is always taken as typed.
    """
    masks = split_masks(text)
    if not masks:
        raise ValueError("The file mask is empty.")
    low = F.lower(name)
    if as_wildcard and not _SPECIAL.search(text):
        masks = [f"*{m}*" for m in masks]
    return reduce(Column.__or__, (one_mask(low, m.lower()) for m in masks))


def keyword_list(keywords: Column) -> Column:
    """The ;-separated keywords, trimmed, without empty ones; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(keywords, F.lit("")), ";"), F.trim), lambda k: k != "")


def keyword_predicate(keywords: Column, wanted: str, all_needed: bool = False, case_sensitive: bool = False, as_wildcard: bool = True) -> Column:
    """One (or all) of the wanted keywords is among the item's: as a part or a glob of one, or equal to one."""
    asked = split_masks(wanted)
    if not asked:
        return F.lit(True)
    own = keyword_list(keywords)
    if not case_sensitive:
        own, asked = F.transform(own, F.lower), [k.lower() for k in asked]

    def found(k: str) -> Column:
        if not as_wildcard:
            return F.array_contains(own, k)
        if _SPECIAL.search(k):
            return F.exists(own, lambda x: x.rlike(glob_regex(k)))
        return F.exists(own, lambda x: x.contains(F.lit(k)))

    return reduce(Column.__and__ if all_needed else Column.__or__, map(found, asked))
