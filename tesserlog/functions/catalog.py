"""Event catalogue: templates to regular expressions to one CASE expression."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "E_UNKNOWN"
_MARK = re.compile(r"(<\*>|<BLOCK>|<IP>|<NUM>)")


def template_regex(template: str) -> str:
    """Wildcards match anything, <BLOCK> a block id; the rest is literal and blanks match any blanks."""
    out = ""
    for piece in _MARK.split(template.strip().replace("[*]", "<*>")):
        if piece == "<BLOCK>":
            out += r"blk_-?\d+"
        elif _MARK.fullmatch(piece):
            out += ".*?"
        else:
            out += re.sub(r"\s+", lambda _: r"\s+", re.sub(r"([^\w\s])", r"\\\1", piece))
    return out


def compile_catalog(templates: Iterable[tuple[str, str]], order: str = "length") -> list[tuple[str, str, str]]:
    """(event id, template, regex); longest template first, or in catalogue order. Invalid expressions are left out."""
    found = []
    for event_id, template in templates:
        if event_id and template:
            pattern = template_regex(template)
            try:
                re.compile(pattern)
            except re.error:
                continue
            found.append((event_id.strip(), template.strip(), pattern))
    return sorted(found, key=lambda x: -len(x[1])) if order == "length" else found


def _literal(template: str) -> str:
    """The longest literal word, a cheap test before the regular expression."""
    words = [w for piece in _MARK.split(template.replace("[*]", "<*>")) if not _MARK.fullmatch(piece) for w in piece.split()]
    return max(words, key=len, default="").lower()


def match_event(content: Column, catalog: list[tuple[str, str, str]]) -> Column:
    """The first event whose expression is found, ignoring case; E_UNKNOWN for none or null."""
    case, low = None, F.lower(content)
    for event_id, template, pattern in catalog:
        hit = content.rlike(f"(?i){pattern}")
        if word := _literal(template):
            hit = F.contains(low, F.lit(word)) & hit
        case = F.when(hit, event_id) if case is None else case.when(hit, event_id)
    return F.lit(UNKNOWN) if case is None else case.otherwise(UNKNOWN)


def load_catalog(table: DataFrame) -> list[tuple[str, str]]:
    """(event id, template) from a catalogue table, whose columns are found by name. A catalogue is small by nature."""
    lower = {c.lower(): c for c in table.columns}
    ids = next(c for k, c in lower.items() if "eventid" in k or k == "id")
    text = next(c for k, c in lower.items() if "template" in k)
    rows = table.select(F.trim(ids).alias("i"), F.trim(text).alias("t")).where("i <> '' and t <> ''")
    return [(r["i"], r["t"]) for r in rows.toLocalIterator()]


def learned_catalog(table: DataFrame) -> list[tuple[str, str]]:
    """Learned templates, named D1, D2, ... in order of cluster."""
    rows = table.where("template is not null").orderBy(F.desc("size"), "template").select("template")
    return [(f"D{i + 1}", r["template"]) for i, r in enumerate(rows.toLocalIterator())]
