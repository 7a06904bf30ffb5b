"""Licences: names, and statements in free text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .scalars import literal_map, normalize_default, strip

# Spellings of each licence, in lower case.
SPELLINGS = {
    "MIT": ["mit", "mit license", "the mit license"],
    "Apache-2.0": ["apache-2.0", "apache 2.0", "apache license 2.0", "apache license, version 2.0", "apache2", "apache v2"],
    "GPL-2.0": ["gpl-2.0", "gpl-2.0-only", "gpl v2", "gplv2", "gnu general public license v2", "gnu general public license version 2"],
    "GPL-3.0": ["gpl-3.0", "gpl-3.0-only", "gpl v3", "gplv3", "gnu general public license v3", "gnu general public license version 3"],
    "AGPL-3.0": ["agpl-3.0", "agpl v3", "agplv3", "gnu affero general public license v3"],
    "LGPL-2.1": ["lgpl-2.1", "lgpl v2.1"],
    "LGPL-3.0": ["lgpl-3.0", "lgpl v3"],
    "BSD-2-Clause": ["bsd-2-clause", "bsd 2-clause", "simplified bsd"],
    "BSD-3-Clause": ["bsd-3-clause", "bsd 3-clause", "new bsd", "bsd"],
    "CC-BY-4.0": ["cc-by-4.0", "cc by 4.0", "creative commons attribution 4.0"],
    "CC-BY-SA-4.0": ["cc-by-sa-4.0"],
    "CC-BY-NC-4.0": ["cc-by-nc-4.0"],
    "CC-BY-NC-SA-4.0": ["cc-by-nc-sa-4.0"],
    "CC0-1.0": ["cc0-1.0", "cc0", "public domain"],
    "Unlicense": ["unlicense", "the unlicense"],
    "ISC": ["isc", "isc license"],
    "MPL-2.0": ["mpl-2.0", "mozilla public license 2.0"],
    "OpenRAIL": ["openrail"],
    "OpenRAIL++": ["openrail++"],
    "Llama-2": ["llama 2", "llama2"],
    "Gemma": ["gemma"],
    "other": ["other"],
    "proprietary": ["proprietary"],
}
# Statements, the most telling first; the first group is the licence.
STATEMENTS = [
    r"(?i)licensed\s+under\s+(?:the\s+)?([A-Za-z0-9][^.\n,;(]{2,60}?)(?:\s+license)?[.\n,;]",
    r"(?i)released\s+under\s+(?:the\s+)?([A-Za-z0-9][^.\n,;(]{2,60}?)(?:\s+license)?[.\n,;]",
    r"(?i)distributed\s+under\s+(?:the\s+)?([A-Za-z0-9][^.\n,;(]{2,60}?)(?:\s+license)?(?:[.\n,;]|\z)",
    r"(?im)^[-*\s]*license\s*[:\-]\s*([A-Za-z0-9][^\n,;(]{1,60})",
    r"(?i)##\s*license\s*\n+\s*([A-Za-z0-9][^\n]{1,60})",
    r"(?i)(?:^|\n)\s*(MIT License|Apache License[\s,]*2\.0|GNU (?:General|Affero|Lesser) Public License[\s\w.]*|BSD[\s\-\w]*License|Creative Commons[^\n,;]{2,50}|Unlicense|ISC License|Mozilla Public License[\s\w]*)",
]

ALIASES = {s: name for name, spellings in SPELLINGS.items() for s in spellings}


def normalize_license(c: Column) -> Column:
    """The licence's usual name, with or without a last word ``license``, else the text in lower case; null gives ''."""
    own = normalize_default(F.coalesce(c, F.lit("")))
    names = literal_map(ALIASES)
    return F.coalesce(F.try_element_at(names, own), F.try_element_at(names, strip(F.regexp_replace(own, r"\s+license$", ""))), own)


def license_in_text(c: Column) -> Column:
    """The first statement whose licence has 3 to 80 characters; null if there is none."""

    def found(pattern: str) -> Column:
        x = strip(F.regexp_extract(c, pattern, 1))
        return F.when(F.length(x).between(3, 80), x)

    return F.coalesce(*map(found, STATEMENTS))


def license_similarity(a: Column, b: Column) -> Column:
    """1 if both are the same licence, 0 if one is missing, else the share of characters in matching blocks of their names."""
    x, y = normalize_license(a), normalize_license(b)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(_matching(x, y))


@F.pandas_udf(DoubleType())
def _matching(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)
