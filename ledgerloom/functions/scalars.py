"""Scalar functions: Column to Column, without Python workers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SIZE_UNITS = {
    "": 1, "b": 1, "byte": 1, "bytes": 1, "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12, "p": 10**15, "pb": 10**15,
    "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50,
}
PURPOSES = [
    "application", "archive", "bom", "configuration", "container", "data", "device", "deviceDriver", "diskImage", "documentation", "evidence", "executable", "file", "filesystemImage",
    "firmware", "framework", "install", "library", "manifest", "model", "module", "operatingSystem", "other", "patch", "platform", "requirement", "source", "specification", "test",
]
PRESENCE = ["yes", "no", "noAssertion"]
SAFETY = ["low", "medium", "high", "serious"]
AVAILABILITY = ["clickthrough", "directDownload", "query", "registration", "scrapingScript"]
CONFIDENTIALITY = ["amber", "clear", "green", "red"]
DATASET_TYPES = ["audio", "categorical", "graph", "image", "noAssertion", "numeric", "other", "sensor", "structured", "syntactic", "text", "timeseries", "timestamp", "video"]
ENUM_ALIASES = {"none": "noAssertion", "unknown": "noAssertion", "no assertion": "noAssertion", "true": "yes", "false": "no"}
PLACEHOLDERS = ["unknown", "none", "n/a", "noassertion", "not found", "not found."]
#: Date formats; single letters take one or two digits.
DATE_FORMATS = [
    "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s.[SSSSSS][SSS]", "yyyy-M-d H:m:s.[SSSSSS][SSS]", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "yyyy-M", "yyyy",
]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes spaces alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def missing_to_null(c: Column) -> Column:
    """'' means missing; ' ' doesn't."""
    return F.nullif(c, F.lit(""))


def literal_map(d: Mapping[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def normalize_default(c: Column) -> Column:
    return F.lower(strip(c))


def normalize_url(c: Column) -> Column:
    """Scheme and host in lower case, no ``www.``, fragment or trailing slash; path case and query stay. Null gives ''."""
    parts = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#[\s\S]*)?$"
    u = strip(F.coalesce(c, F.lit("")))
    scheme, host, path, query = (F.regexp_extract(u, parts, i) for i in (1, 2, 3, 4))
    host = F.regexp_replace(F.lower(host), r"^www\.", "")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    return F.concat(F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path, F.when(query != "?", query).otherwise(""))


def normalize_version(c: Column) -> Column:
    """Without a leading v and build metadata, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "^[vV]", ""), r"\+[0-9A-Za-z.-]+$", ""))


def normalize_org(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    own = normalize_default(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(literal_map(aliases), own), own) if aliases else own


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def parse_date(c: Column) -> Column:
    """A timestamp in UTC (the session's time zone must be UTC) from one of the known formats; an offset is applied. Else null."""
    v = strip(c)
    zoned = v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(Z|[+-]\d{2}:?\d{2})$")
    offset = F.regexp_replace(F.regexp_replace(v, "Z$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    naive = F.when(v.rlike(r"^[0-9T:./ -]+$"), v)
    return F.coalesce(F.when(zoned, F.try_to_timestamp(offset, F.lit("yyyy-M-d'T'H:m:sXXX"))), *(F.try_to_timestamp(naive, F.lit(f)) for f in DATE_FORMATS))


def split_list(c: Column) -> Column:
    """Parts between ; , and line feeds, stripped; the value itself if nothing remains; no parts of a missing value."""
    parts = F.filter(F.transform(F.split(c, r"[;,\n]+"), strip), lambda x: x != "")
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(c)).otherwise(parts)


def distinct_ignoring_case(a: Column) -> Column:
    """The first spelling of each entry, in order."""
    lowered = F.transform(a, lambda x: F.lower(x))
    return F.filter(a, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def named_entities(c: Column) -> Column:
    """Names of a list in text: bullets and placeholders dropped, first spelling kept."""
    bare = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;\n]+"), lambda x: strip(F.regexp_replace(strip(x), r"^[-*•]\s*", "")))
    return distinct_ignoring_case(F.filter(bare, lambda x: (x != "") & ~F.lower(x).isin(PLACEHOLDERS)))


def normalize_enum(c: Column, values: Sequence[str], default: str | None) -> Column:
    """One of the values, whatever its case or alias, else the default."""
    own = strip(c)
    known = literal_map({v.lower(): v for v in values})
    alias = {a: v for a, v in ENUM_ALIASES.items() if v in values}
    by_alias = F.try_element_at(literal_map(alias), F.lower(own)) if alias else F.lit(None).cast("string")
    return F.coalesce(by_alias, F.try_element_at(known, F.lower(own)), F.lit(default).cast("string"))


def normalize_enum_list(c: Column, values: Sequence[str], default: str) -> Column:
    found = F.array_distinct(F.transform(split_list(c), lambda x: normalize_enum(x, values, default)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def normalize_timestamp(c: Column, default: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ from itself or a plain date, else the default."""
    v = strip(c)
    return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), v).when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(v, F.lit("T00:00:00Z"))).otherwise(default)


def size_to_bytes(c: Column) -> Column:
    """Whole bytes of a number with an optional SI or IEC unit; null for anything else and for less than one byte."""
    form = r"^\s*([0-9][0-9_,]*(?:\.[0-9]+)?)\s*([a-zA-Z]*)\s*$"
    number = F.regexp_replace(F.regexp_extract(c, form, 1), "[_,]", "").try_cast("double")
    unit = F.try_element_at(literal_map(SIZE_UNITS), F.lower(F.regexp_extract(c, form, 2))).cast("double")
    whole = F.floor(number * unit)
    return F.when(whole > 0, whole.cast("long"))


def dictionary_entries(c: Column) -> Column:
    """Key-value entries value1, value2, ... of a list in text."""
    return F.transform(split_list(c), lambda x, i: F.struct(F.lit("DictionaryEntry").alias("type"), F.concat(F.lit("value"), (i + 1).cast("string")).alias("key"), x.alias("value")))


def slug(c: Column, default: str = "related-artifact") -> Column:
    own = F.btrim(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9_.-]+", "-"), F.lit("-"))
    return F.when(own == "", F.lit(default)).otherwise(own)


def artifact_key(hub_id: Column, url: Column, otherwise: Column | None = None) -> Column:
    """A file-safe id: the hub id, else the last two parts of a URL, else what is given (a dated name, say)."""
    parts = F.filter(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), lambda x: x != "")
    last = F.array_join(F.slice(parts, -2, 2), "_")
    found = F.coalesce(missing_to_null(hub_id), F.when(F.size(parts) >= 2, last))
    return F.translate(found if otherwise is None else F.coalesce(found, otherwise), "/ ", "__")


def dataset_key(hub_url: Column, repository_url: Column, otherwise: Column | None = None) -> Column:
    """A file-safe id of a dataset: its hub id, else its repository's path."""
    found = F.coalesce(hub_id(hub_url), repository_path(repository_url))
    return F.translate(found if otherwise is None else F.coalesce(found, otherwise), "/", "_")


def clean_number(c: Column) -> Column:
    """Null for what is not a number."""
    return F.when(~F.isnan(c), c)


def rendered(template: Column, values: Mapping[str, Column]) -> Column:
    """A template with each {name} replaced as it stands; nulls give ''."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def named_in_list(items: Column) -> Column:
    """``named_entities`` of a list's entries."""
    return named_entities(F.array_join(items, "\n"))


def named_in_map(values: Column) -> Column:
    """``named_entities`` of a map's values, in the order of its keys."""
    return named_in_list(F.transform(F.array_sort(F.map_entries(values)), lambda e: e["value"]))


def map_entries(values: Column) -> Column:
    """Key-value entries of a map, in the order of its keys; of a map that has a ``key``, the one entry that it tells.

    Entries without a key or value are left out; the one entry may lack its value.
    """
    entry = lambda k, v: F.struct(F.lit("DictionaryEntry").alias("type"), k.alias("key"), v.alias("value"))
    several = F.transform(F.filter(F.array_sort(F.map_entries(values)), lambda e: (e["key"] != "") & (e["value"] != "")), lambda e: entry(e["key"], e["value"]))
    key = strip(F.coalesce(F.try_element_at(values, F.lit("key")), F.lit("")))
    told = F.filter(F.array(entry(key, missing_to_null(F.try_element_at(values, F.lit("value"))))), lambda e: e["key"] != "")
    return F.when(F.map_contains_key(values, F.lit("key")), told).otherwise(several)


def path_segments(url: Column) -> Column:
    path = F.regexp_extract(strip(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def repository_path(url: Column) -> Column:
    """owner/name from a code host's URL; null if its path is shorter."""
    s = path_segments(url)
    return F.when(F.size(s) >= 2, F.array_join(F.slice(s, 1, 2), "/"))


def hub_id(url: Column) -> Column:
    """org/name from a hub's URL, of a dataset after ``datasets``; null if there are no two parts."""
    s = path_segments(url)
    at = F.array_position(s, "datasets")
    after = F.slice(s, (at + 1).cast("int"), F.lit(2))
    return F.when((at > 0) & (F.size(s) >= at + 2), F.array_join(after, "/")).when((at == 0) & (F.size(s) >= 2), F.array_join(F.slice(s, 1, 2), "/"))


def last_segment(c: Column) -> Column:
    return F.try_element_at(F.filter(F.split(c, "/"), lambda x: x != ""), F.lit(-1))


def token_estimate(c: Column) -> Column:
    return (F.length(c) / F.lit(3.5)).cast("int")


def truncated(c: Column, n: int, marker: str = "\n\n[... Content truncated at {:,} characters ...]") -> Column:
    """The first n characters and a marker that names the limit; shorter texts as they are."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker.format(n)))).otherwise(c)


def json_envelope(c: Column) -> Column:
    """A JSON object inside a fenced block, or from the first { to the last }."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(missing_to_null(fenced), missing_to_null(F.regexp_extract(c, r"(?s)(\{.*\})", 1)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' token sets; both empty 1, one empty 0."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[;,\s]+"), lambda t: t != "")) for c in (a, b))
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))


#: What a rule may name as normaliser of compared values.
NORMALISERS: dict[str, Callable[[Column], Column]] = {"default": normalize_default, "url": normalize_url, "version": normalize_version, "org": normalize_org}
