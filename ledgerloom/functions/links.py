"""Links to hubs, code hosts and papers in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import last_segment, strip

# Hosts of each kind, and what a link of the kind holds in its path.
HOSTS = {"hub": ["huggingface.co", "hf.co"], "paper": ["arxiv.org"], "repo": ["github.com"]}
PATHS = {"paper": "abs/|pdf/"}
TAIL = r"[.,;!?)'\"]+$"


def link_fits(url: Column, kind: str) -> Column:
    """Whether a URL is one of the kind; false for null."""
    u = F.lower(strip(F.coalesce(url, F.lit(""))))
    first, *short = HOSTS[kind]
    host = F.contains(u, F.lit(first))
    for s in short:
        host = host | u.startswith(f"{s}/")
    return host & u.rlike(PATHS[kind]) if kind in PATHS else host


def link_in_text(text: Column, kind: str) -> Column:
    """The first link of the kind, full ones before those without a scheme, which get one; null if none fits."""
    forms = [f for scheme in (r"https?://\S*", "") for f in (scheme + h.replace(".", r"\.") + r"/[^\s)\"]+" for h in HOSTS[kind])]

    def found(form: str) -> Column:
        u = F.regexp_replace(F.regexp_extract(text, f"(?i){form}", 0), TAIL, "")
        whole = F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u))
        return F.when((u != "") & link_fits(whole, kind), whole)

    return F.coalesce(*map(found, forms))


def model_name(hub_id: Column, url: Column) -> Column:
    """The last part of an id, else of a URL."""
    return F.coalesce(last_segment(hub_id), last_segment(F.regexp_replace(url, "[?#].*$", "")))
