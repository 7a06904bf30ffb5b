import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import licenses as li
from ledgerloom.functions import links as ln
from ledgerloom.functions import scalars as fn
from ledgerloom.functions import text as tx


def run(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (fn.normalize_url, {"HTTPS://WWW.Host.co/M/X/": "https://host.co/M/X", "https://h.co/a?b=C#d": "https://h.co/a?b=C", "https://h.co/": "https://h.co/", "h.co/m": "h.co/m", "": "", None: ""}),
        (fn.normalize_version, {"v1.2.3": "1.2.3", "1.2.3+sha.abc": "1.2.3", "1.2.3-RC1": "1.2.3-rc1", None: ""}),
        (fn.normalize_org, {" Meta\t": "meta", None: ""}),
        (fn.size_to_bytes, {"12345": 12345, "1,234,567": 1234567, "1_234_567": 1234567, "1 KB": 1000, "1.5 GB": 1_500_000_000, "1 KiB": 1024, "5T": 5 * 10**12, "10000 examples": None, "1.5 million tokens": None, "": None, "x": None, "-500 MB": None, "0": None, "0 KB": None, "0.5": None, "1024.5": 1024, None: None}),
        (lambda c: F.array_join(fn.named_entities(c), "|"), {"squad, MMLU; squad": "squad|MMLU", "- a\n* B, N/A, unknown, A": "a|B", None: "", "not found.": ""}),
        (lambda c: fn.normalize_enum(c, fn.PURPOSES, "other"), {"MODEL": "model", "devicedriver": "deviceDriver", "unknown": "other", None: "other"}),
        (lambda c: fn.normalize_enum(c, fn.PRESENCE, "noAssertion"), {"True": "yes", "false": "no", "No Assertion": "noAssertion", "maybe": "noAssertion"}),
        (lambda c: fn.normalize_timestamp(c, F.lit("x")), {"2024-05-06": "2024-05-06T00:00:00Z", "2024-05-06T01:02:03Z": "2024-05-06T01:02:03Z", "May": "x", None: "x"}),
        (lambda c: F.array_join(fn.split_list(c), "|"), {"a; b,\nc": "a|b|c", ";": ";", "": "", None: ""}),
        (li.normalize_license, {"mit license": "MIT", "Apache 2.0": "Apache-2.0", "GPLv3": "GPL-3.0", "ISC License": "ISC", "BSD License": "BSD-3-Clause", "Own": "own", None: ""}),
        (li.license_in_text, {"It is licensed under the MIT license.": "MIT", "released under MIT;": "MIT", "text\nlicense: GPL v3\nmore": "GPL v3", "## License\n\nUnlicense": "Unlicense", "no statement": None, None: None}),
        (fn.repository_path, {"https://g.co/own/repo/tree/x": "own/repo", "https://g.co": None, "": None}),
        (fn.hub_id, {"https://h.co/datasets/org/data/blob/main/x": "org/data", "https://h.co/org/model": "org/model", "https://h.co/datasets/squad": None, None: None}),
        (fn.slug, {"a b/c": "a-b-c", " -- ": "related-artifact", None: "related-artifact"}),
        (fn.last_segment, {"org/name": "name", "x": "x", "": None}),
        (fn.collapse_whitespace, {" a\t\nb  c ": "a b c", None: ""}),
        (fn.json_envelope, {'say\n```json\n{"a": 1}\n```': '{"a": 1}', 'x {"b": 2} y': '{"b": 2}', "none": None}),
        (tx.useful, {None: False, "": False, " \n ": False, "abc": False, "# Title\n## Two": False, "-----": False, "```python": False, "| --- | --- |": False, "License: MIT": True, "# T\nprose": True, "---\nlicense: mit\n---": True, "| a | b |": True, "日本語テキスト": True}),
    ],
)
def test_scalars(spark, f, cases):
    assert run(spark, f, cases) == list(cases.values())


def test_dates(spark):
    same = ["2024-08-15T10:20:30Z", "2024-08-15T12:20:30+02:00", "2024-08-15T12:20:30+0200", "2024-08-15T10:20:30", "2024-08-15 10:20:30", "2024/8/15 10:20:30", " 2024-8-15 10:20:30.000 "]
    got = run(spark, lambda c: F.date_format(fn.parse_date(c), "yyyy-MM-dd HH:mm:ss"), same)
    assert set(got) == {"2024-08-15 10:20:30"}
    days = {"2024-08-15": "2024-08-15", "15-8-2024": "2024-08-15", "15/08/2024": "2024-08-15", "2024/8/15": "2024-08-15", "2024-08": "2024-08-01", "2024": "2024-01-01", "15.8.2024": None, "soon": None, "": None, None: None}
    assert run(spark, lambda c: F.date_format(fn.parse_date(c), "yyyy-MM-dd"), days) == list(days.values())


def test_jaccard(spark):
    rows = [("a b", "b, A", 1.0), ("a", "b", 0.0), ("a;b c", "a b d", 0.5), ("", None, 1.0), ("a", "", 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, want double")
    assert df.where(fn.jaccard(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_chunks_keep_headers_and_overlap():
    assert list(tx.split_text("")) == [] and list(tx.split_text("short")) == []
    long_line = "x" * 3000
    assert list(tx.split_text(long_line)) == [] or list(tx.split_text(long_line)) == [long_line]
    body = "\n".join(f"Sentence number {i} says something of some length here." for i in range(80))
    text = f"# Top\n## Middle\n{body}\n### Deep\n{body}"
    made = list(tx.split_text(text))
    assert all(len(c) < 1700 for c in made) and made[0].startswith("# Top")
    assert any(c.startswith("# Top\n## Middle\n\nSentence") for c in made)
    assert any("### Deep" in c.split("\n")[:3] for c in made)
    assert all(any(line in c for c in made) for line in body.split("\n"))


def test_chunk_table(spark):
    rows = [("a", "hub", "word " * 800), ("a", "repo", "tiny"), ("b", "hub", None)]
    out = tx.chunks(spark.createDataFrame(rows, "artifact_id string, source string, text string")).collect()
    assert {r.source for r in out} <= {"hub"} and all(r.chunk_size == len(r.text) for r in out)


@pytest.mark.parametrize(
    ("kind", "cases"),
    [
        ("hub", {"see https://huggingface.co/org/m).": "https://huggingface.co/org/m", "at hf.co/org/m, or": None, "none": None, None: None}),
        ("paper", {"arxiv.org/abs/1234.5678.": "https://arxiv.org/abs/1234.5678", "https://arxiv.org/list": None}),
        ("repo", {"github.com/a/b and https://github.com/c/d": "https://github.com/c/d", "git": None}),
    ],
)
def test_links(spark, kind, cases):
    assert run(spark, lambda c: ln.link_in_text(c, kind), cases) == list(cases.values())
    assert run(spark, lambda c: ln.model_name(c, F.lit("https://h.co/a/b?x")), ["org/m", None]) == ["m", "b"]
