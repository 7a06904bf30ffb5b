"""Cutting of texts against hand-made expectations, cleaning, and bills with detection, routing and failing models."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import licenses, text
from ledgerloom.operators import routing
from ledgerloom.plans import bom


def cut(lines, size=40, overlap=0, least=1):
    return list(text.split_text("\n".join(lines), size, overlap, least))


def test_cuts_at_headers_and_good_places():
    # 0.7 of 40 characters are there before the second header, so the chunk ends; its header isn't repeated over itself.
    assert cut(["# A", "x" * 30, "## B", "y"]) == ["# A\n" + "x" * 30, "## B\ny"]
    # Too long: after the last sentence or blank line among the last nine, before a header; what follows gets the headers above.
    assert cut(["# A", "One.", "x" * 20, "y" * 20]) == ["# A\nOne.", "# A\n\n" + "x" * 20 + "\n" + "y" * 20]
    assert cut(["a" * 10, "", "b" * 20, "c" * 20]) == ["a" * 10 + "\n", "b" * 20 + "\n" + "c" * 20]
    # Nowhere good: after four fifths of the lines; a single long line stays alone.
    assert cut(["a" * 12] * 4, 44) == ["\n".join(["a" * 12] * 3), "a" * 12]
    assert cut(["a" * 90]) == ["a" * 90]
    assert cut([]) == [] and cut(["short"], least=6) == []


def test_overlap_and_context():
    lines = ["s" * 9 + "." for _ in range(4)] + ["t" * 9 for _ in range(4)]
    chunks = cut(lines, 60, 15)
    assert chunks[0] == "\n".join(["s" * 9 + "."] * 4) and chunks[1].startswith("s" * 9 + ".")
    deep = cut(["# A", "## B", "### C", "One.", "x" * 30, "Two.", "y" * 30], 45)
    assert all(c.startswith(("# A", "## B\n### C\n\n")) for c in deep)


def test_short_texts_have_no_chunks(spark):
    rows = spark.createDataFrame([("a", "hub", "x" * 50), ("b", "hub", None), ("c", "hub", "word " * 100)], "artifact_id string, source string, text string")
    assert {r.artifact_id for r in text.chunks(rows).collect()} == {"c"}


def test_pdf_lines(spark):
    x = "Title  here\n12\nab\n\n\n\n\n1 2 3\nkept † line 7"
    assert spark.createDataFrame([(x,)], "t string").select(text.pdf_lines(F.col("t"))).first()[0] == "Title here\n\n\nkept  line 7"


def test_documented_report(spark):
    """A report in the documented form: every pair label, in bold, with leading space."""
    said = "**CLAIM_A:** MIT\n**CLAIM_B:** Apache-2.0\n**CONFLICT_WITHIN_A:** No\n**CONFLICT_WITHIN_B:** No\n **CONFLICT_A_VS_B:** Yes: MIT against Apache-2.0"
    rows = spark.createDataFrame([("a", "f", said, [("A", "hub"), ("B", "repo")], ["hub", "repo"])], "artifact_id string, field string, text string, letters array<struct<letter:string,source:string>>, priority array<string>")
    r = routing.select_sources(routing.parse_report(rows)).first()
    assert r.external[0].description == "MIT against Apache-2.0" and r.chosen == ["hub"]


def test_licence_similarity(spark):
    pairs = [("MIT", "mit license", 1.0), ("", "MIT", 0.0), (None, None, 0.0), ("own terms 1", "own terms 2", 20 / 22)]
    out = spark.createDataFrame(pairs, "a string, b string, want double").select(licenses.license_similarity(F.col("a"), F.col("b")).alias("s"), "want").collect()
    assert all(r.s == pytest.approx(r.want) for r in out)


def test_retries_and_fewer_chunks():
    calls, waits = [], []

    def busy(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("Error 400: Provider returned error")
        return x

    assert bom.retried(busy, 5, sleep=waits.append) == 5 and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        bom.retried(lambda: (_ for _ in ()).throw(ValueError("bad key")))

    def limited(question, texts, sources):
        if len(texts) > 6:
            raise ValueError("maximum context length")
        return f"{len(texts)}", "hub"

    assert bom.answered(limited, "q", ["t"] * 9, ["hub"] * 9) == ("6", "hub")
    assert bom.answered(lambda *a: (_ for _ in ()).throw(ValueError("too long")), "q", ["t"], ["hub"]) == ("noAssertion", None)


def test_inferred_fields_follow_the_audit(spark):
    """Of three sources two agree; with chunks enough the third's are left out, and the conflict is recorded."""
    texts = [("m", s, i, f"license: {v}" + " words" * i, [1.0, float(i)]) for s, v in (("hub", "GPL"), ("paper", "MIT"), ("repo", "mit")) for i in range(3)]
    chunks = spark.createDataFrame(texts, "artifact_id string, source string, chunk_index int, text string, embedding array<float>")
    q = spark.createDataFrame([("m", "license", "what is the license", [1.0, 0.0], ["license:"], "normalize_license")], "artifact_id string, field string, question string, embedding array<float>, terms array<string>, post_process string")
    order = spark.createDataFrame([("license", "hub", 0), ("license", "paper", 1), ("license", "repo", 2)], "field string, source string, ord int")
    r = bom.inferred_fields(q, chunks, order, detector=lambda question, groups: "\n".join(f"CLAIM_{a}: {t[0].split()[1]}" for a, t in groups) + "\nCONFLICT_A_VS_B: Yes: GPL or MIT\nCONFLICT_A_VS_C: Yes: GPL or mit\nCONFLICT_B_VS_C: No").first()
    assert r.source in ("paper", "repo") and r.value.startswith("MIT") or r.value.lower().startswith("mit")
    assert r.conflict.external == "Yes: GPL or MIT; GPL or mit" and r.trace.selected == ["paper", "repo"] and r.trace.claims["hub"] == "GPL"


def test_calls_run_side_by_side_in_order_and_share_pauses():
    import threading
    import time

    running, most, lock = 0, 0, threading.Lock()

    def call(i, pause):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.02 * (5 - i % 5))
        with lock:
            running -= 1
        return i

    taken = []
    rows = ((taken.append(i) or i,) for i in range(23))
    found = bom.in_order(call, rows)
    assert next(found) == 0 and len(taken) <= bom.CALLS + 1
    assert list(found) == list(range(1, 23)) and 1 < most <= bom.CALLS
    for said in ("Provider returned error", "[Errno 32] Broken pipe", "read ECONNRESET", "ECONNREFUSED", "(104, 'reset')", "Protocol error", "RemoteDisconnected"):
        tries, waits = [], []

        def busy(said=said, tries=tries):
            tries.append(1)
            if len(tries) < 3:
                raise OSError(said)
            return "done"

        assert bom.retried(busy, sleep=waits.append) == "done" and waits == [2.0, 4.0]
    for said in ("429 rate limit", "timed out", "bad key"):
        with pytest.raises(ValueError):
            bom.retried(lambda said=said: (_ for _ in ()).throw(ValueError(said)), sleep=None)
    now = [0.0]
    pause = bom.Pause(sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0])
    calls = []

    def flaky(x):
        calls.append((x, now[0]))
        if len(calls) == 1:
            raise OSError("broken pipe")
        return x

    assert bom.retried(flaky, 1, pause=pause) == 1 and bom.retried(flaky, 2, pause=pause) == 2
    assert calls == [(1, 0.0), (1, 2.0), (2, 2.0)]
    with pytest.raises(ValueError):
        list(bom.in_order(lambda i, p: (_ for _ in ()).throw(ValueError("x")), ((i,) for i in range(3))))


def test_values_on_the_next_line(spark):
    said = "CLAIM_A:\n\n  MIT \nCLAIM_B: Apache-2.0\nCONFLICT_A_VS_B:\nYes: they differ\nCONFLICT_WITHIN_A: No\nCONFLICT_WITHIN_B:"
    r = spark.createDataFrame([(said,)], "t string").select(routing.report_lines(F.col("t")).alias("m")).first().m
    assert r == {"CLAIM_A": "MIT", "CLAIM_B": "Apache-2.0", "CONFLICT_A_VS_B": "Yes: they differ", "CONFLICT_WITHIN_A": "No"}


def test_direct_answers_are_taken_apart_at_one_marker(spark):
    said = {"a": "ANSWER: MIT CONFLICT_STATUS: No conflicts detected", "b": "MIT CONFLICT_STATUS: hub: MIT, repo: GPL", "c": "x CONFLICT_STATUS: y CONFLICT_STATUS: z", "d": "ANSWER: kept", "e": " ANSWER:  two words  CONFLICT_STATUS: No"}
    texts = spark.createDataFrame([(a, "hub", a + " " + "w" * 60) for a in said], "artifact_id string, source string, text string")
    q = spark.createDataFrame([(a, "license", "q") for a in said], "artifact_id string, field string, question string")
    order = spark.createDataFrame([("license", "hub", 0)], "field string, source string, ord int")
    out = {r.artifact_id: (r.value, r.conflict and (r.conflict.value, r.conflict.source)) for r in bom.direct_answers(texts, q, order, lambda question, t, s: said[t[0][0]]).collect()}
    assert out == {"a": ("MIT", None), "b": ("MIT", ("MIT, GPL", "hub, repo")), "c": (said["c"], None), "d": (said["d"], None), "e": ("two words", None)}
    from ledgerloom.functions.scalars import map_entries, truncated

    one = spark.range(1).select(truncated(F.lit("x" * 1300), 1200).alias("cut"), map_entries(F.create_map(*map(F.lit, ("key", "lr", "value", "1")))).alias("told"), map_entries(F.create_map(*map(F.lit, ("a", "1", "b", "", "", "c")))).alias("some")).first()
    assert one.cut == "x" * 1200 + "\n\n[... Content truncated at 1,200 characters ...]"
    assert [(e.key, e.value) for e in one.told] == [("lr", "1")] and [(e.key, e.value) for e in one.some] == [("a", "1")]


def test_bills_keep_answers_and_traces_and_ask_once(spark, tmp_path):
    """Also where exchanges aren't reused."""
    from ledgerloom.operators import fields

    log = tmp_path / "asked"

    def detector(question, groups):
        with open(log, "a") as f:
            f.write("x\n")
        return "\n".join(f"CLAIM_{a}: {t[0].split()[1]}" for a, t in groups) + "\nCONFLICT_A_VS_B: Yes: GPL or MIT\nCONFLICT_B_VS_C: No\nCONFLICT_A_VS_C: Yes: GPL or mit"

    texts = [(m, s, i, f"license: {v} License" + " words" * i, [1.0, float(i)]) for m in ("m", "n") for s, v in (("hub", "GPL"), ("paper", "MIT"), ("repo", "MIT")) for i in range(3)]
    chunks = spark.createDataFrame(texts, "artifact_id string, source string, chunk_index int, text string, embedding array<float>")
    q = spark.createDataFrame([(m, "license", "what is the license", [1.0, 0.0], ["license:"], "normalize_license") for m in ("m", "n")], "artifact_id string, field string, question string, embedding array<float>, terms array<string>, post_process string")
    order = spark.createDataFrame([("license", "hub", 0), ("license", "paper", 1), ("license", "repo", 2)], "field string, source string, ord int")
    claims = spark.createDataFrame([("m", "suppliedBy", "hub", 0, "Org")], "artifact_id string, field string, source string, ord int, value string")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        out = bom.build(claims, "ai", questions=q, chunks=chunks, source_order=order, detector=detector)
        by = {(r.artifact_id, r.field): r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert log.read_text().count("x") == 2
    r = by["m", "license"]
    assert (r.value, r.raw_answer) == ("MIT", "MIT License") and r.trace.selected == ["paper", "repo"] and r.trace.claims == {"hub": "GPL", "paper": "MIT", "repo": "MIT"}
    assert by["m", "suppliedBy"].trace is None and by["m", "suppliedBy"].raw_answer is None
    w = {x.artifact_id: x for x in fields.wide(out, ["license", "suppliedBy"]).collect()}["m"]
    assert w.license_raw_answer == "MIT License" and w.license_selected_sources == ["paper", "repo"] and w.license_claims["hub"] == "GPL" and w.license_internal_conflicts == {} and len(w.license_external_conflicts) == 2 and w.suppliedBy_claims is None
    import json

    d = json.loads({x.artifact_id: x.json for x in fields.documents(out).collect()}["m"])
    assert d["direct"]["suppliedBy"] == {"value": "Org", "source": "hub", "conflict": None}
    assert d["inferred"]["license"]["trace"]["selected"] == ["paper", "repo"] and d["inferred"]["license"]["raw_answer"] == "MIT License"
