"""The Merkle manifest against a tree built node by node, for trees of many shapes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle
from ledgerloom.llm.common import crc_mod


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def climb(tree, at, own, proof):
    for level in tree[:-1]:
        run = range(at // 3 * 3, min(at // 3 * 3 + 3, len(level)))
        proof += [level[j] for j in run if j != at]
        own, at = h(*(own if j == at else level[j] for j in run)), at // 3
    return own


def brute(rows, is_tampered):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    trees = {s: levels([leaf(r, r[4]) for r in sorted(g, key=lambda r: (r[0] is not None, r[0], leaf(r, r[4])))]) for s, g in groups.items()}
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for at, row in enumerate(sorted(groups[s], key=lambda r: (r[0] is not None, r[0], leaf(r, r[4])))):
            proof, text = [], row[4]
            if is_tampered(row[0]) and text is not None:
                text = text.replace("\n", "")
            folded = climb(top, names.index(s), climb(trees[s], at, leaf(row, text), proof), proof)
            out.append((str(row[0]), leaf(row, row[4]), trees[s][-1][0], top[-1][0], "".join(proof), folded, folded == top[-1][0]))
    return sorted(out)


def tampered(i):
    return i is not None and zlib.crc32(str(i).encode()) % 2 == 0


def result(df):
    out = merkle.merkle_manifest(df, crc_mod("doc_id", 2) == 0)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, "".join(r.proof), r.folded_root, r.verified) for r in out.collect())


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3, 4], [81, 82, 27, 28], [243 + 1, 1, 1, 80], [6562, 9, 10]])
def test_trees_of_many_shapes(spark, sizes):
    r, rows = random.Random(len(sizes)), []
    for s, n in enumerate(sizes):
        rows += [(r.randrange(10**9), f"src{s}", r.choice(["en", None]), r.choice([5, None]), r.choice(["a\nb", "é", "", None, "x\n"])) for _ in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert result(df) == brute(rows, tampered)


def test_awkward_rows_and_other_columns(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (1, "é", "e:n", -1, "\n"), (1, "é", "e:n", -1, "\n"), (1, "Z", None, 2**40, "\n" * 5), (2, "Z", "-", 3, "-"), (2, None, "en", 4, "a" * 300_000 + "\n"), (4, "", "en", 0, "日本\n🙂")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for name in ("tree", "node", "path", "position", "total", "block", "rows", "above_path", "a.b"):
        df = df.withColumn(name, F.lit(1))
    assert result(df.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))) == brute(rows, tampered)
    assert result(df.limit(0)) == []
    plain = merkle.merkle_manifest(df).collect()
    assert all(r.verified and r.folded_root == r.root for r in plain)


def test_many_sources(spark):
    rows = [(i, f"s{i % 300}" if i % 301 else None, "en", i, f"t{i}\n") for i in range(700)]
    assert result(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")) == brute(rows, tampered)
