"""How sources of a language differ in their use of words: a vocabulary of exact document frequencies, then an automaton that recounts it."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialise

#: All ASCII but letters ends a term; A-Z are lowered, other bytes (of all other characters) stay.
PLAIN = bytes(b if b > 0x7F or chr(b).isalpha() else 0x20 for b in range(256)).lower()
COUNTED = "lang string, source string, term string, n long"


@dataclass(frozen=True)
class Audit:
    min_docs: int = 3
    scale: int = 1_000_000_000
    top: int = 200
    #: Terms that one automaton holds, bytes of text that one meets at least, and the sources that meet a source's histogram at once.
    terms: int = 250_000
    text: int = 32 << 20
    sources: int = 256
    #: Entries of a task's tallies, bytes of a chunk of text and of all chunks that a task holds back, pairs worked out at once.
    tallies: int = 400_000
    chunk: int = 1 << 18
    held: int = 8 << 20
    pairs: int = 2_000_000


def _counted(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One batch of parts (lang, source, array of terms, their counts)."""
    if parts:
        columns = zip(*((pa.repeat(pa.scalar(lang), len(n)), pa.repeat(pa.scalar(source, pa.string()), len(n)), term, pa.array(n, pa.int64())) for lang, source, term, n in parts))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in columns], ["lang", "source", "term", "n"])


def _first_pass(audit: Audit):
    """(lang, null, term, documents with it) and (lang, source, null, bytes of text), parts of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency: dict[str, Counter] = {}
        size: Counter = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            parts = [(lang, None, pa.array(c.keys(), pa.binary()).cast(pa.string()), np.fromiter(c.values(), np.int64, len(c))) for lang, c in frequency.items()]
            parts += [(lang, source, pa.nulls(1, pa.string()), np.array([n])) for (lang, source), n in size.items()]
            frequency.clear()
            size.clear()
            return _counted(parts)

        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                for text, lang, source in zip(*(c.to_pylist() for c in batch.slice(lo, 100).columns)):
                    plain = text.encode().translate(PLAIN)
                    size[lang, source] += len(plain)
                    frequency.setdefault(lang, Counter()).update(set(plain.split()))
                if len(size) + sum(map(len, frequency.values())) > audit.tallies:
                    yield from told()
        yield from told()

    return run


def _routed(salts: int, shards: int, large: dict[tuple[str, str], int], audit: Audit):
    """(salt, shard, kind 1, lang, source, body): texts as chunks of padded terms, each term in its shard's chunks.

    A term's shard is its crc32. A source's chunks have one salt, made of its name, so that its counts meet early; those of ``large`` ones
    have as many as are told, in turn by a chunk's place in the task, so a task that is run again deals alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[bytes]] = {}
        sizes: Counter = Counter()
        part, number, shard_of = TaskContext.get().partitionId(), 0, {}

        def told(keys: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for key in keys:
                number += 1
                turn = (part + number) % large.get(key[:2], 1)
                rows.append(((zlib.crc32("\0".join(key[:2]).encode()) + turn) % salts, key[2], 1, key[0], key[1], (b" " + b" ".join(held.pop(key)) + b" ").decode()))
                del sizes[key]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["salt", "shard", "kind", "lang", "source", "body"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                for text, lang, source in zip(*(c.to_pylist() for c in batch.slice(lo, 100).columns)):
                    plain, at = text.encode().translate(PLAIN), 0
                    while at < len(plain):
                        end = plain.find(b" ", at + audit.chunk // 2)
                        cut, at = plain[at : end if end > 0 else None], end if end > 0 else len(plain)
                        lots = {0: cut}
                        if shards > 1:
                            words = {}
                            for w in cut.split():
                                if (s := shard_of.get(w)) is None:
                                    if len(shard_of) > audit.tallies:
                                        shard_of.clear()
                                    s = shard_of[w] = zlib.crc32(w) % shards
                                words.setdefault(s, []).append(w)
                            lots = {s: b" ".join(ws) for s, ws in words.items()}
                        for s, piece in lots.items():
                            key = (lang, source, s)
                            held.setdefault(key, []).append(piece)
                            sizes[key] += len(piece) + 1
                            if sizes[key] > audit.chunk:
                                yield told([key])
            if sizes.total() > audit.held:
                for key in list(held):
                    yield told([key])
        for key in list(held):
            yield told([key])

    return run


def _recounted(audit: Audit):
    """Counts of kept terms in (salt, shard, kind, lang, source, body), sorted: of each salt and shard first the terms, then the chunks, source by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        at, of, terms, number, kept, machine = None, None, [], {}, {}, None
        tally: Counter = Counter()
        names, parts, size = None, [], 0

        def close() -> None:
            """What was counted for one source of one group."""
            nonlocal names, size
            if tally:
                names = pa.array(terms, pa.string()) if names is None else names
                found = np.fromiter(tally.keys(), np.int64, len(tally))
                mine = np.fromiter(map(kept[of[0]].__contains__, found.tolist()), bool, len(tally))
                parts.append((*of, names.take(pa.array(found[mine])), np.fromiter(tally.values(), np.int64, len(tally))[mine]))
                size += len(tally)
                tally.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                salt, shard, kind, lang, source, body = (c[i].as_py() for c in batch.columns)
                if (lang, source) != of or (salt, shard) != at or len(tally) > audit.tallies:
                    close()
                    of = (lang, source)
                    if size > audit.tallies:
                        yield from _counted(parts)
                        parts, size = [], 0
                if (salt, shard) != at:
                    at, terms, number, kept, machine, names = (salt, shard), [], {}, {}, None, None
                if kind == 0:
                    own = kept.setdefault(lang, set())
                    for term in body.split(" "):
                        if (n := number.get(term)) is None:
                            n = number[term] = len(terms)
                            terms.append(term)
                        own.add(n)
                elif lang in kept:
                    if machine is None:
                        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                        for n, term in enumerate(terms):
                            machine.add_word(f" {term} ", n)
                        machine.make_automaton()
                    tally.update(map(itemgetter(1), machine.iter(body)))
        close()
        yield from _counted(parts)

    return run


def _gap(p, q):
    """floor((p - q)^2 / q); exact in 64 bits, as p and q are at most 10^9 + 1."""
    return (p - q) * (p - q) // q


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, first = np.unique(keys[order], return_index=True)
    return keys, np.add.reduceat(values[order], first) if len(keys) else values[:0]


FOUND = "lang string, g int, other int, term string, value long"


def _found(lang, g, other, term, value) -> pa.RecordBatch:
    n = len(value)
    columns = [pa.array([lang] * n, pa.string()) if isinstance(lang, str) else lang, pa.array(g, pa.int32()), pa.nulls(n, pa.int32()) if other is None else pa.array(other, pa.int32()), pa.nulls(n, pa.string()) if term is None else term, pa.array(value, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "g", "other", "term", "value"])


def _of_terms(audit: Audit):
    """From postings sorted by lang and term (lang, term, g, n, p, p0, room: the language's count and terms): the term rows
    (other is null), and what pairs of sources that share terms have beyond what their histograms say (term is null)."""

    def work(lang: str, t: pa.Table) -> Iterator[pa.RecordBatch]:
        term, (g, n, p, p0, room) = t.column("term").combine_chunks(), (t.column(c).to_numpy() for c in ("g", "n", "p", "p0", "room"))
        code = term.dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[first, len(code)])
        big = n.max() > (1 << 62) // audit.scale or room.max() > (1 << 62) // audit.scale
        total = np.add.reduceat(n, first).astype(object if big else np.int64)
        q = np.repeat((1 + audit.scale * (total + 1) // room[first]).astype(np.int64), size)
        more = np.flatnonzero(p > q)
        yield _found(lang, g[more], None, term.take(pa.array(more)), _gap(p[more], q[more]))
        begin, width = np.repeat(first, size), np.repeat(size, size)
        rows = np.flatnonzero(width > 1)
        cuts = np.flatnonzero(np.diff(np.cumsum(width[rows]) // audit.pairs)) + 1
        for lot in np.split(rows, cuts) if len(rows) else ():
            a = np.repeat(lot, width[lot])
            b = np.arange(len(a)) - np.repeat(np.cumsum(width[lot]) - width[lot], width[lot]) + begin[a]
            a, b = a[a != b], b[a != b]
            extra = _gap(p[a], p[b]) - _gap(p[a], p0[b]) - _gap(p0[a], p[b]) + _gap(p0[a], p0[b])
            keys, sums = _summed(g[a].astype(np.int64) << 32 | g[b], extra)
            yield _found(lang, keys >> 32, keys & 0xFFFFFFFF, None, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not t.num_rows:
                continue
            lang = t.column("lang").to_numpy(zero_copy_only=False)
            term = t.column("term").to_numpy(zero_copy_only=False)
            turn = np.flatnonzero((lang[1:] != lang[:-1]) | (term[1:] != term[:-1])) + 1
            last = int(turn[-1]) if len(turn) else 0
            langs = [0, *(np.flatnonzero(lang[1:last] != lang[: last - 1]) + 1).tolist(), last] if last else []
            for lo, hi in zip(langs, langs[1:]):
                yield from work(lang[lo], t.slice(lo, hi - lo))
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield from work(rest.column("lang")[0].as_py(), rest)

    return run


def _of_histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, g, p0, size, kept, ps, ns, others, other_p0, other_size): what each pair sums to if no term were shared.

    Source a's terms meet b's floor and the terms that neither has meet with both floors, (a, b); b's floor meets a's terms, (b, a).
    """
    for batch in batches:
        for i in range(batch.num_rows):
            lang, g, p0, size, kept, *lists = (c[i].as_py() for c in batch.columns)
            ps, ns, others, floors, sizes = (np.array(x or [], dtype=np.int64) for x in lists)
            mine = np.zeros(len(others), dtype=np.int64)
            theirs = mine.copy()
            for lo in range(0, len(ps), 4096):
                p, n = ps[lo : lo + 4096, None], ns[lo : lo + 4096, None]
                mine += (n * _gap(p, floors)).sum(0)
                theirs += (n * _gap(floors, p)).sum(0)
            mine += (kept - size - sizes) * _gap(p0, floors)
            at = others != g
            a, b = np.full(at.sum(), g), others[at]
            yield _found(lang, np.r_[a, b], np.r_[b, a], None, np.r_[mine[at], theirs[at]])


def source_divergence(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank): sources of each language ranked by their distance, and each source's telling terms.

    First pass: exact document frequencies of all terms of each language, tallied in tasks before they are shuffled. Second
    pass: texts become chunks of padded terms, which meet an automaton of at most ``terms`` kept terms. There are as many shards
    of the vocabulary as that takes, a term goes to its shard's chunks alone, and chunks are dealt by source to groups of some 32 MB of text or
    four times the vocabulary, those of a larger source to several, so neither a frequent source nor a large vocabulary makes a large task, and vocabulary copies are
    a quarter of the text at most. Postings hold only what occurs. A pair's sum over all kept terms is worked out from each
    source's histogram of shares (with the other's floor) and a correction for the terms that both have.

    Null text, lang and source count as ''; empty texts still make their group occur. A language without kept terms has pairs of value 0;
    a language of one source has no pairs. Repeated rows count as often as they occur, doc_id and other columns aren't read,
    very long texts are cut into chunks between words, and an empty table gives no rows. All numbers are exact integers.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    told = rows.mapInArrow(_first_pass(audit), COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    first = materialise(told.where((F.col("n") >= audit.min_docs) | F.col("term").isNull()), "first_pass")
    is_term, length = F.col("term").isNotNull(), F.octet_length("term") + 1
    n_terms, n_bytes, text = first.agg(F.count_if(is_term), F.coalesce(F.sum(F.when(is_term, length)), F.lit(0)), F.coalesce(F.sum(F.when(~is_term, F.col("n"))), F.lit(0))).first()
    shards = max(1, -(-n_terms // audit.terms))
    salts = max(1, text // max(audit.text * shards, 4 * n_bytes))

    kept = first.where(is_term).select("lang", "term", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(shards)).cast("int").alias("shard"))
    lot = F.pmod(F.xxhash64("term"), F.lit(max(1, n_terms // (2000 * shards))))
    packed = kept.groupBy("lang", "shard", lot.alias("lot")).agg(F.array_join(F.collect_list("term"), " ").alias("body"))
    vocabulary = packed.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "shard", F.lit(0).alias("kind"), "lang", F.lit("").alias("source"), "body")
    # No more of these than there are salts, as each has a salt's share of the text at least.
    share = max(1, text // salts)
    large = {(r.lang, r.source): -(-r.n // share) for r in first.where(~is_term & (F.col("n") > share)).select("lang", "source", "n").collect()} if salts > 1 else {}
    chunks = rows.mapInArrow(_routed(salts, shards, large, audit), "salt int, shard int, kind int, lang string, source string, body string")
    met = vocabulary.unionByName(chunks).repartition("salt", "shard").sortWithinPartitions("salt", "shard", "kind", "lang", "source")
    counts = met.mapInArrow(_recounted(audit), COUNTED).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    postings = materialise(counts, "postings")

    of_lang = Window.partitionBy("lang")
    groups = first.where(F.col("source").isNotNull()).select("lang", "source")
    groups = groups.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left")
    groups = groups.join(postings.groupBy("lang", "source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("size")), ["lang", "source"], "left").fillna(0, ["kept", "tokens", "size"])
    groups = groups.withColumn("g", F.row_number().over(of_lang.orderBy("source")) - 1).withColumn("room", F.sum("tokens").over(of_lang) + F.col("kept"))
    groups = materialise(groups.withColumn("p0", F.expr(f"if(tokens + kept > 0, 1 + {audit.scale} div (tokens + kept), 1)")), "groups")

    p = F.expr(f"1 + cast(cast({audit.scale} as decimal(10,0)) * cast(n + 1 as decimal(19,0)) div (tokens + kept) as long)")
    scored = materialise(postings.join(groups, ["lang", "source"]).select("lang", "term", "g", "n", p.alias("p"), "p0", "room"), "scored")
    forget(postings)
    shared = scored.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_of_terms(audit), FOUND)

    shares = scored.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("k")).groupBy("lang", "g").agg(F.collect_list("p").alias("ps"), F.collect_list("k").alias("ns"))
    block = F.expr(f"g div {audit.sources}").alias("block")
    others = groups.groupBy("lang", block).agg(*(F.collect_list(c).alias(x) for c, x in (("g", "others"), ("p0", "other_p0"), ("size", "other_size"))))
    alone = groups.join(shares, ["lang", "g"], "left").join(others, "lang").select("lang", "g", "p0", "size", "kept", "ps", "ns", "others", "other_p0", "other_size")
    found = materialise(alone.mapInArrow(_of_histograms, FOUND).unionByName(shared), "found")

    names = groups.select("lang", "g", "source")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where(F.col("term").isNull()).groupBy("lang", "g", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    terms = found.where(F.col("term").isNotNull()).join(names, ["lang", "g"]).withColumnRenamed("term", "item")
    ranked = [x.withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", terms))]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= audit.top))
