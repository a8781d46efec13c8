"""Benchmark decontamination by one Aho-Corasick automaton.

Test questions and answers are normalised (A-Z lowered, words joined by one space) and cut into windows of `words`
consecutive words; an item of fewer words, but not none, is one window. All windows make one automaton, which scans each
document's normalised words once; matches are mapped to word numbers and, for spans, to offsets in the original text.

The automaton is built on the driver from the benchmark, a stated set. Its size is counted in trie nodes (one for each byte
of distinct windows at most; some 50 bytes of memory each). A benchmark of more than PART_NODES is dealt by hash of the
window into parts, which are broadcast, scanned and released one after the other: a worker holds one part at a time. The
passes meet by digest of the text, hits only, so a larger benchmark costs more scans and not more memory.

Nulls, empties, ties: a null or empty text, or one without words, has no words and no hits; an item without words has no
window; windows that several items share count for each; a null item_id marks words but is not listed; repeated items
count once. An empty benchmark leaves every document clean, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WORDS = 10
PART_NODES = 4 << 20
#: Fixed value: the characters of a word, after lowering A-Z.
WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_kept = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: Byte by byte: A-Z lowered, every other ASCII character that isn't a word's to a space. UTF-8 beyond ASCII stays.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c in _kept else 32) for c in range(256))


def fold(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows(text: str | None, words: int = WORDS) -> list[bytes]:
    w = fold(text)
    if not w:
        return []
    return [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]


class Automaton:
    """Windows of items. windows: (item_id, window). hits(text) -> (words, item ids, hit words as merged spans)."""

    def __init__(self, windows_):
        owners: dict[bytes, set] = {}
        for item, w in windows_:
            owners.setdefault(w, set()).add(item)
        self.found = ahocorasick.Automaton()
        for w, ids in owners.items():
            # latin-1 gives one character a byte, so positions are byte positions
            self.found.add_word(" " + w.decode("latin-1") + " ", (w.count(b" ") + 1, tuple(ids)))
        if owners:
            self.found.make_automaton()
        self.any = bool(owners)

    def hits(self, text: str | None) -> tuple[int, set, list[tuple[int, int]]]:
        """Number of words, ids of items with occurring windows, and the hit words as merged [start, end) word ranges."""
        w = fold(text)
        if not w or not self.any:
            return len(w), set(), []
        line = " " + b" ".join(w).decode("latin-1") + " "
        ends, ids = [], set()
        for end, (n, owners) in self.found.iter(line):
            ends.append((end, n))
            ids.update(owners)
        if not ends:
            return len(w), ids, []
        starts = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)  # starts[i] is where the space after word i stands
        spans: list[tuple[int, int]] = []
        for end, n in sorted(ends):
            last = int(np.searchsorted(starts, end)) + 1
            first = last - n
            while spans and first <= spans[-1][1]:
                first = min(first, spans.pop()[0])
            spans.append((first, last))
        return len(w), ids, spans


def parts_of(items: DataFrame, words: int, part_nodes: int) -> Iterator[Automaton]:
    """Automata over parts of the items' windows, one at a time."""
    total = items.agg(F.sum((F.coalesce(F.octet_length("text"), F.lit(0)) + 2) * words)).first()[0] or 0
    n = max(1, -(-int(total) // part_nodes))
    for k in range(n):
        yield Automaton((r[0], w) for r in items.toLocalIterator() for w in windows(r[1], words) if n == 1 or zlib.crc32(w) % n == k)


RESULT = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "items": pa.list_(pa.string()), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
RESULT_DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"


def _result(text: str | None, n: int, ids, spans) -> tuple:
    names = sorted({str(i) for i in ids if i is not None})
    return n, sum(e - s for s, e in spans), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(spans), names, [{"start": s, "end": e} for s, e in offsets(text, spans)]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(RESULT.values())]


def _digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()


def found_in(docs: DataFrame, automata: Iterator[Automaton]) -> DataFrame:
    """docs(text) -> (key, ids, spans) for each distinct text that a part of the automaton hits, and part; written part by part."""
    out = None
    for part in automata:
        held = docs.sparkSession.sparkContext.broadcast(part)

        def look(batches, held=held):
            for b in batches:
                rows = []
                for x in b.column(0):
                    _, ids, spans = held.value.hits(x.as_py())
                    if spans:
                        rows.append((_digest(x.as_py()), [str(i) for i in ids if i is not None], [v for s in spans for v in s]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["key", "ids", "spans"])

        hits = written(docs.select("text").mapInArrow(look, "key string, ids array<string>, spans array<long>"), "hits")
        held.destroy()
        out = hits if out is None else out.unionByName(hits)
    both = out.groupBy("key").agg(F.flatten(F.collect_set("ids")).alias("ids"), F.flatten(F.collect_set("spans")).alias("spans"))
    return written(both, "hits")


def scan(docs: DataFrame, items: DataFrame, words: int = WORDS, part_nodes: int = PART_NODES) -> DataFrame:
    """docs(doc_id, text) x items(item_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items
    (sorted as strings), spans (array of start and end character offsets in the original text), in the rows of docs."""
    items = items.select("item_id", "text").distinct()
    parts = parts_of(items, words, part_nodes)
    one, second = next(parts), next(parts, None)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *RESULT]
    if second is None:
        held = docs.sparkSession.sparkContext.broadcast(one)

        def look(batches):
            for b in batches:
                rows = [_result(x.as_py(), *held.value.hits(x.as_py())) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), *_columns(rows)], names=names)

        return docs.select("doc_id", "text").mapInArrow(look, f"doc_id {kind}, {RESULT_DDL}")

    found = found_in(docs, itertools.chain([one, second], parts))
    key = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    joined = docs.select("doc_id", "text", key.alias("k")).join(found, F.col("k") == F.col("key"), "left").select("doc_id", "text", "ids", "spans")

    def put(batches):
        for b in batches:
            rows = []
            for x, ids, flat in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                flat = flat or []
                rows.append(_result(x.as_py(), len(fold(x.as_py())), ids or [], merge(list(zip(flat[::2], flat[1::2], strict=True)))))
            yield pa.RecordBatch.from_arrays([b.column(0), *_columns(rows)], names=names)

    return joined.mapInArrow(put, f"doc_id {kind}, {RESULT_DDL}")


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def offsets(text: str | None, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of ranges of words."""
    if not spans:
        return []
    places = [m.span() for m in re.finditer(WORD_CHARS, re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    return [(places[s][0], places[e - 1][1]) for s, e in spans]


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of 10 words."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: For the pipeline.
STAGE_WORDS = 10


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, part_nodes: int = PART_NODES) -> DataFrame:
    """documents -> documents without a hit word.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark keeps every row and an empty table
    gives an empty result. Only text is looked at; columns may have any names.
    """
    parts = parts_of(table(spark, sf_dir, "benchmark").select("item_id", "text").distinct(), STAGE_WORDS, part_nodes)
    one, second = next(parts), next(parts, None)
    place = docs.columns.index("text")
    if second is None:
        held = spark.sparkContext.broadcast(one)

        def clean(batches):
            for b in batches:
                yield b.filter(pa.array([not held.value.hits(x.as_py())[2] for x in b.column(place)], pa.bool_()))

        return docs.mapInArrow(clean, docs.schema)
    found = found_in(docs, itertools.chain([one, second], parts)).select("key")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("k"))
    return keyed.join(found, F.col("k") == F.col("key"), "left_anti").select("row.*")


ORACLE_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
