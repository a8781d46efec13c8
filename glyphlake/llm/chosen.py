"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set of shingles has POSITIONS minwise tokens: the least of its hashes under as many hash functions; two sets agree
in a position with a probability equal to their Jaccard similarity s. A tree branches: each node picks one position, and with
odds 1 / threshold - 1 a second, the same for all its documents, and sends a document to the child named by its token there; so
a pair at the threshold meets in one child of each node on average. Nodes of a few documents are compared pair by pair.
Trees are independent and repeated until a pair at the threshold is lost with at most 1 - RECALL after LEVELS levels.

A tree's first level is a shuffle of (node, minwise tokens), sorted by node and streamed; below it a task branches on its own.
A node with more documents than a task should hold is dealt to its children by another shuffle, block by block; documents of
later blocks meet those that stand for the groups of the first one. No node lies deeper than LEVELS: what is there is compared
pair by pair, in a task where one can hold it, else in blocks, each with each over tasks; pairs that are joined already are left
out. A node whose documents are mostly alike doesn't get smaller by branching: it is searched outward from one document at a
time, leaving out those already reached.

The join compares sketches, a byte a position, and so yields candidate groups: components of pairs with FEWEST or more equal
bytes (four deviations below the threshold). Each pair of a group is then decided on full sets, and components of those
links are the result. Equal sets are one node throughout, so copies are never paired.

Nulls, empties, ties: a null text is empty; a text without a word has no shingle, is linked with nothing and is its own
component; under four words the whole sequence is the one shingle. A null doc_id keeps its row; a component's id is its smallest
non-null doc_id, null if it has none; kept says whether both are the same, nulls included. Rows that repeat a doc_id each
keep a row, judged by their texts. Extra columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import blocks, partitions, table, written
from .components import components

WORDS, THRESHOLD = 4, 0.8
POSITIONS, FEWEST = 128, 84
RECALL, LEVELS = 0.9999, 3
#: Nodes up to SMALL are compared pair by pair; a task holds at most about LARGE documents of one node.
SMALL, LARGE = 256, 8192
#: Bits of 128 in which one-bit sketches may differ before full sets are compared, and shingles hashed at once.
BITS, CHUNK = 30, 1 << 20
SEED = 13

_GOLDEN, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_ALL = (1 << 64) - 1


def mixed(*parts: int) -> int:
    """A 64-bit hash of integers."""
    h = SEED
    for p in parts:
        h = ((h ^ (p & _ALL)) * _MIX + _GOLDEN) & _ALL
        h ^= h >> 31
    return (h * _GOLDEN & _ALL) ^ (h >> 29)


def positions(node: int) -> list[int]:
    """The positions that a node branches on: one, or two with odds 1 / THRESHOLD - 1."""
    first = mixed(node, 1) % POSITIONS
    if mixed(node, 2) / 2**64 >= 1 / THRESHOLD - 1:
        return [first]
    return [first, (first + 1 + mixed(node, 3) % (POSITIONS - 1)) % POSITIONS]


def trees(recall: float = RECALL, levels: int = LEVELS, threshold: float = THRESHOLD) -> int:
    """Trees needed for that recall at the threshold."""
    two, meets = 1 / threshold - 1, 1.0
    for _ in range(levels):
        lost = 1 - threshold * meets
        meets = 1 - (1 - two) * lost - two * lost * lost
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def minwise(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(sets, POSITIONS) least hashes; values of all sets, each from begin on and none empty."""
    out = np.empty((len(begin), POSITIONS), np.uint64)
    for k in range(POSITIONS):
        out[:, k] = np.minimum.reduceat((values ^ np.uint64(mixed(k, 11))) * np.uint64(mixed(k, 12) | 1), begin)
    return out * np.uint64(_GOLDEN)


def marked(docs: DataFrame) -> DataFrame:
    """docs(doc_id, key, text) -> doc_id, key, bytes, n_shingles, digest (of the set; null if empty), sketch, paths (first nodes)."""
    roots = [(t, p) for t in range(trees()) for p in positions(mixed(t))]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches):
        for b in blocks(batches, "text", 4 << 20):
            values, at = simhash.sets_of(b.column(2), WORDS)
            n = np.diff(at)
            full = np.flatnonzero(n)
            digests, sketches, paths = [None] * len(n), [None] * len(n), [None] * len(n)
            if len(full):
                least = minwise(values, at[:-1][full])
                codes = (least >> np.uint64(56)).astype(np.uint8)
                nodes = np.stack([(least[:, p] ^ np.uint64(mixed(t, p))) * np.uint64(_MIX) for t, p in roots], axis=1).view(np.int64)
                for i, code, node in zip(full.tolist(), codes, nodes, strict=True):
                    digests[i] = hashlib.sha256(values[at[i] : at[i + 1]].tobytes()).digest()[:16]
                    sketches[i], paths[i] = code.tobytes(), node.tolist()
            sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(2)), 0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), pa.array(n.astype(np.int64)), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], names=["doc_id", "key", "bytes", "n_shingles", "digest", "sketch", "paths"])

    return docs.select("doc_id", "key", "text").mapInArrow(each, f"doc_id {kind}, key string, bytes long, n_shingles long, digest binary, sketch binary, paths array<long>")


def near(sketch: np.ndarray, one: np.ndarray) -> np.ndarray:
    # sixteen words of bytes 0 and 1, whose sums stay in their byte
    return ((sketch == one).view(np.uint64).sum(axis=1) * np.uint64(0x0101010101010101) >> np.uint64(56)) >= FEWEST


class Links:
    """Pairs of rows of `sketch` with FEWEST or more equal bytes: enough of them to join what belongs together. Nodes branch up to
    `levels` times."""

    def __init__(self, sketch: np.ndarray, levels: int = LEVELS - 1):
        self.sketch, self.levels, self.a, self.b = sketch, levels, [], []

    def add(self, a, b) -> None:
        self.a.append(np.broadcast_to(a, np.shape(b)))
        self.b.append(b)

    def walk(self, rows: np.ndarray) -> None:
        """From one row to those near it, and so on, leaving out those already reached."""
        while len(rows) > 1:
            waiting, rows = [rows[0]], rows[1:]
            while waiting and len(rows):
                x = waiting.pop()
                hit = near(self.sketch[rows], self.sketch[x])
                if hit.any():
                    self.add(x, rows[hit])
                    waiting += rows[hit].tolist()
                    rows = rows[~hit]

    def branch(self, rows: np.ndarray, node: int) -> None:
        """A node's documents down to small nodes or the last level."""
        stack = [(rows, node, 0)]
        while stack:
            rows, node, depth = stack.pop()
            if len(rows) <= SMALL or depth >= self.levels or near(self.sketch[rows[1:]], self.sketch[rows[0]]).sum() * 4 >= len(rows):
                self.walk(rows)
                continue
            for p in positions(node):
                token = self.sketch[rows, p]
                order = np.argsort(token, kind="stable")
                ends = np.flatnonzero(np.diff(token[order])) + 1
                for child in np.split(rows[order], ends):
                    if len(child) > 1:
                        stack.append((child, mixed(node, p, int(self.sketch[child[0], p])), depth + 1))

    def nodes(self, path: np.ndarray) -> None:
        """All nodes of rows sorted by path; small ones by shifts of the whole block."""
        begin = np.flatnonzero(np.diff(path, prepend=path[0] - 1 if len(path) else 0))
        size = np.diff(np.append(begin, len(path)))
        few = size <= 16
        here = np.flatnonzero(np.repeat(few, size))
        for shift in range(1, 16):
            here = here[here + shift < len(path)]
            here = here[path[here] == path[here + shift]]
            if not len(here):
                break
            hit = np.concatenate([(self.sketch[h] == self.sketch[h + shift]).sum(axis=1) >= FEWEST for h in np.array_split(here, len(here) // 16384 + 1)])
            self.add(here[hit], here[hit] + shift)
        for s, n in zip(begin[~few].tolist(), size[~few].tolist(), strict=True):
            self.branch(np.arange(s, s + n), int(path[s]))

    def joined(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, root key) of linked keys; keys has one for each row."""
        if not self.a:
            return keys[:0], keys[:0]
        a, b = keys[np.concatenate(self.a)], keys[np.concatenate(self.b)]
        ends, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = simhash.forest(len(ends), place[: len(a)], place[len(a) :])
        child = np.flatnonzero(root != np.arange(len(ends)))
        return ends[child], ends[root[child]]


def _children(path: int, sketch: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, path) of a crowded node's children."""
    out = []
    for p in positions(path):
        names = np.array([mixed(path, p, v) for v in range(256)], np.uint64).view(np.int64)
        out.append((np.arange(len(sketch)), names[sketch[:, p]]))
    return out


def _searched(last: bool, levels: int = LEVELS - 1):
    """Sorted rows(path, key, sketch) -> links (a, b) and rows of crowded nodes for the next shuffle (path, a, sketch): with their
    children's names, or with the node's at the last level."""

    def batch(a, b, path=None, sketch=None):
        return pa.RecordBatch.from_arrays([pa.array([x.ljust(16, b"\0").hex() for x in a], pa.string()), pa.array([x.ljust(16, b"\0").hex() for x in b], pa.string()) if b is not None else pa.nulls(len(a), pa.string()), pa.array(path) if path is not None else pa.nulls(len(a), pa.int64()), pa.array([s.tobytes() for s in sketch], pa.binary()) if sketch is not None else pa.nulls(len(a), pa.binary())], names=["a", "b", "path", "sketch"])

    def each(batches):
        path, key, sketch = np.zeros(0, np.int64), np.zeros(0, "S16"), np.zeros((0, POSITIONS), np.uint8)
        crowded, heads = None, None

        def decided(rows):
            links = Links(sketch[rows], levels)
            links.nodes(path[rows])
            a, b = links.joined(key[rows])
            return batch(a, b) if len(a) else None

        def dealt(rows):
            """One block of a crowded node."""
            nonlocal heads
            links = Links(sketch[rows], levels)
            if heads is not None:
                for k, s in zip(*heads, strict=True):
                    hit = near(sketch[rows], s)
                    if hit.any():
                        yield batch([k] * int(hit.sum()), key[rows][hit])
            links.branch(np.arange(len(sketch[rows])), int(crowded))
            a, b = links.joined(key[rows])
            if len(a):
                yield batch(a, b)
            if heads is None:
                # the roots of the largest groups stand for them
                roots, n = np.unique(b, return_counts=True)
                chief = roots[np.argsort(-n, kind="stable")[:64]]
                place = np.searchsorted(np.sort(key[rows]), chief)
                order = np.argsort(key[rows], kind="stable")[place]
                heads = (chief, sketch[rows][order])
            if last:
                yield batch(key[rows], None, path[rows], sketch[rows])
                return
            for row, child in _children(int(crowded), sketch[rows]):
                yield batch(key[rows][row], None, child, sketch[rows][row])

        for b in batches:
            if not b.num_rows:
                continue
            path = np.concatenate((path, np.asarray(b.column(0))))
            key = np.concatenate((key, np.frombuffer(b"".join(b.column(1).to_pylist()), "S16")))
            sketch = np.concatenate((sketch, np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, POSITIONS)))
            while len(path):
                if crowded is not None:
                    end = int(np.searchsorted(path, crowded, side="right"))
                    if end:
                        yield from dealt(slice(0, min(end, LARGE)))
                        end = min(end, LARGE)
                        path, key, sketch = path[end:], key[end:], sketch[end:]
                        continue
                    crowded = heads = None
                start = int(np.searchsorted(path, path[-1]))
                if start:
                    if (out := decided(slice(0, start))) is not None:
                        yield out
                    path, key, sketch = path[start:], key[start:], sketch[start:]
                if len(path) <= LARGE:
                    break
                crowded = path[0]
        if len(path) and (out := decided(slice(0, len(path)))) is not None:
            yield out

    return each


def candidates(nodes: DataFrame) -> DataFrame:
    """nodes(digest, sketch, paths) -> (node, root) of nodes with a candidate, named in hex."""
    rows = nodes.select(F.explode("paths").alias("path"), F.col("digest").alias("key"), "sketch")
    found = None
    for turn in range(LEVELS):
        dealt = rows.repartition(partitions(nodes.sparkSession), "path").sortWithinPartitions("path")
        out = written(dealt.mapInArrow(_searched(turn == LEVELS - 1, LEVELS - 1 - turn), "a string, b string, path long, sketch binary"), "branches")
        links = out.where("b IS NOT NULL").select("a", "b")
        found = links if found is None else found.unionByName(links)
        rows = out.where("b IS NULL").select("path", F.unhex("a").alias("key"), "sketch")
        if rows.isEmpty():
            return components(found)
    linked = components(found)
    return components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(between(rows, linked)))


def between(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """rows(path, key, sketch) of crowded nodes, linked(node, root) -> links (a, b) that join all of a node's near rows which aren't
    joined yet. A node's rows are dealt into blocks of about LARGE, those of a large group into blocks of their own, and blocks
    are compared two by two over tasks, but not those of one group."""
    named = rows.select("path", F.lower(F.hex("key")).alias("name"), "sketch")
    named = written(named.join(linked, F.col("name") == F.col("node"), "left").select("path", "name", "sketch", F.coalesce("root", "name").alias("label")), "labelled")
    # at most a row for LARGE rows, in both
    large = named.groupBy("path", "label").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE).select("path", "label", "n", F.col("label").alias("own"))
    rest = named.join(F.broadcast(large.select("path", "label")), ["path", "label"], "left_anti").groupBy("path").agg(F.count("*").alias("m"))
    dealt = named.join(F.broadcast(large), ["path", "label"], "left").join(F.broadcast(rest), "path", "left")
    dealt = dealt.withColumn("own", F.coalesce("own", F.lit(""))).withColumn("part", F.pmod(F.xxhash64("name"), F.ceil(F.coalesce("n", "m") / LARGE)))
    held = written(dealt.groupBy("path", "own", "part").agg(F.collect_list(F.struct("label", "name", "sketch")).alias("held")), "blocks")
    side = lambda k: held.select("path", F.struct("own", "part").alias(f"at{k}"))
    pairs = side(0).join(side(1), "path").where("at0 <= at1 AND (at0.own <> at1.own OR at0.own = '')")
    for k in (0, 1):
        pairs = pairs.join(held.select("path", F.struct("own", "part").alias(f"at{k}"), F.col("held").alias(f"held{k}")), ["path", f"at{k}"])
    both = pairs.repartition(partitions(rows.sparkSession), F.xxhash64("path", "at0", "at1")).select("held0", "held1", (F.col("at0") == F.col("at1")).alias("same"))

    def read(lists, i):
        t = lists[i].values
        return t.field(0).to_pylist(), t.field(1).to_pylist(), np.frombuffer(b"".join(t.field(2).to_pylist()), np.uint8).reshape(-1, POSITIONS)

    def each(batches):
        for batch in batches:
            for i, same in enumerate(batch.column(2).to_pylist()):
                label, name, sketch = read(batch.column(0), i)
                n, more = len(name), ([], [], np.zeros((0, POSITIONS), np.uint8)) if same else read(batch.column(1), i)
                names, sketch = name + more[1], np.concatenate((sketch, more[2]))
                root, out = np.unique(label + more[0], return_inverse=True)[1].reshape(-1), []
                for k in range(n):
                    start = k + 1 if same else n
                    open_ = start + np.flatnonzero(root[start:] != root[k])
                    for j in open_[near(sketch[open_], sketch[k])].tolist():
                        if root[j] != root[k]:
                            root[root == root[j]] = root[k]
                            out.append((names[k], names[j]))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["a", "b"])

    return written(both.mapInArrow(each, "a string, b string"), "between")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    key = F.substring(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256), 1, 32)
    docs = docs.select("doc_id", key.alias("key"), "text")
    marks = written(marked(docs), "marks")
    # the text with the smallest doc_id stands for its set
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key", "bytes")).alias("f")
    nodes = marks.where("n_shingles > 0").groupBy("digest").agg(first, F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    nodes = written(nodes.select("digest", "f.doc_id", "f.key", "f.bytes", "sketch", "paths"), "nodes")
    linked = candidates(nodes.select("digest", "sketch", "paths"))
    held = nodes.select(F.lower(F.hex("digest")).alias("name"), F.col("doc_id").alias("first_id"), "key", "bytes", "sketch")
    # only nodes with a candidate go on; a root is named by those that point at it
    linked = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    rooted = held.join(linked, F.col("name") == F.col("node")).select("key", F.xxhash64("root").alias("root"), "first_id", "bytes", lanes_of("sketch").alias("lanes"))
    found = written(simhash.decided(written(rooted, "rooted"), docs, WORDS, BITS, THRESHOLD), "found")
    # a component's smallest id, for its nodes only
    own = nodes.select("digest", F.col("doc_id").alias("first_id"), F.col("key").alias("k"))
    judged = written(own.join(found, F.col("k") == F.col("node"), "left").select("digest", "first_id", F.coalesce("cluster", "k").alias("cluster")), "judged")
    least = judged.groupBy("cluster").agg(F.min("first_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = written(judged.join(least, "cluster", "left").select("digest", F.coalesce("least", "first_id").alias("named")), "named")
    rows = marks.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("named")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def lanes_of(sketch: str):
    """Two longs of a sketch: a bit of each byte."""

    @F.pandas_udf("array<long>")
    def bits(codes):
        import pandas as pd

        return pd.Series([np.packbits(np.frombuffer(c, np.uint8) & 1).view(np.int64) for c in codes])

    return bits(sketch)


def op13_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 4-word shingles, Jaccard similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_OP13 = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
g AS (SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM s GROUP BY list_sort(s), len(s) HAVING len(s) > 0),
t AS (SELECT id, n, unnest(s) AS t FROM g),
e AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.t = b.t AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT id AS a, id AS b FROM g UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, s.doc_id IS NOT DISTINCT FROM coalesce(component_id, s.doc_id) AS kept FROM s LEFT JOIN g ON list_sort(s.s) = g.s LEFT JOIN c ON c.id = g.id"""
