"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has one bit for each of 64 x lanes hash bits: 1 if it is set in over half the shingles of a text. Bits are cut
into `parts` of equal width; inside a part of radius r, bit number i gets the (r + 1)-bit vector 1 + i mod (2^(r+1) - 1),
and table v (1 .. 2^(r+1) - 1) keeps the bits whose vector has an odd inner product with v. At most r differing bits give
r linear equations in r + 1 unknowns, so some v != 0 drops all of them: a pair within r bits in a part always meets in one
of the part's tables. A pair within parts x (r + 1) - 1 bits in all is within r in some part, so it always meets.

Pairs that meet are compared as whole fingerprints. Only distinct fingerprints are hashed into tables; a crowded bucket is
searched outward from one member at a time, leaving out those already reached, and gives a spanning tree and never all its
pairs. Links are joined into components over the corpus. The pipeline's stage takes such groups as candidates only and
decides each of their pairs by the exact Jaccard similarity of sets of shingles.

Nulls, empties, ties: null and empty texts have no shingle and fingerprint zero, which is linked like any other; a text of
fewer words than a shingle is one shingle; exactly half the shingles leave a bit 0; a null doc_id keeps its row, and a
component's id is its smallest non-null doc_id; repeated rows each keep their row. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, split_words, table, written
from .components import components

SEED = 42
#: Shingles turned to bits at once.
CHUNK = 1 << 19
#: Buckets up to this size are compared pair by pair.
SMALL = 48


class Shingles:
    """Shingles of texts as slices of one buffer: words joined by one space. `owners` has each shingle's text."""

    def __init__(self, texts: pa.Array, words: int):
        flat, self.first = split_words(texts)
        count = np.diff(self.first)
        self.count, self.words = len(count), words
        self.joined = pc.binary_join_element_wise(flat.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())).buffers()[2].to_pybytes() if len(flat) else b""
        self.length = np.asarray(pc.binary_length(flat)).astype(np.int64)
        self.start = np.cumsum(self.length + 1) - self.length - 1
        self.n = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
        self.begins = np.cumsum(self.n) - self.n
        # a block's shingles are fewer than its bytes, which Arrow keeps below 2^31
        self.owners = np.repeat(np.arange(self.count, dtype=np.int32), self.n)

    def hashes(self, shingles: np.ndarray, owner: np.ndarray, lane: int) -> np.ndarray:
        a = self.first[owner] + shingles - self.begins[owner]
        b = np.minimum(a + self.words, self.first[owner + 1]) - 1
        digest, seed, joined = xxhash.xxh64_intdigest, SEED + lane, self.joined
        return np.fromiter((digest(joined[s:e], seed) for s, e in zip(self.start[a].tolist(), (self.start[b] + self.length[b]).tolist(), strict=True)), np.uint64, len(shingles))


def fingerprints_of(texts: pa.Array, words: int, lanes: int = 1, distinct: bool = False) -> np.ndarray:
    """(texts, lanes) uint64. Lane k hashes with XXH64 seed 42 + k. With `distinct` a shingle counts once a text."""
    shingles = Shingles(texts, words)
    out = np.zeros((shingles.count, lanes), np.uint64)
    owners, n, hashes = shingles.owners, shingles.n, shingles.hashes
    if not len(owners):
        return out
    used, known = np.arange(len(owners), dtype=np.int32), None
    if distinct:
        known = np.concatenate([hashes(used[at : at + CHUNK], owners[at : at + CHUNK], 0) for at in range(0, len(used), CHUNK)])
        order = np.lexsort((known, owners))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(owners[order]) != 0) | (np.diff(known[order]) != 0)
        used = np.sort(order[fresh]).astype(np.int32)
        known, owners = known[used], owners[used]
        n = np.bincount(owners, minlength=shingles.count)
    ends = np.cumsum(n)
    tallies = {}
    for at in range(0, len(used), CHUNK):
        stop = min(at + CHUNK, len(used))
        doc = owners[at:stop]
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        for lane in range(lanes):
            h = hashes(used[at:stop], doc, lane) if lane or known is None else known[at:stop]
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
            for d, s in zip(doc[heads].tolist(), sums, strict=True):
                key = (lane, d)
                tallies[key] = tallies[key] + s if key in tallies else s
        done = int(np.searchsorted(ends, stop, side="right")) if stop < ends[-1] else shingles.count
        for lane, d in [k for k in tallies if k[1] < done]:
            bit = tallies.pop((lane, d)) * 2 > n[d]
            out[d, lane] = np.packbits(bit, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int, lanes: int = 1, distinct: bool = False, *more: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lane0, ...: fingerprint lanes as (signed) longs. `more` columns are carried along."""
    kept = ["doc_id", *more]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)

    def each(batches):
        for b in blocks(batches, "text"):
            prints = fingerprints_of(b.column(len(kept)), words, lanes, distinct).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *(pa.array(prints[:, k]) for k in range(lanes))], names=[*kept, *(f"lane{k}" for k in range(lanes))])

    return docs.select(*kept, "text").mapInArrow(each, kinds + "".join(f", lane{k} long" for k in range(lanes)))


def masks(radius: int, lanes: int = 1, parts: int = 1) -> np.ndarray:
    """(tables, lanes) uint64: parts x (2^(radius+1) - 1) covering masks over 64 x lanes bits."""
    width, vectors = 64 * lanes // parts, (2 << radius) - 1
    out = []
    for part in range(parts):
        for v in range(1, vectors + 1):
            kept = [part * width + i for i in range(width) if ((1 + i % vectors) & v).bit_count() & 1]
            out.append([sum(1 << (i - 64 * lane) for i in kept if i // 64 == lane) for lane in range(lanes)])
    return np.array(out, np.uint64)


def links_in(prints: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a, b) of `prints` that share a group (sorted) and differ in at most `most` bits; in groups over
    SMALL only enough of them to join all that belong together."""
    lefts, rights = [], []
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if len(group) else 0))
    sizes = np.diff(np.append(starts, len(group)))
    small = np.repeat(sizes <= SMALL, sizes)
    here = np.flatnonzero(small)
    for shift in range(1, SMALL):
        here = here[here + shift < len(group)]
        here = here[group[here] == group[here + shift]]
        if not len(here):
            break
        near = np.bitwise_count(prints[here] ^ prints[here + shift]).sum(axis=1) <= most
        lefts.append(here[near])
        rights.append(here[near] + shift)
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        left = np.arange(s, s + n)
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(prints[left] ^ prints[x]).sum(axis=1) <= most
                if near.any():
                    found, left = left[near], left[~near]
                    lefts.append(np.full(len(found), x))
                    rights.append(found)
                    queue += found.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (none, none)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the links (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def groups(prints: DataFrame, lanes: int, radius: int, parts: int = 1, most: int | None = None) -> DataFrame:
    """prints(node, lane0, ...), node distinct for each fingerprint -> (node, root) for nodes with a link. Pairs within
    parts x (radius + 1) - 1 bits are all found; pairs found beyond that count as links up to `most` bits."""
    guaranteed = parts * (radius + 1) - 1
    most = guaranteed if most is None else most
    table_masks = masks(radius, lanes, parts)
    cols = [f"lane{k}" for k in range(lanes)]
    spread = prints.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(len(table_masks) - 1))))
    # the masked lanes decide where a row goes; the task computes them again
    literal = [F.element_at(F.array(*[F.lit(int(m)) for m in table_masks[:, k].view(np.int64)]), F.col("t") + 1) for k in range(lanes)]
    dealt = spread.repartition("t", *[F.col(c).bitwiseAND(m) for c, m in zip(cols, literal, strict=True)])

    def link(batches):
        got = [(np.asarray(b.column(0)), np.stack([np.asarray(b.column(1 + k)).view(np.uint64) for k in range(lanes)], axis=1)) for b in batches if b.num_rows]
        if not got:
            return
        t, x = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        del got
        key = x & table_masks[t]
        order = np.lexsort((*key.T, t))
        t, x, key = t[order], x[order], key[order]
        fresh = np.empty(len(t), bool)
        fresh[0] = True
        fresh[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]).any(axis=1)
        a, b = links_in(x, np.cumsum(fresh), most)
        if not len(a):
            return
        # what meets in several tables of this task is joined here
        ends, place = np.unique(np.concatenate((x[a], x[b])), axis=0, return_inverse=True)
        place = place.reshape(-1)
        root = forest(len(ends), place[: len(a)], place[len(a) :])
        child = np.flatnonzero(root != np.arange(len(ends)))
        yield pa.RecordBatch.from_arrays([pa.array(names_of(ends[child])), pa.array(names_of(ends[root[child]]))], names=["a", "b"])

    return components(dealt.select("t", *cols).mapInArrow(link, "a string, b string"))


def names_of(prints: np.ndarray) -> list[str]:
    return ["".join(f"{v:016x}" for v in row) for row in prints.tolist()]


def name(lanes: int):
    """The fingerprint as 16 lower-case hex digits a lane."""
    return F.concat(*[F.lpad(F.lower(F.hex(f"lane{k}")), 16, "0") for k in range(lanes)])


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, lanes: int = 1, parts: int = 1, most: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint, component_id, one row for each row of docs."""
    prints = written(fingerprints(docs, words, lanes).withColumn("fingerprint", name(lanes)), "prints")
    nodes = prints.groupBy("fingerprint", *[f"lane{k}" for k in range(lanes)]).agg(F.min("doc_id").alias("first_id"))
    linked = groups(nodes, lanes, radius, parts, most)
    roots = nodes.select("fingerprint", "first_id").join(linked, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    roots = written(roots, "roots")
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(roots.join(least, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 4-word shingles, links at 4 or fewer of 64 bits: 31 covering tables."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: For the pipeline: shingles of five words and 128 bits in four parts of radius 4, so pairs within 19 bits always meet;
#: pairs that meet are candidates up to 27 bits. 19 of 128 bits is the expected distance at a Jaccard similarity of 0.8 of sets
#: of shingles, so a shingle counts once a text: else one word repeated over and over would decide the fingerprint alone.
STAGE = {"lanes": 2, "parts": 4, "radius": 4, "most": 27}
STAGE_WORDS = 5
SIMILARITY = 0.8
#: Bytes of text of a pack of texts that are compared at once, and texts of a larger group taken as pivots, round by round.
PACK = 1 << 23
PIVOTS = (1, 16, 256)


def sets_of(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and where each text's begin (one more entry than texts)."""
    shingles = Shingles(texts, words)
    h = shingles.hashes(np.arange(len(shingles.owners), dtype=np.int32), shingles.owners, 0)
    order = np.lexsort((h, shingles.owners))
    h, owner = h[order], shingles.owners[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return h[fresh], np.searchsorted(owner[fresh], np.arange(shingles.count + 1))


def _unpacked(packs) -> tuple[list, np.ndarray, list[np.ndarray]]:
    """Keys, lanes and sets of a list of structs (key, lanes, shingles)."""
    flat = packs.flatten()
    sets = flat.field("shingles")
    at = np.asarray(sets.offsets)
    values = np.asarray(sets.values).view(np.uint64)
    lanes = np.asarray(flat.field("lanes").flatten()).view(np.uint64).reshape(len(flat), -1)
    return flat.field("key").to_pylist(), lanes, [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity; two empty ones are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    if not len(a):
        return True
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def _compare(most: int, least: float, within: bool = False):
    """Links of pivots with texts, or of texts of one pack: only enough of them to join all that belong together."""

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                keys, lanes, sets = _unpacked(one.column(0))
                n = len(keys)
                if not within:
                    more = _unpacked(one.column(1))
                    keys, lanes, sets = keys + more[0], np.concatenate((lanes, more[1])), sets + more[2]
                root = np.arange(len(keys))
                out = []
                for k in range(n):
                    start = k + 1 if within else n
                    near = start + np.flatnonzero(np.bitwise_count(lanes[start:] ^ lanes[k]).sum(axis=1) <= most)
                    for j in near.tolist():
                        if root[j] != root[k] and (keys[j] == keys[k] or alike(sets[k], sets[j], least)):
                            root[root == root[j]] = root[k]
                            if keys[j] != keys[k]:
                                out.append((keys[k], keys[j]))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=["a", "b"])

    return each


def verified(packed: DataFrame, light: DataFrame, most: int, least: float) -> DataFrame:
    """(node, cluster): the components of the pairs of a candidate group within `most` bits and with at least that Jaccard
    similarity. packed(root, pack, packs, texts: array of key, lanes, shingles), light(root, key, packs, bytes).

    A group of one pack is decided in one row. Of a larger one a pivot is compared with its whole group; what isn't joined
    to the first pivot's cluster gives the next pivots, ever more of them, until each text outside that cluster has been
    compared with all of its group. So every pair is decided, and a group of many copies of one text takes a few passes and
    not all its pairs. A large group's packs are spread over tasks.
    """
    one = F.struct("key", "lanes", "shingles")
    edges = written(packed.where("packs = 1").select("texts").mapInArrow(_compare(most, least, True), "a string, b string"), "links")
    light = light.where("packs > 1")
    first = light.groupBy("root").agg(F.min("key").alias("main"))
    done, found = None, components(edges).withColumnRenamed("root", "cluster")
    for turn in (*PIVOTS, None):
        if done is None:
            open_ = light.join(first, "root").where("key = main").drop("main")
        else:
            home = light.join(found, F.col("key") == F.col("node"), "left").select("root", "key", "packs", "bytes", F.coalesce("cluster", "key").alias("cluster"))
            heart = home.join(first.withColumnRenamed("root", "r"), (F.col("r") == F.col("root")) & (F.col("main") == F.col("key"))).select("root", F.col("cluster").alias("heart"))
            open_ = home.join(heart, "root").where("cluster <> heart").select("root", "key", "packs", "bytes").join(done, "key", "left_anti")
            if turn:
                open_ = open_.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy("key"))).where(F.col("k") <= turn).drop("k")
        # pivots travel in blocks of a bounded size to each pack of their group
        size = open_.groupBy("root").agg((F.floor(F.sum(F.col("bytes") + 64) / PACK) + 1).cast("int").alias("blocks"))
        pivots = written(open_.join(size, "root").select("root", "key", "packs", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int").alias("block")), "pivots")
        if pivots.isEmpty():
            return found
        texts = packed.where("packs > 1").select(F.inline("texts"))
        blocks_ = pivots.join(texts, "key").groupBy("root", "packs", "block").agg(F.collect_list(one).alias("pivots"))
        sent = blocks_.withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1))).drop("packs").join(packed, ["root", "pack"]).select("pivots", "texts")
        edges = edges.unionByName(written(sent.mapInArrow(_compare(most, least), "a string, b string"), "links"))
        done = pivots.select("key") if done is None else done.unionByName(pivots.select("key"))
        found = components(edges).withColumnRenamed("root", "cluster")
    return found


def clusters(docs: DataFrame, words: int = STAGE_WORDS, least: float = SIMILARITY, **how) -> DataFrame:
    """docs(doc_id, key, text), key the same for equal texts only -> (key, first_id, m rows with that id, n rows, cluster) for each distinct text:
    clusters of texts linked by fingerprints and by the exact Jaccard similarity of their sets of shingles."""
    lanes, most = how["lanes"], how["most"]
    cols = [f"lane{k}" for k in range(lanes)]
    sized = docs.select("doc_id", "key", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), "text")
    prints = fingerprints(sized, words, lanes, True, "key", "bytes").withColumn("fingerprint", name(lanes))
    each = prints.groupBy("key", "fingerprint", "bytes", *cols, "doc_id").agg(F.count("*").alias("m"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "m"))
    nodes = each.groupBy("key", "fingerprint", "bytes", *cols).agg(first.alias("f"), F.sum("m").alias("n"))
    nodes = written(nodes.select("key", "fingerprint", "bytes", *cols, F.col("f.doc_id").alias("first_id"), F.col("f.m").alias("m"), "n"), "nodes")
    linked = groups(nodes.select(*cols).distinct(), lanes, how["radius"], how["parts"], most)
    # groups are candidates only: a hash names them
    rooted = nodes.join(linked, F.col("fingerprint") == F.col("node"), "left").select("key", F.xxhash64(F.coalesce("root", "fingerprint")).alias("root"), "first_id", "m", "n", "bytes", F.array(*cols).alias("lanes"))
    rooted = written(rooted, "rooted")
    found = decided(rooted, docs, words, most, least)
    return rooted.join(found, F.col("key") == F.col("node"), "left").select("key", "first_id", "m", "n", F.coalesce("cluster", "key").alias("cluster"))


def decided(rooted: DataFrame, docs: DataFrame, words: int, most: int, least: float) -> DataFrame:
    """(node, cluster) for texts with a link: rooted(key, root, first_id, bytes, lanes) names each text's candidate group by
    root, docs(doc_id, key, text) has the texts; see `verified`."""
    shared = rooted.groupBy("root").agg(F.count("*").alias("texts"), (F.floor(F.sum(F.col("bytes") + 64) / PACK) + 1).cast("int").alias("packs")).where("texts > 1")
    candidates = written(rooted.join(shared, "root").select("root", "packs", F.pmod(F.xxhash64("key"), F.col("packs")).cast("int").alias("pack"), "key", "first_id", "bytes", "lanes"), "candidates")
    # the texts of candidates, one row for each
    texts = docs.select(F.col("key").alias("k"), F.col("doc_id").alias("d"), "text")
    # candidates grow with the input, so they are never broadcast
    wanted = candidates.hint("merge").join(texts, (F.col("key") == F.col("k")) & F.col("first_id").eqNullSafe(F.col("d"))).select("root", "pack", "packs", "key", "lanes", "text").dropDuplicates(["key"])

    def sets(batches):
        for b in blocks(batches, "text"):
            h, at = sets_of(b.column(5), words)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], names=["root", "pack", "packs", "key", "lanes", "shingles"])

    members = wanted.mapInArrow(sets, "root long, pack int, packs int, key string, lanes array<long>, shingles array<long>")
    packed = written(members.groupBy("root", "pack", "packs").agg(F.collect_list(F.struct("key", "lanes", "shingles")).alias("texts")), "packs")
    return verified(packed, candidates.select("root", "key", "packs", "bytes"), most, least)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents -> documents with one row of each group of near copies.

    Texts are near copies at a Jaccard similarity of at least 0.8 of their sets of five-word shingles, and so on from text to
    text. Groups are of texts: ids play no part in them. The row with the smallest doc_id stays (null ids last, then by
    digest of the text; of rows equal in both, one). Null texts count as empty, and all texts without a word are one group;
    texts of under five words are near copies if their words are the same; rows with a null or a shared doc_id are judged by
    their texts. Columns may have any names. An empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # 128 bits of SHA-256
    digest = F.substring(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256), 1, 32)
    keyed = docs.select(row.alias("row"), F.col("doc_id"), digest.alias("key"), F.col("text"))
    found = written(clusters(keyed.select("doc_id", "key", "text"), **STAGE), "clusters")
    best = found.groupBy("cluster").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("b"), F.count("*").alias("texts"))
    # most texts have one row and no near copy: only the others are joined
    judged = found.join(best, "cluster").where("n > 1 OR texts > 1").select(F.col("key").alias("k"), "first_id", "m", "n", (F.col("key") == F.col("b.key")).alias("stays"))
    judged = written(judged, "judged")
    rows = keyed.select("row", "key", "doc_id").join(judged.hint("merge"), F.col("key") == F.col("k"), "left")
    mine = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("first_id"))
    kept = rows.where(F.col("k").isNull() | (mine & (F.col("m") == 1))).select("row")
    if not judged.where("stays AND m > 1").isEmpty():
        # rows that repeat both id and text: one of them
        plain = [f"row.`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        # combined before the shuffle: a text of very many rows sends one from each task
        several = rows.where(mine & (F.col("m") > 1)).groupBy("key").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
        kept = kept.unionByName(several.select("row"))
    return kept.select("row.*")
