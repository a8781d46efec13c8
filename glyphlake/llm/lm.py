"""Language-model scores from sharded Elias-Fano n-gram tries (eliasfano.Trie).

The model is a trigram model (ORDER) with absolute discounting, interpolated with the bigram's and that with the additive
unigram base: p(w | h) = max(c(h w) - d, 0) / c(h) + d n(h) / c(h) p(w | h less its first word); c(h) counts h as a context. A
context never seen leaves the lower order. Probabilities are quantised to 8 bits. The first token's context is a start mark,
and it has no longer one; every text ends with an end token.

1. Texts are cut into blocks inside Arrow batches. A block's distinct n-grams of each length, with their counts in training
   texts, go to the shards of their context (all words but the last) as one packed row for each shard.
2. A shard adds up its rows, builds the trie of its contexts and their successors and stores it, and answers each block's rows
   from the trie. As shards go by whole contexts, a common word's trigrams are spread over many.
3. The answers go back to their blocks, which are made again from the texts; a checksum shows that they are the same.

Nothing is broadcast but four numbers, and no task holds more than a block or a shard; each order has four times
spark.sql.shuffle.partitions shards. A very common word has as many bigrams in its shard as it has different successors.
Words are known by 64 bits of their hash where they are counted, contexts of two words by 48 and successors within a context by 36.
A context never meets those of other shards, nor a successor those of other contexts.

Nulls, empties, ties: a null or empty text is one end token; a null doc_id has checksum 0, so it is held out; repeated rows
count as often as they occur. An empty table gives an empty result. With no training text every base probability is 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_of_id, partitions, split_words, table, written
from .eliasfano import Trie, mapped

ORDER = 3
DISCOUNT = 0.75
BLOCK_BYTES = 8 << 20
#: Bits of hashes that are sent for contexts of several words and for successors.
CONTEXT_BITS, WORD_BITS = 48, 36
#: Hashes of the start mark and the end token; a word's hash is XXH64, never one of these but by chance of 2^-63.
START, END = np.uint64((1 << 64) - 1), np.uint64((1 << 64) - 2)


class Level:
    """Distinct n-grams of one length in a block, by context and word: context and word of each, counts in training texts,
    successors of each context, and each token's n-gram (-1: none). A context's key finds its shard, its name is known there."""

    def __init__(self, keys: np.ndarray, names: np.ndarray, context: np.ndarray, token: np.ndarray, trained: np.ndarray, width: int):
        some = np.flatnonzero(context >= 0)
        gram, which = np.unique(context[some] * width + token[some], return_inverse=True)
        self.keys, self.names, self.context, self.word = keys, names, gram // width, gram % width
        self.at = np.full(len(token), -1, np.int64)
        self.at[some] = which
        self.counts = np.bincount(which, weights=trained[some], minlength=len(gram)).astype(np.int64)
        self.children = np.bincount(self.context, minlength=len(keys))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def dealt(shard: np.ndarray, context: np.ndarray, wanted: np.ndarray):
    """(shard, contexts, n-grams): which wanted contexts and which of the n-grams belong to each shard that has any."""
    asked, of = shard[wanted], shard[context]
    by_shard, of_gram = np.argsort(asked, kind="stable"), np.argsort(of, kind="stable")
    some, context_cut = np.unique(asked[by_shard], return_index=True)
    # no n-gram belongs to a shard without a wanted context
    gram_cut = np.searchsorted(of[of_gram], some)
    for k, (c, g) in enumerate(zip(np.split(wanted[by_shard], context_cut[1:]), np.split(of_gram, gram_cut[1:]), strict=True) if len(some) else ()):
        yield int(some[k]), c, g


class Block:
    """Tokens of some texts as numbers of distinct n-grams of 2 to `order` words."""

    def __init__(self, hashes: np.ndarray, token: np.ndarray, first: np.ndarray, train: np.ndarray, order: int):
        """Words and marks are numbered by their hashes, so that those of any selection rise."""
        by_hash = np.argsort(hashes)
        self.hashes, self.first = hashes[by_hash], first
        rank = np.empty_like(by_hash)
        rank[by_hash] = np.arange(len(hashes))
        token, v = rank[token], len(hashes)
        trained = np.repeat(train, np.diff(first)).astype(float)
        self.word_counts = np.bincount(token, weights=trained, minlength=v).astype(np.int64)
        keys, names, at, self.levels = self.hashes, self.hashes, token, []
        for _ in range(order - 1):
            before = np.empty_like(at)
            before[1:] = at[:-1]
            # the start mark has the largest hash
            before[first[:-1]] = -1 if self.levels else v - 1
            level = Level(keys, names, before, token, trained, v)
            self.levels.append(level)
            keys, at = _mixed(level.keys[level.context], self.hashes[level.word]), level.at
            half = np.uint64(64 - CONTEXT_BITS // 2)
            names = (level.keys[level.context] >> half << half) | (self.hashes[level.word] >> half << np.uint64(64 - CONTEXT_BITS))

    def wanted(self, k: int) -> np.ndarray:
        """Contexts of level k that are asked for: all words, longer ones if something follows."""
        return np.arange(len(self.hashes)) if k == 0 else np.flatnonzero(self.levels[k].children)

    def shard(self, k: int, shards: int) -> np.ndarray:
        """Shard of each context of level k: each level has shards of its own."""
        return _narrow((self.levels[k].keys % np.uint64(shards)) + np.uint64(k * shards))


def _pack(*arrays: np.ndarray) -> bytes:
    import pickle

    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes) -> tuple:
    import pickle

    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def _gaps(x: np.ndarray, bits: int = 64) -> np.ndarray:
    """The first bits of hashes as gaps from one to the next, byte by byte; least where hashes rise."""
    gap = np.diff(x >> np.uint64(64 - bits), prepend=np.uint64(0)) & np.uint64((1 << bits) - 1)
    wide = (int(gap.max()).bit_length() + 7) // 8 if len(gap) else 0
    return np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :wide].T)


def _risen(planes: np.ndarray, bits: int = 64) -> np.ndarray:
    gap = np.zeros((planes.shape[1], 8), np.uint8)
    gap[:, : planes.shape[0]] = planes.T
    return np.cumsum(gap.view(np.uint64).reshape(-1), dtype=np.uint64) & np.uint64((1 << bits) - 1)


def _numbered(batches):
    """(block number, record batch, hashes, token, first, mark) of a task's batches: the same again in every run over the
    same input. Tokens are numbered in the order in which words come, then the end and the start."""
    where = TaskContext.get().partitionId() << 24
    for k, b in enumerate(blocks(batches, "text", BLOCK_BYTES)):
        flat, first = split_words(b.column(b.schema.get_field_index("text")))
        coded = flat.dictionary_encode()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        length = np.diff(first)
        token = np.full(len(flat) + len(length), len(hashes), np.int64)
        token[np.arange(len(flat)) + np.repeat(np.arange(len(length)), length)] = np.asarray(coded.indices)
        hashes = np.concatenate((hashes, [END, START]))
        yield where + k, b, hashes, token, np.concatenate(([0], np.cumsum(length + 1))), xxhash.xxh64_intdigest(token.tobytes() + hashes.tobytes()) >> 1


def requests(docs: DataFrame, shards: int, order: int = ORDER) -> DataFrame:
    """docs(text, train) -> (shard, block, mark, asked): distinct words and n-grams of each block, by shard."""

    def each(batches):
        for number, b, hashes, token, first, mark in _numbered(batches):
            block = Block(hashes, token, first, np.asarray(b.column(b.schema.get_field_index("train")).to_numpy(zero_copy_only=False), bool), order)
            for k, level in enumerate(block.levels):
                rows = []
                for s, contexts, grams in dealt(block.shard(k, shards), level.context, block.wanted(k)):
                    after, which = np.unique(level.word[grams], return_inverse=True)
                    counts = block.word_counts[contexts] if k == 0 else np.zeros(0, np.int64)
                    rows.append((s, _pack(_gaps(level.names[contexts], 64 if k == 0 else CONTEXT_BITS), _narrow(counts), _narrow(level.children[contexts]), _gaps(block.hashes[after], WORD_BITS), _narrow(which), _narrow(level.counts[grams]))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array([mark] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "block", "mark", "asked"])

    return docs.select("text", "train").mapInArrow(each, "shard int, block long, mark long, asked binary")


def _asked(data: bytes, words: bool) -> tuple:
    """(contexts, their counts, children, successors, which, counts) of a request."""
    contexts, counts, children, after, which, times = _unpack(data)
    contexts = _risen(contexts, 64 if words else CONTEXT_BITS)
    return contexts, counts if words else np.zeros(len(contexts), np.uint8), children, _risen(after, WORD_BITS), which, times


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(place.reshape(-1), weights=counts, minlength=len(distinct)).astype(np.int64)


def build(asked: list[tuple], discount: float) -> Trie:
    """The trie of one shard's requests."""
    words, counts = _summed(np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked]))
    trained = [a[5] > 0 for a in asked]
    context = np.concatenate([np.repeat(np.searchsorted(words, a[0]), a[2])[t] for a, t in zip(asked, trained, strict=True)])
    word = np.concatenate([a[3][a[4][t]] for a, t in zip(asked, trained, strict=True)])
    number = np.concatenate([a[5][t] for a, t in zip(asked, trained, strict=True)]).astype(np.int64)
    # as one number where it fits, which sorts faster
    order = np.argsort(context.astype(np.uint64) << np.uint64(WORD_BITS) | word) if len(words) < 1 << (64 - WORD_BITS) else np.lexsort((word, context))
    context, word, number = context[order], word[order], number[order]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
    heads = np.flatnonzero(fresh)
    number = np.add.reduceat(number, heads) if len(heads) else number
    return Trie.build(words, counts, context[heads], word[heads], number, discount)


def _used(codes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes into those values of a table that they use."""
    seen = np.zeros(len(book), bool)
    seen[codes] = True
    return (np.cumsum(seen) - 1)[codes].astype(np.uint8), book[seen]


def answers(asked: DataFrame, shards: int, discount: float = DISCOUNT, keep: bool = False) -> DataFrame:
    """requests -> (shard, block, mark, answer), and for each shard a row of block -1: its training tokens and word kinds, and
    its trie as `answer` if the model is to be kept."""

    def each(key, t):
        words = key[0].as_py() < shards
        got = [_asked(x.as_py(), words) for x in t.column("asked")]
        made = build(got, discount)
        # the bytes that are stored are the ones that are searched, from a memory map
        stored = made.to_bytes()
        trie = Trie.read(mapped(stored))
        rows = []
        for number, mark, (contexts, _, children, after, which, _) in zip(t.column("block").to_pylist(), t.column("mark").to_pylist(), got, strict=True):
            at = trie.words.find(contexts)
            count, mass = trie.look(contexts, at)
            rows.append((number, mark, _pack(_narrow(count if words else count[:0]), *_used(mass, trie.mass_book), *_used(trie.fan(contexts, children, after, which, at), trie.book)), 0, 0))
        counts = np.asarray(made.counts, np.int64)
        rows.append((-1, 0, stored if keep else None, int(counts.sum()), int((counts > 0).sum())))
        cols = list(zip(*rows, strict=True))
        return pa.table({"shard": pa.array([key[0].as_py()] * len(rows), pa.int32()), "block": pa.array(cols[0], pa.int64()), "mark": pa.array(cols[1], pa.int64()), "answer": pa.array(cols[2], pa.binary()), "tokens": pa.array(cols[3], pa.int64()), "kinds": pa.array(cols[4], pa.int64())})

    return asked.groupBy("shard").applyInArrow(each, "shard int, block long, mark long, answer binary, tokens long, kinds long")


def score(docs: DataFrame, shards: int | None = None, discount: float = DISCOUNT, order: int = ORDER, keep: bool = False) -> DataFrame:
    """docs(doc_id, text, train) -> doc_id, n_tokens, n_known, train_tokens, base_score, score; learns from rows with train.
    n-grams have 2 to `order` words. With keep the tries stay in the table `trie` of the shared folder."""
    spark = docs.sparkSession
    shards = shards or 4 * partitions(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(answers(requests(docs, shards, order), shards, discount, keep), "trie")
    total = found.where("block = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    n, v = int(total[0]), int(total[1])
    rest = n + 0.1 * (v + 1)

    def tokens(batches):
        for number, b, hashes, token, first, mark in _numbered(batches):
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            data = _pack(hashes, np.ascontiguousarray(token.astype(np.uint32).view(np.uint8).reshape(-1, 4).T), _narrow(np.diff(first)))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([mark], pa.int64()), ids, pa.array([data], pa.binary())], names=["block", "mark", "ids", "tokens"])

    def finish(batches):
        for b in batches:
            for mark, ids, data, parts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                hashes, planes, length = _unpack(data.as_py())
                first = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
                token = np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1).astype(np.int64)
                got = {p["shard"].as_py(): p for p in parts}
                if any(p["mark"].as_py() != mark for p in got.values()):
                    raise RuntimeError("the input changed between two reads")
                block = Block(hashes, token, first, np.zeros(len(length), bool), order)
                for k, level in enumerate(block.levels):
                    left, prob, count = np.ones(len(level.keys)), np.zeros(len(level.context)), np.zeros(len(level.keys))
                    for s, contexts, grams in dealt(block.shard(k, shards), level.context, block.wanted(k)):
                        c, m, mass_book, p, book = _unpack(got[s]["answer"].as_py())
                        mass = mass_book[m]
                        left[contexts], prob[grams] = np.where(mass > 0, mass, 1.0), book[p]
                        if k == 0:
                            count[contexts] = c
                    if k == 0:
                        seen = count[level.word][level.at]
                        known, base = seen > 0, (seen + 0.1) / rest
                        chance = base.copy()
                    some = np.flatnonzero(level.at >= 0)
                    at = level.at[some]
                    chance[some] = prob[at] + left[level.context][at] * chance[some]
                doc = np.repeat(np.arange(len(length)), length)
                per = lambda x: np.bincount(doc, weights=x, minlength=len(length))
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(length.astype(np.int64)), pa.array(per(known).astype(np.int64)), pa.array(np.full(len(length), n)), pa.array(per(np.log10(base))), pa.array(per(np.log10(chance)))], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kept = docs.select("doc_id", "text", "train").mapInArrow(tokens, f"block long, mark long, ids array<{kind}>, tokens binary")
    back = found.where("block >= 0").groupBy(F.col("block").alias("b")).agg(F.collect_list(F.struct("shard", "mark", "answer")).alias("parts"))
    return kept.join(back, F.col("block") == F.col("b")).select("mark", "ids", "tokens", "parts").mapInArrow(finish, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def op6_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32(doc_id) mod 10 isn't 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_of_id(F.col("doc_id")) % 10 != 0).alias("train"))
    return score(docs).select("doc_id", (crc_of_id(F.col("doc_id")) % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
