"""Best-fit packing of documents into token sequences by a grouping genetic
algorithm on islands.

Pieces.  A document is its token ids and an end id.  Only documents longer than
``capacity`` are cut, into pieces of ``capacity`` ids; the first piece holds the
remainder.  Full pieces are sequences of their own; the others are items.

Islands.  Items are dealt at random (by hash) into blocks of about ``block_items``.
For each block, ``islands`` populations evolve side by side: a crossover injects
whole well-filled bins of one parent into the other, removes the bins that
now hold duplicates, and best-fits the documents that lost their place; a
mutation empties the least-filled bins and best-fits their documents.  After each
epoch the elites of an island migrate to the next one of the ring.  A population
whose best packing has reached the bound ceil(sum / capacity) stops.  The
solutions of one block travel as arrays of bin numbers, so what a task holds is
bounded by ``block_items``.

Remainder.  Bins that stay below ``full_share`` are opened, and their items are
dealt and packed again together, level by level, until one block holds them all
or nothing is gained; so the loss does not grow with the number of blocks.

Token ids are those of the ``tokenizers`` vocabulary file, an added token in a text
included.  Texts made of ASCII and Latin letters that hold none are encoded by tiktoken
with the same vocabulary, several times as fast and with equal ids; all others by
``tokenizers`` itself.

Defined cases: null and empty texts are the end id alone; texts of any length are
cut as above; rows that repeat are packed each; null ids are kept as they are;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, kept_in_worker, long_id, stage

_OTHER_SCRIPTS = re.compile("[^\\x09\\x0a\\x0d\\x20-\\x7e\\xa1-\\u024f]")


def public_vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_encoding():
    """The vocabulary as a tiktoken encoding."""
    import public_tokenizers
    import tiktoken

    with open(public_vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library_tokenizer():
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))


class Encoder:
    """Ids of ``byte_bpe_50k.json`` without tokens at the ends."""

    def __init__(self):
        self.fast = kept_in_worker("byte_bpe_50k", byte_encoding)

    def ids(self, text: str) -> list[int]:
        if "<|" in text or _OTHER_SCRIPTS.search(text):
            return kept_in_worker("byte_bpe_50k_library", library_tokenizer).encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        encoder = Encoder()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = np.array([*(encoder.ids(text) if text else ()), 0], "<u4")
                rows += [(doc, i, start, length, zlib.crc32(ids[start:start + length].tobytes()))
                         for i, (start, length) in enumerate(cut(len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return long_id(docs.select(id_text(id_col), F.col(text_col).alias("text"))
                   .mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long"))


# --- grouping genetic algorithm on one block of items ---------------------

def best_fit(bins: list[list[int]], items: list[int], size: list[int], capacity: int,
             rng: random.Random | None = None) -> list[list[int]]:
    """Put the items, large ones first, each into the fullest bin that takes it.
    With ``rng`` the order is only roughly by size."""
    bins = [list(b) for b in bins]
    free = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -size[i] * (rng.uniform(0.6, 1) if rng else 1)):
        at = bisect.bisect_left(free, (size[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        bisect.insort(free, (room - size[i], k))
    return bins


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then fuller ones, as squares of their fill."""
    return -len(bins), sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list, b: list, size: list[int], capacity: int, rng: random.Random) -> list:
    fill = sorted(range(len(b)), key=lambda k: -sum(size[i] for i in b[k]))
    well = fill[:max(1, len(b) // 2)]
    injected = [b[k] for k in rng.sample(well, max(1, len(well) // 2))]
    held = {i for x in injected for i in x}
    rest = [x for x in a if not held.intersection(x)]
    displaced = [i for x in a if held.intersection(x) for i in x if i not in held]
    return best_fit(injected + rest, displaced, size, capacity)


def mutate(a: list, size: list[int], capacity: int, rng: random.Random, share: float = 0.1) -> list:
    order = sorted(range(len(a)), key=lambda k: sum(size[i] for i in a[k]) * rng.uniform(0.7, 1.0))
    gone = set(order[:max(3, int(len(a) * share))])
    freed = [i for k in gone for i in a[k]]
    return best_fit([x for k, x in enumerate(a) if k not in gone], freed, size, capacity, rng)


def evolve(size: list[int], elites: list[list], capacity: int, seed: int, population: int, generations: int) -> list[list]:
    """The two best packings after some generations; starts from the elites."""
    rng = random.Random(seed)
    bound = -(-sum(size) // capacity)
    score = lambda p: fitness(p, size, capacity)
    pool = list(elites) or [best_fit([], list(range(len(size))), size, capacity)]
    if len(max(pool, key=score)) <= bound:
        return [max(pool, key=score)]
    while len(pool) < population:
        pool.append(best_fit([], list(range(len(size))), size, capacity, rng))
    for _ in range(generations):
        pool.sort(key=score, reverse=True)
        if len(pool[0]) <= bound:
            break
        parents = pool[:max(2, population // 2)]
        children = []
        while len(children) < population - len(parents):
            x, y = rng.sample(parents, 2)
            child = crossover(x, y, size, capacity, rng)
            children.append(mutate(child, size, capacity, rng) if rng.random() < 0.5 else child)
        pool = parents + children
    pool.sort(key=score, reverse=True)
    return pool[:2]


def _as_numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _as_bins(numbers) -> list[list[int]]:
    out = [[] for _ in range(int(max(numbers, default=-1)) + 1)]
    for i, k in enumerate(numbers):
        out[k].append(i)
    return [b for b in out if b]


_STATE = "block long, island int, items array<long>, sizes array<int>, elites array<array<int>>"


def _epoch(state: DataFrame, capacity: int, epoch: int, population: int, generations: int) -> DataFrame:

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                size = [int(x) for x in r.sizes]
                best = evolve(size, [_as_bins(e) for e in r.elites], capacity,
                              hash((int(r.block), int(r.island), epoch)), population, generations)
                yield pd.DataFrame({"block": [r.block], "island": [r.island], "items": [r.items], "sizes": [r.sizes],
                                    "elites": [[_as_numbers(p, len(size)) for p in best]]})

    return state.mapInPandas(run, _STATE)


def _migrated(state: DataFrame, islands: int) -> DataFrame:
    """Every island also gets the elites of the one before it in the ring."""
    moved = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("elites").alias("more"))
    return state.join(moved, ["block", "island"]).select(
        "block", "island", "items", "sizes", F.concat("elites", "more").alias("elites"))


def _pack_level(items: DataFrame, n_items: int, capacity: int, block_items: int, islands: int, epochs: int,
                population: int, generations: int) -> DataFrame:
    """(item, bin, offset, fill) of every item (item, length)."""
    blocks = max(1, -(-n_items // block_items))
    gathered = items.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")) \
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("neg"), "item"))).alias("x")) \
        .select("block", F.col("x.item").alias("items"), F.transform("x", lambda s: (-s["neg"]).cast("int")).alias("sizes"))
    state = gathered.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "items", "sizes",
                            F.array().cast("array<array<int>>").alias("elites"))
    for epoch in range(epochs):
        state = _epoch(state, capacity, epoch, population, generations)
        if epoch + 1 < epochs:
            state = _migrated(state, islands)

    def best(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                size = [int(x) for x in r.sizes]
                found = max((_as_bins(e) for e in r.elites), key=lambda p: fitness(p, size, capacity))
                rows = []
                for k, members in enumerate(found):
                    offset, fill = 0, sum(size[i] for i in members)
                    for i in members:
                        rows.append((r.items[i], (int(r.block) << 32) + k, offset, fill))
                        offset += size[i]
                yield pd.DataFrame(rows, columns=["item", "bin", "offset", "fill"])

    # The islands of a block meet again: the best of each, at most two packings.
    met = state.groupBy("block").agg(F.first("items").alias("items"), F.first("sizes").alias("sizes"),
                                     F.flatten(F.collect_list("elites")).alias("elites"))
    return met.select("block", "items", "sizes", "elites").mapInPandas(best, "item long, bin long, offset long, fill long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
                   block_items: int = 4000, islands: int = 2, epochs: int = 2, population: int = 8,
                   generations: int = 6, full_share: float = 0.97) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    cut_up = stage(pieces(docs, id_col, text_col, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    todo = cut_up.where(F.col("length") < capacity).select("item", "length")
    n, level, placed = todo.count(), 0, []
    while n:
        packed = stage(_pack_level(todo, n, capacity, block_items, islands, epochs, population, generations), "packed")
        opened = packed.where(F.col("fill") < full_share * capacity)
        left = opened.count() if n > block_items else 0
        last = left == 0 or left > 0.8 * n
        done = packed if last else packed.where(F.col("fill") >= full_share * capacity)
        # level in the upper bits, so that numbers differ between levels
        placed.append(done.select("item", (F.col("bin") + (F.lit(level + 1) * F.lit(1 << 58))).alias("sequence_id"), "offset"))
        if last:
            break
        todo = opened.select("item").join(cut_up.select("item", "length"), "item")
        n, level = left, level + 1
    own = cut_up.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
    if not placed:
        return own.drop("item")
    where = placed[0]
    for more in placed[1:]:
        where = where.union(more)
    fitted = cut_up.where(F.col("length") < capacity).join(where, "item")
    return own.unionByName(fitted).drop("item")
