"""Ranked lexical search by dense blocked matrix products.

Terms are the maximal runs of ASCII letters and digits and of characters above ASCII,
A-Z lower-cased.  A term's weight comes from the number of documents that hold it, a
document's factor m from its length; a document's impact for a term is
``w * ((10**9 * tf) div (1000 * tf + 20 * m))``, and its score for an item is the sum
of the impacts of the item's distinct terms.  All of it is integer arithmetic.

Items.  The searched items go in blocks of at most ``block_terms`` term places (an
item with more is a block of its own), so what is broadcast has a bound that does not
depend on their number.  A block's compact vocabulary is the set of its items' terms;
the block is a dense 0/1 matrix, items times vocabulary, cut into tiles of
``tile_terms`` columns.

Statistics.  One pass per block over all whole texts counts documents, terms and, for
the block's terms, the documents that hold them: bounded partial counts per task,
added up by Spark.

Scores.  A second pass turns batches of documents into dense impact tiles, documents
times vocabulary tile, in float64, and multiplies them by the item tiles through BLAS.
Every entry is a whole number; the largest possible sum of a tile is checked to stay
below 2**53, so each product is exact in whatever order BLAS adds, and tiles are added
up as 64-bit integers.

Top k.  A task keeps, for each item, the rows that rank among its ``k`` best by (score
down, doc_id up, nulls last): a row tied with the k-th score is never dropped before
its id is compared.  The tasks' rows meet in one window per item, over at most ``k``
rows from each task.

Defined cases: null and empty texts have no terms; documents without terms count
nowhere and are never found; an item without terms finds nothing; rows that repeat, or
share an id, are documents of their own and may both be ranked; items that share an
id are ranked each; an empty table on either side gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, stage

# A-Z to a-z; ASCII characters that are neither letters nor digits to spaces.  All
# bytes of characters above ASCII stay, so UTF-8 text splits as its characters would.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_EXACT = 1 << 53


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, all_terms: int) -> int:
    return 100 - 50 + (50 * n * n_docs) // all_terms


def compact(items: list[tuple[int, list[bytes]]]) -> dict:
    """A block of items (key, distinct terms), ready to be broadcast: keys, the compact
    vocabulary, and the places (item row, vocabulary column) of the 0/1 matrix."""
    of = {t: i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    at = [(row, of[t]) for row, (_, ts) in enumerate(items) for t in ts]
    return {"keys": np.array([key for key, _ in items], np.int64), "of": of, "at": np.array(at, np.int64).reshape(-1, 2)}


def tiles_of(block: dict, tile_terms: int) -> list[np.ndarray]:
    """The 0/1 matrix, vocabulary tile times items."""
    n, row, col = len(block["of"]), block["at"][:, 0], block["at"][:, 1]
    out = []
    for start in range(0, n, tile_terms):
        tile, mine = np.zeros((min(tile_terms, n - start), len(block["keys"]))), col // tile_terms == start // tile_terms
        tile[col[mine] - start, row[mine]] = 1
        out.append(tile)
    return out


def _item_blocks(items: DataFrame, block_terms: int):
    """Blocks of items, one at a time on the driver, each of at most ``block_terms`` term
    places or of one item."""

    def run(batches):
        for b in batches:
            rows = [(key, t) for key, text in zip(b["key"], b["text"]) if (t := sorted(set(terms(text))))]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "terms"])

    distinct = stage(items.select("key", "text").mapInPandas(run, "key long, terms array<binary>"), "items")
    block, size = [], 0
    for r in distinct.orderBy("key").toLocalIterator():
        if block and size + len(r.terms) > block_terms:
            yield compact(block)
            block, size = [], 0
        block.append((r.key, [bytes(t) for t in r.terms]))
        size += len(r.terms)
    if block:
        yield compact(block)


def _statistics(texts: DataFrame, shared, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and the documents that hold each of the
    block's terms."""

    def run(batches):
        of, n_docs, total = shared.value["of"], 0, 0
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            for text in b["text"]:
                words = terms(text)
                n_docs, total = n_docs + bool(words), total + len(words)
                held = [i for w in set(words) if (i := of.get(w)) is not None]
                df[held] += 1
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.concatenate([[-2, -1], some]), "n": np.concatenate([[n_docs, total], df[some]])})

    sums = texts.mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = dict(sums.toLocalIterator())  # at most two rows more than the block has terms
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(i, 0) for i in range(n_terms)], np.int64)


def keep_best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best rows of each item, by score down and id up, rows
    without an id last."""
    order = np.lexsort((doc, missing, -score, item))
    sorted_item = item[order]
    start = np.searchsorted(sorted_item, sorted_item, "left")
    return order[np.arange(len(order)) - start < k]


def _scores(texts: DataFrame, shared, stats, k: int, tile_terms: int) -> DataFrame:
    n_docs, all_terms, df = stats
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    most = int(weights.max(initial=0)) * (10 ** 9 // 1000)  # of one impact
    if most * min(tile_terms, len(df)) >= _EXACT:
        raise ArithmeticError("tile_terms allows sums beyond 2**53: take a smaller tile")

    def run(batches):
        block = shared.value
        of, tiles = block["of"], tiles_of(block, tile_terms)
        bound = np.zeros(len(block["keys"]), np.int64)  # the k-th score so far
        kept = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]
        waiting: list[list] = [[], [], [], []]

        def merge():
            nonlocal kept, waiting
            item, score, doc, missing = (np.concatenate([a, *w]) for a, w in zip(kept, waiting))
            best = keep_best(item, score, doc, missing, k)
            kept, waiting = [a[best] for a in (item, score, doc, missing)], [[], [], [], []]
            count = np.bincount(kept[0], minlength=len(bound))
            full = np.flatnonzero(count >= k)
            if len(full):
                least = np.full(len(bound), np.iinfo(np.int64).max)
                np.minimum.at(least, kept[0], kept[1])
                bound[full] = least[full]

        for b in batches:
            ids = pd.to_numeric(b["doc_id"]).to_numpy() if b["doc_id"].notna().all() else None
            missing = b["doc_id"].isna().to_numpy()
            doc = ids.astype(np.int64) if ids is not None else np.array([0 if x is None else int(x) for x in b["doc_id"]], np.int64)
            rows, cols, tf, m = [], [], [], []
            for row, text in enumerate(b["text"]):
                words = terms(text)
                if not words:
                    continue
                factor = length_factor(len(words), n_docs, all_terms)
                found = Counter([i for w in words if (i := of.get(w)) is not None])
                rows += [row] * len(found)
                cols += found
                tf += found.values()
                m += [factor] * len(found)
            if not rows:
                continue
            rows, cols = np.array(rows), np.array(cols)
            tf, m = np.array(tf, np.int64), np.array(m, np.int64)
            impact = weights[cols] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            total = np.zeros((len(doc), len(bound)), np.int64)
            for t, tile in enumerate(tiles):
                mine = cols // tile_terms == t
                if mine.any():
                    dense = np.zeros((len(doc), len(tile)))
                    dense[rows[mine], cols[mine] - t * tile_terms] = impact[mine]
                    total += (dense @ tile).astype(np.int64)
            row, item = np.nonzero((total > 0) & (total >= bound))
            for into, values in zip(waiting, (item, total[row, item], doc[row], missing[row])):
                into.append(values)
            if sum(map(len, waiting[0])) > 4 * k * len(bound):
                merge()
        merge()
        if len(kept[0]):
            yield pd.DataFrame({"key": block["keys"][kept[0]], "score": kept[1],
                                "doc_id": [None if gone else str(d) for d, gone in zip(kept[2], kept[3])]})

    best = texts.mapInPandas(run, "key long, score long, doc_id string").withColumn("doc_id", F.col("doc_id").cast("long"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", k: int = 50,
                  block_terms: int = 100_000, tile_terms: int = 2048) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(id_text(id_col), F.col(text_col).cast("string").alias("text"))
    keyed = stage(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
                  .withColumn("key", F.monotonically_increasing_id()), "keyed-items")
    found = []
    for block in _item_blocks(keyed, block_terms):
        shared = spark.sparkContext.broadcast(block)
        stats = _statistics(texts, shared, len(block["of"]))
        if stats[0]:
            found.append(stage(_scores(texts, shared, stats, k, tile_terms), "search-block"))
        shared.unpersist()
    none = keyed.limit(0).select("key", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("rank"))
    best = found[0] if found else none
    for more in found[1:]:
        best = best.union(more)
    return best.join(keyed.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
