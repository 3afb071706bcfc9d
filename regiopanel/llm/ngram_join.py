"""Exact n-gram Jaccard self-join with PartEnum signatures.

Sets.  A text's set holds the hashes of its distinct ``n``-word shingles (the
whole word sequence as one when it has fewer words).  Texts with equal sets
collapse into one node first, so a group of copies costs one node.

Signatures.  Sizes are cut into bands of ratio 1/threshold; linked sets lie in
the same or in neighbouring bands, so a set takes part in the instance of its own
band and in that of the band below.  Within an instance, linked sets differ in at
most ``k`` elements (a pair whose smaller set lies in the band).  The hashed domain is
cut into ``n1`` first-level parts.  At least ``1 + slack`` of them hold at most one
difference, as ``n1 = ceil((k + 1) / 2) + slack``.  Each is cut again into three
second-level parts, and every subset of two of them gives one signature: the content of
the set there.  In a first-level part with one difference, the subset that leaves out
the part with the difference is equal in both sets.

A subset that is empty in a set says nothing, and its signature would be shared by
many; it is left out.  That loses nothing while at most ``slack`` first-level parts of
one of the two sets have an empty subset.  A set with more of them also emits a second
family under another seed, and so on; in the last family empty subsets are emitted as
well, which makes the search complete.

Links.  Every member of a signature is compared with the signature's first
member, and verified links are merged into components.  Members whose signature
still spans several components are open: for them a prefix filter makes the
search complete without enumerating a signature's pairs.  Shingles are ordered from
rare to common; sets similar enough share a shingle among the first
``size - ceil(t * size) + 1`` of each, at places that leave enough behind.  Variants
of one text that drifted apart by their own edits have rare shingles there, so they
hardly meet, while sets without rare shingles are near the common text and already
in its component.  Only pairs of different components are compared.

Every comparison is verified on the full sets: 100 * |both| >= 85 * |either|.

Defined cases: null, empty and blank texts have an empty set, size 0, and are
linked with nothing; a row with a null id takes part, but names a component only
as null when no member has an id; rows with the same id are documents of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (ascii_words, bounded_batches, connected_components, drop_stage, fresh_name, id_text, long_id,
                     mix64, ngram_hashes, numbered_rows, small_enough, stage, word_hashes)

_FAMILIES = 4


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``n``-word shingles."""
    h = word_hashes(ascii_words(text))
    if len(h) == 0:
        return h
    return np.unique(ngram_hashes(h, min(n, len(h))))


def band_of(size: int, percent: int) -> int:
    return math.floor(math.log(size) / math.log(100 / percent) + 1e-9)


def _instance(band: int, percent: int) -> tuple[int, int]:
    """(first-level parts, slack) for pairs whose smaller set lies in ``band``."""
    ratio = 100 / percent
    low, high = (math.ceil(ratio ** (band + i) * (1 + 1e-9)) for i in (1, 2))
    # linked sets r, s have |r ^ s| <= (1 - t) / (1 + t) * (|r| + |s|)
    k = (100 - percent) * (low + high) // (100 + percent)
    least = (k + 2) // 2
    if k == 0:
        return 1, 0
    # two second-level parts are empty in a set of the band with probability exp(-2 * size / parts)
    empties = 3 * least * math.exp(-2 * low / ratio / (3 * least))
    slack = math.ceil(empties + 1.5 * math.sqrt(empties))
    return least + slack, slack


def _content(part: np.ndarray, values: np.ndarray, parts: int) -> np.ndarray:
    """The sum of the values in each part, modulo 2**64 (the halves' sums are exact)."""
    low = np.bincount(part, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), parts).astype(np.uint64)
    high = np.bincount(part, (values >> np.uint64(32)).astype(np.float64), parts).astype(np.uint64)
    return low + (high << np.uint64(32))


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """64-bit PartEnum signatures of a set, for both instances of its band."""
    if len(elements) == 0:
        return np.empty(0, np.uint64)
    band, out = band_of(len(elements), percent), []
    for instance in (band - 1, band):
        n1, slack = _instance(instance, percent)
        for family in range(_FAMILIES):
            tag = mix64(np.uint64([(instance + 2) * 2 * _FAMILIES + family + 1]))[0]
            h = mix64(elements ^ tag)
            part = ((h >> np.uint64(32)) * np.uint64(3 * n1) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(part, minlength=3 * n1).reshape(n1, 3)
            content = _content(part, mix64(h + tag), 3 * n1).reshape(n1, 3)
            place = mix64(np.arange(n1, dtype=np.uint64) + tag)
            lacking = np.zeros(n1, bool)
            for left_out in range(3):
                i, j = (x for x in range(3) if x != left_out)
                empty = count[:, i] + count[:, j] == 0
                sig = mix64(mix64(content[:, i] + place) * np.uint64(0x9E3779B97F4A7C15) + content[:, j] + np.uint64(left_out))
                out.append(sig if family == _FAMILIES - 1 else sig[~empty])
                lacking |= empty
            if lacking.sum() <= slack:
                break
    return np.concatenate(out)


_SET = ["n_shingles", "set_a", "set_b"]


def _identity(elements: np.ndarray) -> tuple[int, int, int]:
    """Size and two 64-bit sums that tell sets apart."""
    other = mix64(elements ^ np.uint64(0x5851F42D4C957F2D))
    return (len(elements), int(mix64(elements).sum(dtype=np.uint64).view(np.int64)),
            int(other.sum(dtype=np.uint64).view(np.int64)))


def _sets(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sigs) for every row."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, n) for t in b["text"]]
            out = pd.DataFrame([_identity(s) for s in sets], columns=_SET)
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out.assign(sigs=[signatures(s, percent).view(np.int64) for s in sets])

    return long_id(texts.mapInPandas(run, "doc_id string, n_shingles long, set_a long, set_b long, sigs array<long>"))


def _elements(texts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, elems): the sorted set of each node, from a text that has it."""

    def run(batches):
        for b in batches:
            rows = []
            for node, size, set_a, set_b, text in zip(b["node"], b["n_shingles"], b["set_a"], b["set_b"], b["text"]):
                s = shingle_set(text, n)
                if _identity(s) == (size, set_a, set_b):  # ids may repeat with other texts
                    rows.append((node, s.view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "elems"])

    ids = small_enough(nodes.withColumn("id", F.col("doc_id").cast("string")).drop("doc_id"))
    found = stage(texts.join(ids, texts.doc_id.eqNullSafe(ids.id)).select("node", *_SET, "text")
                  .mapInPandas(run, "node long, elems array<long>"), "elements")
    if found.count() > found.select("node").distinct().count():  # rows that repeat, text and id
        found = stage(found.dropDuplicates(["node"]), "elements")
    return found


def _verified(pairs: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    both = pairs.join(elements.select(F.col("node").alias("a"), F.col("elems").alias("ea")), "a") \
        .join(elements.select(F.col("node").alias("b"), F.col("elems").alias("eb")), "b")
    common = F.size(F.array_intersect("ea", "eb"))
    either = F.size("ea") + F.size("eb") - common
    return both.where(common * 100 >= either * percent).select("a", "b")


def _may_link(size_a: str, size_b: str, percent: int) -> F.Column:
    """Sizes alone allow the similarity."""
    return F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent


def _first_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each member of a signature with the signature's smallest node."""
    first = members.groupBy("sig").agg(F.min("node").alias("a"), F.min_by("size", "node").alias("size_a"))
    return members.join(first, "sig").where("node <> a").where(_may_link("size_a", "size", percent)) \
        .select("a", F.col("node").alias("b")).distinct()


def _prefixes(members: DataFrame, elements: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """(e, node, size, behind): the prefix shingles that open nodes share.
    ``behind`` is how many shingles of the set come after this one."""
    m = members.join(components, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    spans = m.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("sig")
    open_nodes = stage(m.join(spans, "sig", "left_semi").select("node", "size").distinct(), "open-nodes")
    rows = stage(elements.join(open_nodes.select("node"), "node").select("node", F.explode("elems").alias("e")), "open-shingles")
    # Shingles of one node only come first in its order and meet nobody.
    common = stage(rows.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared-shingles")
    order = Window.partitionBy("node").orderBy(F.desc("df"), F.desc("e"))
    ranked = rows.join(common, "e").withColumn("behind", F.row_number().over(order) - 1)
    prefix = stage(ranked.join(open_nodes, "node").where(F.col("behind") >= F.ceil(F.col("size") * percent / 100) - 1)
                   .select("e", "node", "size", "behind"), "prefixes")
    drop_stage(rows)
    return prefix


def _prefix_pairs(prefix: DataFrame, partners: DataFrame, components: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components with a prefix shingle in common, at places that
    leave enough behind, not compared yet."""
    comp = F.coalesce("component", "node").alias("comp")
    mine = prefix.join(components, "node", "left").select("e", "node", "size", "behind", comp)
    other = partners.join(components, "node", "left").select("e", "node", "size", "behind", comp) \
        .withColumnsRenamed({c: c + "_b" for c in ("node", "size", "behind", "comp")})
    at_most = F.least("behind", "behind_b") + 1  # common shingles, if this one is the first of them
    enough = at_most * (100 + percent) >= (F.col("size") + F.col("size_b")) * percent
    return mine.join(other, "e").where("node <> node_b and comp <> comp_b").where(enough) \
        .select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4,
                             percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id
    reachable by links of Jaccard similarity ``percent``/100 or more)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(id_text(id_col), F.col(text_col).alias("text"))
    sets = stage(_sets(texts, n, percent).withColumn("row", F.monotonically_increasing_id()), "sets")

    # Copies: one node for each distinct set, numbered by its first row.
    nodes = stage(sets.where("n_shingles > 0").groupBy(*_SET)
                  .agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "nodes")
    members, sets = _candidates(sets, nodes)
    wanted = members.select("node").distinct().join(sets.withColumnRenamed("row", "node"), "node")
    elements = _elements(texts, stage(wanted, "candidate-nodes"), n)

    tried = stage(_first_pairs(members, percent), "pairs")
    links = stage(_verified(tried, elements, percent), "links")
    components = connected_components(links)
    prefix = _prefixes(members, elements, components, percent)
    first = prefix.groupBy("e").agg(F.max_by(F.struct("node", "size", "behind"), F.struct("behind", -F.col("node"))).alias("f")).select("e", "f.*")
    for partners in (first, prefix):  # most links by one partner for each shingle; then all that is still apart
        more = stage(_prefix_pairs(prefix, partners, components, tried, percent), "pairs")
        links = links.union(stage(_verified(more, elements, percent), "links"))
        tried, components = tried.union(more), connected_components(links)
    for done in (members, elements, prefix):
        drop_stage(done)

    named = nodes.join(components, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_set = named.select("comp", *_SET).join(names, "comp").drop("comp")
    return sets.join(of_set, _SET, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                     percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of each component the
    one with the smallest id (a null id loses, then the first row).  Ids may be null or
    repeat, so rows go by their number (``common.numbered_rows``)."""
    row = fresh_name(docs, "row_number_")
    numbered = numbered_rows(docs, row)
    linked = ngram_jaccard_components(numbered, row, text_col, n, percent).select(F.col("doc_id").alias(row), "component_id")
    several = stage(linked.where(F.col(row) != F.col("component_id")).select("component_id").distinct(), "groups")
    ids = numbered.select(row, F.col(id_col).alias("id_"))
    members = stage(linked.join(several, "component_id").join(ids, row), "group-members")
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("id_").isNull(), "id_", row)).alias("best")) \
        .select(F.col(f"best.{row}").alias(row))
    dropped = stage(members.select(row).join(kept, row, "left_anti"), "dropped-rows")
    return numbered.join(small_enough(dropped), row, "left_anti").drop(row)


def _candidates(sets: DataFrame, nodes: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(sig, node, size) of the signatures that two nodes or more have; the sets
    without their signatures, which are removed.  Signatures are dealt to ``rounds`` by
    their value, so that only a part of them is in the shuffles at a time."""
    firsts = sets.select(F.col("row").alias("node"), F.col("n_shingles").alias("size"), "sigs") \
        .join(small_enough(nodes.select("node")), "node")
    members = None
    for turn in range(rounds):
        mine = F.filter("sigs", lambda s: F.pmod(s, F.lit(rounds)) == turn)  # noqa: B023
        rows = firsts.select("node", "size", F.explode(mine).alias("sig"))
        shared = stage(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sig"), "shared-signatures")
        some = stage(rows.join(shared, "sig"), "candidates")
        drop_stage(shared)
        members = some if members is None else members.union(some)
    light = stage(sets.drop("sigs"), "light-sets")
    drop_stage(sets)
    return members, light
