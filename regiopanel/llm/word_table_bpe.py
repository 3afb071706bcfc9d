"""BPE encoding and decoding through a table of distinct words.

Split.  A text is cut at the vocabulary's added tokens, each stretch is normalised
(NFC, white space, lower case) and split into words by the vocabulary file's own
pattern.  Stretches of ASCII and Latin letters take an equal, faster way; all others
go through the file's normaliser and splitter.

Word table.  A task turns its texts into blocks: the distinct words of some documents
(about ``block_size`` words of text, or one longer document), and for every place of a
text the number of its word in that list.  A block's words are dealt to ``buckets`` by
their hash.  All blocks' words of a bucket meet in one task, which keeps the bucket's
part of the word table and encodes each distinct word once, by the file's BPE model.
A word that holds a third of all places is shuffled once per block, not once per place.

Ids by position.  The ids of a block's words are joined back to the block; they are in
the order of its word list, so every place of a text takes the ids at its number.  The
texts are split again for this instead of being staged; a block's key is its task and
its place there, and the join fails loudly if its words are not as many as before.

Decoding.  Ids are joined with the id-to-piece table on the map side: it has as many
rows as the vocabulary, whatever the corpus, and is broadcast.  An id that it lacks is
skipped, as the library does.  The vocabulary file names no decoder, so the pieces are
joined by one space each.

Memory: a task holds one block and, while encoding, the distinct words of the buckets
it got; raise ``buckets`` with the corpus.

Defined cases: null and empty texts have no ids and decode to the empty text; texts
of any length are encoded whole; rows that repeat are encoded each; null ids are kept;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, kept_in_worker, stage
from .packing import public_vocabulary

# Code points on which Python's str methods and the library agree: ASCII, Latin-1
# letters and Latin Extended-A and -B, without the white space of Latin-1.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7e\\xa1-\\u012f\\u0132-\\u024f]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# The signs of that range that Python counts as numeric or alphabetic
# otherwise than by the categories L and N.
_ODD = re.compile("[ª²³¹º¼-¾]")


class WordSplitter:
    """Words and added tokens of a text, as the vocabulary file splits it."""

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        assert not any(t[k] for t in spec["added_tokens"] for k in ("normalized", "single_word", "lstrip", "rstrip"))
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")

    def plain_words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and not _ODD.search(text) and unicodedata.is_normalized("NFC", text):
            return _SPLIT.findall(text.lower())
        return [w for w, _ in self.words.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def split(self, text: str | None) -> list[str]:
        """The words; an added token comes as its own content, which no word equals."""
        if not text:
            return []
        if "<|" not in text:
            return self.plain_words(text)
        parts = self.cut.split(text)
        return [w for i, p in enumerate(parts) if p for w in ([p] if i % 2 else self.plain_words(p))]

    def encode(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        return [t.id for p, _ in self.bytes.pre_tokenize_str(word) for t in self.tokenizer.model.tokenize(p)]


def _splitter(vocabulary: str) -> WordSplitter:
    return kept_in_worker(f"words_of_{vocabulary}", lambda: WordSplitter(public_vocabulary(vocabulary)))


class _Numbering(dict):
    """Words to their numbers, in the order of their first place."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _blocks(batches, split, buckets: int, block_words: int, block_docs: int = 4096):
    """(doc ids, words of each document, codes, word lists by bucket) of each block; a
    code is the word's number in the bucket lists one behind the other."""
    ids, lengths, codes, of, size = [], [], [], _Numbering(), 0

    def finish():
        words = list(of)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(words), np.int32)
        number[order] = np.arange(len(words), dtype=np.int32)
        lists, ends = [], np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        for start, end in zip([0, *ends[:-1]], ends):
            lists.append((int(bucket[order[start]]), [words[i] for i in order[start:end]]))
        return ids, lengths, number[np.concatenate(codes)] if size else np.empty(0, np.int32), lists

    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            found = split(text)
            if ids and (size + len(found) > block_words or len(ids) == block_docs):
                yield finish()
                ids, lengths, codes, of, size = [], [], [], _Numbering(), 0
            ids.append(doc)
            lengths.append(len(found))
            if found:
                codes.append(np.fromiter(map(of.__getitem__, found), np.int32, len(found)))
            size += len(found)
    if ids:
        yield finish()


def _block_key(at: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) + at


def _batch(schema: list, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


_WORDS = [("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.string())]
_IDS = [("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("ids", pa.binary())]
_CODES = [("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary())]


def _packed(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.astype("<i4").tobytes() for a in arrays), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i4")


def block_words(texts: DataFrame, vocabulary: str, buckets: int, size: int) -> DataFrame:
    """(block, bucket, words): each block's distinct words, joined by line breaks, which
    no word holds."""

    def run(batches):
        for at, (_, _, _, lists) in enumerate(_blocks(batches, _splitter(vocabulary).split, buckets, size)):
            if lists:
                yield _batch(_WORDS, [_block_key(at)] * len(lists), [k for k, _ in lists], ["\n".join(w) for _, w in lists])

    return texts.mapInArrow(run, "block long, bucket int, words string")


def word_ids(words: DataFrame, vocabulary: str, buckets: int) -> DataFrame:
    """(block, bucket, n, ids) of ``words``: each distinct word is encoded once, by the
    task that has its bucket; ``ids`` packs the words' lengths in ids, then their ids."""

    def run(batches):
        splitter, table = _splitter(vocabulary), {}
        for b in batches:
            out = []
            for block, bucket, joined in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "words"))):
                found = joined.split("\n")
                for w in found:
                    if w not in table:
                        table[w] = np.array(splitter.encode(w), np.int32)
                ids = [table[w] for w in found]
                out.append((block, bucket, len(ids), _packed(np.array([len(x) for x in ids]), *ids)))
            if out:
                yield _batch(_IDS, *zip(*out))

    return words.repartition(buckets, "bucket").mapInArrow(run, "block long, bucket int, n int, ids binary")


def coded_blocks(texts: DataFrame, vocabulary: str, buckets: int, size: int) -> DataFrame:
    """(block, docs, lengths, codes): the documents of each block with their words'
    numbers in the block's word list."""

    def run(batches):
        for at, (ids, lengths, codes, _) in enumerate(_blocks(batches, _splitter(vocabulary).split, buckets, size)):
            yield _batch(_CODES, [_block_key(at)], [ids], [lengths], [_packed(codes)])

    return texts.mapInArrow(run, "block long, docs array<long>, lengths array<int>, codes binary")


def _take_ranges(flat: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges ``at`` of ``flat``, one behind the other, and where each ends."""
    starts = np.cumsum(lengths) - lengths
    n = lengths[at]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json",
           buckets: int | None = None, block_size: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = stage(word_ids(block_words(texts, vocabulary, buckets, block_size), vocabulary, buckets), "word-ids")
    lists = known.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "ids"))).alias("w")) \
        .select(F.col("block").alias("of"), F.col("w.n").alias("n"), F.col("w.ids").alias("ids"))
    coded = coded_blocks(texts, vocabulary, buckets, block_size)

    def run(batches):
        none = np.empty(0, np.int32)
        for b in batches:
            for row in range(b.num_rows):
                docs_, codes = b.column("docs").slice(row, 1).flatten(), _unpacked(b.column("codes")[row].as_py())
                lengths = b.column("lengths").slice(row, 1).flatten().to_numpy()
                sizes, flat = [none], [none]
                for n, data in zip(b.column("n")[row].as_py() or (), b.column("ids")[row].as_py() or ()):
                    packed = _unpacked(data)
                    sizes.append(packed[:n])
                    flat.append(packed[n:])
                sizes, flat = np.concatenate(sizes), np.concatenate(flat)
                if codes.max(initial=-1) + 1 != len(sizes):
                    raise RuntimeError("the texts changed between the two passes")
                ids, ends = _take_ranges(flat, sizes, codes)
                after = np.concatenate([[0], ends])[np.cumsum(lengths)]
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], after]).astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([docs_, out], ["doc_id", "ids"])

    joined = coded.join(lists, F.col("block") == F.col("of"), "left").select("docs", "lengths", "codes", "n", "ids")
    return joined.mapInArrow(run, "doc_id long, ids array<int>")


def piece_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(id, piece) of a vocabulary file: as many rows as it has ids."""
    rows = sorted((i, p) for p, i in _splitter(vocabulary).tokenizer.get_vocab(with_added_tokens=True).items())
    return spark.createDataFrame(rows, "id int, piece string")


def decode(encoded: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """``encoded``(doc_id, ids) with the decoded ``text``, through a join with the
    id-to-piece table on the map side."""
    spark = encoded.sparkSession
    pieces = dict(piece_table(spark, vocabulary).collect())  # one row per id of the vocabulary
    table = spark.sparkContext.broadcast([pieces.get(i) for i in range(max(pieces, default=-1) + 1)])

    def run(batches):
        known = pa.array(table.value, pa.string())
        for b in batches:
            ids = b.column("ids")
            flat, ends = ids.flatten().to_numpy(), np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))
            inside = (flat >= 0) & (flat < len(known))
            found = known.take(pa.array(np.where(inside, flat, 0)))
            there = inside & found.is_valid().to_numpy(zero_copy_only=False)
            if not there.all():  # ids that the vocabulary lacks
                found = found.filter(pa.array(there))
                ends = np.concatenate([[0], np.cumsum(there)])[ends]
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), found), " ")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, text], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")) \
        .mapInArrow(run, "doc_id long, ids array<int>, text string")


def encode_and_decode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", **options) -> DataFrame:
    """Digests of every text's ids and of the text that they decode to: doc_id,
    n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, vocabulary=vocabulary, **options), vocabulary)
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))
