"""Word-table BPE against the plain library calls."""
import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as E
from regiopanel.llm import word_table_bpe as W

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
SCHEMA = "doc_id long, text string"


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op12_word_table_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = ids_of(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_split_and_encode_equal_the_library():
    splitter, rng = W.WordSplitter(PATH), random.Random(3)
    alphabet = ("abcABC\u00e9\u00c9\u00df\u00f1\u0130\u0131\u01c5\u017f'sSt 12\t\n\r\x0b\x0c\x1c\x85\xa0.,!_-\u00b2\u00bc\u00aa"
                "\u03a3\u03c2\u4f60\u597d\u0338\u0301<|>\U0001d4b3\U0001f642\uac00")
    for _ in range(5000):
        t = "".join(rng.choices(alphabet, k=rng.randrange(25)))
        if rng.random() < 0.2:
            t += rng.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]) + rng.choice(alphabet) + "x"
        assert [i for w in splitter.split(t) for i in splitter.encode(w)] == ids_of(t), repr(t)


def test_gaps_edges_and_any_table_size(spark):
    texts = [None, "", "  ", "one two one", "<|endoftext|>one<|startoftext|>", "\u4f60\u597d \u0301x", "word " * 30000, "q" * 5000,
             "One TWO one", "one two one"]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "one", 0), (3, "one two one", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    want = sorted((str(i), ids_of(t)) for i, t, _ in rows)
    for options in ({}, {"buckets": 1, "block_size": 1}, {"buckets": 40, "block_size": 6}):
        encoded = W.encode(df, **options)
        assert sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect()) == want
        assert {(str(r.doc_id), r.text) for r in W.decode(encoded).collect()} == \
            {(i, LIBRARY.decode(ids, skip_special_tokens=False)) for i, ids in want}


def test_each_distinct_word_is_encoded_once_for_all_blocks(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "a A"), (3, None)], SCHEMA).coalesce(1)
    words = W.block_words(df, "word_bpe_49k.json", 7, 2)  # a block for each document
    got = sorted((r.block, w) for r in words.collect() for w in r.words.split("\n"))
    assert got == [(0, "a"), (0, "b"), (1, "a")]
    rows = W.word_ids(words, "word_bpe_49k.json", 7).collect()
    assert sorted((r.block, r.n, list(W._unpacked(bytes(r.ids))[r.n:])) for r in rows if r.block) == [(1, 1, ids_of("a"))]


def test_decode_of_any_ids_and_empty_table(spark):
    ids = [5, 49407, 100, 60000, 49406, 100]  # 60000 is no id of the vocabulary
    df = spark.createDataFrame([(1, ids), (2, []), (3, [5, -1, 10**6])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in W.decode(df).collect()} == \
        {1: LIBRARY.decode(ids, skip_special_tokens=False), 2: "", 3: LIBRARY.decode([5], skip_special_tokens=False)}
    assert W.encode_and_decode(spark.createDataFrame([], SCHEMA)).count() == 0
