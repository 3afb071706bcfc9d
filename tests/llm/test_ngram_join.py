"""Components against comparing every pair that shares a shingle."""
import random

import numpy as np
import pytest

import __spark_entry__ as E
from regiopanel.llm import ngram_join as J
from tests.llm.brute import components, shingles

SF = "/root/testdata/sf0.001"


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.ngram_jaccard_components(df, **options).collect()}


def test_query(spark):
    texts = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    sets = {d: shingles(t, 4) for d, t in texts.items()}
    expected = components(sets, 85)
    rows = E.queries()["op2_ngram_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {d: (len(sets[d]), expected[d]) for d in texts}
    assert len(set(expected.values())) < len(texts)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (2, 60)])
def test_drifting_variants(spark, n, percent):
    """Groups around the threshold, chains, a hot group of variants, short texts."""
    rng, vocabulary = random.Random(n), [f"w{i}" for i in range(50)]
    texts = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 12, 40, 150, 400]))
        for _ in range(30 if g else 120):
            edited = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 40)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts.append(" ".join(edited))
        for _ in range(10):  # a chain: each a little further
            base = base[1:] + [rng.choice(vocabulary)]
            texts.append("  ".join(base).upper())
    texts += ["", None, " \t\n", "one", "One", "one two"]
    sets = {i: shingles(t, n) for i, t in enumerate(texts)}
    expected = components(sets, percent)
    got = run(spark, [(i, t, "x") for i, t in enumerate(texts)], n=n, percent=percent)
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}


def test_signatures_meet():
    """Sets at the threshold share a signature, whatever their sizes."""
    rng = np.random.default_rng(4)
    for percent in (60, 80, 85):
        for size in (1, 2, 3, 7, 20, 77, 300, 2500):
            for _ in range(60):
                s = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
                gone = rng.integers(0, size * (100 - percent) // (100 + percent) + 1)
                other = np.unique(np.concatenate([s[gone:], rng.integers(1, 1 << 62, gone).astype(np.uint64)]))
                both = len(np.intersect1d(s, other))
                if 100 * both >= percent * (len(s) + len(other) - both):
                    assert set(J.signatures(s, percent).tolist()) & set(J.signatures(other, percent).tolist())


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e", ""), (5, "a b c d e", ""), (5, "q r s t u", ""), (7, "Q r s t u", ""), (None, "zz", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    got = sorted(map(str, map(tuple, J.ngram_jaccard_components(df).collect())))
    assert got == sorted(map(str, [(None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (None, 1, None)]))
    assert J.ngram_jaccard_components(df.where("false")).count() == 0


def test_drop_near_copies(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text, 1), (9, text + " more", 2), (4, text, 3), (4, text.upper(), 4), (1, "other", 5), (2, None, 6)]
    out = J.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, row_number_ int").coalesce(1))
    assert out.columns == ["doc_id", "text", "row_number_"]
    assert sorted(r.row_number_ for r in out.collect()) == [3, 5, 6]


def test_rows_of_files_keep_their_numbers_without_a_copy(spark, tmp_path):
    from regiopanel.llm.common import numbered_rows
    df = spark.range(1000).selectExpr("id", "id % 7 as file_").repartition(5)
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for frame in (read, read.select("id"), read.limit(300), read.where("id > 5")):
        numbered = numbered_rows(frame, "row_")
        first, again = (dict(numbered.select("row_", "id").collect()) for _ in range(2))
        assert first == again and len(first) == frame.count() and numbered.columns == frame.columns + ["row_"]
    assert numbered_rows(read, "row_").inputFiles() != [] and all("/t/" in f for f in numbered_rows(read, "row_").inputFiles() if "file-numbers" not in f)


def test_signatures_enumerate_subsets():
    """Sets that differ in one element per first-level part still share signatures."""
    rng = np.random.default_rng(8)
    s = np.unique(rng.integers(1, 1 << 62, 400).astype(np.uint64))
    n1, slack = J._instance(J.band_of(len(s), 80), 80)
    assert n1 > slack + 1 and len(J.signatures(s, 80)) <= 3 * (n1 + J._instance(J.band_of(len(s), 80) - 1, 80)[0])
    other = np.unique(np.concatenate([s[40:], rng.integers(1, 1 << 62, 40).astype(np.uint64)]))
    shared = set(J.signatures(s, 80).tolist()) & set(J.signatures(other, 80).tolist())
    assert shared
