"""Pipeline stages against brute-force decisions on sf0.001."""
import sys

import corpus_pipeline as P
from tests.llm.brute import components, shingles, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from regiopanel.llm import quality
    from regiopanel.llm.common import load, stage
    docs = load(spark, SF, "documents")
    columns = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    left = []
    for name, step in P.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), "pipeline-test")
        assert docs.columns == columns, name
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    good, exact, near, clean = left
    scores = quality.quality_scores(load(spark, SF, "documents"), load(spark, SF, "labels")).collect()
    assert good == {r.doc_id for r in scores if r.predicted}
    last = {}
    for d in good:
        last[text[d]] = max(d, last.get(text[d], d))
    assert exact == set(last.values())
    assert near == set(components({d: shingles(text[d], 5) for d in exact}, 80).values())
    items = [words(r.text) for r in load(spark, SF, "benchmark").collect()]
    strip = lambda w: [x for x in ("".join(c for c in y if c.isalnum()) for y in w) if x]
    grams = [{tuple(strip(w)[i:i + 8]) for i in range(len(strip(w)) - 7)} for w in items]
    for d in near - clean:  # everything that went holds half of some item
        w = strip(words(text[d]))
        have = {tuple(w[i:i + 8]) for i in range(len(w) - 7)}
        assert any(2 * len(g & have) >= len(g) for g in grams)
    assert near - clean and clean
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == clean


def test_entry_has_the_pipeline():
    import __spark_entry__ as E
    assert E.queries()["pipeline"].__doc__ == P.run.__doc__ and len(P.STAGES) == 5
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in E.queries() if k.startswith("op")}
    assert "corpus_pipeline" in sys.modules


def tables(spark, folder, docs, schema, items):
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_number_ int, score_ string, component_id double"


def test_run_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, columns with the names
    that stages use inside, then a table without rows."""
    item = "A train leaves the town of Ostrow at 9 and drives 120 km north while Anna waits for 3 hours at Ostrow"
    good = [(i, f"good prose number {i} about river {i * 7} and quiet hill {i * 11} under evening sky {i}" if i % 2 else f"!! {i} ## !!") for i in range(60)]
    long_text = " ".join(f"w{i}" for i in range(300))
    rows = good + [(None, long_text), (None, long_text), (7000, long_text + " more"), (7001, f"before that, {item}, and after"),
                   (7002, None), (7002, ""), (7003, "x " * 40_000), (7003, "x " * 40_000)]
    docs = [(i, t, "en", "web", len(t or ""), 5, "s", 0.5) for i, t in rows]
    tables(spark, tmp_path, docs, SCHEMA, [(1, item), (None, None)])
    out = P.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert kept >= {i for i, _ in good if i % 2 and i > 20} - {None} and 7001 not in kept
    assert not kept & {i for i, _ in good if i % 2 == 0}
    whole = [r for r in out if r.doc_id == 7003]
    assert {r.piece for r in whole} == set(range(len(whole)))          # one of the two equal rows
    assert len([r for r in out if r.doc_id in (None, 7000)]) == 1      # one of three near copies
    empty = tmp_path / "empty"
    tables(spark, empty, [], SCHEMA, [(1, item)])
    assert P.run(spark, str(empty)).count() == 0


def test_stages_on_tables_without_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "some item text")], "item_id long, text string")
    from regiopanel.llm import decontaminate, exact_dedup, ngram_join, quality
    for out in (quality.keep_good(docs, marks), exact_dedup.drop_exact_copies(docs), ngram_join.drop_near_copies(docs),
                decontaminate.drop_leaks(docs, items), decontaminate.drop_leaks(docs, items.limit(0))):
        assert out.columns == docs.columns and out.count() == 0


def test_quality_stage_on_odd_rows(spark):
    from regiopanel.llm import quality
    docs = [(i, f"good prose {i}" if i % 2 else f"!! {i} ## !!", 1) for i in range(120)]
    docs += [(None, "good prose 7", 2), (None, None, 3), (5, "good prose 5", 4), (5, "good prose 5", 4), (6, "", 5), (8, "good " * 100_000, 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score_ int")
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    out = quality.keep_good(df, marks).collect()
    scores = {r.score_: 0 for r in out}
    for r in out:
        scores[r.score_] += 1
    assert scores[1] == 60 and scores[2] == 1 and scores[4] == 2
    assert quality.keep_good(df.where("false"), marks).count() == 0
