"""Leaks against a brute-force search, re-parameterised questions, edges."""
import re

import __spark_entry__ as E
from regiopanel.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, window=8, coverage=0.5):
    """Pairs by plain n-grams, right for items without slots."""
    out = set()
    grams = {i: {tuple(w[k:k + window]) for k in range(len(w) - window + 1)} for i, w in ((i, words(t)) for i, t in items.items())}
    for d, t in docs.items():
        w = words(t)
        have = {tuple(w[k:k + window]) for k in range(len(w) - window + 1)}
        out |= {(d, i) for i, g in grams.items() if g and len(g & have) >= coverage * len(g)}
    return out


def test_query_matches_brute_force(spark):
    docs = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    items = dict(map(tuple, spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()))
    rows = E.queries()["op7_decontaminate"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(docs, items)
    assert len(rows) > 10


ITEM = "A train leaves the town of Ostrow at 9 and drives 120 km north while Anna waits for 3 hours at Ostrow"


def leaks(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "too short to search")], "item_id long, text string")
    return {r.doc_id: r for r in D.find_leaks(docs, bench, **options).collect()}


def test_slots(spark):
    other = ITEM.replace("Ostrow", "Lipno").replace("120", "77").replace("Anna", "Piotr").replace("km", "miles")
    broken = other.replace("at Lipno", "at Warta")            # one town became two
    merged = ITEM.replace("Anna", "Ostrow")                   # two names became one
    texts = [f"intro words here, {ITEM}", f"Noise. {other}. And more", broken, merged, ITEM.upper(), None, "", "x " * 50_000]
    for options in ({}, {"broadcast_windows": 0}):
        got = leaks(spark, texts, **options)
        # a broken slot costs its windows at most; a copy in capitals is verbatim
        assert {k: r.reparameterised for k, r in got.items()} == {0: False, 1: True, 2: True, 3: True, 4: False}
        assert got[1].n_slots >= 7 and got[1].coverage > 0.8 and got[0].coverage == got[4].coverage == 1.0
        assert got[2].coverage <= got[1].coverage and got[3].coverage >= 0.5


def test_drop_leaks_keeps_columns(spark):
    docs = spark.createDataFrame([(None, ITEM, 1), (None, "clean text", 2), (5, "clean text", 3), (5, "clean text", 3)],
                                 "doc_id long, text string, row_number_ int")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    out = D.drop_leaks(docs, bench)
    assert out.columns == docs.columns
    assert sorted((r.row_number_, r.doc_id) for r in out.collect()) == [(2, None), (3, 5), (3, 5)]


def test_empty(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.find_leaks(docs.where("false"), bench).count() == 0
    assert D.find_leaks(docs, bench.where("false")).count() == 0


LIST = "Take 11 red boxes and 12 blue boxes then 13 green boxes and 14 white boxes before you move 15 long tables and 16 short tables away"


def test_each_diagonal_is_decided_by_its_matched_windows(spark):
    words_ = LIST.split()
    part = " ".join(words_[:19])                                # well over half, verbatim
    foreign = f"{part} and more of them 12 things"              # a foreign value where a later slot would be
    inserted = f"{part} very {' '.join(words_[19:])}"
    broken = LIST.replace("12", "11")
    first_broken = f"{broken}. {'filler ' * 30}. {LIST}"
    docs = spark.createDataFrame(list(enumerate([foreign, inserted, first_broken, broken, LIST])), "doc_id long, text string")
    bench = spark.createDataFrame([(1, LIST)], "item_id long, text string")
    got = {r.doc_id: r for r in D.find_leaks(docs, bench).collect()}
    assert {k: r.reparameterised for k, r in got.items()} == {0: False, 1: False, 2: False, 3: True, 4: False}


NAMES = "When did Anna Kowalska, Piotr Nowak and Maria Lis meet Jan Zych, Ewa Mazur and Adam Wilk near Warta, Lipno and Ostrow"


def test_short_items_and_changed_layout(spark):
    docs = [NAMES, NAMES.lower(), NAMES.replace(" ", "\n"), NAMES.replace(" ", "  "), NAMES.replace(" ", "  \t"),
            "So: WHO wrote\nFaust 2? Nobody knows", "who wrote Faust 3", "Who wrote", "Capital of Peru", "nothing", None, ""]
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, NAMES), (2, "Who wrote Faust 2?"), (3, "capital of Peru"), (4, ""), (5, None), (6, "...")],
                                  "item_id long, text string")
    for options in ({}, {"broadcast_windows": 0}):
        rows = D.find_leaks(docs, bench, **options).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (8, 3)}
        assert len(rows) == 7 and not any(r.reparameterised for r in rows) and {r.coverage for r in rows} == {1.0}
        assert D.drop_leaks(docs, bench, **options).count() == 5


def test_what_is_no_leak(spark):
    """Tables of other numbers, and sentences that share function words alone."""
    import random
    rng = random.Random(3)
    numbers = "Numbers: " + " ".join(str(rng.randrange(10, 999)) for _ in range(40))
    german = "Die Katze der Familie und der Hund des Nachbarn sind in dem Garten und auf der Wiese bei dem Haus an der Straße"
    other = "Die Firma der Stadt und der Chef des Betriebs sind in dem Büro und auf der Messe bei dem Stand an der Halle"
    docs = spark.createDataFrame(list(enumerate([" ".join(str(rng.randrange(10, 999)) for _ in range(40)), other, numbers, german.upper()])),
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, numbers), (2, german)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()} == {(2, 1), (3, 2)}


def test_names_in_other_cases_and_replaced(spark):
    docs = [NAMES.upper(), NAMES.title(), NAMES.replace("Piotr", "Ewa"), NAMES.replace("Maria", "Nadia"), NAMES.replace("Lipno", "Warta")]
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, NAMES)], "item_id long, text string")
    assert {r.doc_id for r in D.find_leaks(docs, bench).collect()} == {0, 1, 2, 3, 4}


def test_rows_without_an_id_are_decided_each(spark):
    words_ = LIST.split()
    halves = [(None, " ".join(words_[:14])), (None, " ".join(words_[11:])), (7, LIST), (7, LIST), (None, LIST)]
    docs = spark.createDataFrame(halves, "doc_id long, text string")
    bench = spark.createDataFrame([(1, LIST)], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in D.find_leaks(docs, bench).collect() if r.coverage == 1.0) == ["7", "7", "None"]
    assert D.find_leaks(docs.limit(2), bench, coverage=0.7).count() == 0


def test_units_of_four_languages(spark):
    texts = ["runs 5 km in 3 Stunden", "pèse 7 kg et 2 grammes", "dura 4 horas y 9 ms", "has 12 boxes"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r.k: [w[2:] for w in r.words if w.startswith("\x01u")] for r in D.template_words(df, "k").collect()}
    assert got == {0: ["km", "stunden"], 1: ["kg", "grammes"], 2: ["horas", "ms"], 3: []}
