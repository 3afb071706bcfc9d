"""Benchmark decontamination by template canonicalisation (native DataFrame code).

Template.  A text becomes lower-cased words without punctuation; numbers, names
(capitalised words inside a sentence) and units behind a number become typed
slots.  A slot keeps its value.  Each ``window``-word window has two hashes: a literal
one, which sees the slots' values in lower case, and a typed one, which sees only their
types, so a question with other numbers or names has the same typed windows.

Search.  Hashes of all windows, built by doubling (1, 2, 4, 8 words), are hash-joined
with the windows of the benchmark.  A typed window of an item counts only with a literal
content word in it (``min_letters`` letters or more and none of ``FUNCTION_WORDS``), so
windows of slots, or of slots and function words, meet nobody.  The benchmark side is
broadcast only while it has at most ``broadcast_windows`` windows; beyond that it is an
ordinary shuffled join.  Only windows that match leave the join.

Decision.  Matches lie on diagonals (document, item, shift).  On each, a value of the
item stands for the value that it has most often in the document, and the other way
round; a slot that breaks this is inconsistent.  A literal match counts.  A typed one
counts when it holds two content words or equal slot values, and either none of its
slots is inconsistent and at most half of its words differ, or at most a quarter of its
words differ.  So an inconsistent slot costs its windows, not the whole hit.  A document
leaks an item when windows that count cover at least ``coverage`` of the item's windows.
``reparameterised`` tells that some value differs on the diagonal with most windows.

Defined cases: null and empty texts leak nothing; items of fewer words than
``window`` are found where a document holds all their words in a row, in any case
and by value, so an item of one word is found in every document that has it; copies
in other cases are found by their literal windows; line breaks and several spaces
count as one; rows go by their place, so rows with the same id, or none, are decided
and reported each; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, numbered_rows, small_enough, stage

# Units behind a number, as signs (with prefixes) and as words in English,
# German, French and Spanish.
UNIT_SIGNS = ("m", "g", "l", "s", "W", "Wh", "V", "A", "Hz", "Pa", "J", "N", "B", "mol", "bar", "t", "cal")
UNIT_PREFIXES = ("n", "µ", "m", "c", "d", "h", "k", "M", "G", "T")
UNIT_WORDS = (
    "min", "h", "kmh", "mph", "ha", "°C", "°F", "C", "F", "%", "€", "$", "in", "ft", "yd", "mi", "lb", "lbs", "oz",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "metre", "metres", "meter", "meters", "kilometres", "kilometers",
    "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounces", "litre", "litres", "liter", "liters", "gallons",
    "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degrees",
    "Sekunden", "Minuten", "Stunde", "Stunden", "Tag", "Tage", "Tagen", "Woche", "Wochen", "Monat", "Monate", "Jahr", "Jahre", "Jahren",
    "Meter", "Kilometer", "Gramm", "Kilogramm", "Liter", "Euro", "Prozent", "Grad", "Meilen",
    "secondes", "heure", "heures", "jour", "jours", "semaine", "semaines", "mois", "an", "ans", "mètres", "kilomètres", "grammes",
    "kilogrammes", "litres", "pourcent", "degrés",
    "segundos", "minutos", "hora", "horas", "día", "días", "semanas", "mes", "meses", "año", "años", "metros", "kilómetros",
    "gramos", "kilogramos", "litros", "porciento", "grados")

# Frequent function words of four letters or more (shorter words count as
# function words anyway) in English, German, French and Spanish.
FUNCTION_WORDS = (
    "that", "this", "with", "from", "have", "been", "were", "they", "their", "there", "them", "then", "than", "these", "those", "which",
    "when", "where", "what", "while", "will", "would", "could", "should", "into", "onto", "over", "under", "about", "after", "before",
    "also", "only", "some", "such", "each", "other", "more", "most", "many", "much", "very", "your", "does", "being", "because", "between",
    "eine", "einen", "einem", "einer", "eines", "oder", "aber", "nicht", "auch", "sind", "wird", "werden", "wurde", "haben", "hatte",
    "sich", "nach", "über", "unter", "durch", "beim", "vom", "zwischen", "diese", "dieser", "dieses", "dass", "wenn", "weil", "noch", "kann",
    "dans", "avec", "pour", "mais", "plus", "cette", "leur", "leurs", "elle", "elles", "nous", "vous", "sont", "était", "être", "avoir",
    "comme", "entre", "sans", "sous", "donc", "tout", "tous", "toute",
    "para", "pero", "como", "este", "esta", "estos", "estas", "desde", "entre", "hasta", "sobre", "también", "porque", "cuando", "donde",
    "ellos", "ellas", "todo", "todos", "tiene", "había", "está", "están")

_MARK = "\u0001"
_SPACE = r"[\s\x0B\x85\p{Z}]"


def template_words(texts: DataFrame, key: str) -> DataFrame:
    """(key, words) of (key, text); a slot is a mark, its type (n, p or u) and its
    value.  One select for each step whose result is used twice, so that it is
    computed once."""
    t = F.translate(F.coalesce("text", F.lit("")), _MARK, " ")
    # line breaks and several spaces are one space
    t = F.regexp_replace(t, rf"(?!(?: (?!{_SPACE}))){_SPACE}+", " ")
    df = texts.select(key, F.regexp_replace(t, r"\p{Lu}(?<=[\p{Ll}\p{N},;] \p{Lu})[\p{L}\p{M}]*", f"{_MARK}p$0").alias("t"))
    joined = F.regexp_replace("t", r"(?<=[0-9])[.,:](?=[0-9])", "")
    numbers = F.regexp_replace(joined, rf"(?<![\p{{L}}\p{{N}}{_MARK}])[0-9]+", f"{_MARK}n$0 ")
    signs = f"[{''.join(UNIT_PREFIXES)}]?(?:{'|'.join(UNIT_SIGNS)})"
    words = "|".join(re.escape(w) for w in UNIT_WORDS)
    units = F.regexp_replace(numbers, rf"({_MARK}n[0-9]+ +){_MARK}?p?({words}|{signs})(?![\p{{L}}\p{{N}}])", f"$1{_MARK}u$2")
    t = F.when(F.col("t").rlike("[0-9]"), units).otherwise(F.col("t"))
    df = df.select(key, F.trim(F.regexp_replace(F.lower(t), rf"[^\p{{L}}\p{{N}}{_MARK}]+", " ")).alias("t"))
    return df.select(key, F.filter(F.split("t", " "), lambda w: w != "").alias("words"))


def with_windows(texts: DataFrame, key: str, window: int) -> DataFrame:
    """(key, pos, literal, typed): both hashes of each window, equal where it has no
    slot; ``window`` is a power of two."""
    assert window >= 1 and window & (window - 1) == 0, "window must be a power of two"
    df = template_words(texts, key)
    literal = lambda w: F.xxhash64(F.when(w.startswith(_MARK), F.substr(w, F.lit(3))).otherwise(w))
    typed = lambda w: F.xxhash64(F.when(w.startswith(_MARK), F.substring(w, 1, 2)).otherwise(w))
    df = df.select(key, F.transform("words", literal).alias("a"), F.transform("words", typed).alias("b"))
    step = 1
    while step < window:
        left = F.greatest(F.size("a") - step, F.lit(0))
        doubled = lambda h: F.zip_with(F.slice(h, F.lit(1), left), F.slice(h, F.lit(step + 1), left),  # noqa: E731, B023
                                       lambda x, y: F.xxhash64(x, y))
        df = df.select(key, doubled("a").alias("a"), doubled("b").alias("b"))
        step *= 2
    # The outer form, as the plain one infers a filter that computes the array again.
    pairs = F.zip_with("a", "b", lambda x, y: F.struct(x.alias("literal"), y.alias("typed")))
    return df.select(key, F.posexplode_outer(pairs).alias("pos", "w")).where("w is not null").select(key, "pos", "w.*")


def _item_windows(forms: DataFrame, window: int, min_letters: int) -> DataFrame:
    """(item_id, item_pos, h, literal, content, slots) of the windows that documents are
    searched for: all literal ones, and typed ones with a content word."""
    words = template_words(forms, "item_id").select("item_id", "words", F.monotonically_increasing_id().alias("form"))
    words = stage(words, "item-words")
    is_slot = lambda w: w.startswith(_MARK)
    is_content = lambda w: ~is_slot(w) & (F.length(w) >= min_letters) & ~w.isin(*FUNCTION_WORDS)
    at = F.expr(f"if(size(words) >= {window}, sequence(0, size(words) - {window}), array())")
    places = words.select("item_id", "words", F.explode(at).alias("item_pos"))
    mine = F.slice("words", F.col("item_pos") + 1, window)
    counts = places.select("item_id", "item_pos", F.size(F.filter(mine, is_content)).alias("content"),
                           F.size(F.filter(mine, is_slot)).alias("slots"), mine.alias("words"))
    # hashes as with_windows makes them, over each window's own words
    def hashed(word):
        out, step = F.transform("words", word), 1
        while step < window:
            n = window - step  # what is left of the window's array shrinks as it does there
            out = F.zip_with(F.slice(out, 1, F.greatest(F.size(out) - step, F.lit(0))), F.slice(out, step + 1, n), lambda x, y: F.xxhash64(x, y))
            step *= 2
        return F.element_at(out, 1)
    literal = lambda w: F.xxhash64(F.when(is_slot(w), F.substr(w, F.lit(3))).otherwise(w))
    typed = lambda w: F.xxhash64(F.when(is_slot(w), F.substring(w, 1, 2)).otherwise(w))
    both = counts.select("item_id", "item_pos", "content", "slots", hashed(literal).alias("a"), hashed(typed).alias("b"))
    one = both.select("item_id", "item_pos", F.col("a").alias("h"), F.lit(True).alias("literal"), "content", "slots")
    other = both.where("b <> a and content > 0").select("item_id", "item_pos", F.col("b").alias("h"), F.lit(False).alias("literal"), "content", "slots")
    return one.union(other).distinct()


def _slots(texts: DataFrame, key: str) -> DataFrame:
    """(key, at, type, value) of every slot of a text."""
    words = template_words(texts, key).select(key, F.posexplode_outer("words").alias("at", "word"))
    return words.where(F.col("word").startswith(_MARK)) \
        .select(key, "at", F.substring("word", 2, 1).alias("type"), F.expr("substring(word, 3)").alias("value"))


def _literal_words(texts: DataFrame, key: str) -> DataFrame:
    """(key, w): lower-cased words, slots by their values."""
    return template_words(texts, key).select(key, F.transform(
        "words", lambda w: F.when(w.startswith(_MARK), F.substr(w, F.lit(3))).otherwise(w)).alias("w"))


def _whole_items(texts: DataFrame, items: DataFrame, window: int, broadcast_windows: int) -> DataFrame:
    """Hits of items of fewer than ``window`` words, that documents hold word for word."""
    short = _literal_words(items, "item_id").where((F.size("w") > 0) & (F.size("w") < window)) \
        .select("item_id", F.size("w").alias("n"), F.xxhash64("w").alias("h")).distinct()
    short = stage(short, "short-items")
    runs = []
    for r in sorted(short.select("n").distinct().collect()):  # fewer than ``window`` lengths
        at = F.expr(f"if(size(w) >= {r.n}, sequence(1, size(w) - {r.n - 1}), array())")
        runs.append(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, r.n))))
    none = F.lit(0).cast("long")
    hits = short.limit(0).select(F.lit(None).cast("long").alias("doc_id"), "item_id") if not runs else \
        _literal_words(texts, "doc_id").select("doc_id", F.explode(F.array_distinct(F.concat(*runs))).alias("h")) \
        .join(F.broadcast(short) if short.count() <= broadcast_windows else short, "h").select("doc_id", "item_id").distinct()
    return hits.select("doc_id", "item_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("coverage"),
                       none.alias("n_slots"), F.lit(False).alias("reparameterised"))


def _leaks(texts: DataFrame, items: DataFrame, window: int = 8, coverage: float = 0.5, min_letters: int = 4,
           broadcast_windows: int = 500_000) -> DataFrame:
    """Leaks of ``texts``(doc_id, text), whose ids are not null and differ."""
    # in a lower-cased copy names are plain words
    forms = items.union(items.select("item_id", F.lower("text")))
    known = stage(_item_windows(forms, window, min_letters), "item-windows")
    small = known.count() <= broadcast_windows
    hashes = F.when(F.col("literal") == F.col("typed"), F.array("literal")).otherwise(F.array("literal", "typed"))
    found = with_windows(texts, "doc_id", window).select("doc_id", "pos", F.explode(hashes).alias("h")) \
        .join(F.broadcast(known) if small else known, "h").drop("h")
    totals = known.groupBy("item_id").agg(F.count_distinct("item_pos").alias("all_windows"))
    # Matches are aligned along diagonals; a place matched literally needs no more.
    line = ["doc_id", "item_id", "shift"]
    lines = stage(found.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos").agg(
        F.max("literal").alias("literal"), F.max("content").alias("content"), F.max("slots").alias("slots")), "lines")
    enough = lambda n: F.col(n) >= coverage * F.col("all_windows")
    likely = lines.groupBy("doc_id", "item_id").agg(F.count_distinct("item_pos").alias("n")).join(totals, "item_id") \
        .where(enough("n")).select("doc_id", "item_id", "all_windows")
    places = stage(lines.join(likely, ["doc_id", "item_id"]), "places")
    counted = places.where("literal").select(*line, "all_windows", "item_pos", F.lit(False).alias("differs"))
    typed = places.where("not literal")
    if not typed.isEmpty():
        counted = counted.unionByName(_typed_places(typed, texts, items, line, window))
    counted = stage(counted, "counted-places")
    per = counted.groupBy(*line, "all_windows").agg(F.collect_set("item_pos").alias("places"), F.max("differs").alias("differs"))
    # the diagonal with most windows tells about the slots, a verbatim one first
    best = F.max(F.struct(F.size("places"), ~F.col("differs"), -F.col("shift"), F.col("places"))).alias("best")
    hits = counted.groupBy("doc_id", "item_id", "all_windows").agg(F.count_distinct("item_pos").alias("n_windows")).where(enough("n_windows")) \
        .join(per.groupBy("doc_id", "item_id").agg(best), ["doc_id", "item_id"])
    asked = _slots(items, "item_id").select("item_id", "at").distinct()
    held = hits.select("doc_id", "item_id", F.col("best.places").alias("places")).join(asked, "item_id") \
        .where(F.exists("places", lambda p: (p <= F.col("at")) & (F.col("at") < p + window))) \
        .groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_slots"))
    return hits.join(held, ["doc_id", "item_id"], "left").select(
        "doc_id", "item_id", "n_windows", (F.col("n_windows") / F.col("all_windows")).alias("coverage"),
        F.coalesce("n_slots", F.lit(0)).alias("n_slots"), (~F.col("best.col2")).alias("reparameterised")) \
        .union(_whole_items(texts, items, window, broadcast_windows))


def _typed_places(typed: DataFrame, texts: DataFrame, items: DataFrame, line: list[str], window: int) -> DataFrame:
    """The typed matches that count, by the slots inside them: (*line, all_windows,
    item_pos, differs)."""
    asked = _slots(items, "item_id").distinct()
    pairs = typed.join(asked, "item_id").where((F.col("item_pos") <= F.col("at")) & (F.col("at") < F.col("item_pos") + window)) \
        .select(*line, "item_pos", "at", "type", F.col("value").alias("asked"))
    ids = typed.select(F.col("doc_id").alias("id")).distinct()
    given = _slots(texts.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), "doc_id") \
        .select("doc_id", F.col("at").alias("doc_at"), "type", "value")
    both = stage(pairs.withColumn("doc_at", F.col("at") + F.col("shift")).join(given, ["doc_id", "doc_at", "type"]), "slot-pairs")
    # the value that each value stands for most often on its diagonal, both ways
    n = both.groupBy(*line, "type", "asked", "value").agg(F.count_distinct("at").alias("n"))
    most = lambda key, other, name: n.groupBy(*line, "type", key).agg(
        F.max_by(other, F.struct("n", F.col("asked") == F.col("value"), other)).alias(name))
    slots = both.join(most("asked", "value", "for_asked"), [*line, "type", "asked"]) \
        .join(most("value", "asked", "for_value"), [*line, "type", "value"])
    off = (F.col("value") != F.col("for_asked")) | (F.col("asked") != F.col("for_value"))
    inside = slots.groupBy(*line, "item_pos").agg(
        F.count(F.when(F.col("asked") == F.col("value"), 1)).alias("equal"), F.count(F.when(off, 1)).alias("off"))
    differing = F.col("slots") - F.coalesce("equal", F.lit(0))
    counts = (F.col("content") + F.coalesce("equal", F.lit(0)) >= 2) & (
        (F.coalesce("off", F.lit(0)) == 0) & (differing * 2 <= window) | (differing * 4 <= window))
    return typed.join(inside, [*line, "item_pos"], "left").where(counts) \
        .select(*line, "all_windows", "item_pos", (differing > 0).alias("differs"))


def _texts_and_items(docs: DataFrame, benchmark: DataFrame, row: str, text_col: str, item_col: str, item_text_col: str):
    return (docs.select(F.col(row).alias("doc_id"), F.col(text_col).cast("string").alias("text")),
            benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """One row per leaked item of a document: doc_id, item_id, n_windows, coverage,
    n_slots, reparameterised."""
    row = fresh_name(docs, "row_number_")
    numbered = numbered_rows(docs, row)
    leaks = stage(_leaks(*_texts_and_items(numbered, benchmark, row, text_col, item_col, item_text_col), **options)
                  .withColumnRenamed("doc_id", row), "leaks")
    ids = numbered.select(row, F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(small_enough(leaks), row).select("doc_id", *[c for c in leaks.columns if c != row])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak nothing, all columns unchanged.  Ids may be null
    or repeat, so rows go by their number (``common.numbered_rows``)."""
    row = fresh_name(docs, "row_number_")
    numbered = numbered_rows(docs, row)
    leaks = _leaks(*_texts_and_items(numbered, benchmark, row, text_col, item_col, item_text_col), **options)
    bad = stage(leaks.select(F.col("doc_id").alias(row)).distinct(), "leaking-rows")
    return numbered.join(small_enough(bad), row, "left_anti").drop(row)
