"""Validated CSV ingest with row-level quarantine (SRC-1..SRC-13).

Flow: records cut from parallel splits (``sources.records``) -> columns by each file's
own header -> typed columns via guarded casts -> one columnar staging, good and bad
rows apart -> loaded rows (keyed upsert, last row wins), error rows and a one-row
summary, each of which reads only its columns.  Every step is a column expression or a
combinable aggregate:

* ``_row`` is one long, file number above record number, so "last row wins" is a
  ``max_by`` of fixed-width values: a hash aggregate on both sides of the shuffle,
  without a sort;
* the in-file duplicate counter is a group-by count, which combines map-side, so a key
  repeated in a third of the file is pre-aggregated before the shuffle;
* error rows take their record number out of ``_row``: nothing is shuffled to be
  numbered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regiopanel import schemas as S
from regiopanel.functions.geo import wkt_geometry
from regiopanel.session import stage_table
from regiopanel.sources.records import RECORD_BITS, CsvRecords, ImportRejected

G, M = S.G, S.M
ROW = "_row"              # record order key: file number above record number (first data record = 2)
MALFORMED = "_malformed"  # too few / too many fields
KEYS = ("_key0", "_key1")  # raw text of the first two required columns, the in-file duplicate key

# The characters Python's str.strip()/int()/float() treat as
# whitespace (str.isspace), as a regex class; Java's \s covers only ASCII.
_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_INT_RE = rf"^{_WS}*[+-]?\d+(?:_\d+)*{_WS}*$"
_FLOAT_RE = (rf"^{_WS}*[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)"
             rf"(?:[eE][+-]?\d+(?:_\d+)*)?{_WS}*$")
# Decimal-digit sets accepted like ASCII digits by Python's
# int()/float()/strptime (Arabic-Indic, Extended Arabic-Indic, full-width).
_DIGIT_SETS = "٠١٢٣٤٥٦٧٨٩" + "۰۱۲۳۴۵۶۷۸۹" + "０１２３４５６７８９"
_ASCII_DIGITS = "0123456789" * 3
_NONFINITE_RE = rf"(?i)^{_WS}*[+-]?(?:nan|inf|infinity){_WS}*$"
_MONTH_RE = r"^(\d{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])$"

MEASURES = {
    "visitors_monthly": [("total_visitors", S.MONEY)],
    "rooms_beds_monthly": [("total_rooms", S.MONEY), ("total_beds", S.MONEY)],
    "hotel_occupancy_monthly": [("average_occupancy_rate", S.RATE)],
}
TARGET = {
    "visitors_monthly": "visitors",
    "rooms_beds_monthly": "rooms_beds",
    "hotel_occupancy_monthly": "occupancy",
    "admin_boundaries": "boundaries",
}


def validate_headers(dataset_type: str, fieldnames: list[str] | None) -> None:
    if dataset_type not in S.REQUIRED_COLUMNS:
        raise ImportRejected(f"Unsupported dataset_type: {dataset_type}")
    missing = [c for c in S.REQUIRED_COLUMNS[dataset_type] if not fieldnames or c not in fieldnames]
    if missing:
        raise ImportRejected(f"Missing columns: {', '.join(missing)}")


# --- scan -------------------------------------------------------------------

def open_csv(spark: SparkSession, path: str, dataset_type: str, split_bytes: int | None = None) -> CsvRecords:
    """The records of a file, a folder or a glob; every file's header must have the
    required columns, in any order and with any others between them."""
    records = CsvRecords(spark, path, split_bytes)
    if not records.headers:
        validate_headers(dataset_type, None)
    for _, columns, _ in records.headers:
        validate_headers(dataset_type, columns)
    return records


def header_rows(records: CsvRecords) -> list[DataFrame]:
    """All-string rows with ``_row`` and ``_malformed``, one frame for each header."""
    one = len(records.headers) == 1
    return [records.rows(columns, None if one else files) for _, columns, files in records.headers]


def read_csv_raw(spark: SparkSession, path: str, dataset_type: str) -> DataFrame:
    """All-string records of an import with ``_row`` and ``_malformed``; with several
    headers, a column that a file lacks is NULL in its rows."""
    frames = header_rows(open_csv(spark, path, dataset_type))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_line_numbers(subset: DataFrame, full: DataFrame | None = None, name: str = "row_number") -> DataFrame:
    """``subset`` with the record number in its file (first data record = 2, the header
    being 1), which ``_row`` holds."""
    return subset.withColumn(name, F.col(ROW).bitwiseAND((1 << RECORD_BITS) - 1))


# --- row typing -------------------------------------------------------------

def _py_strip(c: Column) -> Column:
    """Python's str.strip(): remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def _quote(c: Column) -> Column:
    return F.concat(F.lit("'"), c, F.lit("'"))


def _parse_int(df: DataFrame, t: Column, p: str, shown: Column) -> DataFrame:
    """Adds {p}_val / {p}_msg (messages quote ``shown``, the original text).
    Staged columns: each regex runs once per row (an expensive expression
    referenced twice is not re-inlined by Catalyst)."""
    df = df.withColumn(f"{p}_ok", t.isNotNull() & t.rlike(_INT_RE))
    ok = F.col(f"{p}_ok")
    df = df.withColumn(f"{p}_val", F.when(ok, F.regexp_replace(_py_strip(t), "_", "").try_cast("int")))
    return df.withColumn(f"{p}_msg", F.when(t.isNull(), F.lit(
        "int() argument must be a string, a bytes-like object or a real number, not 'NoneType'"))
        .when(~ok, F.concat(F.lit("invalid literal for int() with base 10: "), _quote(shown)))
        .when(F.col(f"{p}_val").isNull(), F.lit("integer out of range")))


def _parse_month(df: DataFrame, t: Column, p: str, shown: Column) -> DataFrame:
    df = df.withColumn(f"{p}_head", F.substring(t, 1, 10))
    head = F.col(f"{p}_head")
    df = df.withColumn(f"{p}_shaped", head.rlike(_MONTH_RE))
    shaped = F.col(f"{p}_shaped")
    # The shape check fixes every field's width; a space can only pad the day.
    df = df.withColumn(f"{p}_val", F.when(shaped, F.try_to_date(F.regexp_replace(head, " ", ""), "yyyy-M-d")))
    return df.withColumn(f"{p}_msg", F.when(t.isNull(), F.lit("'NoneType' object is not subscriptable"))
                         .when(~shaped, F.concat(F.lit("time data "), _quote(F.substring(shown, 1, 10)),
                                                 F.lit(" does not match format '%Y-%m-%d'")))
                         .when(F.col(f"{p}_val").isNull(), F.lit("day is out of range for month")))


def _parse_float(df: DataFrame, t: Column, p: str, dtype, shown: Column) -> DataFrame:
    df = df.withColumn(f"{p}_ok", t.isNotNull() & t.rlike(_FLOAT_RE))
    ok = F.col(f"{p}_ok")
    df = df.withColumn(f"{p}_dbl", F.when(ok, F.regexp_replace(_py_strip(t), "_", "").try_cast("double")))
    df = df.withColumn(f"{p}_val", F.col(f"{p}_dbl").try_cast(dtype))
    return df.withColumn(f"{p}_msg", F.when(t.isNull(), F.lit(
        "float() argument must be a string or a real number, not 'NoneType'"))
        .when(t.rlike(_NONFINITE_RE), F.concat(F.lit("non-finite value rejected: "), _quote(shown)))
        .when(~ok, F.concat(F.lit("could not convert string to float: "), _quote(shown)))
        .when(F.col(f"{p}_val").isNull(), F.lit("numeric field overflow")))


def typed_rows(raw: DataFrame, dataset_type: str, governorate: DataFrame | None = None) -> DataFrame:
    """Adds typed values, ``_ok``, ``error_message`` and the counter flags to
    each raw row.  Checks run in the reference's order: id, month, measures,
    so a bad id hides a bad month and a bad month hides a negative value."""
    validate_headers(dataset_type, raw.columns)
    req = S.REQUIRED_COLUMNS[dataset_type]
    if MALFORMED not in raw.columns:
        raw = raw.withColumn(MALFORMED, F.lit(False))
    header = [c for c in raw.columns if c not in (ROW, MALFORMED)]
    raw_col = lambda c: F.col(f"`{c}`")
    # Blank field: whitespace-only text, or NULL in a well-formed row (the CSV
    # reader turns empty fields into NULL; in a short row NULL means missing).
    blank = F.lit(False)
    for c in header:
        blank = blank | raw_col(c).rlike(rf"^{_WS}*$") | (raw_col(c).isNull() & ~F.col(MALFORMED))
    # Raw text as the reference sees it: '' for blank fields of well-formed rows.
    text = lambda c: F.when(raw_col(c).isNull() & ~F.col(MALFORMED), F.lit("")).otherwise(raw_col(c))
    df = raw.select(ROW, MALFORMED, F.struct(*[text(c).alias(c) for c in header]).alias("_raw"),
                    F.coalesce(blank, F.lit(False)).alias("_null_like"))
    raw_text = lambda c: F.col("_raw").getField(c)
    # numbers and dates with ASCII digits; most texts have no other character at all
    plain = lambda c: F.octet_length(c) == F.length(c)
    numeric = [req[0]] if dataset_type == "admin_boundaries" else [req[0], M, *[c for c, _ in MEASURES[dataset_type]]]
    df = df.withColumns({f"_t{i}": F.when(plain(raw_text(c)), raw_text(c)).otherwise(F.translate(raw_text(c), _DIGIT_SETS, _ASCII_DIGITS))
                         for i, c in enumerate(numeric)})
    t = lambda c: F.col(f"_t{numeric.index(c)}")

    df = _parse_int(df, t(req[0]), "_g", raw_text(req[0]))
    g_bad = F.col("_g_msg").isNotNull()
    out = {G: F.col("_g_val")}
    if dataset_type == "admin_boundaries":
        # as a generator: filters on what it gives stay behind it, so a text is read once
        df = df.select("*", F.inline(F.array(wkt_geometry(raw_text("wkt")))).alias("_geom", "_w_msg"))
        msgs = [F.col("_g_msg"), F.when(~g_bad, F.col("_w_msg"))]
        out.update({"governorate_code": raw_text("governorate_code"),
                    "governorate_name_en": raw_text("governorate_name_en"),
                    "boundary_coords": F.col("_geom")})
        invalid_month, negative = F.lit(False), F.lit(False)
    else:
        df = _parse_month(df, t(M), "_m", raw_text(M))
        out[M] = F.col("_m_val")
        m_bad = F.col("_m_msg").isNotNull()
        msgs = [F.col("_g_msg"), F.when(~g_bad, F.col("_m_msg"))]
        prior = ~g_bad & ~m_bad
        neg = F.lit(False)
        for i, (name, dtype) in enumerate(MEASURES[dataset_type]):
            df = _parse_float(df, t(name), f"_v{i}", dtype, raw_text(name))
            out[name] = F.col(f"_v{i}_val")
            msgs.append(F.when(prior, F.col(f"_v{i}_msg")))
            prior = prior & F.col(f"_v{i}_msg").isNull()
            neg = neg | (F.col(f"_v{i}_dbl") < 0)
        invalid_month = ~g_bad & m_bad
        negative = prior & neg
    df = df.select(ROW, MALFORMED, "_raw", "_null_like", *[v.alias(k) for k, v in out.items()],
                   *[raw_text(c).alias(k) for k, c in zip(KEYS, req)],
                   F.coalesce(*msgs).alias("error_message"),
                   F.coalesce(invalid_month, F.lit(False)).alias("_invalid_month"),
                   F.coalesce(negative, F.lit(False)).alias("_negative"))
    if governorate is not None:   # SRC-13: referential check, quarantined
        known = governorate.select(F.col(G).alias("_known_g")).distinct()
        df = (df.join(known, F.col(G) == F.col("_known_g"), "left")
              .withColumn("error_message", F.coalesce(
                  "error_message",
                  F.when(F.col("_known_g").isNull(),
                         F.concat(F.lit("governorate_id "), F.col(G).cast("string"),
                                  F.lit(" is not a known governorate")))))
              .drop("_known_g"))
    # the whole record as text, of rejected rows only
    raw_json = F.when(F.col("error_message").isNotNull(), F.to_json("_raw", {"ignoreNullFields": "false"}))
    return df.withColumns({"_ok": F.col("error_message").isNull(), "raw_row_json": raw_json}).drop("_raw")


# --- outputs ----------------------------------------------------------------

def loaded_rows(typed: DataFrame, dataset_type: str) -> DataFrame:
    """Keyed upsert: among good rows, the last row of each typed key wins
    (boundaries are keyed by region id alone).  Measures and ``_row`` have a fixed
    width, so this is a hash aggregate; boundaries, a few rows, hold text and arrays."""
    good = typed.where("_ok")
    if dataset_type == "admin_boundaries":
        vals = ["governorate_code", "governorate_name_en", "boundary_coords"]
        return good.groupBy(G).agg(F.max_by(F.struct(*vals), ROW).alias("_w")) \
            .select(G, *[F.col(f"_w.{v}").alias(v) for v in vals], F.lit(4326).alias("srid"))
    return good.groupBy(G, M).agg(*[F.max_by(n, ROW).alias(n) for n, _ in MEASURES[dataset_type]])


def error_rows(typed: DataFrame) -> DataFrame:
    """Error sink rows: (row_number, error_message, raw_row_json)."""
    bad = typed.where(~F.col("_ok")).select(ROW, "error_message", "raw_row_json")
    return with_line_numbers(bad).select("row_number", "error_message", "raw_row_json")


def duplicate_keys(typed: DataFrame, dataset_type: str) -> DataFrame:
    """Raw-text keys (first two required columns) seen more than once."""
    names = [f"raw_{c}" for c in S.REQUIRED_COLUMNS[dataset_type][:2]]
    return (typed.select(*[F.col(k).alias(n) for k, n in zip(KEYS, names)]).groupBy(*names)
            .agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1))


def summary(typed: DataFrame, dataset_type: str) -> DataFrame:
    """One-row validation summary and job counters (SRC-7, AG-9, SRC-11)."""
    dups = duplicate_keys(typed, dataset_type).agg(
        F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).cast("long").alias("duplicates_in_file"))
    counts = typed.agg(
        F.count(F.lit(1)).alias("processed_rows"),
        F.count(F.when(F.col("_ok"), 1)).alias("success_rows"),
        F.count(F.when(~F.col("_ok"), 1)).alias("error_rows"),
        F.count(F.when(F.col("_negative"), 1)).alias("negative_values"),
        F.count(F.when(F.col("_invalid_month"), 1)).alias("invalid_months"),
        F.count(F.when(F.col("_null_like"), 1)).alias("null_like_values"))
    out = counts.crossJoin(dups)   # 1 row x 1 row
    return out.select(
        "processed_rows", "success_rows", "error_rows",
        *S.SUMMARY_COUNTERS,
        F.when(F.col("error_rows") == 0, F.lit("completed")).otherwise(F.lit("completed_with_errors")).alias("status"),
        F.concat(F.lit("Imported "), F.col("success_rows").cast("string"), F.lit(" row(s)")).alias("message"),
        F.to_json(F.struct(*[F.col(c) for c in S.SUMMARY_COUNTERS])).alias("validation_summary_json"),
    )


def outputs(typed: DataFrame, dataset_type: str) -> dict:
    return {"typed": typed, "loaded": loaded_rows(typed, dataset_type),
            "errors": error_rows(typed), "summary": summary(typed, dataset_type)}


def import_rows(raw: DataFrame, dataset_type: str, governorate: DataFrame | None = None,
                persist: bool = False) -> dict:
    """Run the import on an all-string frame with ``_row`` (and optionally
    ``_malformed``).  Returns loaded / errors / summary frames.  The target
    table is replaced by ``loaded`` (full refresh), even when it is empty.

    With ``persist`` the typed rows are staged once, good and bad rows in folders of
    their own: every record is parsed exactly once and each output reads its columns
    and its rows only."""
    typed = typed_rows(raw, dataset_type, governorate)
    return outputs(stage_table(typed, "import", "_ok") if persist else typed, dataset_type)


def import_csv(spark: SparkSession, path: str, dataset_type: str, governorate: DataFrame | None = None,
               split_bytes: int | None = None) -> dict:
    """Import a CSV file, folder or glob; ``records`` of the result numbers the rows."""
    records = open_csv(spark, path, dataset_type, split_bytes)
    typed = [typed_rows(raw, dataset_type, governorate) for raw in header_rows(records)]
    staged = stage_table(reduce(DataFrame.unionByName, typed), "import", "_ok")
    return outputs(staged, dataset_type) | {"records": records}


def job_row(summary_df: DataFrame, import_job_id: int, dataset_type: str, filename: str,
            created_by: str | None = None) -> DataFrame:
    """Import-job ledger row (append to the job ledger)."""
    return summary_df.select(
        F.lit(import_job_id).cast("long").alias("import_job_id"),
        F.lit(dataset_type).alias("dataset_type"), F.lit(filename).alias("filename"),
        "status", "processed_rows", "success_rows", "error_rows", "message", "validation_summary_json",
        F.lit(created_by).cast("string").alias("created_by"), F.current_timestamp().alias("created_at"))


def error_ledger_rows(errors: DataFrame, import_job_id: int) -> DataFrame:
    """Error rows tagged with their job id (append to the error ledger)."""
    return errors.select(F.lit(import_job_id).cast("long").alias("import_job_id"), "row_number", "error_message",
                         "raw_row_json", F.current_timestamp().alias("created_at"))


def duplicate_flags(typed: DataFrame, dataset_type: str) -> DataFrame:
    """Per-row in-file duplicate flag: the 2nd+ occurrence of a raw key.

    First occurrence per key = min(_row) from a combinable aggregate, joined
    back on the key -- no window holding all rows of a hot key."""
    k = typed.select(ROW, *KEYS)
    first = k.groupBy(*KEYS).agg(F.min(ROW).alias("_first"))
    return (k.join(first, k[KEYS[0]].eqNullSafe(first[KEYS[0]]) & k[KEYS[1]].eqNullSafe(first[KEYS[1]]))
            .select(ROW, (F.col(ROW) > F.col("_first")).alias("is_duplicate")))


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("import_job_id").desc())


def list_errors(errors: DataFrame, import_job_id: int) -> DataFrame:
    return errors.where(F.col("import_job_id") == import_job_id).orderBy("row_number")


def fk_violations(fact: DataFrame, governorate: DataFrame) -> DataFrame:
    """Fact rows whose region is not in the dimension (left anti join)."""
    return fact.join(governorate.select(G), G, "left_anti")


def _typed_boundaries(raw: DataFrame) -> DataFrame:
    if ROW not in raw.columns:
        raw = raw.withColumn(ROW, F.lit(0).cast("long"))
    return typed_rows(raw, "admin_boundaries")


def parse_boundaries(raw: DataFrame) -> DataFrame:
    """Typed boundaries from raw (id, code, name, wkt) strings; the rows that are not
    valid are those of ``rejected_boundaries``."""
    return loaded_rows(_typed_boundaries(raw), "admin_boundaries")


def rejected_boundaries(raw: DataFrame) -> DataFrame:
    """The invalid rows with their messages."""
    return error_rows(_typed_boundaries(raw))

