"""DuckDB statements of the queries over CSV text.  The order of the records is that in
which ``sources.uploads`` writes them: even order keys, then odd ones."""

LINES = """
line AS (
  SELECT *, l_orderkey * 8 + l_linenumber AS k,
         row_number() OVER (ORDER BY l_orderkey % 2, l_orderkey, l_linenumber, l_quantity, l_partkey, l_discount) AS ordinal
  FROM lineitem),
fields AS (
  SELECT ordinal, k, l_orderkey % 2 AS odd,
         CASE WHEN k % 97 = 5 THEN 'x' || l_suppkey ELSE CAST(l_suppkey % 50 AS VARCHAR) END AS g,
         CASE WHEN k % 89 = 3 THEN 'bad-month' WHEN k % 83 = 1 THEN strftime(l_shipdate, '%Y-%-m-1')
              ELSE strftime(l_shipdate, '%Y-%m-01') END AS m,
         CASE WHEN k % 79 = 2 THEN '' WHEN k % 73 = 4 THEN '-' || l_linenumber ELSE CAST(l_linenumber AS VARCHAR) END AS rooms,
         CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS beds,
         CASE WHEN k % 79 = 2 THEN 'n/a' WHEN k % 73 = 4 THEN ' ' || printf('%.2f', l_discount) || ' '
              ELSE printf('%.2f', l_discount) END AS rate,
         CASE WHEN k % 3 = 0 THEN 'shipped "' || l_returnflag || '",' || chr(10) || strftime(l_shipdate, '%Y-%m-%d')
              WHEN k % 3 = 1 THEN 'line ' || k || ', as ordered'
              ELSE chr(10) || l_linestatus || chr(13) || chr(10) || chr(10) END AS remarks
  FROM line),
checked AS (
  SELECT *, CASE WHEN g LIKE 'x%' THEN 'invalid literal for int() with base 10: ''' || g || chr(39)
                 WHEN m = 'bad-month' THEN 'time data ''bad-month'' does not match format ''%Y-%m-%d' || chr(39) END AS key_error
  FROM fields),
keyed AS (
  SELECT *, CAST(g AS INTEGER) AS governorate_id, CAST(strptime(m, '%Y-%m-%d') AS DATE) AS month_index
  FROM checked WHERE key_error IS NULL)"""

SQL = {
    "csv_records": """
        SELECT row_number() OVER (ORDER BY doc_id) AS ordinal, doc_id, lang,
               length(coalesce(text, '')) AS n_chars, md5(coalesce(text, '')) AS text_md5
        FROM documents""",
    "import_rooms_beds": f"""
        WITH {LINES}
        SELECT governorate_id, month_index, CAST(arg_max(rooms, ordinal) AS DOUBLE) AS total_rooms,
               CAST(arg_max(beds, ordinal) AS DOUBLE) AS total_beds
        FROM keyed WHERE rooms <> '' GROUP BY governorate_id, month_index""",
    "import_occupancy": f"""
        WITH {LINES}
        SELECT governorate_id, month_index, CAST(arg_max(trim(rate), ordinal) AS DOUBLE) AS average_occupancy_rate
        FROM keyed WHERE rate <> 'n/a' GROUP BY governorate_id, month_index""",
    "import_csv_errors": f"""
        WITH {LINES},
        bad AS (
          SELECT *, coalesce(key_error, CASE WHEN rooms = '' THEN 'could not convert string to float: ' || chr(39) || chr(39) END)
                    AS error_message
          FROM checked)
        SELECT ordinal, error_message,
               CASE WHEN odd = 0 THEN '{{"governorate_id":' || to_json(g) || ',"month_index":' || to_json(m) || ',"total_rooms":' || to_json(rooms)
                         || ',"total_beds":' || to_json(beds) || ',"remarks":' || to_json(remarks) || '}}'
                    ELSE '{{"remarks":' || to_json(remarks) || ',"total_beds":' || to_json(beds) || ',"month_index":' || to_json(m)
                         || ',"total_rooms":' || to_json(rooms) || ',"governorate_id":' || to_json(g) || '}}' END AS raw_row_json
        FROM bad WHERE error_message IS NOT NULL""",
    "import_csv_summary": f"""
        WITH {LINES},
        counts AS (
          SELECT count(*) AS processed_rows, count(*) FILTER (WHERE key_error IS NULL AND rate <> 'n/a') AS success_rows,
                 count(*) - count(DISTINCT (g, m)) AS duplicates_in_file, 0::BIGINT AS negative_values,
                 count(*) FILTER (WHERE g NOT LIKE 'x%' AND m = 'bad-month') AS invalid_months, 0::BIGINT AS null_like_values
          FROM checked)
        SELECT *, processed_rows - success_rows AS error_rows,
               CASE WHEN processed_rows = success_rows THEN 'completed' ELSE 'completed_with_errors' END AS status,
               'Imported ' || success_rows || ' row(s)' AS message,
               '{{"duplicates_in_file":' || duplicates_in_file || ',"negative_values":0,"invalid_months":' || invalid_months
               || ',"null_like_values":0}}' AS validation_summary_json
        FROM counts""",
}

# Rings of sources.proxy.nested_wkt: a square of side 8, most often with a hole of side 3,
# and a square of side 2; even keys run clockwise.
NESTED = """
c AS (
  SELECT c_custkey AS k, c_name, CAST(c_custkey % 180 - 90 AS DOUBLE) AS x, CAST(c_custkey % 80 - 40 AS DOUBLE) AS y,
         CASE WHEN c_custkey % 11 = 4 THEN 'a ring is not closed' WHEN c_custkey % 11 = 5 THEN 'a ring has fewer than 4 points'
              WHEN c_custkey % 11 = 6 THEN 'a ring has no area' WHEN c_custkey % 11 = 7 THEN 'a hole lies outside its shell' END AS error_message
  FROM customer)"""
SQL["nested_boundaries"] = f"""
    WITH {NESTED},
    rings AS (
      SELECT *, [[x, y], [x + 8, y], [x + 8, y + 8], [x, y + 8], [x, y]] AS shell,
             [[x + 1, y + 2], [x + 4, y + 2], [x + 4, y + 5], [x + 1, y + 5], [x + 1, y + 2]] AS hole,
             [[x + 20, y], [x + 22, y], [x + 22, y + 2], [x + 20, y + 2], [x + 20, y]] AS other
      FROM c WHERE error_message IS NULL)
    SELECT CAST(k AS INTEGER) AS governorate_id, 2 AS n_polygons, 2 AS n_rings, 8.0 * 8 - 3 * 3 + 2 * 2 AS area,
           CAST(to_json(struct_pack(type := 'Feature', geometry := struct_pack(type := 'MultiPolygon',
             coordinates := [[CASE WHEN k % 2 = 0 THEN list_reverse(shell) ELSE shell END, hole], [other]]),
             properties := struct_pack(governorate_id := CAST(k AS INTEGER), governorate_code := 'C' || k, governorate_name_en := c_name)))
             AS VARCHAR) AS feature_json
    FROM rings"""
SQL["nested_boundary_errors"] = f"""
    WITH {NESTED}
    SELECT row_number() OVER (ORDER BY k) AS ordinal, 'C' || k AS governorate_code, error_message
    FROM c QUALIFY error_message IS NOT NULL"""
