"""The folding of region names against its definition in Python."""
import re
import unicodedata

from pyspark.sql import functions as F

from regiopanel.functions.names import normalize_name
from tests.plan_report import formatted


def fold(name):
    text = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", name.lower()))
    return re.sub("[^a-z0-9]+", " ", text.replace("`", "").replace("'", "")).strip()


def test_every_code_point_of_the_latin_blocks(spark):
    blocks = [(0x20, 0x250), (0x300, 0x370), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500), (0x2C60, 0x2C80),
              (0x3200, 0x3400), (0xA720, 0xA800), (0xFB00, 0xFB07), (0xFF00, 0xFF60), (0x1D400, 0x1D800)]
    chars = [chr(c) for lo, hi in blocks for c in range(lo, hi) if unicodedata.category(chr(c)) != "Cn"]
    # Java knows fewer letters' cases than Python in the newest additions
    chars = [c for c in chars if c.lower() == c or ord(c) < 0xA7C0]
    names = [n for c in chars for n in (c, f"a{c}b", f"x {c}{c}'s", f"E{c}́")]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select("n", normalize_name(F.col("n")).alias("k")).collect()]
    wrong = [(n, k, fold(n)) for n, k in got if k != fold(n)]
    assert not wrong, wrong[:20]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("Région",), (None,)], "n string")
    out = df.select(normalize_name(F.col("n")).alias("k"))
    assert [r.k for r in out.collect()] == ["region", ""]
    assert "PythonUDF" not in formatted(out) and "EvalPython" not in formatted(out)
