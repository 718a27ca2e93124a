import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.config import BATCH_KEYWORDS, Settings, app_info
from docloom.functions import metadata as meta
from docloom.functions import text as fn

#: (a, b, whether they are different)
PAIRS = [
    ("the quick brown fox jumps over one lazy dog", "The quick brown cat jumps over one lazy dog", False),
    ("the quick brown fox jumps over one lazy dog", "rain fell on a red roof all week", True),
    ("", "some text", True),
    ("text", "", True),
    ("", "", True),
    (None, "x", True),
    (" ".join("abcdefghij"), " ".join("abc") + " k l m", True),
    ("a b c d e f", "a b c g h i j", False),
    ("a b c d e f", "a b c g h i j k", True),
]
texts = st.text(alphabet=st.sampled_from(list("aAbB ßİéÉ1.\t\n\x0b\x1c\x85\xa0 　 ")), max_size=30)
quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def different(a, b):
    x, y = (set((t or "").lower().split()[:50]) for t in (a, b))
    return not x or not y or 10 * len(x & y) < 3 * len(x | y)


def test_similarity(spark):
    rows = spark.createDataFrame(PAIRS, "a string, b string, want boolean").withColumn("got", fn.is_different(F.col("a"), F.col("b"))).collect()
    assert all(r.got == r.want == different(r.a, r.b) for r in rows)


@quick
@given(st.lists(texts, min_size=30, max_size=60))
def test_text_functions_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    got = df.select("t", fn.words(F.col("t")).alias("words"), fn.strip(F.col("t")).alias("strip"), fn.is_upper(F.col("t")).alias("upper")).collect()
    for r in got:
        assert r.words == r.t.split() and r.strip == r.t.strip()
        if not set(r.t) & set("ßİ"):
            assert r.upper == r.t.isupper()


def test_white_space_is_what_python_strips():
    assert sorted(fn.WHITE_SPACE) == sorted(c for c in map(chr, range(0x110000)) if c.isspace())


def test_small_functions(spark):
    one = spark.range(1).select(
        fn.block_text(F.lit(None), F.lit("<p> x <b>y</b></p>")).alias("a"), fn.block_text(F.lit(" t "), F.lit("<p>z</p>")).alias("b"), fn.block_text(F.lit(""), F.lit("<p> </p>")).alias("c"),
        fn.stem(F.lit("/x/y.tar.gz")).alias("d"), fn.stem(F.lit(".profile")).alias("e"), fn.basename(F.lit("/x/y.PDF")).alias("f"), fn.is_pdf(F.lit("y.PDF")).alias("g"),
        fn.megabytes(F.lit(131072)).alias("h"), fn.contains_any(F.lit("see Abstract: 1"), BATCH_KEYWORDS).alias("i"), fn.contains_any(F.lit("see abstract"), BATCH_KEYWORDS).alias("j"),
    ).first()
    assert tuple(one) == ("x y", "t", None, "y.tar", ".profile", "y.PDF", True, 0.12, True, False)


@pytest.mark.parametrize("given_, want", [("{12345678-1234-5678-1234-56781234ABCD}", True), ("urn:uuid:12345678123456781234567812345678", True), ("123", False), ("", False), (None, False)])
def test_uuids(spark, given_, want):
    assert (spark.range(1).select(fn.normalised_uuid(F.lit(given_).cast("string"))).first()[0] is not None) == want


def test_metadata(spark):
    rows = [("{}", '{"a": 1}'), ('{"a": 1, "b": "x"}', '{"a": [2]}'), ("bad", '{"c": true}'), (None, None), ("[1]", "{}"), ("null", "{}"), ("", "{}")]
    got = spark.createDataFrame(rows, "l string, r string").select(meta.merged(F.col("l"), F.col("r")), meta.metadata_error(F.col("l")), meta.parsed(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [
        ('{"a":1}', None, "{}"), ('{"b":"x","a":[2]}', None, '{"a": 1, "b": "x"}'), ('{"c":true}', None, "{}"), ("{}", None, "{}"),
        ("{}", "metadata is not an object", "{}"), ("{}", None, "{}"), ("{}", None, "{}"),
    ]


def test_settings():
    own = Settings.from_env({"MAX_FILE_SIZE_MB": "2", "MARKER_USE_LLM": "True", "RETRY_ATTEMPTS": "5"})
    assert (own.max_file_size, own.use_llm, own.extract_images, own.retry_attempts) == (2097152, True, True, 5)
    assert own.extractor_options()["output_format"] == "markdown" and len(own.extractor_options()) == 9
    assert set(app_info()) == {"name", "version", "description"}
