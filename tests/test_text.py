import pytest
from pyspark.sql import functions as F

from tablesmith.functions import text as tf
from tablesmith.operators import text


def one(spark, values, fn, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


def test_title_case_matches_python(spark):
    samples = ["it's foo-bar o2x  BIG 中a", "ßtz und ßa", "ΣΑΣ ǆa", "hello   world.\nnew line",
               "o'neil-smith 3rd", "", "ALL CAPS", "a.b,c;d"]
    assert one(spark, samples, tf.title_case) == [s.title() for s in samples]
    assert one(spark, [None], tf.title_case) == [None]


@pytest.mark.parametrize("src,expected", [
    ("Call me at 3365145915 or (919) 223-0874", "Call me at1(336)514-5915 or1(919)223-0874"),
    ("Main: 216-402-9971, emergency contact is 6183675061.",
     "Main: 1(216)402-9971, emergency contact is1(618)367-5061."),
    ("Invalid number 12345, real one is 18005551234", "Invalid number 12345, real one is 1(800)555-1234"),
    ("119192230874", "119192230874"),
])
def test_format_phone_fixtures(spark, src, expected):
    assert one(spark, [src], tf.format_phone) == [expected]


def test_format_phone_null_is_empty(spark):
    assert one(spark, [None], tf.format_phone) == [""]


def test_email_valid_fixture(spark):
    vals = ["a@b.co", "a@b", "a b@c.d", "x@y.z.", "", None]
    assert one(spark, vals, tf.email_valid) == [True, False, False, True, False, None]


def test_validate_emails_clear_and_drop(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (2, "bad"), (3, None)], "id int, email string")
    cleared = {r.id: r.email for r in text.validate_emails(df, ["email"], "clear").collect()}
    assert cleared == {1: "a@b.co", 2: None, 3: None}
    kept = sorted(r.id for r in text.validate_emails(df, ["email"], "remove_row").collect())
    assert kept == [1, 3]
    with pytest.raises(ValueError):
        text.validate_emails(df, None)


def test_trim_unicode_whitespace(spark):
    vals = ["  a b \t", " x ", "\n y \n"]
    assert one(spark, vals, tf.strip_whitespace) == [v.strip() for v in vals]


def test_replace_literal_is_literal_and_case_insensitive(spark):
    vals = ["The cat. the dog. THE $1 end", None]
    got = one(spark, vals, lambda c: tf.replace_literal(c, "the", "a$1\\g<0>"))
    assert got == ["a$1\\g<0> cat. a$1\\g<0> dog. a$1\\g<0> $1 end", None]
    got = one(spark, ["a.b.c"], lambda c: tf.replace_literal(c, ".", "-", match_case=True))
    assert got == ["a-b-c"]


def test_replace_regex_python_templates(spark):
    import re
    vals = ["john smith, jane doe", "x"]
    pat, repl = r"(?P<first>\w+) (\w+)", r"\2 \g<first> \g<1>"
    got = one(spark, vals, lambda c: tf.replace_regex(c, pat, repl, match_case=True))
    assert got == [re.sub(pat, repl, v) for v in vals]


def _py(pattern: str) -> str:
    """Our constants carry Java flags; Python's re is Unicode-aware by default."""
    return pattern.replace("(?mU)", "(?m)").replace("(?U)", "")


# (kind, pattern, replacement) applied in order, then a whitespace strip
MD_STEPS = [("re", tf.MD_CHARS_PATTERN, ""), ("re", _py(tf.BULLET_LINE_PATTERN), ""),
            ("text", "\r\n", "\n"), ("text", "\r", "\n"),
            ("re", tf.SPACE_BEFORE_NEWLINE_PATTERN, "\n"), ("re", r"\n{3,}", "\n\n")]


def _py_strip_markdown(value):
    import re
    for kind, pat, rep in MD_STEPS:
        value = re.sub(pat, rep, value) if kind == "re" else value.replace(pat, rep)
    return value.strip()


def _py_segments(raw):
    import re
    plain = _py_strip_markdown(raw)

    def tidy(piece):
        piece = piece.strip(tf.SEGMENT_STRIP_CHARS)
        return re.sub(_py(tf.NUMBER_PREFIX_PATTERN), "", piece).strip() if piece else ""

    tidied = (tidy(p) for p in re.split(_py(tf.INLINE_SPLIT_PATTERN), plain) if p and not p.isspace())
    kept = [p for p in tidied if p and not re.fullmatch(tf.PUNCT_ONLY_PATTERN, p)]
    return kept or [plain.strip()]


MD_SAMPLES = ["**Bold** and _it_ and `code`\n- item one\n* item two\n\n\n\nEnd.  \nNext",
              "Steps: 1. open the box. 2. Take it out; then done.\nFinally (a) close.",
              "  \r\n  • bullet\r\nplain  ", "Title:\n\n1) first\n2) second", "...", "x"]


def test_strip_markdown_matches_python(spark):
    assert one(spark, MD_SAMPLES, tf.strip_markdown) == [_py_strip_markdown(s) for s in MD_SAMPLES]


def test_split_segments_matches_python(spark):
    got = one(spark, MD_SAMPLES, tf.split_segments)
    assert [list(g) for g in got] == [_py_segments(s) for s in MD_SAMPLES]


def test_split_segments_on_conversations(spark):
    from conftest import SF01
    conv = spark.read.parquet(f"{SF01}/conversations.parquet")
    seg = text.split_segments(conv, "text", keys=["conv_id", "turn"])
    got = {}
    for r in seg.collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.segment_no, r.segment))
    expected = {(r.conv_id, r.turn): _py_segments(r.text) for r in conv.collect()}
    assert {k: [s for _, s in sorted(v)] for k, v in got.items()} == expected


def test_string_op_unknown_raises(spark):
    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(ValueError):
        text.string_op(df, "reverse")


def test_python_float_and_timestamp_text(spark):
    import datetime
    vals = [6.55, 10000000.0, 12345678.9, 0.1 + 0.2, 5.0, -0.0, 0.0001, 1e-05, 2.5e-3, 1 / 3, 1.5e16, -2e20,
            float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(tf.python_float_text(F.col("x"))).collect()]
    assert got == [None if v is None else str(v) for v in vals]
    ts = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5),), (datetime.datetime(2024, 1, 2, 3, 4, 5, 120),)],
                               "t timestamp")
    assert [r[0] for r in ts.select(tf.python_timestamp_text(F.col("t"))).collect()] == \
        ["2024-01-02 03:04:05", "2024-01-02 03:04:05.000120"]


def test_named_groups_and_backreferences_translate(spark):
    import re
    vals = ["aab abab xx yy", "no match", "aaaa"]
    for pat, repl in [(r"(?P<x>a)(?P=x)", r"<\g<x>>"), (r"(?P<w>\w)(?P=w)", r"\g<w>!"), (r"(a)(b)", r"\2\1")]:
        got = one(spark, vals, lambda c: tf.replace_regex(c, pat, repl, match_case=True))
        assert got == [re.sub(pat, repl, v) for v in vals], pat
