"""Quality rules: one threshold table compiled into one Spark projection.

``measured(df)`` adds integer measures of a text and ``judged(df, rules)``
adds one boolean per rule group, all as built-in column expressions.  A rule
compares integer measures (``100 * part <= percent * whole``), so every
engine gives the same verdict.

Defined cases: a null text counts as an empty one (no words, rejected);
extra columns pass through, and an input column named like a measure is
replaced; repeated rows are judged one by one; an empty table gives an empty
result.  Words are runs of anything but ASCII white space; lines split at
``\n`` and count only when they hold a word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the "
    "their they this to was were which will with you "
    "au aux avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "auf aus das dem den der des die ein eine einen er es für im ist mit nicht sich sie und von zu "
    "al como con del el es las lo los más no para por se su una y").split()

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_stop_words", "n_letter_words", "n_bang_words", "n_bullet_lines", "n_ellipsis_lines")


@dataclass(frozen=True)
class Rule:
    """``100 * part`` must lie in ``[low, high]`` percent of ``whole`` (None: no bound)."""
    name: str
    part: str
    whole: str | None = None
    low: int | None = None
    high: int | None = None

    def sql(self) -> str:
        whole = f" * {self.whole}" if self.whole else ""
        part = f"100 * {self.part}" if self.whole else self.part
        tests = [f"{part} {op} {bound}{whole}" for op, bound in ((">=", self.low), ("<=", self.high))
                 if bound is not None]
        return "(" + " AND ".join(tests) + ")"


# Base rules: enough words, and at most half of them inside repeated word triples.
BASE_RULES = (
    Rule("words", "n_words", low=50),
    Rule("repeated words", "n_repeat_words", "n_words", high=50),
)

# The method's own threshold table.
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=300, high=1000),
    Rule("symbols per word", "n_symbols", "n_words", high=10),
    Rule("words with a letter", "n_letter_words", "n_words", low=80),
    Rule("exclamations", "n_bang_words", "n_words", high=30),
    Rule("stop words", "n_stop_words", "n_words", low=3),
    Rule("duplicate lines", "n_dup_lines", "n_lines", high=34),
    Rule("bullet lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis lines", "n_ellipsis_lines", "n_lines", high=30),
)

_TRIPLES = "CASE WHEN size(__w) > 2 THEN transform(sequence(0, size(__w) - 3), " \
           "i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) ELSE array() END"

# Of texts with a repeated triple: sort hashes with their word index, keep the indexes whose
# neighbour has the same hash and the same words.
_SORTED = "sort_array(transform(__h, (h, i) -> struct(h AS h, i AS i)))"
_SAME = "{a}.h = {b}.h AND slice(__w, {a}.i + 1, 3) = slice(__w, {b}.i + 1, 3)"
_REPEATED = ("sort_array(transform(filter(__s, (x, k) -> "
             f"(k > 0 AND {_SAME.format(a='x', b='__s[k - 1]')}) OR "
             f"(k < size(__s) - 1 AND {_SAME.format(a='x', b='__s[k + 1]')})), x -> x.i))")
# Words covered by the kept triples: each adds three, less what the next one covers too.
_COVERED = ("aggregate(transform(__p, (x, k) -> IF(k < size(__p) - 1, least(3, __p[k + 1] - x), 3)), "
            "0L, (s, x) -> s + x)")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the integer measures of MEASURES (all bigint)."""
    names = [c for c in df.columns if c.lower() not in MEASURES]
    # the input travels as one struct, so that no column of it can clash with a helper column
    t = df.select(F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("__end")).alias("__row"),
                  F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    # one layer per helper: Catalyst keeps layers apart that a later one reads more than once
    t = t.withColumns({"__w": F.expr(rf"regexp_extract_all(__t, '{_sql_re(WORD_RE)}', 0)"),
                       "__l": F.expr(rf"filter(split(__t, '\n', -1), x -> x rlike '{_sql_re(WORD_RE)}')")})
    t = t.withColumn("__h", F.expr(_TRIPLES))
    t = t.withColumn("__s", F.expr(f"CASE WHEN size(array_distinct(__h)) < size(__h) THEN {_SORTED} END"))
    t = t.withColumn("__p", F.expr(f"CASE WHEN __s IS NOT NULL THEN {_REPEATED} END"))
    count = lambda array, test: F.expr(f"CAST(size(filter({array}, x -> {test})) AS BIGINT)")
    measures = {
        "n_words": F.expr("CAST(size(__w) AS BIGINT)"),
        "word_chars": F.expr("CAST(char_length(array_join(__w, '')) AS BIGINT)"),
        "n_symbols": F.expr("CAST(char_length(__t) - char_length(translate(__t, '#*$%&|<>', '')) AS BIGINT)"),
        "n_dup_lines": F.expr("CAST(size(__l) - size(array_distinct(__l)) AS BIGINT)"),
        "n_repeat_words": F.expr(f"CASE WHEN __p IS NULL THEN 0L ELSE {_COVERED} END"),
        "n_lines": F.expr("CAST(size(__l) AS BIGINT)"),
        "n_stop_words": count("__w", f"lower(x) IN ({stops})"),
        "n_letter_words": count("__w", r"x rlike '\\p{L}'"),
        "n_bang_words": count("__w", "endswith(x, '!!')"),
        "n_bullet_lines": count("__l", r"ltrim(x) rlike '^[-*•]'"),
        "n_ellipsis_lines": count("__l", r"rtrim(x) rlike '(\\.\\.\\.|…)$'"),
    }
    return t.select(*[F.col("__row").getField(c).alias(c) for c in names],
                    *[measures[m].alias(m) for m in MEASURES])


def _sql_re(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def failed(rules) -> F.Column:
    """True where any rule of the table fails."""
    return F.expr("NOT (" + " AND ".join(r.sql() for r in rules) + ")")


def judged(df: DataFrame, text: str = "text", base=BASE_RULES, rules=RULES) -> DataFrame:
    """``measured(df)`` with ``base_failed`` and ``kept`` (base passed and every rule passed)."""
    m = measured(df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("base_failed", "kept")]), text)
    m = m.withColumn("base_failed", failed(base))
    return m.withColumn("kept", ~F.col("base_failed") & ~failed(rules))


def clean_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes every rule, with the input's columns."""
    j = judged(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                         F.col(f"`{text}`").alias("__text")), "__text")
    # a filter is not pushed below a row number: pushed down, it would hold every measure's whole
    # expression wherever one refers to another
    j = j.withColumn("__row_no", F.monotonically_increasing_id())
    return j.where(F.col("kept") & (F.col("__row_no") >= 0)).select(*[F.col("row").getField(c).alias(c) for c in df.columns])
