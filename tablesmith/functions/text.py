"""Text column functions (Column -> Column), all built-in Spark expressions.

Python's ``re`` treats ``\\d``, ``\\s`` and ``\\b`` as Unicode classes; Java
does so only under the ``(?U)`` flag, so patterns that must agree with
Python-style semantics carry it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference behaviour for equal results.
# E-mail validation pattern (anchored, whole value):
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
# Phone numbers inside text: optional +/1 prefix, 3-3-4 digits, rewritten as 1(AAA)BBB-CCCC.
PHONE_PATTERN = r"(?U)\b(?:\+?1?[-.\s]?)?\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})\b"
PHONE_REPLACEMENT = "1($1)$2-$3"
# Markdown clean-up: emphasis/code marks, bullet prefixes, spaces before newlines.
MD_CHARS_PATTERN = r"(\*\*|\*|`|_{1,2})"
BULLET_LINE_PATTERN = r"(?mU)^\s*[-•]\s+"
SPACE_BEFORE_NEWLINE_PATTERN = r"[ \t]+\n"
# Segment splitting: newlines, sentence ends before a capital or '(', after ':' or ';',
# and before numbered items; number prefixes and punctuation-only parts are dropped.
INLINE_SPLIT_PATTERN = r"(?U)(?:\n+|(?<=\.)\s+(?=[A-Z(])|(?<=:)\s+|(?<=;)\s+|\s+(?=\d+[\.)]\s))"
NUMBER_PREFIX_PATTERN = r"(?U)^\s*\(?\d+[\.)]\s*"
SEGMENT_STRIP_CHARS = " \n\t-•–—"
PUNCT_ONLY_PATTERN = r"^[.;:,()\[\]{}]+$"
# ---------------------------------------------------------------------------

# str.strip() also takes the separators U+001C to U+001F
_UNICODE_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# One character that is not a cased letter (upper, lower or title case).
_NON_CASED = r"([^\p{Lu}\p{Ll}\p{Lt}])"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_whitespace(col) -> Column:
    """``str.strip()``: removes all leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), _UNICODE_STRIP, "")


def title_case(col) -> Column:
    """``str.title()``: a letter after any non-cased character starts a word
    (``it's foo-bar`` -> ``It'S Foo-Bar``), the rest of the word is lower case.

    ``initcap`` title-cases after spaces only, so a marker space is put after
    every non-cased character, ``initcap`` runs once over the whole text, and
    the markers are removed.  A word-initial sharp s titlecases to "Ss".
    """
    c = _c(col)
    marked = F.initcap(F.regexp_replace(c, _NON_CASED, "$1 "))
    titled = F.when(F.instr(marked, "ß") > 0, F.regexp_replace(marked, r"(^| )ß", "$1Ss")).otherwise(marked)
    return F.regexp_replace(titled, _NON_CASED + " ", "$1")


def email_valid(col) -> Column:
    # only \n ends a line for Python; Java's (?d) says the same
    return _c(col).rlike("(?d)" + EMAIL_PATTERN)


def format_phone(col) -> Column:
    """Rewrite every 10/11-digit phone number inside the text; NULL becomes ''."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), PHONE_PATTERN, PHONE_REPLACEMENT)


def strip_markdown(col) -> Column:
    """Remove emphasis/code marks and bullets, normalise newlines, strip."""
    c = F.regexp_replace(_c(col), MD_CHARS_PATTERN, "")
    c = F.regexp_replace(c, "(?d)" + BULLET_LINE_PATTERN, "")
    c = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    c = F.regexp_replace(c, SPACE_BEFORE_NEWLINE_PATTERN, "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip_whitespace(c)


def _strip_chars(col: Column, chars: str) -> Column:
    cls = "[" + "".join("\\" + ch if ch in "\\]-^[" else ch for ch in chars) + "]+"
    return F.regexp_replace(col, f"^{cls}|{cls}$", "")


def split_segments(col) -> Column:
    """Array of clean segments of the markdown-stripped text (never empty for non-NULL)."""
    text = strip_markdown(col)
    parts = F.split(text, INLINE_SPLIT_PATTERN, -1)
    parts = F.filter(parts, lambda p: F.length(strip_whitespace(p)) > 0)
    parts = F.transform(parts, lambda p: _strip_chars(p, SEGMENT_STRIP_CHARS))
    parts = F.transform(parts, lambda p: F.when(
        F.length(p) > 0, strip_whitespace(F.regexp_replace(p, NUMBER_PREFIX_PATTERN, ""))
    ).otherwise(p))
    parts = F.filter(parts, lambda p: (F.length(p) > 0) & ~p.rlike(PUNCT_ONLY_PATTERN))
    return F.when(text.isNull(), F.lit(None)).when(
        F.size(parts) > 0, parts).otherwise(F.array(strip_whitespace(text)))


# --- Python-style text of values (what ``astype(str)`` shows) ----------------

def python_float_text(col) -> Column:
    """``str(float)``: plain decimals for 1e-4 <= |x| < 1e16 (``10000000.0``,
    where Java prints ``1.0E7``), ``1e-05`` / ``1.5e+16`` outside that range.

    Digits come from the JVM's double-to-text conversion; before JDK 19 that
    is not always the shortest form (e.g. 2**-24), so such rare values show
    more digits than Python prints."""
    x = _c(col)
    java = x.cast("string")
    # plain digits as the JVM prints them; below 1e-3 and from 1e7 it prints an exponent, which a decimal
    # wide enough for all 17 digits undoes
    wide = F.when(F.abs(x) < 1, java.try_cast("decimal(38,30)").cast("string")).otherwise(
        java.try_cast("decimal(38,18)").cast("string"))
    unscaled = F.regexp_replace(F.regexp_replace(wide, "0+$", ""), r"\.$", ".0")
    plain = F.when(java.contains("E"), unscaled).otherwise(java)
    mant = F.regexp_replace(F.regexp_extract(java, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exp = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.abs(exp).cast("string")
    sci = F.concat(mant, F.lit("e"), F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
                   F.when(F.abs(exp) < 10, F.concat(F.lit("0"), digits)).otherwise(digits))
    ax = F.abs(x)
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("nan"))
            .when(x == F.lit(float("inf")), F.lit("inf"))
            .when(x == F.lit(float("-inf")), F.lit("-inf"))
            .when(x == 0, java)                      # "0.0" / "-0.0" as Python
            .when((ax >= F.lit(1e-4)) & (ax < F.lit(1e16)), plain)
            .otherwise(sci))


def python_timestamp_text(col) -> Column:
    """pandas text of a timestamp: seconds, plus microseconds when non-zero."""
    x = _c(col)
    return F.when(F.date_format(x, "SSSSSS") == F.lit("000000"), F.date_format(x, "yyyy-MM-dd HH:mm:ss")) \
        .otherwise(F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def check_regex(pattern: str) -> str:
    """Compile ``pattern`` with the JVM's regex engine (the one ``rlike`` and
    ``regexp_replace`` use) so a bad pattern fails here, not inside a task."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    if sc is not None:
        try:
            sc._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception as e:  # py4j wraps PatternSyntaxException
            msg = str(e).splitlines()
            raise ValueError(f"invalid regular expression {pattern!r}: {msg[1] if len(msg) > 1 else msg[0]}") from None
    return pattern


# --- find / replace -------------------------------------------------------

def java_quote(s: str) -> str:
    """Literal-match Java regex for ``s`` (handles an embedded ``\\E``)."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def java_literal_replacement(s: str) -> str:
    """Replacement text with ``\\`` and ``$`` taken literally."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def python_template_to_java(repl: str) -> str:
    """Translate a Python ``re.sub`` template to Java's ``Matcher`` syntax.

    ``\\1`` -> ``$1``, ``\\g<1>`` / ``\\g<name>`` -> ``$1`` / ``${name}``,
    other escapes keep their literal character, ``$`` is literal.
    """
    out = []
    i = 0
    simple = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\"}
    while i < len(repl):
        ch = repl[i]
        if ch == "\\" and i + 1 < len(repl):
            nxt = repl[i + 1]
            if nxt.isdigit():
                j = i + 1
                while j < len(repl) and repl[j].isdigit() and j < i + 3:
                    j += 1
                out.append("$" + repl[i + 1:j])
                i = j
                continue
            if nxt == "g" and i + 2 < len(repl) and repl[i + 2] == "<":
                end = repl.index(">", i + 3)
                name = repl[i + 3:end]
                out.append("$" + name if name.isdigit() else "${" + name + "}")
                i = end + 1
                continue
            out.append(simple.get(nxt, java_literal_replacement(nxt)))
            i += 2
            continue
        out.append("\\$" if ch == "$" else ch)
        i += 1
    return "".join(out)


def python_pattern_to_java(pattern: str) -> str:
    """Named-group spellings differ: ``(?P<n>..)`` and ``(?P=n)``."""
    import re
    pattern = pattern.replace("(?P<", "(?<")
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)


def replace_literal(col, find: str, repl: str, match_case: bool = False) -> Column:
    if not find:
        raise ValueError("find value cannot be empty")
    if match_case:
        return F.replace(_c(col), F.lit(find), F.lit(repl))
    return F.regexp_replace(_c(col), "(?iu)" + java_quote(find), java_literal_replacement(repl))


def replace_regex(col, pattern: str, repl: str, match_case: bool = False) -> Column:
    if not pattern:
        raise ValueError("find value cannot be empty")
    # Python classes are Unicode and only \n ends a line
    flags = "(?dU)" if match_case else "(?idU)"
    return F.regexp_replace(_c(col), check_regex(flags + python_pattern_to_java(pattern)),
                            python_template_to_java(repl))
