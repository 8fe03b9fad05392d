"""Text normalisation as column expressions.

All but ``tokens_with_positions`` stay in the JVM. Case folding is lower case
plus the one Latin-1 letter that folds to two (sharp s).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.functions.stopwords import STOP_WORDS

#: Signs that become blanks, fixed values; apostrophe and full stop stay.
PUNCTUATION = "\t\n\r;\"&/:!#?$%()@^*+-,=><[]{}|`~_"
LATIN_TERM = "[a-zªºà-öø-ÿ]+"
POSITION = T.StructType([T.StructField("token_pos", T.IntegerType()), T.StructField("char_pos", T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))])
TOKEN = T.StructType([T.StructField("token", T.StringType()), *POSITION.fields])


def blank_out(text: Column, chars: str) -> Column:
    """Every character of ``chars`` becomes a blank."""
    return F.translate(text, chars, " " * len(chars))


def strip_punctuation(text: Column) -> Column:
    return blank_out(text, PUNCTUATION)


def fold_case(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("ß"), F.lit("ss")))


def tokenise(text: Column) -> Column:
    """Array of case-folded runs of Latin-1 letters; null for a null text."""
    return F.regexp_extract_all(fold_case(text), F.lit(LATIN_TERM), F.lit(0))


def letters_only(token: Column) -> Column:
    return F.regexp_replace(fold_case(token), r"[^\p{L}]", "")


def split_words(text: Column) -> Column:
    """Array of runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def has_alphanumeric(token: Column) -> Column:
    return token.rlike(r"[\p{L}\p{N}]")


@F.pandas_udf(T.ArrayType(TOKEN))
def tokens_with_positions(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """White-space tokens with their number and inclusive character span, in code points."""
    import re

    for s in texts:
        yield s.map(lambda t: None if t is None else [{"token": m[0], "token_pos": n, "char_pos": {"begin": m.start(), "end": m.end() - 1}} for n, m in enumerate(re.finditer(r"\S+", t))])


def positioned(text: Column) -> Column:
    """Punctuation blanked out, then tokens with positions."""
    return tokens_with_positions(strip_punctuation(text))


def counted_length(tokens: Column) -> Column:
    """Tokens with a letter or digit, before any is dropped: a document's length."""
    return F.size(F.filter(tokens, lambda x: has_alphanumeric(x["token"])))


def streaming_terms(tokens: Column) -> Column:
    """Folded letters of each token; terms of up to two letters go."""
    terms = F.transform(tokens, lambda x: F.struct(letters_only(x["token"]).alias("term"), x["token_pos"].alias("token_pos"), x["char_pos"].alias("char_pos")))
    return F.filter(terms, lambda x: F.length(x["term"]) > 2)


def index_terms(tokens: Column, stop: frozenset[str] = STOP_WORDS) -> Column:
    """Tokens of 3 to 99 characters, folded to letters, without stop words; empty terms can stay."""
    sized = F.filter(tokens, lambda x: F.length(x["token"]).between(3, 99))
    terms = F.transform(sized, lambda x: F.struct(letters_only(x["token"]).alias("term"), x["token_pos"].alias("token_pos"), x["char_pos"].alias("char_pos")))
    return F.filter(terms, lambda x: ~x["term"].isin(sorted(stop)))


def index_words(text: Column, stop: frozenset[str] = STOP_WORDS) -> Column:
    """The terms of ``index_terms`` without positions, all in the JVM."""
    sized = F.filter(split_words(strip_punctuation(text)), lambda t: F.length(t).between(3, 99))
    return F.filter(F.transform(sized, letters_only), lambda t: ~t.isin(sorted(stop)))


def drop_stop_words(tokens: Column, stop: frozenset[str] = STOP_WORDS) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(sorted(stop)))


def looks_like_html(text: Column) -> Column:
    start = F.lower(F.substring(text, 1, 200))
    return start.contains("<html") | start.contains("<!doctype")


def strip_stream_time(doc_name: Column) -> Column:
    """A document's name after the first hyphen."""
    return F.regexp_replace(doc_name, "^[^-]*-?", "")


def merge_positions(positions: Column) -> Column:
    """The span of several positions: smallest begin and number, largest end."""
    return F.struct(
        F.array_min(F.transform(positions, lambda x: x["token_pos"])).alias("token_pos"),
        F.struct(F.array_min(F.transform(positions, lambda x: x["char_pos"]["begin"])).alias("begin"), F.array_max(F.transform(positions, lambda x: x["char_pos"]["end"])).alias("end")).alias("char_pos"),
    )


def ln(x: Column) -> Column:
    """Natural logarithm with -inf at 0, where Spark has NULL."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf")))


def scientific(log_value: Column, digits: int = 14) -> Column:
    """A natural-log number in scientific notation, beyond the range of a double."""
    log10 = log_value / F.lit(2.302585092994046)
    exponent = F.floor(log10)
    return F.format_string(f"%.{digits - 1}fe%d", F.pow(F.lit(10.0), log10 - exponent), exponent)


def latin1_fallback(data: Column) -> Column:
    """UTF-8 where the bytes are valid, else ISO-8859-1."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def vector_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_norm(a: Column) -> Column:
    return F.sqrt(vector_dot(a, a))


def vector_scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def vector_zip(a: Column, b: Column, op: str) -> Column:
    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / y}
    return F.zip_with(a, b, ops[op])


def vector_unit(a: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    n = vector_norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def random_vector(dim: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Column:
    """A vector of uniform numbers for each row, the same for equal seeds and partitions."""
    return F.array(*((F.lit(low) + F.rand(seed + i) * (high - low)).cast("float") for i in range(dim)))
