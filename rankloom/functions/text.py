"""Text normalisation, tokens and counts as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.constants import QUESTION_WORDS

# Unicode letters, numbers and underscore: the JVM's own \w is ASCII-only.
WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{2,}"
# Every Unicode white-space character, control separators 1C..1F included.
SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\p{Z}"
# The runs of them that are not one blank already.
SPACES = rf" [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*"
TITLE_WORD = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?![\p{L}\p{N}_])"


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def normalize_whitespace(col: Column) -> Column:
    """Null becomes '', white space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(_text(col), SPACES, " "))


def tokenize(col: Column) -> Column:
    """Lower-cased word tokens. White space never belongs to a word, so the text
    needs no normalising first."""
    return F.regexp_extract_all(F.lower(_text(col)), F.lit(WORD), F.lit(0))


def question_type(col: Column) -> Column:
    """First token if it is a question word, else 'other'. Only one match is made."""
    first = F.regexp_extract(F.lower(_text(col)), WORD, 0)
    return F.when(first.isin(QUESTION_WORDS), first).otherwise("other")


def title_word_count(col: Column) -> Column:
    """Whole words made of one ASCII capital and ASCII small letters."""
    return F.regexp_count(_text(col), F.lit(TITLE_WORD)).cast("bigint")


def text_key(col: Column) -> Column:
    """128-bit key of a text: 16 bytes instead of the text in joins and shuffles."""
    return F.unhex(F.md5(col))


def with_grams(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the uni- and bigram list of ``text``; words have at least two characters
    and shorter ones are gone before bigrams form."""
    w = f"__{out}_words"
    words = F.regexp_extract_all(F.lower(_text(F.col(text))), F.lit(LONG_WORD), F.lit(0))
    grams = f"""
        concat({w}, zip_with(
            slice({w}, 1, greatest(size({w}) - 1, 0)),
            slice({w}, 2, greatest(size({w}) - 1, 0)),
            (a, b) -> a || ' ' || b))"""
    return df.withColumn(w, words).withColumn(out, F.expr(grams)).drop(w)


def with_value_counts(df: DataFrame, values: str, out: str) -> DataFrame:
    """Add ``array<struct<value, n>>`` with the distinct elements of an array column
    and how often each occurs. Sorting keeps this n log n within the row, so counting
    words of a text needs no shuffle.

    The two helper columns are each read more than once, which keeps the optimizer
    from inlining the sort into the element-wise lambdas.
    """
    run, start = f"__{out}_sorted", f"__{out}_start"
    starts = f"""
        filter(
            if(size({run}) > 0, sequence(0, size({run}) - 1), cast(array() AS array<int>)),
            i -> i = 0 OR get({run}, i) <> get({run}, greatest(i - 1, 0)))"""
    counts = f"""
        zip_with(
            {start},
            slice(concat(slice({start}, 2, size({start})), array(size({run}))), 1, size({start})),
            (a, b) -> named_struct('value', get({run}, a), 'n', cast(b - a AS bigint)))"""
    return (
        df.withColumn(run, F.sort_array(values))
        .withColumn(start, F.expr(starts))
        .withColumn(out, F.expr(counts))
        .drop(run, start)
    )


def with_shared_terms(df: DataFrame, query: str, doc: str, out: str) -> DataFrame:
    """Add ``array<struct<value, n, query_n>>``: the terms two token columns share,
    with the count in the document and in the query. Stays within the row."""
    # Both sides are counted by one sort, each term with a mark of its side (no term holds a
    # control character); a shared term's two counts then stand next to each other.
    marked, counts = f"__{out}_marked", f"__{out}_counts"
    sides = f"concat(transform({doc}, t -> t || '\\u0001'), transform({query}, t -> t || '\\u0002'))"
    base = "substr({0}.value, 1, length({0}.value) - 1)"
    pairs = f"zip_with(slice({counts}, 1, greatest(size({counts}) - 1, 0)), slice({counts}, 2, size({counts})), (c, d) -> named_struct('c', c, 'd', d))"
    shared = f"""
        transform(
            filter({pairs}, p -> {base.format('p.c')} = {base.format('p.d')}),
            p -> named_struct('value', {base.format('p.c')}, 'n', p.c.n, 'query_n', p.d.n))"""
    return (
        with_value_counts(df.withColumn(marked, F.expr(f"if(size({query}) = 0, {query}, {sides})")), marked, counts)
        .withColumn(out, F.expr(shared))
        .drop(marked, counts)
    )


def explode_rows(df: DataFrame, *keep, items: Column, out: str) -> DataFrame:
    """``keep`` plus one row per element of an array.

    A plain explode makes the optimizer push "array is not empty" down to the scan with
    the whole expression behind the array inlined, which tokenises every text again,
    inside lambdas once per element. The outer form does not, and rows it adds for
    empty arrays are dropped here.
    """
    return df.select(*keep, F.explode_outer(items).alias(out)).where(F.col(out).isNotNull())
