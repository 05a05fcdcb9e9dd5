"""Row filters of a format: exact and substring matches, by strings or by words of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logmill.plans.spec import FieldSpec, LogFormat, MatchSpec

#: Words of a file up to which they become literals of an expression.
LITERAL_WORDS = 1000


def words_of_file(df: DataFrame, path: str) -> DataFrame:
    """``word``: the distinct white-space separated words of a file."""
    text = df.sparkSession.read.text(path)
    return text.select(F.explode(F.split("value", r"\s+")).alias("word")).where("word <> ''").distinct()


def contains_any(token: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(token, w)) if words else F.lit(False)


def contains_all(token: Column, words: list[str]) -> Column:
    return F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(token, w)) if words else F.lit(True)


def literal_match(token: Column, match: MatchSpec, words: list[str]) -> Column:
    """Whether the row passes this match alone."""
    if match.exact:
        hit = token.isin(words) if words else F.lit(False)
    elif match.negative or match.logic == "or":
        hit = contains_any(token, words)
    else:
        hit = contains_all(token, words)
    return ~hit if match.negative else hit


def _token(field: FieldSpec) -> Column:
    return F.get(F.col("tokens"), F.lit(field.pos))


def tokens_containing(found: DataFrame, listed: DataFrame, all_words: bool) -> DataFrame:
    """``word``: the distinct tokens of ``found`` (word) that contain a word of ``listed`` (word), or all of them.

    For lists of any size: the substrings of a token that have the length of a listed
    word meet the list in an equality join, so no list is held by a task or the driver.
    """
    lengths = sorted(r["n"] for r in listed.select(F.length("word").alias("n")).distinct().collect())  # few: one row per length

    def parts(n: int) -> Column:
        starts = F.when(F.length("word") >= n, F.sequence(F.lit(1), F.length("word") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.substring("word", i, F.lit(n))))

    tokens = found.distinct()
    cut = tokens.select(F.col("word").alias("token"), F.explode(F.flatten(F.array(*map(parts, lengths)))).alias("word"))
    met = cut.join(listed, "word")
    if not all_words:
        return met.select(F.col("token").alias("word")).distinct()
    return met.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == listed.count()).select(F.col("token").alias("word"))


def apply_matches(df: DataFrame, fmt: LogFormat) -> DataFrame:
    """Keep rows that pass every ``and`` match (and every match of a key field) and, if there are any, one ``or`` match.

    Long word lists become joins, which Spark broadcasts if their size allows; a lone
    ``and`` match is a semi or anti join.
    """
    must: list[Column] = []
    may: list[Column] = []
    dropped: list[str] = []
    source = df
    for i, f in enumerate(fmt.fields):
        if f.match is None or f.is_contain:
            continue
        token, required = _token(f), f.key or f.match.logic == "and"
        if f.match.match_file:
            listed = words_of_file(df, f.match.match_file)
            few = [r["word"] for r in listed.limit(LITERAL_WORDS + 1).collect()]
            if len(few) > LITERAL_WORDS:
                if not f.match.exact:
                    all_words = not f.match.negative and f.match.logic != "or"
                    listed = tokens_containing(source.select(token.alias("word")), listed, all_words)
                if required:
                    df = df.join(listed, token == F.col("word"), "left_anti" if f.match.negative else "left_semi")
                else:
                    flag = f"_listed{i}"
                    dropped.append(flag)
                    df = df.withColumn("_t", token).join(listed.withColumn(flag, F.lit(True)).withColumnRenamed("word", "_t"), "_t", "left").drop("_t")
                    hit = F.coalesce(F.col(flag), F.lit(False))
                    may.append(~hit if f.match.negative else hit)
                continue
            condition = literal_match(token, f.match, sorted(few))
        else:
            condition = literal_match(token, f.match, [f.match.match_str])
        (must if required else may).append(condition)
    for c in must:
        df = df.where(c)
    if may:
        df = df.where(reduce(lambda a, b: a | b, may))
    return df.drop(*dropped)
