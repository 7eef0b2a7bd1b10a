"""Operator 7, quality rules: a table of thresholds compiled into one native Spark projection.

Words are runs of characters other than space and \\x09-\\x0D; lines are split at \\n. Everything is
a Column expression: no user function, no shuffle, one pass over the text. Stop words are those of four
languages (STOP_WORDS), so texts of others need a table of their own.

Cases: a null text counts as an empty one (no words, so the length rule fails it); a null id, ties
and repeated rows are each judged alone, one row out per row in; an empty table gives an empty
result; columns of the input are carried under their own names, except that a measure of the same
name replaces them. A ratio with denominator zero is null and fails no rule. Repeated windows are found by one
sort of longs that hold a hash and a place; in a text of 2**20 words or more, or one where hashes of different windows
are equal, by a sort of the windows themselves, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacelab.llm.shared import column, others, table, unused

# Common function words of four languages; a word counts in lower case, as it is written.
STOP_WORDS = {
    "en": "the of and to in is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back where much your way well down should because each just those people how too good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split(),
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au avec ce il elle par plus ne se son sa ses on sont mais ou nous vous aux leur cette".split(),
    "de": "der die das und ist in zu den von mit nicht des sich auf für ein eine einer dem im als auch an es war er sie wird bei aus nach wie oder am hat".split(),
    "es": "el la los las de que y en un una por con no se del al es lo su para como más pero sus le ha o este sí porque esta entre cuando muy sin".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document fails the rule when numerator / denominator is below least or above most."""

    name: str
    numerator: str
    denominator: str | None = None
    least: float | None = None
    most: float | None = None


#: The default threshold table.
RULES = (
    Rule("length", "n_words", None, 50, None),
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.10),
    Rule("stop_words", "n_stop_words", "n_words", 0.06, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.60),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.50),
)

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


#: Low bits of a window's key hold its place; texts of more words take the exact way.
PLACE_BITS = 20


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text holds twice or more.

    A window's key is the high bits of its hash and its place, so one sort of longs brings equal
    windows together. Neighbours of equal hash are compared word by word; a text where any two
    differ, or whose places don't fit, is worked out from the windows themselves.
    """
    n = F.size(words)
    starts = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))
    mask = (1 << PLACE_BITS) - 1

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    keys = F.sort_array(
        F.transform(
            starts,
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")),
        )
    )

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit(mask)).cast("int")

    def pairs(s: Column) -> Column:
        both = F.arrays_zip(s.alias("a"), F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))).alias("b"))
        return F.filter(both, lambda x: F.shiftrightunsigned(x["a"].bitwiseXOR(x["b"]), PLACE_BITS) == 0)

    def count(p: Column) -> Column:
        places = F.array_union(F.transform(p, lambda x: place(x["a"])), F.transform(p, lambda x: place(x["b"])))
        differ = F.exists(p, lambda x: window(place(x["a"])) != window(place(x["b"])))
        return F.when(differ, F.lit(-1)).otherwise(_let(F.sort_array(places), _gain))

    quick = F.when(n > mask, F.lit(-1)).otherwise(_let(_let(keys, pairs), count))
    windows = F.array_sort(F.transform(starts, lambda w, i: F.struct(window(i).alias("w"), i.alias("i"))))
    return _let(quick, lambda q: F.when(q >= 0, q).otherwise(_let(_let(windows, _twice), _gain)))


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once: a one-element array carries it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _twice(s: Column) -> Column:
    kept = F.filter(
        s,
        lambda x, k: ((k > 0) & (x["w"] == F.get(s, k - 1)["w"])) | F.coalesce(x["w"] == F.get(s, k + 1)["w"], F.lit(False)),
    )
    return F.array_sort(F.transform(kept, lambda x: x["i"]))


def _gain(at: Column) -> Column:
    gains = F.transform(at, lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, k - 1))))
    return F.aggregate(gains, F.lit(0), lambda a, x: a + x)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines, n_repeat_words."""
    body = F.coalesce(column(text), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = others(docs, names)
    word_name = unused(kept, "words_")
    line_name = unused([*kept, word_name], "lines_")
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    body_name = unused([*kept, word_name, line_name], "body_")
    parts = docs.select(*map(column, kept), words.alias(word_name), lines.alias(line_name), body.alias(body_name))
    w, x, body = F.col(word_name), F.col(line_name), F.col(body_name)
    known = {v for vs in STOP_WORDS.values() for v in vs}
    found = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.filter(w, lambda v: v.isin(*sorted(known)))).cast("long").alias("n_stop_words"),
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    )
    # One struct a row, unfolded: a filter on a measure stays above the measures, which are worked
    # out once; a filter on a column of docs reaches the scan.
    return parts.select(*map(column, kept), F.inline(F.array(found)))


def verdict(rules=RULES) -> Column:
    """The threshold table as one expression: the names of the rules that a row fails."""
    out = []
    for r in rules:
        value = F.col(r.numerator).cast("double")
        if r.denominator:
            value = value / F.nullif(F.col(r.denominator), F.lit(0))
        tests = [t for t in ((value < r.least) if r.least is not None else None, (value > r.most) if r.most is not None else None) if t is not None]
        out.append(F.when(reduce(lambda a, b: a | b, tests), F.lit(r.name)))
    return F.array_compact(F.array(*out))


def quality_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with its measures, base_failed, failed_rules (array of names) and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = measures(docs, text).withColumn("base_failed", base).withColumn("failed_rules", verdict(rules))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return df.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op7_sql() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted({w for v in STOP_WORDS.values() for w in v}))
    fails = []
    for r in RULES:
        value = r.numerator + (f"::DOUBLE / nullif({r.denominator}, 0)" if r.denominator else "")
        tests = [f"{value} < {r.least}"] * (r.least is not None) + [f"{value} > {r.most}"] * (r.most is not None)
        fails.append(f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END")
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN again ON w.doc_id = again.doc_id),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             concat_ws(',', {', '.join(fails)}) AS failed_rules FROM m)
SELECT *, (NOT base_failed AND failed_rules = '') AS kept FROM v"""
