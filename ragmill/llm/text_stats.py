"""Per-text statistics in built-in functions only; everything stays inside the text's own row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import SPACE_WORD, space_split

WINDOW = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_distinct")


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, F.lit(chars), F.lit("")))).cast("long")


def text_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns of keep and STATS (long) of each text; a null text has no words.

    word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_marks: ASCII capitals and punctuation;
    n_dup_lines: lines with a word equal to an earlier line; n_repeat_words: words in 5-word windows found twice or more
    in the text (windows are told apart by 64 bits of hash). A pass over a text costs time in proportion to its length,
    apart from a sort of its windows where one repeats."""
    t, w, g, h, s, p = (F.col(c) for c in ("_t", "_w", "_g", "_h", "_s", "_p"))
    base = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.select(*keep, "_t", space_split(t).alias("_w"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(SPACE_WORD)).alias("_l"))
    stats = base.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count(t, "[#*$%&|<>]+").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        _count(t, r"[!-/:-`{-~]+").alias("n_marks"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("_g"),
    )
    n = F.size(g)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(g, i + k) for k in range(WINDOW)]))
    stats = stats.withColumn("_h", F.when(n > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))).withColumn("n_distinct", F.size(F.array_distinct(g)).cast("long"))
    stats = stats.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    again = F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))
    stats = stats.withColumn("_p", F.when(s.isNotNull(), F.sort_array(F.transform(again, lambda e: e["p"]))))
    covered = F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x)
    return stats.select(*keep, *[c for c in STATS if c != "n_repeat_words"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
