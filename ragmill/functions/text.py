"""Scalar text rules as built-in column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without topical signal.
STOPWORDS = (
    "the a an and or but of to in on for with at by from as is are was were be been being it this that these those i you he she "
    "we they not no do does did has have had will would can could should may might must if then than so such there here which who "
    "whom whose what when where why how all any both each more most other some only own same too very s t just"
).split()
#: Capitalised words and long words that are no evidence of a claim.
STOP_CAPS = "The This That These Those It There A An In On For And But As If When While However Based".split()
STOP_WORDS = "which there their these those about would could should where while after before being other using under above below".split()
#: Abbreviations that end in a period without ending a sentence (regular expressions).
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Sr Jr St Vs vs etc e\\.g i\\.e Inc Ltd Co Corp Gov Sen Rep Gen Col Capt Lt Ave No Vol Fig approx U\\.S U\\.K".split()
#: Limits of the text rules.
SNIPPET_CHARS, HEADING_CHARS, HEADING_WORDS, TITLE_WORDS, SENTENCE_CHARS = 240, 80, 12, 8, 280


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends. The pattern searches the whole text, so it runs only where an end needs it."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def clean_text(c: Column) -> Column:
    """Drop NUL characters, strip; an empty text is null."""
    return F.nullif(strip(F.translate(c, "\0", "")), F.lit(""))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))


def count_words(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit("")))).cast("long")


def bm25_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def content_tokens(c: Column) -> Column:
    """Lower-cased words that start with a letter, longer than one character, without stopwords."""
    found = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z0-9'-]*"), F.lit(0)), F.lower)
    return F.filter(found, lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a lambda's variable, as expressions inside lambdas run for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def term_counts(tokens: Column) -> Column:
    """Distinct tokens of an array with their numbers, as array of (term, tf): sorted, then the runs are measured."""

    def runs(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)))
        starts = F.filter(places, lambda i: (F.size(s) > 0) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        one = lambda b: lambda at, i: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(b, i + 1), F.size(s)) - at).cast("long").alias("tf"))
        return let(starts, lambda b: F.transform(b, one(b)))

    return let(F.array_sort(tokens), runs)


def simple_sentences(c: Column) -> Column:
    """Split after . ! ? and white space; strip, drop empty ones."""
    return F.filter(F.transform(F.split(strip(c), r"(?U)(?<=[.!?])\s+", -1), strip), lambda s: s != "")


def split_sentences(c: Column) -> Column:
    """As simple_sentences, but a known abbreviation does not end a sentence; what follows is joined by one space."""
    abbr = rf"\b(?:{'|'.join(ABBREVIATIONS)})\."
    joined = F.regexp_replace(strip(c), rf"(?iU)(?<=\.)(?<={abbr})\s+", " ")  # the first test fails fast nearly everywhere
    return F.filter(F.transform(F.split(joined, rf"(?iU)(?<=[.!?])(?<!{abbr})\s+", -1), strip), lambda s: s != "")


def detect_heading(line: Column) -> Column:
    """The stripped line if it looks like a heading (all capitals, or a short title without end punctuation), else null."""

    def told(s: Column) -> Column:
        letters = F.length(F.regexp_replace(s, r"\P{L}", ""))
        ok = lambda n: (letters >= 2) & (n <= HEADING_WORDS) & ((F.upper(s) == s) | (s.rlike(r"^\p{Lu}") & ~s.rlike(r"[.,;:!?]$") & (n <= TITLE_WORDS)))
        return F.when((s != "") & (F.length(s) <= HEADING_CHARS), F.when(let(F.size(words(s)), ok), s))

    return let(strip(line), told)


def representative_sentence(c: Column) -> Column:
    """The sentence with the highest share of capitalised words, then most words, then the first; at most 280 characters."""
    caps = lambda w: F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    one = lambda s, i: let(words(s), lambda w: F.struct((caps(w) / F.size(w)).alias("d"), F.size(w).alias("n"), (-i).alias("i"), s.alias("s")))
    scored = F.transform(simple_sentences(c), one)
    return F.substring(F.coalesce(F.array_max(scored)["s"], strip(c)), 1, SENTENCE_CHARS)


def snippet(c: Column) -> Column:
    """One line of at most 240 characters; longer texts are cut at the last space and end in an ellipsis."""
    s = F.replace(strip(c), F.lit("\n"), F.lit(" "))
    cut = F.substring(s, 1, SNIPPET_CHARS)
    cut = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(s) > SNIPPET_CHARS, F.concat(cut, F.lit("…"))).otherwise(s)


def cut_on_space(c: Column, limit: int) -> Column:
    """At most limit characters, cut back to the last space and marked by an ellipsis."""
    cut = F.substring(c, 1, limit)
    cut = F.when(F.contains(cut, F.lit(" ")), F.regexp_replace(cut, " [^ ]*$", "")).otherwise(cut)
    return F.when(F.length(c) > limit, F.concat(cut, F.lit("…"))).otherwise(c)


def key_terms(c: Column) -> Column:
    """Distinct claim carriers: capitalised words of three letters, numbers, words of five letters; lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    caps = F.filter(runs, lambda w: w.rlike("^[A-Z][A-Za-z]{2,}$") & ~F.array_contains(F.array(*[F.lit(x) for x in STOP_CAPS]), w))
    long = F.filter(F.transform(runs, F.lower), lambda w: w.rlike("^[a-z]{5,}$") & ~F.array_contains(F.array(*[F.lit(x) for x in STOP_WORDS]), w))
    numbers = F.regexp_extract_all(c, F.lit(r"(?U)\b\d[\d,.%]*\b"), F.lit(0))
    return F.array_distinct(F.concat(F.transform(caps, F.lower), numbers, long))


def file_type(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def cache_key(user: Column, question: Column, mode: Column) -> Column:
    norm = F.regexp_replace(F.lower(strip(question)), r"(?U)\s+", " ")
    return F.concat(F.lit("qcache:"), user.cast("string"), F.lit(":"), mode, F.lit(":"), F.sha2(norm, 256))


def confidence_band(c: Column) -> Column:
    return F.when(c > 0.7, F.lit("High")).when(c >= 0.4, F.lit("Moderate")).otherwise(F.lit("Low"))


def row_text(columns: list[str]) -> Column:
    """"name: value" of each non-empty column, joined by ", "; an empty name reads "Column"."""
    parts = []
    for c in columns:
        v = F.col(f"`{c}`").cast("string")
        parts.append(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{c.strip() if c else 'Column'}: "), v)))
    return F.concat_ws(", ", *parts)


def split_followups(c: Column, marker: str = "===FOLLOWUPS===") -> Column:
    """struct(answer, rest): both stripped around the first marker; without a marker the text unchanged and ''."""
    at = F.locate(marker, c)
    has = at > 0
    return F.struct(
        F.when(has, strip(F.substring(c, F.lit(1), at - 1))).otherwise(c).alias("answer"),
        F.when(has, strip(F.substring(c, at + len(marker), F.length(c)))).otherwise(F.lit("")).alias("rest"),
    )


def _json_array(c: Column, schema: str) -> Column:
    inner = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(F.when(strip(c).startswith("["), c), schema), F.from_json(F.nullif(inner, F.lit("")), schema), F.array().cast(schema))


def parse_json_questions(c: Column) -> Column:
    """First four non-empty strings of the JSON array in a text."""
    return F.slice(F.filter(F.transform(_json_array(c, "array<string>"), strip), lambda x: x != ""), 1, 4)


def parse_json_events(c: Column) -> Column:
    """Events (date, event, chunk_index) of the JSON array in a text; those without date or event are dropped."""
    got = _json_array(c, "array<struct<date:string,event:string,chunk_index:int>>")
    ok = F.filter(got, lambda e: F.coalesce(e["date"], F.lit("")).__ne__("") & F.coalesce(e["event"], F.lit("")).__ne__(""))
    return F.transform(ok, lambda e: F.struct(F.substring(e["date"], 1, 20).alias("date"), F.substring(e["event"], 1, 500).alias("event"), F.coalesce(e["chunk_index"], F.lit(0)).alias("chunk_index")))


def citations(c: Column) -> Column:
    """Numbers of the [n] markers of an answer, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int"))
