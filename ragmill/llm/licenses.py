"""License scans: several hundred ordered signature rules behind a keyword prefilter.

A text is reduced to its lower-cased words, joined by one space. Rules (label, priority, confidence, keywords, regular
expression over words) are of five sorts: wording of the licences themselves (TEXTS), addresses (ADDRESSES), SPDX tags
(SPDX; each operand of an expression with AND, OR and WITH), and names from FAMILIES alone or in a notice, each with and without a version. A rule's keywords are the plain
words that every match of it has; rules with the same keywords form a set that is tried only where all of them occur,
and no rule is tried on a text without any gate word (every rule needs one).

Overlaps are resolved in the order of priority, then length, then place, then label: a detection goes if an accepted one of
the same or a higher priority contains it, or if it overlaps an accepted one of a higher priority. Rejected detections
suppress nothing. Only detections that overlap through each other are compared, so the work grows with the text. The four
base phrases are always reported. All work is done in the text's own row.

Defined cases: a null text has no words; without a detection the labels are empty, the places null and the score 0;
equal intervals of one priority keep the label that sorts first; copies and repeated ids give a row each.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import alnum_split, ascii_lower
from ragmill.llm.license_texts import ADDRESSES, SPDX, TEXTS

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, names (regular expressions over words), versions (empty: none are told apart).
FAMILIES = (
    ("gpl", ("gnu general public licen[sc]e", "gnu gpl", "gpl"), ("1", "2", "3")),
    ("gpl", ("gplv?", "gnu gplv?"), ("1", "2", "3")),
    ("lgpl", ("gnu lesser general public licen[sc]e", "gnu library or lesser general public licen[sc]e"), ("2", "2 1", "3")),
    ("lgpl", ("lgplv?", "gnu lgplv?"), ("2", "2 1", "3")),
    ("agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e"), ("1", "3")),
    ("agpl", ("agplv?", "gnu agplv?"), ("1", "3")),
    ("gfdl", ("gnu free documentation licen[sc]e", "free documentation licen[sc]e"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache licen[sc]e", "apache software licen[sc]e", "apache"), ("1 0", "1 1", "2 0")),
    ("mit", ("mit licen[sc]e", "expat licen[sc]e", "x11 licen[sc]e"), ()),
    ("bsd-2-clause", ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd licen[sc]e"), ()),
    ("bsd-3-clause", ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"), ()),
    ("bsd-4-clause", ("bsd 4 clause", "4 clause bsd", "original bsd"), ()),
    ("bsd", ("bsd licen[sc]e", "bsd style licen[sc]e", "berkeley software distribution licen[sc]e"), ()),
    ("0bsd", ("bsd zero clause", "zero clause bsd", "0bsd"), ()),
    ("isc", ("isc licen[sc]e", "internet systems consortium licen[sc]e"), ()),
    ("zlib", ("zlib licen[sc]e", "zlib libpng licen[sc]e"), ()),
    ("mpl", ("mozilla public licen[sc]e",), ("1 0", "1 1", "2 0")),
    ("mpl", ("mpl", "mplv?"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public licen[sc]e",), ("1 0", "2 0")),
    ("edl", ("eclipse distribution licen[sc]e",), ("1 0",)),
    ("eupl", ("european union public licen[sc]e",), ("1 0", "1 1", "1 2")),
    ("cddl", ("common development and distribution licen[sc]e",), ("1 0", "1 1")),
    ("cpl", ("common public licen[sc]e",), ("1 0",)),
    ("cpal", ("common public attribution licen[sc]e",), ("1 0",)),
    ("artistic", ("artistic licen[sc]e", "perl artistic licen[sc]e", "clarified artistic licen[sc]e"), ("1 0", "2 0")),
    ("bsl", ("boost software licen[sc]e",), ("1 0",)),
    ("busl", ("business source licen[sc]e",), ("1 0", "1 1")),
    ("sspl", ("server side public licen[sc]e",), ("1",)),
    ("elastic", ("elastic licen[sc]e",), ("1 0", "2 0")),
    ("unlicense", ("unlicense", "the unlicense"), ()),
    ("wtfpl", ("wtfpl", "wtfplv?"), ("2",)),
    ("psf", ("python software foundation licen[sc]e", "psf licen[sc]e", "python licen[sc]e"), ("2",)),
    ("php", ("php licen[sc]e",), ("3 0", "3 01")),
    ("ruby", ("ruby licen[sc]e",), ()),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), ("1 0", "1 1")),
    ("odbl", ("open database licen[sc]e", "open data commons open database licen[sc]e"), ("1 0",)),
    ("odc-by", ("open data commons attribution licen[sc]e",), ("1 0",)),
    ("pddl", ("open data commons public domain dedication and licen[sc]e", "public domain dedication and licen[sc]e"), ("1 0",)),
    ("cc0", ("cc0", "creative commons zero", "cc0 universal"), ("1 0",)),
    ("cc-by", ("cc by",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("cc by sa",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("cc by nd",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("cc by nc",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("cc by nc sa",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", ("cc by nc nd",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", ("creative commons attribution",), ("2 0", "3 0", "4 0")),
    ("cc-by-sa", ("creative commons attribution share ?alike",), ("2 0", "3 0", "4 0")),
    ("cc-by-nc", ("creative commons attribution non ?commercial",), ("2 0", "3 0", "4 0")),
    ("cc-by-nd", ("creative commons attribution no ?deriv(?:ative)?s",), ("2 0", "3 0", "4 0")),
    ("openssl", ("openssl licen[sc]e",), ()),
    ("ncsa", ("university of illinois ncsa open source licen[sc]e",), ()),
    ("upl", ("universal permissive licen[sc]e",), ("1 0",)),
    ("ms-pl", ("microsoft public licen[sc]e",), ()),
    ("ms-rl", ("microsoft reciprocal licen[sc]e",), ()),
    ("osl", ("open software licen[sc]e",), ("1 0", "2 0", "2 1", "3 0")),
    ("afl", ("academic free licen[sc]e",), ("1 2", "2 0", "2 1", "3 0")),
    ("public-domain", ("dedicated to the public domain", "in the public domain", "public domain dedication"), ()),
)

#: What stands before a licence's name, and the rank and confidence of the form.
FORMS = (
    ("notice", 6, 1.0, "(?:licen[sc]ed|released|distributed|published|available|provided|covered|made available) (?:under|by) (?:the )?(?:terms of (?:the )?)?(?:a )?"),
    ("name", 4, 0.8, ""),
)
TEXT_PRIORITY, TEXT_SURE = 8, 1.0  # wording of a licence
TAG_PRIORITY, TAG_SURE = 7, 0.95  # tags and addresses
WEAK_PRIORITY, WEAK_SURE = 2, 0.4  # wording that many licences share
#: Every rule needs one of these; cheap to refuse a text by
GATES = ("licen", "spdx", "gpl", "mpl", "bsd", "apache", "gnu", "creative", "cc", "cc0", "public", "permi", "redistribut", "warrant", "copyright", "unencumbered", "proprietary", "confidential", "liab", "conditions", "advertis", "openssl", "cryptograph", "hereby", "third parties", "commercial", "wtfpl")
_GATE = "|".join(g for g in GATES if g not in ("cc", "cc0")) + r"|cc0|cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"
SPDX_WORDS = {name: " ".join(re.findall("[a-z0-9]+", name.lower())) for name in SPDX.split()}
_ID = "(?:" + "|".join(sorted(SPDX_WORDS.values(), key=lambda x: (-len(x), x))) + ")"
_EXCEPTION = "(?: with (?:[a-z0-9]+ ){1,4}exception(?: [0-9]+)*)?"
#: What OR and AND between the licences of a tag are replaced by: one word that no text has, so places stay.
OPERATOR = "spdx~or"
#: A licence of a tag and the OR or AND after it; the first stands behind the tag's words, the next where the last ended.
_OPERATED = rf"((?:(?<= )spdx licen[sc]e identifier |\G(?! )){_ID}(?: only| or later)?{_EXCEPTION}) (?:or|and) (?={_ID} )"
OPTIONAL = re.compile(r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[?*+]?(?:\{[0-9,]+\})?|\[[^\]]*\][?*+]?")


def keywords_of(pattern: str) -> list[str]:
    """The gate word and the two longest other plain words that every match has; a group, a class or an optional letter
    leaves the plain beginning of its word."""
    words = []
    for w in re.split("[ \x00]", OPTIONAL.sub("\x00", pattern)):
        plain = re.match(r"[a-z0-9]*", re.sub(r"[a-z0-9]\?.*", "", w)).group()
        if len(plain) > 1 or plain.isdigit():
            words.append(plain)
    fixed = " ".join(words)
    gates = [g for g in GATES if g in fixed]
    if not gates:
        raise ValueError(f"no gate word in every match of: {pattern}")
    rest = sorted({w for w in words if gates[0] not in w}, key=lambda w: (-len(w), w))[:2]
    return [gates[0], *rest]


def _rule(rule: str, label: str, priority: int, sure: float, pattern: str, plain: str | None = None) -> dict:
    """plain: words of every match and its surroundings, if pattern does not show them."""
    return {"rule": rule, "label": label, "priority": priority, "sure": sure, "keywords": keywords_of(plain or pattern), "pattern": f"(?<= ){pattern}(?= )"}


def build_rules() -> list[dict]:
    """All signature rules in order: wording, tags and addresses, notices, names, shared wording."""
    rules = [_rule(f"{label}/text-{i}", label, WEAK_PRIORITY if label.startswith("~") else TEXT_PRIORITY, WEAK_SURE if label.startswith("~") else TEXT_SURE, x) for label, xs in TEXTS for i, x in enumerate(xs)]
    for r in rules:
        r["label"] = r["label"].removeprefix("~")
    for name, words in SPDX_WORDS.items():
        tail = "(?! [0-9])" + ("(?: only| or later)?" if re.match("[al]?gpl|gfdl", words) else "")
        rules.append(_rule(f"{name}/tag", name.lower(), TAG_PRIORITY, TAG_SURE, f"spdx licen[sc]e identifier {words}{tail}"))
        rules.append(_rule(f"{name}/operand", name.lower(), TAG_PRIORITY, TAG_SURE, f"(?<= {OPERATOR} ){words}{tail}", f"spdx identifier {words}"))
    rules += [_rule(f"{label}/address-{i}", label, TAG_PRIORITY, TAG_SURE, x) for i, (label, x) in enumerate(ADDRESSES)]
    for form, priority, sure, before in FORMS:
        for label, names, versions in FAMILIES:
            for name in names:
                for v in (*versions, ""):
                    major, _, minor = v.partition(" ")
                    number = f" ?(?:version |v ?)?{major}(?: {minor or '0'})?" if minor in ("", "0") else f" ?(?:version |v ?)?{major} {minor}"
                    tail = f"(?:{number})(?! [0-9])(?: or (?:any )?later(?: version)?| only)?" if v else ""
                    full = label + (f"-{major}.{minor or '0'}" if v else "")
                    rules.append({
                        "rule": f"{full}/{form}/{name}", "label": full, "priority": priority + bool(v), "sure": sure if v or not versions else sure - 0.1,
                        "keywords": keywords_of(name), "pattern": f"(?<= ){before}{name}{tail}(?= )",
                    })
    return rules


RULES = build_rules()
_ONE = "struct<label:string,priority:int,sure:double,pattern:string,base:boolean>"


def _rule_sets() -> list[dict]:
    """Rules by their keywords; the base phrases are sets of their own."""
    base = [{"label": label, "priority": 0, "sure": 0.5, "keywords": phrase.split(" "), "pattern": f"(?<= ){phrase}(?= )", "base": True} for phrase, label in BASE]
    sets: dict[tuple[str, ...], list[dict]] = {}
    for r in base + [r | {"base": False} for r in RULES]:
        sets.setdefault(tuple(r["keywords"]), []).append({k: r[k] for k in ("label", "priority", "sure", "pattern", "base")})
    return [{"keywords": list(k), "rules": v} for k, v in sets.items()]


def _spaces(x: str) -> str:
    return f"(length({x}) - length(replace({x}, ' ', '')))"


def _suppressed(found: str) -> str:
    """Detections, sorted by place, after suppression."""
    kind = "struct<s:int,e:int,p:int,label:string,sure:double>"
    plain = "named_struct('s', x.s, 'e', x.e, 'p', x.p, 'label', x.label, 'sure', x.sure)"
    # detections that overlap through each other, from left to right; 'now' is the group being made and e where it ends
    group = f"struct<e:int,now:array<{kind}>,done:array<array<{kind}>>>"
    groups = (
        f"aggregate(array_sort(transform({found}, x -> {plain})), cast(named_struct('e', 0, 'now', array(), 'done', array()) AS {group}), "
        f"(a, x) -> cast(CASE WHEN x.s < a.e THEN named_struct('e', greatest(a.e, x.e), 'now', array_append(a.now, x), 'done', a.done) "
        f"ELSE named_struct('e', x.e, 'now', array(x), 'done', array_append(a.done, a.now)) END AS {group}), a -> array_append(a.done, a.now))"
    )
    order = "struct<np:int,ne:int,s:int,label:string,e:int,p:int,sure:double>"
    ranked = "array_sort(transform(g, x -> named_struct('np', -x.p, 'ne', x.s - x.e, 's', x.s, 'label', x.label, 'e', x.e, 'p', x.p, 'sure', x.sure)))"
    clash = "exists(a, y -> (y.s <= x.s AND x.e <= y.e) OR (y.p > x.p AND y.s < x.e AND x.s < y.e))"
    chosen = f"CASE WHEN size(g) < 2 THEN g ELSE transform(aggregate({ranked}, cast(array() AS array<{order}>), (a, x) -> CASE WHEN {clash} THEN a ELSE array_append(a, x) END), x -> {plain}) END"
    return f"array_sort(flatten(transform({groups}, g -> {chosen})))"


def license_scan(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """For each text: keep columns, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (array
    of start, end, label, priority, sure; in words, end excluded, after suppression)."""
    keep = ["doc_id"] if keep is None else keep
    k = [f"_o_{c}" for c in keep]
    low = docs.select(*[F.col(c).alias(f"_o_{c}") for c in keep], ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    got = low.select(*k, alnum_split(F.col("_t")).alias("_w"), F.col("_t").rlike(_GATE).alias("_gate"))
    got = got.select(*k, F.size("_w").cast("long").alias("n_words"), F.when(F.col("_gate"), F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))).alias("_n"))
    got = got.withColumn("_n", F.when(F.contains("_n", F.lit("spdx licen")), F.regexp_replace("_n", _OPERATED, f"$1 {OPERATOR} ")).otherwise(F.col("_n")))
    got = got.withColumn("_r", F.from_json(F.lit(json.dumps(_rule_sets())), f"array<struct<keywords:array<string>,rules:array<{_ONE}>>>"))
    tried = "flatten(transform(filter(_r, g -> forall(g.keywords, w -> contains(_n, w))), g -> g.rules))"
    got = got.selectExpr(*k, "n_words", "_n", f"CASE WHEN _n IS NOT NULL THEN {tried} END AS _r")
    hits = "filter(transform(_r, r -> named_struct('p', r.priority, 'label', r.label, 'sure', r.sure, 'base', r.base, 'm', regexp_extract_all(_n, r.pattern, 0), 'q', split(_n, r.pattern, -1))), h -> size(h.m) > 0)"
    got = got.selectExpr(*k, "n_words", f"coalesce({hits}, array()) AS _h")
    one = "struct<s:int,e:int,p:int,label:string,sure:double,base:boolean>"
    at, end = f"(a.n + {_spaces('h.q[i]')})", f"(a.n + {_spaces('h.q[i]')} + {_spaces('h.m[i]')})"
    found = (
        f"flatten(transform(_h, h -> aggregate(sequence(0, size(h.m) - 1), cast(named_struct('n', -1, 'out', array()) AS struct<n:int,out:array<{one}>>), "
        f"(a, i) -> cast(named_struct('n', {end}, 'out', array_append(a.out, named_struct('s', {at}, 'e', {end} + 1, 'p', h.p, 'label', h.label, 'sure', h.sure, 'base', h.base))) AS struct<n:int,out:array<{one}>>), a -> a.out)))"
    )
    got = got.selectExpr(*k, "n_words", f"{found} AS _f")
    got = got.selectExpr(*k, "n_words", "filter(_f, x -> x.base) AS _b", "filter(_f, x -> NOT x.base) AS _d")
    got = got.selectExpr(*k, "n_words", "_b", f"CASE WHEN size(_d) < 2 THEN transform(_d, x -> named_struct('s', x.s, 'e', x.e, 'p', x.p, 'label', x.label, 'sure', x.sure)) ELSE {_suppressed('_d')} END AS _d")
    return got.selectExpr(
        *[f"_o_{c} AS `{c}`" for c in keep],
        "n_words",
        "bigint(size(_b)) AS n_base",
        "bigint(array_min(transform(_b, x -> x.s))) AS first_word",
        "bigint(array_max(transform(_b, x -> x.s))) AS last_word",
        "array_join(array_sort(array_distinct(transform(_b, x -> x.label))), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(transform(_b, x -> x.label), transform(_d, x -> x.label)))), ',') AS labels",
        "coalesce(array_max(transform(concat(transform(_b, x -> x.sure), transform(_d, x -> x.sure)), x -> x)), 0D) AS score",
        "_d AS detections",
    )
