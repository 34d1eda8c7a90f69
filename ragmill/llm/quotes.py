"""Quotation linking: conversations in reply order, without the quoted text.

Each message's lines are split into quote level (the number of leading '>') and content; a line such as "On Monday, A
wrote:" before a quote, on one line or two, in English, German, French or Spanish, is an attribution and belongs to
neither side. A line such as "-----Original Message-----" outside a quote makes all below it one level deeper; that line
and the header lines right below it belong to neither side. Neighbouring quoted lines of one level form a
passage. Passages and the messages' own text (paragraphs, lines and sentences) are hashed after lower-casing and
collapsing white space; a passage is linked to the first earlier message of its conversation that has it as own text.
Passages left over (cut, re-wrapped or edited quotes) are matched by their runs of SHINGLE words: each run votes for the
first message that has it among its own words, and the message with the most votes (of equal ones the first) is the
original if it has half of the passage's runs or more. The message's parent is the link of its outermost (least-level)
first linked passage. Messages without a link continue the conversation at its top level.

The order of replies is (top-level ancestor, depth, message), so that each thread stands together and each message after
its parent; ancestor and depth come from pointer doubling, which keeps two values a message. All steps are joins and
aggregates on (conversation, hash) or (conversation, message); originals are reduced to one row per hash first, so
common passages make no pairs and no conversation is gathered in one task. A passage, parent or message with very many
rows meets its one counterpart by broadcast (join_unique), so no join has a hot key.

Defined cases: a null text is empty and links nothing; a null conversation id is a conversation of its own; a null turn
sorts first; rows with the same conversation and turn are told apart by their text, and full copies share one key (each
stays a row); a passage of fewer than SHINGLE words is linked only by its hash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import alnum_split, join_unique, materialize

SHINGLE = 5
_MARK = r"^[ \t]*((?:>[ \t]?)+)"
#: How an attribution line ends, how one of two lines begins, marks of forwarded messages and their headers.
_WROTE = (
    r"(?:^|[ \t])(?:wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escribe)[ \t\u00A0\u202F]*:[ \t\r]*$"
    r"|^[ \t]*am[ \t].*[0-9].*[ \t]schrieb[ \t].*:[ \t\r]*$"
)
_OPENS = r"^[ \t]*(?:on|am|le|el)[ \t].*[0-9].*[^.!?: \t\r][ \t\r]*$"
_FORWARD = (
    r"^[ \t]*-{2,}[ \t]*(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d.origine"
    r"|message original|message transféré|mensaje original|mensaje reenviado)[ \t]*-*[ \t\r]*$|^[ \t]*begin forwarded message:[ \t\r]*$"
)
_HEADER = r"^[ \t]*(?:from|sent|to|cc|bcc|date|subject|reply-to|von|gesendet|an|datum|betreff|de|envoyé|à|objet|enviado|para|fecha|asunto)[ \t\u00A0]*:"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[ \\\\t\\\\r\\\\f\\\\n]+', ' '))"


def parse_messages(messages: DataFrame) -> DataFrame:
    """conv, m (message key), turn, role, body (own text), depth (deepest quote level), passages (array of level, nth,
    hash and distinct word runs of each quoted passage) and own (hashes of own paragraphs, lines and sentences)."""
    base = messages.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"),
        "conv_id", "turn", "role",
        F.coalesce("text", F.lit("")).alias("_t"),
    )
    m = F.format_string("%020d-%016x", F.coalesce(F.col("turn").cast("long"), F.lit(-1)) + F.lit(2**62), F.xxhash64("_t", F.coalesce("role", F.lit(""))))
    k = ["conv", "conv_id", "turn", "role", "m"]
    base = base.withColumn("m", m).withColumn("_l", F.split("_t", "\n", -1))
    level = f"length(regexp_replace(regexp_extract(x, r'{_MARK}', 1), '[^>]', ''))"
    base = base.selectExpr(*k, f"transform(_l, x -> named_struct('lv', {level}, 'c', regexp_replace(x, r'{_MARK}', ''))) AS _x")
    base = base.select("*", F.expr(f"CASE WHEN size(_x) > 1 THEN filter(sequence(0, size(_x) - 1), i -> get(_x, i).lv = 0 AND lower(get(_x, i).c) RLIKE r\"{_FORWARD}\") ELSE array() END AS _k"))
    base = base.select(*k, "_x", "_k", F.expr("transform(_k, (s, j) -> slice(_x, s + 1, coalesce(get(_k, j + 1), size(_x)) - s)) AS _g"))
    # the place from 1 of the first line of a forwarded part that is neither its mark nor a header nor blank; 0 if none is
    body_at = f"array_position(transform(g, (y, t) -> t > 0 AND trim(BOTH ' \\t\\r' FROM y.c) <> '' AND NOT lower(y.c) RLIKE r'{_HEADER}'), true)"
    base = base.select("*", F.expr(f"transform(_g, g -> {body_at}) AS _h"))
    deeper = "transform(_g, (g, j) -> transform(g, (y, t) -> CASE WHEN get(_h, j) = 0 OR t + 1 < get(_h, j) THEN named_struct('lv', -1, 'c', '') ELSE named_struct('lv', y.lv + j + 1, 'c', y.c) END))"
    base = base.selectExpr(*k, f"CASE WHEN size(_k) = 0 THEN _x ELSE concat(slice(_x, 1, _k[0]), flatten({deeper})) END AS _x")
    # an attribution stands right before a quote, or with one blank line between; its last line names the verb
    quote_next = "(get(_x, {0} + 1).lv > 0 OR (trim(get(_x, {0} + 1).c) = '' AND get(_x, {0} + 2).lv > 0))"
    last = "lower(get(_x, {0}).c) RLIKE r'%s' AND get(_x, {0}).lv = 0 AND %s" % (_WROTE, quote_next)
    first = f"lower(x.c) RLIKE r'{_OPENS}' AND {last.format('i + 1')}"
    base = base.selectExpr(*k, f"transform(_x, (x, i) -> CASE WHEN x.lv = 0 AND coalesce(({last.format('i')}) OR ({first}), false) THEN named_struct('lv', -1, 'c', '') ELSE x END) AS _y")
    # a passage or paragraph starts at a line with content whose neighbour above is blank or of another level
    has = "trim(BOTH ' \\t\\r' FROM {}.c) <> ''"
    starts = f"filter(sequence(0, size(_y) - 1), i -> {has.format('get(_y, i)')} AND (i = 0 OR NOT {has.format('get(_y, i - 1)')} OR get(_y, i - 1).lv <> get(_y, i).lv))"
    base = base.selectExpr(*k, "_y", f"{starts} AS _s")
    lines = f"filter(slice(_y, s + 1, coalesce(get(_s, j + 1), size(_y)) - s), y -> {has.format('y')})"
    base = base.selectExpr(*k, "_y", f"transform(_s, (s, j) -> named_struct('lv', get(_y, s).lv, 't', array_join(transform({lines}, y -> y.c), '\\n'))) AS _p")
    digest = lambda x: f"md5({_norm(x)})"
    base = base.select(*k, "_y", "_p", alnum_rows("_p").alias("_w"))
    runs = f"array_distinct(transform(sequence(0, size(_w[i]) - {SHINGLE}), o -> xxhash64({', '.join(f'get(_w[i], o + {n})' for n in range(SHINGLE))})))"
    passages = f"filter(transform(_p, (p, i) -> named_struct('lv', p.lv, 'nth', i, 'h', {digest('p.t')}, 'runs', CASE WHEN p.lv > 0 AND size(_w[i]) >= {SHINGLE} THEN {runs} ELSE array() END)), p -> p.lv > 0)"
    own = "filter(_p, p -> p.lv = 0)"
    parts = f"concat(transform({own}, p -> p.t), transform(filter(_y, y -> y.lv = 0 AND {has.format('y')}), y -> y.c), flatten(transform({own}, p -> split(regexp_replace(p.t, '\\\\s+', ' '), '(?<=[.!?]) '))))"
    return base.selectExpr(
        *k,
        "trim(BOTH '\\n' FROM array_join(transform(filter(_y, y -> y.lv = 0), y -> y.c), '\\n')) AS body",
        "coalesce(array_max(transform(_y, y -> y.lv)), 0) AS depth",
        f"{passages} AS passages",
        f"array_distinct(transform({parts}, x -> {digest('x')})) AS own",
    )


def alnum_rows(passages: str):
    """The words of each passage or paragraph."""
    return F.transform(passages, lambda p: F.when(p["lv"] > 0, alnum_split(F.lower(p["t"]))))


def link_quotes(parsed: DataFrame) -> DataFrame:
    """Rows (conv, m, lv, nth, original, turn of the original) of the quoted passages that an earlier message has."""
    key = ["conv", "m", "lv", "nth"]
    quoted = materialize(parsed.where(F.size("passages") > 0).select("conv", "m", F.explode("passages").alias("p")).select("conv", "m", "p.*").dropDuplicates(key), "quotes-passages")
    if quoted.isEmpty():
        return quoted.select(*key, F.col("m").alias("original"), F.lit(None).cast(dict(parsed.dtypes)["turn"]).alias("parent_turn"))
    first = F.min(F.struct("m", "turn")).alias("f")
    own = parsed.select("conv", "m", "turn", F.explode("own").alias("h")).groupBy("conv", "h").agg(first)
    same = materialize(join_unique(quoted.drop("runs"), own, ["conv", "h"], "inner").where(F.col("f.m") < F.col("m")).select(*key, "f"), "quotes-equal")
    rest = materialize(quoted.where(F.size("runs") > 0).join(same, key, "left_anti").select(*key, "runs"), "quotes-rest")
    if not rest.isEmpty():
        talks = materialize(rest.select("conv").distinct(), "quotes-talks")
        words = parsed.join(talks, "conv", "left_semi").select("conv", "m", "turn", alnum_split(F.lower("body")).alias("_w"))
        runs = f"CASE WHEN size(_w) >= {SHINGLE} THEN transform(sequence(0, size(_w) - {SHINGLE}), o -> xxhash64({', '.join(f'get(_w, o + {n})' for n in range(SHINGLE))})) END"
        holders = words.select("conv", "m", "turn", F.explode(F.expr(runs)).alias("run")).groupBy("conv", "run").agg(first)
        asked = materialize(rest.select(*key, F.size("runs").alias("n"), F.explode("runs").alias("run")), "quotes-runs")
        votes = join_unique(asked, materialize(holders, "quotes-holders"), ["conv", "run"], "inner").where(F.col("f.m") < F.col("m"))
        votes = votes.groupBy(*key, "n", "f").agg(F.count("*").alias("v")).groupBy(*key, "n").agg(F.min(F.struct((-F.col("v")).alias("v"), "f")).alias("b"))
        same = same.unionByName(votes.where(-2 * F.col("b.v") >= F.col("n")).select(*key, "b.f"))
    return same.select(*key, F.col("f.m").alias("original"), F.col("f.turn").alias("parent_turn"))


def reply_threads(parents: DataFrame) -> DataFrame:
    """conv, m, thread (top-level ancestor), reply_depth from rows (conv, m, parent); messages absent as m are tops. Each
    round doubles the distance to the known ancestor, so rounds are the logarithm of the deepest reply."""
    state = materialize(parents.select("conv", "m", F.col("parent").alias("up"), F.lit(1).cast("long").alias("dist"), F.lit(True).alias("moved")), "quotes-threads")
    while not state.where("moved").isEmpty():
        above = state.select("conv", F.col("m").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"))
        nxt = join_unique(state.drop("moved"), above, ["conv", "up"])
        state = materialize(nxt.select("conv", "m", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.col("up2").isNotNull().alias("moved")), "quotes-threads")
    return state.select("conv", "m", F.col("up").alias("thread"), F.col("dist").alias("reply_depth"))


def link_conversations(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, body, quote_depth, n_quotes, n_linked, parent_turn, reply_depth and
    reply_key; ordering a conversation by reply_key gives the reply order."""
    parsed = materialize(parse_messages(messages), "quotes-parsed")
    links = materialize(link_quotes(parsed), "quotes-links")
    outermost = F.min(F.struct("lv", "nth", "original", "parent_turn")).alias("b")
    chosen = materialize(links.groupBy("conv", "m").agg(outermost, F.count("*").alias("n_linked")).select("conv", "m", F.col("b.original").alias("parent"), F.col("b.parent_turn").alias("parent_turn"), "n_linked"), "quotes-parents")
    named = materialize(chosen.drop("parent").join(reply_threads(chosen), ["conv", "m"]), "quotes-named")
    out = join_unique(parsed, named, ["conv", "m"])
    depth = F.coalesce("reply_depth", F.lit(0)).cast("long")
    return out.select(
        "conv_id", "turn", "role", "body",
        F.greatest("depth", F.lit(0)).cast("long").alias("quote_depth"),
        F.size("passages").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent_turn",
        depth.alias("reply_depth"),
        F.format_string("%s/%010d/%s", F.coalesce("thread", "m"), depth, F.col("m")).alias("reply_key"),
    )
