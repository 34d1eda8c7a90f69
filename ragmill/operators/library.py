"""Library views and life cycle: lists, pages, tags, collections, versions, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doc_filter(documents: DataFrame, name: str | None = None, kind: Column | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """Live documents that were not failed by their ingest, optionally with a name that contains a term, of a kind, and with
    a tag (left semi). A status that is null is not failed."""
    out = documents.where(F.col("deleted_at").isNull() & ~F.col("processing_status").eqNullSafe("failed"))
    if name:
        out = out.where(F.col("filename").ilike(f"%{name}%"))
    if kind is not None:
        out = out.where(kind)
    return out.join(tagged, "document_id", "left_semi") if tagged is not None else out


def doc_chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return documents.join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def doc_tags(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """Sorted tags of each document, joined by a comma."""
    t = tags.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return documents.join(t, "document_id", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def tag_normalise(tags: DataFrame, limit: int = 10) -> DataFrame:
    """Trim, lower-case; valid if [a-z0-9-]+ and among the first `limit` of the document (by order nth)."""
    t = tags.withColumn("tag", F.lower(F.trim("tag"))).withColumn("well_formed", F.col("tag").rlike("^[a-z0-9-]+$"))
    n = F.row_number().over(Window.partitionBy("document_id", "well_formed").orderBy("nth"))
    return t.withColumn("accepted", F.col("well_formed") & (n <= limit))


def retag(tags: DataFrame, remove: DataFrame) -> DataFrame:
    return tags.join(remove, ["document_id", "tag"], "left_anti")


def duplicate_names(documents: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Name of the document that each one duplicates; deleted targets still resolve."""
    d = documents.join(duplicates.select("document_id", "duplicate_of"), "document_id", "left")
    return d.join(documents.select(F.col("document_id").alias("duplicate_of"), F.col("filename").alias("duplicate_name")), "duplicate_of", "left")


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Live collections with their member counts (soft-deleted documents count)."""
    m = members.groupBy("collection_id").agg(F.count("document_id").alias("documents"))
    live = collections.where(F.col("deleted_at").isNull())
    return live.join(m, "collection_id", "left").select("collection_id", F.coalesce("documents", F.lit(0)).alias("documents"))


def collection_documents(members: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return doc_chunk_counts(documents.where(F.col("deleted_at").isNull()).join(members, "document_id"), chunks)


def page(rows: DataFrame, by: str, limit: int, offset: int = 0, id_col: str = "id") -> DataFrame:
    """Newest-first page of every group at once, with the group's total."""
    w = Window.partitionBy(by)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(F.col("created_at").desc(), F.col(id_col).desc()))).withColumn("total", F.count("*").over(w))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).withColumn("rank", F.col("rank").cast("long"))


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of each conversation, oldest first."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def append_version(uploads: DataFrame) -> DataFrame:
    """Version number of each upload of a name and the archived key of the one before."""
    w = Window.partitionBy("user_id", "filename").orderBy("uploaded_at", "storage_key")
    return uploads.withColumn("version_number", F.row_number().over(w)).withColumn("archived_key", F.lag("storage_key").over(w))


def restorable(documents: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Trash: deleted documents, whole days since, and whether they can be restored."""
    t = documents.where(F.col("deleted_at").isNotNull())
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("deleted_at")) / 86_400)
    return t.withColumn("days", age.cast("long")).withColumn("restorable", F.col("days") < days)


def _stale(rows: DataFrame, now: str, days: int) -> DataFrame:
    return rows.where(F.col("deleted_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


#: Child tables and what their rows hang on: (parent table, the parent's key, the child's column). A row goes with any parent.
CASCADE: dict[str, list[tuple[str, str, str]]] = {
    "documents": [("users", "user_id", "user_id")],
    "collections": [("users", "user_id", "user_id")],
    "chat_history": [("users", "user_id", "user_id")],
    "chunks": [("documents", "document_id", "document_id")],
    "chunk_coverage": [("chunks", "chunk_id", "chunk_id"), ("users", "user_id", "user_id")],
    "document_tags": [("documents", "document_id", "document_id")],
    "collection_documents": [("documents", "document_id", "document_id"), ("collections", "collection_id", "collection_id")],
    "document_versions": [("documents", "document_id", "document_id")],
    "document_timelines": [("documents", "document_id", "document_id")],
}


def cascade(tables: dict[str, DataFrame], gone: dict[str, DataFrame], links: dict[str, list[tuple[str, str, str]]] | None = None) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(what stays of each table, counts of what goes: table, rows; file keys of what goes: storage_key).

    gone holds the rows that are removed themselves, by table. Children follow along the links, parents first, so a row goes
    with a parent that goes only because of its own parent; each step is a left semi and a left anti join on the link's column.
    Links to tables that are not given are skipped."""
    links = CASCADE if links is None else links
    spark = next(iter(tables.values())).sparkSession
    order, open_tables = [], list(tables)
    while open_tables:
        free = [t for t in open_tables if not any(p in open_tables and p != t for p, _, _ in links.get(t, []))]
        if not free:
            raise ValueError(f"links go round among {open_tables}")
        order += free
        open_tables = [t for t in open_tables if t not in free]

    stays, goes = {}, {}
    for t in order:
        rows, lost = tables[t], []
        if t in gone:
            key = {"documents": "document_id", "collections": "collection_id", "users": "user_id", "chat_history": "id"}.get(t, gone[t].columns[0])
            lost.append((gone[t].select(key).distinct(), key))
        for parent, key, column in links.get(t, []):
            if parent in goes:
                lost.append((goes[parent].select(F.col(key).alias(column)).distinct(), column))
        out, left = None, rows
        for keys, column in lost:
            part = left.join(keys, column, "left_semi").select(*rows.columns)
            out = part if out is None else out.unionByName(part)
            left = left.join(keys, column, "left_anti").select(*rows.columns)
        stays[t], goes[t] = left, rows.limit(0) if out is None else out
    counts, files = None, None
    for t in order:
        one = goes[t].agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
        if "storage_key" in goes[t].columns:
            keys = goes[t].where(F.col("storage_key").isNotNull()).select("storage_key")
            files = keys if files is None else files.unionByName(keys)
    return stays, counts, files if files is not None else spark.createDataFrame([], "storage_key string")


def purge_deleted(tables: dict[str, DataFrame], now: str, days: int = 30) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Remove documents, collections and history rows that were deleted more than `days` ago, and all that hangs on them: see
    cascade."""
    return cascade(tables, {t: _stale(tables[t], now, days) for t in ("documents", "collections", "chat_history") if t in tables})


def purge_users(tables: dict[str, DataFrame], users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Remove accounts (user_id) and all that is theirs: see cascade. tables must hold `users`."""
    return cascade(tables, {"users": users})


def add_key_scheme(keys: Column, scheme: str = "legacy://") -> Column:
    """Stored keys with a scheme before them; null stays."""
    return F.concat(F.lit(scheme), keys)


def drop_key_scheme(keys: Column, scheme: str = "legacy://") -> Column:
    """The reverse of add_key_scheme: keys without the scheme stay as they are."""
    return F.when(keys.startswith(scheme), F.substring(keys, len(scheme) + 1, 2**31 - 1)).otherwise(keys)


def expired_tokens(tokens: DataFrame, now: str) -> DataFrame:
    return tokens.where(F.col("expires_at") < F.lit(now).cast("timestamp"))


def usable_reset_tokens(tokens: DataFrame, now: str) -> DataFrame:
    """Reset tokens that were not used and have not expired. Columns used_at, expires_at."""
    return tokens.where(F.col("used_at").isNull() & ~(F.col("expires_at") < F.lit(now).cast("timestamp")))


def token_reuse(uses: DataFrame) -> DataFrame:
    """Uses of one-time tokens with `reused` (not the token's first use) and `revoked`: issued before the user's latest
    reuse. Columns user_id, jti, issued_at, used_at."""
    w = Window.partitionBy("user_id", "jti").orderBy("used_at", "issued_at")
    u = uses.withColumn("reused", F.row_number().over(w) > 1)
    before = u.where("reused").groupBy("user_id").agg(F.max("used_at").alias("revoked_before"))
    return u.join(before, "user_id", "left").withColumn("revoked", F.coalesce(F.col("issued_at") < F.col("revoked_before"), F.lit(False)))


def rate_limit_audit(events: DataFrame, limits: dict[str, tuple[int, str]]) -> DataFrame:
    """Flag events beyond the limit of their action in calendar-aligned windows. Columns key, action, ts, id; actions
    without a limit are allowed. Only the running number of a key in a window is needed, so a window holds one key's
    events of one minute, hour or day."""
    unit = F.create_map(*[F.lit(x) for a, (_, u) in limits.items() for x in (a, u)])
    most = F.create_map(*[F.lit(x) for a, (n, _) in limits.items() for x in (a, n)])
    e = events.withColumn("_u", unit[F.col("action")]).withColumn("window_start", F.when(F.col("_u").isNotNull(), F.expr("date_trunc(_u, ts)")))
    nth = F.row_number().over(Window.partitionBy("key", "action", "window_start").orderBy("ts", "id"))
    return e.withColumn("nth", nth.cast("long")).withColumn("limited", F.coalesce(F.col("nth") > most[F.col("action")], F.lit(False))).drop("_u")


def progress_changes(states: DataFrame) -> DataFrame:
    """Rows of a progress feed that differ from the one before, up to the first final state. Columns key, ts, id, state."""
    w = Window.partitionBy("key").orderBy("ts", "id")
    s = states.withColumn("_before", F.lag("state").over(w))
    done = F.sum(F.when(F.col("state").isin("done", "failed"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_done", F.coalesce(done, F.lit(0)))
    return s.where((F.col("_done") == 0) & ~F.col("state").eqNullSafe(F.col("_before"))).drop("_before", "_done")
