"""What may be searched: chunk states, scopes with tags, owners and shared bases, stores and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of chunks that a search may return, and kinds that answers leave out: fixed values.
SEARCHABLE = ("text", "summary", "table_column", "table_summary", "faq", "image_ocr", "image_caption")
TABLE_KINDS = ("table_summary", "table_column")
DATA_FILES = ("csv", "xlsx", "xls")


def searchable(enabled: Column, index_status: Column, chunk_type: Column) -> Column:
    """Enabled, not being indexed or failed (null and empty pass), and of a searchable kind."""
    return F.coalesce(enabled, F.lit(True)) & ~F.coalesce(index_status, F.lit("")).isin("processing", "failed") & chunk_type.isin(*SEARCHABLE)


def answerable(chunk_type: Column) -> Column:
    """Not one of the descriptions of a table, which are for finding it only."""
    return ~F.coalesce(chunk_type, F.lit("")).isin(*TABLE_KINDS)


def is_data_file(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*DATA_FILES)


def holds(text: Column, needle: str) -> Column:
    """Whether the text has the needle, whatever the case; %, _ and backslashes are letters like others."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return text.ilike(f"%{escaped}%")


def within_scopes(rows: DataFrame, scopes: list[dict], tags: DataFrame | None = None, kb_col: str = "kb_id", doc_col: str = "doc_id") -> DataFrame:
    """Rows that some scope allows: {'kb': ..., 'docs': [...], 'tags': [...]}, all of its parts;
    a tag is one that `tags` (doc_col, tag) gives the document. Without scopes, no rows."""
    wanted = sorted({t for s in scopes for t in s.get("tags", ())})
    own = "_tags"
    if wanted:
        of = tags.filter(F.col("tag").isin(wanted)).groupBy(doc_col).agg(F.collect_set("tag").alias(own))
        rows = rows.join(of, doc_col, "left")

    def condition(scope: dict) -> Column:
        parts = [F.col(kb_col) == scope["kb"]]
        if scope.get("docs"):
            parts.append(F.col(doc_col).isin(list(scope["docs"])))
        if scope.get("tags"):
            parts.append(F.coalesce(F.arrays_overlap(own, F.array(*map(F.lit, scope["tags"]))), F.lit(False)))
        return reduce(lambda a, b: a & b, parts)

    allowed = reduce(lambda a, b: a | b, map(condition, scopes), F.lit(False))
    return rows.filter(allowed).drop(own)


def live_memories(now, kinds: tuple[str, ...] = (), dimensions: int | None = None) -> Column:
    """Of memories (status, expires_at, kind, vector): active, not expired, of the kinds and the vector size."""
    alive = (F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
    if kinds:
        alive &= F.col("kind").isin(*kinds)
    return alive & (F.size("vector") == dimensions) if dimensions else alive


def own_then_shared(wanted: DataFrame, own: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """Rows of `own` for the wanted keys, and rows of `shared` for those that it lacks."""
    mine = own.join(wanted, key, "left_semi")
    return mine.unionByName(shared.join(wanted, key, "left_semi").join(own.select(key), key, "left_anti"))


def messages_of(messages: DataFrame, sessions: DataFrame, owner, session_col: str = "session_id") -> DataFrame:
    """Messages of an owner's sessions (session_col, owner, deleted) that aren't deleted."""
    live = sessions.filter((F.col("owner") == owner) & ~F.coalesce("deleted", F.lit(False))).select(session_col)
    return messages.join(live, session_col, "left_semi")


def normalise_if_mixed(hits: DataFrame, normalised: Column, by: str = "query_id") -> DataFrame:
    """Scores normalised where a query's hits come from several kinds of engine, else as they are."""
    kinds = hits.groupBy(by).agg(F.count_distinct("engine").alias("_kinds"))
    return hits.join(kinds, by).withColumn("score", F.when(F.col("_kinds") > 1, normalised).otherwise(F.col("score"))).drop("_kinds")


def split_by_retriever(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vector hits and keyword hits; other kinds are neither."""
    return hits.filter(F.col("retriever") == "vector"), hits.filter(F.col("retriever") == "keyword")


def routes(bases: DataFrame) -> DataFrame:
    """kb_id, index, retrievers of bases (kb_id, kind): FAQ bases have an index of their own, without keywords."""
    faq = F.col("kind") == "faq"
    return bases.select("kb_id", F.when(faq, "faq").otherwise("document").alias("index"), F.when(faq, F.array(F.lit("vector"))).otherwise(F.array(F.lit("vector"), F.lit("keyword"))).alias("retrievers"))


def by_store(bases: DataFrame) -> DataFrame:
    """store, tenant, kb_ids (sorted) and one_model: bases (kb_id, store, tenant, model) that one
    request can search together, and whether their vectors are of one model."""
    return bases.groupBy("store", "tenant").agg(F.sort_array(F.collect_set("kb_id")).alias("kb_ids"), (F.count_distinct("model") <= 1).alias("one_model"))


def page(rows: DataFrame, order: list[str], after: tuple | None = None, size: int = 20, most: int = 100) -> DataFrame:
    """The page after a key, in the order of columns, and `more`: whether rows follow. One row more
    than the page is fetched to know."""
    size = min(size if size > 0 else 20, most)
    if after is not None:
        conditions = [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(order[:k], after[:k])], F.lit(True)) & (F.col(order[k]) > after[k]) for k in range(len(order))]
        rows = rows.filter(reduce(lambda a, b: a | b, conditions))
    top = rows.orderBy(*order).limit(size + 1)
    every = Window.orderBy(*order)
    at = top.withColumns({"_at": F.row_number().over(every), "_n": F.count("*").over(Window.orderBy(F.lit(0)))})
    return at.filter(F.col("_at") <= size).withColumn("more", F.col("_n") > size).drop("_at", "_n")
