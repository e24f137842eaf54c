"""Joins, lookups and mutations of chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.session import fresh, materialise


def hydrate(hits: DataFrame, chunks: DataFrame, on: str = "doc_id") -> DataFrame:
    """Hits with their chunk's columns; hits without a chunk are dropped."""
    return hits.join(chunks, on)


def with_neighbours(hits: DataFrame, chunks: DataFrame, group: str, index: str) -> DataFrame:
    """The hits (match_type 'hit') and the chunks before and after them in their document
    ('neighbour'), once each and never a hit itself."""
    hit = hits.select(group, index).distinct()
    near = hit.select(group, F.explode(F.array(F.col(index) - 1, F.col(index) + 1)).alias(index)).distinct()
    near = near.join(hit, [group, index], "left_anti").withColumn("match_type", F.lit("neighbour"))
    return chunks.join(hit.withColumn("match_type", F.lit("hit")).unionByName(near), [group, index])


def enriched(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, match_type, score: hits (query_id, chunk_id, rank, score) as 'hit', and the chunks that
    these name: their parent ('parent', with the hit's score), those of their list of relations ('related'), and for
    hits of kind 'text' those before and after ('near'; both of score 0). A chunk comes once a query, by the
    best hit that names it, of one hit's names in this order; hits aren't named again, nor what isn't there.

    `chunks` has chunk_id, kind, parent_id, related (an array), before_id and after_id, all but the first nullable."""
    own = hits.select("query_id", "chunk_id", "rank", "score").join(chunks.select("chunk_id", "kind", "parent_id", "related", "before_id", "after_id"), "chunk_id")
    kind = lambda name, order, score, found: F.struct(F.lit(order).alias("o"), F.lit(name).alias("match_type"), score.alias("score"), found.alias("found"))
    zero, near = F.lit(0.0), F.col("kind") == "text"
    named = F.concat(
        F.array(kind("parent", 1, F.col("score").cast("double"), F.col("parent_id"))),
        F.transform(F.coalesce("related", F.array().cast(chunks.schema["related"].dataType)), lambda r: kind("related", 2, zero, r)),
        F.array(*[kind("near", 3, zero, F.when(near, F.col(c))) for c in ("after_id", "before_id")]),
    )
    named = own.select("query_id", "rank", F.explode(named).alias("n")).filter("n.found IS NOT NULL").groupBy("query_id", F.col("n.found").alias("chunk_id"))
    first = named.agg(F.min(F.struct("rank", "n.o", "n.match_type", "n.score")).alias("n"))
    first = first.join(own.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return own.select("query_id", "chunk_id", F.lit("hit").alias("match_type"), F.col("score").cast("double").alias("score")).unionByName(first.select("query_id", "chunk_id", "n.match_type", "n.score"))


def upsert(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """`target` with rows of `changes` in place of those with the same key, or added."""
    return target.join(changes.select(*key), key, "left_anti").unionByName(changes)


def insert_missing(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """`target` and the rows whose key it lacks."""
    return target.unionByName(rows.join(target.select(*key), key, "left_anti"))


def delete(target: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    return target.join(ids.select(*key), key, "left_anti")


MAP_SIDE = 2_000_000  # ids (some 50 MB) that are broadcast whole
WORDS = 1 << 20  # of 64 bits, the filter (some 50 MB) that is broadcast for more ids


def without(rows: DataFrame, lost: DataFrame, column: str) -> DataFrame:
    """`rows` but for those whose `column` is among the values of `lost`, a table of one column
    that is read several times; a null there stands for null.

    Wide rows stay where they are. Up to MAP_SIDE values are broadcast. Of more, a Bloom
    filter of fixed size is: rows that it clears are kept at once, in one branch, and only
    the others are shuffled for the exact anti join, in another.
    """
    (name,) = lost.columns
    n, named = lost.agg(F.count("*"), F.count(name)).first()
    if named < n:
        rows, lost = rows.filter(F.col(column).isNotNull()), lost.filter(F.col(name).isNotNull())
    if not named:
        return rows
    key, word, maybe = fresh(rows, "key", "word", "maybe")
    lost = lost.select(F.col(name).alias(key)).distinct()
    if n <= MAP_SIDE:
        return rows.join(F.broadcast(lost), F.col(column) == F.col(key), "left_anti")

    marked = _sifted(rows, lost.select(F.col(key).alias(word)), column, maybe)
    clear = marked.filter(~F.col(maybe)).select(*rows.columns)
    return clear.unionByName(marked.filter(maybe).select(*rows.columns).join(lost.hint("shuffle_merge"), F.col(column) == F.col(key), "left_anti"))


def probably_among(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` is among the values of a table of one column, and a few others:
    a filter of fixed size is broadcast, and nothing is shuffled."""
    name, maybe = fresh(rows, "value", "maybe")
    return _sifted(rows, values.toDF(name), column, maybe).filter(maybe).select(*rows.columns)


def _sifted(rows: DataFrame, values: DataFrame, column: str, maybe: str) -> DataFrame:
    """`rows` with `maybe`: false only if `column` isn't among `values`. A Bloom filter whose four
    bits a value lie in one word, as a table of words that is joined by number."""
    (name,) = values.columns
    word, bits = fresh(rows.withColumn(name, F.lit(0)), "word", "bits")

    def place(value):
        return F.pmod(F.xxhash64(value), F.lit(WORDS)).cast("int")

    def mask(value):
        draw = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(F.xxhash64(value, F.lit(1)), 6 * k), F.lit(64)).cast("int"))
        return draw(0).bitwiseOR(draw(1)).bitwiseOR(draw(2)).bitwiseOR(draw(3))

    bloom = values.groupBy(place(F.col(name)).alias(word)).agg(F.bit_or(mask(F.col(name))).alias(bits))
    hit = F.coalesce(F.col(bits).bitwiseAND(mask(F.col(column))) == mask(F.col(column)), F.lit(False))
    return rows.join(F.broadcast(bloom), place(F.col(column)) == F.col(word), "left").withColumn(maybe, hit)


def copy_with_ids(rows: DataFrame, id_map: DataFrame, key: str) -> DataFrame:
    """Copies of the mapped rows (old_id, new_id) under their new ids."""
    return rows.join(id_map.select(F.col("old_id").alias(key), "new_id"), key).withColumn(key, F.col("new_id")).drop("new_id")


def set_flags(rows: DataFrame, flags: DataFrame, key: str, column: str) -> DataFrame:
    """`column` as `flags` has it for the key, else unchanged."""
    return rows.join(flags.select(key, F.col(column).alias("_flag")), key, "left").withColumn(column, F.coalesce("_flag", column)).drop("_flag")


def diff(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: 'add' (only left), 'delete' (only right), 'update' (another digest) or 'keep'."""
    a, b = left.select(key, F.col(digest).alias("_a")), right.select(key, F.col(digest).alias("_b"))
    change = F.when(F.col("_b").isNull(), "add").when(F.col("_a").isNull(), "delete").when(F.col("_a") == F.col("_b"), "keep").otherwise("update")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def similar_surfaces(names: DataFrame, limit: float = 0.8, column: str = "name") -> DataFrame:
    """a, b, similarity: pairs a < b of distinct names whose character pairs have Jaccard
    similarity of at least `limit`."""
    pairs = similar_across(names.select(F.col(column).alias("name")), None, limit)
    return pairs.filter("a < b")


BITS = [f"bits{k}" for k in range(4)]
CELL = 16_384  # names of one side that meet in a task by a common pair of characters


def _bits(grams: Column) -> list[Column]:
    """A set as 256 bits in four numbers, one bit an element; two sets differ in at least as many elements as in bits."""
    place = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(256)).cast("int"))
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(64)).cast("int"))
    word = lambda k: F.aggregate(place, F.lit(0).cast("long"), lambda s, p: F.when(F.floor(p / 64) == k, s.bitwiseOR(one(p))).otherwise(s))
    return [word(k).alias(name) for k, name in enumerate(BITS)]


def similar_across(left: DataFrame, right: DataFrame | None, limit: float = 0.8, cell: int = CELL) -> DataFrame:
    """a, b, similarity: names of `left` and of `right` (one column each; None: the same) whose
    character pairs have Jaccard similarity of at least `limit`.

    Prefix filter: of two sets that similar, the (1 - limit) share of rarest elements,
    and one more, have one in common. Only those few meet in the join, so a common pair
    of characters doesn't bring all names together. Where they meet, the sets' bits tell by
    how many elements they differ at least, so that few pairs leave the join; these are verified
    on the sets. Names of one element are dealt into cells of `cell` names a side.
    """
    sides = [left] if right is None else [left, right]
    grams = [F.col("name"), T.bigram_set(F.col("name")).alias("grams")]
    sets = [x.toDF("name").filter("name IS NOT NULL").distinct().select(*grams).filter(F.size("grams") > 0) for x in sides]
    sets = [materialise(s.select("name", "grams", F.size("grams").alias("n"), *_bits(F.col("grams"))), "surfaces") for s in sets]
    rows = [s.select("name", "n", *BITS, F.explode("grams").alias("gram")) for s in sets]
    rarity = (rows[0] if right is None else rows[0].union(rows[1])).groupBy("gram").agg(F.count("*").alias("freq"))
    keep = F.col("n") - F.ceil(F.lit(limit) * F.col("n") - 1e-6) + 1

    def prefix(gram: DataFrame) -> DataFrame:
        ordered = gram.join(rarity, "gram").groupBy("name", "n", *BITS).agg(F.array_sort(F.collect_list(F.struct("freq", "gram"))).alias("ordered"))
        first = ordered.select("name", "n", *BITS, F.explode(F.slice("ordered", F.lit(1), F.least(keep, F.col("n")).cast("int"))).alias("g"))
        return materialise(first.select("name", "n", *BITS, "g.gram"), "surface-prefixes")

    kept = [prefix(r) for r in rows]
    one, two = kept[0], kept[-1]
    cells = [k.groupBy("gram").agg(F.ceil(F.count("*") / cell).cast("int").alias(f"cells_{side}")) for k, side in ((one, "a"), (two, "b"))]
    cells = cells[0].join(cells[1], "gram")
    dealt = lambda at, mine, other: (
        at.join(cells, "gram").withColumn(mine, F.pmod(F.xxhash64("name"), F.col(f"cells_{mine}")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"cells_{other}") - 1)))
    )
    one = dealt(one, "a", "b").select("gram", F.col("a").alias("row"), F.col("b").alias("column"), F.col("name").alias("a"), "n", *BITS)
    two = dealt(two, "b", "a").select("gram", F.col("a").alias("row"), F.col("b").alias("column"), F.col("name").alias("b"), F.col("n").alias("m"), *[F.col(c).alias(f"other_{c}") for c in BITS])
    pairs = one.join(two if right is not None else two.hint("shuffle_merge"), ["gram", "row", "column"])
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in BITS[1:]), F.bit_count(F.col(BITS[0]).bitwiseXOR(F.col(f"other_{BITS[0]}"))))
    pairs = pairs.filter(differ <= (F.col("n") + F.col("m")) * ((1 - limit) / (1 + limit) + 1e-6) + 1e-6)
    pairs = pairs.filter(F.least("n", "m") >= F.lit(limit) * F.greatest("n", "m") - 1e-6)
    pairs = (pairs.filter("a < b") if right is None else pairs).select("a", "b").distinct()
    full = pairs.join(sets[0].select(F.col("name").alias("a"), F.col("grams").alias("ga")), "a").join(sets[-1].select(F.col("name").alias("b"), F.col("grams").alias("gb")), "b")
    return full.withColumn("similarity", F.round(T.jaccard(F.col("ga"), F.col("gb")), 6)).filter(F.col("similarity") >= limit).select("a", "b", "similarity")


def first_passage(found: DataFrame) -> DataFrame:
    """doc_id, passage_id of containing(): each document's least passage, its first match."""
    return found.groupBy("doc_id").agg(F.min("passage_id").alias("passage_id"))


def assembled(queries: DataFrame, qas: DataFrame, answers: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, query, answer, passages of an evaluation set: queries (query_id, query), qas
    (query_id, aid), answers (aid, answer), qrels (query_id, pid). The answer is that of the least
    id, null without one; passages are sorted and empty without any."""
    first = qas.groupBy("query_id").agg(F.min("aid").alias("aid"))
    of = qrels.groupBy("query_id").agg(F.sort_array(F.collect_set("pid")).alias("passages"))
    at = queries.join(first, "query_id", "left").join(answers, "aid", "left").join(of, "query_id", "left")
    return at.select("query_id", "query", "answer", F.coalesce("passages", F.array().cast(of.schema["passages"].dataType)).alias("passages"))


def sampled_set(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, most: int, extra: float = 0.2, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The `most` queries with most relevant passages (the least id at a tie), and the corpus
    (pid, ...) of their passages and a share of all others, chosen by a digest of the id."""
    top = qrels.groupBy("query_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query_id").limit(most).select("query_id")
    chosen = queries.join(top, "query_id", "left_semi")
    wanted = qrels.join(top, "query_id", "left_semi").select("pid").distinct()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "pid"), 11) / F.lit(float(1 << 53))
    others = corpus.join(wanted, "pid", "left_anti").filter(draw < extra)
    return chosen, corpus.join(wanted, "pid", "left_semi").unionByName(others)


def top_per_item(pairs: DataFrame, item: str, other: str, k: int) -> DataFrame:
    """other, place: the k best of every item's candidates (item, other, score), all together, each
    once, in the order in which they first come: by item, then place within it."""
    order = Window.partitionBy(item).orderBy(F.desc("score"), F.asc(other))
    top = pairs.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k)
    first = top.groupBy(other).agg(F.min(F.struct(F.col(item).alias("item"), F.col("_at").alias("at"))).alias("place"))
    return first.select(other, "place.item", "place.at")


def accepted_tags(matches: DataFrame, n_tags: int, least: float = 0.75, most: int = 3) -> DataFrame:
    """doc_id, tag, confidence, place of a model's proposals (doc_id, tag: a number from 1, confidence):
    a missing confidence is 1, one above 1 a percentage; those below `least` or of no tag go,
    each tag counts once, and the `most` surest stay."""
    sure = F.when(F.col("confidence").isNull(), 1.0).when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    kept = matches.withColumn("confidence", sure).filter((F.col("confidence") >= least) & F.col("tag").between(1, n_tags))
    once = kept.groupBy("doc_id", "tag").agg(F.max("confidence").alias("confidence"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "tag")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def unused(tags: DataFrame, tag_col: str, *uses: DataFrame) -> DataFrame:
    """Tags that no table of uses (one column each) has; nulls there use nothing."""
    for use in uses:
        (name,) = use.columns
        tags = tags.join(use.select(F.col(name).alias("_use")).filter("_use IS NOT NULL").distinct(), F.col(tag_col) == F.col("_use"), "left_anti")
    return tags


def merge_spans(spans: DataFrame, by: list[str], start: str = "start_at", end: str = "end_at") -> DataFrame:
    """Overlapping or touching spans of each group joined: by, start, end, n_spans, best score."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    at = spans.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    at = at.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_spans"), F.max("score").alias("score")).drop("_island")
