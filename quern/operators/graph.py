"""Link graphs, folder trees, wiki checks and code-like relations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.containment import ENDS, GOES_ON, HELD, LONGEST, SENT, Beginnings
from quern.operators.relations import MAP_SIDE, similar_across
from quern.session import discard, materialise, spread

MOST_LEVELS = 16


def neighbours(nodes: DataFrame, edges: DataFrame, *terms: str) -> DataFrame:
    """a, b: edges (a, b), taken both ways, from nodes (id, name) whose name contains any of the terms."""
    named = reduce(lambda x, y: x | y, [F.col("name").contains(t) for t in terms], F.lit(False))
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    return both.join(nodes.filter(named).select(F.col("id").alias("a")), "a", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree over distinct edges (a, b)."""
    e = edges.select("a", "b").distinct()
    out, into = e.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("out_degree")), e.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.join(into, "node", "full_outer").select("node", zero("out_degree"), zero("in_degree"))


def lint(pages: DataFrame, links: DataFrame) -> DataFrame:
    """slug, n_broken, n_out, n_in, is_orphan, is_empty for pages (slug, text) and links
    (slug, target): broken links lead to no page, an orphan has no link to it, and an
    empty page has under 50 bytes."""
    links = links.distinct()
    broken = links.join(pages.select(F.col("slug").alias("target")), "target", "left_anti").groupBy("slug").agg(F.count("*").alias("n_broken"))
    out = links.groupBy("slug").agg(F.count("*").alias("n_out"))
    into = links.filter("slug != target").groupBy(F.col("target").alias("slug")).agg(F.count("*").alias("n_in"))
    at = pages.join(broken, "slug", "left").join(out, "slug", "left").join(into, "slug", "left").fillna(0, ["n_broken", "n_out", "n_in"])
    return at.select("slug", "n_broken", "n_out", "n_in", (F.col("n_in") == 0).alias("is_orphan"), (F.octet_length("text") < 50).alias("is_empty"))


def health(linted: DataFrame) -> DataFrame:
    """One row: n_pages, and a score of 100 less the orphans' percentage, 5 a broken link,
    15 if there are no links, 3 an empty page, at least 0."""
    at = linted.agg(
        F.count("*").alias("n_pages"), F.sum("n_broken").alias("broken"), F.sum("n_out").alias("links"),
        F.count_if("is_orphan").alias("orphans"), F.count_if("is_empty").alias("empty"),
    )
    lost = F.floor(F.col("orphans") * 100 / F.greatest("n_pages", F.lit(1))) + 5 * F.col("broken") + F.when(F.col("links") == 0, 15).otherwise(0) + 3 * F.col("empty")
    return at.select("n_pages", "orphans", "broken", F.greatest(100 - lost, F.lit(0)).cast("long").alias("score"))


def resolve_slugs(dead: DataFrame, pages: DataFrame, limit: float = 0.8) -> DataFrame:
    """slug, found, how: a page (slug, title) for each dead slug: of the same slug, of that
    title, of the same slug without case, hyphens and underscores, or of the slug whose
    character pairs are most alike, at `limit` or more; the least slug at a tie. Slugs that
    aren't found otherwise meet pages on their rarest pairs of characters."""
    by = lambda key, how: pages.groupBy(key.alias("key")).agg(F.min("slug").alias(how)).filter("key IS NOT NULL")
    at = dead.select("slug", F.lower(F.col("slug")).alias("lowered"), T.slug_key(F.col("slug")).alias("plain"))
    at = at.join(by(F.col("slug"), "exact"), F.col("slug") == F.col("key"), "left").drop("key")
    at = at.join(by(F.lower("title"), "titled"), F.col("lowered") == F.col("key"), "left").drop("key")
    at = at.join(by(T.slug_key(F.col("slug")), "normalised"), F.col("plain") == F.col("key"), "left").drop("key")
    at = materialise(at.select("slug", "exact", "titled", "normalised"), "slugs")
    left = at.filter(F.coalesce("exact", "titled", "normalised").isNull()).select("slug")
    near = similar_across(left, pages.select("slug"), limit).toDF("slug", "page", "like")
    fuzzy = near.groupBy("slug").agg(F.min_by("page", F.struct(-F.col("like"), F.col("page"))).alias("fuzzy"))
    at = at.join(fuzzy, "slug", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("titled").isNotNull(), "title").when(F.col("normalised").isNotNull(), "normalised").when(F.col("fuzzy").isNotNull(), "fuzzy")
    return at.select("slug", F.coalesce("exact", "titled", "normalised", "fuzzy").alias("found"), how.alias("how"))


def folder_path(path: Column) -> Column:
    """A folder path without outer spaces and slashes, empty parts and '.'."""
    return F.array_join(F.filter(F.transform(F.split(F.trim(path), "/+"), lambda p: F.trim(p)), lambda p: (p != "") & (p != ".")), "/")


def folder_parent(path: Column) -> Column:
    """The folder above a normal path; '' for what lies in the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def folder_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


SALTS, BLOCK = 32, 4096  # tasks that share a title's pages, and slugs that move as one row


def _titles_within(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """slug, title: pages (slug, text) that have a title of `titles` (title), each title once however many pages
    bear it: short titles are followed through the texts, which are dealt to tasks, and others found by anchor grams;
    see quern.operators.containment."""
    from quern.operators.containment import containing

    each = titles.select("title").distinct().select(F.col("title").alias("passage_id"), F.col("title").alias("passage"))
    found = containing(spread(pages.select("slug", "text"), "slug"), each, "slug", "text", within=False, follow=True)
    return found.select(F.col("doc_id").alias("slug"), F.col("passage_id").alias("title"))


def _salted(at: DataFrame, of: DataFrame) -> DataFrame:
    """at (slug, title, ...) joined with of (title, ...), a small table of few rows a title: each title's pages are dealt to SALTS tasks."""
    dealt = of.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return at.withColumn("_salt", F.pmod(F.xxhash64("slug"), F.lit(SALTS)).cast("int")).join(dealt, ["title", "_salt"]).drop("_salt")


def _of_several_titles(pages: DataFrame) -> bool:
    return not pages.groupBy("slug").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def missing_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """slug, target: pages (slug, title, text) whose text has another page's title without a link
    (slug, target) to it. A page meets titles, and these bring their pages in blocks: the pairs, of which
    there are as many as pages and targets that they name, are made where they are written and never shuffled.
    Nor are titles that pages have, while the pages' titles and the links are few enough to be broadcast."""
    titles = materialise(pages.filter("trim(title) != ''").select("title", "slug").distinct(), "titles")
    sizes = titles.groupBy("title").agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    blocks = titles.join(sizes, "title").groupBy("title", F.pmod(F.xxhash64("slug"), F.col("_n")).alias("_block")).agg(F.collect_list("slug").alias("_targets")).drop("_block")
    linked = links.groupBy("slug").agg(F.collect_set("target").alias("_linked"))
    found = _titles_within(pages, titles).join(F.broadcast(linked) if links.count() <= MAP_SIDE else linked, "slug", "left")
    pairs = found.join(F.broadcast(blocks), "title") if titles.count() <= MAP_SIDE else _salted(found, blocks)
    pairs = pairs.select("slug", "_linked", F.explode("_targets").alias("target")).filter("slug != target")
    pairs = pairs.filter(F.col("_linked").isNull() | ~F.array_contains("_linked", F.col("target"))).select("slug", "target")
    return pairs.distinct() if _of_several_titles(pages) else pairs


#: Where no link may go: code, links of both kinds, addresses. Fixed value.
UNLINKED = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\[\[[^\]]*\]\]|!?\[[^\]\n]*\]\([^)\n]*\)|https?://\S+", re.S)


#: Runs of ASCII word letters: where a title stands as places_of() has it, each of its runs is a whole run of the text.
RUN = re.compile(r"[A-Za-z0-9_]+")


def link_text(text: str, titles: list[tuple[str, str]]) -> str:
    """The text with [[slug|title]] at the first place of each title (slug, title) that isn't within
    code, a link or an address; longer titles first, each slug once, and none that the text links
    to already. A title that begins or ends with an ASCII word letter isn't looked for within words."""
    pieces, linked, bearers = re.split(f"({UNLINKED.pattern})", text, flags=re.S), set(re.findall(r"\[\[([^\]|]+)", text)), {}
    for slug, title in sorted(titles, key=lambda t: (-len(t[1]), t[1], t[0])):
        bearers.setdefault(title, {})[slug] = None
    used = set(text).union(*bearers)
    gap = next(c for c in map(chr, range(0x110000)) if c not in used and not RUN.match(c))  # stands for what isn't free
    free, kept = gap.join(pieces[::2]), pieces[1::2]
    for title, slugs in bearers.items():
        left, out, links, made, at, seen = (s for s in slugs if s not in linked), [], [], [], 0, 0
        for start in places_of(title, free) if title else ():
            slug = next(left, None)
            if slug is None:
                break
            n = free.count(gap, at, start)
            links += [*kept[seen : seen + n], f"[[{slug}|{title}]]"]
            made.append(slug)
            out.append(free[at:start])
            at, seen = start + len(title), seen + n
        if out:
            linked.update(made)
            free, kept = gap.join([*out, free[at:]]), links + kept[seen:]
    return "".join(p + k for p, k in zip(free.split(gap), [*kept, ""], strict=True))


WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")


def places_of(title: str, text: str) -> Iterator[int]:
    """Where a title begins in the text, from left to right without overlaps; not within words where it begins or ends with a word letter."""
    first, last, at = title[0] in WORD, title[-1] in WORD, text.find(title)
    while at >= 0:
        end = at + len(title)
        if (first and at and text[at - 1] in WORD) or (last and end < len(text) and text[end] in WORD):
            end = at + 1
        else:
            yield at
        at = text.find(title, end)


def free_text(text: str | None) -> str:
    """What links may go into, a null character between its parts."""
    return "\0".join(re.split(f"({UNLINKED.pattern})", text or "", flags=re.S)[::2])


def title_places(text: str | None, titles: list[str]) -> list[tuple[str, int]]:
    """Titles that the text has as words, and at how many places at most links can go there."""
    free = free_text(text)
    return [(t, n) for t in titles if t and (n := sum(1 for _ in places_of(t, free)))]


def _titles_as_words(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """slug, title: pages (slug, text) whose text may have a title as words, each title and page once: those with the
    title's longest run, and for titles without any those that contain it."""

    @F.pandas_udf("array<string>")
    def runs(text: pd.Series) -> pd.Series:
        return pd.Series([list(dict.fromkeys(RUN.findall(free_text(t)))) for t in text], dtype=object)

    own = F.regexp_extract_all("title", F.lit(RUN.pattern), F.lit(0))
    longest = F.array_max(F.transform(own, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    keyed = titles.select("title").distinct().withColumn("run", longest)
    by_run = pages.select("slug", F.explode(runs("text")).alias("run")).join(keyed.filter("run IS NOT NULL"), "run").select("slug", "title")
    others = keyed.filter("run IS NULL").select("title")
    return by_run.distinct() if others.isEmpty() else by_run.unionByName(_titles_within(pages, others)).distinct()


def _linked_by_shuffles(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """linked_pages() for more titles or bearers than a task can hold: pages, titles and bearers meet in joins."""
    texts = pages.select("slug", "text")

    @F.pandas_udf("array<struct<title:string,n:int>>")
    def counted(text: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([[{"title": x, "n": n} for x, n in title_places(t, list(o))] for t, o in zip(text, titles, strict=True)])

    within = _titles_as_words(pages, titles).groupBy("slug").agg(F.collect_list("title").alias("titles"))
    spare = F.size(F.split("text", r"\[\[")) + 1
    at = texts.join(within, "slug").select("slug", counted("text", "titles").alias("t"), spare.alias("spare"))
    if _of_several_titles(titles.withColumnRenamed("bearer", "slug")):  # then a page may be linked already by another title
        at = at.withColumn("spare", F.aggregate("t", F.col("spare"), lambda a, x: a + x["n"]))
    wanted = at.select("slug", "spare", F.explode("t").alias("t")).groupBy("slug", "t.title").agg(F.max(F.col("t.n") + F.col("spare")).alias("n"))
    wanted = materialise(wanted, "wanted-titles")
    most = wanted.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    first = titles.withColumn("_place", F.row_number().over(Window.partitionBy("title").orderBy("bearer"))).filter(F.col("_place") <= most)
    bearers = first.groupBy("title").agg(F.array_sort(F.collect_list("bearer")).alias("bearers"))
    named = _salted(wanted, bearers).groupBy("slug").agg(F.collect_list(F.struct("title", F.slice("bearers", F.lit(1), F.col("n")).alias("bearers"))).alias("titles"))

    @F.pandas_udf("string")
    def linked(text: pd.Series, slugs: pd.Series, titles: pd.Series) -> pd.Series:
        given = [[(b, x["title"]) for x in o for b in x["bearers"] if b != own] for own, o in zip(slugs, titles, strict=True)]
        return pd.Series([None if t is None else link_text(t, o) for t, o in zip(text, given, strict=True)], dtype=object)

    return texts.join(named, "slug", "left").select("slug", F.when(F.col("titles").isNull(), F.col("text")).otherwise(linked("text", F.col("slug").cast("string"), F.coalesce("titles", F.array().cast(named.schema["titles"].dataType)))).alias("text"))


class WordTitles(Beginnings):
    """Titles to be followed from where one can begin: not within words if it begins with a word letter."""

    def __init__(self, titles: list[str]):
        super().__init__(titles)
        firsts = {t[0] for t in titles}
        sets = ["[" + "".join(map(re.escape, sorted(s))) + "]" if s else "(?!)" for s in (firsts & WORD, firsts - WORD)]
        self.starts = re.compile(rf"(?<![A-Za-z0-9_]){sets[0]}|{sets[1]}")

    def places(self, free: str) -> dict[str, int]:
        """title_places() for all of them at once, of a text that free_text() made."""
        get, size, found, ends = self.of.get, len(free), {}, {}
        for m in self.starts.finditer(free):
            start = m.start()
            end = start + 1
            while k := get(free[start:end]):
                if k & ENDS and not (end < size and free[end - 1] in WORD and free[end] in WORD):
                    title = free[start:end]
                    if ends.get(title, 0) <= start:
                        found[title], ends[title] = found.get(title, 0) + 1, end
                if not k & GOES_ON or end == size:
                    break
                end += 1
        return found


def linked_pages(pages: DataFrame) -> DataFrame:
    """slug, text of pages (slug, title, text) with links to the other pages whose titles they have.
    Of the pages that bear one title, a page is given only as many, the first by slug, as it has places for
    them, and those besides that link_text() may pass over: the page itself and what its text links to.

    Up to MAP_SIDE bearers of titles that are short enough are sent to all tasks: then a text is dealt to a task once, and
    finds its titles, their places and bearers there."""
    titles = materialise(pages.filter("title != ''").select("title", F.col("slug").cast("string").alias("bearer")).distinct(), "titles")
    size, n = titles.agg(F.coalesce(F.sum(F.length("title")), F.lit(0)), F.count("*")).first()
    each = titles.select("title").distinct()
    if n > MAP_SIDE or size > SENT or each.agg(F.coalesce(F.sum(F.length("title")), F.lit(0))).first()[0] > HELD:
        return _linked_by_shuffles(pages, titles)
    follow = F.col("title").rlike(RUN.pattern) & (F.length("title") <= LONGEST)
    others = each.filter(~follow)
    texts = spread(pages.select("slug", "text"), "slug")
    if others.isEmpty():
        at = texts.withColumn("titles", F.array().cast("array<string>"))
    else:
        at = texts.join(_titles_within(pages, others).groupBy("slug").agg(F.collect_list("title").alias("titles")), "slug", "left")
    several = _of_several_titles(titles.withColumnRenamed("bearer", "slug"))  # then a page may be linked already by another title
    sent = pages.sparkSession.sparkContext.broadcast(titles.select("title", "bearer", follow.alias("follow")).orderBy("title", "bearer").toArrow())

    @F.pandas_udf("string")
    def linked(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        bearers = sent.value.column("bearer").combine_chunks()
        first, followed = {}, []
        for k, (title, follows) in enumerate(zip(sent.value.column("title").to_pylist(), sent.value.column("follow").to_pylist(), strict=True)):
            if title not in first:
                first[title] = k
                followed += [title] * follows
        places = [*first.values(), len(bearers)]
        last, known = dict(zip(first, places[1:], strict=True)), WordTitles(followed)

        def one(own: str, text: str, others: list[str] | None) -> str:
            found = known.places(free_text(text)) | (dict(title_places(text, list(others))) if others is not None else {})
            spare = text.count("[[") + 2 + several * sum(found.values())
            return link_text(text, [(b, t) for t, n in found.items() for b in bearers.slice(first[t], min(n + spare, last[t] - first[t])).to_pylist() if b != own])

        for slugs, text, others in rows:
            yield pd.Series([None if t is None else one(s, t, o) for s, t, o in zip(slugs, text, others, strict=True)], dtype=object)

    return at.select("slug", linked(F.col("slug").cast("string"), "text", "titles").alias("text"))


def parse_graph(replies: DataFrame, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and edges (id, a, b, kind) of replies (id, text): JSON objects, in a fence or
    not, with "nodes" [{name}] and "relations" [{from, to, type}]. Ends that no node names become
    nodes, relations of a node to itself go, and so do those of a kind that isn't listed."""
    from quern.functions.prepare import fenced_json

    schema = "nodes array<struct<name:string>>, relations array<struct<`from`:string,`to`:string,type:string>>"
    read = replies.select("id", F.from_json(fenced_json(F.col("text")), schema).alias("g"))
    end = lambda r: F.struct(F.trim(r["from"]).alias("a"), F.trim(r["to"]).alias("b"), r["type"].alias("kind"))
    true = lambda e: (e["a"] != "") & (e["b"] != "") & (e["a"] != e["b"]) & (e["kind"].isin(kinds) if kinds else F.lit(True))
    found = F.coalesce(F.array_distinct(F.filter(F.transform("g.relations", end), true)), F.array().cast("array<struct<a:string,b:string,kind:string>>"))
    named = F.coalesce(F.filter(F.transform("g.nodes", lambda n: F.trim(n["name"])), lambda n: n != ""), F.array().cast("array<string>"))
    names = F.array_union(named, F.flatten(F.transform(found, lambda e: F.array(e["a"], e["b"]))))
    # A reply is read once and brings no row twice; the outer kind of explode keeps Spark from reading it for a filter first.
    edges = read.select("id", F.explode_outer(found).alias("e")).filter("e IS NOT NULL").select("id", "e.*").distinct()
    return read.select("id", F.explode_outer(names).alias("name")).filter("name IS NOT NULL").distinct(), edges


def merge_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """namespace, name, attributes, chunks of nodes and new ones: attributes and chunks of one name are united."""
    every = nodes.unionByName(new)
    united = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return every.groupBy("namespace", "name").agg(united("attributes"), united("chunks"))


def delete_namespaces(nodes: DataFrame, edges: DataFrame, namespaces: list[str]) -> tuple[DataFrame, DataFrame]:
    gone = F.col("namespace").isin(namespaces)
    return nodes.filter(~gone), edges.filter(~gone)


def opposite(edges: DataFrame, node) -> DataFrame:
    """Edges that touch a node, with `other`, the end that isn't it, and `outgoing`."""
    out = F.col("a") == node
    return edges.filter(out | (F.col("b") == node)).withColumns({"other": F.when(out, F.col("b")).otherwise(F.col("a")), "outgoing": out})


def visible_relations(relations: DataFrame, snapshots: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """`relations` (snapshot, from_file, to_file and more) that can be shown: their snapshot is
    published, their file is a parsed member of it and not deleted, and so is the file they lead
    to, unless they lead to none ('' or null)."""
    published = snapshots.filter("state = 'published'").select("snapshot")
    parsed = members.filter("status = 'parsed'").select("snapshot", "file").distinct()
    live = parsed.join(files.filter("deleted_at IS NULL").select("file"), "file", "left_semi")
    at = relations.join(published, "snapshot", "left_semi").join(live.withColumnRenamed("file", "from_file"), ["snapshot", "from_file"], "left_semi")
    target = live.select("snapshot", F.col("file").alias("to_file"), F.lit(True).alias("_there"))
    outside = F.coalesce("to_file", F.lit("")) == ""
    return at.join(target, ["snapshot", "to_file"], "left").filter(outside | F.col("_there")).select(*relations.columns)


def folder_totals(paths: DataFrame, column: str = "path") -> DataFrame:
    """folder, n_direct, n_total: entries in each folder itself and in its whole subtree.
    Every ancestor of a path exists; the root is ''. An entry adds one row per ancestor, and
    equal paths are counted together before that."""
    counted = paths.groupBy(F.regexp_replace(F.trim(F.col(column)), "^/+|/+$", "").alias("path")).agg(F.count("*").alias("n"))
    parts = F.filter(F.split("path", "/+"), lambda p: p != "")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    at = counted.select("n", F.array_join(parts, "/").alias("own"), F.explode(chain).alias("folder"))
    return at.groupBy("folder").agg(F.sum(F.when(F.col("folder") == F.col("own"), F.col("n")).otherwise(0)).alias("n_direct"), F.sum("n").alias("n_total"))


def descendants(nodes: DataFrame, roots: DataFrame, most_levels: int = MOST_LEVELS, live: Column | None = None) -> DataFrame:
    """root, id, level, cut of what hangs below each root in nodes (id, parent), level by level;
    `live` says which nodes count. Nodes at the last level are `cut` if they have children
    that count and aren't shown."""
    nodes = nodes.filter(live) if live is not None else nodes
    level = materialise(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("level")), "descendants")
    levels = []
    for depth in range(1, most_levels + 1):
        found = level.join(nodes.select(F.col("id").alias("child"), F.col("parent").alias("id")), "id").select("root", F.col("child").alias("id"), F.lit(depth).alias("level"))
        level = materialise(found, "descendants")
        if level.isEmpty():
            discard(level)
            break
        levels.append(level)
    out = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("level"))
    for x in levels:
        out = out.unionByName(x)
    parents = nodes.select(F.col("parent").alias("id")).filter("id IS NOT NULL").distinct().withColumn("_more", F.lit(True))
    cut = F.col("_more").isNotNull() & (F.col("level") == most_levels)
    return out.filter("level > 0").join(parents, "id", "left").select("root", "id", "level", cut.alias("cut"))


def top_nodes(scored: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k best nodes of each graph, then each node once, in its best graph."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("node"))
    top = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    best = top.groupBy("node").agg(F.max(F.struct("score", F.col(by))).alias("best"))
    return best.select("node", "best.score", F.col(f"best.{by}"))
