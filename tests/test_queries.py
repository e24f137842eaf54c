"""Every registered query against its DuckDB twin, or against plain Python where it has none."""

import hashlib
import math
import re

import pytest

from quern.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, same_rows):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        same_rows(got, duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(got) and name in PLAIN, "a query without SQL is held against plain Python below"


def test_entry(spark):
    import __spark_entry__

    assert FLAGSHIP in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def tokens(text):
    return {w for w in re.sub(r"\s+", " ", text.lower()).strip(" ").split(" ") if len(w) > 1 and re.search(r"[^\W_]", w)}


def norm(text):
    return re.sub(r"\s+", " ", text.lower()).strip(" ")


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def candidates(duck):
    """query_id: (doc_id, score, text, source, rank) of the fifty best by BM25, best first."""
    from quern.plans.retrieval_queries import BM25_CTE

    rows = duck.execute(f"WITH {BM25_CTE} SELECT query_id, doc_id, round(score / 100, 6), text, source, rank FROM bm_ranked JOIN documents USING (doc_id) WHERE rank <= 50 ORDER BY query_id, rank").fetchall()
    out = {}
    for q, *row in rows:
        out.setdefault(q, []).append(row)
    return {q: sorted(own, key=lambda r: (-r[1], r[0])) for q, own in out.items()}


def plain_mmr(candidates, **_):
    for q, own in candidates.items():
        chosen = []
        while len(chosen) < min(10, len(own)):
            value = lambda i: 0.7 * own[i][1] - 0.3 * max((alike(tokens(own[i][2]), tokens(own[j][2])) for j in chosen), default=0.0)  # noqa: B023, E731
            best = max((i for i in range(len(own)) if i not in chosen), key=lambda i: (value(i), -i))
            if value(best) <= -1:
                break
            chosen.append(best)
        yield from ((q, own[i][0], own[i][1], k) for k, i in enumerate(chosen, 1))


def plain_overlaps(candidates, **_):
    for q, own in candidates.items():
        kept = []
        for r in sorted(own, key=lambda r: (-r[1], -len(norm(r[2])), r[0])):
            clash = lambda s: s[3] == r[3] and (norm(r[2]) in norm(s[2]) or norm(s[2]) in norm(r[2]) or len(tokens(r[2]) & tokens(s[2])) >= 0.85 * max(1, min(len(tokens(r[2])), len(tokens(s[2])))))  # noqa: B023, E731
            if not any(map(clash, kept)):
                kept.append(r)
        yield from ((q, r[0], r[1], k) for k, r in enumerate(sorted(kept, key=lambda r: (-r[1], r[0])), 1))


def plain_budget(candidates, **_):
    for q, own in candidates.items():
        used, n = 0, 0
        for doc, _, text, _, rank in sorted(own, key=lambda r: r[4]):
            cost = len(text) + 3
            if n < 5 and used + cost <= 4000:
                used, n = used + cost, n + 1
                yield q, doc, rank, cost


def metric_words(text):
    sentences = [p.strip() for p in re.split("[。.]", text) if p.strip()]
    return [re.findall(r"[a-zA-Z0-9_.,!?]+|[^a-zA-Z0-9_\s]", s) for s in sentences]


def longest_words(x, y):
    """Words of all longest common subsequences, by tables of sets of sequences' words and lengths."""
    from functools import cache

    @cache
    def best(i, j):
        if i == len(x) or j == len(y):
            return 0, frozenset()
        options = [best(i + 1, j), best(i, j + 1)]
        if x[i] == y[j]:
            n, words = best(i + 1, j + 1)
            options.append((n + 1, words | {x[i]}))
        most = max(n for n, _ in options)
        return most, frozenset().union(*(w for n, w in options if n == most))

    return best(0, 0)[1]


def plain_rouge_l(duck, **_):
    import sys

    sys.setrecursionlimit(20_000)
    pairs = duck.execute("SELECT a.conv_id, a.turn, a.text, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant'").fetchall()
    for conv, turn, hyp, ref in pairs:
        h, r = metric_words(hyp), metric_words(ref)
        union = set().union(*(longest_words(tuple(x), tuple(y)) for x in r for y in h)) if h and r else set()
        own, other = len({w for s in h for w in s}), len({w for s in r for w in s})
        p, q = (len(union) / own if own else 0.0), (len(union) / other if other else 0.0)
        yield conv, turn, round(2 * p * q / (p + q + 1e-8), 6)


def plain_means(duck, **_):
    long = [r[2] for r in plain_rouge_l(duck)]
    scores = duck.execute(ORACLE_SQL["generation_metrics"]).df()
    yield from ((m, round(scores[m].mean(), 4), len(scores)) for m in ("bleu1", "bleu2", "bleu4", "rouge1", "rouge2"))
    yield "rougel", round(sum(long) / len(long), 4), len(long)


def recursive_chunks(duck, size=512, overlap=80):
    from quern.operators.chunking import split_recursive

    for i, text in duck.execute("SELECT doc_id, text FROM documents WHERE text != ''").fetchall():
        yield i, text, split_recursive(text, size, overlap)


def plain_verdicts(duck, **_):
    from quern.operators.chunking import verdict

    yield from ((i, len(chunks), verdict([b - a for a, b, _, _ in chunks], len(text), 512)) for i, text, chunks in recursive_chunks(duck))


def plain_parts(duck, **_):
    """Runs of neighbouring chunks; edited ones (and what follows them) join by text."""
    source = dict(duck.execute("SELECT doc_id, source FROM documents").fetchall())
    out = []
    for i, text, chunks in recursive_chunks(duck):
        run = None
        for n, (a, b, _, _) in enumerate(chunks):
            if n % 5 == 3:
                continue
            own, trusted = text[a:b], n % 7 != 2
            holds = lambda x, y: x == y or (len(y) >= 12 and y in x)
            if run and run["trusted"] and trusted:
                joins = a <= run["end"]
            else:
                joins = bool(run) and (n == run["last"] + 1 or holds(run["text"], own) or holds(own, run["text"]))
            if not joins:
                run = {"first": n, "start": a, "end": b, "text": own, "trusted": trusted, "last": n, "n": 1}
                out.append((i, run))
                continue
            if run["trusted"] and trusted:
                run["text"] += own[run["end"] - a :]
            else:
                shared = next((k for k in range(min(len(run["text"]), len(own), 400), 11, -1) if run["text"][-k:] == own[:k]), 0)
                whole = run["text"] if holds(run["text"], own) else own if holds(own, run["text"]) else run["text"] + (own[shared:] if shared else "\n\n" + own)
                run |= {"text": whole, "trusted": False}
            run |= {"end": max(run["end"], b), "last": n, "n": run["n"] + 1}
    for i, run in out:
        yield source[i], i, run["first"], run["start"], run["end"], run["n"], hashlib.sha256(run["text"].encode()).hexdigest()


def plain_widened(duck, **_):
    from quern.operators.stitch import join_texts

    for i, text, chunks in recursive_chunks(duck, 160, 20):
        parts = [text[a:b] for a, b, _, _ in chunks]
        for n in range(1, len(parts), 4):
            lo = hi = n
            whole = parts[n]
            if len(whole) < 350:
                lo, hi = max(0, n - 1), min(len(parts) - 1, n + 1)
                whole = join_texts(join_texts(parts[lo], whole) if lo < n else whole, parts[hi] if hi > n else "")
                while len(whole) < 350 and (lo > 0 or hi < len(parts) - 1):
                    if lo > 0:
                        lo, whole = lo - 1, join_texts(parts[lo - 1], whole)
                    if len(whole) < 350 and hi < len(parts) - 1:
                        hi, whole = hi + 1, join_texts(whole, parts[hi + 1])
                whole = whole[:850]
            yield i, n, hi - lo, hashlib.sha256(whole.encode()).hexdigest()


def plain_clusters(duck, one_store=False, cosine_least=0.999, **_):
    rows = duck.execute("SELECT p_brand, p_type, p_partkey, p_name, p_size FROM part ORDER BY p_partkey").fetchall()
    rows = [("", "", *r[2:]) for r in rows] if one_store else rows
    taken = set()
    for n, (brand, kind, i, name, size) in enumerate(rows):
        if i in taken:
            continue
        words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
        cosine = lambda a, b: (a * b + 100) / math.sqrt((a * a + 100) * (b * b + 100))
        own = [j for b, k, j, other, s in rows[n + 1 :] if (b, k) == (brand, kind) and j not in taken and (alike(words(name), words(other)) >= 0.3 or cosine(size, s) >= cosine_least)]
        if own:
            taken |= {i, *own}
            yield from ((j, i) for j in (i, *own))


def plain_clusters_one_store(duck, **_):
    yield from plain_clusters(duck, True, 0.99999)


def plain_links(duck, **_):
    rows = duck.execute("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1), regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', '', 'g'), '<[^>]*>', ' ', 'g') FROM pages").fetchall()
    titles = {i: t.split(" ")[0] for i, t, _ in rows}
    letter = lambda c: c.isascii() and (c.isalnum() or c == "_")
    for i, _, text in rows:
        free = [True] * len(text)  # characters that no link and no address has
        for m in re.finditer(r"```.*?(?:```|\Z)|`[^`\n]*`|\[\[[^\]]*\]\]|!?\[[^\]\n]*\]\([^)\n]*\)|https?://\S+", text, re.S):
            free[m.start() : m.end()] = [False] * (m.end() - m.start())
        for j, title in sorted(titles.items(), key=lambda x: (-len(x[1]), x[1], str(x[0]))):
            at = 0
            while title and j != i and (at := text.find(title, at)) >= 0:
                end = at + len(title)
                inside = (at and letter(text[at - 1]) and free[at - 1] and letter(title[0])) or (end < len(text) and letter(text[end]) and free[end] and letter(title[-1]))
                if all(free[at:end]) and not inside:
                    link = f"[[{j}|{title}]]"
                    text, free = text[:at] + link + text[end:], free[:at] + [False] * len(link) + free[end:]
                    break
                at += 1
        yield i, hashlib.md5(text.encode()).hexdigest()


def plain_limited(duck, **_):
    recent = {}
    for user, i, at in duck.execute("SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms FROM events ORDER BY at_ms, event_id").fetchall():
        own = [t for t in recent.get(user, []) if t > at - 6 * 3_600_000]
        yield user, i, len(own) < 3
        recent[user] = own + ([at] if len(own) < 3 else [])


PLAIN = {
    "rate_limited": (plain_limited, ["user_id", "event_id", "allowed"]),
    "wiki_links": (plain_links, ["slug", "text_md5"]),
    "mmr_rerank": (plain_mmr, ["query_id", "doc_id", "score", "rank"]),
    "partial_overlap_removal": (plain_overlaps, ["query_id", "doc_id", "score", "rank"]),
    "memory_budget": (plain_budget, ["query_id", "doc_id", "rank", "cost"]),
    "rouge_l_scores": (plain_rouge_l, ["conv_id", "turn", "rougel"]),
    "metric_means": (plain_means, ["metric", "mean", "n"]),
    "chunk_verdicts": (plain_verdicts, ["doc_id", "n_chunks", "verdict"]),
    "stitched_parts": (plain_parts, ["query_id", "doc_id", "chunk_index", "start_at", "end_at", "n_parts", "content_sha256"]),
    "widened_hits": (plain_widened, ["doc_id", "chunk_index", "n_joined", "content_sha256"]),
    "memory_clusters": (plain_clusters, ["item_id", "seed"]),
    "memory_clusters_one_store": (plain_clusters_one_store, ["item_id", "seed"]),
    "vector_graph_search": (None, []),  # the same
    "vector_index_search": (None, []),  # recall is measured in test_operators
}


@pytest.mark.parametrize("name", sorted(k for k, (f, _) in PLAIN.items() if f))
def test_against_plain_python(name, spark, duck, candidates):
    plain, columns = PLAIN[name]
    simple = lambda v: round(float(v), 4) if isinstance(v, float) else v
    rows = lambda it: sorted((tuple(map(simple, r)) for r in it), key=repr)
    got = rows(tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF).collect())
    assert got == rows(plain(duck=duck, candidates=candidates)) and got
