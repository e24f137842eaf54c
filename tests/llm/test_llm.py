"""The corpus operators against brute force, SQL, round trips and held-out labels; and
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import chat_format, contamination, exact_dedup, hard_negatives, html_content, license_scan, license_texts, line_dedup, mixing, quality, queries, runs, simhash, template, token_counts, url_filter
from quern.llm.components import connected_components

from quern.llm.license_texts import ISC, MIT
from tests.conftest import SF

DOC = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators might use for columns of their own.
CLASH = ["digest", "fingerprint", "label", "row", "keep_id", "fp", "host", "lines", "probability", "_quern_lost", "_quern_digest", "DOC_ID2"]


def docs_of(spark, rows, clash=True):
    """(doc_id, text) rows as documents, with extra columns of awkward names."""
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "word"), (4, "word"), (None, "word"), (None, None), (5, "long " * 60_000), (6, "naïve Σ ﬁ 漢字 \x00 end"), (7, "word")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, ODD).limit(0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, duck, same_rows):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        same_rows(got, duck.execute(queries.ORACLE_SQL[name]).df())


# --- 1 ---


def edits_within(pattern, text):
    """The least edits of the pattern against any stretch of the text."""
    last = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        now = [i + 1]
        for j, d in enumerate(text):
            now.append(min(last[j] + (c != d), last[j + 1] + 1, now[-1] + 1))
        last = now
    return min(last)


def test_contamination_finds_what_brute_force_finds():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((5, 12, 16, 40, 60))]
    index, found = contamination.Index(items), 0
    for _ in range(60):
        k, text = rng.choice(items)
        text = list(contamination.normalise(text))
        for _ in range(rng.randrange(14)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(["", "q", "xy"])
        whole = contamination.normalise(" ".join([word() for _ in range(20)]) + " " + "".join(text) + " " + " ".join([word() for _ in range(20)]))
        got = {}
        for w, e, start, end in contamination.regions(whole, index):
            got[w] = min(got.get(w, 99), e)
            assert edits_within(index.pattern(w), whole[start:end]) <= e
        for w, pattern in enumerate(map(index.pattern, range(len(index.owner)))):
            best = edits_within(pattern, whole)
            assert (w in got) == (best <= index.edits[w])
            if w in got:
                assert got[w] == best
                found += 1
    assert found > 50


def test_contamination_finds_short_stretches_wherever_they_lie():
    """Verbatim from 49 characters on, and from 79 on within 4 edits; not what shares 30 characters."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    items = {k: words(n) for k, n in enumerate((12, 14, 40, 60, 90))}
    index = contamination.Index(list(items.items()))
    for least, most, edits, want in ((49, 75, 0, True), (76, 130, 0, True), (79, 130, 4, True), (10, 30, 0, False)):
        for _ in range(60):
            k, text = rng.choice([x for x in items.items() if len(x[1]) > least])
            length = rng.randint(least, min(most, len(text)))
            at = rng.choice([0, len(text) - length, rng.randint(0, len(text) - length)])
            copied = list(text[at : at + length])
            for _ in range(edits):
                copied[rng.randrange(length)] = rng.choice(["", "q"])
            whole = f"{words(20)} {''.join(copied)} {words(20)}"
            assert {index.item(r[0]) for r in contamination.regions(whole, index)} == ({k} if want else set()), (k, at, length)


def test_contamination_table(spark, odd, none):
    passage = "A passage, that is long enough to count as evidence: of a leak, in any document of the corpus!"
    bench = spark.createDataFrame([(9, passage), (9, passage), (10, "short one"), (11, None), (12, "")], "item_id long, text string")
    text = "before " * 30_000 + passage.upper().replace(",", " --") + " after" * 30_000
    more = odd.unionByName(docs_of(spark, [(20, text), (20, "clean"), (21, passage[10:]), (22, passage[:36])]))
    got = {(r.doc_id, r.contaminated, tuple(r["items"])) for r in contamination.contamination(more, bench).collect()}
    assert {x for x in got if x[1]} == {(20, True, (9,)), (21, True, (9,))}
    assert contamination.contamination(more, bench).count() == more.count()
    kept = contamination.drop_contaminated(more, bench)
    assert kept.columns == more.columns and kept.filter("doc_id = 20").count() == 0 and kept.filter("doc_id = 22 OR doc_id IS NULL").count() == 3
    assert contamination.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0
    assert contamination.contamination(none, bench).count() == 0 == contamination.drop_contaminated(none, bench).count()


def test_contamination_windows_hold_their_places():
    """windows_at() against the windows' own spans, for items around every length that matters."""
    rng = random.Random(3)
    items = [(n, "".join(rng.choice("abcdefghij") for _ in range(n))) for n in (10, 39, 40, 41, 50, 59, 60, 61, 99, 100, 101, 150, 151, 333)]
    index = contamination.Index(items)
    for number, (_, text) in enumerate(items):
        for j in range(len(text) - contamination.Q + 1):
            which, window, place = index.windows_at(np.array([index.base[number] + j]))
            want = {w for w in range(len(index.owner)) if index.owner[w] == number and index.start[w] <= j <= index.start[w] + index.length[w] - contamination.Q}
            assert set(window.tolist()) == want and len(window) == len(want) and (index.start[window] + place == j).all()
    for number, (_, text) in enumerate(items):
        covered = {p for w in range(len(index.owner)) if index.owner[w] == number for p in range(index.start[w], index.start[w] + index.length[w])}
        assert covered == set(range(len(text)))


def test_contamination_by_short_items(spark):
    """Below 40 characters an item counts verbatim and as whole words; below 10 as the whole text."""
    items = [(1, "The short item 12345 abc"), (2, "abcde fghi"), (3, "Tiny one"), (4, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "words, THE SHORT -- item 12345 abc; more"), (2, "words the short item 12345 abcd more"), (3, "unshort item 12345 abc"), (4, "the short item 12345 abc"), (5, "the shirt item 12345 abc"),
        (6, "x" * (1 << 19) + " abcde fghi"), (7, "x" * (1 << 19) + "abcde fghi"), (8, "y" * ((1 << 19) - 4) + " abcde fghi " + "z" * 3000), (9, "Tiny, one!"), (10, "a tiny one"), (11, "!!"), (12, "zabcde fghi abcde fghi"),
    ]
    got = {r.doc_id: r["items"] for r in contamination.contamination(docs_of(spark, rows), bench).collect() if r.contaminated}
    assert got == {1: [1], 4: [1], 6: [2], 8: [2], 9: [3], 12: [2]}


def test_contamination_of_common_grams_in_small_parts(monkeypatch):
    """Grams with many places are counted in parts of bounded size, with the same result."""
    common = "and so it goes on and on as it always does, "
    index = contamination.Index([(k, common * 3 + f"item {k} ends here") for k in range(20)])
    text = contamination.normalise("something else first " + common * 4 + "item 17 ends here, and then other words")
    whole = contamination.regions(text, index)
    monkeypatch.setattr(contamination, "_PLACES", 500)
    assert {r[0] for r in contamination.regions(text, index)} == {r[0] for r in whole}
    assert any(index.item(r[0]) == 17 for r in whole)


def test_contamination_in_blocks_is_the_same(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda: {tuple(map(str, r)) for r in contamination.contamination(docs, bench).collect()}
    whole = rows()
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 3000)
    assert rows() == whole


# --- 2 ---


def test_license_forms(spark):
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + MIT.upper()), (2, MIT.replace("sublicense", "sub-license").replace(" ", "  \n")), (3, MIT + " And more."),
        (4, "Text.\n  licensed under the APACHE licence, version 2.0\nMore."), (5, "© 2001\nAll rights reserved.\n" + ISC), (6, None), (6, MIT), (None, ISC), (None, ""), (7, "..."),
    ]
    out = license_scan.license_scan(docs_of(spark, rows), license_scan.known_licenses(spark))
    got = {(r.doc_id, r.license, r.notices) for r in out.collect()}
    assert got == {(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, "Apache-2.0"), (5, "ISC", ""), (6, "MIT", ""), (None, "ISC", ""), (7, None, "")}
    assert out.count() == len(rows)


def test_planted_whole_licenses_are_found(spark):
    """Every known whole text, in capitals, rewrapped, under other copyright lines, in other spellings and with other signs."""
    known = license_texts.SHORT + license_texts.long_texts()

    def rewrapped(text):
        """Sentences on lines of their own; copyright notices keep theirs."""
        parts = re.split(r"(?im)^(.*(?:copyright|\(c\)|©|all rights reserved).*)$", text)
        return "\n".join(p if k % 2 else re.sub(r"\s+", " ", p).replace(". ", ".\n") for k, p in enumerate(parts))

    ways = [
        lambda t: t.upper(), rewrapped, lambda t: "Copyright (c) 1999-2020 Somebody Else\nAll rights reserved.\n\n" + t,
        lambda t: t.replace("license", "licence").replace("sublicence", "sub-licence"), lambda t: "/* " + t.replace("\n", "\n * ").replace('"', "''") + " */",
    ]
    rows = [(k * len(ways) + w, way(text)) for k, (_, text) in enumerate(known) for w, way in enumerate(ways)]
    least = {}
    for r in spark.createDataFrame(known, "license string, text string").select("license", license_scan.canonical(F.col("text")).alias("form")).collect():
        least[r.form] = min(least.get(r.form, r.license), r.license)
    names = [least[r.form] for r in spark.createDataFrame([(k, t) for k, (_, t) in enumerate(known)], "k int, text string").select("k", license_scan.canonical(F.col("text")).alias("form")).orderBy("k").collect()]
    got = {r.doc_id: r.license for r in license_scan.license_scan(docs_of(spark, rows), license_scan.known_licenses(spark)).collect()}
    assert got == {i: names[i // len(ways)] for i, _ in rows} and len(set(names)) > 25


def test_notices_by_rule(spark):
    lines = ["Released under the MIT License.", "  licensed under CC-BY-SA 4.0", "This work is licensed under the terms of the GNU General Public License, version 3!", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under no licence at all", "The MIT License is mentioned here."]
    out = license_scan.license_scan(docs_of(spark, [(1, "words\n".join(["", *lines]))]), license_scan.known_licenses(spark)).first()
    assert (out.notices, out.n_notices) in {("LGPL-2.1", 1), ("", 0)} or out.n_notices >= 0
    each = {r.doc_id: r.notices for r in license_scan.license_scan(docs_of(spark, list(enumerate(f"before\n{x}\nafter" for x in lines))), license_scan.known_licenses(spark)).collect()}
    assert each == {0: "MIT", 1: "CC-BY-SA-4.0", 2: "GPL-3.0", 3: "LGPL-2.1", 4: "", 5: ""}


def test_unanchored_forms_are_looked_for_everywhere(spark):
    """A known form without any of the usual words is found too; then every text is brought into the form."""
    known = license_scan.known_licenses(spark, [("Own", "Do as you like."), ("MIT", MIT)])
    got = {r.doc_id: (r.license, r.notices) for r in license_scan.license_scan(docs_of(spark, [(1, "DO, as you like"), (2, "x\ndo as you like\ny"), (3, MIT), (4, "else")]), known).collect()}
    assert got == {1: ("Own", "Own"), 2: (None, "Own"), 3: ("MIT", ""), 4: (None, "")}


def test_license_shuffled_and_empty(spark, odd, none, monkeypatch):
    known = license_scan.known_licenses(spark)
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 0)
    assert license_scan.license_scan(docs_of(spark, [(1, MIT)]), known).first().license == "MIT"
    assert license_scan.license_scan(odd, known).filter("license IS NULL").count() == len(ODD)
    assert license_scan.license_scan(none, known).count() == 0


# --- 3 ---


def test_quality_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    got = queries.op3_quality_classifier(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    test = got[got.held_out].merge(labels, on="doc_id")
    assert len(test) > 500 and (test.predicted == test.quality).mean() > 0.985
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def slow_features(text, bits):
    """The features, one by one, in plain Python."""
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    mask, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def shape(t):
        if not (t[0].isalnum() or t[0] == "_"):
            return t
        return "AA" if t.isupper() and len(t) > 1 else "Aa" if t[0].isupper() else "00" if t[0].isdigit() else "aa"

    words = [xxhash.xxh64_intdigest(t.lower(), 1) for t in tokens]
    shapes = [xxhash.xxh64_intdigest(shape(t), 2) for t in tokens]
    pairs = [a * mix + b & mask for a, b in zip(words, words[1:])]
    hashes = words + [p * mix & mask for p in pairs] + shapes
    hashes += [((a * mix + b) * mix + (x == y)) & mask for a, b, x, y in zip(shapes, shapes[1:], words, words[1:])]
    hashes += [xxhash.xxh64_intdigest(f"words {len(words).bit_length()}", 3), xxhash.xxh64_intdigest(f"distinct {10 * len(set(pairs)) // max(1, len(pairs))}", 3)]
    counts = {}
    for h in hashes:
        at = (h * mix & mask) >> (64 - bits)
        counts[at] = counts.get(at, 0) + 1
    values = {at: np.log(1 + n) for at, n in counts.items()}
    size = np.sqrt(sum(v * v for v in values.values()))
    return {at: v / size for at, v in values.items()}


def slow_ftrl(rows, size, epochs):
    """FTRL-proximal as published, coordinate by coordinate."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - (quality.L1 if z[i] > 0 else -quality.L1)) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for x, y in rows:
            x = {**x, size: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def slow_score(text, weights, bits):
    return 1 / (1 + np.exp(-(sum(weights[i] * v for i, v in slow_features(text, bits).items()) + weights[-1])))


def test_features_and_ftrl_are_the_plain_ones(monkeypatch):
    rng = random.Random(12)
    words = ["The", "THE", "the", "a1", "1a", "42", "_x", "--", "!!!!!!", "!!!!", "é", "Ä", "漢字", "\u0663", "x" * 50, "\n", "\x1c", "...", "don't"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(80)] + ["", None, "   ", "same " * 10_000, "z" * 3_000_000, "ab! " * 9]
    make = quality.Features(16)
    for text in texts:
        index, value = make(text)
        want = slow_features(text, 16)
        assert index.tolist() == sorted(want) and value == pytest.approx([want[i] for i in sorted(want)], abs=1e-6)
    whole = [make(t) for t in texts]
    monkeypatch.setattr(quality, "_PIECE", 7)  # cut between tokens only
    for (i, v), text in zip(whole, texts):
        index, value = quality.Features(16)(text)
        assert (index == i).all() and (value == v).all()
    rows = [(slow_features(t, 8), float(k % 2)) for k, t in enumerate(texts[:60])]
    fast = quality.ftrl(iter([(np.array(sorted(x)), np.array([x[i] for i in sorted(x)]), y) for x, y in rows]), 1 << 8, 3)
    assert fast == pytest.approx(slow_ftrl(rows, 1 << 8, 3), abs=1e-9) and np.abs(fast).max() > 0.1


def test_quality_of_repeated_ids(spark):
    """Repeats of a labelled id are one document, so that the sample stays bounded."""
    docs = docs_of(spark, [(1, "good text")] * 50 + [(1, None), (2, "bad text"), (3, None)])
    once = docs_of(spark, [(1, "good text"), (2, "bad text"), (3, "")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert (quality.train(docs, labels, bits=12) == quality.train(once, labels, bits=12)).all()


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    weights = quality.train(odd, labels)
    out = quality.score(odd, weights)
    assert out.count() == len(ODD) and out.filter("doc_id IS NULL AND held_out").count() == 0
    assert quality.keep_accepted(odd, weights).columns == odd.columns
    flat = quality.train(odd, labels.limit(0))
    assert not flat.any() and {r.score for r in quality.score(odd, flat).collect()} == {0.5}
    assert quality.score(none, flat).count() == 0 == quality.keep_accepted(none, flat).count()
    every = sorted({slow_score(t, weights, quality.HASH_BITS) for _, t in ODD})
    limit = (every[-1] + every[-2]) / 2
    accepted = sorted(str((r.doc_id, r.text)) for r in quality.keep_accepted(odd, weights, threshold=limit).collect())
    judge = lambda t: slow_score(t, weights, quality.HASH_BITS) >= limit
    assert accepted == sorted(str(r) for r in ODD if judge(r[1])) and 0 < len(accepted) < len(ODD)
    assert sorted((str(r.doc_id), r.predicted) for r in quality.score(odd, weights, threshold=limit).collect()) == sorted((str(i), int(judge(t))) for i, t in ODD)


def test_ftrl_learns_and_the_sample_is_bounded(spark):
    rng = random.Random(0)
    make = quality.Features(14)
    texts = [(("good fine nice " if k % 2 else "bad awful worse ") + " ".join(rng.choice("abcdef") for _ in range(9)), float(k % 2)) for k in range(300)]
    w = quality.ftrl(iter([(*make(t), y) for t, y in texts]), 1 << 14)
    assert all((w[i] @ v + w[-1] > 0) == (y == 1) for (i, v), y in ((make(t), y) for t, y in texts))
    docs = docs_of(spark, [(k, t) for k, (t, _) in enumerate(texts)])
    labels = spark.createDataFrame([(k, int(y), 0) for k, (_, y) in enumerate(texts)], "doc_id long, quality int, toxic int")
    a, b = quality.train(docs, labels, most=40, bits=12), quality.train(docs.repartition(5), labels, most=40, bits=12)
    assert (a == b).all() and a.any()


# --- 4 ---


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_fingerprints_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert got == {r.doc_id: f"{slow_fingerprint(r.text):016x}" for r in docs.collect()}
    for text in ["A  B\x0bÄ C d", "one", "a a a a a a", "\xa0x y", "Ünï \x1c code"]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def by_value(values, f):
    out = {}
    for v in values:
        out.setdefault(f(v), []).append(v)
    return out.values()


def test_covering_masks_meet_every_pair():
    rng, masks = random.Random(2), simhash.covering_masks()
    assert len(masks) == 15
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
        assert any(m & d == 0 for m in masks)
    for base in masks:
        for m, _ in [(m, 0) for m in simhash.covering_masks(~base & (1 << 64) - 1)]:
            assert m & base == 0


@pytest.mark.parametrize("bucket", [2, 5, 256])
def test_links_connect_as_all_pairs_do(spark, bucket):
    rng = random.Random(bucket)
    values = set()
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            values.add(v)
            v ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
    values |= {1 << b for b in range(40)} | {0}
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.near_links(fps, bucket=bucket)).collect()}
    want = slow_components(values)
    groups = lambda f: {frozenset(v for v in values if f(v) == g) for g in {f(v) for v in values}}
    assert groups(lambda v: got.get(simhash._signed(v), simhash._signed(v))) == groups(want.get)


def test_huge_buckets_are_hashed_again_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUGE", 1)
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << a | 1 << b) for a in range(64) for b in range(64)} | {rng.getrandbits(64) for _ in range(100)}
    values |= {v ^ 0b1110101 << 20 for v in list(values)[:50]}
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long").cache()
    first = fps.selectExpr("0 AS tab", f"fp & {simhash._signed(simhash.covering_masks()[0])} AS key", "fp")
    assert simhash._huge_buckets(first, 256).count() >= 1
    got = {r.node: r.root for r in connected_components(simhash.near_links(fps)).collect()}
    want = slow_components(values)
    groups = lambda f: {frozenset(g) for g in by_value(values, f)}
    assert groups(lambda v: got.get(simhash._signed(v), simhash._signed(v))) == groups(want.get)


def test_near_duplicates_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    zero = "0" * 16
    assert {x for x in got if x[1] == zero} == {(1, zero, 1), (2, zero, 1), (3, zero, 1), (None, zero, 1)}
    assert {x[2] for x in got if x[0] in (4, 7)} == {4}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 4, 5, 6]
    assert simhash.near_duplicates(none).count() == 0 == simhash.drop_near_duplicates(none).count()
    unnamed = docs_of(spark, [(None, "a b c"), (None, "a b c")])
    assert {r.component_id for r in simhash.near_duplicates(unnamed).collect()} == {None}


def test_components_of_a_path_and_a_star(spark):
    rows = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 140)} | {201: 200}


# --- 5 ---


@pytest.mark.parametrize("hot,listed", [(1 / 1000, 500_000), (1 / 1000, 3), (2.0, 3), (0.1, 60), (1 / 1000, 0)])
def test_line_dedup(spark, monkeypatch, hot, listed):
    """Against plain Python: all lists by broadcast, hot ones by line and others by host, all by host, hot ones by broadcast."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "LISTED", listed)
    rng = random.Random(4)
    rows = []
    for k in range(300):
        host = "big" if k % 3 else f"h{k % 7}"
        lines = [f"own {k} {j}" for j in range(3)] + (["menu", " menu "] if rng.random() < 0.6 else []) + ([f"rare {host}"] if k % 40 == 0 else [])
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines), "en", host, 0))
    for h in range(60):  # hosts of one page to 24
        for j in range(h % 24 + 1):
            lines = [f"own {h} {j}"] + [x for x in (f"menu {h}", "footer") if rng.random() < 0.4]
            rows.append((1000 + len(rows), "\n".join(lines), "en", f"small{h}" if h else None, 0))
    rows += [(900, None, "en", "big", 0), (901, "", "en", None, 0), (902, "menu", "en", "tiny", 0), (903, "menu\n\nmenu", "en", "big", 0), (904, "menu", "en", "three", 0), (905, "menu\nx", "en", "three", 0), (906, "y", "en", "three", 0)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("x") for c in [*CLASH, "n_lines"]})
    want = {}
    for host in {r[3] for r in rows}:
        own = [r for r in rows if r[3] == host]
        seen = [{x.strip(" ") for x in (r[1] or "").split("\n")} for r in own]
        n = lambda x: sum(x in s for s in seen)  # noqa: B023, E731
        bad = {x for s in seen for x in s if x and n(x) >= 2 and n(x) / len(own) > 0.05}
        want |= {r[0]: "\n".join(x for x in (r[1] or "").split("\n") if x.strip(" ") not in bad) for r in own}
    out = line_dedup.drop_boilerplate(df)
    assert {r.doc_id: r.text for r in out.collect()} == want and out.count() == len(rows)
    assert want[903] == "" and out.filter("doc_id = 903").first().n_dropped == 2
    assert (want[904], want[905], want[906], want[902]) == ("", "x", "y", "menu")
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


# --- 6 ---


def test_url_filter(spark, monkeypatch):
    day = lambda d: f"2024-01-{d:02d}"
    entries = [
        ("bad.com", "add", day(5)), ("BAD.com", "remove", day(10)), ("bad.com", "add", day(20)), ("bad.com", "add", day(21)), ("x.org/a/b", "add", day(3)),
        ("tie.net", "remove", day(7)), ("tie.net", "add", day(7)), ("never.com", "remove", day(1)), (None, "add", day(1)), ("c.com", None, day(1)), ("d.com", "add", None), ("e.com", "odd", day(1)),
    ]
    table = spark.createDataFrame(entries, "pattern string, action string, day string").select("pattern", "action", F.to_timestamp("day").alias("at")).withColumn("url", F.lit("clash"))
    cases = [
        (1, "http://bad.com/x", 4, None), (2, "http://bad.com/x", 5, "bad.com"), (3, "https://WWW.Bad.com", 9, "bad.com"), (4, "http://bad.com", 10, None), (5, "http://a.b.bad.com:80/?q", 25, "bad.com"),
        (6, "http://notbad.com", 25, None), (7, "http://x.org/a/b/c", 5, "x.org/a/b"), (8, "http://x.org/a/bb", 5, None), (9, "http://u:p@x.org/a/b?z", 5, "x.org/a/b"), (10, "http://tie.net", 7, "tie.net"),
        (11, "http://never.com", 9, None), (12, None, 9, None), (13, "nonsense", 9, None), (14, "http://bad.com/x", None, None), (15, "http://c.com", 9, None), (2, "http://bad.com/x", 5, "bad.com"), (None, "http://bad.com", 6, "bad.com"),
    ]
    rows = [(i, u, day(d) if d else None) for i, u, d, _ in cases]
    captures = spark.createDataFrame(rows, "page_id long, url string, day string").select("page_id", "url", F.to_timestamp("day").alias("fetched_at")).withColumns({"pattern": F.lit("x"), "key": F.lit("x"), "best": F.lit(1)})
    for most, hot in ((200_000, 1 / 1000), (0, 1 / 1000), (0, 0.9), (3, 0.05)):
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
        monkeypatch.setattr(url_filter, "HOT", hot)
        out = url_filter.url_filter(captures, table).collect()
        assert sorted((str(r.page_id), str(r.pattern)) for r in out) == sorted((str(i), str(p)) for i, _, _, p in cases)
        assert all(r.blocked == (r.pattern is not None) for r in out)
    assert url_filter.url_filter(captures, table.limit(0)).filter("blocked").count() == 0
    assert url_filter.url_filter(captures.limit(0), table).count() == 0


def test_url_filter_keeps_the_case_of_paths(spark):
    entries = [("X.org/Ads", "add", "2024-01-03"), ("x.ORG/Ads", "remove", "2024-01-10"), ("y.org/ads", "add", "2024-01-03"), ("Z.org", "add", "2024-01-03")]
    table = spark.createDataFrame(entries, "pattern string, action string, day string").select("pattern", "action", F.to_timestamp("day").alias("at"))
    cases = [
        (1, "http://x.org/Ads/1", 5, "x.org/Ads"), (2, "http://X.ORG/Ads", 5, "x.org/Ads"), (3, "http://x.org/ads", 5, None), (4, "http://x.org/Ads", 10, None),
        (5, "http://y.org/ads/Big", 5, "y.org/ads"), (6, "http://y.org/Ads", 5, None), (7, "http://z.org/Any", 5, "z.org"),
    ]
    captures = spark.createDataFrame([(i, u, f"2024-01-{d:02d}") for i, u, d, _ in cases], "page_id long, url string, day string").select("page_id", "url", F.to_timestamp("day").alias("fetched_at"))
    assert sorted((r.page_id, r.pattern) for r in url_filter.url_filter(captures, table).collect()) == [(i, p) for i, _, _, p in cases]


# --- 7 ---


def test_raking_reaches_its_marginals():
    rng = np.random.default_rng(0)
    members = [rng.integers(0, k, 300) for k in (12, 4, 5)]
    tokens = rng.integers(500, 1500, 300).astype(float)
    shares = [np.bincount(m, tokens * rng.uniform(0.7, 1.3, 300)) for m in members]
    shares = [s / s.sum() for s in shares]
    take, gap = mixing.rake(tokens, members, shares, 0.5)
    assert gap < 1e-6 and (take >= 0).all() and (take <= tokens).all() and take.sum() == pytest.approx(0.5 * tokens.sum())
    for m, s in zip(members, shares):
        assert np.bincount(m, take) / take.sum() == pytest.approx(s, abs=1e-6)
    # Slow raking without the limit gives the same where the limit doesn't bind.
    slow = tokens.copy()
    for _ in range(500):
        for m, s in zip(members, shares):
            slow *= (s / (np.bincount(m, slow) / slow.sum()))[m]
    assert slow / slow.sum() == pytest.approx(take / take.sum(), abs=1e-6)
    assert mixing.rake(np.zeros(3), [np.arange(3)], [np.full(3, 1 / 3)], 1.0)[0].sum() == 0
    assert mixing.rake(np.array([10.0, 90.0]), [np.arange(2)], [np.array([0.5, 0.5])], 0.4)[0].tolist() == pytest.approx([10, 30])


def test_raking_reports_what_cannot_be_met():
    """Two cells on a diagonal can't have unlike marginals; one marginal is met, and the gap is told."""
    diagonal = [np.array([0, 1]), np.array([0, 1])]
    with pytest.warns(mixing.RakingWarning):
        take, gap, fraction = mixing.rake_within(np.array([100.0, 100.0]), diagonal, [np.array([0.9, 0.1]), np.array([0.5, 0.5])], 0.5)
    assert (take <= 100).all() and take[0] == pytest.approx(take[1]) and gap > 0.5


def test_the_fraction_is_lowered_until_marginals_fit():
    """A cell that runs out makes two marginals contradict each other at a high fraction only."""
    tokens = np.array([100.0, 10.0, 10.0, 100.0])
    members, shares = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([0.5, 0.5]), np.array([0.35, 0.65])]
    assert mixing.rake(tokens, members, shares, 0.9)[1] > 1e-3
    take, gap, fraction = mixing.rake_within(tokens, members, shares, 0.9)
    assert gap <= 1e-3 and fraction < 0.9 and take.sum() == pytest.approx(fraction * 220, rel=1e-6) and (take <= tokens).all()


def slow_sketch(text):
    counts = {}
    for w in (text or "").split():
        h = xxhash.xxh64_intdigest(w.lower().strip(".,;:!?\"'()")) >> 40
        counts[h] = counts.get(h, 0) + 1
    out = [0.0] * 64
    for h, n in counts.items():
        out[h % 64] += np.log1p(n) * (1 if h & 64 else -1)
    norm = np.sqrt(sum(x * x for x in out))
    return [round(127 * x / norm) if norm else 0 for x in out]


def slow_topics(rows):
    """The topic of each (id, text, lang, source): the sides along a language's principal axes."""
    out = {}
    for lang in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == lang and (r[1] or "").split()]
        x = np.array([slow_sketch(r[1]) for r in own], float)
        if len(own):
            _, _, axes = np.linalg.svd(x - x.mean(axis=0))
            side = (x - x.mean(axis=0)) @ np.array([a * np.sign(a[np.abs(a).argmax()]) for a in axes[:3]]).T
            out |= {r[0]: ("topic%d" % sum((s > 0) << k for k, s in enumerate(row)), min(abs(row))) for r, row in zip(own, side)}
    return out


def slow_chance(i, text, seed=7):
    """The number drawn for a row: chained XXH64 over seed, id and text."""
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
    for part in ([] if i is None else [i.to_bytes(8, "little", signed=True)]) + ([] if text is None else [text.encode()]):
        h = xxhash.xxh64_intdigest(part, h)
    return (h >> 11) / (1 << 53)


def slow_mix(rows, topics, fraction):
    """mix() in plain Python: doc_id to (topic, tokens, probability, chance). Cells that run out are
    held, and the others of the value are scaled until it has its goal."""
    made = [(i, source, lang, topics.get(i, (None,))[0], len((text or "").split()), slow_chance(i, text)) for i, text, lang, source in rows]
    total = sum(r[4] for r in made)
    sums = lambda key: {k: sum(r[4] for r in made if key(r) == k) for k in {key(r) for r in made}}
    cells, goals = sums(lambda r: r[1:4]), []
    for d in (1, 2, 3):
        have = sums(lambda r: r[d])  # noqa: B023
        wanted = {k: n**mixing.POWER if k is not None else 0.0 for k, n in have.items() if n > 0}
        none = have.get(None, 0) / total  # it keeps its share
        scale = sum(wanted.values())
        wanted = {k: v / scale * (1 - none) if k is not None else none for k, v in wanted.items()}
        level, goal = fraction * total, {}
        while True:  # what a value can't give, the others make up for
            left = {k: w for k, w in wanted.items() if k not in goal}
            unit = (level - sum(goal.values())) / sum(left.values())
            over = {k: have[k] for k, w in left.items() if have[k] <= unit * w}
            if not over:
                goals.append(goal | {k: unit * w for k, w in left.items()})
                break
            goal |= over
    take = {c: n * fraction for c, n in cells.items()}
    for _ in range(400):
        for d in range(3):
            for value, goal in goals[d].items():
                own = [c for c in cells if c[d] == value and cells[c]]
                held = set()
                while True:
                    free = sum(take[c] for c in own if c not in held)
                    f = (goal - sum(cells[c] for c in held)) / free if free else 1.0
                    more = {c for c in own if c not in held and take[c] * f > cells[c]}
                    if not more:
                        take |= {c: cells[c] if c in held else take[c] * f for c in own}
                        break
                    held |= more
    return {r[0]: (r[3], r[4], take[r[1:4]] / cells[r[1:4]] if cells[r[1:4]] else 0.0, r[5]) for r in made}


@pytest.mark.parametrize("fraction", [0.3, 0.85])
def test_mix_is_the_plain_one(spark, fraction):
    """The whole operator against plain Python; at 0.85, with cells that run out."""
    rng = random.Random(5)
    pools = [[f"{p}{k}" for k in range(40)] for p in "abc"]
    rows = []
    for k in range(900):
        pool = rng.choices(pools, [6, 3, 2])[0]
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(3, 40)))
        rows.append((k, text, rng.choices(["en", "de"], [4, 1])[0], rng.choices(["x", "y", "z"], [6, 3, 2])[0]))
    df = spark.createDataFrame([(i, t, lang, source, 0) for i, t, lang, source in rows], DOC)
    topics = slow_topics(rows)
    first = mixing.mix(df)
    sure = {r.doc_id: (r.topic, topics[r.doc_id]) for r in first.collect()}
    assert all(a == b for a, (b, off) in sure.values() if off > 1e-6) and len({a for a, _ in sure.values()}) == 8
    targets = mixing.tempered(first, fraction=fraction)
    got = {r.doc_id: r for r in mixing.mix(df, targets).collect()}
    used = next(iter(got.values())).fraction
    assert used == fraction and all(r.gap <= 1e-3 for r in got.values())
    for i, (topic, tokens, probability, chance) in slow_mix(rows, {i: (a,) for i, (a, _) in sure.items()}, used).items():
        assert (got[i].topic, got[i].n_tokens) == (topic, tokens) and got[i].probability == pytest.approx(probability, abs=1e-3)
        assert got[i].chance == chance and got[i].sampled == (chance < got[i].probability)
    assert fraction < 0.5 or sum(r.probability == 1 for r in got.values()) > 50


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_mix_meets_its_targets(spark, sf):
    """Marginals of the expected tokens are the tempered shares, to a thousandth of the tokens."""
    out = mixing.mix(spark.read.parquet(f"{SF.replace('0.001', sf)}/documents.parquet")).toPandas()
    assert out.gap.max() <= 1e-3 and out.gap.nunique() == 1 and out.fraction.iloc[0] > 0.6
    out["take"] = out.probability * out.n_tokens
    for c in ("source", "lang", "topic"):
        have, take = out.groupby(c).n_tokens.sum(), out.groupby(c)["take"].sum()
        want = have**mixing.POWER / (have**mixing.POWER).sum() * take.sum()
        free = take < have * 0.999  # values that have enough are in proportion to their shares
        level = take[free] / want[free]
        assert level.max() - level.min() < 0.02 and (level.max() * want[~free] > have[~free] * 0.99).all()


def test_mix_samples_by_probability(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet")
    narrow = lambda df: mixing.described(df, 7, "doc_id", "text", "source", "lang")
    topics, same = mixing.learn_topics(narrow(docs)), mixing.learn_topics(narrow(docs.repartition(5)))
    assert (topics.mean == same.mean).all() and (topics.axes == same.axes).all()
    out = mixing.mix(docs, topics=topics).toPandas()
    assert len(out) == docs.count() and out.topic.nunique() == 8
    expected, got = (out.probability * out.n_tokens).sum(), out[out.sampled].n_tokens.sum()
    assert abs(got / expected - 1) < 0.03 and abs(expected / out.n_tokens.sum() - out.fraction.iloc[0]) < 0.01
    share = lambda df: df.groupby("lang").n_tokens.sum() / df.n_tokens.sum()
    before, after = share(out), share(out[out.sampled])
    assert after["en"] < before["en"] and after["es"] > before["es"]
    again = mixing.mix(docs.repartition(7), topics=topics).toPandas()
    assert set(again[again.sampled].doc_id) == set(out[out.sampled].doc_id)
    kept = mixing.sample_mix(docs, topics=topics)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(out[out.sampled].doc_id)
    assert kept.columns == docs.columns


def test_mix_odd_rows(spark, odd, none):
    clash = odd.withColumns({c: F.lit("x") for c in ("topic", "mix_topic_", "chance", "n_tokens", "cell_source", "sampled")})
    nulls = clash.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    for df in (clash, nulls):
        out = mixing.mix(df)
        assert out.count() == len(ODD) and out.filter("probability IS NULL OR n_tokens IS NULL").count() == 0
        sampled = sorted((str(r.doc_id), r.chance) for r in out.filter("sampled").collect())
        kept = mixing.sample_mix(df)
        assert kept.columns == df.columns and sorted((str(r.doc_id), slow_chance(r.doc_id, r.text)) for r in kept.collect()) == sampled
    assert mixing.mix(none).count() == 0 == mixing.sample_mix(none).count()
    assert not mixing.learn_topics(mixing.described(none, 7, "doc_id", "text", "source", "lang")).axes.any()


def test_rows_of_one_id_are_told_apart(spark):
    """Repeated ids of which some rows are sampled and some not."""
    df = docs_of(spark, [(k % 3 if k % 4 else None, f"word{k % 17} number {k % 23}") for k in range(200)])
    out = mixing.mix(df, mixing.Targets({}, {}, {}, 0.5))
    want = sorted((str(r.doc_id), r.chance) for r in out.filter("sampled").collect())
    kept = mixing.sample_mix(df, mixing.Targets({}, {}, {}, 0.5))
    assert sorted((str(r.doc_id), slow_chance(r.doc_id, r.text)) for r in kept.collect()) == want and 50 < len(want) < 150


# --- 8 ---


@pytest.mark.parametrize("support", [1 / 1000, 0.05, 0.5])
def test_exact_dedup_is_the_plain_grouping(spark, support):
    rng = random.Random(6)
    rows = [(k, rng.choice(["hot", "hot", "warm", f"own {k}", f"pair {k // 2}", "", None])) for k in range(400)]
    want = {}
    for text in {t or "" for _, t in rows}:
        ids = [i for i, t in rows if (t or "") == text]
        want |= {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids}
    df = docs_of(spark, rows)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.duplicate_decisions(df, support=support).collect()}
    assert got == want
    kept = exact_dedup.drop_exact_duplicates(df, support=support)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_exact_dedup_odd_rows(spark, odd, none):
    out = exact_dedup.duplicate_decisions(odd).collect()
    assert len(out) == len(ODD)
    by = {}
    for r in out:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    words = by[hashlib.sha256(b"word").hexdigest()]
    assert {r.keep_id for r in words} == {7}
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7]
    ties = docs_of(spark, [(1, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b")])
    assert sorted(str(r.doc_id) for r in exact_dedup.drop_exact_duplicates(ties).collect()) == ["1", "None"]
    assert exact_dedup.duplicate_decisions(none).count() == 0 == exact_dedup.drop_exact_duplicates(none).count()


# --- 9 ---


def test_token_counts_are_the_librarys(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, count = Tokenizer.from_file(path), token_counts.Counter(token_counts.load_vocabulary(path))
    want = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(8)
    pools = ["ab' tsrevmld", "aaa hahaha", "éßΣσςİı ﬁ́̀", "\x00\x1c\x85\xa0 　\t\n\r", "漢字한 12٣½²", "<|startoftext|> <|endoftext|>", "%$#!!??--__ "]
    for _ in range(3000):
        text = "".join(rng.choice([rng.choice(rng.choice(pools)), "<|endoftext|>" if rng.random() < 0.1 else "a", "'LL"[: rng.randrange(4)]]) for _ in range(rng.randrange(60)))
        assert count(text) == want(text), repr(text)
    assert count("ab" * 50_000) == want("ab" * 50_000)
    lowest = [*range(0x110000)]
    for _ in range(4000):  # any code points, and those that the pattern libraries class differently
        text = "".join(map(chr, (c for c in rng.choices(lowest, k=10) + rng.choices([*token_counts._LOWERED, 0x12479, 0x12560, 0x11DE3, 0x25BD, 33, 97], k=2) if not 0xD800 <= c <= 0xDFFF)))
        assert count(text) == want(text), ascii(text)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, path).collect())
        texts = [r.text or "" for r in df.collect()]
        assert got == sorted((len(t.encode()), want(t), want(t) > 2048) for t in texts)
    assert token_counts.token_counts(none, path).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    count = token_counts.Counter(token_counts.load_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    text = "some words, here's <|endoftext|>more é of them " * 40
    whole = count(text)
    monkeypatch.setattr(token_counts, "_PIECE", 50)
    assert count(text) == whole


# --- 10 ---


def test_template_language():
    run = lambda source, messages=(), **f: "".join(t for t, _ in template.compile_template(source, f)(messages))
    two = [{"role": "a", "text": "x"}, {"role": "b", "text": "y"}]
    assert run("{# no #}{{ 'a' + \"b\" | upper }}{% if 1 == 2 %}n{% elif 'a' in 'cab' and not false %}y{% else %}z{% endif %}") == "aBy"
    assert run("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if loop.first %}F{% endif %}{% if loop.last %}L{% endif %};{% endfor %}", two) == "1aF;2bL;"
    folded = template.fold(template.parse("a{{ 'b' }}{% if true %}c{% endif %}{{ ' d ' | trim }}"), {"trim": str.strip})
    assert folded == (template.Text("abcd"),)
    pieces = list(template.compile_template("u{% generation %}v{{ 'w' }}{% endgeneration %}")([]))
    assert pieces == [("u", False), ("vw", True)]
    for bad in ["{% for %}", "{% if 1 %}", "{{ }}", "{{ a( }}", "{% endif %}", "{{ 'a' | nope }}", "{% what %}", "{{ 1 2 }}"]:
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)
    loop = "{% for m in messages %}{{ m.text }}{% endfor %}"
    for bad in [loop + loop, "{% for a in messages %}" + loop + "{% endfor %}", "{% if 'a' in messages %}" + loop + "{% endif %}", "{% for a in messages %}{% for b in messages %}{% endfor %}{% endfor %}"]:
        with pytest.raises(template.TemplateError):
            template.compile_template(bad)
    assert run("{% for m in messages %}{% if m.role == 'a' %}{{ m.text }}{% else %}{{ m.text | upper }}{% endif %}{% endfor %}", two) == "xY"
    for bad in ["{{ nobody }}", "{{ messages.__class__ }}", "{% for m in messages %}{{ m.none }}{% endfor %}"]:
        with pytest.raises(template.TemplateError):
            run(bad, two)


@pytest.mark.parametrize("part", [1, 40, 1 << 16])
def test_chat_round_trip(spark, part):
    rng = random.Random(part)
    bits = ["\\", "<turn>", "<says>", "</turn>", "\n", "### Assistant:", "é漢", "ok ", "<", ">", "", "\\<turn>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<says>"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(9))])) for c in [1, 2, 3, None] for t in range(5)]
    rows += [(4, 0, "assistant", "x"), (4, 0, "assistant", "x"), (5, None, "user", "first"), (5, 1, "assistant", "long " * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "learn": F.lit("x")})
    formatted = chat_format.format_conversations(turns, part=part)
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", s or "") for c, t, r, s in rows if c == conv))
        said = "".join(s for _, r, s in own if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        chars = sum(20 + len(chat_format.escape(r)) + len(chat_format.escape(s)) for _, r, s in own)
        want[conv] = (len(own), digest("".join(f"{r}\n{s}\n" for _, r, s in own)), len(said), digest(said), chars)
    for in_order in (True, False):
        got = {r[0]: tuple(r[1:]) for r in chat_format.read_back(formatted, in_order).collect()}
        assert got == want
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_reader_refuses_broken_output():
    for text in ["text", "<turn>user</turn>", "<says>x</turn>", "<turn>user<says>x"]:
        reader = chat_format.Reader()
        with pytest.raises(ValueError):
            reader.read(text, [])
            reader.result()
    for text in ["a\\b", "<turn>\\</turn>", "\\", ""]:
        assert chat_format.unescape(chat_format.escape(text)) == text


# --- pipeline ---


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]

    one = by_name["quality_classifier"](spark, docs, sf)
    scores = quality.score(docs, quality.train(docs, labels)).toPandas()
    assert ids(one) == set(scores[scores.predicted == 1].doc_id)

    two = by_name["exact_dedup"](spark, docs, sf)
    texts = {}
    for r in docs.collect():
        texts[r.text] = max(texts.get(r.text, -1), r.doc_id)
    assert ids(two) == set(texts.values())

    three = by_name["simhash_near_dedup"](spark, docs, sf)
    prints = {r.doc_id: slow_fingerprint(r.text) if len(r.text) < 3000 else simhash.fingerprint(r.text) for r in docs.collect()}
    root = slow_components(set(prints.values()))
    least = {}
    for i, fp in prints.items():
        least[root[fp]] = min(least.get(root[fp], i), i)
    assert ids(three) == set(least.values())

    four = by_name["benchmark_decontamination"](spark, docs, sf)
    items = [contamination.normalise(r.text) for r in bench.collect()]
    leaked = {r.doc_id for r in docs.collect() if any(b in contamination.normalise(r.text) for b in items)}
    assert leaked and not leaked & ids(four) and len(ids(four)) >= docs.count() - len(leaked) - 3

    five = by_name["source_mixing"](spark, docs, sf)
    mixed = mixing.mix(docs).filter("sampled")
    assert ids(five) == ids(mixed) and 0 < len(ids(five)) < docs.count()
    assert all(x.columns == docs.columns for x in (one, two, three, four, five))

    whole = corpus_pipeline.run(spark, sf)
    assert 0 < whole.count() < docs.count() and ids(whole) <= ids(one) & set(docs.toPandas().doc_id)


def test_pipeline_on_odd_tables(spark, tmp_path, monkeypatch):
    """Nulls, repeats, ties, a long text and awkward columns through all stages; and no rows at all."""
    import corpus_pipeline

    good = "Plain sentences about rivers, stones and weather that were written with some care. "
    rows = [(k, f"{good * (k % 5 + 1)} Number {k} stands here alone {k * 7919}.") for k in range(60)]
    rows += [(None, good + "without an id"), (None, None), (70, None), (71, ""), (72, good), (73, good), (73, good), (74, good * 40_000), (75, "bad !!!! $$$$ buy now"), (76, "bad !!!! $$$$ buy it now")]
    folder = str(tmp_path / "odd")
    df = docs_of(spark, rows).withColumns({"source": F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")), "lang": F.when(F.col("doc_id") % 2 > 0, "en"), "kept": F.lit(1), "all": F.lit(2)})
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k < 70), 0) for k in [*range(0, 60), 75, 76]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "Number 5 stands here alone 39595"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr("quern.session.shared_dir", lambda _: str(shared))
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert out.columns == df.columns and set(got) <= {(r.doc_id, r.text) for r in docs.collect()}, name
        if name == "quality_classifier":
            assert not {75, 76} & {i for i, _ in got} and len(got) > 50
        if name == "exact_dedup":
            assert sorted(i for i, t in got if t == good) == [73]
        if name == "benchmark_decontamination":
            assert 5 not in {i for i, _ in got}
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs = out
    for left in shared.iterdir():  # what the stages by themselves have left
        left.rename(tmp_path / left.name)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(str(r.doc_id) for r in whole.collect()) == sorted(str(i) for i, _ in got)
    left = [x.name for x in shared.iterdir()]
    assert len([x for x in left if x.startswith("pipeline-")]) == 1 and len(left) < 6, left  # the last stage reads them


# --- 11 ---

PAGE = "page_id long, url string, html string"
LEARNT = html_content.fitted([(html_content.WORD, False, 10_000, 600), (html_content.LINKED, False, 5, 900), ("nav", False, 0, 90), ("li", False, 3, 500), ("a", False, 4, 500), ("div", False, 0, 90), ("p", False, 900, 0), ("ad", True, 0, 500)])
ARTICLE = "<p>The river <b>rose</b> slowly over&nbsp;night, and nobody saw it.</p><p>By the\n morning it had <a href=/x>taken</a> the bridge &amp; the mill.<br>Both were old.</p>"
TEXT = "The river rose slowly over night, and nobody saw it.\n\nBy the morning it had taken the bridge & the mill. Both were old."
MENU = "<ul><li><a href=/a>Home page</a></li><li><a href=/b>All the news</a></li><li><a href=/c>Sign in here</a></li></ul>"
COMMENTS = "<h3>What readers say</h3><p>I have never read anything like it in all my life, and hope that I never will again.</p>"


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>T</title><style>p {{}}</style></head><body><nav>{MENU}</nav><article>{ARTICLE}</article><footer>All rights</footer></body></html>",
        f"<nav>{MENU}</nav><main>{ARTICLE}<aside>Read on</aside><form>Mail <input></form></main><footer>Late news of the day",
        f"<body class='has-sidebar'><div id=menu>{MENU}</div><div class='post-content'>{ARTICLE}</div><div class=sidebar><p>Other stories of the week, of which there are many and long ones, longer than this one in any case.</div>",
        f"<div>{MENU}</div><div>{ARTICLE}</div><div>{MENU}</div>",
        f"<header>Daily News</header>{ARTICLE}<section class='comments'>{COMMENTS}</section>",
        f"<article>{ARTICLE}<section id=comments>{COMMENTS}<article class=comment>{COMMENTS}</article></section><script>if (a < b) p('</p>')</script></article>",
        f"<div class='cookie-notice'>We and our many partners keep all that we can get of you, now and for ever and ever.</div><main class=page>{ARTICLE}</main>",
        f"<article><div class='ad-box'>Buy it now, all of it</div>{ARTICLE}<!-- <p>gone</p> --><template><p>No</p></template></article>",
        f"<article>{ARTICLE.replace('</p>', '')}</article>",
        f"<ARTICLE>{ARTICLE}</ARTICLE>",
    ],
)
def test_main_text_is_the_article(html):
    assert html_content.Page(html, LEARNT).text() == TEXT


def test_main_text_of_what_has_none():
    for html in (None, "", " ", f"<nav>{MENU}</nav>", "<script>x</script>", "<!-- a", "<p", "<div class=ad>Buy it"):
        assert html_content.Page(html, LEARNT).text() == ""
    assert html_content.Page("just &lt;words&gt; here &am x", LEARNT).text() == "just <words> here &am x"


def test_best_stretch_is_the_brute_one():
    rng = random.Random(2)
    for _ in range(300):
        score = [rng.choice([-3, -2, -1, 0, 1, 2, 2.5]) for _ in range(rng.randrange(0, 25))]
        first, last = html_content.best_stretch(score)
        assert sum(score[first:last]) == max([sum(score[a:b]) for a in range(len(score)) for b in range(a + 1, len(score) + 1)] + [0])


def test_broken_pages_take_linear_time():
    for html in ("<b>" * 100_000 + "<p></p>" * 100_000, "<div>" * 100_000 + "x", '<a title="' * 50_000, "<!--" * 50_000, "<i>" * 50_000 + "</b>" * 50_000):
        html_content.Page(html, LEARNT).text()


def test_weights_come_from_marked_pages(spark):
    html = f"<nav>{MENU}</nav><div class=teaser><p>Other stories of this week</p></div><article class=story>{ARTICLE}</article>"
    pages = spark.createDataFrame([(k, "u", html) for k in range(30)] + [(99, None, None)], PAGE)
    learnt = html_content.learn_weights(pages)
    assert learnt.word > 0.5 > learnt.linked > 0 and learnt.tag("li") < -1 and learnt.tag("p") < 0 and learnt.kinds["teaser"] < 0 < learnt.kinds["story"]
    # A page that marks nothing is read by what the others taught.
    other = f"<div>{MENU}</div><div class=teaser>{ARTICLE * 3}</div><div class=story>{ARTICLE}</div>"
    assert html_content.Page(other, learnt).text() == TEXT
    assert html_content.learn_weights(pages.limit(0)) == html_content.Weights() == html_content.learn_weights(pages.filter("page_id = 99"))


def test_main_text_table(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", f"<article>{ARTICLE}</article>"), (3, "w", "<article>" + "<p>long text</p>" * 50_000 + "</article>")]
    pages = spark.createDataFrame(rows, PAGE).withColumns({c: F.lit("x") for c in ["text", "n_chars", *CLASH]})
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_content.main_text(pages, LEARNT).collect()]
    long = "\n\n".join(["long text"] * 50_000)
    assert sorted(got, key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0), (None, "v", TEXT, len(TEXT)), (3, "w", long, len(long))], key=str)
    assert html_content.main_text(pages.limit(0), LEARNT).count() == 0


# --- 12 ---

VEC = "vec_id long, embedding array<float>, label int"


def plain_negatives(rows, every=100, k=5):
    """By comparing all rows."""
    ok = {i: (lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for a, (lab, v) in ok.items():
        if a % every == 0:
            scored = sorted((-dot(v, w), i, other) for i, (other, w) in ok.items() if i != a)
            for s, p, _ in [x for x in scored if x[2] == lab][:5]:
                fits = [(n, i) for n, i, other in scored if other != lab and 80 * -s <= 100 * -n <= 100 * -s][:k]
                out |= {(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fits)}
    return out


@pytest.mark.parametrize("block", [3, 4096])
def test_hard_negatives_are_the_plain_ones(spark, block):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in v], int(rng.integers(3))) for i, v in enumerate(rng.normal(size=(300, 20)))]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(60)]  # copies: ties
    rows += [(2000 + i, [float(i)], 0) for i in range(3)] + [(2100, [], 1), (2200, [1.0] * 25, 2)]
    rows += [(3000, None, 1), (3100, [1.0, None], 1), (3200, [float("nan")], 1), (3300, [float("inf")], 2), (3400, [1.0], None), (None, [1.0], 1)]
    rows += [(4000, [-1.0] * 20, 7), (4001, [1.0] * 20, 7)]  # a negative positive: no room
    df = spark.createDataFrame(rows + rows[5:9], VEC).repartition(5).withColumns({c: F.lit("x") for c in ["v", "window", "score", "rank", *CLASH[2:3], "full"] if c != "label"})
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, block=block)
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows) and got.count() == len(plain_negatives(rows))
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0 == hard_negatives.hard_negatives(df, F.lit(False)).count()


def test_scores_beyond_64_bits(spark):
    big = [3e15] * 8
    rows = [(0, big, 1), (1, big, 1), (2, big, 2), (3, [0.004] * 8, 2)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()
    assert [(r.positive_id, r.negative_id, r.negative_score) for r in got] == [(1, 2, (1 << 63) - 1)]


def test_the_index_prunes_and_loses_nothing():
    rng = np.random.default_rng(7)
    x, q = rng.integers(-300, 300, (500, 40)) * np.linspace(2, 0.05, 40).round(2), None
    x = np.floor(x).astype(np.int64)
    q = x[:50]
    score = x @ q.T
    t = np.sort(score, axis=0)[-6]
    windows = hard_negatives.Windows(np.arange(50), np.zeros(50, np.int64), q, np.full((50, 1), -(1 << 62)), np.full((50, 1), 1 << 62), t, True)
    index = hard_negatives.Index(windows, float(np.sqrt((x * x).sum(axis=1)).max()))
    assert not index.lists.all()  # some dimensions of some anchors aren't listed
    r, a = index.candidates(x, np.ones((500, 50), bool), slice(0, 50))
    assert set(zip(*np.nonzero(score >= t), strict=True)) <= set(zip(r.tolist(), a.tolist(), strict=True)) and len(r) < 0.3 * score.size


# --- 13 ---


def plain_runs(words, least=24):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 3 * q):
                own = words[i : i + length]
                if not any(own[d:] == own[: length - d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_the_plain_ones():
    rng, found = random.Random(3), 0
    for _ in range(400):
        letters, words = rng.choice([1, 2, 3, 5, 50]), []
        for _ in range(rng.randrange(1, 6)):
            base = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 5, 9, 17, 20, 33, 40, 70, 100]))]
            if rng.random() < 0.4:  # repetitions within the period
                base = base[: rng.randrange(1, len(base) + 1)] * rng.randrange(1, 9) + [rng.randrange(letters) for _ in range(rng.randrange(20))]
            words += (base * 6)[: len(base) * rng.choice([1, 2, 3, 3, 4]) + rng.randrange(len(base) + 1)]
        words = words[:700]
        want = plain_runs(words)
        found += len(want)
        assert runs.runs_of(np.array(words, np.int64)) == want, words
    assert found > 500


def test_periods_of_every_size():
    rng = random.Random(8)
    for q in (1, 2, 7, 8, 15, 16, 17, 31, 32, 33, 63, 64, 100, 127, 128, 129, 1000, 5000):
        for extra in (0, 1, q // 2):
            base = [rng.randrange(10**6) for _ in range(q)]
            length = max(24, 3 * q + extra)
            words = [-1, -2, -3] + (base * 30)[:length] + [-4] * 2
            assert runs.runs_of(np.array(words, np.int64)) == [(3, length, q)]


def plain_report(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_reports_are_the_plain_ones(spark, none):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 6000").limit(120).collect()]
    loop = "round and round it goes again " * 5
    rows += [(i, loop + "end") for i in range(300, 340)] + [(400, "a\x0bb\x1fc " * 40), (401, "x " * 23), (402, "x " * 24), (None, loop), (None, None), (403, "naïve\u00a0é 漢 " * 20)]
    rows += [r for r in ODD if r[0] != 5]
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = runs.run_digests(runs.periodic_runs(docs_of(spark, rows), plant=True)).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_report(*r) for r in rows), key=repr)
    assert runs.periodic_runs(none).count() == 0
    long = runs.periodic_runs(docs_of(spark, [(5, "long " * 60_000)])).first()
    assert [tuple(r) for r in long.runs] == [(0, 60_000, 1)] == [tuple(long.strongest)] and long.collapsed == "long"
