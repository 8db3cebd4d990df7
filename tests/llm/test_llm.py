"""The corpus operators against brute force on small tables that hold the awkward cases."""

import base64
import glob
import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import fingerprints, nearcopies, repeats
from tickloom.llm.blocks import blocks, shingles, words
from tickloom.llm.languages import identify_languages, page_evidence, visible_text
from tickloom.llm.languages import train as train_languages
from tickloom.llm.leaks import find_leaks
from tickloom.llm.lines import dedup_lines
from tickloom.llm.mixing import distribution, mix_sources
from tickloom.llm.quality import classify_quality, estimate
from tickloom.llm.queries import ORACLES, QUERIES, VOCABULARY, op1_quality, op2_near_dedup, op6_language_id, op8_toxicity
from tickloom.llm.tokens import ForwardTrie, count_tokens, load_pieces
from tickloom.llm.toxicity import rate_toxicity
from tickloom.llm.toxicity import train as train_toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, label string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    vocabulary = ["ab", "Cd", "é", "ünd", "the", "of", "x9", "zeta", "idiot"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    line = "this line of more than forty characters is shared by MANY documents"
    base = prose(120)
    texts = ["", None, " \n\t ", "!!!", "one", prose(3), base, base, base.upper(), base + " tail", "\n", prose(30_000)]
    texts += [prose(40) + "\n" + line + "\n" + prose(30) for _ in range(6)] + [line + "\n" + line, "a" * 400, "a" * 400 + "b"]
    words_ = base.split()
    for i in range(12):
        copy = list(words_)
        copy[rng.randrange(len(copy))] = f"edit{i}"
        texts.append(" ".join(copy))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), len(t or ""), "k", "r", None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[0], (None, base, "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows.append((6, "another text under an id that is taken", "en", "s1", 1, "k", "r", "l"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_key(found):
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, sf_dir)
    assert set(columns) == set(found.columns)
    assert by_key(found.select(*columns).collect()) == by_key(cursor.fetchall())


def test_words_and_shingles(rows):
    texts = [r[1] for r in rows]
    counts, grams = [], []
    for block in blocks(pa.array(texts), 5000):
        found = words(block)
        counts += found.counts.tolist()
        grams += shingles(found).counts.tolist()
    expected = [len(WORD.findall(lower(t or ""))) for t in texts]
    assert counts == expected
    assert grams == [n - 4 if n >= 5 else int(n > 0) for n in expected]


# ---------------------------------------------------------------- line dedup


def brute_lines(rows):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return by_key(out)


def test_lines(docs, rows, none):
    found = dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert by_key(found) == brute_lines([r[:2] for r in rows])
    assert dedup_lines(none).count() == 0


# ---------------------------------------------------------------- near copies


def grams_of(text):
    found = WORD.findall(lower(text or ""))
    if not found:
        return None
    return Counter(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def brute_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [grams_of(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                shared = sum((sets[a] & sets[b]).values())
                near = shared >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - shared)
            else:
                near = sets[a] == sets[b] and lower(rows[a][1] or "") == lower(rows[b][1] or "")
            if near:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        known = least.get(find(k))
        least[find(k)] = known if i is None else i if known is None else min(known, i)
    return by_key((i, least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("direct", [32, 1])
def test_near_copies(monkeypatch, docs, rows, none, direct):
    monkeypatch.setattr(nearcopies, "DIRECT", direct)
    assert by_key(nearcopies.near_copies(docs).collect()) == brute_classes([r[:2] for r in rows])
    assert nearcopies.near_copies(none).count() == 0


def test_crowded_family_by_index(monkeypatch, spark):
    """Copies edited so far that only some pairs are linked, found by the prefix index alone."""
    monkeypatch.setattr(nearcopies, "DIRECT", 1)
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 4, 6, 8])):
            copy[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_key(nearcopies.near_copies(frame).collect()) == brute_classes(rows)


def test_crowded_family_of_varied_lengths(monkeypatch, spark):
    """The same with parts cut off, so that weights span the whole range in which partners may lie."""
    monkeypatch.setattr(nearcopies, "DIRECT", 1)
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for i in range(70):
        copy = base[rng.randrange(25) : 200 - rng.randrange(25)]
        for at in rng.sample(range(len(copy)), rng.choice([0, 1, 2, 4])):
            copy[at] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_key(nearcopies.near_copies(frame).collect()) == brute_classes(rows)


def test_tokens_do_not_grow_faster_than_keys(monkeypatch, spark):
    """Edited copies of one text leave few tokens each in the index, however many copies there are."""
    monkeypatch.setattr(nearcopies, "DIRECT", 1)
    made = []
    store = nearcopies.stored

    def seen(frame, name):
        out = store(frame, name)
        if name == "tokens":
            made.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "stored", seen)
    base = [f"w{k}" for k in range(300)]
    for copies in (60, 240):
        rng = random.Random(1)
        rows = []
        for i in range(copies):
            copy = base[rng.randrange(40) : 300 - rng.randrange(40)]
            for at in rng.sample(range(len(copy)), rng.choice([0, 2, 4, 8])):
                copy[at] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(copy)))
        nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert made[1] <= 6 * max(made[0], copies)


def test_one_copy_stays(docs, rows):
    kept = nearcopies.keep_one_copy(docs)
    assert kept.columns == docs.columns
    classes = brute_classes([r[:2] for r in rows])
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(c for _, c in classes if c is not None) <= set(ids)


def test_parities_never_differ_in_more_bits_than_cells():
    draw = np.random.default_rng(5)
    for shared, alone in ((0, 0), (0, 1), (40, 0), (40, 3), (500, 60), (3, 900)):
        cells = draw.integers(0, 2**63, shared + alone, dtype=np.uint64)
        text = np.repeat([0, 2], [shared, shared + alone])
        bits = nearcopies.parities(text, np.concatenate([cells[:shared], cells]), 3).view(np.uint64)
        assert not bits[1].any()
        differ = int(np.bitwise_count(bits[0] ^ bits[2]).sum())
        assert differ <= alone and differ % 2 == alone % 2


def test_darts_agree_as_weighted_jaccard():
    cells = np.arange(1, 301, dtype=np.uint64) * np.uint64(7919)
    text = np.concatenate([np.zeros(200, int), np.ones(200, int)])
    made = nearcopies.throw_darts(text, np.concatenate([cells[:200], cells[100:]]), 2, 4000)
    assert abs((made[0] == made[1]).mean() - 1 / 3) < 0.03
    # A cell that is half covered counts half.
    share = np.concatenate([np.ones(200), np.full(200, 0.5)])
    made = nearcopies.throw_darts(text, np.concatenate([cells[:200], cells[:200]]), 2, 4000, share)
    assert abs((made[0] == made[1]).mean() - 0.5) < 0.03


# ---------------------------------------------------------------- decontamination


def brute_leaks(rows, items):
    tests = []
    for item, text in items:
        found = WORD.findall(lower(text or ""))
        size = min(10, len(found))
        tests += [("" if item is None else str(item), tuple(found[i : i + size])) for i in range(len(found) - size + 1) if size]
    out = []
    for i, text in rows:
        found = WORD.findall(lower(text or ""))
        hit, named = set(), set()
        places = defaultdict(list)
        for size in {len(w) for _, w in tests}:
            for at in range(len(found) - size + 1):
                places[tuple(found[at : at + size])].append(at)
        for item, window in tests:
            for at in places.get(window, ()):
                hit |= set(range(at, at + len(window)))
                named.add(item)
        out.append((i, len(found), len(hit), sorted(named)))
    return by_key(out)


@pytest.mark.parametrize("pass_bytes", [4 << 20, 40])
def test_leaks(spark, docs, rows, none, pass_bytes):
    long = WORD.findall(lower(rows[11][1]))
    items = [(1, " ".join(long[500:530])), (2, "ZETA idiot"), (3, ""), (None, "one"), (10, " ".join(long[510:522])), (1, None), (4, "edit3")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(docs, benchmark, pass_bytes=pass_bytes, shard_bytes=3000)
    got = found.select("row.doc_id", "n_words", "n_hit", "items").collect()
    assert by_key(got) == brute_leaks([r[:2] for r in rows], items)
    best = found.where("row.doc_id = 11").first()
    assert (best["longest_words"], best["longest_item"], best["longest_at"]) == (30, "1", 500)
    assert find_leaks(none, benchmark).count() == 0
    assert find_leaks(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_longest_match_whatever_the_passes(spark):
    """Equally long matches: the earliest in the document counts, and there the smallest item."""
    passages = [" ".join(f"p{i}x{k}" for k in range(10)) for i in range(8)]
    items = [(f"{end}{i}", f"{passage} {end}") for i, passage in enumerate(passages) for end in ("b", "a")]
    rows = [(i, " gap ".join(passages[i:] + passages[:i])) for i in range(8)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for pass_bytes in (4 << 20, 400, 40):
        found = find_leaks(docs, benchmark, pass_bytes=pass_bytes).select("row.doc_id", "longest_words", "longest_item", "longest_at")
        assert by_key(found.collect()) == [(i, 10, f"a{i}", 0) for i in range(8)]


# ---------------------------------------------------------------- mixing


def test_mixing(spark, docs, rows, none):
    found = mix_sources(docs, total=200.0)
    again = mix_sources(docs.repartition(2), total=200.0)
    assert by_key(found.select("row.doc_id", "copy").collect()) == by_key(again.select("row.doc_id", "copy").collect())
    assert mix_sources(none).count() == 0
    only = mix_sources(docs, weights={"s1": 1.0}, total=100.0).select("row.source").distinct().collect()
    assert [r[0] for r in only] == ["s1"]
    keys = [r[0] for r in found.select("shuffle_key").collect()]
    assert keys == sorted(keys)


def test_mixing_reaches_target(spark):
    frame = spark.range(30_000).selectExpr("id AS doc_id", "'t' AS text", "if(id % 10 = 0, 'small', 'large') AS source")
    found = {r["source"]: r["count"] for r in mix_sources(frame, weights={"small": 3, "large": 1}).groupBy("row.source").count().collect()}
    assert abs(found["small"] - 22_500) < 500 and abs(found["large"] - 7_500) < 300


def test_distribution_of_large_rate(spark):
    values = distribution(spark.createDataFrame([("a", 2000.0)], "source string, rate double")).first()["at_most"]
    assert abs(values[-1] - 1) < 1e-9 and 0.45 < values[2000] < 0.55


# ---------------------------------------------------------------- token counts


def brute_tokens(text, pieces, byte_score):
    total = 0
    for token in re.findall(r"[^\x09-\x0D ]+", text or ""):
        token = "▁" + token
        best = [(0.0, 0)]
        for end in range(1, len(token) + 1):
            ways = [(best[b][0] + pieces[token[b:end]], -best[b][1] - 1) for b in range(end) if token[b:end] in pieces]
            if token[end - 1] not in pieces:
                size = len(token[end - 1].encode())
                ways.append((best[end - 1][0] + size * byte_score, -best[end - 1][1] - size))
            score, count = max(ways)
            best.append((score, -count))
        total += best[-1][1]
    return total


def test_tokens(docs, rows, none):
    pieces = load_pieces(VOCABULARY)
    trie = ForwardTrie(pieces)
    found = count_tokens(docs, pieces).select("row.doc_id", "n_tokens").collect()
    expected = [(r[0], brute_tokens(r[1], pieces, trie.byte_score)) for r in rows]
    assert by_key(found) == by_key(expected)
    assert count_tokens(none, pieces).count() == 0


# ---------------------------------------------------------------- suffix dedup


def brute_repeats(rows, length=50):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            first[raw[p : p + length]] = min(first.get(raw[p : p + length], 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < ((1 << 62) if i is None else i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return by_key(out)


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 500, "hot_shards": 1}])
def test_repeats(docs, rows, none, options):
    found = repeats.remove_repeats(docs, **options).select(
        "doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)
    )
    assert by_key(found.collect()) == brute_repeats([r[:2] for r in rows])
    assert repeats.remove_repeats(none).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = rng.permutation(2900)
    groups = np.sort(rng.integers(0, 4, len(starts)))
    order = repeats.suffix_order(repeats.HashedText(data), starts, groups, 50)
    raw = data.tobytes()
    expected = sorted(range(len(starts)), key=lambda k: (groups[k], raw[starts[k] : starts[k] + 50]))
    assert order.tolist() == expected


# ---------------------------------------------------------------- fingerprints


def test_fingerprints(docs, rows, none):
    order = sorted((r[:2] for r in rows), key=lambda r: (-(1 << 63 if r[0] is None else r[0]) if r[0] is not None else 1 << 63, r[1] or ""))
    expected = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    found = fingerprints.fingerprint_edits(docs)
    assert by_key(found.select("doc_id", "n_chars", "edited_sha256").collect()) == by_key(expected)
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_sketch_estimates():
    rng = random.Random(2)
    tokens = [f"t{rng.randrange(10**6)}" for _ in range(4000)]
    one, two, few = fingerprints.sketches(pa.array([" ".join(tokens[:3000]), " ".join(tokens[1000:]), "a b c"]))
    assert abs(fingerprints.resemblance(one, two) - 0.5) < 0.15
    assert abs(fingerprints.containment(one, two) - 2 / 3) < 0.2
    assert abs(fingerprints.distinct(one) / 2996 - 1) < 0.3
    assert fingerprints.distinct(few) == 1 and fingerprints.resemblance(few, few) == 1
    assert np.array_equal(fingerprints.decode(fingerprints.encode(one)), one)


def test_merged_parts(spark):
    rng = random.Random(2)
    texts = [" ".join(f"t{rng.randrange(500)}" for _ in range(300)) for _ in range(9)]
    frame = spark.createDataFrame([("a", t) for t in texts] + [(None, "x y z")], "part string, text string")
    prints = fingerprints.fingerprint_documents(frame).select("row.part", "fingerprint")
    merged = {r["part"]: r["fingerprint"] for r in fingerprints.merge_parts(prints, "part").collect()}
    whole = np.unique(np.concatenate(fingerprints.sketches(pa.array(texts))))[: fingerprints.K]
    assert np.array_equal(fingerprints.decode(merged["a"]), whole) and None in merged


# ---------------------------------------------------------------- classifiers


def test_quality_on_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = op1_quality(spark, sf_dir).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in found}
    assert kept[1] > 0.98 and kept[0] < 0.3


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.7
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth).astype(int) for a in (0.9, 0.8, 0.7, 0.85)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, table, prior = estimate(patterns, counts.astype(float))
    assert np.allclose(table[1, :, 1], [0.9, 0.8, 0.7, 0.85], atol=0.03) and abs(prior - 0.7) < 0.03


def test_toxicity_on_held_out_labels(spark, sf_dir):
    """English only: in the other languages many labels do not follow from any word."""
    large = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.1")
    docs = spark.read.parquet(f"{large}/documents.parquet")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    rated = rate_toxicity(docs, train_toxicity(docs, seen), carry=["doc_id", "lang"]).where("row.lang = 'en'")
    held = rated.select("row.doc_id", F.col("toxic").alias("said")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    held = held.select("toxic", "said").collect()
    assert np.mean([r["said"] for r in held if r["toxic"] == 1]) > 0.85
    assert np.mean([r["said"] for r in held if r["toxic"] == 0]) < 0.01


def test_languages_on_documents(spark, sf_dir):
    lang = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = op6_language_id(spark, sf_dir).join(lang, "doc_id").select("lang", "language", "accepted").collect()
    assert np.mean([r["lang"] == r["language"] and r["accepted"] for r in found]) > 0.99


def test_languages_on_pages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = train_languages(docs, docs["text"], docs["lang"], docs["doc_id"])
    evidence = page_evidence(pages["url"], pages["html"])
    found = identify_languages(pages, evidence, model, visible_text(pages["html"]), carry=["page_id", "html"])
    rows = found.select("language", F.regexp_extract("row.html", 'lang="([a-z]+)"', 1).alias("declared")).collect()
    assert len(rows) == pages.count()
    assert np.mean([r["language"] == r["declared"] for r in rows if r["declared"]]) > 0.9


def tongue(seed, words=40):
    """Texts of an invented language: its words share no run of letters with another's, but by chance."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)]
    while True:
        yield " ".join(rng.choice(vocabulary) for _ in range(words))


def test_more_languages_than_a_slice(spark):
    """Each label is a language, however many there are; undeclared rows are told by their text alone."""
    rows = []
    for k in range(70):
        texts = tongue(k)
        rows += [(f"l{k:02}", next(texts), f"l{k:02}") for _ in range(1 + (k < 64))] + [(None, next(texts), f"l{k:02}")]
    frame = spark.createDataFrame(rows, "lang string, text string, truth string")
    model = train_languages(frame, frame["text"], frame["lang"], frame["text"])
    evidence = {"declared": frame["lang"], "host": F.lit("h"), "suffix": F.lit("s")}
    found = identify_languages(frame, evidence, model, carry=["truth"]).select("row.truth", "language", "accepted").collect()
    assert len(found) == len(rows)
    assert [r for r in found if r["truth"] != r["language"] or not r["accepted"]] == []


def test_rare_languages_have_models(spark):
    """The sample is bounded for each label, so a small share of the rows is no reason to have no model."""
    large, rare = tongue("large"), {name: tongue(name) for name in ("rare1", "rare2", "rare3")}
    rows = [(i, "large", next(large), "large") for i in range(3000)]
    for name, texts in rare.items():
        rows += [(len(rows) + i, name if i < 4 else None, next(texts), name) for i in range(6)]
    frame = spark.createDataFrame(rows, "id long, lang string, text string, truth string")
    model = train_languages(frame, frame["text"], frame["lang"], frame["id"], sample=30)
    trained = {r["language"] for r in model["counts"].select("language").distinct().collect()}
    assert [model["names"][k] for k in sorted(trained)] == ["large", "rare1", "rare2", "rare3"]
    evidence = {"declared": frame["lang"], "host": F.lit("h"), "suffix": F.lit("s")}
    found = identify_languages(frame, evidence, model, carry=["truth"]).select("row.truth", "language", "accepted").collect()
    assert [r for r in found if r["truth"] != r["language"] or not r["accepted"]] == []


def test_classifiers_on_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (7, 0, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert classify_quality(docs).count() == docs.count()
    assert rate_toxicity(docs, train_toxicity(docs, labels)).where("severity IS NULL").count() == 0
    model = train_languages(docs, docs["text"], docs["lang"], docs["doc_id"])
    evidence = {"declared": docs["lang"], "host": docs["source"], "suffix": docs["key"]}
    found = identify_languages(docs, evidence, model)
    assert found.count() == docs.count()
    assert found.where("row.text IS NULL AND accepted").count() == 0
    assert classify_quality(none).count() == 0
    assert rate_toxicity(none, train_toxicity(none, labels)).count() == 0
    evidence = {"declared": none["lang"], "host": none["source"], "suffix": none["key"]}
    assert identify_languages(none, evidence, train_languages(none, none["text"], none["lang"], none["doc_id"])).count() == 0


def test_queries_return_every_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert op2_near_dedup(spark, sf_dir).select("doc_id").distinct().count() == n
    assert op8_toxicity(spark, sf_dir).count() == n


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark, docs, rows, sf_dir):
    import corpus_pipeline as pipeline

    frame = docs.drop("key", "row", "label").withColumn("n_chars", F.col("n_chars").cast("long"))
    benchmark = {name: f for name, f in pipeline.STAGES}
    lines = by_key(benchmark["line_dedup"](spark, frame, sf_dir).select("doc_id", "text").collect())
    assert lines == by_key((r[0], r[3]) for r in brute_lines([r[:2] for r in rows]))
    near = benchmark["near_dedup"](spark, frame, sf_dir)
    assert near.columns == frame.columns
    tests = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = benchmark["decontamination"](spark, frame, sf_dir).select("doc_id", "text").collect()
    assert len(clean) == sum(not r[2] for r in brute_leaks([r[:2] for r in rows], tests))
    out = pipeline.run(spark, sf_dir)
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"}
    assert out.count() > 0


# ---------------------------------------------------------------- whole rows against plain Python


def plain_mix(x):
    full = (1 << 64) - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & full
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & full
    return x ^ x >> 31


def plain_sketch(text):
    full, odd, known = (1 << 64) - 1, 0x9E3779B97F4A7C15, {}
    step = pow(odd, -1, 1 << 64)

    def word_hash(word):
        if word not in known:
            total = sum(plain_mix((b + 1) * odd & full) * pow(step, j, 1 << 64) for j, b in enumerate(word.encode()))
            known[word] = plain_mix(total & full)
        return known[word]

    hashes = [word_hash(w) for w in WORD.findall(lower(text))]
    size, found = min(5, len(hashes)), set()
    for at in range(len(hashes) - size + 1 if hashes else 0):
        value = hashes[at]
        for k in range(1, size):
            value = (value * 0xD1342543DE82EF95 + plain_mix((hashes[at + k] + k) & full)) & full
        found.add((plain_mix(value) ^ (odd if size < 5 else 0)) >> 16)
    return sorted(found)[:128]


def plain_resemblance(one, two):
    if not one or not two:
        return float(len(one) == len(two))
    both = sorted({*one, *two})[:128]
    return len({*one} & {*two} & {*both}) / len(both)


def brute_kept(rows, prints):
    """The row of each class of near-copies that stays."""
    classes = defaultdict(list)
    for k, least in brute_classes([(k, r[1]) for k, r in enumerate(rows)]):
        classes[least].append(k)
    best = [min(c, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, prints[rows[k][1] or ""])) for c in classes.values()]
    return by_key(rows[k] for k in best)


def prints_of(frame):
    """Spark's own hash of each text, which decides among rows with one id."""
    text = F.coalesce("text", F.lit(""))
    return {r[0]: r[1] for r in frame.select(text, F.xxhash64(text)).distinct().collect()}


def test_one_copy_stays_exactly(docs, rows):
    assert by_key(nearcopies.keep_one_copy(docs).collect()) == brute_kept(rows, prints_of(docs))


def test_fingerprints_in_all_columns(docs, rows):
    order = sorted((r[:2] for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        one, two, three = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        coded = [base64.b64encode(b"".join(x.to_bytes(6, "big") for x in s)).decode() for s in (one, two)]
        near = (plain_resemblance(one, two), plain_resemblance(one, three))
        expected.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *coded, *near))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert by_key(fingerprints.fingerprint_edits(docs).select(*columns).collect()) == by_key(expected)


def brute_mix(rows):
    """Rows with copy and shuffle_key, in their order; source is the fourth column."""
    sizes = Counter(r[3] for r in rows)
    out = []
    for r in rows:
        n = sizes[r[3]]
        rate = math.sqrt(n) / sum(math.sqrt(x) for x in sizes.values()) * len(rows) / n
        u = int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        copies, at_most = 0, math.exp(-rate)
        while at_most <= u:
            copies += 1
            at_most += math.exp(copies * math.log(rate) - rate - math.lgamma(copies + 1))
        out += [(*r, c, hashlib.md5(f"mix:{r[0]}:{c}".encode()).hexdigest()) for c in range(1, copies + 1)]
    return sorted(out, key=lambda r: (r[-1], r[-2]))


def test_pipeline_row_by_row(spark, tmp_path):
    import corpus_pipeline as pipeline

    line, one, two = "this line of more than forty letters is in MANY of the texts", tongue("one", 60), tongue("two", 60)
    texts = [(next(one), "one") for _ in range(20)] + [(next(two), "two") for _ in range(20)]
    texts += [(f"{next(one)}\n{line}", "one") for _ in range(6)]
    texts += [(texts[3][0], "one"), (texts[25][0] + " tail", "two"), (texts[25][0].upper(), "two")]
    texts += [("12 34 !!", "one"), ("", "two"), (None, "one")]
    leak = " ".join(texts[7][0].split()[20:32])
    rows = [(i, t, lang, f"s{i % 3 % 2}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, leak), (2, "words that are in none of the texts at all , not one")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Every text with letters is plainly of its language.
    kept = [r for r in rows if re.search("[a-z]", (r[1] or "").lower())]
    lined = {r[0]: r[3] for r in brute_lines([r[:2] for r in kept])}
    kept = [(r[0], lined[r[0]], r[2], r[3], len(lined[r[0]])) for r in kept]
    kept = brute_kept(kept, dict.fromkeys(lined.values(), 0))
    leaks = {r[0] for r in brute_leaks([r[:2] for r in kept], items) if r[2]}
    assert leaks and len(kept) < len(texts) - 5
    expected = brute_mix([r for r in kept if r[0] not in leaks])
    out = pipeline.run(spark, str(tmp_path)).select("doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key")
    assert [tuple(r) for r in out.collect()] == expected
