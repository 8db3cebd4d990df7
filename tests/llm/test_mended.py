"""Cases that earlier versions of the corpus operators did not hold."""

import inspect
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_llm import SCHEMA, awkward, by_key
from tickloom.llm import fingerprints, leaks, quality, tokens, toxicity
from tickloom.llm.blocks import blocks, hashed_cells, shingles, words
from tickloom.llm.fingerprints import fingerprint_documents, fingerprint_edits, merge_parts
from tickloom.llm.languages import EVIDENCE, SMOOTHING, document_evidence, identify_languages, likelihoods, page_evidence, slices, train
from tickloom.llm.frames import stored, stored_alone
from tickloom.llm.leaks import find_leaks
from tickloom.llm.mixing import mix_sources, mixed_documents
from tickloom.llm.nearcopies import keep_one_copy
from tickloom.llm.queries import language_of_pages, op2_near_dedup
from tickloom.llm.tokens import ForwardTrie, count_block


def pieces():
    return {"▁": -2.0, "a": -1.5, "b": -1.7, "ab": -2.5, "aba": -2.9, "é": -4.0, "babab": -3.1}


def test_long_pre_tokens_score_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 700):
        token = "".join(rng.choice(list("abcé文"), n))
        trie = ForwardTrie(pieces())
        assert trie._long(token) == trie.add(token)
    text = " ".join(["abab" * 9, "ab", "é" * 30, "ab", "abab" * 9])
    block = next(blocks(pa.array([text])))
    whole = count_block(block, ForwardTrie(pieces()))
    monkeypatch.setattr(tokens, "LONG", 3)
    monkeypatch.setattr(tokens, "MAX_NODES", 4)
    for one, two in zip(whole, count_block(block, ForwardTrie(pieces()))):
        assert np.array_equal(one, two)


def test_known_pre_tokens_are_not_walked_again(monkeypatch):
    trie = ForwardTrie(pieces())
    block = next(blocks(pa.array(["ab aba ab", "aba"])))
    first = count_block(block, trie)
    monkeypatch.setattr(trie, "add", None)
    for one, two in zip(first, count_block(block, trie)):
        assert np.array_equal(one, two)


SCRIPT = """
import resource
from tickloom.llm.tokens import ForwardTrie
text = "\u6587\u5b57" * 1_000_000
trie = ForwardTrie({"\u6587": -2.0, "\u5b57": -2.5, "\u6587\u5b57": -3.0})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
score, tokens = trie.add(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, len(trie.scores), score, tokens)
"""


def test_memory_of_a_very_long_pre_token():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    made = subprocess.run([sys.executable, "-c", SCRIPT], cwd=root, capture_output=True, text=True, check=True, timeout=200)
    megabytes, nodes, score, count = made.stdout.split()
    assert int(megabytes) < 50 and nodes == "1"
    assert float(score) == -3_000_000 and count == "1000000"


def test_mixed_documents_with_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(k, "t", "s", 7, "x") for k in range(50)], "doc_id long, text string, source string, copy int, Shuffle_Key string")
    found = mixed_documents(docs, total=100.0)
    assert found.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    assert found.select("copy").distinct().count() > 1
    same = mix_sources(docs, total=100.0).select("row.doc_id", F.col("copy"))
    assert sorted(map(tuple, found.select("doc_id", "copy").collect())) == sorted(map(tuple, same.collect()))


@pytest.mark.parametrize("sampled", [1, 200])
def test_edits_do_not_depend_on_the_sample(monkeypatch, spark, sampled):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    expected = by_key(fingerprint_edits(docs).collect())
    monkeypatch.setattr(fingerprints, "SAMPLED", sampled)
    assert by_key(fingerprint_edits(docs.repartition(3)).collect()) == expected


def test_ends_of_ranges_are_bounded_however_many_rows(spark):
    """The keys that reach the driver, and the rows that a last task gets, follow the ranges and not the rows."""
    for rows in (2_000, 200_000):
        given = spark.range(rows).select((F.col("id") * 7).alias("key"))
        tops = fingerprints._tops(given, 8)
        assert len(tops) == 8 and tops[-1] == (rows - 1) * 7
        sizes = np.diff(np.concatenate([[-1], tops])) / 7
        assert sizes.max() < 1.5 * rows / 8
        read = fingerprints.sampled(given, F.col("key"), rows, 8 * fingerprints.SAMPLED).count()
        assert read < 8 * fingerprints.SAMPLED * 1.4
    hot = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).cast("long").alias("key"))
    assert fingerprints._tops(hot, 8)[-1] == 99_998


def test_parts_under_any_key_name(spark):
    parts = spark.createDataFrame([(k % 2, f"some words of text number {k} and more words") for k in range(20)], "sketch int, text string")
    prints = fingerprint_documents(parts, carry=["sketch"]).select("row.sketch", "fingerprint")
    plain = prints.select(F.col("sketch").alias("name"), "fingerprint")
    for key in ("sketch", "own", "salt", "__salt"):
        found = merge_parts(plain.withColumnRenamed("name", key), key)
        assert found.columns == [key, "fingerprint"]
        assert by_key(found.collect()) == by_key(merge_parts(plain, "name").collect())


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert keep_one_copy(none).count() == 0
    assert fingerprint_documents(none).count() == 0
    assert fingerprint_edits(none).count() == 0
    assert merge_parts(fingerprint_documents(none, carry=["lang"]).select("row.lang", "fingerprint"), "lang").count() == 0


def test_clean_documents_take_no_further_pass(monkeypatch, spark):
    """They are written once, whatever the number of passes; the result is that of one pass."""
    text = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(k, text(k)) for k in range(60)] + [(60, text(3, 12) + " " + text(900)), (61, None), (62, "short item here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(k, text(k, 14)) for k in range(0, 9)] + [(20, "Short item"), (21, None)], "item_id long, text string")
    whole = by_key(find_leaks(docs, items).collect())
    made = []
    store = leaks.stored

    def seen(frame, name):
        out = store(frame, name)
        made.append((out.count(), out.where("text IS NOT NULL").count()))
        return out

    monkeypatch.setattr(leaks, "stored", seen)
    assert by_key(find_leaks(docs, items, pass_bytes=200).collect()) == whole
    assert len(made) > 3 and made[0][0] == len(rows)
    assert all(n <= 12 for n, _ in made[1:]) and made[0][1] <= 12


def plain_posterior(rows, names, means, grams):
    """(language, posterior) of rows (declared, host, suffix) from their texts' mean log-likelihoods."""
    best = [None if not g else int(np.argmax(m)) for m, g in zip(means, grams)]
    total = np.zeros(len(names))
    for b in best:
        if b is not None:
            total[b] += 1
    share = (total + 1) / (total.sum() + len(names))

    def counts(of):
        table = {}
        for row, b in zip(rows, best):
            if b is not None:
                table.setdefault(of(row), np.zeros(len(names)))[b] += 1
        return table

    def smooth(n, above):
        return (n + SMOOTHING * above) / (n.sum() + SMOOTHING)

    suffixes = {s: smooth(n, share) for s, n in counts(lambda r: r[2]).items()}
    hosts = {h: smooth(n, suffixes[h[1]]) for h, n in counts(lambda r: r[1:]).items()}
    declared = {d: (n + SMOOTHING * n.sum() / max(total.sum(), 1)) / (total + SMOOTHING) for d, n in counts(lambda r: r[0]).items()}
    out = []
    for row, mean, g in zip(rows, means, grams):
        logs = mean * min(g, EVIDENCE) + np.log(hosts.get(row[1:], share)) + np.log(declared.get(row[0], np.ones(len(names))))
        at = int(np.argmax(logs))
        out.append((names[at], 1 / np.exp(logs - logs[at]).sum()))
    return out


def test_fused_posterior(spark):
    tongues = {"aa": "banu tero mila", "bb": "grosk vaft hulm", "cc": "eau oise ieux"}
    rng = np.random.default_rng(4)
    rows = []
    for k in range(90):
        own = list(tongues)[k % 3]
        words = " ".join(rng.choice(tongues[own].split() + ["der", "the"], int(rng.integers(0, 9))))
        declared = [own, None, "bb", "zz"][int(rng.integers(4))]
        rows.append((k, words or None, declared, f"h{int(rng.integers(5))}.{own if k % 5 else 'xx'}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    model = train(docs.where("lang <> 'zz'"), docs["text"], docs["lang"], docs["doc_id"])
    evidence = {"declared": docs["lang"], "host": docs["host"], "suffix": F.regexp_extract(docs["host"], r"([^.]*)$", 1)}
    found = sorted(identify_languages(docs, evidence, model, carry=["doc_id"]).collect(), key=lambda r: r.row.doc_id)
    block = next(blocks(pa.array([r[1] for r in rows])))
    means, grams = likelihoods(block, slices(model))
    given = [(r[2] or "", r[3], r[3].split(".")[1]) for r in rows]
    expected = plain_posterior(given, model["names"], means, grams)
    assert [r.language for r in found] == [e[0] for e in expected]
    assert np.allclose([r.posterior for r in found], [e[1] for e in expected], rtol=1e-9)


def test_rare_languages_reject_what_they_do_not_know(spark):
    rows = [(k, "banu tero mila sola rend " * 6, "aa") for k in range(3)] + [(9, "grosk vaft hulm knarf blig " * 6, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s1"))
    model = train(docs, docs["text"], docs["lang"], docs["doc_id"])
    other = spark.createDataFrame(
        [(1, "tero mila banu rend"), (2, "vaft grosk blig hulm"), (3, "xqzjy wvyxk qqzxj jkzqw yyxwv"), (4, "зима лето осень весна")],
        "doc_id long, text string",
    ).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s1")})
    found = {r.row.doc_id: (r.language, r.accepted) for r in identify_languages(other, document_evidence(other), model).collect()}
    assert found[1] == ("aa", True) and found[2] == ("bb", True)
    assert not found[3][1] and not found[4][1]


def test_pages_are_named_by_the_language_they_declare(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = language_of_pages(spark, sf_dir)
    assert found.count() == pages.count()
    said = pages.select("page_id", page_evidence(pages["url"], pages["html"])["declared"].alias("declared"))
    both = found.join(said, "page_id").where("accepted AND declared IS NOT NULL")
    assert both.count() > 50
    assert both.where("language = declared").count() > 0.9 * both.count()


def slope(loss, x, at, step=1e-5):
    up, down = x.copy(), x.copy()
    up[at] += step
    down[at] -= step
    return (loss(up) - loss(down)) / (2 * step)


def caught(monkeypatch, module, run):
    """The gradient that a fit in `module` is given, and what it holds."""
    held = []

    def keep(gradient, start, **options):
        held.append((gradient, start))
        return start

    monkeypatch.setattr(module, "fit", keep)
    run()
    gradient, start = held[0]
    return gradient, start, inspect.getclosurevars(gradient).nonlocals


def test_toxicity_gradient(monkeypatch, spark, sf_dir):
    """The gradient is the slope of the cumulative-link model's penalised loss, written out plainly."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    gradient, start, held = caught(monkeypatch, toxicity, lambda: toxicity.train(docs, labels, sample=150))
    of, column, value, grade, used = (held[n] for n in ("of", "column", "value", "grade", "used"))

    def loss(x):
        w, free = x[: len(used)], x[len(used) :]
        cuts = [-np.inf, free[0]]
        for f in free[1:]:
            cuts.append(cuts[-1] + np.exp(f))
        cuts.append(np.inf)
        total = 0.0
        z = np.zeros(len(grade))
        for o, c, v in zip(of, column, value):
            z[o] += w[c] * v
        for k, g in enumerate(grade):
            total -= np.log(1 / (1 + np.exp(z[k] - cuts[g + 1])) - (0 if g == 0 else 1 / (1 + np.exp(z[k] - cuts[g]))))
        return total / len(grade) + toxicity.PENALTY / 2 * (w * w).sum()

    assert len(set(grade.tolist())) > 2
    rng = np.random.default_rng(1)
    x = start + rng.normal(0, 0.02, len(start))
    made = gradient(x)
    for at in [*rng.integers(0, len(used), 5), len(used), len(x) - 1]:
        assert np.isclose(made[at], slope(loss, x, at), rtol=1e-3, atol=1e-8)


def test_quality_gradient(monkeypatch, spark, sf_dir):
    """The scorer's gradient is the slope of the logistic loss against the posteriors."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    gradient, start, held = caught(monkeypatch, quality, lambda: quality.train(docs, sample=60))
    of, feature, value, label = (held[n] for n in ("of", "feature", "value", "label"))

    def loss(w):
        z = np.full(len(label), w[-1])
        np.add.at(z, of, w[feature] * value)
        return -(label * -np.log1p(np.exp(-z)) + (1 - label) * -np.log1p(np.exp(z))).mean() + 0.5e-5 * (w * w).sum()

    rng = np.random.default_rng(1)
    w = start + rng.normal(0, 0.1, len(start))
    made = gradient(w)
    for at in [*rng.choice(feature, 5), len(w) - 1]:
        assert np.isclose(made[at], slope(loss, w, at), rtol=1e-3, atol=1e-8)


def test_stages_leave_only_their_outputs(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(root))
    kept = stored_alone(spark, lambda: stored(stored(spark.range(5).toDF("x"), "one"), "two").where("x > 1"), "out")
    assert [p.split("-")[1] for p in set(os.listdir(root)) - before] == ["out"]
    assert kept.count() == 3


def links_of(texts, queries, similarity=0.8, size=5):
    """(query, row) of every two rows whose shingles are that similar, by comparing the queries with all rows."""
    parts, base = [], 0
    for block in blocks(pa.array(texts)):
        text, cells = hashed_cells(shingles(words(block), size))
        parts.append((text + base, cells))
        base += len(block.offsets) - 1
    text, cells = (np.concatenate(x) for x in zip(*parts))
    weight = np.bincount(text, minlength=len(texts))
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    order = np.argsort(cells, kind="stable")
    by_cell, owner = cells[order], text[order]
    for q in queries:
        mine = cells[bounds[q] : bounds[q + 1]]
        low, high = np.searchsorted(by_cell, mine, "left"), np.searchsorted(by_cell, mine, "right")
        at = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
        shared = np.bincount(owner[at], minlength=len(texts))
        for d in np.flatnonzero((shared > 0) & (shared >= similarity * (weight + weight[q] - shared) - 1e-9)):
            if d != q:
                yield q, int(d)


def test_recall_on_documents(spark, sf_dir):
    """Rows whose id is divisible by 50 against all rows: linked texts are in one class."""
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    classes = {r.doc_id: r.class_id for r in op2_near_dedup(spark, sf_dir).collect()}
    queries = [k for k, r in enumerate(rows) if r.doc_id % 50 == 0]
    links = list(links_of([r.text or "" for r in rows], queries))
    assert links
    found = [classes[rows[q].doc_id] == classes[rows[d].doc_id] for q, d in links]
    assert np.mean(found) >= 0.99
