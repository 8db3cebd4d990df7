"""Token files, conversation repair and ranked search against plain versions."""

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from test_llm import awkward, lower
from tickloom.llm import conversations, lexical, tokenfiles
from tickloom.llm.conversations import audit_conversations, damaged, repair_conversations, repaired_digests
from tickloom.llm.lexical import rank_documents
from tickloom.llm.queries import TOKENIZER, op11_token_files, op12_conversation_repair
from tickloom.llm.tokenfiles import TextEncoder, checksums, read_token_files, read_token_range, write_token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, label string"


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


# ---------------------------------------------------------------- token files


@cache
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def plain_sum(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


ODD = list("ab 's.,\n\t\r\x0b\x0c\x1c\x85\xa0 　é中文。「12ſ١Ⅷ̈​﻿🙂_-") + ["<|endoftext|>", "'ll", "can't"]


def test_encoder_agrees_with_the_library(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(14))) for _ in range(3000)]
    texts += ["".join(rng.choices(list("abé.,! ") + ["wordword"], k=rng.randrange(60))) for _ in range(1000)]
    encoder = TextEncoder(TOKENIZER)
    assert all(encoder(t) == plain_ids(t) for t in texts)
    monkeypatch.setattr(tokenfiles, "LONG_PIECE", 3)
    monkeypatch.setattr(tokenfiles, "LONGEST", 2)
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 20)
    uncut = ["".join(rng.choices(list("ab'.,文中。，「1Ⅷ🙂_-éア가、！ ") + ["'ll"], k=12)) for _ in range(3000)]
    assert all(encoder(t) == plain_ids(t) for t in uncut)


def test_blocks_of_many_texts():
    rng = random.Random(4)
    texts = ["", None] + ["".join(rng.choices(ODD + ["word "] * 40, k=rng.randrange(90))) for _ in range(500)] + [None, "", "x"]
    for limit in (1 << 20, 300):
        for end in (None, 7):
            counts, ids = [], []
            for block in tokenfiles.blocks(pa.array(texts), limit):
                found = TextEncoder(TOKENIZER).block(block, end)
                counts += found[0].tolist()
                ids += found[1].tolist()
            expected = [plain_ids(t) + ([] if end is None else [end]) for t in texts]
            assert counts == [len(e) for e in expected]
            assert ids == [i for e in expected for i in e]


def test_pieces_under_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokenfiles, "mix", lambda x: x % np.uint64(3))
    text = "some words, that are not the same at all. And longer ones: internationalisation"
    assert TextEncoder(TOKENIZER)(text) == plain_ids(text)


def test_words_of_letters_skip_the_search_for_words(monkeypatch):
    searched, search = [], TextEncoder._encode_pieces
    monkeypatch.setattr(TextEncoder, "_encode_pieces", lambda self, pieces: searched.extend(pieces) or search(self, pieces))
    encoder = TextEncoder(TOKENIZER)
    texts = [f"prose{mark} prosé{mark} проза" for mark in ("", "***", "'s", "#", ".")]
    assert [encoder(t) for t in texts] == [plain_ids(t) for t in texts]
    # The word before a mark is the same piece as the word alone.
    assert sorted(searched) == ["#", "'s", "***", "."]
    assert len(encoder.known.hashes) == 3 + 4


def test_letters_and_marks_of_two_bytes(monkeypatch):
    rng = random.Random(5)
    signs = list("aZé×÷ÀÿĀſƻǀɏʰЀяѿ҂ґΩ;·'’_-1²  .*\n\x00") + ["'ll", " été", " word", "\u0301", "\ud7ff"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 12))) for _ in range(3000)]
    encoder = TextEncoder(TOKENIZER)
    assert all(encoder(t) == plain_ids(t) for t in texts)
    monkeypatch.setattr(tokenfiles, "_word_tokenizer", lambda path: None)  # a tokenizer whose model is not asked alone
    assert all(TextEncoder(TOKENIZER)(t) == plain_ids(t) for t in texts[:300])


def test_any_white_space_is_found():
    space = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u2064\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x2010)))
    none = "a\x0a\x0e\x1b\x20\x84\xa1\u1681\u180d\u1fff\u2010\u2027\u2030\u205e\u2065\u3001\ufefe\uff00🙂"
    texts = [x for s in space + none for x in (s, f"é{s}", f"{s}b")]
    (block,) = tokenfiles.blocks(pa.array(texts))
    _, spaced = TextEncoder(TOKENIZER)._odd(block, block.data.tobytes(), tokenfiles._KINDS[block.data])
    assert spaced.tolist() == [any(c in space for c in t) for t in texts]


def test_very_long_texts():
    text = "word  and\n" * 300_000
    assert TextEncoder(TOKENIZER)(text) == plain_ids(text)


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    write_token_files(docs, f"file://{tmp_path}/t", TOKENIZER, carry=["source", "row", "key"])
    back = read_token_files(spark, f"file://{tmp_path}/t").collect()
    assert sorted((str(r.key), r.n_tokens, r.ids, tuple(r.row)) for r in back) == sorted(
        (str(r[0]), len(plain_ids(r[1])) + 1, plain_ids(r[1]) + [0], (r[3], r[6], r[5])) for r in rows
    )
    # One stream in the order of ids, nulls first.
    in_order = sorted(back, key=lambda r: r.start)
    assert [r.start for r in in_order] == [0, *np.cumsum([r.n_tokens for r in in_order])[:-1].tolist()]
    assert [r.key for r in in_order] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    sums = checksums(read_token_files(spark, f"file://{tmp_path}/t")).collect()
    assert sorted(r.ids_crc32 for r in sums) == sorted(plain_sum(plain_ids(r[1]) + [0]) for r in rows)


def test_parts_of_the_stream(spark, sf_dir, tmp_path):
    path = f"file://{tmp_path}/t"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, TOKENIZER, end_id=None)
    whole = {r.key: r for r in read_token_files(spark, path).collect()}
    total = sum(r.n_tokens for r in whole.values())
    for first, last in ((0, 1), (5000, 5001), (1000, 90_000), (total - 1, total + 9), (0, total), (7, 7), (total, total + 5)):
        found = {r.key for r in read_token_range(spark, path, first, last).collect()}
        assert found == {k for k, r in whole.items() if r.start < last and r.start + r.n_tokens > first and first < last}
    some = read_token_files(spark, path, ids=False, low=10, high=20)
    assert some.columns == ["key", "start", "n_tokens"]
    assert {r.key for r in some.collect()} == set(range(10, 21))
    text = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,10)" in text and "ids" not in text.split("ReadSchema")[1].split("\n")[0]


def test_encodings_groups_and_page_index(spark, sf_dir, tmp_path):
    path = f"file://{tmp_path}/t"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    write_token_files(docs, path, TOKENIZER, row_group_bytes=300_000, page_bytes=20_000, page_rows=50)
    groups, pages = 0, False
    for name in glob.glob(f"{tmp_path}/t/rows/*.parquet"):
        about = pq.ParquetFile(name).metadata
        groups += about.num_row_groups
        for g in range(about.num_row_groups):
            columns = {about.row_group(g).column(c).path_in_schema: about.row_group(g).column(c) for c in range(about.num_columns)}
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert "DELTA_BINARY_PACKED" in columns["key"].encodings and "DELTA_BINARY_PACKED" in columns["first"].encodings
            assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings)
            assert ids.has_offset_index and columns["key"].has_column_index
            pages |= "RLE_DICTIONARY" in ids.encodings
    assert groups > 4 and pages


def test_token_files_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    write_token_files(none, f"file://{tmp_path}/t", TOKENIZER)
    assert read_token_files(spark, f"file://{tmp_path}/t").count() == 0
    assert read_token_range(spark, f"file://{tmp_path}/t", 0, 5).count() == 0


def test_token_query(spark, sf_dir):
    documents = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    start, expected = 0, []
    for r in documents:
        ids = plain_ids(r.text) + [0]
        expected.append((r.doc_id, start, len(ids), plain_sum(ids)))
        start += len(ids)
    assert sorted(map(tuple, op11_token_files(spark, sf_dir).collect())) == expected


# ---------------------------------------------------------------- conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def plain_audit(rows):
    """All of a conversation's columns from (turn, role, text) in order, by recursion over whole texts of edits."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts, faults, seen = Counter(), [], set()
    for _, role, text in rows:
        ended = text.rstrip(SPACE)
        fault = "blank" if not ended else "duplicate" if (role, text) in seen else "" if ended[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        counts[fault] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserts):
        """(cost, edits, repaired rows) of the rest, after a row with this initial."""
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 4:
            for role in ("user", "assistant"):
                if role[0] in legal[last]:
                    cost, edits, out = best(i, role[0], inserts + 1)
                    ways.append((cost + 2, "I" + edits, ((role, ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, edits, out = best(i + 1, last, 0)
            ways.append((cost + 3, "D" + edits, out))
            if faults[i] not in ("blank", "duplicate"):
                for letter, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if new[:1] and new[:1] in legal[last]:
                        cost, edits, out = best(i + 1, new[:1], 0)
                        ways.append((cost + price + (faults[i] == "truncated"), letter + edits, ((new, text), *out)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "", 0)
    assert GRAMMAR.fullmatch("".join(role[0] for role, _ in out))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), out


def shaken(seed, conversations_=400):
    rng = random.Random(seed)
    out = []
    for conv in range(conversations_):
        for turn in range(rng.randrange(9)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ursa"])
            text = rng.choice(["Yes.", "No!", "What", "and so on ", "", " \t", None, "End. \n", "why?\x0b", f"own {turn}."])
            out.append((conv if conv else None, rng.choice([turn, turn, turn, turn, None, 2 * turn]), role, text))
            if rng.random() < 0.1:
                out.append(out[-1])
    return out


TURNS = "conv_id long, turn long, role string, text string, conv string, place string"


def by_conversation(rows):
    shown = lambda v: " " if v is None else v
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, shown(role), shown(text)))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


@pytest.mark.parametrize("held", [1 << 18, 2])
def test_audits_and_repairs(monkeypatch, spark, held):
    monkeypatch.setattr(conversations, "HELD", held)
    rows = shaken(8)
    frame = spark.createDataFrame([(*r, "x", None) for r in rows], TURNS).repartition(4)
    expected = {c: plain_audit(r) for c, r in by_conversation(rows).items()}
    audits = audit_conversations(frame)
    assert {r.conv: tuple(r)[1:] for r in audits.collect()} == {c: e[0] for c, e in expected.items()}
    digests = {r.conv: r.repaired_sha256 for r in repaired_digests(frame, audits).collect()}
    text = {c: "\n".join(f"{r}:{t}" for r, t in e[1]) for c, e in expected.items()}
    assert digests == {c: hashlib.sha256(t.encode()).hexdigest() for c, t in text.items()}
    with_batches = repair_conversations(frame)
    found = {}
    for r in sorted(with_batches.collect(), key=lambda r: r.place):
        assert (r.row is None) == (r.edit == "I") and (r.row is None or r.row.place is None)
        found.setdefault(r.conv, []).append((r.role, r.text))
    assert found == {c: list(e[1]) for c, e in expected.items() if e[1]}


def test_states_fit_their_numbers():
    """All transitions that any conversation can reach are few."""
    known = conversations.Transitions()
    todo, seen = [conversations.START], {conversations.START}
    while todo:
        costs = todo.pop()
        for symbol in range(16):
            after = known.made[known.number(costs, symbol)][0]
            if after not in seen:
                seen.add(after)
                todo.append(after)
    assert len(known.made) < 1 << 16


def test_carried_over_batches(spark):
    """One conversation longer than many Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}." if t % 5 else "") for t in range(300)]
        frame = spark.createDataFrame([(*r, None, None) for r in rows], TURNS)
        (audit, _), out = plain_audit_long(rows), None
        found = audit_conversations(frame).collect()
        assert (found[0].cost, found[0].blank) == audit
        kept = repair_conversations(frame).collect()
        assert GRAMMAR.fullmatch("".join(r.role[0] for r in sorted(kept, key=lambda r: r.place)))
        assert sorted(r.place for r in kept) == list(range(len(kept)))
        assert found[0].audit.count("K") + found[0].audit.count("D") + found[0].audit.count("R") == 300
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_audit_long(rows):
    """Cost and blanks by a forward pass over four states."""
    cost = {"": 0}
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserts(cost):
        for _ in range(3):
            for last, c in list(cost.items()):
                for new in legal[last].replace("s", ""):
                    cost[new] = min(cost.get(new, 10**9), c + 2)
        return cost

    for _, _, role, text in rows:
        cost, after = inserts(cost), {}
        for last, c in cost.items():
            ways = [(last, 3)] + ([] if not text.strip() else [(r, 0 if r == role[0] else 2) for r in legal[last] if r != "s"])
            for new, price in ways:
                after[new] = min(after.get(new, 10**9), c + price)
        cost = after
    cost = inserts(cost)
    return (min(cost.get("", 10**9), cost.get("a", 10**9)), sum(not r[3].strip() for r in rows)), None


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], TURNS)
    assert audit_conversations(none).count() == repair_conversations(none).count() == repaired_digests(none).count() == 0


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def test_damage(spark):
    rows = shaken(5, 300)
    frame = spark.createDataFrame([(*r, None, None) for r in rows], TURNS)
    assert Counter(map(tuple, damaged(frame).collect())) == Counter(plain_damage(rows))


def test_repair_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = by_conversation(plain_damage(rows))
    expected = []
    for conv in {r[0] for r in rows}:
        audit, out = plain_audit(found.get(conv, []))
        text = "\n".join(f"{r}:{t}" for r, t in out)
        expected.append((conv, *audit, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, op12_conversation_repair(spark, sf_dir).collect())) == sorted(expected)


# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranks(rows, items, best=10):
    docs = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in docs:
            m = 25 + 75 * n * n_docs // n_terms
            score = 0
            for term in TERM.findall(lower(text or "")):
                if term in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (1_000_000_000 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        for rank, (score, null, i) in enumerate(sorted(found)[:best], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(out, key=repr)


def library(seed, documents=600):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(documents):
        topic = rng.randrange(250)
        texts.append(" ".join(names[min(int(rng.expovariate(0.05)), 299)] if rng.random() < 0.6 else names[topic + rng.randrange(40)] for _ in range(rng.randrange(1, 60))))
    texts += [texts[0]] * 40 + [texts[1].upper()] * 30
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (None, None), (9, "")]
    items = [(k, " ".join(rng.choices(names, k=rng.randrange(1, 25)))) for k in range(90)]
    return rows, items + [(5, texts[0]), (None, texts[1]), (7, None), (8, "?!"), (9, "nowhere"), (5, texts[0])]


@pytest.mark.parametrize("settings", [{}, {"seeds": 50}, {"seeds": 20, "pass_bytes": 2000, "best": 3}])
@pytest.mark.parametrize("batch", [10_000, 64])
def test_ranks(monkeypatch, spark, settings, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows, items = library(4)
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
        tests = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
        found = rank_documents(docs, tests, **settings)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == plain_ranks(rows, items, settings.get("best", 10))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranks_on_awkward_rows(spark, docs, rows):
    items = [("a", rows[6][1]), ("b", "IDIOT x9"), (None, "zeta"), ("c", None), ("é", "ünd é")]
    tests = spark.createDataFrame(items, "item_id string, text string")
    found = rank_documents(docs, tests).collect()
    assert sorted(map(tuple, found), key=repr) == plain_ranks([r[:2] for r in rows], items)


def test_ranks_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the of")], "item_id long, text string")
    assert rank_documents(docs, none).count() == 0
    assert rank_documents(spark.createDataFrame([], SCHEMA), some).count() == 0


def test_text_ids_and_long_texts(monkeypatch, spark):
    monkeypatch.setattr(lexical, "PIECE_BYTES", 64)
    rows, items = library(6, 80)
    rows = [(None if i is None else f"d{i}", t) for i, t in rows] + [("long", "w1 " * 900 + "x" * 700 + " w299")]
    state = lexical.item_terms([t for _, t in items])
    import pyarrow as pa

    totals, bounds, numbers, times = lexical.term_vectors(pa.array([t for _, t in rows]), state[0], lexical.marks_of(state[0]))
    assert totals.tolist() == [len(TERM.findall(lower(t or ""))) for _, t in rows]
    wanted = {t for _, text in items for t in TERM.findall(lower(text or ""))}
    for k, (_, text) in enumerate(rows):
        counts = Counter(t for t in TERM.findall(lower(text or "")) if t in wanted)
        assert sorted(times[bounds[k] : bounds[k + 1]].tolist()) == sorted(counts.values())
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = rank_documents(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted(map(tuple, found), key=repr)
    named = [(i if i is None else i, t) for i, t in rows]
    expected = plain_ranks_text(named, items)
    assert got == expected


def plain_ranks_text(rows, items):
    """Text ids are compared as text."""
    numbers = {i: k for k, i in enumerate(sorted({i for i, _ in rows if i is not None}))}
    names = {k: i for i, k in numbers.items()}
    found = plain_ranks([(None if i is None else numbers[i], t) for i, t in rows], items)
    return sorted(((a, b, None if c is None else names[c], d) for a, b, c, d in found), key=repr)


def test_whole_branches_are_left_out(monkeypatch):
    """Most pairs of documents and items are never scored, where items have few rare terms."""
    rows, _ = library(12, 4000)
    items = [(k, f"w{k * 3} w{k * 3 + 1} w1 w2") for k in range(96)]
    import pyarrow as pa

    known, terms = lexical.item_terms([t for _, t in items])
    totals, bounds, numbers, times = lexical.term_vectors(pa.array([t for _, t in rows]), known, lexical.marks_of(known))
    df = np.bincount(numbers, minlength=len(known))
    n = int((totals > 0).sum())
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df])
    values = lexical._values(totals, times, bounds, n, int(totals.sum()))
    tree = lexical.Items(terms, weights, 10)
    scored = 0
    leaf = lexical.Search._leaf

    def counted(self, node, chosen, *rest):
        nonlocal scored
        scored += len(chosen)
        leaf(self, node, chosen, *rest)

    monkeypatch.setattr(lexical.Search, "_leaf", counted)
    search = lexical.Search(tree, np.ones(len(terms), dtype=np.int64))
    search.block(lexical.Vectors(bounds, numbers, values), np.arange(len(rows)), pa.array(range(len(rows))))
    leaves = -(-len(rows) // lexical.DOC_LEVELS[0])
    assert 0 < scored < 0.4 * leaves * len(items)
