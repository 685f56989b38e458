"""Exact copies, token alignment and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offerscope.llm import alignment, catalog, exact_dedup, spelling
from offerscope.llm.common import Scratch
from offerscope.llm.encode import tokenizer_path

from .conftest import SF

A, B = tokenizer_path(catalog.BYTE_BPE), tokenizer_path(catalog.PIECE_BPE)


# ---------------------------------------------------------------- exact copies

def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def marked(rows):
    groups = defaultdict(list)
    for place, (doc_id, text) in enumerate(rows):
        groups[plain(text)].append((doc_id is not None, doc_id or 0, place, doc_id))
    out = []
    for place, (doc_id, text) in enumerate(rows):
        first = min(groups[plain(text)])
        out.append((doc_id, first[3], len(groups[plain(text)]), first[2] == place, hashlib.sha256(plain(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("capacity, bits", [(4096, 64), (8, 64), (1, 5), (1000, 1)])
def test_exact_dedup_equals_brute_force(docs, capacity, bits):
    """Few key bits make most keys collide, a small capacity makes buckets split."""
    want = marked([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert as_rows(exact_dedup.mark(docs, capacity, bits)) == want


def test_exact_dedup_equals_sql(spark):
    import duckdb
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = catalog.op11_exact_dedup(spark, SF)
    rel = duck.sql(catalog.ORACLES["op11_exact_dedup"])
    assert found.columns == rel.columns and as_rows(found) == sorted(rel.fetchall(), key=repr)


def test_exact_dedup_odd_rows(odd_docs, no_docs):
    got = as_rows(exact_dedup.mark(odd_docs.coalesce(1)))
    want = marked([(r["doc_id"], r["text"]) for r in odd_docs.coalesce(1).collect()])
    # Equal rows of one id: one of them stays, whichever came first.
    assert got == want and sum(r[3] for r in got) == len({r[4] for r in got})
    stay = exact_dedup.dedup(odd_docs)
    assert stay.columns == odd_docs.columns and stay.count() == len({r[4] for r in got})
    assert exact_dedup.mark(no_docs).count() == 0 and exact_dedup.dedup(no_docs).count() == 0


def test_directory_covers_every_key_once(spark):
    scratch = Scratch(spark, "test-directory")
    keys = [random.Random(k).getrandbits(64) - (1 << 63) for k in range(500)] + [(5 << 60) + (k << 45) for k in range(300)]
    entries = spark.createDataFrame([(k,) for k in keys], "key long")
    slots, depth = exact_dedup.directory(entries, len(keys), scratch, capacity=32)
    found = {r["slot"]: (r["bucket"], r["depth"]) for r in slots.collect()}
    # 300 keys share their first 10 bits: only their bucket is split so far.
    sizes = Counter(found[(k % (1 << 64)) >> (64 - depth)] for k in keys)
    assert max(sizes.values()) <= 32 and len({d for _, d in found.values()}) > 1


# ---------------------------------------------------------------- alignment

def tokens_of(tool, text):
    """(ends, ids) of both tokenizers, each from its library alone."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = tool.a.encode(" " + text, add_special_tokens=False).ids, tool.b.encode(text)
    if b"".join(tool.bytes_a[k] for k in a) != whole or b"".join(tool.bytes_b[k] for k in b) != whole:
        return None
    return (np.cumsum([len(tool.bytes_a[k]) for k in a]), a), (np.cumsum([len(tool.bytes_b[k]) for k in b]), b)


def plain_alignment(tool, text):
    found = tokens_of(tool, text)
    if found is None:
        return 0, 0, 0, 0, "", {}
    (end_a, a), (end_b, b) = found
    groups, links, i, j = [], Counter(), 0, 0
    for cut in sorted(set(end_a.tolist()) & set(end_b.tolist())):
        x, y = i, j
        while i < len(a) and end_a[i] <= cut:
            i += 1
        while j < len(b) and end_b[j] <= cut:
            j += 1
        groups.append((a[x:i], b[y:j]))
        links.update((p, q) for p in a[x:i] for q in b[y:j])
    text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return len(a), len(b), len(groups), sum(links.values()), text, links


ODD_TEXTS = ["a", " ", "  a", "a ", "a  b", "x\ny", "x\n\ny", "\nx", "x\n", "x \n y", "a\tb", "don't", "<|endoftext|> <s> </s> <0x41>", "x▁y", "▁",
             "日本語 текст 🙂 x", "é ﬁ Å é", " x", "x y", "12 345 6,789.01", "a" * 3000, "ab" * 2000, "\x00 \x01", "🙂" * 50,
             "one\ntwo\nthree four", "end.\nNext line", "x　y z", "a\r\nb", "﻿x", "word​word", "x\x85y", "q\x1cr"]


@pytest.fixture(scope="module")
def tool():
    return alignment.Aligner(A, B)


def check(tool, texts):
    for text, got in zip(texts, tool.align(texts)):
        want = plain_alignment(tool, text)
        links = {(int(k) // tool.n_b, int(k) % tool.n_b): int(t) for k, t in zip(got[5], got[6])}
        assert (*got[:5], links) == (*want[:5], dict(want[5])), repr(text)


def test_alignment_equals_brute_force(tool, docs):
    check(tool, ODD_TEXTS + [None, ""])
    check(tool, [r["text"] for r in docs.collect()])
    check(tool, ODD_TEXTS[::-1])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abctheingrs .,'-12\n\t éß日🙂▁ <>|s_")), max_size=60))
def test_alignment_of_any_text(text):
    check(alignment.aligner(A, B), [text])


@given(st.lists(st.integers(0, 60), unique=True), st.lists(st.integers(0, 60), unique=True))
def test_shared_cuts_are_all_common_ends(x, y):
    a, b = np.asarray(sorted({*x, 61})), np.asarray(sorted({*y, 61}))
    got = alignment.shared_cuts(a, b, np.asarray([0]), np.asarray([len(a)]))
    assert a[got].tolist() == sorted(set(x) & set(y))


def test_wide_leaf_by_distinct_ids(tool, monkeypatch):
    monkeypatch.setattr(alignment, "_DENSE", 1)
    check(alignment.Aligner(A, B), ODD_TEXTS)


@pytest.mark.parametrize("head", [0, 200, 1 << 17])
def test_alignment_counts_of_table(spark, docs, tool, head):
    rows = [(r["doc_id"], plain_alignment(tool, r["text"])) for r in docs.collect()]
    count = Counter(p for _, x in rows for p in x[5])
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    want = {d: (*x[:4], sum(t for p, t in x[5].items() if count[p] == top[p[0]]), sum(t * count[p] for p, t in x[5].items()),
                hashlib.sha256(x[4].encode()).hexdigest() if x[4] else "", x[4]) for d, x in rows}
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs, A, B, keep_groups=True, head=head).collect()}
    assert got == want


def test_alignment_odd_rows(odd_docs, no_docs):
    got = alignment.align(odd_docs, A, B).collect()
    assert len(got) == odd_docs.count()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in got if r["doc_id"] in (3, 4, 7))
    assert alignment.align(no_docs, A, B).count() == 0


# ---------------------------------------------------------------- spelling

def counted(rows, every=199):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            out[run[:at] + run[at + 1:] if h % every == 0 else run] += 1
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def grouped(n, factor=5):
    near = {w: [t for t in n if one_edit(w, t)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda t: (-n[t], t), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, count, every", [(6, 5, 199), (3, 2, 7), (1, 1, 199)])
def test_spelling_equals_brute_force(docs, least, count, every):
    rows = [(r["doc_id"], r["text"]) for r in docs.limit({1: 15, 3: 60, 6: 200}[least]).collect()]
    frame = docs.where(docs["doc_id"].isin([d for d, _ in rows]))
    n = {w: k for w, k in counted(rows, every).items() if len(w) >= least and k >= count}
    assert as_rows(spelling.group(frame, every, least, count)) == grouped(n)


def test_spelling_chains_and_long_words(spark):
    long = "x" * 3000
    n = {"abcdef": 3000, "abcdeg": 600, "abcdgg": 100, "abcgg": 20, "bcgg": 4, "aabcdef": 5, "aaabcdef": 1, "abcdefg": 600, "zabcdef": 3, "fedcba": 7,
         long: 10, long + "y": 2, long[1:]: 50, "y" + long: 1, "": 0, "ÿabcdef": 3, "aaaa": 9, "aaa": 45, "aa": 225}
    n = {w: k for w, k in n.items() if w}
    frame = spark.createDataFrame([(1, " ".join([w] * k)) for w, k in n.items()], "doc_id long, text string")
    counts = spelling.words(frame, every=1 << 40)
    assert {r["word"]: r["n"] for r in counts.collect()} == n
    assert as_rows(spelling.group(frame, 1 << 40, 1, 1)) == grouped(n)


@settings(max_examples=5, deadline=None)
@given(st.sets(st.text(alphabet="ab", min_size=1, max_size=7), min_size=1, max_size=60))
def test_neighbours_of_dense_words(spark, words):
    known = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r["word"], r["near"]) for r in spelling.neighbours(known, Scratch(spark, "test-spelling")).collect()}
    assert got == {(w, t) for w in words for t in words if one_edit(w, t)}


def test_spelling_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    n = {w: k for w, k in counted(rows).items() if len(w) >= 4 and k >= 2}
    assert as_rows(spelling.group(odd_docs, least_letters=4, least_count=2)) == grouped(n)
    assert spelling.group(no_docs).count() == 0
