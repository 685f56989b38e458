"""Token files, packing and BPE against the tokenizers library."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offerscope.llm import encode, language, packing, speculative_bpe, token_files
from offerscope.llm.common import Scratch
from offerscope.llm.encode import WordEncoder, tokenizer_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def library(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path(name))


def ids_of(name, texts):
    return [e.ids for e in library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["", " ", "  ", "a  b", "a   b ", "\n\n a", " \n x", "it's we'll", "aaaa" * 200, "<|endoftext|>", "x<|endoftext|> y", "tab\tand\x0bvt", "\u3000wide\u3000", "e\u0301 \u0301", "🙂 日本", "1234 56.7", "\x1c\x1d"]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_word_encoder_equals_library(name):
    rng = random.Random(1)
    parts = ["a", "b c", " ", "\n", "  ", "'s", "é", "<|endoftext|>", "12", ".", "日", "\t", "the "]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000)]
    got = WordEncoder(tokenizer_path(name)).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == ids_of(name, texts)


BPE = speculative_bpe.SpeculativeBPE(tokenizer_path(BYTE))
LIBRARY = library(BYTE)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_speculative_bpe_equals_library(text):
    ids, decimal = BPE.encode([text])[0]
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert decimal == ",".join(map(str, want)).encode()
    assert BPE.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


def test_speculation_fails_sometimes_and_is_mended(docs):
    words = sorted({(" " + w).encode() for r in docs.select("text").limit(20).collect() for w in r[0].split()})
    found, failed = BPE.words(words)
    assert found == [BPE.exact(w) for w in words]
    assert 0 < failed < len(words)


def test_bpe_of_table(spark, odd_docs, docs):
    for frame in (odd_docs, docs):
        got = speculative_bpe.encode_decode(frame, tokenizer_path(BYTE)).collect()
        texts = [r["text"] or "" for r in frame.select("doc_id", "text").collect()]
        want = sorted((hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), t) for i, t in zip(ids_of(BYTE, texts), texts))
        assert sorted((r["ids_sha256"], r["decoded"]) for r in got) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 31), st.integers(0, 300), st.integers(0, 200))
def test_pack_round_trip(bits, n, first):
    ids = np.random.default_rng(n).integers(0, 1 << bits, n + first).astype(np.uint32)
    assert token_files.unpack(token_files.pack(ids, bits), bits, n, first).tolist() == ids[first:].tolist()


def test_pack_rejects_wide_ids():
    with pytest.raises(ValueError):
        token_files.pack(np.asarray([8]), 3)


def test_token_files(spark, docs, odd_docs, no_docs):
    for frame in (docs, odd_docs):
        files = token_files.write_token_files(frame, Scratch(spark, "test").path("files"), tokenizer_path(BYTE), 0, 50257)
        got = token_files.read_digests(spark, files).orderBy("start").collect()
        rows = sorted(frame.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
        at = 0
        assert len(got) == len(rows)
        for r, (doc_id, text), ids in zip(got, rows, ids_of(BYTE, [t for _, t in rows])):
            raw = np.asarray(ids + [0], "<u4")
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(raw), zlib.crc32(raw.tobytes()))
            at += len(raw)
        file = token_files.TokenFile(files[0][0])
        assert file.bits == 16
        assert file.document(1).tolist() == ids_of(BYTE, [rows[1][1]])[0] + [0]
        assert file.ids(5, 7).tolist() == file.ids(0, 20)[5:12].tolist()
    files = token_files.write_token_files(no_docs, Scratch(spark, "test").path("files"), tokenizer_path(BYTE), 0, 50257)
    assert files == [] and token_files.read_digests(spark, files).count() == 0


def check_pieces(rows, ids_by_doc, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_by_doc)
    for doc, pieces in by_doc.items():
        raw, at = np.asarray(ids_by_doc[doc], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(raw)
            assert r["ids_crc32"] == zlib.crc32(raw[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(raw)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / total


def test_packing(spark, docs, odd_docs, no_docs):
    rows = packing.pack(docs, tokenizer_path(WORD), 1).collect()
    texts = docs.select("doc_id", "text").collect()
    share = check_pieces(rows, {r[0]: i + [1] for r, i in zip(texts, ids_of(WORD, [r[1] for r in texts]))}, 2048)
    assert share < 0.03
    rows = packing.pack(odd_docs, tokenizer_path(WORD), 1, window=64).collect()
    assert sum(r["length"] for r in rows) == sum(len(i) + 1 for i in ids_of(WORD, [r[1] for r in odd_docs.select("doc_id", "text").collect()]))
    assert packing.pack(no_docs, tokenizer_path(WORD), 1).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9), st.integers(3, 12))
def test_best_cuts_are_best(gaps, window):
    ends = np.cumsum(gaps)
    places, cost = packing.cut_points(ends, ends[:-1:2], np.asarray([], np.int64), window)
    cuts = packing.best_cuts(places, cost, window)
    price = dict(zip(places.tolist(), cost.tolist()))

    def total(c):
        return sum(window - (b - a) + price[b] for a, b in zip(c, c[1:]))

    def every(at):
        if at == places[-1]:
            yield [at]
        for b in places:
            if at < b <= at + window:
                yield from ([at, *rest] for rest in every(b))

    assert all(0 < b - a <= window for a, b in zip(cuts, cuts[1:]))
    if len(places) <= 12:
        assert total(cuts) == min(map(total, every(0)))


def test_small_plans_give_the_same_documents(docs):
    ids = [np.asarray(i, np.uint32) for i in ids_of(WORD, [r[0] for r in docs.select("text").limit(40).collect()])]
    p = packing.Packer(128, np.asarray([269]), np.asarray([267]), 0, plan=500)
    rows = [r for k, i in enumerate(ids) for r in p.add(k, i)] + list(p.finish())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_pieces([dict(zip(names, r)) for r in rows], {k: i.tolist() for k, i in enumerate(ids) if len(i)}, 128)


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_new_words_reach_the_library_together(name, monkeypatch):
    from offerscope.llm import encode
    monkeypatch.setattr(encode, "CACHE_WORDS", 40)
    monkeypatch.setattr(encode, "ROW_WORDS", 16)
    monkeypatch.setattr(encode, "SPLIT_CHARS", 200)
    rng = random.Random(3)
    words = ["it's", "don't", "é.", "ÉTÉ", "naïve,", "a\tb", "x y", "日本", "İ", "12,5", "$$$", "é", "'s", "***!", "Straße", "A1b2"] + [f"w{k}ord" for k in range(200)]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    enc, calls = WordEncoder(tokenizer_path(name)), []
    row = enc._row
    enc._row = lambda some, *a: calls.append(len(some)) or row(some, *a)
    for at in range(0, 400, 50):
        got = enc.encode(texts[at:at + 50])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == ids_of(name, texts[at:at + 50])
        # Two generations, of which the younger takes at most one slice's words beyond its bound.
        assert len(enc.old) + len(enc.cache) <= 2 * (40 + 200)
    assert max(calls) == 16


def test_words_that_differ_by_case_or_mark_reach_the_library_once():
    words = ["Straße", "été", "Ⱥbc", "İx", "\u01c5a", "2²", "x'", "'s", "it's", "<|ENDOFTEXT|>", "a-b", "Σας", "...", "?", "日本", "word"]
    texts = [f"{form}{mark}" for w in words for form in (w, w.upper(), w.lower(), w.title()) for mark in ("", *".,;:!?", "?!", "'", ".a")]
    enc, seen = WordEncoder(tokenizer_path(WORD)), []
    row = enc._row
    enc._row = lambda some, *a: seen.extend(some) or row(some, *a)
    for some in (texts, [" ".join(texts)], texts[::-1]):
        assert [np.frombuffer(g, "<u4").tolist() for g in enc.encode(some)] == ids_of(WORD, some)
    assert len(seen) == len(set(seen))
    # One form of the 28 of a case and a mark.
    assert [w for w in seen if w.lower() in {"word" + m for m in ("", *".,;:!?")}] == ["word"]


def test_rows_of_other_bytes_go_to_the_library_word_by_word():
    enc = WordEncoder(tokenizer_path(WORD))
    enc.n_bytes = enc.n_bytes + 1
    assert enc._row(["one", "two"], " ", "") is None
    texts = ["One two, three. FOUR", "été l'été"]
    assert [np.frombuffer(g, "<u4").tolist() for g in enc.encode(texts)] == ids_of(WORD, texts)


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_whole_widths_give_the_same_bytes(monkeypatch, bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 5000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        raw = token_files.pack(ids, bits)
        parts = [token_files.unpack(raw, bits, max(0, n - k), k) for k in (0, 5, 70)]
        with monkeypatch.context() as m:
            m.setattr(token_files, "WHOLE", {})
            assert token_files.pack(ids, bits) == raw
            for k, part in zip((0, 5, 70), parts):
                assert part.tolist() == token_files.unpack(raw, bits, max(0, n - k), k).tolist() == ids[k:].tolist()


def test_gaps_are_told_as_by_the_patterns():
    line, rng = re.compile(r"\n(?:\s|\Z)|(?:\A|\s)\n"), np.random.default_rng(3)
    chars = ["a", "b", "\u00e9", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\ufeff"]
    for few in (5, len(chars)):
        for _ in range(20_000):
            text = "".join(chars[k] for k in rng.integers(0, few, rng.integers(0, 7)))
            assert encode._odd_space(text) == bool(encode._ODD_SPACE.search(text)), text
            if "\n" in text:
                assert encode._odd_line(text.split("\n")) == bool(line.search(text)), text


def test_language_tasks_free_the_word_caches():
    for stage in (language._document_frequency, language._count_rows, lambda batches: language._predicted(batches, None)):
        encode.encoder(tokenizer_path("word_bpe_49k.json"))
        list(stage([]))
        assert not encode._ENCODERS
