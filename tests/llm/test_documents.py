"""Near duplicates, line dedup, PII, language ID and fingerprints."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from offerscope.llm import catalog, common, fingerprint, language, line_dedup, ngram_jaccard, pii
from offerscope.llm.shingles import shingle_sets

from .conftest import PASSAGE, SCHEMA, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i:i + 5]) for i in range(len(w) - 4)))


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return sorted((d, len(x), find(d)) for d, x in sets)


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    # Chains of edits about the threshold, and a cluster around one text.
    base = ("lorem ipsum " + PASSAGE + " " + " ".join(f"w{i}" for i in range(60))).split()
    extra = []
    for k in range(60):
        words = list(base)
        for j in range(k % 7):
            words[(k * 13 + j * 17) % len(words)] = f"edit{k}x{j}"
        extra.append((10_000 + k, " ".join(words)))
    for k in range(30):
        extra.append((20_000 + k, " ".join(base[:30 + 3 * k])))
    rows += extra
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in ngram_jaccard.near_duplicates(frame).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) < len(rows) - 60


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(odd_docs).collect()}
    n = len(shingles(PASSAGE))
    assert {(1, n, 1), (2, n, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (13, 1, 6), (None, n, None)} <= got
    assert ngram_jaccard.near_duplicates(no_docs).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAB é\t\n\x0b\x1c日", max_size=40), min_size=1, max_size=5))
def test_shingle_sets(texts):
    found = shingle_sets(texts)
    assert [len(s) for s in found] == [len(shingles(t)) for t in texts]
    for x, s in zip(texts, found):
        for y, t in zip(texts, found):
            assert len(np.intersect1d(s, t)) == len(shingles(x) & shingles(y))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 300), st.integers(0, 300), st.integers(0, 300))
def test_bitmap_bound_never_loses_a_link(common, left, right):
    pool = np.random.default_rng(common).integers(0, 1 << 63, common + left + right).astype(np.uint64)
    x, y = np.unique(pool[:common + left]), np.unique(np.concatenate([pool[:common], pool[common + left:]]))
    both = len(np.intersect1d(x, y))
    if 100 * both >= 75 * (len(x) + len(y) - both):
        assert ngram_jaccard.may_link(ngram_jaccard.parity_bits(x), len(x), ngram_jaccard.parity_bits(y), len(y))


def brute_lines(rows, min_words):
    """Deleted (document, place) pairs by comparing all runs."""
    lines = [(d, p, x, len(WORD.findall(x))) for d, t in rows for p, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    runs = []
    for i, (d, _, _, _) in enumerate(lines):
        words = 0
        for j in range(i, len(lines)):
            if lines[j][0] != d:
                break
            words += lines[j][3]
            if words >= min_words:
                runs.append((i, j + 1, tuple(x[2] for x in lines[i:j + 1])))
    first = {}
    gone = set()
    for a, b, run in runs:
        if first.setdefault(run, a) < a:
            gone |= {lines[k][:2] for k in range(a, b)}
    return gone


@pytest.mark.parametrize("min_words", [1, 2, 4, 10])
def test_line_dedup_equals_brute_force(spark, min_words):
    rng = np.random.default_rng(5)
    pool = ["a", "b b", "c c c", "d d d d d", "", "  ", "one two three four five six seven eight nine ten eleven"]
    rows = [(d, "\n".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 9)))) for d in range(60)] + [(60, None), (61, ""), (62, "a\n" * 40)]
    got = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words).collect()}
    gone = brute_lines(rows, min_words)
    for d, t in rows:
        want = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone)
        assert got[d]["text"] == want
        assert got[d]["n_deleted"] == sum(1 for x, _ in gone if x == d)


def brute_copies(rows):
    """Longest run from each worded line that begins earlier as well: its
    document, place among the worded lines, lines and words."""
    docs = [[x for x in t.split("\n") if WORD.search(x)] for _, t in rows]
    starts = [(d, i) for d, lines in enumerate(docs) for i in range(len(lines))]
    out = {}
    for at, (d, i) in enumerate(starts):
        most = 0
        for e, j in starts[:at]:
            n = 0
            while i + n < len(docs[d]) and j + n < len(docs[e]) and docs[d][i + n] == docs[e][j + n]:
                n += 1
            most = max(most, n)
        if most:
            out[d, i] = most, sum(len(WORD.findall(x)) for x in docs[d][i:i + most])
    return out


@pytest.mark.parametrize("hot", [3, 1024])
def test_repeated_runs_are_followed_to_their_end(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = np.random.default_rng(8)
    pool = ["a", "b b", "c c c"]
    texts = [[pool[k] for k in rng.integers(0, len(pool), rng.integers(1, 12))] for _ in range(30)]
    texts += [[f"line {k}" for k in range(45)]] * 2 + [[f"line {k}" for k in range(7, 44)], ["a"] * 21]
    rows = [(d, "\n".join(t)) for d, t in enumerate(texts)]
    lines = spark.createDataFrame([(d, d, i, len(x.split()), hash(x), len(x)) for d, t in enumerate(texts) for i, x in enumerate(t)],
                                  "doc_id long, _row long, idx int, words long, h1 long, h2 long")
    scratch = common.Scratch(spark, "runs")
    copies = line_dedup.later_copies(scratch, scratch.write(lines, "lines"))
    want = brute_copies(rows)
    assert {(r["_row"], r["idx"]): (r["len"], r["words"]) for r in copies.collect()} == want
    ends = {(r["_row"], r["idx"]): r["end"] for r in line_dedup.maximal_runs(copies).collect()}
    assert ends == {(d, i): i + n for (d, i), (n, _) in want.items() if want.get((d, i - 1), (0,))[0] != n + 1}
    assert ends[31, 0] == 45 and ends[32, 0] == 37


def test_line_dedup_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.sql(catalog.ORACLES["op3_line_dedup"]).fetchall())
    got = sorted(tuple(r) for r in catalog.op3_line_dedup(spark, SF).select("doc_id", "n_lines", "n_deleted", "text").collect())
    assert got == want and sum(r[2] for r in got)


def test_line_dedup_odd_rows(odd_docs, no_docs):
    out = line_dedup.dedup(odd_docs)
    assert out.count() == odd_docs.count()
    rows = out.where("doc_id IS NULL OR doc_id IN (1, 2, 3)").select("doc_id", "text", "n_deleted").collect()
    # The null id comes first, so it keeps the passage.
    assert sorted((r[0] or 0, r[1], r[2]) for r in rows if r[0] != 3) == [(0, PASSAGE, 0), (1, "", 1), (2, "", 1), (2, "", 1)]
    assert line_dedup.dedup(no_docs).count() == 0


def test_line_dedup_keeps_own_columns_of_any_name(spark):
    rows = [(1, "a b\nc d", 5, "x", 7), (2, "a b\ne f", 6, "y", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _row long, gone string, _gone long")
    got = sorted(tuple(r) for r in line_dedup.dedup(frame).collect())
    assert got == [(1, "a b\nc d", 5, "x", 7, 2, 0), (2, "e f", 6, "y", 8, 2, 1)]


def test_hot_lines_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 3)      # more than a third of all windows
    rows = [(d, f"the same line\nown line {d}\n" + ("twice here\ntwice there" if d < 2 else "")) for d in range(30)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = brute_lines(rows, line_dedup.MIN_WORDS)
    assert got == {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows}


def test_line_dedup_keeps_row_ids_when_the_scan_is_cut_anew(spark, tmp_path):
    rows = [(d, f"own line of document {d} with more than ten words in it here\n" + (PASSAGE if d % 3 == 0 else f"tail {d}")) for d in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").write.parquet(path := str(tmp_path / "documents"))
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in sizes:
            spark.conf.set(k, "1")
        out = line_dedup.dedup(spark.read.parquet(path))
        before = spark.read.parquet(path).rdd.getNumPartitions()
        for k in sizes:
            spark.conf.set(k, "1g")
        assert spark.read.parquet(path).rdd.getNumPartitions() != before
        got = {r["doc_id"]: r["text"] for r in out.collect()}
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)
    gone = brute_lines(rows, line_dedup.MIN_WORDS)
    assert got == {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute_base(t):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", "b.c", ".", "1", "23", "255", "256", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "4111111111111111", "\n", "é", "٣"]), max_size=25))
def test_base_spans_equal_patterns(parts):
    assert pii.base_spans("".join(parts)) == brute_base("".join(parts))


@pytest.fixture(scope="module")
def weights():
    return pii.train(pii.labelled_regions())


def test_semi_markov_field_on_held_out_texts(weights):
    right = found = wanted = 0
    for text, spans in pii.labelled_regions(200, seed=99):
        r = pii.Region(text, 0, len(text))
        got = {(r.tokens[i][0], r.tokens[j - 1][1], k) for i, j, k in pii.viterbi(len(r.tokens), r.lattice(), weights)}
        right, found, wanted = right + len(got & set(spans)), found + len(got), wanted + len(spans)
    assert right / found > 0.95 and right / wanted > 0.95


def test_viterbi_is_best(weights):
    text = "call (415) 555-2671 or 10.0.0.1 or 4111.1111.1111.1111 now"
    region = pii.Region(text, 0, len(text))
    lattice, n = region.lattice(), len(region.tokens)

    def best(at):
        if at == n:
            return 0.0
        return max([best(at + 1)] + [sum(weights.get(x, 0.0) for x in f) + best(j) for i, j, _, f in lattice if i == at])

    score = {(i, j, k): sum(weights.get(x, 0.0) for x in f) for i, j, k, f in lattice}
    assert sum(score[s] for s in pii.viterbi(n, lattice, weights)) == pytest.approx(best(0))


def test_pii_of_tables(odd_docs, no_docs, docs, weights):
    rows = {r["doc_id"]: r for r in pii.detect(odd_docs, weights).where("doc_id > 2").collect()}
    assert rows[11]["spans"] == "email:5:13" and rows[11]["redacted"] == "mail [EMAIL] now" and rows[3]["redacted"] is None
    assert pii.detect(no_docs, weights).count() == 0
    for r in pii.detect(docs, weights).collect():
        base = brute_base(r["text"])
        assert r["base"] == ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert set(r["base"].split(",")) <= set(r["spans"].split(","))
        for s, e, _ in base:
            assert r["text"][s:e] not in r["redacted"]


def test_pii_query_counts_base_spans(spark, tmp_path):
    texts = ["write j.doe (at) mail (dot) com or a.b@c.de", "call (415) 555-2671 or +1 (415) 555-2671, ip 10.0.0.1", "card 4111.1111.1111.1111 or 4111 1111 1111 1111", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in catalog.op2_pii(spark, str(tmp_path)).collect()}
    for d, t in enumerate(texts):
        base = brute_base(t or "")
        assert [rows[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert rows[d]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert rows[d]["n_spans"] == len([s for s in rows[d]["spans"].split(",") if s])
    # The field adds spans here, which the counts of the kinds leave out.
    assert sum(r["n_spans"] - sum(r[f"n_{k}"] for k in pii.KINDS) for r in rows.values()) >= 3


def test_language_held_out(spark, docs, odd_docs, no_docs):
    model = language.train(language.training_rows(docs))
    said = language.identify(docs.select("doc_id", "text", "lang"), model).collect()
    held = [r for r in said if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert sum(r["rejected"] for r in said) <= 0.01 * len(said)
    rows = {r["doc_id"]: r for r in language.identify(odd_docs, model).collect()}
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[12]["lang_pred"] == "und" and rows[3]["score"] == 0 and rows[12]["rejected"]
    assert rows[14]["rejected"] and "spans" in language.identify(odd_docs, model).columns
    nothing = language.train(language.training_rows(no_docs))
    assert language.identify(no_docs, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("left_out", [None, "de", "es", "fr"])
def test_language_rejects_unlearned_texts(left_out):
    rows = duckdb.sql("SELECT doc_id, text, lang FROM read_parquet('/root/testdata/sf0.01/documents.parquet') WHERE text IS NOT NULL AND lang IS NOT NULL ORDER BY doc_id").fetchall()
    tf, has = language.counts([r[1] for r in rows])
    idf = (np.log((1 + len(rows)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    held = np.array([zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows])
    known = np.array([r[2] != left_out for r in rows])
    found = {}
    for k in np.flatnonzero(has & known & ~held):
        if len(found.setdefault(rows[k][2], set())) < language.SAMPLE:
            found[rows[k][2]].add(language._packed(tf[k]))
    model = language.fit({lang: sorted(x) for lang, x in found.items()}, idf)
    rejected = np.array([x[2] for x in model.predict([r[1] for r in rows])])
    assert rejected[held & known & has].mean() <= 0.01
    assert not (~known).any() or rejected[~known].mean() >= 0.9
    rng = np.random.default_rng(11)

    def gibberish(first, n_letters, words):
        return " ".join("".join(map(chr, rng.integers(first, first + n_letters, rng.integers(2, 9)))) for _ in range(words))

    texts = [gibberish(first, n, words) for first, n in ((0x61, 26), (0x4E00, 8000), (0x430, 32)) for words in (50, 500, 5000) for _ in range(3)]
    assert all(x[2] for x in model.predict(texts))


def test_slices_of_long_texts_count_all(monkeypatch):
    text = "the quick brown fox " * 500
    whole, _ = language.counts([text])
    monkeypatch.setattr(language, "SLICE", 1000)
    parts, _ = language.counts([text])
    assert (parts >= whole).all() and parts.sum() - whole.sum() <= 10 * 6


def test_counts_equal_brute_force_in_one_table_a_group(monkeypatch):
    def brute(text):
        row, mask = np.zeros(language.DIMENSIONS), (1 << 64) - 1
        chars = re.sub(r"\0+", "\0", "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0")
        for n in (1, 2, 3):
            for at in range(len(chars) - n + 1):
                part = chars[at:at + n]
                if part.strip("\0"):
                    h = 0
                    for c in part:
                        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
                    row[((h + n) * 0xD6E8FEB86659FD93 & mask) >> 64 - language.BITS] += 1
        return row

    rng = random.Random(5)
    texts = ["", "a", " ", "İ 日本", "12", *["".join(rng.choice("abéÉ .\n1日") for _ in range(rng.randrange(60))) for _ in range(150)]]
    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or bincount(*a, **k))
    tf, has = language.counts(texts)
    assert len(calls) == -(-len(texts) // 64)
    assert tf.dtype == np.float32 and (tf == np.stack([brute(t) for t in texts])).all()
    assert has.tolist() == [any(map(str.isalpha, t)) for t in texts]


def brute_levels(raw):
    out = []
    for i in range(len(raw) - fingerprint.WINDOW + 1):
        counts = np.bincount(np.frombuffer(raw[i:i + fingerprint.WINDOW], np.uint8))
        p = counts[counts > 0] / fingerprint.WINDOW
        out.append(-(p * np.log2(p)).sum() / np.log2(fingerprint.WINDOW) * (fingerprint.LEVELS - 1))
    return np.asarray(out)


def test_entropy_levels_equal_brute_force():
    raw = b"".join(bytes([k % 7, k % 31, k * k % 251]) for k in range(300)) + b"a" * 80 + b"the end of it all, and more"
    flat, starts, windows = fingerprint.lay_out([raw])
    levels = fingerprint.entropy_levels(flat)[:windows[0]]
    assert np.abs(levels - brute_levels(raw)).max() <= 1.0


def test_fingerprints_of_table(spark, docs, odd_docs, no_docs):
    rank = fingerprint.rarity(docs)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_pairs(docs.repartition(6), rank, buckets=7).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), reverse=True)
    assert len(got) == len(rows)
    alone = dict(zip([d for d, _ in rows], fingerprint.digests([t.encode() for _, t in rows], rank)))
    edited, following = [], []
    for k, (d, t) in enumerate(rows):
        nd, nt = rows[(k + 1) % len(rows)]
        cut = len(t) // 2
        e = (t[:len(t) - cut] + nt[:cut]).encode()
        r = got[d]
        assert r["edited_sha256"] == hashlib.sha256(e).hexdigest() and r["n_chars"] == len(t)
        assert r["fingerprint"] == alone[d].hex() == fingerprint.digests([t.encode()], rank)[0].hex()
        assert r["near_next"] == pytest.approx(fingerprint.likeness(alone[d], alone[nd]))
        edited.append(r["near_edited"])
        following.append(r["near_next"])
    assert np.median(edited) > 0.3 and np.median(following) < 0.05
    odd = fingerprint.fingerprint_pairs(odd_docs, rank, buckets=3).collect()
    assert len(odd) == odd_docs.count()
    assert len({r["fingerprint"] for r in odd if r["doc_id"] in (1, 2)}) == 1
    assert fingerprint.fingerprint_pairs(no_docs, fingerprint.rarity(no_docs)).count() == 0
    one = spark.createDataFrame([(1, "a single text that is long enough for some windows")], "doc_id long, text string")
    assert fingerprint.fingerprint_pairs(one, rank).first()["near_next"] == 1.0


def test_schema_of_queries():
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in catalog.QUERIES}
    assert SCHEMA.fieldNames()[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
