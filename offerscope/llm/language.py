"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of its hashed character n-grams (one to
three characters of lower-cased letters; anything else is one gap).  Each
language has several centroids, from spherical k-means on a bounded sample of
labelled rows; a text gets the language of the centroid of highest cosine and
is rejected if that cosine is under the centroid's own floor.  Floors follow
from the cosines of the centroid's rows and from labelled rows that the
centroids have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import encode
from .common import python_stages

BITS = 14
DIMENSIONS = 1 << BITS
CENTROIDS = 3           # a language
SAMPLE = 300            # expected labelled rows a language for the centroids
SLICE = 1 << 20         # characters hashed at once
# A centroid's floor is the LOW quantile of the cosines of its own rows, times a
# share that goes by the text's number of distinct n-grams (texts of few have
# low cosines): MARGIN times the greatest by which all rows of the sample stay
# that have as many, each scored by centroids of the other FOLDS - 1 folds.
LOW, MARGIN, FOLDS = 0.05, 0.85, 4
LEAST_OWN = 5           # rows of a centroid, unless the language has no other
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (texts x DIMENSIONS) and whether a text has a letter.
    Long input is hashed in slices, all of it; the n-grams at a slice's border
    (one a million characters) may count twice."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    has = np.zeros(len(texts), bool)
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    group: list[tuple[int, np.ndarray]] = []
    size = 0
    for k, c in enumerate(codes):
        # Slices of one text overlap by two characters, so that no n-gram is lost.
        for at in range(0, max(1, len(c)), SLICE):
            group.append((k, c[max(0, at - 2):at + SLICE]))
            size += len(group[-1][1])
            if size >= SLICE or len(group) >= 64:
                _count(group, out, has)
                group, size = [], 0
    if group:
        _count(group, out, has)
    return out, has


def _count(group: list[tuple[int, np.ndarray]], out: np.ndarray, has: np.ndarray) -> None:
    gap = np.zeros(2, np.uint32)
    flat = np.concatenate([x for _, c in group for x in (c, gap)])
    local = np.repeat(np.arange(len(group)), [len(c) + 2 for _, c in group])
    letter = _is_letter()[flat]
    rows = np.fromiter((k for k, _ in group), np.int64, len(group))
    has[rows[np.unique(local[letter])]] = True
    # One gap between words: drop gaps that follow gaps.
    keep = letter | np.concatenate([[True], letter[:-1]]) | np.concatenate([[True], local[1:] != local[:-1]])
    flat, letter, local = np.where(letter, flat, 0)[keep].astype(np.uint64), letter[keep], local[keep]
    # A group's rows follow each other; slices of one text share a row.
    first, last = int(rows[0]), int(rows[-1]) + 1
    place = (rows - first)[local] * DIMENSIONS
    cells = []
    for n in (1, 2, 3):
        h, fine = flat[:len(flat) - n + 1].copy(), letter[:len(flat) - n + 1].copy()
        same = local[n - 1:] == local[:len(local) - n + 1]
        for i in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + flat[i:len(flat) - n + 1 + i]
            fine |= letter[i:len(flat) - n + 1 + i]
        h = (h + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        cell = (h >> np.uint64(64 - BITS)).astype(np.int64)
        cells.append((place[:len(cell)] + cell)[fine & same])
    table = np.bincount(np.concatenate(cells), minlength=(last - first) * DIMENSIONS)
    out[first:last] += table.reshape(-1, DIMENSIONS)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    # In place: a batch is some 33 MB, and both workers of an executor hold one.
    x = np.log1p(tf)
    x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0)


def richness(tf: np.ndarray) -> np.ndarray:
    """Class of the number of distinct n-grams, by powers of two."""
    return np.log2(np.maximum((tf > 0).sum(1), 1)).astype(np.int64)


@dataclass
class LanguageModel:
    idf: np.ndarray             # DIMENSIONS
    languages: list[str]        # of each centroid
    centroids: np.ndarray       # centroids x DIMENSIONS
    floors: np.ndarray          # of each centroid
    shares: np.ndarray          # of its floor, by richness() of the text

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid, cosine and floor of each text."""
        cos = vectors(tf, self.idf) @ self.centroids.T
        best = cos.argmax(1)
        return best, np.clip(cos[np.arange(len(tf)), best], 0, 1), self.floors[best] * self.shares[richness(tf)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected); ``und``, 0 and rejected if the text is
        null or has no letter, or if nothing was learned."""
        tf, has = counts([t or "" for t in texts])
        if not len(self.centroids):
            return [(UNKNOWN, 0.0, True)] * len(texts)
        return [(self.languages[b], float(s), bool(s < floor)) if h else (UNKNOWN, 0.0, True)
                for b, s, floor, h in zip(*self.nearest(tf), has)]


def k_means(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; starts are spread out among the half of the rows
    nearest to the mean, so the result is fixed and no outlier is a start."""
    near = x @ x.mean(0)
    dense = x[np.argsort(-near, kind="stable")[:max(k, (len(x) + 1) // 2)]]
    chosen = [0]
    while len(chosen) < min(k, len(dense)):
        chosen.append(int((dense @ dense[chosen].T).max(1).argmin()))
    centres = dense[chosen]
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(1)
        new = np.stack([x[owner == j].mean(0) if (owner == j).any() else centres[j] for j in range(len(centres))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def _document_frequency(batches):
    import pyarrow as pa
    encode.release()
    total = np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        tf, _ = counts(batch.column(0).to_pylist())
        total += (tf > 0).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS)), pa.array(total)], names=["dim", "df"])


def _packed(tf: np.ndarray) -> bytes:
    at = np.flatnonzero(tf)
    return at.astype(np.float32).tobytes() + tf[at].astype(np.float32).tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMENSIONS), np.float32)
    for k, row in enumerate(rows):
        at, n = np.frombuffer(row, np.float32).reshape(2, -1)
        out[k, at.astype(np.int64)] = n
    return out


def _count_rows(batches):
    import pyarrow as pa
    encode.release()
    for batch in batches:
        tf, has = counts(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(t) for t in tf], pa.binary()),
                                          pa.array(has)], names=["lang", "tf", "has"])


def train(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Model from rows of (text, lang); rows with a null are left out.

    Document frequencies come from all rows.  Centroids come from a bounded
    sample: about ``sample`` rows a language, those whose text's hash falls
    under the language's share, with their whole texts."""
    python_stages(labelled.sparkSession)
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit({}, np.ones(DIMENSIONS, np.float32))
    df = np.zeros(DIMENSIONS)
    for r in rows.select("text").mapInArrow(_document_frequency, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect():
        df[r["dim"]] = r["df"]
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30))
    found: dict[str, set[bytes]] = {}
    for r in drawn.select("lang", "text").mapInArrow(_count_rows, "lang string, tf binary, has boolean").where("has").select("lang", "tf").toLocalIterator():
        # A hash that many copies share could exceed the expected size.
        if len(found.setdefault(r["lang"], set())) < 4 * sample:
            found[r["lang"]].add(bytes(r["tf"]))
    return fit({lang: sorted(rows) for lang, rows in found.items()}, idf)


def _centroids(found: dict[str, list[bytes]], idf: np.ndarray, fold: int | None = None) -> LanguageModel:
    """Centroids and their floors at share 1, without the rows of ``fold``."""
    languages, centroids, floors = [], [], []
    for lang in sorted(found):
        x = vectors(_unpacked([r for k, r in enumerate(found[lang]) if k % FOLDS != fold] or found[lang]), idf)
        centres = k_means(x, CENTROIDS)
        n = np.bincount((x @ centres.T).argmax(1), minlength=len(centres))
        centres = centres[n >= min(LEAST_OWN, n.max())]
        cos = x @ centres.T
        owner = cos.argmax(1)
        for j, c in enumerate(centres):
            own = cos[owner == j, j]
            languages.append(lang)
            centroids.append(c)
            floors.append(float(np.quantile(own if len(own) else cos.max(1), LOW)))
    return LanguageModel(idf, languages, np.asarray(centroids, np.float32).reshape(-1, DIMENSIONS), np.asarray(floors), np.ones(BITS + 1))


def fit(found: dict[str, list[bytes]], idf: np.ndarray) -> LanguageModel:
    """Model from the packed counts of each language's rows.  Every row is
    scored once by centroids that have not seen it; the shares let all stay."""
    shares = np.full(BITS + 1, MARGIN)
    for fold in range(FOLDS):
        unseen = _centroids(found, idf, fold)
        for rows in found.values():
            if len(rows) > fold:
                tf = _unpacked(rows[fold::FOLDS])
                _, score, floor = unseen.nearest(tf)
                np.minimum.at(shares, richness(tf), MARGIN * score / np.maximum(floor, 1e-9))
    model = _centroids(found, idf)
    # Not over the share of richer texts.
    model.shares = np.minimum.accumulate(shares[::-1])[::-1]
    return model


def _predicted(batches, model: LanguageModel):
    import pyarrow as pa
    encode.release()
    for batch in batches:
        said = model.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()),
             pa.array([s[2] for s in said], pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (with a ``text`` column) plus lang_pred, score and rejected.

    Only the text is an input of the prediction.  Null, empty and letterless
    texts are ``und``; rows are independent, so repeated rows agree; own
    columns named lang_pred, score or rejected are replaced."""
    python_stages(docs.sparkSession)
    kept = docs.drop("lang_pred", "score", "rejected")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)    # a fixed size: idf and a few centroids
    return kept.mapInArrow(lambda it: _predicted(it, shared.value), schema + ", lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
