"""Spelling variants by a relational trie frontier.

The words form a trie whose unary paths are one edge; its edges are a
distributed table (node, first letter, label, child, the letters that leave the
child).  States (word, position, node, edits) are joined with it level by
level: a state without an edit follows its own letters, or takes the one edit;
a state with one edit follows exact labels only.  States at a word's end with
one edit are neighbours.

Two tries are walked at once, of the words and of their reversals, and the edit
is only taken in the word's second half: of two words that differ by one edit,
what they share at the front or at the back reaches the middle.  So words that
differ in their first letters (half as many as the shortest word has) never
meet in a trie: it is a forest with one root for each such beginning, and few
labels leave a node so deep.  The number of levels is that of the most
branchings on one path, not the longest word's length.

The forest is cut from the sorted words, in ranges: each task keeps the path to
its current word and writes an edge when it leaves it.  A path that crosses a
border is written by both tasks, each with its own words' branchings; every
word's path is whole in its own task, which is all that the walk needs.

A node is known by a 64-bit hash of its letters; pairs found are compared
again, so equal hashes cost time, not correctness."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, python_stages, text_or_empty

EVERY = 199          # a run whose checksum it divides loses a letter
LEAST_LETTERS = 6
LEAST_COUNT = 5
FACTOR = 5           # a form is this many times as frequent
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_END = "$"           # among the letters that leave a node: a word ends there
EDGES = 1 << 14      # edges of one batch


def _lower() -> Column:
    """A-Z lower-cased.  Where no other capital letter can occur Spark's
    ``lower`` does the same in a fraction of ``translate``'s time."""
    text = text_or_empty()
    return F.when(text.rlike("[À-Þ]|[^\\x00-ÿ]"), F.translate(text, _CAPITALS, _CAPITALS.lower())).otherwise(F.lower(text))


def words(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word, n) of all runs of letters in ``docs`` (doc_id, text; others are
    not read), A-Z lower-cased.  Null text has none, a null id counts as ''."""
    runs = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("id"),
                       F.explode(F.regexp_extract_all(_lower(), F.lit("([a-zÀ-ÿ]+)"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat("id", "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    return (runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def node_id(side: int, letters: str) -> int:
    import xxhash
    h = xxhash.xxh3_64_intdigest(f"{side}{letters}")
    return h - (1 << 64) if h >> 63 else h


def _words(batches, begin: int) -> Iterator:
    """Each word as both tries read it, with its root and its last node."""
    import pyarrow as pa
    for batch in batches:
        n = batch.column(1).to_pylist()
        for side in (0, 1):
            texts = [t[::-1] if side else t for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"side": pa.array([side] * len(texts), pa.int32()), "w": texts, "n": n,
                                              "root": pa.array([node_id(side, t[:begin]) for t in texts], pa.int64()),
                                              "last": pa.array([node_id(side, t) for t in texts], pa.int64())})


def _shared(a: str, b: str) -> int:
    """How many first letters ``a`` and ``b`` share."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def forest(words, begin: int) -> Iterator[tuple]:
    """Edges (node, c, label, child, depth, next) of the words, which come
    sorted by (side, word).  Held is the path to the last one only."""
    side, prev, path = None, "", []       # path: [depth, letters that leave, node id], from the root on

    def leave(depth: int) -> Iterator[tuple]:
        while path[-1][0] > depth:
            below, letters, child = path.pop()
            if path[-1][0] < depth:
                path.append([depth, "", node_id(side, prev[:depth])])
            above, _, node = path[-1]
            label = prev[above:below]
            if label[0] not in path[-1][1]:
                path[-1][1] += label[0]
            yield node, label[0], label, child, above, letters

    for s, w in words:
        same = _shared(prev, w) if s == side else -1
        if same < begin:
            if path:
                yield from leave(begin)
            side, path = s, [[begin, "", node_id(s, w[:begin])]]
        else:
            yield from leave(same)
        if len(w) > path[-1][0]:
            path.append([len(w), _END, node_id(s, w)])
        else:
            path[-1][1] += _END
        prev = w
    if path:
        yield from leave(begin)


def _edges(batches, begin: int) -> Iterator:
    import pyarrow as pa
    schema = pa.schema([("from", pa.int64()), ("c", pa.string()), ("label", pa.string()), ("child", pa.int64()), ("depth", pa.int32()), ("next", pa.string())])
    rows = []
    for edge in forest(((s, w) for b in batches for s, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), begin):
        rows.append(edge)
        if len(rows) == EDGES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _goes_on(rest: Column, after: Column) -> Column:
    """Whether the edge's child has a way on with what ``rest`` has after its
    first ``after`` letters, or is a word's end if that is nothing."""
    letter = F.substr(rest, after + 1, F.lit(1))
    return F.contains("next", F.when(letter == "", F.lit(_END)).otherwise(letter))


def _move(on: Column, made: int, when: Column) -> Column:
    """``on`` letters further with ``made`` edits, or null."""
    return F.when(when, F.struct(on.cast("int").alias("on"), F.lit(made).alias("made")))


def _next(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The frontier one level on."""
    edges = edges.withColumnRenamed("depth", "above")
    ahead = states.drop("depth").withColumns({"rest": F.expr("substring(w, pos + 1)"), "may": F.expr("edits = 0 AND pos >= floor(char_length(w) / 2)")})
    # A letter too many is left out where the state stands; of a run of equal letters, the last.
    fewer = (ahead.where("may AND char_length(rest) > 1 AND substring(rest, 1, 1) <> substring(rest, 2, 1)")
             .withColumns({"pos": F.col("pos") + 1, "rest": F.expr("substring(rest, 2)"), "edits": F.lit(1), "may": F.lit(False)}))
    rest, label = F.col("rest"), F.col("label")
    size, left = F.char_length(label), F.char_length(rest)
    here = F.col("node") == F.col("from")

    # Along the state's own next letter; an edit lies past it, inside the label.
    walking = ahead.unionByName(fewer).where("rest <> ''").withColumn("letter", F.substring("rest", 1, 1))
    own = walking.join(edges, here & (F.col("letter") == F.col("c")))
    exact = F.startswith(rest, label)
    inside = (F.col("edits") == 0) & (size > 1) & ~exact & (F.col("pos") + size >= F.floor(F.char_length("w") / 2))

    def edited(length: Column) -> Column:
        return _move(length, 1, inside & (left >= length) & (F.levenshtein(label, F.substr(rest, F.lit(1), length), 1) == 1) & _goes_on(rest, length))

    own_moves = F.array(_move(size, 0, exact & ((F.col("edits") == 0) | _goes_on(rest, size))), edited(size), edited(size - 1), edited(size + 1))

    # Along another letter: it replaces the state's next one or is put before it.
    others = here & (F.substring("rest", 1, 1) != F.col("c"))
    tail = F.expr("substring(label, 2)")
    replaced = (left >= size) & (tail == F.substr(rest, F.lit(2), size - 1)) & _goes_on(rest, size)
    put = (left >= size - 1) & (tail == F.substr(rest, F.lit(1), size - 1)) & _goes_on(rest, size - 1)
    other = ahead.where("may").join(edges, others & (replaced | put))
    other_moves = F.array(_move(size, 1, replaced), _move(size - 1, 1, put))

    def moved(frame: DataFrame, moves: Column) -> DataFrame:
        frame = frame.select("side", "w", "pos", "child", "edits", (F.col("above") + size).alias("depth"), F.explode(F.array_compact(moves)).alias("m"))
        return frame.select("side", "w", (F.col("pos") + F.col("m.on")).alias("pos"), F.col("child").alias("node"), "depth", (F.col("edits") + F.col("m.made")).alias("edits"))

    return moved(own, own_moves).unionByName(moved(other, other_moves))


def neighbours(known: DataFrame, scratch: Scratch, least_letters: int = 1) -> DataFrame:
    """(word, near, near_n), both ways, of the words of ``known`` (word, n;
    distinct, none shorter than ``least_letters``) that differ by one inserted,
    deleted or replaced letter."""
    python_stages(known.sparkSession)
    begin = least_letters // 2
    read = scratch.write(known.select("word", "n").mapInArrow(lambda it: _words(it, begin), "side int, w string, n long, root long, last long"), "read")
    in_order = read.select("side", "w").repartitionByRange("side", "w").sortWithinPartitions("side", "w")
    edges = scratch.write(in_order.mapInArrow(lambda it: _edges(it, begin), "from long, c string, label string, child long, depth int, next string"), "edges")
    states = read.select("side", "w", F.lit(begin).alias("pos"), F.col("root").alias("node"), F.lit(begin).alias("depth"), F.lit(0).alias("edits"))
    level, found = 0, None
    while True:
        seen = Observation()
        on_way = F.expr("edits = 0 OR pos < char_length(w)")
        states = scratch.write(states.observe(seen, F.count_if(on_way).alias("n"), F.min(F.when(on_way, F.col("depth"))).alias("least")), f"states-{level}")
        # At a word's end with one edit, or one letter before it without.
        done = states.where("edits = 1 AND pos = char_length(w) OR edits = 0 AND pos = char_length(w) - 1").select("side", "w", "node")
        found = done if found is None else found.unionByName(done)
        if not seen.get["n"]:
            break
        states, level = _next(states.where(on_way), edges.where(F.col("depth") >= seen.get["least"])), level + 1

    def forward(c: str) -> Column:
        return F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))

    ends = read.select("side", F.col("last").alias("node"), F.col("w").alias("t"), F.col("n").alias("near_n"))
    pairs = found.join(ends, ["node", "side"]).select(forward("w").alias("word"), forward("t").alias("near"), "near_n")
    near = scratch.write(pairs.where(F.levenshtein("word", "near", 1) == 1).distinct(), "near")
    scratch.drop("read", "edges", *[f"states-{k}" for k in range(level + 1)])
    return near


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form), each followed to
    the last form.  Forms are ever more frequent, so there are no cycles;
    every round doubles the length of the way taken."""
    at, k = scratch.write(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        seen, k = Observation(), k + 1
        step = at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        at = scratch.write(step.observe(seen, F.count_if("moved").alias("n")), f"roots-{k}").select("word", "root")
        scratch.drop(f"roots-{k - 1}")
        if not seen.get["n"]:
            return at


def group(docs: DataFrame, every: int = EVERY, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` with enough
    letters and occurrences.  A word's form is its most frequent neighbour
    (ties: the smallest in code-point order) if that is ``factor`` times as
    frequent.  No documents, or texts without words, give no rows; equal rows
    count each."""
    scratch = Scratch(docs.sparkSession, "spelling")
    known = scratch.write(words(docs, every).where((F.char_length("word") >= least_letters) & (F.col("n") >= least_count)), "words")
    near = neighbours(known, scratch, least_letters)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("b"))
    joined = known.join(best, "word", "left").withColumn("top", -F.col("b.less"))
    is_form = F.col("top") >= F.col("n") * factor
    formed = scratch.write(joined.select("word", F.when(is_form, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                         F.when(is_form, F.col("top")).alias("form_n")), "forms")
    last = roots(formed.where("form IS NOT NULL").select("word", "form"), scratch)
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
