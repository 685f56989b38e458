"""Personal data: four base patterns and a semi-Markov conditional random
field that adds what they miss.

The field scores whole candidate segments (up to ``LONGEST`` tokens, so that a
position has a bounded number of entities that end at it) by features of the
span: its shape, digits, separators, checks and the words around it.  Dynamic
programming over a region's tokens chooses boundaries and types together.
Regions are where a digit, ``@`` or a spelled-out address mark stands; other
text cannot hold an entity.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from .common import python_stages

# Kinds in the order of reports, and the base patterns.  The
# domain part follows an ``@``; a digit run is entered at its first digit, as a
# start inside it could only fail the same way.
KINDS = ["email", "ip", "card", "phone"]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LONGEST = 14            # tokens of an entity
CONTEXT = 40            # characters around a region
JOIN = 24               # characters between triggers of one region
_TRIGGER = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]|\bdot\b", re.ASCII)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]", re.ASCII)
_AT, _DOT = re.compile(r"@|[\[({ ]at[\])} ]"), re.compile(r"\.|[\[({ ]dot[\])} ]")
_MORE = re.compile(r"(?:[.]| ?[\[({]dot[\])}] ?| dot )[A-Za-z]{2}|[-. ]?[0-9]", re.ASCII)    # the span would go on

CUES = {"email": {"mail", "email", "e", "contact", "write"}, "ip": {"ip", "address", "host", "server", "from"},
        "card": {"card", "visa", "credit", "pay", "number"}, "phone": {"tel", "phone", "call", "mobile", "fax", "ring"}}


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping
    within a kind; a match that fails its check is dropped and not retried."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        # The local part is the whole run of its letters before the mark.
        start = at
        while start > end and text[start - 1] in LOCAL_LETTERS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, end := m.end(), "email"))
        else:
            # No match can start before this mark any more.
            end = at + 1
        at = text.find("@", max(at + 1, end))
    if re.search("[0-9]", text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if is_ip(m.group())]
        for m in CARD.finditer(text):
            digits = digits_of(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def features(text: str, kind: str, before: str, after: str, rest: str) -> list[str]:
    """Whole-span features of a candidate segment."""
    digits = digits_of(text)
    shape = re.sub("[a-z]+", "a", re.sub("9+", lambda m: f"9{min(len(m.group()), 5)}", re.sub("[0-9]", "9", text.lower())))
    seps = "".join(sorted({c for c in text if not c.isalnum()}))
    out = ["bias", f"n{min(len(digits), 20)}", f"sep{seps}", f"end{text[0].isalnum():d}{text[-1].isalnum():d}"]
    if digits and len(shape) <= 24:
        out.append(f"shape{shape}")
    if kind == "email":
        out += [f"at{len(_AT.findall(text))}", f"dot{min(2, len(_DOT.findall(text)))}",
                f"form{bool(re.fullmatch(r'[A-Za-z0-9._%+-]+(?:@| ?[\[({]at[\])}] ?| at )[A-Za-z0-9-]+(?:(?:[.]| ?[\[({]dot[\])}] ?| dot )[A-Za-z0-9-]+)+', text)):d}"]
    elif kind == "ip":
        parts = re.split(r"[^0-9]+", text)
        out += [f"parts{min(6, len(parts))}", f"octets{len(parts) == 4 and all(p and int(p[:9]) <= 255 for p in parts):d}"]
    elif kind == "card":
        out += [f"luhn{luhn(digits):d}", f"long{13 <= len(digits) <= 19:d}", f"letters{any(c.isalpha() for c in text):d}"]
    else:
        out += [f"len{10 <= len(digits) <= 15:d}", f"lead{text[0]}", f"letters{any(c.isalpha() for c in text):d}", f"groups{min(6, len(re.findall('[0-9]+', text)))}"]
    out.append(f"cue{before.lower() in CUES[kind]:d}")
    # Whether the span goes on: a neighbour stuck to it means a wrong border.
    out.append(f"stuck{before[-1:].isdigit() or before in ('+', '(', '.', '-', '@', '_', '='):d}{after[:1].isdigit() or after in ('@', '_', '='):d}")
    out.append(f"more{bool(_MORE.match(rest)):d}")
    return [f"{kind}|{x}" for x in out]


class Region:
    """Tokens of a stretch of text, and the candidate segments over them."""

    def __init__(self, text: str, start: int, end: int):
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.text = text

    def candidates(self):
        """(first token, end token, kind) of the segments that may be entities:
        within a line, opened and closed by fitting tokens, with a mark or
        enough digits."""
        t, tok = self.text, self.tokens
        for i, (a, first_end) in enumerate(tok):
            opens = t[a]
            if not (opens.isalnum() or opens in "+("):
                continue
            n_digits = 0
            for j in range(i, min(len(tok), i + LONGEST)):
                b = tok[j][1]
                if j > i and ("\n" in t[tok[j - 1][1]:tok[j][0]] or tok[j][0] - tok[j - 1][1] > 2):
                    break
                closes = t[b - 1]
                if "0" <= t[tok[j][0]] <= "9":
                    n_digits += b - tok[j][0]
                if not closes.isalnum():
                    continue
                span = t[a:b]
                if not opens.isalpha() and "0" <= closes <= "9" and n_digits >= 4:
                    if not any(c.isalpha() for c in span):
                        if span.count(".") >= 3 and opens.isdigit():
                            yield i, j + 1, "ip"
                        if 13 <= n_digits <= 19 and opens.isdigit():
                            yield i, j + 1, "card"
                        if 7 <= n_digits <= 15:
                            yield i, j + 1, "phone"
                if j > i + 2 and opens.isalnum() and _AT.search(span) and _DOT.search(span):
                    yield i, j + 1, "email"

    def lattice(self):
        """(first, end, kind, features) of each candidate."""
        t, tok = self.text, self.tokens
        out = []
        for i, j, kind in self.candidates():
            before = t[tok[i - 1][0]:tok[i - 1][1]] if i else ""
            if i and before in ("+", "(", ".", "-", "@", "_", "=") and tok[i - 1][1] != tok[i][0]:
                before = ""
            after = t[tok[j][0]:tok[j][1]] if j < len(tok) and tok[j][0] == tok[j - 1][1] else ""
            out.append((i, j, kind, features(t[tok[i][0]:tok[j - 1][1]], kind, before, after, t[tok[j - 1][1]:tok[j - 1][1] + 12])))
        return out


def viterbi(n: int, lattice, weights) -> list[tuple[int, int, str]]:
    """Best segmentation of ``n`` tokens into candidates and single outside
    tokens (score 0)."""
    ending = defaultdict(list)
    for i, j, kind, f in lattice:
        ending[j].append((i, kind, sum(map(weights.get, f, [0.0] * len(f)))))
    best, back = [0.0], [None]
    for j in range(1, n + 1):
        value, how = best[j - 1], None
        for i, kind, score in ending[j]:
            if best[i] + score > value:
                value, how = best[i] + score, (i, kind)
        best.append(value)
        back.append(how)
    out, j = [], n
    while j:
        if back[j]:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def _expected(n: int, lattice, weights):
    """Segment probabilities by the forward-backward sums."""
    starting, ending = defaultdict(list), defaultdict(list)
    for k, (i, j, _, f) in enumerate(lattice):
        score = sum(weights[x] for x in f)
        starting[i].append((j, score))
        ending[j].append((i, score, k))

    def add(values):
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    forward, backward = [0.0], [0.0] * (n + 1)
    for j in range(1, n + 1):
        forward.append(add([forward[j - 1], *[forward[i] + s for i, s, _ in ending[j]]]))
    for i in range(n - 1, -1, -1):
        backward[i] = add([backward[i + 1], *[backward[j] + s for j, s in starting[i]]])
    return {k: math.exp(forward[i] + s + backward[j] - forward[n]) for j in ending for i, s, k in ending[j]}


def labelled_regions(n: int = 600, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts with their entities: forms of the four kinds, spelled-out and
    regrouped ones among them, and look-alikes that are none (years, versions,
    amounts, keys, serial numbers, times), in plain words."""
    rng = random.Random(seed)
    words = "the of and a to in der die und von le la et des el los que y report sent on page was near with this item".split()

    def number(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def card(groups):
        body = str(rng.choice([4, 5, 3, 6])) + number(sum(groups) - 2)
        digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        out, at = [], 0
        for g in groups:
            out.append(digits[at:at + g])
            at += g
        return out

    def entity():
        kind = rng.choice(KINDS)
        name, host, top = rng.choice(["j.doe", "anna", "m_king", "kim.84", "info"]), rng.choice(["mail", "example", "my-host", "web7"]), rng.choice(["com", "org", "net", "co.uk"])
        if kind == "email":
            at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), (" at ", " dot "), ("(at)", ".")])
            return kind, name + at + host + dot + top.replace(".", dot)
        if kind == "ip":
            return kind, ".".join(str(rng.randrange(256)) for _ in range(4))
        if kind == "card":
            sep = rng.choice(["", " ", "-", ".", "-"])
            return kind, sep.join(card(rng.choice([[4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 1], [4, 4, 4, 4]])))
        a, b, c = f"{rng.randrange(200, 999)}", number(3), number(4)
        return kind, rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 20 {number(4)} {c}", f"+49 {a} {number(7)}", f"0049 {a} {number(7)}", f"{a} {b} {c}"])

    def look_alike():
        return rng.choice([f"{rng.randrange(1900, 2030)}", f"{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(99)}", f"{number(2)}:{number(2)}",
                           f"{rng.randrange(1900, 2030)}-{number(2)}-{number(2)}", f"${number(3)},{number(3)}.{number(2)}", f"no. {number(6)}", f"v{number(1)}.{number(1)}",
                           "AK" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)), f"key={number(3)}f{number(5)}a{number(4)}", f"{number(12)}", f"{number(8)}",
                           f"{number(16)[:15]}", f"{number(3)} {number(2)} {number(4)}", f"page {number(3)}, {number(4)}", f"{number(24)}",
                           f"{rng.randrange(300, 999)}.{rng.randrange(300, 999)}.{number(3)}.{number(3)}.{number(2)}", f"{number(20)}", f"{number(5)}-{number(6)}"])

    out = []
    while len(out) < n:
        text, spans = "", []
        for _ in range(rng.randrange(1, 4)):
            text += " ".join(rng.choice(words) for _ in range(rng.randrange(2, 6))) + " "
            if rng.random() < 0.6:
                kind, s = entity()
                if rng.random() < 0.3:
                    text += rng.choice(sorted(CUES[kind])) + rng.choice([" ", ": "])
                spans.append((len(text), len(text) + len(s), kind))
            else:
                s = look_alike()
                if sum(c.isdigit() for c in s) in (13, 14, 15, 16) and luhn(digits_of(s)):
                    continue
            text += s + rng.choice([" ", ", ", ". "])
        out.append((text + "end", spans))
    return out


def train(examples: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 12, rate: float = 0.4, decay: float = 1e-4) -> dict[str, float]:
    """Weights of the greatest conditional likelihood, by AdaGrad.  The labelled
    texts are a small table given as a parameter."""
    ready = []
    for text, spans in examples:
        region = Region(text, 0, len(text))
        lattice = region.lattice()
        gold = {k for k, (i, j, kind, _) in enumerate(lattice) if (region.tokens[i][0], region.tokens[j - 1][1], kind) in spans}
        ready.append((len(region.tokens), lattice, gold))
    weights: dict[str, float] = defaultdict(float)
    squared: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(rounds):
        for n, lattice, gold in ready:
            if not lattice:
                continue
            gradient: dict[str, float] = defaultdict(float)
            for k, p in _expected(n, lattice, weights).items():
                slope = (k in gold) - p
                if abs(slope) > 1e-4:
                    for x in lattice[k][3]:
                        gradient[x] += slope
            for x, g in gradient.items():
                g -= decay * weights[x]
                squared[x] += g * g
                weights[x] += rate * g / math.sqrt(squared[x])
    return dict(weights)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around triggers, within borders of words."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() - out[-1][1] <= JOIN:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    merged: list[list[int]] = []
    for a, b in out:
        a, b = max(0, a - CONTEXT), min(len(text), b + CONTEXT)
        while a and not text[a - 1].isspace() and a > b - 100_000:
            a -= 1
        while b < len(text) and not text[b].isspace() and b < a + 100_000:
            b += 1
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def find(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans): the field adds segments that overlap no base
    span."""
    base = base_spans(text)
    added = []
    for a, b in regions(text):
        region = Region(text, a, b)
        lattice = region.lattice()
        if not lattice:
            continue
        for i, j, kind in viterbi(len(region.tokens), lattice, weights):
            s, e = region.tokens[i][0], region.tokens[j - 1][1]
            if not any(s < y and x < e for x, y, _ in base):
                added.append((s, e, kind))
    return base, sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its kind; of overlapping spans the
    first names the joined stretch."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _found(batches, weights):
    import pyarrow as pa

    def joined(spans):
        return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = [find(t or "", weights) for t in texts]
        counts = [pa.array([sum(x[2] == kind for x in every) for _, every in found], pa.int64()) for kind in KINDS]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *counts, pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(a) for _, a in found], pa.string()),
             pa.array([None if t is None else redact(t, a) for t, (_, a) in zip(texts, found)], pa.string())],
            names=[*batch.schema.names, *[f"n_{k}" for k in KINDS], "base", "spans", "redacted"])


def detect(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` (with a ``text`` column) plus n_<kind> counts of all spans, the
    ``base`` spans, all ``spans`` (kind:start:end by start, in code points) and
    the ``redacted`` text.

    A null text has no spans and stays null when redacted; rows are
    independent; own columns of the added names are replaced."""
    python_stages(docs.sparkSession)
    kept = docs.drop(*[f"n_{k}" for k in KINDS], "base", "spans", "redacted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(lambda it: _found(it, weights),
                           schema + ", " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, redacted string")


def base_digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
