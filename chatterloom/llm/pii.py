"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give base spans (email, ip, card, phone), which always stay. The random field scores whole candidate
spans: shape, digits, check sums and neighbours of a segment, not of single tokens. A dynamic program over
a region (neighbouring chunks with digits or ``@``) chooses boundaries and kinds together, with segments of at most ``MOST_TOKENS`` tokens. Its
spans are added where they touch no base span.

It is trained here, by gradient steps on the conditional likelihood (forward and backward sums over all segmentations), on
regions of at most ``SAMPLE_ROWS`` rows with the base spans as labels. Every text is scanned whole.

Null texts count as empty: no spans. Repeated rows get equal spans. Without training regions only base spans are found.
Positions count code points, the end is exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, inf, log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.llm.shared import small_batches

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 16
SAMPLE_ROWS = 2_000
SAMPLE_REGIONS = 500  # regions the gradient steps use; of the sampled rows, the first by hash
EPOCHS = 4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Every match starts where a run of digits starts, so the lookbehind loses none and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[\s\S]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _ip_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _ip_parts(m[0])]
        found += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of chunks with a digit or ``@``, joined over single blanks, that can hold an entity."""
    out: list[list[int]] = []
    at, n = 0, len(text)
    while m := _ANCHOR.search(text, at):
        start, end = m.span()
        low = out[-1][1] if out else 0
        while start > low and not text[start - 1].isspace():
            start -= 1
        while end < n and not text[end].isspace():
            end += 1
        if out and start - out[-1][1] == 1 and text[start - 1] == " ":
            out[-1][1] = end
        else:
            out.append([start, end])
        at = end
    return [(a, b) for a, b in out if "@" in (s := text[a:b]) or len(_DIGIT.findall(s)) >= 4]


def _class(c: str) -> str:
    return "a" if c.isalpha() else "9" if c in "0123456789" else c if c.isascii() else "u"


def _shape(s: str) -> str:
    out = ""
    for c in s:
        if (k := _class(c)) != out[-1:] or k not in "a9":
            out += k
    return out


def features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole span."""
    s = text[start:end]
    d = _digits(s)
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    return [
        "bias",
        "shape " + _shape(s),
        f"ats {min(s.count('@'), 2)} dots {min(s.rpartition('@')[2].count('.'), 4)}",
        f"digits {min(len(d), 24)} plus {s[0] == '+'}",
        f"luhn {16 <= len(d) <= 19 and luhn(d)} letters {any(c.isalpha() for c in s)}",
        f"parts {s.count('.') == 3 and s.replace('.', '').isdigit() and s[0] != '.' and s[-1] != '.' and '..' not in s and s.isascii() and _ip_parts(s)}",
        "first " + _class(s[0]),
        "last " + _class(s[-1]),
        "before " + _class(before),
        "after " + _class(after),
    ]


def candidates(text: str, start: int, end: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of tokens of a region and its segments (first token, token after, start, end) that may be an entity."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
    out = []
    for i, (a, _) in enumerate(tokens):
        if text[a].isspace():
            continue
        anchors = 0
        for j in range(i, min(len(tokens), i + MOST_TOKENS)):
            b = tokens[j][1]
            anchors += text[tokens[j][0]] in "0123456789@"
            if anchors and b - a >= 6 and not text[b - 1].isspace():
                out.append((i, j + 1, a, b))
    return len(tokens), out


@dataclass
class Model:
    weights: dict[str, list[float]]  # feature -> weight per kind

    def segment_scores(self, text: str, a: int, b: int) -> list[float]:
        known = [w for f in features(text, a, b) if (w := self.weights.get(f))]
        return [sum(x) for x in zip(*known)] if known else [0.0] * len(KINDS)

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """Best segmentation of a region: its entities as (kind number, start, end)."""
        n, segments = candidates(text, start, end)
        into: dict[int, list[tuple[float, int, tuple[int, int, int]]]] = {}
        for i, j, a, b in segments:
            scores = self.segment_scores(text, a, b)
            k = max(range(len(KINDS)), key=scores.__getitem__)
            if scores[k] > 0:
                into.setdefault(j, []).append((scores[k], i, (k, a, b)))
        best, back = [0.0] + [-inf] * n, [None] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], (j - 1, None)
            for score, i, span in into.get(j, ()):
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, span)
        out, j = [], n
        while j:
            j, span = back[j]
            if span:
                out.append(span)
        return out[::-1]


def _add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x if y == -inf else x + log(1 + exp(y - x))


def train(texts: list[str], most_regions: int = SAMPLE_REGIONS) -> Model:
    """AdaGrad on log p(labelled segmentation | region); the labels are the base spans that are candidates."""
    examples = []
    for text in texts:
        gold = {(a, b): k for k, a, b in base_spans(text)}
        for start, end in regions(text):
            n, segments = candidates(text, start, end)
            if n > 4 * MOST_TOKENS or len(examples) >= most_regions:
                continue
            taken: list[int | None] = []
            last = 0
            for i, j, a, b in segments:
                k = gold.get((a, b))
                taken.append(k if k is not None and i >= last else None)
                last = j if taken[-1] is not None else last
            examples.append((n, segments, [features(text, a, b) for _, _, a, b in segments], taken))
    kinds = range(len(KINDS))
    # Only features of labelled spans, or of spans beside them, ever need a weight; all others stay at 0.
    weights: dict[str, list[float]] = {f: [0.0] * len(KINDS) for _, _, feats, _ in examples for fs in feats for f in fs}
    if "bias" in weights:
        weights["bias"] = [-3.0] * len(KINDS)
    seen = {f: [1e-2] * len(KINDS) for f in weights}
    for _ in range(EPOCHS):
        for n, segments, feats, taken in examples:
            scores = [[sum(x) for x in zip(*(weights[f] for f in fs))] for fs in feats]
            ending: dict[int, list[int]] = {}
            starting: dict[int, list[int]] = {}
            for s, (i, j, _, _) in enumerate(segments):
                ending.setdefault(j, []).append(s)
                starting.setdefault(i, []).append(s)
            forward, backward = [0.0] + [-inf] * n, [-inf] * n + [0.0]
            for j in range(1, n + 1):
                forward[j] = forward[j - 1]
                for s in ending.get(j, ()):
                    for k in kinds:
                        forward[j] = _add(forward[j], forward[segments[s][0]] + scores[s][k])
            for i in range(n - 1, -1, -1):
                backward[i] = backward[i + 1]
                for s in starting.get(i, ()):
                    for k in kinds:
                        backward[i] = _add(backward[i], backward[segments[s][1]] + scores[s][k])
            for s, (i, j, _, _) in enumerate(segments):
                for k in kinds:
                    g = (taken[s] == k) - exp(min(0.0, forward[i] + scores[s][k] + backward[j] - forward[n]))
                    if abs(g) > 1e-3:
                        for f in feats[s]:
                            seen[f][k] += g * g
                            weights[f][k] += 0.3 * g / sqrt(seen[f][k])
    return Model({f: w for f, w in weights.items() if any(w)})


def spans(text: str | None, model: Model) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, is base) by kind, then start."""
    text = text or ""
    base = base_spans(text)
    out = [(*x, True) for x in base]
    for start, end in regions(text):
        for k, a, b in model.decode(text, start, end):
            if not any(x[1] < b and a < x[2] for x in base):
                out.append((k, a, b, False))
    return sorted(out)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, most_regions: int = SAMPLE_REGIONS) -> Model:
    """A model from about ``rows`` rows that hold a digit or ``@``, chosen by a hash of the text."""
    usable = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    share = min(1.0, rows / max(1, usable.count()))
    chosen = usable.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:  # the regions and a few characters beside them are all that training needs
            cut = []
            for t in x.column("text"):
                t = t.as_py()
                cut.append([t[max(0, a - 2) : b + 2] for a, b in regions(t)])
            yield pa.RecordBatch.from_arrays([x.column("h"), pa.array(cut, pa.list_(pa.string()))], ["h", "regions"])

    found = small_batches(chosen).mapInArrow(gather, "h long, regions array<string>").orderBy("h").limit(rows).toArrow()
    return train([r for some in found.column("regions").to_pylist() for r in some], most_regions)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) of every row; spans are structs (kind, start, end, base) by kind, then start."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [
                [{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in spans(t.as_py(), sent.value)] for t in x.column("text")
            ]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
