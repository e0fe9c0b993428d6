"""Personal data: base rules, and candidate spans that boosted trees select.

The base rules' spans always stay. Beyond them, generators of high recall propose overlapping spans of several kinds: every
run of up to GROUPS digit groups within a stretch of digits and separators, and addresses written out in words. Trees judge
each by its format and context; of those above the calibrated threshold the likelier of overlapping ones is taken. The trees
are fitted here on sentences made by a seeded generator, and the threshold is the least that reaches PRECISION on sentences
kept apart.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import arrow_rows, bounded_batches, table, task

KINDS = ("email", "ip", "card", "phone", "ssn")
BASE_KINDS = KINDS[:4]
PRECISION, SENTENCES = 0.995, 4000
#: Proposals judged together.
JUDGED = 20_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match never begins within a run of digits: where the run's beginning fails, so do its later digits
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, rank of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """The base rules' spans: each kind leftmost first and not overlapping, failing matches dropped without a retry."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        before = text[done:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local and (m := _HOST.match(text, at)):
            out.append((at - local, 0, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1  # the at sign itself can't be part of a name
            at = text.find("@", done)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


# -- candidates ---------------------------------------------------------------------------------

_STRETCH = re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,3}[0-9])+")
_GROUP = re.compile(r"[+(]*[0-9]+")
_WORDED = re.compile(r"\b[A-Za-z0-9._-]{2,40}\x20?[\[({<]?\x20?(?:at|AT|@)\x20?[\])}>]?\x20?[A-Za-z0-9-]{2,40}(?:\x20?[\[({<]?\x20?(?:dot|DOT|\.)\x20?[\])}>]?\x20?[A-Za-z]{2,10}){1,3}\b")
_CUES = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address", "from"), "card": ("card", "visa", "credit", "pay"),
    "phone": ("call", "tel", "phone", "fax", "mobile", "dial"), "ssn": ("ssn", "social", "security"),
}
_AGAINST = ("version", "page", "order", "date", "since", "total", "price", "release", "isbn", "item", "code", "figure", "between", "year")


def candidates(text: str) -> Iterator[Span]:
    """Overlapping proposals, each a start, a kind's rank and an end. Linear in the text: a group begins runs of 19
    digits at most, and groups of over 24 digits none."""
    if _DIGIT.search(text):
        for m in _STRETCH.finditer(text):
            if m.end() - m.start() < 7:
                continue
            groups = [(g.start(), g.end(), g.end() - g.start()) for g in _GROUP.finditer(text, m.start(), m.end())]
            for i, (start, _, size) in enumerate(groups):
                digits = 0
                if size > 24:
                    continue
                for j in range(i, len(groups)):
                    digits += len(_DIGIT.findall(text[groups[j][0] : groups[j][1]])) if groups[j][2] <= 24 else 99
                    if digits > 19:
                        break
                    end = groups[j][1]
                    if 7 <= digits <= 15:
                        yield start, 3, end
                    if j - i == 3 and digits <= 12:
                        yield start, 1, end
                    if digits >= 13:
                        yield start, 2, end
                    if digits == 9:
                        yield start, 4, end
    if " at" in text or "(at" in text or "[at" in text or "@" in text or " AT" in text:
        for m in _WORDED.finditer(text):
            yield m.start(), 0, m.end()


def features(text: str, span: Span) -> list[float]:
    """Format and context of a proposal, as small integers."""
    start, rank, end = span
    body, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 2]
    digits = _DIGIT.findall(body)
    sizes = [len(x) for x in re.findall(r"[0-9]+", body)]
    low = before.lower()
    shape = 0
    for s in sizes[:6]:
        shape = shape * 5 + min(s, 4)
    return [
        rank, len(digits), len(sizes), shape, sizes[0] if sizes else 0, sizes[-1] if sizes else 0, max(sizes, default=0), body.count("."), body.count("-"), body.count(" "),
        body.count("/"), body.startswith("+"), "(" in body, ")" in body, body.count("(") == body.count(")"), luhn("".join(digits)) if 13 <= len(digits) <= 19 else 0, _octets(body) if rank == 1 else 0,
        any(c in low for c in _CUES[KINDS[rank]]), any(c in low for k, cs in _CUES.items() if k != KINDS[rank] for c in cs), any(c in low for c in _AGAINST),
        before[-1:].isalnum(), before[-1:] in "+-(./" if before else 0, bool(re.search(r"[0-9][\x20().\-/]*$", before)), after[:1].isalnum(), bool(re.match(r"[\x20().\-/]*[0-9]", after)), after[:1] in ".-/" and after[1:2].isdigit(),
        "dot" in body.lower(), any(c in body for c in "[({<"), bool(re.search(r"\b(?:at|AT)\b", body)), sizes[:1] in ([19], [20]) or bool(sizes and 1900 <= int(re.findall(r"[0-9]+", body)[0][:6]) <= 2100), len(set(digits)),
    ]


# -- sentences to learn from --------------------------------------------------------------------


def _sentence(rng: random.Random) -> tuple[str, list[Span]]:
    """A made-up sentence and the personal data in it."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    octet = lambda: str(rng.randint(0, 255))

    def card() -> str:
        n = rng.choice((14, 15, 16, 16, 16))
        body = rng.choice("3456") + d(n - 2)
        check = next(c for c in "0123456789" if luhn(body + c))
        full, sep = body + check, rng.choice(("", " ", "-", "."))
        size = rng.choice((4, 4, 4, 4, 2, 1))
        return sep.join(full[k : k + size] for k in range(0, n, size)) if sep else full

    area = lambda: rng.choice("23456789") + d(2)
    truths = {
        0: lambda: f"{word()}{rng.choice(('.', '', '_'))}{word()}{rng.choice((' at ', ' (at) ', ' [at] ', '(at)', ' AT '))}{word()}{rng.choice((' dot ', ' (dot) ', ' DOT ', '[dot]'))}{rng.choice(('com', 'org', 'net'))}",
        1: lambda: ".".join((octet(), octet(), octet(), octet())),
        2: card,
        3: lambda: rng.choice((f"+1 ({d(3)}) 555-{d(4)}", f"({area()}) {d(3)}-{d(4)}", f"{area()}-{d(3)}-{d(4)}", f"{area()}.{d(3)}.{d(4)}", f"+{rng.randint(2, 99)} {d(2)} {d(4)} {d(4)}", f"+1 {area()} {d(3)} {d(4)}", f"00{rng.randint(20, 99)} (0) {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}")),
        4: lambda: f"{d(3)}-{d(2)}-{d(4)}",
    }
    noise = (
        lambda: f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2100)} {rng.randint(0, 23):02d}.{rng.randint(0, 59):02d}",
        lambda: f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(1900, 2100)}",
        lambda: f"version {rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 900)}.{rng.randint(0, 9000)}",
        lambda: f"{d(rng.randint(1, 3))}.{d(rng.randint(4, 12))}",
        lambda: d(rng.randint(7, 22)),
        lambda: f"{rng.randint(1900, 2100)}-{rng.randint(1900, 2100)}",
        lambda: f"order {d(4)}-{d(5)}-{d(3)}",
        lambda: f"isbn 978-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
        lambda: " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(3, 9))),
        lambda: ".".join(d(rng.randint(1, 3)) for _ in range(rng.randint(5, 8))),
        lambda: f"{words(1, 3)} at {words(1, 2)}. {word()}",
        lambda: f"{words(1, 2)} at {word()} dot {word()} {word()}",
        lambda: rng.choice("abcdef") + d(rng.randint(7, 12)) + rng.choice("abcdef"),
        lambda: f"{d(rng.randint(3, 6))}-{d(rng.randint(3, 6))}-{d(rng.randint(3, 6))}",
    )
    text, spans = words(0, 4), []
    for _ in range(rng.randint(1, 4)):
        text += rng.choice((" ", " ", ", ", ". ", ": ", "\n", " | ")) if text else ""
        if rng.random() < 0.5:
            rank = rng.randrange(5)
            if rng.random() < 0.4 or rank == 4:
                text += f"{rng.choice(_CUES[KINDS[rank]])} "
            body = truths[rank]()
            spans.append((len(text), rank, len(text) + len(body)))
            text += body
        else:
            text += rng.choice(noise)()
        if rng.random() < 0.7:
            text += f" {words(1, 3)}"
    return text, spans


@cache
def model(seed: int = 7) -> tuple[Trees, float]:
    """Trees and threshold; takes a few seconds once, on the driver."""
    rng = random.Random(seed)
    rows, truth, part = [], [], []
    for k in range(SENTENCES):
        text, spans = _sentence(rng)
        known = set(spans)
        for c in candidates(text):
            rows.append(features(text, c))
            truth.append(c in known)
            part.append(k % 4 == 3)
    x, y, kept = np.array(rows, np.float64), np.array(truth, np.float64), np.array(part)
    trees = fit(x[~kept], y[~kept])
    chance, right = trees.chance(x[kept]), y[kept] > 0
    order = np.argsort(-chance, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    return trees, max(0.5, float(chance[order][good[-1]]) if len(good) else 1.0)


def select(text: str, base: list[Span], proposals: list[Span], chances: np.ndarray, threshold: float) -> list[Span]:
    """Proposals above the threshold, the likelier first, then the longer; none overlaps a base span or another.

    What is taken is kept as ascending stretches apart from each other, so one bisection tells whether a proposal is free.
    """
    chosen: list[Span] = []
    begins: list[int] = []
    ends: list[int] = []
    for s, _, e in sorted(base):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)
    for k in np.lexsort(([p[0] - p[2] for p in proposals], -chances)).tolist():
        if chances[k] < threshold:
            break
        s, _, e = proposals[k]
        at = bisect_right(ends, s)
        if at == len(begins) or e <= begins[at]:
            chosen.append(proposals[k])
            begins.insert(at, s)
            ends.insert(at, e)
    return chosen


def find(texts: list[str | None], trees: Trees, threshold: float) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text; up to JUDGED proposals are judged together, and those below the threshold dropped."""
    based: list[list[Span]] = []
    likely: list[list[tuple[Span, float]]] = [[] for _ in texts]
    waiting: list[tuple[int, Span]] = []
    rows: list[list[float]] = []

    def judge() -> None:
        for (k, c), chance in zip(waiting, trees.chance(np.array(rows, np.float64)).tolist() if rows else (), strict=True):
            if chance >= threshold:
                likely[k].append((c, chance))
        waiting.clear()
        rows.clear()

    for k, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        based.append(base)
        taken = bytearray(len(text))
        for a, _, b in base:
            taken[a:b] = b"\1" * (b - a)
        for c in candidates(text):
            if not base or taken.find(1, c[0], c[2]) < 0:
                waiting.append((k, c))
                rows.append(features(text, c))
                if len(rows) == JUDGED:
                    judge()
    judge()
    return [(base, select(text or "", base, [c for c, _ in some], np.array([x for _, x in some]), threshold)) for text, base, some in zip(texts, based, likely, strict=True)]


FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])))])
FOUND_SQL = "doc_id long, spans array<struct<start:int,rank:int,end:int,kind:string,base:boolean>>"


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each row of docs (doc_id, text); one narrow pass.

    A span has start, rank (of its kind), end, kind and base (found by a base rule); spans are in order of start, then
    kind; offsets are code points. Null and empty texts have none; repeated rows are judged each.
    """
    bounded_batches(docs.sparkSession)
    trees, threshold = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, (base, added) in zip(b.column("doc_id").to_pylist(), find(b.column("text").to_pylist(), trees, threshold), strict=True):
                spans = sorted([(s, True) for s in base] + [(s, False) for s in added])
                rows.append((doc_id, [{"start": s, "rank": r, "end": e, "kind": KINDS[r], "base": own} for (s, r, e), own in spans]))
            yield arrow_rows(FOUND, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task(run), FOUND_SQL)


def without(text: str, spans: list[Span]) -> str:
    """text with each span replaced by <PII:kind>; of overlapping spans the earliest, then the first kind's, names the mark."""
    out, at = [], 0
    for s, rank, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<PII:{KINDS[rank]}>"]
        at = max(at, e)
    return "".join((*out, text[at:]))


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with each base span and each selected one in text replaced by <PII:kind>; one narrow pass.

    n_chars, where there is such a column, is brought up to date for the texts that change. Null texts stay null; repeated
    rows change alike; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    trees, threshold = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [base + added for base, added in find(texts, trees, threshold)]
            now = [without(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)]
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            columns["text"] = pa.array(now, b.schema.field("text").type)
            if "n_chars" in columns:
                old = columns["n_chars"]
                columns["n_chars"] = pa.array([len(t) if spans else n for t, spans, n in zip(now, found, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=b.schema)

    return docs.mapInArrow(task(run), docs.schema)


DIGEST = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = personal_data(table(spark, sf_dir, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, spans in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist(), strict=True):
                told = [(s["base"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                base, counts = ",".join(t for own, t in told if own), Counter(s["kind"] for s in spans if s["base"])
                rows.append((doc_id, *map(counts.__getitem__, BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in told)))
            yield arrow_rows(DIGEST, rows)

    return found.mapInArrow(task(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
