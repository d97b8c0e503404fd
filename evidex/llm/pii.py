"""Personal data: four fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm.common import CHUNK, codepoints, ends, run_hash, tidy

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses, found from their @ so that long runs without one cost no more than their length."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        got = _DOMAIN.match(text, at) if start < at else None
        if got:
            out.append((start, got.end()))
        low = got.end() if got else at + 1
        at = text.find("@", low)
    return out


def good_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def good_card(text: str) -> bool:
    digits = "".join(c for c in text if "0" <= c <= "9")
    return 13 <= len(digits) <= 19 and luhn(digits)


def good_phone(text: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in text) <= 15


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind and then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for kind, pattern, good in (("ip", _IP, good_ip), ("card", _CARD, good_card), ("phone", _PHONE, good_phone)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if good(m[0])]
    return out


# The labelled table.

LABELLED = 600


def labelled_rows(n: int = LABELLED, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """``n`` short invented sentences with their spans: personal data in the fixed patterns' forms and
    in looser ones (spoken addresses, telephones without a plus, dotted cards), and look-alikes
    (versions, dates, prices, keys, hashes, counts) that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiouéü") for _ in range(r.randint(1, 4)))

    def card(sep: str) -> str:
        body = "4" + digits(14)
        last = next(d for d in "0123456789" if luhn(body + d))
        return sep.join((body + last)[k:k + 4] for k in range(0, 16, 4))

    makers = {
        "email": [lambda: f"{word()}.{digits(2)}@{word()}{r.randint(1, 9)}.example.com", lambda: f"{word()}@{word()}.org",
                  lambda: f"{word()} at {word()} dot com", lambda: f"{word()} (at) {word()} (dot) org"],
        "ip": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))],
        "card": [lambda: card(""), lambda: card(" "), lambda: card("-"), lambda: card(".")],
        "phone": [lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f"+{r.randint(30, 60)} {digits(3)} {digits(7)}",
                  lambda: f"({digits(3)}) 555-{digits(4)}", lambda: f"{digits(3)}-555-{digits(4)}", lambda: f"{digits(3)}.555.{digits(4)}"],
    }
    none = [lambda: f"Version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            lambda: f"{r.randint(1, 23)}:{digits(2)}", lambda: f"${r.randint(1, 900)}.{digits(2)}", lambda: f"{r.randint(1, 99)},{digits(3)}",
            lambda: "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)),
            lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"password={digits(3)}{word()}{digits(4)}",
            lambda: digits(r.randint(1, 12)), lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"CC BY-NC {r.randint(1, 4)}.0",
            lambda: f"at {word()} {word()}", lambda: f"{digits(3)}-{digits(2)}", lambda: f"({digits(3)})", lambda: f"{digits(5)}-{digits(4)}",
            lambda: f"@{word()}", lambda: "###", lambda: "| " + word() + " |", lambda: f"{digits(4)} {digits(4)}"]
    out = []
    for _ in range(n):
        text, spans = word().capitalize(), []
        for _ in range(r.randint(1, 3)):
            text += " " + " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(0, 4)))
            text = text.rstrip() + " "
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                made = r.choice(makers[kind])()
                spans.append((kind, len(text), len(text) + len(made)))
            else:
                made = r.choice(none)()
            text += made + r.choice(["", ",", "."])
        out.append((text + " " + word() + ".", spans))
    return out


def labelled_table(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """(text, spans array<struct<kind, start, end>>): the small table the field is trained from.

    It comes as an Arrow table, which the driver holds itself; rows of Python objects go through a
    second set of Python workers on each executor, which stay beside those of the later stages.
    """
    rows = labelled_rows(n)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in found] for _, found in rows]
    return spark.createDataFrame(pa.table([pa.array([t for t, _ in rows], pa.string()), pa.array(spans, pa.list_(span))], names=["text", "spans"]))


# The field.

LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
ROWS = 1 << 13
_SHAPES: list[np.ndarray] = []


def _shape_table() -> np.ndarray:
    """Shape of every code point: upper, lower and other letters, digits, white space; signs are themselves."""
    if not _SHAPES:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = 1 if ch.isupper() else 2
            elif ch.isspace():
                table[c] = 0
            elif "0" <= ch <= "9":
                table[c] = 3
        _SHAPES.append(table)
    return _SHAPES[0]


def tokens(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, rows of the weights (tokens x features), line) of the words of all texts.

    A word is a run without white space. Its features are its shape (runs of a class count
    once), shape with the number of digits, the shapes of its neighbours on the line, the
    word before in lower case if short, and its own lower case if short.
    """
    code = codepoints("".join(f"{t}\n" for t in texts))
    shape = _shape_table()[code]
    gap = shape == 0
    before = np.concatenate([[True], gap[:-1]])
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    change = ~gap & (before | np.concatenate([[True], shape[1:] != shape[:-1]]))
    seen = np.concatenate([[0], np.cumsum(change)])
    form = run_hash(shape[change], seen[start], seen[end])
    count = np.concatenate([[0], np.cumsum(shape == 3)])
    digits = np.minimum(count[end] - count[start], 20).astype(np.uint64)
    low = np.where((code >= 65) & (code <= 90), code + 32, code)
    small = end - start <= 6
    word = np.where(small, run_hash(low, start, end), np.uint64(1))
    lines = np.concatenate([[0], np.cumsum(code == 10)])
    line = lines[start]
    at = ends(len(t) + 1 for t in texts)
    text = np.searchsorted(at, start, "right") - 1
    first = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]]) if len(line) else first
    shift = lambda a: (np.where(first, np.uint64(2), np.concatenate([a[:1], a[:-1]])), np.where(last, np.uint64(3), np.concatenate([a[1:], a[-1:]])))
    (left, right), (left_word, _) = shift(form), shift(word)
    parts = (form, form + digits * np.uint64(0x9E3779B97F4A7C15), left, right, left_word, word)
    rows = np.stack([(p ^ p >> np.uint64(17)) % np.uint64(ROWS) + np.uint64(k * ROWS) for k, p in enumerate(parts)], 1).astype(np.int64)
    return text, start - at[text], end - at[text], rows, line


FEATURES = 6


def _padded(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first token, length) of each line."""
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(line)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(rows: Sequence[tuple[str, Sequence[Span]]], rounds: int = 120, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of label pairs, by Adam on the penalised log-likelihood of the labelled rows."""
    text, start, end, feats, line = tokens([t for t, _ in rows])
    gold = np.zeros(len(text), np.int64)
    for k, (_, spans) in enumerate(rows):
        mine = np.flatnonzero(text == k)
        for kind, a, b in spans:
            inside = mine[(start[mine] < b) & (end[mine] > a)]
            gold[inside] = LABELS.index(f"I-{kind}")
            gold[inside[:1]] = LABELS.index(f"B-{kind}")
    first, length = _padded(line)
    n, steps, k = len(first), int(length.max()), len(LABELS)
    where = first[:, None] + np.minimum(np.arange(steps), length[:, None] - 1)
    live = np.arange(steps) < length[:, None]
    y = gold[where]
    params = [np.zeros((FEATURES * ROWS, k)), np.zeros((k, k))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    used = np.unique(feats)
    for r in range(1, rounds + 1):
        weight, pair = params
        emit = weight[feats].sum(1)[where]
        alpha, beta = np.zeros((n, steps, k)), np.zeros((n, steps, k))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, steps):
            step = _logsum(alpha[:, t - 1, :, None] + pair, 1) + emit[:, t]
            alpha[:, t] = np.where(live[:, t, None], step, alpha[:, t - 1])
        whole = _logsum(alpha[:, -1], 1)
        for t in range(steps - 2, -1, -1):
            step = _logsum(pair + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(live[:, t + 1, None], step, 0)
        node = np.exp(alpha + beta - whole[:, None, None]) * live[:, :, None]
        both = live[:, 1:, None, None] * np.exp(alpha[:, :-1, :, None] + pair + (emit + beta)[:, 1:, None, :] - whole[:, None, None, None])
        grad_pair = -both.sum((0, 1))
        np.add.at(grad_pair, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
        delta = -node[live]
        delta[np.arange(len(delta)), y[live]] += 1
        grad = np.zeros_like(weight)
        for f in range(FEATURES):
            np.add.at(grad, feats[where[live], f], delta)
        for p, g, m in zip(params, (grad - penalty * n * weight, grad_pair - penalty * n * pair), moments, strict=True):
            rows_ = used if p is weight else slice(None)
            m[0][rows_] = 0.9 * m[0][rows_] + 0.1 * g[rows_]
            m[1][rows_] = 0.99 * m[1][rows_] + 0.01 * g[rows_] ** 2
            p[rows_] += 0.1 * (m[0][rows_] / (1 - 0.9 ** r)) / (np.sqrt(m[1][rows_] / (1 - 0.99 ** r)) + 1e-8)
    return params[0].astype(np.float32), params[1].astype(np.float32)


def viterbi(emit: np.ndarray, line: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Best label of each token; lines of similar length are decoded together in padded matrices."""
    first, length = _padded(line)
    out = np.zeros(len(line), np.int64)
    low = 0
    while low < (length.max() if len(length) else 0):
        high = max(8, 2 * low)
        mine = np.flatnonzero((length > low) & (length <= high))
        low = high
        if not len(mine):
            continue
        f, n = first[mine], length[mine]
        steps = int(n.max())
        where = f[:, None] + np.minimum(np.arange(steps), n[:, None] - 1)
        best, back = emit[f], np.zeros((steps, len(f), len(pair)), np.uint8)
        keep = np.arange(len(pair), dtype=np.uint8)
        for t in range(1, steps):
            score = best[:, :, None] + pair
            arg = score.argmax(1)
            live = (t < n)[:, None]
            back[t] = np.where(live, arg, keep)
            best = np.where(live, np.take_along_axis(score, arg[:, None], 1)[:, 0] + emit[where[:, t]], best)
        label = best.argmax(1)
        every = np.arange(len(f))
        for t in range(steps - 1, -1, -1):
            out[where[:, t]] = np.where(t < n, label, out[where[:, t]])
            label = back[t][every, label]
    return out


_TRIM = ".,;:!?\"'()[]{}<>|"
_CHECK = {"email": lambda s: "@" in s or re.search(r"\bat\b.*\bdot\b", s, re.I | re.S) is not None, "ip": lambda s: s.count(".") == 3 and re.fullmatch(r"[0-9.]+", s) is not None and good_ip(s),
          "card": good_card, "phone": good_phone}


def field_spans(texts: Sequence[str], model: tuple[np.ndarray, np.ndarray]) -> list[list[Span]]:
    """Spans the field finds in each text that hold as many and as good digits as their kind must."""
    weight, pair = model
    out: list[list[Span]] = [[] for _ in texts]
    text, start, end, feats, line = tokens(texts)
    if not len(text):
        return out
    emit = weight[feats[:, 0]]
    for f in range(1, FEATURES):
        emit = emit + weight[feats[:, f]]
    label = viterbi(emit, line, pair)
    hits = np.flatnonzero(label)
    k = 0
    while k < len(hits):
        i = hits[k]
        kind = (label[i] - 1) // 2
        j = k + 1
        while j < len(hits) and hits[j] == hits[j - 1] + 1 and line[hits[j]] == line[i] and label[hits[j]] == 2 * kind + 2:
            j += 1
        whole = texts[text[i]]
        a, b = int(start[i]), int(end[hits[j - 1]])
        found = whole[a:b]
        a += len(found) - len(found.lstrip(_TRIM.replace("(", "") if kind == 3 else _TRIM))
        b -= len(found) - len(found.rstrip(_TRIM))
        if b > a and _CHECK[KINDS[kind]](whole[a:b]):
            out[text[i]].append((KINDS[kind], a, b))
        k = j
    return out


def all_spans(base: list[Span], extra: list[Span]) -> list[Span]:
    """Base spans and those of the field that touch none of them, by kind and then start."""
    held = sorted((a, b) for _, a, b in base)
    lows = [a for a, _ in held]
    highs = list(np.maximum.accumulate([b for _, b in held])) if held else []
    out = list(base)
    for kind, a, b in extra:
        k = int(np.searchsorted(lows, b))
        if not k or highs[k - 1] <= a:
            out.append((kind, a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


#: Characters that a part of a long line takes from the parts beside it.
MARGIN = 4096
#: Characters that the field works on at a time; its matrices take some 150 bytes a character.
FIELD = CHUNK // 2
_BLANK = re.compile(r"\s")


def parts_of(text: str, limit: int = CHUNK) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, first, last) of parts of about ``limit`` characters; spans that begin from
    ``first`` to before ``last`` are the part's own.

    A text is cut at line ends, which neither features nor decoding cross. A line beyond the
    limit is cut at blanks, and its parts overlap by MARGIN characters and more up to a blank on
    either side, so a span at a cut is decoded with its neighbours on both sides.
    """
    at = 0
    while len(text) - at > limit:
        line = text.rfind("\n", at, at + limit) + 1
        if line > at:
            yield at, line, at, line
            at = line
            continue
        stop = text.find("\n", at + limit) + 1 or len(text)
        low = first = at
        while stop - first > limit + 2 * MARGIN and (cut := _BLANK.search(text, first + limit, stop)):
            high = _BLANK.search(text, min(stop, cut.end() + MARGIN), stop)
            yield low, high.end() if high else stop, first, cut.end()
            first = cut.end()
            low = next((k for k in range(max(at, first - MARGIN), at, -1) if text[k - 1].isspace()), at)
        yield low, stop, first, stop
        at = stop
    if at < len(text) or not at:
        yield at, len(text), at, len(text)


def _field(texts: Sequence[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[list[Span]]:
    """The field's spans of each whole text, its parts, whole, about FIELD characters at a time."""
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, int, int, int, str]] = []

    def flush() -> None:
        for (row, start, first, last, _), spans in zip(held, field_spans([h[4] for h in held], model), strict=True):
            out[row] += [(kind, a + start, b + start) for kind, a, b in spans if first <= a + start < last]
        held.clear()

    size = 0
    for row, text in enumerate(texts):
        for start, end, first, last in parts_of(text or ""):
            held.append((row, start, first, last, (text or "")[start:end]))
            size += end - start + 64
            if size >= FIELD:
                flush()
                size = 0
    flush()
    return out


def find(texts: Sequence[str | None], model: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    for text, more in zip(texts, _field(texts, model), strict=True):
        base = base_spans(text or "")
        yield base, all_spans(base, more)


def redacted(text: str, spans: Sequence[Span]) -> str:
    """The text with every run of overlapping spans replaced by [KIND] of its first one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _said(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans) of every whole text.

    The counts and base_spans are of the fixed patterns; spans also has what the field adds.
    Spans are kind:start:end in code points, end exclusive, by kind and start, joined by
    commas. Null and empty texts have none; rows with a null or repeated id are kept; other
    columns are not read. A map over the scan.
    """
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, spans string"
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_spans", "spans"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = list(find(texts, model))
            columns = [batch.column(0), *[pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS],
                       pa.array([_said(b) for b, _ in found], pa.string()), pa.array([_said(s) for _, s in found], pa.string())]
            yield pa.record_batch(columns, names=names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(each), schema)


def replace(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with the spans in their texts replaced; all other columns as they are, null texts too."""
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [None if t is None else redacted(t, s) for t, (_, s) in zip(texts, find(texts, model), strict=True)]
            yield batch.set_column(at, text_col, pa.array(new, pa.string()))

    return docs.mapInArrow(tidy(each), docs.schema)


def trained(spark: SparkSession, n: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """The field trained from the labelled table, ``n`` rows."""
    rows = [(r.text, [tuple(s) for s in r.spans]) for r in labelled_table(spark, n).collect()]  # bounded by n
    return train(rows)
