"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from evidex.llm.common import CHUNK, codepoints, grouped, segments, tidy

DIMENSIONS = 1024
SEED = 20_011
FOLDS = 5
#: Columns of n-grams that are multiplied at a time.
WIDTH = 4096
#: Letters from which on a cosine tells a learned language from noise, and held-out rows that a floor needs.
LETTERS, FLOOR_ROWS = 32, 100
_LETTERS: dict[tuple[int, int], np.ndarray] = {}
_IS_LETTER: list[np.ndarray] = []


def letter_vector(symbol: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The random vector of -1 and 1 of a code point; 0 stands for the gap between words."""
    if (symbol, dimensions) not in _LETTERS:
        draw = np.random.default_rng([SEED, symbol]).integers(0, 2, dimensions, dtype=np.int8)
        _LETTERS[symbol, dimensions] = (2 * draw - 1).astype(np.int8)
    return _LETTERS[symbol, dimensions]


def is_letter() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _IS_LETTER[0]


def bundle(texts: Sequence[str], owner: np.ndarray, owners: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Sum, per owner, of the vectors of all letter trigrams of its texts (owners x dimensions).

    Text is lowered; anything but letters is one gap, which also stands at both ends. A trigram
    abc is the product of a rotated by two, b by one and c.
    """
    out = np.zeros((owners, dimensions), np.float32)
    lowered = [f" {t} ".lower() for t in texts]
    code = codepoints("".join(lowered))
    if not len(code):
        return out
    text = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    symbol = np.where(is_letter()[code], code, 0)
    keep = symbol > 0
    keep[1:] |= (symbol[:-1] > 0) | (text[1:] != text[:-1])
    keep[0] = True
    symbol, text = symbol[keep], text[keep]
    same = text[2:] == text[:-2]
    alphabet = np.flatnonzero(np.bincount(symbol))
    number = np.zeros(int(alphabet[-1]) + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    s, n = number[symbol], len(alphabet)
    gram = ((s[:-2] * n + s[1:-1]) * n + s[2:])[same]
    who = owner[text[:-2][same]]
    if not len(gram):
        return out
    if n ** 3 <= 1 << 22:
        found = np.flatnonzero(np.bincount(gram, minlength=n ** 3))
        place = np.zeros(n ** 3, np.int64)
        place[found] = np.arange(len(found))
        column = place[gram]
    else:
        found, column = np.unique(gram, return_inverse=True)
    vectors = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    two, one = np.roll(vectors, 2, 1), np.roll(vectors, 1, 1)
    for low in range(0, len(found), WIDTH):
        part = found[low:low + WIDTH]
        grams = (two[part // (n * n)] * one[part // n % n] * vectors[part % n]).astype(np.float32)
        mine = (column >= low) & (column < low + WIDTH) if len(found) > WIDTH else slice(None)
        counts = np.bincount(who[mine] * len(part) + column[mine] - low, minlength=owners * len(part))
        out += counts.reshape(owners, len(part)).astype(np.float32) @ grams
    return out


def bundled(parts: Sequence[tuple[int, str]], owners: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """``bundle`` of (owner, part of a text) pairs, a chunk at a time, so a long text costs no more memory than a short one."""
    out = np.zeros((owners, dimensions))
    held: list[tuple[int, str]] = []
    size = 0
    for k, part in enumerate(parts):
        held.append(part)
        size += len(part[1])
        if size >= CHUNK or k + 1 == len(parts):
            out += bundle([p for _, p in held], np.array([o for o, _ in held]), owners, dimensions)
            held, size = [], 0
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language prototypes: the bundle of all texts of a language, over all rows with text and language.

    Each task sends one vector per language; their sums of whole numbers are exact, whatever
    the order. What comes to the driver is a vector per language.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, held in grouped(texts):
                names = sorted(set(langs[first:first + len(held)]))
                index = {name: k for k, name in enumerate(names)}
                parts = [(index[langs[first + k]], p) for k, t in enumerate(held) for p in segments(t)]
                for name, vector in zip(names, bundled(parts, len(names), dimensions), strict=True):
                    sums[name] = sums.get(name, 0) + vector
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["lang", "vector"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    parts = rows.mapInArrow(tidy(each), "lang string, vector array<double>")
    summed = parts.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for lang, at, value in summed.collect():  # dimensions x languages
        out.setdefault(lang, np.zeros(dimensions))[at] = value
    return out


def annotate(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns: the prototype of the largest cosine with the text's bundle, and that cosine.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned. The cosine is
    not taken below 0; equal cosines go to the name that sorts first. All rows and columns are
    kept; ``names`` must not be among them. Texts of over half a million characters are
    bundled part by part, cut between words. A map over the rows: no shuffle.
    """
    langs = sorted(prototypes)
    matrix = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in langs]).T if langs else None
    dimensions = len(matrix) if langs else DIMENSIONS
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found, scores = ([], []) if langs else (["und"] * len(texts), [0.0] * len(texts))
            for _, held in grouped(texts) if langs else ():
                parts = [(k, p) for k, t in enumerate(held) for p in segments(t)]
                bundles = bundled(parts, len(held), dimensions)
                cosine = bundles @ matrix / np.maximum(np.linalg.norm(bundles, axis=1), 1e-300)[:, None]
                best = cosine.argmax(1)
                letters = {k for k, p in parts if is_letter()[codepoints(p)].any()}
                found += [langs[best[k]] if k in letters else "und" for k in range(len(held))]
                scores += [min(1.0, max(0.0, float(cosine[k, best[k]]))) if k in letters else 0.0 for k in range(len(held))]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(tidy(each), StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def letters(text_col: str = "text"):
    """The number of letters of a text, 0 for null."""
    return F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\P{L}+", ""))


def floor(held: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang") -> float:
    """The cosine below which a text of at least LETTERS letters is in no learned language.

    It is the least one of the rows of ``held`` that have a language and as many letters, which
    must not have been learned from, and at most three standard deviations of the cosine of
    unrelated vectors. 0, which rejects nothing, where fewer than FLOOR_ROWS such rows are there.
    """
    if not prototypes:
        return 0.0
    rows = held.filter(F.col(lang_col).isNotNull() & (letters(text_col) >= LETTERS)).select(F.col(text_col).alias("text"))
    n, least = annotate(rows, prototypes).agg(F.count(F.lit(1)), F.min("score")).first()
    noise = 3 / np.sqrt(len(next(iter(prototypes.values()))))
    return min(least, float(noise)) if n >= FLOOR_ROWS else 0.0


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text, see ``annotate``.

    Only id and text are read; rows with a null or repeated id are kept.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return annotate(rows, prototypes).drop("text")


def held_out(id_col: str = "doc_id", folds: int = FOLDS):
    """True for the ids that no prototype is learned from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0
