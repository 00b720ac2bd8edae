"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
#: Runs of token characters that hold every access key and hex run that counts.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Modules whose names are the labelled sample of names in code.
MODULES = ("argparse", "ast", "asyncio", "collections", "concurrent.futures", "configparser", "csv", "datetime", "decimal", "email.message", "functools", "http.client", "http.server", "importlib.machinery", "inspect", "io", "json", "logging.handlers", "multiprocessing.pool", "os", "pathlib", "socketserver", "sqlite3", "ssl", "string", "subprocess", "tarfile", "threading", "traceback", "typing", "unittest", "unittest.mock", "urllib.request", "xml.dom.minidom", "xml.sax.handler", "zipfile")
#: Shortest run the models judge, the mean log ratio a character from which it is a secret, documents and longest
#: text from which ordinary identifiers are taken, random strings that are drawn.
MIN_RUN, THRESHOLD, SAMPLE, SAMPLE_BYTES, DRAWN = 20, 0.5, 2000, 16_384, 20_000


@dataclass(frozen=True)
class MarkovModel:
    """Log ratio of each step from a character (row; the last row is the start) to the next."""

    ratio: np.ndarray

    def score(self, run: str) -> float:
        at = _index(run)
        return float(self.ratio[np.concatenate(([len(ALPHABET)], at[:-1])), at].mean()) if len(at) else 0.0


_PLACE = np.full(256, -1, np.int64)
_PLACE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def _index(run: str) -> np.ndarray:
    return _PLACE[np.frombuffer(run.encode("latin-1"), np.uint8)]


def _steps(strings: list[str], smoothing: float) -> np.ndarray:
    n = len(ALPHABET)
    counts = np.full((n + 1, n), smoothing)
    for s in strings:
        at = _index(s)
        np.add.at(counts, (np.concatenate(([n], at[:-1])), at), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def train(secrets: list[str], ordinary: list[str], smoothing: float = 0.5) -> MarkovModel:
    """Models of both labelled samples; characters outside the alphabet end a string before they come here."""
    return MarkovModel(_steps(secrets, smoothing) - _steps(ordinary, smoothing))


def random_strings(n: int = DRAWN, seed: int = 7) -> list[str]:
    """Labelled sample of secrets: draws from the alphabets that keys use, always the same."""
    draw = random.Random(seed)
    kinds = (ALPHABET[:62], ALPHABET[:64], "0123456789abcdef", ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62])
    return ["".join(draw.choices(kinds[i % len(kinds)], k=draw.randint(20, 64))) for i in range(n)]


def identifiers(texts: list[str], seed: int = 7) -> list[str]:
    """Labelled sample of ordinary identifiers: the words of texts (without what the patterns find), alone, in capitals
    and joined as in code and paths."""
    draw, out = random.Random(seed), []
    for t in texts:
        for _, a, b in reversed(base_spans(t)):
            t = t[:a] + " " + t[b:]
        w = [x for x in re.findall("[A-Za-z]+", t) if len(x) < 40]
        out += w
        for i in range(0, len(w) - 3, 3):
            out.append(draw.choice(("_", "-", "/", "")).join(x if draw.random() < 0.5 else x.capitalize() for x in w[i : i + 3]) + draw.choice(("", "", "1", "2024", "=")))
        out += [x.upper() for x in w[::7]]
    return out


def code_words(fold: int | None = None, held_out: bool = False) -> list[str]:
    """Words of the names in MODULES and of their classes' attributes, in lower case and in order; with a fold, those
    whose crc32 modulo 5 is that number (held_out) or is not."""
    names = set()
    for m in map(import_module, MODULES):
        for name in dir(m):
            names |= {name, *dir(getattr(m, name))} if isinstance(getattr(m, name), type) else {name}
    words = sorted({w.lower() for n in names for w in re.findall("[A-Z]?[a-z]+|[A-Z]+(?![a-z])", n) if 2 < len(w) < 20})
    return [w for w in words if fold is None or (zlib.crc32(w.encode()) % 5 == fold) == held_out]


def code_names(words: list[str], n: int = DRAWN, seed: int = 7) -> list[str]:
    """Labelled sample of names as code has them, of two to six words each, and of dates, counts and digits in order."""
    draw, out = random.Random(seed), []
    for i in range(n):
        w = draw.choices(words, k=draw.randint(2, 6))
        style = i % 8
        if style < 2:
            out.append("".join(x.capitalize() for x in w))
        elif style == 2:
            out.append(w[0] + "".join(x.capitalize() for x in w[1:]))
        elif style == 3:
            out.append("_".join(w) + draw.choice(("", "", "_1", "_v2", "=")))
        elif style == 4:
            out.append("_".join(w).upper())
        elif style == 5:
            out.append(draw.choice("-/+").join(w))
        elif style == 6:
            day = lambda: f"{draw.randint(1970, 2039)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}"
            out.append("-".join([day(), *(f"{draw.randint(0, 59):02}" for _ in range(draw.randint(0, 3))), day()]))
        else:
            a, step = draw.randrange(10), draw.choice((0, 1, 1, 9))
            out.append("".join(str((a + step * j) % 10) for j in range(draw.randint(20, 40))))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns match, by start and kind; a match that is too short is dropped, and
    what it covers is not looked at again for that kind."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in RUN.finditer(text):
        if "AKIA" in run[0]:
            out += [(1, run.start() + m.start(), run.start() + m.end()) for m in ACCESS.finditer(run[0]) if len(m[0]) >= 16]
        if len(run[0]) >= 32:
            out += [(2, run.start() + m.start(), run.start() + m.end()) for m in HEX.finditer(run[0]) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], s[0]))


def random_parts(run: str, model: MarkovModel, threshold: float) -> list[tuple[int, int]]:
    """(start, end) of what looks random in run: all of it, or else the rows of pieces between = and / whose steps lie
    most above the threshold (all maximal ones, in one pass), of MIN_RUN or more characters."""
    if len(run) < MIN_RUN:
        return []
    if model.score(run) >= threshold:
        return [(0, len(run))]
    edge = [0, *sorted({x for m in re.finditer("[=/]+", run) for x in m.span()} - {0, len(run)}), len(run)]
    if len(edge) < 3:
        return []
    at = _index(run)
    total = np.concatenate(([0.0], np.cumsum(model.ratio[np.concatenate(([len(ALPHABET)], at[:-1])), at] - threshold)))
    held: list[tuple[int, int]] = []
    for a, b in zip(edge, edge[1:]):
        while total[b] > total[a]:
            j = len(held) - 1
            while j >= 0 and total[held[j][0]] >= total[a]:
                j -= 1
            if j < 0 or total[held[j][1]] >= total[b]:
                held.append((a, b))
                break
            a = held[j][0]
            del held[j:]
    return [(a, b) for a, b in held if b - a >= MIN_RUN and model.score(run[a:b]) >= threshold]


def all_spans(text: str, model: MarkovModel, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """The base spans, and what looks random of the runs outside of them."""
    base = base_spans(text)
    more = []
    for run in RUN.finditer(text):
        a, end = run.span()
        for x, y in sorted((x, y) for _, x, y in base if x < end and a < y) + [(end, end)]:
            more += [(3, a + p, a + q) for p, q in random_parts(text[a:x], model, threshold)]
            a = max(a, y)
    return sorted(base + more, key=lambda s: (s[1], s[0])) if more else base


def sample_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rows: int = SAMPLE, most: int = SAMPLE_BYTES) -> list[str]:
    """Whole texts of the first rows documents by md5 of the id with 1 to most bytes: rows * most bytes at most."""
    some = docs.filter(F.octet_length(text).between(1, most)).select(F.col(id_column).alias("i"), F.col(text).alias("t"))
    order = F.md5(F.col("i").cast("string"))
    # Ids first, so that tasks send only those of their first rows, and texts only of ids that are in.
    ids = some.select("i").orderBy(order, "i").limit(rows).distinct().withColumnRenamed("i", "_i")
    some = some.join(F.broadcast(ids), F.col("i").eqNullSafe(F.col("_i")), "left_semi")
    return [r["t"] for r in some.orderBy(order, "i", "t").limit(rows).collect()]


def scan(docs: DataFrame, model: MarkovModel, id_column: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) of each row; spans: array of (kind, start, end), code points, end exclusive, by start and kind.

    Null text is empty and has no spans; null ids and repeated rows stay; other columns are not read; no rows give no
    rows. Texts of any length are scanned whole, one at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one table of the alphabet's size squared
    kind = dict(docs.dtypes)[id_column]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in all_spans(x.as_py() or "", shared.value, threshold)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int>>")


def op10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scan(docs, train(random_strings(), identifiers(sample_texts(docs)) + code_names(code_words())))
    said = lambda which: f"concat_ws(',', transform({which}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    count = lambda k: F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS bigint) AS n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.expr(said("filter(spans, s -> s.kind <> 'markov')")), 256).alias("base_sha256"), F.expr(said("spans")).alias("spans"))
