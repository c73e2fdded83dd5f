"""Secret scans (operator 5): fixed patterns, then character Markov models of random strings and ordinary identifiers.

Two bigram models over the characters of a candidate are trained from labelled samples: strings labelled *random*
(keys as generators make them) and strings labelled *ordinary* (identifiers, paths and words joined as people join
them). Runs of characters of ``[A-Za-z0-9+/_=-]`` are parted where a span of the fixed patterns lies. A run of at least
``MIN_RUN`` characters that holds a digit and a letter is a secret of kind ``random`` if the log-likelihood ratio per
character exceeds ``THRESHOLD``. Else its stretches between any two of ``/ = _ -`` (or its ends) are judged in the same
way, those with the greatest sum of ratios above the threshold first, so a key behind a path or a name is found.

Both the training samples and the model are small and fixed: ``samples`` makes them by rule from a seed. They can be
replaced by any labelled strings through ``train``.

Spans are in code points, the end exclusive. Cases: a null or empty text has no spans; an empty table gives an empty
result; repeated rows are scanned each, and so is a text of any length, whole. Columns other than doc_id and text are not
read by ``scan`` and pass through ``stage``. Runs of fewer than ``MIN_RUN`` characters are not judged: what a key of that
length would add over chance is less than the threshold asks for.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import parts, table, tidy

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{32,}", re.ASCII)
MIN_RUN = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}", re.ASCII)
THRESHOLD = 0.9
#: An identifier by convention, not judged in parts.
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", re.ASCII)
SEPARATORS = re.compile(r"[/=_-]+", re.ASCII)
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def samples(seed: int = 7, n: int = 6000) -> list[tuple[str, bool]]:
    """Labelled strings: (text, is random)."""
    rng = random.Random(seed)
    hexes, letters = "0123456789abcdef", ALPHABET[:62]
    kinds = [hexes, hexes.upper(), letters, letters + "+/", letters + "-_", letters[26:62], letters[:26] + letters[52:62]]
    out = [("".join(rng.choices(rng.choice(kinds), k=rng.randint(20, 64))), True) for _ in range(n)]
    # Ordinary words by rule: syllables of consonant clusters and vowels, joined as in identifiers, paths and versions.
    onset = "b c d f g h j k l m n p r s t v w x y z bl br ch cl cr dr fl fr gl gr kn ph pf pl pr qu sc sch sh sp st str th tr tz wh zw".split()
    vowel, coda = "a e i o u ai au ea ee ei eu ie io oe oo ou ue y".split(), ["", "", "", "n", "r", "s", "t", "l", "d", "m", "nt", "st", "ng", "ck", "ch", "rt", "ld", "hn", "hl", "x", "z", "by", "ung", "tion", "ment", "er", "able"]
    word = lambda: "".join(rng.choice(onset) + rng.choice(vowel) + rng.choice(coda) for _ in range(rng.randint(1, 3)))
    for _ in range(n):
        words = [word() for _ in range(rng.randint(2, 7))]
        if rng.random() < 0.6:
            words.insert(rng.randint(1, len(words)), str(rng.randint(0, 10 ** rng.randint(1, 4))))
        style = rng.randint(0, 5)
        joined = ["_".join(words), "-".join(words), "/".join(words), "".join(w.capitalize() for w in words), "_".join(w.upper() for w in words), "".join(words)][style]
        out.append((joined, False))
        if rng.random() < 0.1:
            out.append((rng.choice("=-_0123456789") * rng.randint(20, 60), False))
            out.append(("".join(str(rng.randint(1, 99)).zfill(2) for _ in range(rng.randint(10, 16))), False))
    return out


@dataclass(frozen=True)
class Model:
    """Log ratio of each pair of characters (and of each first character): random against ordinary."""

    pair: np.ndarray
    first: np.ndarray

    def ratio(self, text: str) -> float:
        code = _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
        return float(self.first[code[0]] + self.pair[code[:-1], code[1:]].sum()) / len(code)


def train(labelled: Iterable[tuple[str, bool]]) -> Model:
    """Bigram models with add-a-half smoothing towards each model's unigrams."""
    k = len(ALPHABET) + 1
    pair, first = np.zeros((2, k, k)), np.zeros((2, k))
    for text, is_random in labelled:
        code = _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
        first[int(is_random), code[0]] += 1
        np.add.at(pair[int(is_random)], (code[:-1], code[1:]), 1)
    single = (pair.sum(1) + 1) / (pair.sum((1, 2))[:, None] + k)
    smooth = (pair + 20 * single[:, None, :]) / (pair.sum(2, keepdims=True) + 20)
    start = (first + 20 * single) / (first.sum(1, keepdims=True) + 20)
    return Model(np.log(smooth[1] / smooth[0]), np.log(start[1] / start[0]))


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    out: list[Span] = []
    low = text.lower() if text.isascii() else None
    if low is None or "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _holds_both(run: str) -> bool:
    return any(c.isdigit() for c in run) and any(c.isalpha() for c in run)


def _stretch(run: str, model: Model) -> tuple[int, int] | None:
    """The stretch between separators with the greatest sum of ratios above the threshold, of those that count."""
    between = [m.span() for m in SEPARATORS.finditer(run)]
    starts = np.array([0, *[b for _, b in between if b < len(run)]])
    ends = np.array([*[a for a, _ in between if a], len(run)])
    code = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
    upto = np.concatenate([[0, 0], np.cumsum(model.pair[code[:-1], code[1:]])]) - THRESHOLD * np.arange(len(run) + 1)
    gain = model.first[code[starts]] - upto[starts + 1] - THRESHOLD
    # A stretch starts at or before the last letter and the last digit in front of its end, and MIN_RUN before it.
    at = np.arange(len(run))
    last = [np.maximum.accumulate(np.where(kind, at, -1)) for kind in (code < 52, (code >= 52) & (code < 62))]
    latest = np.minimum(np.minimum(last[0], last[1])[ends - 1], ends - MIN_RUN)
    n = np.searchsorted(starts, latest, side="right")
    ends, n = ends[n > 0], n[n > 0]
    if not len(ends):
        return None
    most = np.maximum.accumulate(gain)
    sums = upto[ends] + most[n - 1]
    k = int(np.argmax(sums))
    # Of equal sums the latest start, so that the stretch is the shortest.
    return (int(starts[np.flatnonzero(gain[: n[k]] == most[n[k] - 1])[-1]]), int(ends[k])) if sums[k] > 0 else None


def random_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    out: list[Span] = []
    for m in RUN.finditer(text):
        if not _holds_both(m[0]):
            continue
        todo, at = [], m.start()
        for _, a, b in base:
            if a < m.end() and m.start() < b:
                todo.append((at, a))
                at = max(at, b)
        todo.append((at, m.end()))
        while todo:
            a, b = todo.pop()
            run = text[a:b]
            if b - a < MIN_RUN or not _holds_both(run):
                continue
            if model.ratio(run) > THRESHOLD:
                out.append(("random", a, b))
            elif not UUID.fullmatch(run) and (found := _stretch(run, model)):
                out.append(("random", a + found[0], a + found[1]))
                todo += [(a, a + found[0]), (a + found[1], b)]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of a text."""
    base = base_spans(text or "")
    return base, sorted(base + random_spans(text or "", base, model), key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlaps together) replaced by ``[SECRET]``."""
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, text, base) of every document."""
    model = model or train(samples())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("base", pa.bool_())]))
        for batch in parts(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = find(text, model)
                known = set(base)
                rows.append([{"kind": s[0], "start": s[1], "end": s[2], "text": text[s[1] : s[2]], "base": s in known} for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,text:string,base:boolean>>")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its secrets replaced by ``[SECRET]`` and n_chars, where there is one, counted anew."""
    model = train(samples())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            old = batch.column("text").to_pylist()
            new = [redacted(t, find(t, model)[1]) for t in old]
            changed = {"text": new}
            if "n_chars" in batch.schema.names:
                changed["n_chars"] = [n if a is b else len(b) for a, b, n in zip(old, new, batch.column("n_chars").to_pylist(), strict=True)]
            for name, values in changed.items():
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
