"""Personal data (operator 2) by DataFrame functions only.

Base spans come from fixed patterns with checks. Beyond them, candidate spans (names, national telephone numbers,
social security numbers, account numbers) are put to three labelers: the *shape* of the span (regular expressions), a
*gazetteer* of first names, prefixes and countries, and the *context* before it. Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is for each kind; its posteriors are the training labels of a logistic
span classifier, whose features are the votes and what the labelers do not see: the characters on either side, the length,
the place in its line, the word behind, the mix of its characters. It decides every candidate.

One pass over the corpus finds all spans and candidates and writes those (no texts) to the shared folder. Patterns of votes
and features are counted over the whole corpus; a pattern has at most ``8 * product of FEATURES`` forms a kind, whatever the
corpus, and only their counts reach the driver. The classifier is applied as a Column expression to what was written.

Patterns are written so that Java's matcher neither recurses nor restarts inside a run: quantified groups are
possessive, and a run is entered at its start (or where the last match ended). Spans of a text are found from the lengths
of the pieces between matches in running sums over chunks, and overlaps by merging sorted spans, so the work grows with the
text, not with the square of its matches.

Spans are kind:start:end in code points, the end exclusive, by kind and then start. A candidate that overlaps a base span,
or a candidate of an earlier kind (whether that is taken or not), is left out; of names that overlap the one that the
classifier scores higher stays, else the first. Cases: a null or empty text has no spans; repeated rows are treated alike;
an empty table gives an empty result; without candidates the labelers' prior reliabilities hold. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import table, written

_LOCAL = "[A-Za-z0-9._%+-]"
#: Base kinds in order, and patterns equivalent to the plain ones in the module's contract.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Kinds of candidates. Each two neighbours of a run of capitalised words are a candidate: the match takes the first
#: word, its group is the whole name.
EXTRA = {
    "tel": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![\p{L}\p{N}'-])(?!(?:Dear|Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora|Hello|Hi|The|From|To|By)\x20)(?=(\p{Lu}\p{Ll}++\x20\p{Lu}\p{Ll}++)(?![\p{L}\p{N}'-]))\p{Lu}\p{Ll}++",
}
#: First names, country codes of account numbers, and words of context.
FIRST_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Daniel Matthew Anthony"
    " Mark Paul Steven Andrew Peter Anna Emma Laura Maria Julia Sophie Marie Pierre Jean Jacques Michel Philippe Nicolas Claire Camille Hans Klaus Jürgen Wolfgang Stefan"
    " Andreas Martin Petra Sabine Monika Ursula Carlos Juan José Luis Miguel Antonio Francisco Carmen Ana Isabel Lucía Pablo Diego Alice Bob Kevin Brian George Edward Jane"
).split()
COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split()
CONTEXT = {
    "tel": "phone|tel|call|fax|mobile|cell|contact|telefon|handy|téléphone|teléfono|appel",
    "ssn": "ssn|social security|social|security number|tax id",
    "iban": "iban|account|konto|compte|cuenta|bank|transfer",
    "name": r"\bmr\b|\bmrs\b|\bms\b|\bdr\b|name|\bi am\b|dear|contact|regards|sincerely|signed|herr|frau|madame|monsieur|señor|author|patient|customer",
}
LOOK_BACK = 40
_SPAN = "array<struct<start:bigint,end:bigint,text:string>>"
#: Items that ``scanned`` goes through before it puts their results aside.
CHUNK = 256


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with x evaluated once."""
    return F.transform(F.array(x), then)[0]


def scanned(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(state, item)`` gives for each item: (next state, array of results), the results joined.

    An array is copied whole when something is added to it; results are gathered by chunks, so a list of n items costs
    about n * CHUNK / 2 copies and not n * n / 2.
    """
    none = F.array().cast(out)

    def add(acc: Column, item: Column) -> Column:
        next_, made = step(acc["state"], item)
        return F.struct(next_.alias("state"), F.concat(acc["out"], made).alias("out"))

    def chunks(every: Column) -> Column:
        def one(acc: Column, k: Column) -> Column:
            own = F.aggregate(F.slice(every, k * CHUNK + 1, CHUNK), F.struct(acc["state"].alias("state"), none.alias("out")), add)
            return let(own, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        start = F.struct(state.alias("state"), F.array().cast(f"array<{out}>").alias("out"))
        last = F.floor((F.size(every) - 1) / CHUNK).cast("int")
        return F.when(F.size(every) > 0, F.flatten(F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), start, one, lambda acc: acc["out"]))).otherwise(none)

    return let(items, chunks)


def positions(text: Column, pattern: str, group: int = 0) -> Column:
    """Start, end and text of all matches, or of their ``group``, which starts where the match does.

    The pieces between matches give the places of matches.
    """
    every = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), every(0).alias("match"), every(group).alias("span"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"]).cast("long")
        span = F.struct(start.alias("start"), (start + F.length(x["span"]).cast("long")).alias("end"), x["span"].alias("text"))
        return F.when(x["match"].isNull(), start).otherwise(start + F.length(x["match"]).cast("long")), F.when(x["match"].isNull(), F.array().cast(_SPAN)).otherwise(F.array(span))

    return scanned(both, F.lit(0).cast("long"), _SPAN, step)


#: Characters of a block of text.
BLOCK = 1024


def blocks_of(text: Column) -> Column:
    """A text cut into blocks: finding a place in a string takes time in proportion to the string."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start (included) to end (not included, and not beyond the last) of a text in blocks."""
    first, last = F.floor(start / BLOCK).cast("int"), F.least(F.floor((end - 1) / BLOCK).cast("int"), F.size(blocks) - 1)

    def part(k: Column) -> Column:
        a = F.greatest(start - k * BLOCK, F.lit(0))
        return F.substr(blocks[k], (a + 1).cast("int"), (end - k * BLOCK - a).cast("int"))

    return F.when((end > start) & (last >= first), F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise("")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc: Column, k: Column) -> Column:
        d = F.substr(digits, -k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s))


def _valid(kind: str, span: Column) -> Column:
    x = span["text"]
    if kind == "ip":
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(x, r"\."), lambda p: small(p) & (F.substr(p, F.lit(-3), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(x))
        return F.when(n.between(16, 19), luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def base(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with one array of spans for each base kind."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = {}
    for kind, pattern in BASE.items():
        guard = F.contains("text", F.lit(NEEDS[kind])) & F.col("text").rlike(pattern) if kind in NEEDS else F.col("text").rlike(pattern)
        found[kind] = _checked(kind, F.when(guard, positions(F.col("text"), pattern)).otherwise(F.array().cast(_SPAN)))
    return out.withColumns(found)


#: What the classifier sees beside the votes, and how many values each has.
FEATURES = {"before": 3, "after": 4, "size": 4, "behind": 4, "mixed": 2}
_VOTES = "shape:int,gazetteer:int,context:int"
_EXTRA = f"array<struct<kind:string,start:bigint,end:bigint,{_VOTES},{','.join(f'{n}:int' for n in FEATURES)}>>"


def candidates(found: DataFrame) -> DataFrame:
    """Adds ``extra``: candidate spans with their kind, the votes of the three labelers and the classifier's features."""
    named = {f"{kind}_": F.when(F.col("text").rlike(pattern), positions(F.col("text"), pattern, int(kind == "name"))).otherwise(F.array().cast(_SPAN)) for kind, pattern in EXTRA.items()}
    out = found.withColumns(named)
    out = out.withColumn("_blocks", F.when(sum((F.size(k) for k in named), F.lit(0)) > 0, blocks_of(F.col("text"))).otherwise(F.array().cast("array<string>")))
    votes, earlier = [], [F.col(k) for k in BASE]
    for kind in EXTRA:
        own = F.col(f"{kind}_")
        votes.append(F.when(F.size(own) > 0, _voted(kind, _clear(own, F.flatten(F.array(*earlier))))).otherwise(F.array().cast(_EXTRA)))
        earlier.append(own)
    return out.withColumn("extra", F.flatten(F.array(*votes))).drop(*named, "_blocks")


def _clear(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others: none that began earlier reaches them, and none begins before their end."""
    both = "array<struct<start:bigint,end:bigint,own:boolean,text:string>>"
    shape = lambda own: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s["text"].alias("text"))
    ordered = F.array_sort(F.concat(F.transform(others, shape(False)), F.transform(spans, shape(True))))
    keep = lambda s, ok: F.when(ok, F.array(s)).otherwise(F.array().cast(both))
    # Of equal starts others come in any order: the way back sees those that the way there did not.
    there = scanned(ordered, F.lit(0).cast("long"), both, lambda end, s: (F.when(s["own"], end).otherwise(F.greatest(end, s["end"])), keep(s, ~s["own"] | (s["start"] >= end))))
    back = scanned(F.reverse(there), F.lit(2**62).cast("long"), both, lambda start, s: (F.when(s["own"], start).otherwise(F.least(start, s["start"])), keep(s, s["own"] & (s["end"] <= start))))
    left = F.transform(F.reverse(back), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    return let(others, lambda o: F.when(F.size(o) == 0, spans).otherwise(left))


def _voted(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *_votes(kind, s), *_features(kind, s)))


def _features(kind: str, span: Column) -> list[Column]:
    at = lambda a, b: between(F.col("_blocks"), a, b)
    before = at(F.greatest(span["start"] - 1, F.lit(0)), span["start"])
    after, rest = at(span["end"], span["end"] + 1), F.ltrim(at(span["end"], span["end"] + 12))
    limits = {"tel": (12, 13, 14), "ssn": (10, 11, 12), "iban": (18, 22, 27), "name": (10, 13, 17)}[kind]
    size = F.length(span["text"])
    mixed = span["text"].rlike(r"[^\x00-\x7F]") if kind == "name" else span["text"].rlike(r"([0-9A-Z])\1\1")
    found = {
        "before": F.when(before.isin("", "\n"), 0).when(before.isin(" ", "\t"), 1).otherwise(2),
        "after": F.when(after.isin("", "\n"), 0).when(after.isin(" ", "\t"), 1).when(after.isin(*",.;:!?)"), 2).otherwise(3),
        "size": sum((F.when(size > n, 1).otherwise(0) for n in limits), F.lit(0)),
        "behind": F.when(rest.rlike(r"^\p{Ll}"), 0).when(rest.rlike(r"^\p{Lu}"), 1).when(rest.rlike(r"^[0-9]"), 2).otherwise(3),
        "mixed": mixed.cast("int"),
    }
    return [found[n].cast("int").alias(n) for n in FEATURES]


def _votes(kind: str, span: Column) -> list[Column]:
    x = span["text"]
    digits = _digits(x)
    if kind == "tel":
        shape, known = ~F.substr(digits, F.lit(1), F.lit(1)).isin("0", "1"), ~F.substr(digits, F.lit(4), F.lit(1)).isin("0", "1")
    elif kind == "ssn":
        shape, known = ~F.substr(digits, F.lit(1), F.lit(3)).isin("000", "666") & (F.substr(digits, F.lit(4), F.lit(2)) != "00"), F.substr(digits, F.lit(1), F.lit(1)) != "9"
    elif kind == "iban":
        shape, known = F.length(F.replace(x, F.lit(" "))).between(15, 34), F.substr(x, F.lit(1), F.lit(2)).isin(*COUNTRIES)
    else:
        shape, known = F.forall(F.split(x, " "), lambda w: F.length(w) >= 3), F.split(x, " ")[0].isin(*FIRST_NAMES)
    from_ = F.greatest(span["start"] - LOOK_BACK, F.lit(0))
    before = F.lower(between(F.col("_blocks"), from_, span["start"]))
    # (?U): a word boundary knows letters beyond ASCII.
    return [v.cast("int").alias(n) for n, v in (("shape", shape), ("gazetteer", known), ("context", before.rlike(f"(?U){CONTEXT[kind]}")))]


#: Prior of each labeler: votes for a true span and for a false one, as counts, so that scarce data change little.
PRIOR = {"shape": ((18, 2), (10, 10)), "gazetteer": ((14, 6), (3, 17)), "context": ((12, 8), (2, 18))}
#: Prior of a candidate being true, as counts: a free-standing number of the right shape is likelier than a name.
PRIOR_TRUE = {"tel": (8, 12), "ssn": (12, 8), "iban": (12, 8), "name": (2, 18)}
LABELERS = tuple(PRIOR)


#: What a candidate shows: its kind, the votes and the features.
Pattern = tuple
_COLUMNS = (*LABELERS, *FEATURES)
#: Strength with which the classifier's weights are held at zero, as counts: of votes hardly, of features more.
HELD = {"vote": 0.01, "feature": 10.0}


@dataclass(frozen=True)
class Classifier:
    """Of each kind the bias and the weights of votes and of each feature's values.

    ``reliability[kind][labeler]`` = (votes for among true, votes for among false).
    """

    bias: dict[str, float]
    weight: dict[tuple[str, str], float]
    values: dict[tuple[str, str], list[float]]
    reliability: dict[str, dict[str, tuple[float, float]]]

    def score(self, span: Column) -> Column:
        out = F.lit(None).cast("double")
        for k in EXTRA:
            own = F.lit(self.bias[k])
            for name in LABELERS:
                own = own + F.lit(self.weight[k, name]) * span[name]
            for name in FEATURES:
                own = own + F.element_at(F.array(*map(F.lit, self.values[k, name])), span[name] + 1)
            out = F.when(span["kind"] == k, own).otherwise(out)
        return out


def _posterior(kind: str, votes: tuple[int, ...], share: dict, sure: dict) -> float:
    yes, no = share[kind], 1 - share[kind]
    for name, v in zip(LABELERS, votes, strict=True):
        true, false = sure[kind][name]
        yes *= true if v else 1 - true
        no *= false if v else 1 - false
    return yes / (yes + no)


def estimate(counts: dict[Pattern, int], rounds: int = 200) -> tuple[dict, dict]:
    """EM over vote patterns: the share of true candidates of each kind, and the reliability of each labeler for it.

    The priors are counts beside the corpus's, so the more data there are the less they weigh. A labeler votes for a true
    span at least as often as for a false one: that keeps the two classes from changing places.
    """
    share = {k: a / (a + b) for k, (a, b) in PRIOR_TRUE.items()}
    sure = {k: {n: (t[0] / sum(t), f[0] / sum(f)) for n, (t, f) in PRIOR.items()} for k in EXTRA}
    votes: dict[tuple, int] = {}
    for p, n in counts.items():
        votes[p[: 1 + len(LABELERS)]] = votes.get(p[: 1 + len(LABELERS)], 0) + n
    for _ in range(rounds):
        post = {p: _posterior(p[0], p[1:], share, sure) for p in votes}
        for k in EXTRA:
            own = {p: n for p, n in votes.items() if p[0] == k}
            yes, every = sum(n * post[p] for p, n in own.items()), sum(own.values())
            a, b = PRIOR_TRUE[k]
            share[k] = (yes + a) / (every + a + b)
            for j, name in enumerate(LABELERS, 1):
                (t1, t0), (f1, f0) = PRIOR[name]
                true = (sum(n * post[p] * p[j] for p, n in own.items()) + t1) / (yes + t1 + t0)
                false = (sum(n * (1 - post[p]) * p[j] for p, n in own.items()) + f1) / (every - yes + f1 + f0)
                sure[k][name] = (true, false) if true >= false else ((true + false) / 2,) * 2
    return share, sure


def fit(counts: dict[Pattern, int], rounds: int = 200) -> Classifier:
    """EM, then for each kind a logistic classifier of votes and features, trained on the posteriors by Newton's method.

    Every possible pattern of votes, without features, is one more training row, so scarce data follow the priors.
    """
    share, sure = estimate(counts, rounds)
    starts = dict(zip(FEATURES, np.cumsum([1 + len(LABELERS), *FEATURES.values()]).tolist()))
    width = 1 + len(LABELERS) + sum(FEATURES.values())
    held = np.array([1e-3] + [HELD["vote"]] * len(LABELERS) + [HELD["feature"]] * sum(FEATURES.values()))
    bias, weight, values = {}, {}, {}
    for k in EXTRA:
        rows = [(p[1:], n) for p, n in counts.items() if p[0] == k and n]
        votes = [v for v in product((0, 1), repeat=len(LABELERS))]
        x = np.zeros((len(votes) + len(rows), width))
        x[:, 0] = 1
        x[: len(votes), 1 : 1 + len(LABELERS)] = votes
        y, n = np.array([_posterior(k, v, share, sure) for v in votes] + [0.0] * len(rows)), np.ones(len(x))
        for i, (pattern, count) in enumerate(rows, len(votes)):
            own = pattern[: len(LABELERS)]
            x[i, 1 : 1 + len(LABELERS)] = own
            for name, value in zip(FEATURES, pattern[len(LABELERS) :], strict=False):
                x[i, starts[name] + value] = 1
            y[i], n[i] = _posterior(k, own, share, sure), count
        w = np.zeros(width)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (y - p)) - held * w
            bend = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(held)
            step = np.linalg.solve(bend, slope)
            w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        bias[k] = float(w[0])
        weight |= {(k, name): float(v) for name, v in zip(LABELERS, w[1:], strict=False)}
        values |= {(k, name): [float(v) for v in w[starts[name] : starts[name] + size]] for name, size in FEATURES.items()}
    return Classifier(bias, weight, values, sure)


def vote_counts(found: DataFrame) -> dict[Pattern, int]:
    """How often each pattern of votes and features occurs among the candidates of the corpus (``extra``)."""
    # The outer form: for the inner one the optimiser would filter by the array's size and so search every text twice.
    rows = found.select(F.explode_outer("extra").alias("e")).select("e.*").where("kind IS NOT NULL").groupBy("kind", *_COLUMNS).count().collect()
    return {(r["kind"], *(r[n] for n in _COLUMNS)): r["count"] for r in rows}


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, an array of spans for each base kind, and ``extra``, the candidates."""
    return candidates(base(docs))


def decided(found: DataFrame, model: Classifier) -> DataFrame:
    """``found`` with ``added``, the candidates that the classifier takes, instead of ``extra``."""
    taken = F.filter("extra", lambda s: model.score(s) > 0)
    names = _of_kind("name", taken)
    scored = F.transform(names, lambda s: F.struct(s.alias("s"), model.score(s).alias("score")))

    # Names in order: the last one taken gives way to one that overlaps it and scores higher.
    def step(last: Column, x: Column) -> tuple[Column, Column]:
        free = last["s"].isNull() | (last["s"]["end"] <= x["s"]["start"])
        put = F.when(free & last["s"].isNotNull(), F.array(last["s"])).otherwise(F.array().cast(_EXTRA))
        return F.when(free | (x["score"] > last["score"]), x).otherwise(last), put

    none = F.lit(None).cast(f"struct<s:{_EXTRA[6:-1]},score:double>")
    # One more item pushes out the last name.
    end = F.array(F.struct(F.named_struct(*[v for n, t in [("kind", "string"), ("start", "bigint"), ("end", "bigint"), *[(c, "int") for c in _COLUMNS]] for v in (F.lit(n), F.lit(2**62).cast(t) if n in ("start", "end") else F.lit(None).cast(t))]).alias("s"), F.lit(0.0).alias("score")))
    chosen = scanned(F.concat(scored, end), F.struct(none["s"].alias("s"), none["score"].alias("score")), _EXTRA, step)
    out = found.withColumn("_taken", taken)
    chosen_names = let(F.col("_taken"), lambda _: chosen)
    return out.withColumn("added", F.when(F.size(F.filter("_taken", lambda s: s["kind"] == "name")) > 1, F.concat(F.filter("_taken", lambda s: s["kind"] != "name"), chosen_names)).otherwise(F.col("_taken"))).drop("extra", "_taken")


def find(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, text, an array of spans for each base kind, and ``added``: the candidates that the classifier takes."""
    return decided(spans(docs), model)


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _of_kind(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in BASE]
    spotted = written(spans(table(spark, sf_dir, "documents")).select("doc_id", *bare, "extra"), "spans")
    found = decided(spotted, fit(vote_counts(spotted)))
    plain = F.flatten(F.array(*[_written(k, F.col(k)) for k in BASE]))
    added = F.flatten(F.array(*[_written(k, _of_kind(k, F.col("added"))) for k in EXTRA]))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.size("added").cast("long").alias("n_added"),
        plain.alias("plain"),
        added.alias("more"),
    ).select("doc_id", *[f"n_{k}" for k in BASE], "n_added", F.sha2(F.array_join("plain", ","), 256).alias("base_sha256"), F.array_join(F.concat("plain", "more"), ",").alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """doc_id and text with each span of ``find`` replaced by its kind in brackets; spans that overlap go together under the first one."""
    def shape(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.concat(*map(shape, BASE), F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        put = F.array(between(F.col("_blocks"), at, s["start"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.greatest(at, s["end"]), F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(put)

    cut = found.withColumn("_blocks", blocks_of(F.col("text"))).withColumn("_cut", scanned(F.array_sort(every), F.lit(0).cast("long"), "array<string>", step))
    at = F.coalesce(F.array_max(F.transform(every, lambda s: s["end"])), F.lit(0))
    return cut.select("doc_id", F.concat(F.array_join("_cut", ""), F.substr("text", (at + 1).cast("int"))).alias("text"))
