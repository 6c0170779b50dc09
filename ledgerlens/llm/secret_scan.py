"""Secret scan: three fixed patterns and a battery of randomness tests.

The patterns give the base spans. Besides, runs of encoding characters are cut at '=' and at the
edges of base spans, and in each piece every longest stretch of 20 or more characters that one
alphabet holds is a candidate. Its encoding is the smallest alphabet that holds it, and its digits
in that alphabet are tested for randomness: chi-squared uniformity, runs about the median, and
serial correlation. The score is the Bonferroni-combined p-value of "this is random". Stretches
without a letter and of one repeated character are no candidates. Accepted candidates that overlap
(a token and the path around it) are joined to one span.

A natural string can pass the tests when it is short, so the least score is set for each
stratum (encoding, power of two of the length) by target-decoy control of the false-discovery
rate: a candidate's decoy is the same number of characters of that alphabet from the text around
its run, leaving out all runs that may hold candidates, so that in a list of secrets the next secret is no
decoy. A text of nothing but candidates gives no decoys; those of the stratum's other candidates then
stand for them in proportion. The least score is the smallest at which decoys are at most
`FALSE_DISCOVERIES` of the candidates that reach it. All candidates of all texts count.

Defined results: a null text counts as empty and has no spans; offsets count code points, ends
are exclusive; rows are judged one by one, so repeated rows repeat; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import small_batches, written

#: Fixed patterns: kind, pattern, and what a match needs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets in order of size; a candidate takes the first that holds its characters.
ALPHABETS = {"hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER,
             "BASE36": DIGITS + UPPER, "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/",
             "base64url": UPPER + LOWER + DIGITS + "-_"}
STRETCHES = [re.compile(f"[{re.escape(a)}]{{20,}}") for a in ALPHABETS.values()]
_VALUES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}

LEAST_P = 0.01
FALSE_DISCOVERIES = 0.05
BINS = 100


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches."""
    out = []
    folded = text.lower()
    if any(w in folded for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def infer_encoding(run: str) -> str | None:
    """The smallest alphabet of a run; None for runs without a letter or of one repeated character."""
    used = set(run)
    if len(used) < 2 or not used & set(LOWER + UPPER):
        return None
    return next((name for name, a in ALPHABETS.items() if used <= set(a)), None)


def randomness(values: list[int], k: int) -> float:
    """Bonferroni-combined p-value that digits below `k` are independent and uniform."""
    n = len(values)
    counts = [0] * k
    for v in values:
        counts[v] += 1
    chi = k / n * sum(c * c for c in counts) - n
    spread = math.sqrt(2 * (k - 1) * (n - 1) / n)
    p_uniform = _upper((chi - (k - 1)) / spread) if spread else 1.0

    high = [2 * v >= k for v in values]
    a = sum(high)
    b = n - a
    p_runs = 0.0
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0

    mu, sigma2 = (k - 1) / 2, (k * k - 1) / 12
    r = sum((x - mu) * (y - mu) for x, y in zip(values, values[1:], strict=False)) / sigma2
    p_serial = 2 * _upper(abs(r) / math.sqrt(n - 1))
    return min(1.0, 3 * min(p_uniform, p_runs, p_serial))


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uncovered(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that no base span covers."""
    out = []
    for s, _, e in base:
        if s < end and start < e:
            out.append((start, s))
            start = max(start, e)
    return [(s, e) for s, e in [*out, (start, end)] if e - s >= 20]


class Ground:
    """What lies outside the runs of encoding characters, from which decoys are drawn: it holds no candidate."""

    def __init__(self, text: str, runs: list[tuple[int, int]]):
        edges = [0, *[x for run in runs for x in run], len(text)]
        self._parts = [(edges[i], edges[i + 1]) for i in range(0, len(edges), 2)]
        self._text, self._of = text, {}

    def decoy(self, encoding: str, after: int, n: int) -> str | None:
        """The next `n` characters of the alphabet after a place in the text, then from its start; None if there are fewer."""
        if encoding not in self._of:
            value = _VALUES[encoding]
            places = [i for s, e in self._parts for i in range(s, e) if self._text[i] in value]
            self._of[encoding] = places, "".join([self._text[i] for i in places])
        places, letters = self._of[encoding]
        if len(letters) < n:
            return None
        at = bisect_left(places, after)
        return letters[at:at + n] + letters[:max(0, at + n - len(letters))]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """The candidates of a text by start, outer ones first."""
    out = []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    ground = Ground(text, runs)
    for run_start, run_end in runs:
        for piece in uncovered(run_start, run_end, base):
            found = {x.span() for stretch in STRETCHES for x in stretch.finditer(text, *piece)}
            for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
                run = text[start:end]
                encoding = infer_encoding(run)
                if encoding is None:
                    continue
                value = _VALUES[encoding]
                around = ground.decoy(encoding, run_end, len(run))
                out.append({"start": start, "end": end, "encoding": encoding, "band": len(run).bit_length(),
                            "score": randomness([value[c] for c in run], len(value)),
                            "decoy": None if around is None else randomness([value[c] for c in around], len(value))})
    return out


_SPAN = "array<struct<start: int, kind: int, end: int>>"
_CANDIDATE = "array<struct<start: int, end: int, encoding: string, band: int, score: double, decoy: double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, candidates) of each text, written: a few spans a document."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    candidate_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()),
                                         ("band", pa.int32()), ("score", pa.float64()), ("decoy", pa.float64())]))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                more.append(candidates(text, found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, base_type), pa.array(more, candidate_type)],
                                             names=["id", "base", "candidates"])

    return written(small_batches(slim).mapInArrow(spans, f"id {id_type}, base {_SPAN}, candidates {_CANDIDATE}"), "secrets")


def least_scores(scanned: DataFrame) -> DataFrame:
    """(encoding, band, least): one row a stratum in which any score is accepted."""
    each = scanned.select(F.explode("candidates").alias("c")).select("c.*")

    def binned(column: str, is_decoy: int) -> DataFrame:
        return each.where(F.col(column).isNotNull()).select(
            "encoding", "band", F.least(F.floor(F.col(column) * BINS), F.lit(BINS - 1)).alias("bin"), F.lit(is_decoy).alias("decoy"))
    counts = binned("score", 0).unionByName(binned("decoy", 1)).groupBy("encoding", "band", "bin").agg(
        F.sum("decoy").alias("decoys"), F.sum(1 - F.col("decoy")).alias("targets"))
    # at most BINS rows a stratum
    whole = Window.partitionBy("encoding", "band")
    share = F.sum("targets").over(whole) / F.greatest(F.sum("decoys").over(whole), F.lit(1))
    counts = counts.withColumn("decoys", F.col("decoys") * F.greatest(share, F.lit(1.0)))
    higher = Window.partitionBy("encoding", "band").orderBy(F.col("bin").desc())
    totals = counts.select("encoding", "band", "bin", F.sum("decoys").over(higher).alias("decoys"),
                           F.sum("targets").over(higher).alias("targets"))
    return (totals.where(F.col("decoys") <= FALSE_DISCOVERIES * F.col("targets")).groupBy("encoding", "band")
            .agg((F.min("bin") / BINS).alias("least")))


def _joined(spans, c):
    """Spans with a candidate that starts no earlier; what it overlaps grows, what holds it stays."""
    def span(start, end):
        return F.array(F.struct(start.alias("start"), F.lit(3).alias("kind"), end.alias("end")))
    last = F.try_element_at(spans, F.lit(-1))
    return (F.when(c["end"] <= last["end"], spans)
            .when(c["start"] < last["end"], F.concat(F.slice(spans, 1, F.size(spans) - 1), span(last["start"], c["end"])))
            .otherwise(F.concat(spans, span(c["start"], c["end"]))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: identifier and spans, array<struct<start, kind, end>> by start, then kind
    (0 assign, 1 access, 2 hex, 3 random)."""
    scanned = scan(docs, id_col, text_col)
    strata = {f"{r.encoding}/{r.band}": max(r.least, LEAST_P) for r in least_scores(scanned).collect()}  # 8 encodings, 31 bands
    least = F.create_map(*[F.lit(x) for kv in strata.items() for x in kv]) if strata else \
        F.lit(None).cast(T.MapType(T.StringType(), T.DoubleType()))

    def accepted(c):
        return F.coalesce(c["score"] >= F.try_element_at(least, F.concat(c["encoding"], F.lit("/"), c["band"].cast("string"))),
                          F.lit(False))
    random = F.aggregate(F.filter("candidates", accepted), F.array().cast(_SPAN), _joined)
    return scanned.select(F.col("id").alias(id_col), F.sort_array(F.concat("base", random)).alias("spans"))


def as_text(spans):
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
