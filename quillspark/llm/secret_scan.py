"""Secret scan: known shapes, and a battery of randomness tests with false-discovery control.

Base spans are three regular expressions. Beyond them, a candidate is a maximal run of 20
or more characters of one inferred encoding (decimal, hexadecimal, base32, base36, base62,
base64, base64url) that mixes digits and letters. A run of their characters is cut at inner
equals signs (those at its end are padding), and a part that no alphabet holds is cut into its maximal parts of
base64 and of base64url, which may overlap; each is tested. Three tests of randomness over its
symbols -- chi-squared uniformity over bins of the alphabet, Wald-Wolfowitz runs about the
alphabet's middle, and lag-1 serial correlation -- are combined by Fisher's method. Ordinary
identifiers are far from random; a random secret is not.

Which candidates are rejected as random is a weighted Benjamini-Hochberg decision over all
candidates of the corpus (weight in proportion to the information a candidate of its length
can carry, so short ones, whose tests are weak, need more evidence to be dismissed), and
bounds the share of true secrets among the dismissed. What is not dismissed is a secret.

Plan: one pass counts p-values in a fixed number of bins (partial aggregation; a bounded table reaches
the driver), a second marks spans. Both are scans without a shuffle of texts. Nothing
depends on a key, so skew costs nothing.

Defined results: null and empty texts have no spans; repeated rows are scanned each; an
empty table gives no rows; all input columns are kept, ``spans`` excepted, which is replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import caches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: In lower case, one of these is in every text that ASSIGN matches in.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")

MIN_LENGTH, MIN_BITS, LEVEL = 20, 80.0, 0.05
BINS = 3000  # of -log10(p), a hundredth each

#: Alphabets in order of their symbols; the smallest that holds a run is its encoding.
ALPHABETS = tuple(
    (name, {c: i for i, c in enumerate(symbols)})
    for name, symbols in (
        ("decimal", "0123456789"),
        ("hex", "0123456789abcdef"),
        ("HEX", "0123456789ABCDEF"),
        ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
        ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
        ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ))

#: Parts between inner equals signs; in a part that mixes both kinds of signs, what either alphabet holds.
_parts = re.compile(r"[^=]+(?:=+$)?").finditer
_SIDES = (re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*"))

_HEX, _RUN, _DIGIT, _ALPHA = 1, 2, 4, 8
_CLASS = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    _s = chr(_c) if _c < 128 else ""
    _CLASS[_c] = (_HEX * bool(_s and _s in "0123456789abcdef") | _RUN * bool(_s and (_s.isalnum() or _s in "+/_-="))
                  | _DIGIT * _s.isdigit() | _ALPHA * _s.isalpha())


def infer(run: str) -> tuple[str, np.ndarray] | None:
    """The encoding's name and the symbols' values."""
    body = run.rstrip("=")
    for name, index in ALPHABETS:
        values = [index.get(c, -1) for c in body]
        if values and min(values) >= 0:
            return name, np.array(values, dtype=np.float64)
    return None


def encoded(run: str) -> list[tuple[int, int]]:
    """The maximal parts of ``run`` of one encoding, in order; none lies within another."""
    out = []
    for m in _parts(run):
        a, b = m.span()
        part = run[a:b].rstrip("=")
        if not (("+" in part or "/" in part) and ("-" in part or "_" in part)):
            out.append((a, b))
            continue
        held = sorted({(a + x.start(), a + x.end()) for side in _SIDES for x in side.finditer(run[a:b])}, key=lambda s: (s[0], -s[1]))
        end = -1
        for s, e in held:
            if e > end:
                out.append((s, e))
                end = e
    return [(s, e) for s, e in out if e - s >= MIN_LENGTH]


def _upper_chi2(x: float, df: int) -> float:
    """Wilson and Hilferty's normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(values: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation, if the symbols are random."""
    n = len(values)
    bins = max(2, min(size, n // 4))
    edges = np.arange(bins + 1) * size / bins
    share = np.diff(np.ceil(edges)) / size
    seen = np.bincount(np.minimum((values * bins / size).astype(int), bins - 1), minlength=bins)
    uniform = _upper_chi2(float(((seen - n * share) ** 2 / (n * share)).sum()), bins - 1)
    high = values >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        runs_p = _two_sided((runs - mean) / math.sqrt(var))
    else:
        runs_p = 2.0 ** (1 - n)
    d = values - values.mean()
    total = float((d * d).sum())
    serial = _two_sided((float((d[1:] * d[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total > 0 else 0.0
    return uniform, runs_p, serial


def weighted_p(run: str) -> float | None:
    """Fisher's combination of the battery over the weight of the run's length; None: no candidate."""
    found = infer(run)
    if found is None:
        return None
    name, values = found
    size = len(dict(ALPHABETS)[name])
    bits = len(values) * math.log2(size)
    if len(values) < MIN_LENGTH or bits < MIN_BITS:
        return None
    x = -2 * sum(math.log(max(p, 1e-300)) for p in battery(values, size))
    h = x / 2
    p = math.exp(-h) * (1 + h + h * h / 2) if h < 700 else 0.0  # chi-squared, 6 degrees
    return min(1.0, p * 160.0 / bits)


def _runs(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[float, int, int]]]:
    """Base spans, and candidates with their weighted p; code points, end exclusive."""
    raw = text.encode("utf-8", "surrogatepass")
    kind = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    place = (lambda i: i) if len(raw) == len(text) else (lambda i: len(raw[:i].decode("utf-8", "surrogatepass")))
    base = []
    lower = text.lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    runs = _runs(kind & _RUN != 0, MIN_LENGTH)
    if runs:
        base += [("hex", place(a), place(b)) for a, b in _runs(kind & _HEX != 0, 24)]
    candidates = []
    for a, b in [(a + s, a + e) for a, b in runs for s, e in encoded(raw[a:b].decode())]:
        part = kind[a:b]
        if (part & _DIGIT).any() and (part & _ALPHA).any() and (p := weighted_p(raw[a:b].decode())) is not None:
            start, end = place(a), place(b)
            if not any(s < end and start < e for _, s, e in base):
                candidates.append((p, start, end))
    return sorted(base, key=lambda s: (s[1], KINDS.index(s[0]))), candidates


def bin_of(p: float) -> int:
    return min(BINS - 1, int(-math.log10(max(p, 1e-30)) * 100))


def dismissal_bin(counts: dict[int, int], level: float = LEVEL) -> int:
    """Benjamini-Hochberg over binned p: candidates in this bin or beyond are dismissed."""
    total, beyond, cut = sum(counts.values()), 0, BINS
    for b in sorted(counts, reverse=True):
        beyond += counts[b]
        if 10 ** (-b / 100) * total <= level * beyond:  # the bin's largest p
            cut = b
    return cut


def _bins():
    @F.pandas_udf("array<int>")
    def bins(text: pd.Series) -> pd.Series:
        caches.claim("secret_scan")
        return pd.Series([[bin_of(p) for p, _, _ in scan_text(t)[1]] for t in text])

    return bins


def _spans(cut: int):
    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(text: pd.Series) -> pd.Series:
        caches.claim("secret_scan")
        out = []
        for t in text:
            base, candidates = scan_text(t)
            found = base + [("random", s, e) for p, s, e in candidates if bin_of(p) < cut]
            out.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))])
        return pd.Series(out)

    return spans


def scan_secrets(docs: DataFrame, text: str = "text", level: float = LEVEL) -> DataFrame:
    """All rows with ``spans``: kind, start, end, sorted by start, then kind."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = docs.select(F.explode(_bins()(whole)).alias("bin")).groupBy("bin").count()
    cut = dismissal_bin({r["bin"]: r["count"] for r in found.collect()}, level)  # at most BINS rows
    return docs.drop("spans").withColumn("spans", _spans(cut)(whole))


def redact(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span in the text by ``<kind>``; where spans overlap, the first one's kind stands."""
    whole = F.col(f"`{text}`")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(s: Column, p: Column) -> Column:
        gap = F.substr(whole, (s["at"] + 1).cast("int"), F.greatest(p["start"] - s["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.when(p["start"] >= s["at"], F.concat(s["out"], F.array(gap, F.concat(F.lit("<"), p["kind"], F.lit(">"))))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], p["end"]).alias("at"))

    done = F.aggregate("spans", start, step, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substr(whole, (s["at"] + 1).cast("int"))))
    return scanned.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(whole))
