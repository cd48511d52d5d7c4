"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

Three patterns give the base spans. Further candidates are all other runs of 24 or
more characters of an encoding, letters or digits alone included; the smallest known
alphabet that holds a run is its encoding. Three tests ask whether its symbols look drawn at random:
chi-squared uniformity over the alphabet, the Wald-Wolfowitz runs test about the
alphabet's middle, and lag-one serial correlation. Fisher's method combines them.

Which runs are cleared as not random is decided for the whole corpus by
Benjamini-Hochberg, apart for each length band (powers of two), since short runs
can show little and would else be judged by what long ones show. The candidates
that are not cleared are secrets. The procedure works on p-values rounded up to
1/50 of a power of ten, so it needs only counts by band and step.

Everything is DataFrame functions. Texts are looked through once: what is found is
written, the limits are counted from it, and both are read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.storage import written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
#: Shortest run that the tests judge.
MIN_RUN = 24
RUN = rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}"
HINT = rf"(?i:password|passwd|secret|token|api_?key)|{ACCESS}|{HEX}|{RUN}"

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by pattern, smallest alphabet first, with the alphabet in value order.
ENCODINGS = [
    (r"^[0-9]+$", _DIGITS),
    (r"^[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    (r"^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    (r"^[a-z]+$", _LOWER),
    (r"^[A-Z]+$", _UPPER),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[a-z0-9]+$", _DIGITS + _LOWER),
    (r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    (r"^[A-Za-z]+$", _UPPER + _LOWER),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    (r"^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
]
#: Steps of a p-value: 50 for each power of ten, down to 1e-300.
STEPS, LAST_STEP = 50, 15_000
_BLOCK = 256
_SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"
_RUNS = "array<struct<start:bigint,end:bigint,band:int,step:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, wherever lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _sums_before(values: Column) -> Column:
    """For each element the sum of those before it, by blocks of 256."""

    def of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, _BLOCK))
        return _let(blocks, lambda bs: _let(F.transform(bs, _total), lambda sums: F.flatten(
            F.transform(bs, lambda block, b: _let(_total(F.slice(sums, 1, b)), lambda base:
                F.transform(block, lambda _, i: base + _total(F.slice(block, 1, i))))))))

    return F.when(F.size(values) > 0, _let(values, of)).otherwise(F.array().cast("array<bigint>"))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in
    code points; ``value`` is the given group."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))
    gaps = F.split(text, pattern, -1)
    return _let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda whole: _let(
        F.zip_with(lengths(F.slice(gaps, 1, F.size(whole))), lengths(whole), lambda g, m: g + m), lambda both: F.zip_with(
            F.arrays_zip(_sums_before(both).alias("a"), both.alias("b"), whole.alias("w")),
            F.regexp_extract_all(text, F.lit(pattern), group),
            lambda z, v: F.struct((z["a"] + z["b"] - F.length(z["w"])).alias("start"), (z["a"] + z["b"]).alias("end"), v.alias("value")))))


def _long_enough(least: int):
    return lambda m: F.length(m["value"]) >= least


def _span(rank: int):
    return lambda m: F.struct(m["start"], F.lit(rank).alias("rank"), m["end"])


def _base_spans(text: Column) -> Column:
    """The base spans, by start, then kind."""
    parts = []
    for rank, (pattern, group, least) in enumerate([(ASSIGN, 1, 8), (ACCESS, 0, 16), (HEX, 0, 32)]):
        kept = F.filter(_found(text, pattern, group), _long_enough(least))
        spans = F.transform(kept, _span(rank))
        parts.append(F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS)).cast(_SPANS))
    return F.array_sort(F.concat(*parts))


def _upper_tail(value: Column) -> Column:
    """P(Z > z) of the standard normal distribution (Abramowitz and Stegun 26.2.17)."""

    def poly(t: Column) -> Column:
        return t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))

    def of(z: Column) -> Column:
        tail = _let(1 / (1 + 0.2316419 * F.abs(z)), poly) * F.exp(-z * z / 2) * 0.3989422804014327
        return _let(tail, lambda p: F.when(z >= 0, p).otherwise(1 - p))

    return _let(value, of)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _uniform_p(s: Column) -> Column:
    """Chi-squared test, by Wilson and Hilferty's cube root."""
    df = s["k"] - 1
    chi = F.greatest(s["squares"] * s["k"] / s["n"] - s["n"], F.lit(0.0))
    return _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))


def _runs_p(s: Column) -> Column:
    mean = 2 * s["high"] * (s["n"] - s["high"]) / s["n"] + 1

    def of(m: Column) -> Column:
        spread = (m - 1) * (m - 2) / (s["n"] - 1)
        return _let(spread, lambda v: F.when(v <= 0, F.lit(0.0)).otherwise(_two_sided((s["runs"] - m) / F.sqrt(F.greatest(v, F.lit(1e-9))))))

    return _let(mean, of)


def _serial_p(s: Column) -> Column:
    z = (s["cov"] / F.greatest(s["var"], F.lit(1e-9)) + 1 / s["n"]) * F.sqrt(s["n"])
    return F.when(s["var"] <= 0, F.lit(0.0)).otherwise(_two_sided(z))


def randomness(run: Column) -> Column:
    """Combined p-value of a run being random in its encoding; small for ordinary text."""
    alphabet = F.lit(_UPPER + _LOWER + _DIGITS + "+/-_")
    for pattern, symbols in reversed(ENCODINGS):
        alphabet = F.when(run.rlike(pattern), F.lit(symbols)).otherwise(alphabet)

    def coded(s: Column) -> Column:
        values = F.transform(F.split(s["run"], ""), lambda c: F.instr(s["alphabet"], c).cast("double") - 1)
        middle = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
        return _let(values, lambda v: F.struct(
            v.alias("v"), middle(v).alias("middle"), (F.length(s["alphabet"]) / F.lit(2.0)).alias("half")))

    def measured(s: Column) -> Column:
        v, middle, half = s["v"], s["middle"], s["half"]
        n = F.size(v)
        zero = F.lit(0.0)
        pairs = F.zip_with(F.slice(v, 1, n - 1), F.slice(v, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        squares = F.aggregate(F.array_distinct(v), zero, lambda a, x: a + F.pow(F.size(F.filter(v, lambda y: y == x)), F.lit(2.0)))
        return _let(pairs, lambda ps: F.struct(
            n.cast("double").alias("n"), (half * 2).alias("k"), squares.alias("squares"),
            F.size(F.filter(v, lambda x: x >= half)).cast("double").alias("high"),
            (1 + F.size(F.filter(ps, lambda p: (p["a"] >= half) != (p["b"] >= half)))).alias("runs"),
            F.aggregate(v, zero, lambda a, x: a + (x - middle) * (x - middle)).alias("var"),
            F.aggregate(ps, zero, lambda a, p: a + (p["a"] - middle) * (p["b"] - middle)).alias("cov")))

    def combined(s: Column) -> Column:
        ln = lambda p: F.ln(F.greatest(p, F.lit(1e-100)))
        half = -(ln(_uniform_p(s)) + ln(_runs_p(s)) + ln(_serial_p(s)))
        return _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return _let(_let(_let(F.struct(run.alias("run"), alphabet.alias("alphabet")), coded), measured), combined)


def _candidates(text: Column, base: Column) -> Column:
    """Runs to test, apart from the base spans: start, end, length band, p-value step."""

    def tested(m: Column) -> Column:
        length = F.length(m["value"])
        step = F.least(F.lit(LAST_STEP), F.floor(-F.log10(F.greatest(randomness(m["value"]), F.lit(1e-300))) * STEPS))
        return F.struct(m["start"], m["end"], F.floor(F.log2(length)).cast("int").alias("band"), step.cast("int").alias("step"))

    apart = lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    found = F.transform(F.filter(_found(text, RUN), apart), tested)
    return F.when(text.rlike(RUN), found).otherwise(F.array().cast(_RUNS)).cast(_RUNS)


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with a column ``__scan`` of base spans and tested runs."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    both = _let(_base_spans(body), lambda base: F.struct(base.alias("base"), _candidates(body, base).alias("runs")))
    empty = F.struct(F.array().cast(_SPANS).alias("base"), F.array().cast(_RUNS).alias("runs"))
    return docs.withColumn("__scan", F.when(body.rlike(HINT), both).otherwise(empty))


def cleared_steps(scanned: DataFrame, level: float) -> DataFrame:
    """(band, least): runs of a band whose p-value step is at least ``least`` are
    cleared by Benjamini-Hochberg at ``level``; bands that clear none are missing."""
    steps = (
        scanned.where(F.size("__scan.runs") > 0)
        .select(F.explode("__scan.runs").alias("r"))
        .groupBy("r.band", "r.step")
        .agg(F.count("*").alias("n"))
    )
    # one row for each band and step: at most 15,001 a band
    whole, above = Window.partitionBy("band"), Window.partitionBy("band").orderBy(F.desc("step"))
    ranked = steps.select("band", "step", F.sum("n").over(above).alias("upto"), F.sum("n").over(whole).alias("all"))
    passing = F.pow(F.lit(10.0), -F.col("step") / STEPS) <= level * F.col("upto") / F.col("all")
    return ranked.where(passing).groupBy("band").agg(F.min("step").alias("least"))


def scan(docs: DataFrame, text: str = "text", level: float = 0.05) -> DataFrame:
    """``docs`` with a struct column ``__secrets``: ``base`` and ``spans``, arrays of
    (start, rank, end), rank in ``KINDS``, by start, then rank; code points, end exclusive.

    Null texts have no span. Found runs never overlap base spans. Repeated rows
    count as often as they occur. The per-band limits are at most a few dozen
    rows, one for each power of two in length, and are broadcast.
    """
    scanned = written(_scanned(docs, text), "scanned")
    limits = cleared_steps(scanned, level)
    table = limits.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("band", "least"))).alias("__limits"))
    kept = F.filter("__scan.runs", lambda r: ~(r["step"] >= F.coalesce(F.try_element_at("__limits", r["band"]), F.lit(LAST_STEP + 1))))
    extra = F.transform(kept, lambda r: F.struct(r["start"], F.lit(3).alias("rank"), r["end"])).cast(_SPANS)
    joined = scanned.join(F.broadcast(table))  # one row
    spans = F.when(F.size("__scan.runs") == 0, F.col("__scan.base")).otherwise(F.array_sort(F.concat("__scan.base", extra)))
    return joined.withColumn("__secrets", F.struct(F.col("__scan.base").alias("base"), spans.alias("spans"))).drop("__scan", "__limits")


def spans_text(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"], s["end"])), ",")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """``text`` with each group of overlapping spans replaced by ``mark``; null stays null."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        more = F.array(F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["parts"], more)).otherwise(a["parts"]).alias("parts"),
        )

    rest = lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(F.col(text))
