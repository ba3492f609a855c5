"""Secret scanning with DataFrame functions only: known forms, and a randomness test battery.

Known forms are found by patterns. Other long runs of token letters are tested: the run's encoding
is inferred (hex, base32, base64), and three statistics are taken of its symbols: chi-squared against
a uniform alphabet, Wald-Wolfowitz runs about the middle of the alphabet, and lag-one serial
correlation. A run whose runs or serial statistic is far from chance is no random string. For the
others the hypothesis to reject is that the run is ordinary writing: there chi-squared is noncentral
and grows with the length, which gives a p value that takes the length into account. Benjamini and
Hochberg's step-up is then applied apart for each encoding and class of lengths, so that the many
short candidates do not decide about long ones. Only a histogram of p values leaves the tasks.

Positions are code points, end exclusive. Null texts are empty; repeated rows are done each on its
own; a table without candidates gives known forms only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featspan.llm.arrays import cut, pieces_of, running

#: The known forms, in the order in which spans of equal start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

RUN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: How much chi-squared of ordinary writing grows per symbol: size of the alphabet times the chance
#: that two of its symbols agree, less 1 (digits in hex; letters in the others).
EXCESS = {"hex": 0.6, "base32": 1.24, "base64": 3.5}
#: Least lengths of the classes that are controlled apart.
LENGTHS = (20, 32, 48, 64)
#: Deviations beyond which runs or serial correlation are far from chance.
ODD = 3.5
_SPANS = "array<struct<start:int,kind:int,end:int>>"
_TESTED = "array<struct<start:int,end:int,stratum:string,bin:int>>"
_PER_DECADE, _BINS = 20, 400


def _placed(text: Column, pattern: str, group: int = 0) -> Column:
    """Structs (start, end, found) of all matches; found is the text of ``group``."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(
        F.zip_with(whole, found, lambda w, f: F.struct(F.length(w).alias("size"), f.alias("found"))),
        F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.length),
        lambda m, gap: F.struct(gap.alias("gap"), m["size"].alias("size"), m["found"].alias("found")),
    )
    kind = "struct<start:int,end:int,found:string>"
    out = running(
        steps,
        F.lit(0),
        lambda at, s: at + s["gap"] + s["size"],
        lambda at, s: F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["size"]).alias("end"), s["found"].alias("found")),
        "int",
        kind,
    )
    # most texts have no match: one pass over the text decides
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(f"array<{kind}>"))


def known(text: Column) -> Column:
    """Spans of the known forms, by start and kind."""
    assign = F.filter(_placed(text, ASSIGN, 2), lambda s: F.length(s["found"]) >= 6)
    parts = [assign, _placed(text, ACCESS), _placed(text, HEX)]
    named = [
        F.transform(p, _as_kind(k)).cast(_SPANS) for k, p in enumerate(parts)
    ]
    return F.array_sort(F.concat(*named))


def _as_kind(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def _lower_tail(z: Column) -> Column:
    """Chance that a normal variate is below ``z``; Abramowitz and Stegun 26.2.17."""
    size = F.abs(z)
    t = 1 / (1 + 0.2316419 * size)
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = reduce(lambda acc, c: acc * t + c, reversed(terms), F.lit(0.0)) * t
    tail = poly * F.exp(-size * size / 2) * 0.3989422804014327
    return F.when(z < 0, tail).otherwise(1 - tail)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _by_encoding(encoding: Column, values: dict) -> Column:
    return F.when(encoding == "hex", values["hex"]).when(encoding == "base32", values["base32"]).otherwise(values["base64"])


def _more(**made: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Add fields to a struct; each step sees the fields of the steps before it as values."""

    def step(run: Column) -> Column:
        for name, of in made.items():
            run = run.withField(name, of(run))
        return run

    return step


def _symbols(run: Column) -> Column:
    folded = F.when(run["encoding"] == "hex", F.lower(run["found"])).otherwise(F.translate(run["found"], "-_", "+/"))
    letters = _by_encoding(run["encoding"], ALPHABETS)
    return F.transform(F.split(folded, ""), lambda c: F.instr(letters, c).cast("double") - 1)


def _pairs(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    """``of`` each value and the next one."""
    n = F.size(values) - 1
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), of)


def tested(text: Column) -> Column:
    """Structs (start, end, stratum, bin) of all candidate runs; a bin is a twentieth of a decade of p."""
    size = lambda r: reduce(lambda c, n: F.when(F.length(r["found"]) >= n, F.lit(n)).otherwise(c), LENGTHS, F.lit(0))
    steps = (
        _more(
            n=lambda r: F.length(r["found"]).cast("double"),
            size=size,
            encoding=lambda r: F.when(r["found"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
            .when(r["found"].rlike("^[A-Z2-7]+$"), F.lit("base32"))
            .otherwise(F.lit("base64")),
        ),
        _more(
            k=lambda r: _by_encoding(r["encoding"], {e: F.lit(float(len(a))) for e, a in ALPHABETS.items()}),
            excess=lambda r: _by_encoding(r["encoding"], {e: F.lit(x) for e, x in EXCESS.items()}),
            symbols=_symbols,
        ),
        _more(
            high=lambda r: F.transform(r["symbols"], lambda s: (s >= r["k"] / 2).cast("double")),
            centre=lambda r: _sum(r["symbols"]) / r["n"],
            squares=lambda r: _sum(
                F.transform(F.array_distinct(r["symbols"]), lambda d: F.pow(F.size(F.filter(r["symbols"], lambda s: s == d)), F.lit(2.0)))
            ),
        ),
        _more(
            ups=lambda r: _sum(r["high"]),
            changes=lambda r: _sum(_pairs(r["high"], lambda x, y: F.abs(x - y))),
            power=lambda r: _sum(F.transform(r["symbols"], lambda s: (s - r["centre"]) * (s - r["centre"]))),
            lagged=lambda r: _sum(_pairs(r["symbols"], lambda x, y: (x - r["centre"]) * (y - r["centre"]))),
        ),
        _more(mean=lambda r: 2 * r["ups"] * (r["n"] - r["ups"]) / r["n"] + 1, chi=lambda r: r["squares"] * r["k"] / r["n"] - r["n"]),
        _more(
            spread=lambda r: (r["mean"] - 1) * (r["mean"] - 2) / (r["n"] - 1),
            z=lambda r: (r["chi"] - (r["k"] - 1) - (r["n"] - 1) * r["excess"]) / F.sqrt(2 * (r["k"] - 1) + 4 * (r["n"] - 1) * r["excess"]),
        ),
        _more(
            # one value throughout has no runs and no correlation to speak of: no random string
            runs=lambda r: F.when(r["spread"] > 0, (r["changes"] + 1 - r["mean"]) / F.sqrt(r["spread"])).otherwise(F.lit(-99.0)),
            serial=lambda r: F.when(r["power"] > 0, (r["lagged"] / r["power"] + 1 / r["n"]) * F.sqrt(r["n"])).otherwise(F.lit(99.0)),
        ),
        _more(
            p=lambda r: F.when((F.abs(r["runs"]) > ODD) | (F.abs(r["serial"]) > ODD), F.lit(1.0)).otherwise(
                F.greatest(_lower_tail(r["z"]), F.lit(1e-300))
            )
        ),
    )
    runs = reduce(F.transform, steps, _placed(text, RUN))

    def result(r: Column) -> Column:
        bin_ = F.greatest(F.least(F.floor(-F.log10(r["p"]) * _PER_DECADE), F.lit(_BINS)), F.lit(0)).cast("int")
        stratum = F.concat(r["encoding"], F.lit("/"), r["size"].cast("string"))
        return F.struct(r["start"].alias("start"), r["end"].alias("end"), stratum.alias("stratum"), bin_.alias("bin"))

    return F.transform(runs, result).cast(_TESTED)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def discovery_bins(docs: DataFrame, rate: float = 0.05) -> dict[str, int]:
    """Per stratum the least bin that is a discovery at this false-discovery rate; strata without any are left out.

    The driver gets the histogram: at most 12 strata by 401 bins.
    """
    counts = docs.select(F.explode(tested(_text(docs))).alias("t")).groupBy("t.stratum", "t.bin").agg(F.count(F.lit(1)).alias("n"))
    by: dict[str, dict[int, int]] = {}
    for r in counts.collect():
        by.setdefault(r["stratum"], {})[r["bin"]] = r["n"]
    out = {}
    for stratum, bins in by.items():
        total, reached = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            reached += bins[b]
            if 10 ** (-b / _PER_DECADE) * total <= rate * reached:  # the largest p of the bin
                out[stratum] = b
    return out


def find(docs: DataFrame, bins: dict[str, int]) -> tuple[DataFrame, str, str]:
    """The documents with two more columns, known forms and all spans, both by start and kind; and their names.

    Discoveries that lie wholly in known forms are part of them and make no span of their own.
    """
    base, found = _unused(docs, "base"), _unused(docs, "found")
    text = _text(docs)
    out = docs.withColumn(base, known(text))
    if not bins:
        return out.withColumn(found, F.col(base)), base, found
    limits = F.create_map(*[F.lit(x) for kv in sorted(bins.items()) for x in kv])

    hits = F.filter(tested(text), lambda t: F.coalesce(t["bin"] >= limits[t["stratum"]], F.lit(False)))
    held = _unused(out, "hits")
    out = out.withColumn(held, F.transform(hits, _as_kind(3)).cast(_SPANS))
    # where there is nothing known there is nothing to compare with
    random = F.when((F.size(base) > 0) & (F.size(held) > 0), _not_within(F.col(held), F.col(base))).otherwise(F.col(held))
    return out.withColumn(found, F.array_sort(F.concat(F.col(base), random))).drop(held), base, found


def _covers(base: Column) -> Column:
    """Structs (start, end) of the stretches that spans, in order of their starts, cover without a gap."""
    grown = running(
        base,
        F.lit(-1),
        lambda end, s: F.greatest(end, s["end"]),
        lambda end, s: F.struct(s["start"].alias("start"), F.greatest(end, s["end"]).alias("end"), (s["start"] > end).alias("new")),
        "int",
        "struct<start:int,end:int,new:boolean>",
    )
    # from the back: the end of a stretch is that of its last span
    ended = running(
        F.reverse(grown),
        F.struct(F.lit(-1).alias("end"), F.lit(True).alias("new")),
        lambda later, s: F.struct(F.when(later["new"], s["end"]).otherwise(later["end"]).alias("end"), s["new"].alias("new")),
        lambda later, s: F.struct(s["start"].alias("start"), F.when(later["new"], s["end"]).otherwise(later["end"]).alias("end"), s["new"].alias("new")),
        "struct<end:int,new:boolean>",
        "struct<start:int,end:int,new:boolean>",
    )
    return F.filter(ended, lambda s: s["new"])


def _not_within(spans: Column, base: Column) -> Column:
    """The spans that do not lie wholly in a stretch covered by ``base``."""
    rows = "struct<start:int,kind:int,end:int>"
    stretches = F.transform(_covers(base), lambda s: F.struct(s["start"].alias("start"), F.lit(-1).alias("kind"), s["end"].alias("end")))
    both = F.array_sort(F.concat(stretches.cast(f"array<{rows}>"), spans))
    free = running(
        both,
        F.lit(-1),
        lambda end, s: F.when(s["kind"] < 0, s["end"]).otherwise(end),
        lambda end, s: F.when((s["kind"] >= 0) & (s["end"] > end), s),
        "int",
        rows,
    )
    return F.filter(free, lambda s: s.isNotNull())


def _unused(docs: DataFrame, name: str) -> str:
    """``name`` with so many underscores before it that no column has that name."""
    names = {c.lower() for c in docs.columns}
    while name in names:
        name = "_" + name
    return name


def listed(spans: str) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Counts and spans per document."""
    spans, base, found = find(docs.select("doc_id", "text"), discovery_bins(docs.select("text"), rate))

    def count(kind: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(found).alias("spans"),
    )


def redact(docs: DataFrame, rate: float = 0.05, mask: str = "[secret]") -> DataFrame:
    """Documents with every span (overlapping ones as one) replaced by ``mask``; n_chars follows if there is one."""
    spans, _, found = find(docs, discovery_bins(docs.select("text"), rate))
    parts = _unused(spans, "kept")
    pieces = pieces_of(F.col("text"))
    # what lies between the spans, then what follows the last one
    kept = running(
        F.col(found),
        F.lit(-1),
        lambda at, s: F.greatest(at, s["end"]),
        lambda at, s: F.when(s["start"] > at, cut(F.col(parts), F.greatest(at, F.lit(0)), s["start"])),
        "int",
        "string",
    )
    ends = F.array_max(F.transform(found, lambda s: s["end"]))
    masked = F.array_join(F.concat(F.filter(kept, lambda x: x.isNotNull()), F.array(cut(F.col(parts), ends, F.length("text")))), mask)
    out = spans.withColumn(parts, F.when(F.size(found) > 0, pieces))
    out = out.withColumn("text", F.when(F.size(found) > 0, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        same = F.size(found) == 0
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
