"""Secret scans: fixed patterns, and a randomness test battery for other strings.

Strings of 20 or more letters, digits and ``+/_-`` with a digit and a letter are
candidates, unless a pattern's span overlaps them (the demand for both loses a
random string of 20 characters in 3 % of cases, and fewer longer ones). Each is
tested in its inferred encoding (hex, base32, base36, base62,
base64) for randomness: chi-squared uniformity of its alphabet, runs about the
alphabet's middle, and lag-one serial correlation. Fisher's method makes one
p-value of the three. Random strings have p-values spread evenly over 0 to 1,
others small ones; so in each encoding and class of lengths, counted over the
whole corpus, the number of p-values above a half tells how many candidates are
random. The cut is the least p-value down to which the share of others among
what is reported stays within ``FALSE_SHARE``, and never under ``LEAST_P``.
Short strings, which the tests tell apart badly, thus get a cut of their own.

Everything is a column expression. Positions are code points, ends exclusive.

Defined results: null and empty texts have no spans; a candidate that overlaps a
pattern's span is none, so the cut is set by what the battery can add; repeated rows are scanned each; other columns
pass through ``redacted`` and are ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import staged, text_or_empty

#: Pattern kinds in the order they are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the narrowest; the first whose alphabet holds all of a string is inferred.
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Lower ends of the classes of lengths.
LENGTHS = (20, 24, 32, 40, 48, 64, 96, 128, 256)
BINS = 200
FALSE_SHARE = 0.1
LEAST_P = 0.001
#: Items of a text's list that are put together at a time.
CHUNK = 128

SPANS = "array<struct<kind:string,start:int,stop:int,found:string>>"


def _chunks(items: Column) -> Column:
    """A list in parts of ``CHUNK``: what is put together item by item is copied as often, so long lists are done by parts."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / CHUNK))), lambda c: F.slice(items, (c * CHUNK + 1).cast("int"), CHUNK))


def _running(chunks: Column, start: Column, step, of) -> Column:
    """(chunk, start) of each chunk: ``start`` taken on by ``step`` with what ``of`` makes of the chunks before."""
    starts = F.aggregate(
        chunks,
        F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, c: F.struct(step(acc["at"], of(c)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    return F.arrays_zip(chunks.alias("chunk"), starts.alias("start"))


def matches(text: Column, pattern: str, kind: str, guard: Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (kind, start, stop, found), found being a group's text.

    Spark's functions give the texts of matches and the texts between them;
    their lengths, added up, are the positions.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = lambda p: F.struct(F.length(p["between"]).alias("before"), F.length(p["whole"]).alias("long"), p["found"].alias("found"))
    parts = F.transform(F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("between"), whole.alias("whole"), found.alias("found")), lengths)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["before"] + x["long"])
    start = lambda acc, x: acc["at"] + x["before"]
    spans = lambda z: F.aggregate(
        z["chunk"],
        F.struct(z["start"].alias("at"), F.array().cast(SPANS).alias("out")),
        lambda acc, x: F.struct(
            (start(acc, x) + x["long"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), start(acc, x).alias("start"), (start(acc, x) + x["long"]).alias("stop"), x["found"].alias("found")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    every = F.flatten(F.transform(_running(_chunks(parts), F.lit(0), lambda at, n: at + n, total), spans))
    return F.when(guard, every).otherwise(F.array().cast(SPANS))


def pattern_spans(text: Column) -> list[Column]:
    """Spans of each pattern kind, in the order of ``KINDS``."""
    assigned = matches(text, ASSIGN, "assign", text.rlike(ASSIGN), 2)
    return [
        F.filter(assigned, lambda s: F.length(s["found"]) >= ASSIGN_LEAST),
        matches(text, ACCESS, "access", text.contains("AKIA") & text.rlike(ACCESS)),
        matches(text, HEX, "hex", text.rlike(HEX)),
    ]


def upper_tail(z: str) -> str:
    """SQL for the normal distribution's upper tail (Abramowitz and Stegun 7.1.26)."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2e0)))"
    half = f"(0.5e0 * {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{z} * {z} / 2e0))"
    return f"(CASE WHEN {z} < 0 THEN 1 - {half} ELSE {half} END)"


def _by_encoding(make, default: str = "NULL") -> str:
    return "CASE c.enc " + " ".join(f"WHEN '{name}' THEN {make(alphabet)}" for name, alphabet in ENCODINGS.items()) + f" ELSE {default} END"


def _half(alphabet: str) -> str:
    return "".join("01"[2 * i >= len(alphabet)] for i in range(len(alphabet)))


def with_tests(df: DataFrame, column: str) -> DataFrame:
    """Add to each candidate its encoding, length n, and p-value p (1: as random as can be)."""
    inferred = "CASE " + " ".join(f"WHEN translate(c.found, '{alphabet}', '') = '' THEN '{name}'" for name, alphabet in ENCODINGS.items()) + " END"
    alphabet, size = _by_encoding(lambda a: f"'{a}'"), _by_encoding(lambda a: f"{len(a)}e0")
    floor = "greatest(1e-15, {})"
    p_runs = f"CASE WHEN c.high = 0 OR c.high = c.n THEN pow(2e0, 1 - c.n) ELSE 2 * {upper_tail('c.z_runs')} END"
    steps = [
        f"named_struct('start', c.start, 'stop', c.stop, 'found', c.found, 'n', CAST(length(c.found) AS DOUBLE), 'enc', {inferred})",
        f"named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 'enc', c.enc, 'k', {size}, "
        f"'squares', aggregate(transform(sequence(1, length({alphabet})), j -> pow(c.n - length(replace(c.found, substr({alphabet}, j, 1), '')), 2)), 0e0, (a, v) -> a + v), "
        f"'bits', {_by_encoding(lambda a: f"translate(c.found, '{a}', '{_half(a)}')")}, "
        f"'x', transform(slice(split(c.found, ''), 1, length(c.found)), s -> CAST(instr({alphabet}, s) AS DOUBLE)))",
        "named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 'enc', c.enc, 'x', c.x, 'high', CAST(length(replace(c.bits, '0', '')) AS DOUBLE), "
        "'runs', CAST(length(regexp_replace(c.bits, '0+|1+', 'r')) AS DOUBLE), 'mean', aggregate(c.x, 0e0, (a, v) -> a + v) / c.n, "
        "'z_chi', (c.k / c.n * c.squares - c.n - (c.k - 1)) / sqrt(2 * (c.k - 1) * (c.n - 1) / c.n))",
        "named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 'enc', c.enc, 'high', c.high, 'z_chi', c.z_chi, 'runs', c.runs, 'expected', 2 * c.high * (c.n - c.high) / c.n + 1, "
        "'spread', aggregate(c.x, 0e0, (a, v) -> a + pow(v - c.mean, 2)), "
        "'lagged', aggregate(zip_with(slice(c.x, 1, CAST(c.n AS INT) - 1), slice(c.x, 2, CAST(c.n AS INT) - 1), (u, v) -> (u - c.mean) * (v - c.mean)), 0e0, (a, v) -> a + v))",
        "named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 'enc', c.enc, 'high', c.high, 'z_chi', c.z_chi, "
        "'z_runs', CASE WHEN c.high = 0 OR c.high = c.n THEN 0e0 ELSE abs(c.runs - c.expected) / sqrt(greatest(1e-9, (c.expected - 1) * (c.expected - 2) / (c.n - 1))) END, "
        "'z_serial', CASE WHEN c.spread = 0 THEN 99e0 ELSE abs(c.lagged / c.spread + 1 / c.n) * sqrt(c.n) END)",
        f"named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 'enc', c.enc, 'half', -(ln({floor.format(upper_tail('c.z_chi'))}) + ln({floor.format(p_runs)}) + ln({floor.format(f'2 * {upper_tail("c.z_serial")}')})))",
        "named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 'enc', c.enc, 'p', exp(-c.half) * (1 + c.half + c.half * c.half / 2))",
    ]
    for k, step in enumerate(steps):
        kept = "filter({}, c -> c.enc IS NOT NULL)".format(column) if k == 1 else column
        df = df.withColumn(column, F.expr(f"transform({kept}, c -> {step})"))
    return df


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTHS):
        out = F.when(n >= least, F.lit(k)).otherwise(out)
    return out


def cuts(candidates: DataFrame) -> dict[str, float]:
    """The least p-value to report, by encoding and class of lengths; (enc, n, p) of all candidates are counted in bins."""
    counted = candidates.groupBy("enc", _length_class(F.col("n")).alias("of"), F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")).count().collect()
    by: dict[str, list[int]] = {}
    for r in counted:
        by.setdefault(f"{r.enc}:{r.of}", [0] * BINS)[r.bin] += r["count"]
    found = {}
    for name, bins in by.items():
        random = 2 * (sum(bins[BINS // 2 :]) + 1)
        at = next((b for b in range(BINS) if 1 - random * (1 - b / BINS) / max(1, sum(bins[b:])) <= FALSE_SHARE), BINS // 2)
        found[name] = max(LEAST_P, at / BINS)
    return found


def _scanned(docs: DataFrame) -> DataFrame:
    """Pattern spans ``__assign``, ``__access``, ``__hex`` and tested candidates ``__random`` of each text, which overlap none of them."""
    text = text_or_empty()
    assign, access, hex_ = pattern_spans(text)
    found = docs.withColumns({"__assign": assign, "__access": access, "__hex": hex_, "__random": matches(text, CANDIDATE, "random", text.rlike(CANDIDATE))})
    base = F.concat("__assign", "__access", "__hex")
    own = F.filter("__random", lambda c: ~F.exists(base, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    return with_tests(found.withColumn("__random", F.when(F.size(base) > 0, own).otherwise(F.col("__random"))), "__random")


def _with_spans(scanned: DataFrame, limits: dict[str, float]) -> DataFrame:
    """With ``__spans``: pattern spans and the candidates that pass, by start and then kind as listed."""
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else F.lit(None).cast("map<string,double>")
    passed = F.filter("__random", lambda c: c["p"] >= limit[F.concat_ws(":", c["enc"], _length_class(c["n"]).cast("string"))])

    def ranked(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"))

    found = {"assign": "__assign", "access": "__access", "hex": "__hex", "random": passed}
    every = F.concat(*(F.transform(c, ranked(kind)) for kind, c in found.items()))
    return scanned.withColumn("__spans", F.array_sort(every))


def joined(spans: Column, kinds: Sequence[str] = KINDS) -> Column:
    """Spans as kind:start:stop, joined by commas."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if len(kinds) < len(KINDS) else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _limits(scanned: DataFrame) -> dict[str, float]:
    return cuts(scanned.select(F.explode("__random").alias("c")).select("c.enc", "c.n", "c.p"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (array of start, rank, stop, kind) of every row."""
    scanned = staged(_scanned(docs.select("doc_id", "text")).drop("text"), "scanned")
    return _with_spans(scanned, _limits(scanned)).select("doc_id", F.col("__spans").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` (overlapping ones as one) replaced by ``mark``."""
    text = text_or_empty()
    scanned = staged(_scanned(docs), "scanned")
    spans = _with_spans(scanned, _limits(scanned))
    last = lambda c: F.array_max(F.transform(c, lambda s: s["stop"]))

    def cut(z: Column) -> Column:
        """The text from where a chunk of spans begins to where it ends, without them."""
        begin = z["start"]
        piece = F.substring(text, begin + 1, F.greatest(F.lit(0), last(z["chunk"]) - begin))
        parts = F.aggregate(
            z["chunk"],
            F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["stop"]).alias("at"),
                F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(F.substring(piece, acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit(mark)))).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return F.array_join(parts, "")

    chunks = _running(_chunks(F.col("__spans")), F.lit(0), F.greatest, last)
    whole = F.concat(F.array_join(F.transform(chunks, cut), ""), F.substring(text, last(F.col("__spans")) + 1, F.length(text)))
    return spans.withColumn("text", F.when(F.size("__spans") > 0, whole).otherwise(F.col("text"))).select(*docs.columns)
