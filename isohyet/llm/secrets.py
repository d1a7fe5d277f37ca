"""Secrets in texts, as Column expressions only: fixed patterns, and tokens that pass for random.

Fixed patterns (``assign``, ``access``, ``hex``) give the base spans.  The method adds spans of kind ``random``.  A
token is a whole run of the symbols of base 64 in either spelling; an equals sign ends it, so what stands before and
after one are two tokens and padding is not part of either.  A token whose encoding can be inferred (hexadecimal, base
32 or base 36 in one case of letters, base 64 in two; runs of digits alone have none) and that is long enough to carry
96 bits is put to five tests of the hypothesis that its symbols are drawn uniformly and independently - chi-squared
against the uniform alphabet, chi-squared of the shares of three groups (digits, vowels and the rest, in base 64
capitals, small letters and the rest), the one component of chi-squared that points to words (no digits, many vowels,
few capitals; one-sided), runs above and below the middle of the alphabet, and serial correlation.  The smallest of the five
p-values, times five, is the token's.  Per encoding and class of length, Benjamini-Hochberg over all
tokens of the corpus settles below which p-value a token is declared ordinary, so that at most 5 % of these
declarations are expected to hit a random token; what is left is reported unless a base span covers it.  Where random
tokens are the bulk of a class, its limit is low and a long word may be reported with them.

Moments of the statistics are those for the token's own length.  P-values are rounded up to a twentieth of a power of
ten, down to 1e-300, and counted, so what the driver reads is bounded: a few encodings, classes of length and steps.

The work on a text grows with its length: places of matches are running sums made block by block, and a redacted text is
joined once from pieces that are cut from short parts of it.

Positions are code points, the end is exclusive.  Null counts as the empty text and has no span.  Repeated rows and
rows without doc_id are scanned like all others; other columns are carried along untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import once, shielded, unshielded

# Kinds in the order of report, pattern, group that is measured, least length.  The last two patterns take
# whole runs of their symbols, so asking for the length inside the pattern finds the same spans as dropping short runs.
PATTERNS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
KINDS = ["assign", "access", "hex", "random"]
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LEAST = {"hex": 24, "base32": 20, "base36": 19, "base64": 16}  # symbols that carry 96 bits
# Groups of symbols whose shares are tested; what is in neither goes together.
GROUPS = {"hex": ["0123456789", "ae"], "base32": ["234567", "AEIOU"], "base36": ["0123456789", "aeiou"],
          "base64": ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"]}
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
# Shares of the symbols in words run together: vowels (in base 64 small ones), capitals in base 64, digits and signs; the
# rest goes to the other letters.  Only the direction of the test depends on them, not its level.
WORDS = {"hex": [("ae", 0.45), ("0123456789", 0.05)], "base32": [("AEIOU", 0.38), ("234567", 0.02)],
         "base36": [("aeiou", 0.38), ("0123456789", 0.02)],
         "base64": [("aeiou", 0.30), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.15), ("0123456789+/", 0.02)]}
FALSE_DISCOVERIES = 0.05
DECADE, FLOOR = 20, 1e-300  # steps of the grid of p-values in a power of ten; the least p-value
CHUNK = 4096                # code points in the parts that a text is cut from
_FAR = 2**31 - 1


def _running(values: Column, op, zero: Column) -> Column:
    """``op`` over all values up to each place.  Long arrays go in blocks of about the root of their size, since an array
    that grows by one element is copied each time."""
    empty = F.array().cast("array<int>")

    def plain(v):
        return F.aggregate(v, empty, lambda s, x: F.array_append(s, op(F.coalesce(F.get(s, F.size(s) - 1), zero), x)))

    def blocked(v):
        parts = once(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda k: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / k).cast("int")), lambda b: plain(F.slice(v, b * k + 1, k))))

        def linked(r):
            ends = plain(F.transform(r, lambda part: F.get(part, F.size(part) - 1)))
            return once(ends, lambda e: F.flatten(F.transform(r, lambda part, b: once(
                F.coalesce(F.get(e, b - 1), zero), lambda before: F.transform(part, lambda x: op(before, x))))))

        return once(parts, linked)

    return once(values, lambda v: F.when(F.size(v) <= 32, plain(v)).otherwise(blocked(v)))


def _located(text: Column, pattern: str) -> Column:
    """``array<struct<start, token>>`` of all leftmost matches: their places follow from the pieces between them."""
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,token:string>>")

    def of(tokens):
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(tokens))
        steps = F.transform(F.arrays_zip(pieces.alias("piece"), tokens.alias("token")),
                            lambda x: F.char_length(x["piece"]) + F.char_length(x["token"]))
        ends = _running(steps, lambda s, x: s + x, F.lit(0))
        places = F.transform(F.arrays_zip(ends.alias("end"), tokens.alias("token")), lambda x: F.struct(
            (x["end"] - F.char_length(x["token"])).alias("start"), x["token"].alias("token")))
        return F.when(F.size(tokens) > 0, places).otherwise(empty)

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _base(kind: str, pattern: str, group: int, least: int) -> Column:
    found = F.filter(_located(F.col("__text"), pattern), lambda x: F.char_length(
        F.regexp_extract(x["token"], pattern, group) if group else x["token"]) >= least)
    return F.transform(found, lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.char_length(x["token"])).alias("end")))


def _encoding(token: Column) -> Column:
    letters = token.rlike("[A-Za-z]")
    kinds = [("hex", "^([0-9a-f]+|[0-9A-F]+)$"), ("base32", "^[A-Z2-7]+$"), ("base36", "^([0-9a-z]+|[0-9A-Z]+)$"),
             ("base64", "^(?=.*[a-z])(?=.*[A-Z])")]
    out = F.lit(None).cast("string")
    for name, form in reversed(kinds):
        out = F.when(token.rlike(form) & letters, F.lit(name)).otherwise(out)
    return out


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable (fixed values: Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _symbols(x: Column) -> Column:
    """Places of the token's symbols in its alphabet."""
    form = (F.when(x["encoding"].isin("hex", "base36"), F.lower(x["token"]))
            .otherwise(F.translate(x["token"], "-_", "+/")))
    alphabet = F.lit(None).cast("string")
    for name, symbols in ALPHABETS.items():
        alphabet = F.when(x["encoding"] == name, F.lit(symbols)).otherwise(alphabet)
    return F.transform(F.split(form, ""), lambda c: F.call_function("instr", alphabet, c) - 1)


def _among(places: list[int]):
    return lambda c: c.isin(places)


def _groups(v: Column, n: Column, encoding: Column) -> Column:
    """Pearson's test of the shares of three groups of symbols, with the closed form for two degrees of freedom."""
    out = F.lit(None).cast("double")
    for name, groups in GROUPS.items():
        alphabet = ALPHABETS[name]
        rest = "".join(c for c in alphabet if not any(c in g for g in groups))
        total = F.lit(0.0)
        for group in (*groups, rest):
            expected = n * (len(group) / len(alphabet))
            found = F.size(F.filter(v, _among([alphabet.index(c) for c in group])))
            total = total + F.pow(found - expected, F.lit(2.0)) / expected
        out = F.when(encoding == name, F.exp(-total / 2)).otherwise(out)
    return out


def _wordlike(v: Column, n: Column, encoding: Column) -> Column:
    """One-sided test of the log-likelihood ratio of words against uniform symbols, by its moments under the latter."""
    out = F.lit(None).cast("double")
    for name, groups in WORDS.items():
        alphabet = ALPHABETS[name]
        rest = "".join(c for c in alphabet if not any(c in g for g, _ in groups))
        groups = [*groups, (rest, 1 - sum(share for _, share in groups))]
        uniform = [len(g) / len(alphabet) for g, _ in groups]
        weights = [math.log(share / u) for (_, share), u in zip(groups, uniform)]
        mean = sum(u * w for u, w in zip(uniform, weights))
        spread = math.sqrt(sum(u * w * w for u, w in zip(uniform, weights)) - mean * mean)
        total = F.lit(0.0)
        for (group, _), weight in zip(groups, weights):
            total = total + F.size(F.filter(v, _among([alphabet.index(c) for c in group]))) * weight
        out = F.when(encoding == name, _upper_tail((total - n * mean) / (F.sqrt(n) * spread))).otherwise(out)
    return out


def _p_value(x: Column) -> Column:
    """Five tests of uniform independent symbols ``x.symbols`` out of ``x.size``, combined by Bonferroni."""
    v, n, m = x["symbols"], F.size(x["symbols"]).cast("double"), x["size"].cast("double")
    squares = F.aggregate(F.array_distinct(v), F.lit(0.0),
                          lambda s, c: s + F.pow(n - F.size(F.array_remove(v, c)), F.lit(2.0)))
    # A gamma variable of the statistic's mean and variance, made normal by its cube root (Wilson and Hilferty).
    spread = (2 / F.lit(9.0)) * (1 - 1 / n) / (m - 1)
    uniform = _upper_tail((F.pow((m * squares / n - n) / (m - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    pairs = F.arrays_zip(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1))
    middle = (m - 1) / 2
    high = F.size(F.filter(v, lambda c: c > middle)).cast("double")
    low = n - high
    changes = F.size(F.filter(pairs, lambda p: (p["0"] > middle) != (p["1"] > middle))).cast("double")
    mean = 2 * high * low / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    runs = F.when(variance > 0, _two_sided((changes + 1 - mean) / F.sqrt(variance))).otherwise(F.lit(0.0))
    centre = F.aggregate(v, F.lit(0.0), lambda s, c: s + c) / n

    def correlation(centre):  # the mean is taken once, not at every symbol
        total = F.aggregate(v, F.lit(0.0), lambda s, c: s + (c - centre) * (c - centre))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["0"] - centre) * (p["1"] - centre))
        return F.when(total > 0, lagged / total)

    def serial_p(r):
        return F.when(r.isNotNull(), _two_sided((r + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))

    serial = once(once(centre, correlation), serial_p)
    return F.least(F.lit(1.0), 5 * F.least(uniform, _groups(v, n, x["encoding"]), _wordlike(v, n, x["encoding"]), runs, serial))


def _candidates(documents: DataFrame) -> DataFrame:
    """``__tokens``: start, end, encoding, class of length and p-value of each token that could be an encoded secret."""
    rows = documents.withColumn("__tokens", F.transform(_located(F.col("__text"), TOKEN), lambda x: F.struct(
        x["start"].alias("start"), x["token"].alias("token"), _encoding(x["token"]).alias("encoding"))))

    def by_encoding(encoding, values):
        out = F.lit(None).cast("int")
        for name, value in values.items():
            out = F.when(encoding == name, F.lit(value)).otherwise(out)
        return out

    rows = rows.withColumn("__tokens", F.filter("__tokens", lambda x: x["encoding"].isNotNull() & (
        F.char_length(x["token"]) >= by_encoding(x["encoding"], LEAST))))
    rows = rows.withColumn("__tokens", F.transform("__tokens", lambda x: F.struct(
        x["start"].alias("start"), (x["start"] + F.char_length(x["token"])).alias("end"), x["encoding"].alias("encoding"),
        by_encoding(x["encoding"], {k: len(v) for k, v in ALPHABETS.items()}).alias("size"), _symbols(x).alias("symbols"))))
    return rows.withColumn("__tokens", F.transform("__tokens", lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["encoding"].alias("encoding"),
        F.least(F.floor(F.size(x["symbols"]) / 8), F.lit(8)).cast("int").alias("length"),
        F.ceil(F.log10(F.greatest(_p_value(x), F.lit(FLOOR))) * DECADE).cast("int").alias("step"))))


def ordinary_limits(documents: DataFrame) -> dict[tuple[str, int], int | None]:
    """Benjamini-Hochberg per encoding and class of length: steps up to the limit mark ordinary tokens (None: none are)."""
    with_text = documents.select(F.coalesce("text", F.lit("")).alias("__text"))
    steps = (_candidates(with_text).select(F.explode("__tokens").alias("x"))
             .groupBy("x.encoding", "x.length", "x.step").count().collect())
    limits = {}
    for stratum in {(r["encoding"], r["length"]) for r in steps}:
        counts = sorted((r["step"], r["count"]) for r in steps if (r["encoding"], r["length"]) == stratum)
        total, below, limit = sum(c for _, c in counts), 0, None
        for step, count in counts:
            below += count
            if 10 ** (step / DECADE) <= FALSE_DISCOVERIES * below / total:
                limit = step
        limits[stratum] = limit
    return limits


def _uncovered(tokens: Column, base: Column) -> Column:
    """Start and end of the tokens that share no place with a base span.  In the order of starts, one before the token
    must not reach into it, and the next one must not begin before its end."""
    def event(kind):
        return lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("token"), x["end"].alias("end"))

    def of(events):
        reach = _running(F.transform(events, lambda e: F.when(e["token"] == 0, e["end"]).otherwise(-1)), F.greatest, F.lit(-1))
        following = F.reverse(_running(F.reverse(F.transform(
            events, lambda e: F.when(e["token"] == 0, e["start"]).otherwise(_FAR))), F.least, F.lit(_FAR)))
        rows = F.arrays_zip(events.alias("event"), reach.alias("reach"), following.alias("following"))
        free = F.filter(rows, lambda r: (r["event"]["token"] == 1) & (r["reach"] <= r["event"]["start"])
                        & (r["following"] >= r["event"]["end"]))
        return F.transform(free, lambda r: r["event"])

    alone = F.transform(tokens, event(1))
    return F.when((F.size(base) == 0) | (F.size(alone) == 0), alone).otherwise(
        once(F.sort_array(F.concat(F.transform(base, event(0)), alone)), of))


def scan(documents: DataFrame) -> DataFrame:
    """``documents`` with ``base_spans`` and ``spans``: kind, start and end of every secret, by start and then by kind;
    columns of these names are replaced."""
    limits = ordinary_limits(documents)
    rows = documents.withColumn("__text", F.coalesce("text", F.lit("")))
    for kind, pattern, group, least in PATTERNS:
        rows = rows.withColumn(f"__{kind}", _base(kind, pattern, group, least))
    rows = _candidates(rows).withColumn("__base", F.concat(*(F.col(f"__{k}") for k, *_ in PATTERNS)))

    def suspect(x):
        ordinary = F.lit(False)
        for (encoding, length), limit in limits.items():
            if limit is not None:
                ordinary = ordinary | ((x["encoding"] == encoding) & (x["length"] == length) & (x["step"] <= limit))
        return ~ordinary

    added = F.transform(_uncovered(F.filter("__tokens", suspect), F.col("__base")), lambda x: F.struct(
        F.lit("random").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def ordered(spans):
        rank = F.array(*(F.lit(k) for k in KINDS))
        keyed = F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    rows = rows.withColumn("base_spans", ordered(F.col("__base"))).withColumn("spans", ordered(F.concat("__base", added)))
    return rows.drop("__text", "__tokens", "__base", *(f"__{k}" for k, *_ in PATTERNS))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every secret replaced by a mark; overlapping spans become one; n_chars follows if it is there."""
    rows = scan(shielded(documents, "text", "n_chars"))

    def cleaned(chunks):
        def cut(a, b):  # from the few chunks that hold the piece, as looking for a place in a text reads all before it
            first = F.floor(a / CHUNK).cast("int")
            held = F.array_join(F.slice(chunks, first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "")
            return F.substring(held, a - first * CHUNK + 1, b - a)

        def pieces(reach):
            spans = F.arrays_zip(F.transform("spans", lambda x: x["start"]).alias("start"), F.concat(
                F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1)).alias("after"))
            fresh = F.filter(spans, lambda x: x["start"] >= x["after"])
            marked = F.transform(fresh, lambda x: F.concat(cut(x["after"], x["start"]), F.lit(mark)))
            return F.concat(F.array_join(marked, ""), cut(F.get(reach, F.size(reach) - 1), F.char_length("text")))

        return once(_running(F.transform("spans", lambda x: x["end"]), F.greatest, F.lit(0)), pieces)

    clean = once(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0)), cleaned)
    rows = rows.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast(
            documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return unshielded(rows, documents, "text", "n_chars")
