"""Secrets: patterns with known forms, and strings that a battery of randomness tests tells from ordinary ones.

DataFrame functions only.  Candidates are long runs of key characters.  For each
the encoding is inferred, and with it the alphabet that a random key would be
drawn from: digits, hex, letters of one case, base32, letters of one case with
digits, letters, or letters and digits.  Three tests hold the run against that alphabet:
chi-squared uniformity with the alphabet's degrees of freedom, runs of character
classes, and lag-one serial correlation, each with its mean and variance for
random draws.  A run that any of them rejects (level NOT_RANDOM, shared out among
the three, which holds however they depend) is no key.

Short ordinary strings may pass for random, so the same three statistics are also
compared with what ordinary strings show.  Runs with fewer than two digits are
compared with ordinary words instead, joinedAsHere among them: they change case
as often as random letters, but hold fewer of the rarer case.  The combined z
gives a p-value; a Benjamini-Hochberg rule for each class of length and encoding,
over all candidates of the table, decides.  Only its histogram (a few hundred
rows) reaches the driver.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import spans as S
from nearfield.llm.common import without

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}+"
TWO_DIGITS = "[0-9].*[0-9]"

#: What ordinary strings show: chance that two letters agree (the index of coincidence of European languages is 0.067 to
#: 0.078), rate of class changes, serial correlation.  Fixed values.
ORDINARY_REPEAT, ORDINARY_RUNS, ORDINARY_SERIAL = 0.075, 0.15, 0.45
#: The same for runs with fewer than two digits: chance that two characters agree, share of the rarer case.  Fixed values.
WORDS_REPEAT, WORDS_CASE = 0.06, 0.3
#: Share of false finds among the strings that the battery adds.
FALSE_SHARE = 0.01
STEP = 0.25

#: Share of random keys that the three tests for randomness may reject together.
NOT_RANDOM = 0.001
#: The alphabets of the encodings: (what the run consists of, letters, classes whose runs are counted, letters of each class).
ALPHABETS = (
    ("^[0-9]*$", 10, "[0-4]++|[5-9]++", (5, 5)),
    ("^(?:[0-9a-f]*|[0-9A-F]*)$", 16, "[0-9]++|[a-fA-F]++", (10, 6)),
    ("^(?:[a-z]*|[A-Z]*)$", 26, "[a-mA-M]++|[n-zN-Z]++", (13, 13)),
    ("^(?:[a-z2-7]*|[A-Z2-7]*)$", 32, "[0-9]++|[a-zA-Z]++", (6, 26)),
    ("^(?:[a-z0-9]*|[A-Z0-9]*)$", 36, "[0-9]++|[a-zA-Z]++", (10, 26)),
    ("^[a-zA-Z]*$", 52, "[a-z]++|[A-Z]++", (26, 26)),
    ("^[a-zA-Z0-9]*$", 62, "[0-9]++|[a-z]++|[A-Z]++", (10, 26, 26)),
)


def _by_alphabet(value: Column, of) -> Column:
    """``of(letters, classes, sizes)`` for the first alphabet that ``value`` consists of."""
    out = F.lit(None)
    for pattern, *alphabet in reversed(ALPHABETS):
        out = F.when(value.rlike(pattern), of(*alphabet)).otherwise(out)
    return out


def randomness(value: Column) -> Column:
    """(chi, runs, serial): z of each test of the letters and digits of ``value`` against random draws from its alphabet."""
    return S.bound(F.regexp_replace(value, "[^A-Za-z0-9]", ""), lambda v: S.bound(_moments(v), lambda m: _against_random(v, m)))


def _moments(v: Column) -> Column:
    """(n, squares, serial) of a run: length, sum of squared letter counts, lag-one correlation (null: one letter alone)."""
    n = F.char_length(v).cast("double")
    counts = F.transform(F.array_distinct(F.split(v, "")), lambda c: n - F.char_length(F.replace(v, c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda t, c: t + c * c)

    def correlation(codes: Column) -> Column:
        def around(mean: Column) -> Column:
            spread = F.aggregate(codes, F.lit(0.0), lambda t, c: t + (c - mean) * (c - mean))
            lag = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: (a - mean) * (b - mean))
            return F.try_divide(F.aggregate(lag, F.lit(0.0), lambda t, c: t + c), spread)

        return S.bound(F.aggregate(codes, F.lit(0.0), lambda t, c: t + c) / n, around)

    serial = S.bound(F.transform(F.split(v, ""), lambda c: F.ascii(c).cast("double")), correlation)
    return F.struct(n.alias("n"), squares.alias("squares"), serial.alias("serial"))


def _against_random(v: Column, m: Column) -> Column:
    n, serial = m["n"], F.coalesce(m["serial"], F.lit(1.0))

    def chi(letters, classes, sizes):
        # The cube root of a chi-squared value over its degrees of freedom is nearly normal.
        df = letters - 1
        return (F.cbrt((m["squares"] * letters / n - n) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))

    def runs(letters, classes, sizes):
        p = [s / letters for s in sizes]
        change, both = 1 - sum(x * x for x in p), 1 - 2 * sum(x * x for x in p) + sum(x**3 for x in p)
        changes = F.char_length(F.regexp_replace(v, classes, "x")) - 1
        return (changes - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * (both - change * change))

    return F.struct(_by_alphabet(v, chi).alias("chi"), _by_alphabet(v, runs).alias("runs"), ((serial + 1 / n) * F.sqrt(n)).alias("serial"))


def may_be_random(value: Column) -> Column:
    """Whether no test rejects ``value`` as random draws: too uneven, too few or many runs, or correlated neighbours."""
    each = NOT_RANDOM / 3
    one, two = NormalDist().inv_cdf(1 - each), NormalDist().inv_cdf(1 - each / 2)
    return S.bound(randomness(value), lambda z: (z["chi"] <= one) & (F.abs(z["runs"]) <= two) & (F.abs(z["serial"]) <= two))


def battery(value: Column) -> Column:
    """The combined z of the comparison with ordinary strings: above 0 the more, the less ``value`` looks like one.

    Marks that part words are left out, so that they do not count as changes of class.
    """
    few = ~value.rlike(TWO_DIGITS)
    return S.bound(F.regexp_replace(value, "[^A-Za-z0-9]", ""), lambda v: S.bound(_moments(v), lambda m: _against_ordinary(v, m, few)))


def _against_ordinary(v: Column, m: Column, few: Column) -> Column:
    n = m["n"]
    pairs = n * (n - 1) / 2
    repeat = F.when(few, WORDS_REPEAT).otherwise(ORDINARY_REPEAT)
    uniform = (pairs * repeat - (m["squares"] - n) / 2) / F.sqrt(pairs * repeat * (1 - repeat))
    rarer = F.least(*(F.char_length(F.regexp_replace(v, c, "")) for c in ("[^a-z]++", "[^A-Z]++"))).cast("double")
    cased = (rarer - n * WORDS_CASE) / F.sqrt(n * WORDS_CASE * (1 - WORDS_CASE))
    runs = F.char_length(F.regexp_replace(v, "[a-z]++|[A-Z]++|[0-9]++", "x")).cast("double")
    changing = (runs - 1 - (n - 1) * ORDINARY_RUNS) / F.sqrt((n - 1) * ORDINARY_RUNS * (1 - ORDINARY_RUNS))
    serial = (ORDINARY_SERIAL - F.coalesce(m["serial"], F.lit(1.0))) * F.sqrt(n)
    return F.when(few, (uniform + cased) / math.sqrt(2)).otherwise((uniform + changing + serial) / math.sqrt(3))


def stratum(value: Column) -> Column:
    """Encoding and class of length, as one small number; words do not raise the thresholds of runs with digits."""
    n = F.char_length(value)
    encoding = F.when(~value.rlike(TWO_DIGITS), 3).when(~value.rlike("[A-Za-z]"), 4).when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 0).when(value.rlike("^[A-Za-z0-9]+$"), 1).otherwise(2)
    return encoding * 8 + F.when(n < 24, 0).when(n < 32, 1).when(n < 48, 2).when(n < 80, 3).otherwise(4)


def candidates(text: Column) -> Column:
    """Runs of key characters, long enough for the tests without their marks: spans with value."""
    long = lambda v: v.rlike("(?:[A-Za-z0-9][^A-Za-z0-9]*+){16}")
    return F.coalesce(F.when(text.rlike(CANDIDATE), S.matches(text, CANDIDATE, long)), S.none())


def thresholds(histogram: dict[tuple[int, int], tuple[int, int]]) -> dict[int, int]:
    """For each stratum the least z step that Benjamini-Hochberg keeps; histogram: by (stratum, z step), (all, those that may be random)."""
    out = {}
    for s in {k for k, _ in histogram}:
        bins = sorted(((z, c) for (k, z), c in histogram.items() if k == s), reverse=True)
        total, seen = sum(c for _, (c, _) in bins), 0
        for z, (_, c) in bins:
            seen += c
            if c and math.erfc(z * STEP / math.sqrt(2)) / 2 * total <= FALSE_SHARE * seen:
                out[s] = z
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with base and spans: arrays of (start, rank, end, kind, value, score), sorted by start, then kind.

    docs has a string column ``text``; columns of those names are replaced.  base holds
    assign, access and hex; spans adds kind random (score: its z), where it
    overlaps no base span.  A null or empty text has none; the work on a very
    long one grows with its length, and little faster with its matches.  Rows and other
    columns stay; repeated rows are treated alike, and equal strings too; an empty
    table gives no rows.
    """
    docs = without(docs, "base", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select(F.explode(candidates(text)).alias("s")).select(stratum(F.col("s.value")).alias("stratum"), F.floor(battery(F.col("s.value")) / STEP).cast("int").alias("z"), may_be_random(F.col("s.value")).alias("random"))
    counted = seen.groupBy("stratum", F.least(F.greatest("z", F.lit(-200)), F.lit(200)).alias("z")).agg(F.count("*").alias("n"), F.count_if("random").alias("random"))
    least = thresholds({(r["stratum"], r["z"]): (r["n"], r["random"]) for r in counted.collect()})
    group2 = lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 1)) >= 6
    found = {
        "assign": F.when(text.rlike(r"(?i)(?:passw|secret|token|api_?key)"), S.matches(text, ASSIGN, group2)),
        "access": F.when(F.contains(text, F.lit("AKIA")), S.matches(text, ACCESS, lambda v: F.char_length(v) >= 20)),
        "hex": F.when(text.rlike("[0-9a-f]{24}"), S.matches(text, HEX, lambda v: F.lit(True))),
    }
    base = F.concat(*(S.named(F.coalesce(found[k], S.none()), k, i, lambda s: F.lit(1.0)) for i, k in enumerate(KINDS)))

    def kept(s: Column) -> Column:
        of = stratum(s["value"])
        limit = F.lit(None).cast("int")
        for k, z in sorted(least.items()):
            limit = F.when(of == k, F.lit(z)).otherwise(limit)
        return F.coalesce((F.floor(s["score"] / STEP) >= limit) & may_be_random(s["value"]), F.lit(False))

    tested = S.named(candidates(text), "random", len(KINDS), lambda s: battery(s["value"]))
    out = docs.withColumns({"base": F.array_sort(base), "spans": tested if least else F.array().cast(S.NAMED)})
    return out.withColumn("spans", F.array_sort(F.concat("base", F.filter(S.clear_of(F.col("spans"), F.col("base")), kept))))


def redact_secrets(found: DataFrame) -> DataFrame:
    """The rows of ``find_secrets`` with every span in ``text`` replaced by <kind>."""
    return found.withColumn("text", S.redacted(F.col("text"), F.col("spans"), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">"))))
