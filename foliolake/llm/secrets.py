"""Secret scan: fixed patterns, and a battery of randomness tests for what the patterns do not know.

A run of 20 or more letters of the usual encodings is a candidate.  Its encoding is inferred from its letters.
Three tests ask if it could be uniformly random over that encoding's alphabet: chi-squared over the kinds of
letters, the Wald-Wolfowitz runs test about the middle of the alphabet, and the lag-one serial correlation.  A
candidate that no test rejects gets an e-value against ordinary writing: the likelihood ratio of uniform letters
to a letter model of text, which grows with each letter, so that short runs need more.  The e-values of a
document's candidates go through the e-BH rule, which bounds the false discovery rate under any dependence.  All
of it is column expressions; nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import span_array

# The patterns of the base scan and the least lengths of what they find, in the order of the kinds.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
          r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ["assign", "access", "hex", "random"]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Share of small letters, capitals, digits and signs in ordinary writing, and how many of each there are.
WRITING = {"lower": (0.93, 26), "upper": (0.03, 26), "digit": (0.02, 10), "sign": (0.02, 4)}
#: Level of the battery (shared by its three tests), and the false discovery rate of a document's candidates.
BATTERY_LEVEL, DISCOVERY_RATE = 0.001, 0.001

_SPAN = "struct<start:int,kind:int,end:int>"


def _upper_tail(z: Column) -> Column:
    """One minus the normal distribution function, by a logistic curve that is right to 0.0002."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _count(of: Column, letters: str) -> Column:
    return F.length(of) - F.length(F.regexp_replace(of, f"[{letters}]", ""))


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def encoding_of(run: Column) -> Column:
    """Encoding that the letters of a run allow: null for digits only, which encode no key."""
    return (F.when(run.rlike("^[0-9]+$"), F.lit(None).cast("string")).when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
            .when(run.rlike("^[A-Z2-7]+=*$"), "base32").otherwise("base64"))


def battery(run: Column, encoding: Column) -> Column:
    """``struct(chi2_p, runs_p, serial_p, e_log)``: p-values of uniform randomness, log of the e-value against writing."""
    body = F.translate(F.rtrim(F.translate(run, "=", " ")), "-_", "+/")
    body = F.when(encoding == "hex", F.lower(body)).otherwise(body)
    alphabet = F.element_at(F.create_map(*[F.lit(v) for kv in ALPHABETS.items() for v in kv]), encoding)

    def tests(s: Column) -> Column:
        b, a = s["body"], s["alphabet"]
        k, n = F.length(a).cast("double"), F.length(b).cast("double")
        lower, upper, digit, sign = (_count(run_, letters).cast("double") for run_, letters in (
            (b, "a-z"), (b, "A-Z"), (b, "0-9"), (b, "+/")))
        shares = [(lower, F.when(k == 16, 6.0).when(k == 32, 0.0).otherwise(26.0)), (upper, F.when(k == 16, 0.0).otherwise(26.0)),
                  (digit, F.when(k == 16, 10.0).when(k == 32, 6.0).otherwise(10.0)), (sign, F.when(k == 64, 2.0).otherwise(0.0))]
        chi2 = sum((F.when(of > 0, (seen - n * of / k) * (seen - n * of / k) / (n * F.greatest(of, F.lit(1.0)) / k)).otherwise(0.0)
                    for seen, of in shares), F.lit(0.0))
        df = F.when(k == 64, 3.0).otherwise(1.0)
        chi2_z = (F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        writing = sum((seen * (F.log(1 / k) - math.log(share / letters)) for seen, (share, letters) in zip(
            (lower, upper, digit, sign), WRITING.values(), strict=True)), F.lit(0.0))

        def ordered(x: Column) -> Column:
            pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
            middle = k / 2 - 0.5
            above = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.when(v > middle, 1.0).otherwise(0.0))
            below = n - above
            runs = F.aggregate(pairs, F.lit(1.0), lambda acc, pq: acc + F.when((pq["p"] > middle) != (pq["q"] > middle), 1.0).otherwise(0.0))
            expected = 1 + 2 * above * below / n
            spread = (expected - 1) * (expected - 2) / (n - 1)
            runs_p = F.when(spread > 0, 2 * _upper_tail(F.abs(runs - expected) / F.sqrt(spread))).otherwise(0.0)
            moment = F.aggregate(pairs, F.lit(0.0), lambda acc, pq: acc + (pq["p"] - middle) * (pq["q"] - middle))
            serial_z = moment / ((k * k - 1) / 12) / F.sqrt(n - 1)
            return F.struct(_upper_tail(chi2_z).alias("chi2_p"), runs_p.alias("runs_p"),
                            (2 * _upper_tail(F.abs(serial_z))).alias("serial_p"), writing.alias("e_log"))

        return _bind(F.transform(F.split(b, ""), lambda c: F.call_function("instr", a, c).cast("double") - 1), ordered)

    return _bind(F.struct(body.alias("body"), alphabet.alias("alphabet")), tests)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """``array<struct<start, kind, end>>`` of the fixed patterns, by start and kind; offsets in code points, end exclusive."""
    assigned = F.filter(span_array(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= LEAST_VALUE)
    return F.array_sort(F.concat(_spans(assigned, 0), _spans(span_array(text, ACCESS), 1), _spans(span_array(text, HEX), 2)))


def random_spans(text: Column, base: Column) -> Column:
    """Candidates that the battery takes for random and e-BH discovers, without those that touch a base span."""
    free = F.filter(span_array(text, CANDIDATE), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    known = F.filter(F.transform(free, lambda c: F.struct(c.alias("c"), encoding_of(c["match"]).alias("enc"))), lambda c: c["enc"].isNotNull())
    tested = F.transform(known, lambda c: F.struct(c["c"].alias("c"), battery(c["c"]["match"], c["enc"]).alias("t")))

    def discovered(all_: Column) -> Column:
        # candidates that a test rejects have no evidence for them; they still count in the family
        def log_e(t: Column) -> Column:
            passed = F.least(t["chi2_p"], t["runs_p"], t["serial_p"]) >= BATTERY_LEVEL / 3
            return F.when(passed, t["e_log"]).otherwise(float("-inf"))

        def least(logs: Column) -> Column:
            """Smallest discovered log e-value: the last place k, from the largest down, whose value is at least log(m / (rate k))."""
            m = F.size(logs).cast("double")
            reached = F.transform(logs, lambda v, i: F.when(v >= F.log(m / (DISCOVERY_RATE * (i + 1))), v))
            return F.array_min(F.array_compact(reached))

        bar = least(F.sort_array(F.transform(all_, lambda c: log_e(c["t"])), asc=False))
        return _bind(bar, lambda b: F.filter(all_, lambda c: F.coalesce(log_e(c["t"]) >= b, F.lit(False))))

    return F.when(F.size(known) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(
        _bind(tested, lambda all_: _spans(F.transform(discovered(all_), lambda c: c["c"]), 3)))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, base, added)``: spans of the fixed patterns and those the method adds, as arrays of (start, kind, end).

    Null texts count as empty; texts without secrets have empty arrays.  One row per input row; other columns are
    left out.
    """
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # explode of one element: a generator is worked out once, a projection may be copied into what uses it
    rows = rows.select(key, "_text", F.explode(F.array(base_spans(F.col("_text")))).alias("base"))
    return rows.select(key, "base", F.explode(F.array(random_spans(F.col("_text"), F.col("base")))).alias("added"))


def summary(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(key, n_assign, n_access, n_hex, n_random, base_sha256, spans)``; see ``scan`` for the cases."""
    found = scan(df, key=key, text=text)
    count = lambda column, kind: F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")
    return found.select(key, *[count("base", i).alias(f"n_{KINDS[i]}") for i in range(3)], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
                        as_text(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_random"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones together, replaced by a mark; a null text stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= state["at"], F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    whole = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def redact(df: DataFrame, *, text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with all secrets in ``text`` replaced by a mark, and ``length``, if it is a column, brought up to date.

    Rows and other columns stay as they are, null and clean texts too.
    """
    names = df.columns
    taken = {n.lower() for n in names}
    base, spans, clean = (next(n for k in range(len(names) + 1) if (n := f"_{what}{k}") not in taken) for what in ("base", "spans", "clean"))
    filled = F.coalesce(F.col(text), F.lit(""))
    found = df.select("*", F.explode(F.array(base_spans(filled))).alias(base))
    found = found.select("*", F.explode(F.array(F.array_sort(F.concat(F.col(base), random_spans(filled, F.col(base)))))).alias(spans))
    found = found.select("*", F.explode(F.array(redacted(F.col(text), F.col(spans), mark))).alias(clean))
    changed = {text: F.col(clean)}
    if length and length in names and df.schema[length].dataType.typeName() in ("integer", "long"):
        changed[length] = F.when(F.size(spans) == 0, F.col(length)).otherwise(F.length(clean).cast(df.schema[length].dataType))
    return found.select(*[changed.get(n, F.col(f"`{n}`")).alias(n) for n in names])
