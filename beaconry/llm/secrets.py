"""Secret scan: fixed forms, and random-looking tokens found by a battery of randomness tests.

Base kinds (assign, access, hex) are leftmost non-overlapping matches of fixed
expressions that pass a length check. Beside them every token of SHORTEST and
more characters of [A-Za-z0-9+/_=-] between the matches of assign, without an
access or hex match in it, is a candidate.
Its encoding (decimal, hex, base32, letters and digits of one or both cases,
base64) is inferred from the characters it has, and three tests are made over
that alphabet:

* chi-squared uniformity of the symbols,
* Wald-Wolfowitz runs above and below the alphabet's middle,
* serial correlation of neighbouring symbols.

A candidate must look random in all three (no test rejects at 0.001). That alone
says little of short tokens, so the evidence against ordinary words is measured
too: how far its repeats lie below those of text (index of coincidence 0.066 for
letters) and how often it changes between small letters, capitals and digits.
Both scores grow with the length; together (Stouffer) they give a p-value under
"this is text". Benjamini-Hochberg, in strata of encoding and length, keeps the
rate of false discoveries at RATE: p-values are counted by stratum in steps of a
tenth of a decade, a table of fixed size, so all candidates of the corpus take
part and none is gathered anywhere. What is kept becomes spans of kind `random`.

Everything is built-in expressions; texts are never shuffled. Time is linear in a
text's length, in the number of its matches and in the length of a token: places
are running sums by blocks, and a token's characters are taken apart once.

Defined results: a null text counts as empty and has no spans; rows that repeat
an id are scanned on their own; without candidates nothing is added; an empty
table gives no rows; other columns are ignored (redact() keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.common import materialise, whole

SHORTEST, RATE, STEPS, BLOCK = 20, 0.01, 200, 256
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # the same as AKIA[A-Z0-9]+ with a length check after it: what is left of a run is shorter
HEX = "[0-9a-f]{24,}"
TOKEN = f"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, the expression of its tokens, the alphabet, the index of coincidence of text in it
ENCODINGS = (
    ("dec", "^[0-9]+$", DIGITS, 0.15),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.12),
    ("base32", "^[A-Z2-7]+=*$", LARGE + "234567", 0.066),
    ("small", "^[a-z]+$", SMALL, 0.066),
    ("small36", "^[a-z0-9]+$", DIGITS + SMALL, 0.066),
    ("large36", "^[A-Z0-9]+$", DIGITS + LARGE, 0.066),
    ("letters", "^[A-Za-z]+$", LARGE + SMALL, 0.066),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + LARGE + SMALL, 0.066),
    ("base64", "^", LARGE + SMALL + DIGITS + "+/-_=", 0.066),
)
CHANGES = 0.08  # of neighbours in text, those of different classes
BOUND = 3.2905  # two-sided 0.001
_SPAN = "array<struct<a:bigint,k:int,b:bigint>>"


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _starts(lengths: Column) -> Column:
    """Running sums of an array before each entry. Arrays grow within blocks of BLOCK and over the blocks only, so n entries cost about n * BLOCK copies."""

    def told(x: Column) -> Column:
        """x: n (lengths), sums (of each block)."""
        grown = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        fold = lambda values, at: F.aggregate(values, F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("out")), grown, lambda s: s["out"])
        heads = fold(x["sums"], F.lit(0).cast("long"))
        return F.flatten(F.transform(heads, lambda at, k: fold(F.slice(x["n"], (k * BLOCK + 1).cast("int"), BLOCK), at)))

    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    sums = F.transform(blocks, lambda k: F.aggregate(F.slice(lengths, k * BLOCK + 1, BLOCK), F.lit(0).cast("long"), lambda t, v: t + v))
    return F.when(F.size(lengths) > 0, _let(F.struct(lengths.alias("n"), sums.alias("sums")), told)).otherwise(F.array().cast("array<bigint>"))


def _spans(matches: Column, between: Column, k: int, offset: Column) -> Column:
    """(a, k, b) of all matches; between: the text's pieces around them, of which the first begins at offset."""
    size = F.transform(matches, lambda m: F.length(m).cast("long"))
    gaps = F.zip_with(F.slice(between, 1, F.size(matches)), size, lambda s, n: F.length(s) + n)
    place = lambda at, n: F.struct((at + n["gap"] - n["n"] + offset).alias("a"), F.lit(k).alias("k"), (at + n["gap"] + offset).alias("b"))
    told = lambda x: F.zip_with(_starts(x["gaps"]), F.zip_with(x["gaps"], x["size"], lambda g, n: F.struct(g.alias("gap"), n.alias("n"))), place)
    return F.when(F.size(matches) > 0, _let(F.struct(gaps.alias("gaps"), size.alias("size")), told)).otherwise(F.array().cast(_SPAN))


def _normal_tail(z: Column) -> Column:
    """P(Z > z), Abramowitz and Stegun 26.2.17; relative error is small for z >= 0."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(s: Column) -> Column:
    """(encoding, stratum by length, step of the p-value) of a token; step -1 where a test says it isn't random."""
    enc = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        enc = F.when(s.rlike(ENCODINGS[i][1]), i).otherwise(enc)
    alphabets, ics = F.array(*(F.lit(e[2]) for e in ENCODINGS)), F.array(*(F.lit(e[3]) for e in ENCODINGS))

    def told(x: Column) -> Column:
        """x: token, enc."""
        s, alphabet = x["s"], F.element_at(alphabets, x["enc"] + 1)
        n, k = F.length(s).cast("double"), F.length(alphabet).cast("double")
        hex_ = F.when(x["enc"] == 1, F.lower(s)).otherwise(s)
        chars = F.filter(F.split(hex_, ""), lambda c: c != "")
        return F.struct(
            x["enc"].alias("enc"), n.alias("n"), k.alias("k"), F.element_at(ics, x["enc"] + 1).alias("ic"),
            # sum of squared counts: what is left of the token without a character tells its count
            F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda t, c: t + F.pow(n - F.length(F.replace(hex_, c, F.lit(""))), 2)).alias("squares"),
            F.transform(chars, lambda c: F.call_function("instr", alphabet, c)).alias("codes"),
            F.transform(chars, lambda c: F.call_function("instr", alphabet, c) * 2 > k).alias("high"),
            F.transform(chars, lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)).alias("classes"),
        )

    def summed(x: Column) -> Column:
        ones = F.aggregate(x["high"], F.lit(0.0), lambda t, h: t + h.cast("double"))
        return F.struct(x.alias("x"), ones.alias("ones"), (F.aggregate(x["codes"], F.lit(0.0), lambda t, c: t + c) / x["n"]).alias("mean"))

    return F.transform(F.transform(F.transform(F.array(F.struct(s.alias("s"), enc.alias("enc"))), told), summed), _judged)[0]


def _changes(a: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.size(a) - 1), F.lit(0.0), lambda t, i: t + (a[i] != a[i - 1]).cast("double"))


def _judged(y: Column) -> Column:
    """y: x (told of a token), ones, mean. What a lambda names again and again is a field, so it is computed once."""
    x, ones, mean, codes = y["x"], y["ones"], y["mean"], y["x"]["codes"]
    n, k = x["n"], x["k"]
    chi = k / n * x["squares"] - n
    # Wilson and Hilferty: the cube root of chi-squared over its degrees is nearly normal.
    z_chi = (F.cbrt(chi / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    both = 2 * ones * (n - ones)
    z_runs = F.when(both > n, F.abs(_changes(x["high"]) - both / n) / F.sqrt(both * (both - n) / (n * n * (n - 1)))).otherwise(F.lit(99.0))
    square = F.aggregate(codes, F.lit(0.0), lambda t, c: t + (c - mean) * (c - mean))
    lag = F.aggregate(F.sequence(F.lit(1), F.size(codes) - 1), F.lit(0.0), lambda t, i: t + (codes[i] - mean) * (codes[i - 1] - mean))
    z_serial = F.when(square > 0, F.abs(lag / square + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    far = n * F.greatest(F.lit(0.2), k * x["ic"] - 1)
    text_chi = ((k - 1) + far - chi) / F.sqrt(2 * (k - 1) + 4 * far)
    text_runs = (_changes(x["classes"]) - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))
    # The battery's verdict enters the p-value: evidence against text counts only for what looks random.
    z = (text_chi + text_runs) / math.sqrt(2)
    step = F.floor(-10 * F.log10(F.greatest(_normal_tail(z), F.lit(1e-300))) + 1e-9)
    random = (z_chi <= 3.0902) & (z_runs <= BOUND) & (z_serial <= BOUND)
    size = F.floor(F.log2(n / SHORTEST) + 1e-9)
    return F.struct((x["enc"] * 8 + F.least(size, F.lit(7))).cast("int").alias("stratum"), F.when(random, F.least(step, F.lit(STEPS))).otherwise(-1).cast("int").alias("step"))


def annotate(docs: DataFrame) -> DataFrame:
    """docs with base (sorted spans) and found (candidates: a, b, stratum, step)."""
    t = F.col("_t")
    none = F.array().cast("array<string>")
    low = F.lower(t)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    df = docs.withColumn("_t", whole())
    df = df.withColumn("_named", named).withColumn("_key", t.contains("AKIA")).withColumn("_long", t.rlike(TOKEN))
    df = df.withColumn("_hex", F.col("_long") & t.rlike(HEX))

    def pieces(df: DataFrame, name: str, when: str, rx: str) -> DataFrame:
        # Apart from the few texts that hold such a thing, no expression is run over a text twice.
        df = df.withColumn(f"_{name}_m", F.when(F.col(when), F.regexp_extract_all(t, F.lit(rx), F.lit(0))).otherwise(none))
        return df.withColumn(f"_{name}_s", F.when(F.size(f"_{name}_m") > 0, F.split(t, rx, -1)).otherwise(none))

    for name, when, rx in (("assign", "_named", ASSIGN), ("access", "_key", ACCESS), ("hex", "_hex", HEX)):
        df = pieces(df, name, when, rx)
    zero = F.lit(0).cast("long")
    values = F.when(F.size("_assign_m") > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).otherwise(none)
    df = df.withColumn("_v", F.transform(values, lambda v: F.length(v) >= 6)).withColumn("_assign", _spans(F.col("_assign_m"), F.col("_assign_s"), 0, zero))
    kept = F.transform(F.filter(F.zip_with("_assign", "_v", lambda x, v: F.struct(x.alias("x"), v.alias("v"))), lambda y: y["v"]), lambda y: y["x"])
    base = F.concat(kept, _spans(F.col("_access_m"), F.col("_access_s"), 1, zero), _spans(F.col("_hex_m"), F.col("_hex_s"), 2, zero))
    df = df.withColumn("base", F.array_sort(base))
    # Candidates are looked for between the matches of assign; a token that holds one of the other kinds shows it by itself.
    part = lambda at, p: F.struct(at.alias("at"), p.alias("p"))
    begins = F.concat(F.array(zero), F.transform("_assign", lambda x: x["b"]))
    parts = F.when(~F.col("_long"), F.array().cast("array<struct<at:bigint,p:string>>")).when(F.size("_assign_m") > 0, F.zip_with(begins, "_assign_s", part)).otherwise(F.array(part(zero, t)))
    df = df.withColumn("_parts", F.filter(parts, lambda x: x["p"].rlike(TOKEN)))

    def tokens(x: Column) -> Column:
        """x: at, p."""
        both = F.struct(F.regexp_extract_all(x["p"], F.lit(TOKEN), F.lit(0)).alias("m"), F.split(x["p"], TOKEN, -1).alias("s"), x["at"].alias("at"))
        named = lambda y: F.zip_with(_spans(y["m"], y["s"], 3, y["at"]), y["m"], lambda v, s: F.struct(v["a"].alias("a"), v["b"].alias("b"), s.alias("s")))
        return _let(both, named)

    df = df.withColumn("_free", F.filter(F.flatten(F.transform("_parts", tokens)), lambda x: ~x["s"].rlike(HEX) & ~x["s"].rlike(ACCESS)))
    found = F.transform("_free", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), _battery(x["s"]).alias("j")))
    df = df.withColumn("found", F.transform(found, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["j"]["stratum"].alias("stratum"), x["j"]["step"].alias("step"))))
    return df.drop(*(c for c in df.columns if c.startswith("_") and c not in docs.columns))


def limits(annotated: DataFrame, rate: float = RATE) -> dict[int, int]:
    """By stratum the least step that is a discovery (Benjamini-Hochberg over all candidates)."""
    rows = annotated.select(F.explode("found").alias("x")).groupBy("x.stratum", "x.step").count().collect()  # at most 72 strata of STEPS + 2 steps
    counts: dict[int, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(r["stratum"], {})[r["step"]] = r["count"]
    out = {}
    for stratum, steps in counts.items():
        total, above = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            above += steps[step]
            if step >= 0 and 10 ** (-step / 10) <= rate * above / total:
                out[stratum] = step
    return out


def _more(limit: dict[int, int]) -> Column:
    if not limit:
        return F.array().cast(_SPAN)
    least = F.create_map(*(F.lit(x) for kv in sorted(limit.items()) for x in kv))
    kept = F.filter("found", lambda x: (x["step"] >= 0) & F.coalesce(x["step"] >= least[x["stratum"]], F.lit(False)))
    return F.transform(kept, lambda x: F.struct(x["a"].alias("a"), F.lit(3).alias("k"), x["b"].alias("b")))


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["a"].cast("string"), x["b"].cast("string"))), ",")


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans, n_random of every row (see the module's text)."""
    rows = materialise(annotate(docs.select("doc_id", "text")).select("doc_id", "base", "found"), "secrets")
    more = _more(limits(rows, rate))
    counts = [_count(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    both = F.array_sort(F.concat("base", more))
    return rows.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(both).alias("spans"), F.size(more).cast("long").alias("n_random"))


def redact(docs: DataFrame, rate: float = RATE, mark: str = "[SECRET]") -> DataFrame:
    """docs, every row and column, with each span (overlapping ones as one) replaced by mark, and n_chars following."""
    noted = annotate(docs.select(F.struct(*docs.columns).alias("_row"), "text"))  # so that no column of docs meets one of ours
    noted = materialise(noted.drop("text"), "noted").withColumn("text", F.col("_row.text"))  # scanned once: the limits and the rows both need it
    noted = noted.withColumn("_spans", F.array_sort(F.concat("base", _more(limits(noted, rate)))))
    step = lambda s, x: F.struct(
        F.greatest(s["at"], x["b"]).alias("at"),
        F.when(x["a"] >= s["at"], F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), (x["a"] - s["at"]).cast("int")), F.lit(mark))).otherwise(s["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.aggregate("_spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))))
    has = F.size("_spans") > 0
    noted = noted.withColumn("text", F.when(has, text).otherwise(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.when(has, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return noted.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
