"""Secrets in texts: fixed patterns, and a battery of randomness tests with false-discovery control. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns, the least length of what they find, and the kinds in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]{24,}"  # runs of hex digits are maximal, so that shorter ones can be left out in the pattern
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Upper ends of the length classes in which false discoveries are controlled.
LENGTHS = (23, 31, 47, 63)
#: Chance that two neighbouring characters of ordinary words differ in kind (lower, upper, digit, other).
TEXT_CHANGES = 0.05
FALSE_DISCOVERIES = 0.01
#: The 0.999 quantile of chi-squared with three degrees of freedom.
BATTERY_MOST = 16.27
STEPS = 400


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end, match>> of a pattern's matches, in code points; `keep` decides on (match, group 2).

    Spark gives matches without their places. The text between them, cut out by the same pattern, gives the distances.
    """
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias(name) for name, group in (("m", 0), ("v", 2)) if keep or not group]
    empty = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, kind: int, end: int, match: string>>))")
    parts = F.filter(F.arrays_zip(*found, F.split(text, pattern, -1).alias("g")), lambda part: part["m"].isNotNull())  # the last gap has no match

    def step(state, part):
        start = (state["at"] + F.length(part["g"])).cast("int")
        end = (start + F.length(part["m"])).cast("int")
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["m"].alias("match")))
        spans = F.concat(state["spans"], span)
        return F.struct(end.alias("at"), (F.when(keep(part["m"], part["v"]), spans).otherwise(state["spans"]) if keep else spans).alias("spans"))

    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int, match: string>>)")
    return F.when(text.rlike(pattern), F.aggregate(parts, empty, step)["spans"]).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns, sorted by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    assign = _spans(text, ASSIGN, 0, lambda m, value: F.length(value) >= ASSIGN_LEAST)
    access = F.filter(_spans(text, ACCESS, 1), lambda s: s["end"] - s["start"] >= ACCESS_LEAST)
    return F.array_sort(F.concat(assign, access, _spans(text, HEX, 2)))


def battery(token: Column) -> Column:
    """struct<unlike, log_p> of a token of 20 or more characters.

    The encoding is the smallest alphabet that has all characters. `unlike` sums the squares of three standard scores
    against random symbols of it: excess of chi-squared over a uniform alphabet, runs above and below the
    alphabet's middle, and serial correlation of neighbours. `log_p` bounds the (natural) log probability that ordinary
    words change as often between lower, upper, digit and other characters, by Chernoff's bound on the binomial.
    """
    plain = F.translate(token, "-_", "+/")
    kind = F.when(plain.rlike("^[0-9a-f]+$") | plain.rlike("^[0-9A-F]+$"), "hex").when(plain.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    alphabet = F.when(kind == "hex", F.lit(ALPHABETS["hex"])).when(kind == "base32", F.lit(ALPHABETS["base32"])).otherwise(F.lit(ALPHABETS["base64"]))
    named = F.struct(alphabet.alias("alphabet"), F.when(kind == "hex", F.lower(plain)).otherwise(plain).alias("t"))

    def setup(x: Column) -> Column:
        symbols = F.filter(F.split(x["t"], "", -1), lambda c: c != "")
        places = F.transform(symbols, lambda c: F.instr(x["alphabet"], c).cast("double"))
        return F.struct(F.length(x["alphabet"]).cast("double").alias("k"), F.length(x["t"]).cast("double").alias("n"), places.alias("v"), x["t"].alias("t"), F.array_distinct(symbols).alias("d"))

    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, y: a + y)

    # Sums are named before the lambdas that need them, which would else repeat them for every symbol.
    def sums(x: Column) -> Column:
        n, k, v = x["n"], x["k"], x["v"]
        squares = total(F.transform(x["d"], lambda c: F.pow(n - F.length(F.replace(x["t"], c, F.lit(""))), F.lit(2.0))))
        above = total(F.transform(v, lambda y: (y > k / 2).cast("double")))
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(n.alias("n"), k.alias("k"), (k / 2).alias("half"), v.alias("v"), pairs.alias("pairs"), squares.alias("squares"), above.alias("above"), (total(v) / n).alias("mean"))

    def scores(x: Column) -> Column:
        n, k, v, half, above, mean = (x[c] for c in ("n", "k", "v", "half", "above", "mean"))
        chi = F.greatest((k / n * x["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)), F.lit(0.0))
        both = 2 * above * (n - above)
        changes = total(F.transform(x["pairs"], lambda p: ((p["a"] > half) != (p["b"] > half)).cast("double")))
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, (changes - both / n) / F.sqrt(spread)).otherwise(F.lit(1e3))
        variance = total(F.transform(v, lambda y: (y - mean) * (y - mean)))
        products = total(F.transform(x["pairs"], lambda p: (p["a"] - mean) * (p["b"] - mean)))
        serial = F.when(variance > 0, (products / variance + 1 / n) * F.sqrt(n)).otherwise(F.lit(1e3))
        return chi * chi + runs * runs + serial * serial

    unlike = F.element_at(F.transform(F.transform(F.transform(F.array(named), setup), sums), scores), 1)
    kinds = F.translate(token, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "a" * 26 + "A" * 26 + "0" * 10 + "----")
    places = (F.length(token) - 1).cast("double")
    changes = places + 1 - F.length(F.regexp_replace(kinds, r"(.)(?=\1)", ""))
    share = F.greatest(1 - changes / places, F.lit(TEXT_CHANGES))
    bound = -places * (share * F.log(share / TEXT_CHANGES) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - TEXT_CHANGES))).otherwise(0.0))
    return F.struct(unlike.alias("unlike"), bound.alias("log_p"))


def _length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for i in reversed(range(len(LENGTHS))):
        out = F.when(n <= LENGTHS[i], F.lit(i)).otherwise(out)
    return out


def _candidates(text: Column) -> Column:
    spans = _spans(F.coalesce(text, F.lit("")), TOKEN, 3)
    return F.transform(spans, lambda s: s.withField("test", battery(s["match"])))


def thresholds(docs: DataFrame, text: str = "text") -> dict[int, float]:
    """Benjamini-Hochberg limits on log_p, by length class, over the tokens of all texts.

    p-values are counted in tenths of a decade, at most (classes x STEPS) rows whatever the corpus; the limit is the largest p whose
    bound on false discoveries holds. Classes without any discovery are absent.
    """
    tokens = docs.select(F.explode(_candidates(F.col(text))).alias("s"))
    step = F.least(F.floor(-F.col("s.test.log_p") / F.log(F.lit(10.0)) * 10), F.lit(STEPS)).cast("int")
    counts = tokens.groupBy(_length_class(F.length("s.match")).alias("length"), step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    reach = F.sum("n").over(Window.partitionBy("length").orderBy(F.desc("step")))
    limits = counts.withColumn("reach", reach).withColumn("all", F.sum("n").over(Window.partitionBy("length")))
    limits = limits.where(F.pow(F.lit(10.0), -F.col("step") / 10) <= FALSE_DISCOVERIES * F.col("reach") / F.col("all"))
    rows = limits.groupBy("length").agg(F.min("step").alias("step")).collect()  # a row per length class
    return {r["length"]: r["step"] for r in rows}


def all_spans(text: Column, limits: dict[int, int]) -> tuple[Column, Column]:
    """(base spans, all spans) of a text column, each sorted by start, then kind."""
    base = base_spans(text)
    if not limits:
        return base, base
    step = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])

    def random(s: Column) -> Column:
        limit = F.try_element_at(step, _length_class(F.length(s["match"])))
        return (s["test"]["unlike"] <= BATTERY_MOST) & (F.least(F.floor(-s["test"]["log_p"] / F.log(F.lit(10.0)) * 10), F.lit(STEPS)) >= limit)

    extra = F.transform(F.filter(_candidates(text), random), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["match"].alias("match")))
    return base, extra


def scan(docs: DataFrame, text: str = "text", limits: dict[int, int] | None = None) -> DataFrame:
    """`docs` with `base` and `spans`: array<struct<start, kind, end, match>>, sorted by start, then kind.

    `kind` counts in KINDS. Base spans are those of the fixed patterns, per kind leftmost and non-overlapping. The battery adds
    tokens that pass for random symbols of their encoding, are no ordinary words at a false-discovery rate of 1 % among the
    tokens of like length in all texts, and don't lie within a base span. Two passes read the texts; only
    counts of p-values are shuffled. Null and empty texts have no spans. A column named `base` or `spans` is replaced.
    """
    limits = thresholds(docs, text) if limits is None else limits
    base, extra = all_spans(F.col(text), limits)
    out = docs.withColumn("base", base)
    if not limits:
        return out.withColumn("spans", F.col("base"))
    fresh = F.filter(extra, lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    return out.withColumn("spans", F.array_sort(F.concat("base", fresh)))


def spans_text(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by `mask`; overlapping spans are one stretch. Null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        new = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], new).otherwise(state["out"]).alias("out"))

    done = lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)
