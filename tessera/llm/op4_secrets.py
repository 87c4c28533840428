r"""Secret scanning by rules and a battery of randomness tests, in DataFrame expressions only.

Rules: values assigned to secret-like names, access-key ids, and long hexadecimal runs.  Beside them,
every token of LEAST or more characters is a candidate that has a digit, or a capital after a small letter (others
can't pass: their classes never change).  Its encoding is inferred (hex, base32, base36, base62, base64), and its
symbols go through three tests of randomness within that alphabet: chi-squared uniformity, the runs test over the
classes digit, capital and small letter, and lag-1 serial correlation.  Tokens that the battery calls non-random
(least p-value under `reject`, Bonferroni over the three) are dropped.

What is left is tested the other way: could ordinary text give this?  The statistics of uniformity and of runs are
referred to their distributions under text of the token's length: symbols that coincide as often as letters do, and
classes that change at a rate of SWITCH (a capital that begins a word counts as small, signs as nothing).  Both
p-values are upper bounds (a normal bound of the lower tail, Chernoff's of the upper), fall with the length, and are
combined by Fisher's rule.  The Benjamini-Hochberg rule over the document's candidates, with weights in proportion to
their lengths, bounds the false-discovery rate by `fdr`.

Families are documents, so a document's result depends on nothing else and no shuffle is needed.
Positions are code points, from the pieces between matches; no Python runs on the executors.

Defined results: null text is empty and has no spans.  Spans are ordered by start, then by kind in the
order assign, access, hex, random; a random span that overlaps a rule span is left out.  Equal texts get equal
spans; an empty table gives an empty one; extra columns pass through, one called as `out` as `out`_input.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import cleared, fresh

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
LEAST = 16
TOKEN = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{{{LEAST}}})(?=[A-Za-z0-9+/_-]*?(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_-]++={{0,2}}"
KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
REJECT = 0.001

#: Symbol orders of the encodings.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {"hex": DIGITS + LOWER[:6], "base32": LOWER.upper() + "234567", "base36": DIGITS + LOWER, "base62": DIGITS + LOWER.upper() + LOWER, "base64": LOWER.upper() + LOWER + DIGITS + "+/-_"}
#: Ordinary text: how often two symbols of a token coincide, and three; by the kind of alphabet.  And how often classes change.
COINCIDE = {"hex": (0.10, 0.014)} | {k: (0.06, 0.005) for k in ("base32", "base36", "base62", "base64")}
SWITCH = 0.12
#: Matches whose places are summed in one fold.
FOLD = 64

Spans = "array<struct<kind:string,s:bigint,e:bigint,found:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Matches of pattern as (kind, s, e, found), positions from the lengths of matches and of the pieces between them."""
    long_ = lambda c: c.cast("bigint")
    none = F.array().cast(Spans)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.length(x["found"])
        one = F.array(F.struct(F.lit(kind).alias("kind"), long_(s).alias("s"), long_(e).alias("e"), x["found"].alias("found")))
        return F.struct(long_(e).alias("at"), F.when(x["size"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def placed(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, long_(F.lit(0)), lambda t, x: t + x["gap"] + F.length(x["found"])))
        starts = F.aggregate(totals, F.struct(long_(F.lit(0)).alias("at"), F.array().cast("array<bigint>").alias("out")), lambda acc, t: F.struct((acc["at"] + t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.transform(F.arrays_zip(parts.alias("part"), starts.alias("at")), lambda p: F.aggregate(p["part"], F.struct(p["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    def parts(rows: Column) -> Column:
        """Prefix sums go in folds of FOLD matches, and over the folds' totals, so that no fold grows with the text."""
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / FOLD)), lambda k: F.slice(rows, (k * FOLD + 1).cast("int"), F.lit(FOLD)))

    def of(found: Column) -> Column:
        sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found, F.length)
        pieces = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found))
        rows = F.arrays_zip(pieces.alias("gap"), found.alias("found"), sizes.alias("size"))
        return F.when(F.size(found) > 0, let(let(rows, parts), placed)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def normal_upper(z: Column) -> Column:
    """P(Z > z) by the logistic approximation, good to 2e-4."""
    return 1.0 / (1.0 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(700.0))))


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32").when(token.rlike("^[0-9a-z]+$"), "base36").when(token.rlike("^[0-9A-Za-z]+$"), "base62").otherwise("base64")
    )


def symbols(token: Column, code: Column) -> Column:
    """Places of the token's characters in its alphabet, from 0; padding is left out."""
    letters = F.split(F.rtrim(token, F.lit("=")), "")
    alphabet = F.create_map(*[F.lit(x) for k, v in ALPHABETS.items() for x in (k, v)])[code]
    folded = F.when(code == "hex", F.transform(letters, F.lower)).otherwise(letters)
    return F.transform(folded, lambda c: F.when((code == "base64") & c.isin("+", "-"), 62).when((code == "base64") & c.isin("/", "_"), 63).otherwise(F.instr(alphabet, c) - 1))


def classes(token: Column) -> Column:
    """The token's letters and digits, each as its class: 0, A or a."""
    kept = F.regexp_replace(token, "[^A-Za-z0-9]+", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")


def runs_of(kinds: Column) -> Column:
    return F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")).cast("double")


def runs_test(kinds: Column) -> Column:
    """Two-sided p-value of the number of runs of the classes, given their counts; 0 where there is one class only."""
    n = F.length(kinds).cast("double")
    counts = [n - F.length(F.replace(kinds, F.lit(c))) for c in "0Aa"]
    two, three = sum((c * c for c in counts), F.lit(0.0)), sum((c * c * c for c in counts), F.lit(0.0))
    mean = n + 1 - two / n
    spread = (two * (two + n * (n + 1)) - 2 * n * three - n * n * n) / (n * n * (n - 1))
    return F.when(F.greatest(*counts) == n, F.lit(0.0)).otherwise(2 * normal_upper(F.abs(runs_of(kinds) - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))))


def text_log_p(code: Column, n: Column, pairs: Column, folded: Column) -> Column:
    """Log of the p-value that ordinary text of this length has so few coinciding symbols and so many changes of class (Fisher's rule on both)."""
    two, three = (F.create_map(*[F.lit(x) for k, q in COINCIDE.items() for x in (k, q[i])])[code] for i in (0, 1))
    every = n * (n - 1) / 2
    spread = F.sqrt(every * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two))
    few = F.log(F.least(normal_upper((every * two - pairs - 0.5) / spread), F.lit(1.0)))
    places = F.length(folded) - 1.0
    rate = (runs_of(folded) - 1) / F.greatest(places, F.lit(1.0))
    entropy = rate * F.log(F.greatest(rate, F.lit(1e-12)) / SWITCH) + (1 - rate) * F.log(F.greatest(1 - rate, F.lit(1e-12)) / (1 - SWITCH))
    many = F.when(rate > SWITCH, -places * entropy).otherwise(0.0)
    both = few + many
    return both + F.log(1 - both)


def battery(token: Column) -> Column:
    """(code, n, p_uniform, p_runs, p_serial, log_p) of a token: the three tests of randomness, and the log of the p-value under ordinary text."""
    code = encoding(token)
    s = symbols(token, code)
    made = F.transform(F.array(F.struct(code.alias("code"), s.alias("s"))), lambda x: F.struct(x["code"].alias("code"), x["s"].alias("s"), classes(token).alias("classes"), classes(F.regexp_replace(token, "[A-Z](?=[a-z])", "a")).alias("folded"), F.size(x["s"]).cast("double").alias("n"), F.create_map(*[F.lit(v) for k, a in ALPHABETS.items() for v in (k, float(min(64, len(a))))])[x["code"]].alias("a")))

    def tests(x: Column) -> Column:
        n, a, s = x["n"], x["a"], x["s"]
        squares = F.aggregate(F.array_distinct(s), F.lit(0.0), lambda t, d: t + F.pow(F.size(F.filter(s, lambda y: y == d)).cast("double"), F.lit(2.0)))
        k = a - 1
        chi = a / n * squares - n
        uniform = normal_upper((F.pow(F.greatest(chi, F.lit(1e-9)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)))
        p_runs = runs_test(x["classes"])
        middle = F.aggregate(s, F.lit(0.0), lambda t, y: t + y) / n
        var = F.aggregate(s, F.lit(0.0), lambda t, y: t + (y - middle) * (y - middle))
        pairs = F.arrays_zip(F.slice(s, F.lit(1), F.size(s) - 1).alias("x"), F.slice(s, F.lit(2), F.size(s) - 1).alias("y"))
        serial = F.aggregate(pairs, F.lit(0.0), lambda t, p: t + (p["x"] - middle) * (p["y"] - middle)) / F.greatest(var, F.lit(1e-9))
        p_serial = F.when(var == 0, F.lit(0.0)).otherwise(2 * normal_upper(F.abs(serial) * F.sqrt(n)))
        return F.struct(x["code"].alias("code"), n.alias("n"), uniform.alias("p_uniform"), p_runs.alias("p_runs"), p_serial.alias("p_serial"), text_log_p(x["code"], n, (squares - n) / 2, x["folded"]).alias("log_p"))

    return F.element_at(F.transform(made, tests), 1)


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets", *, fdr: float = FDR, reject: float = REJECT) -> DataFrame:
    """docs with an array column `out` of (kind, s, e, found, random), rules and randomness together; random says whether the battery calls it so."""
    docs = cleared(docs, out)
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(Spans)
    named = let(F.lower(text), lambda low: functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in ("passw", "secret", "token", "apikey", "api_key")]))
    assign = F.when(named, spans_of(text, ASSIGN, "assign", 1, 8)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), spans_of(text, ACCESS, "access")).otherwise(none)
    hexes = F.when(text.rlike("[0-9a-f]{32}"), spans_of(text, HEX, "hex")).otherwise(none)
    tokens = F.when(text.rlike(TOKEN), spans_of(text, TOKEN, "random")).otherwise(none)
    rules, cand, tested = (fresh(docs, f"{out}_{x}") for x in ("rules", "candidates", "tested"))
    docs = docs.withColumn(rules, F.concat(assign, access, hexes)).withColumn(cand, tokens)
    free = F.filter(F.col(cand), lambda c: ~F.exists(F.col(rules), lambda r: (r["s"] < c["e"]) & (c["s"] < r["e"])))
    # What a rule found is judged too, by its last token; its span stays whatever the answer.
    every = F.transform(F.concat(F.col(rules), free), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), F.when(c["kind"] == "random", c["found"]).otherwise(F.regexp_extract(c["found"], "([A-Za-z0-9+/_-]+={0,2})$", 1)).alias("token")))
    scored = F.transform(F.filter(every, lambda c: F.length(c["token"]) >= LEAST), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), battery(c["token"]).alias("t")))
    docs = docs.withColumn(cand, free).withColumn(tested, scored)
    passed = F.filter(F.col(tested), lambda c: 3 * F.least(c["t"]["p_uniform"], c["t"]["p_runs"], c["t"]["p_serial"]) >= reject)
    family = F.size(F.col(tested)).cast("double")
    mean = F.aggregate(F.col(tested), F.lit(0.0), lambda t, c: t + c["t"]["n"]) / family
    ranked = F.array_sort(F.transform(passed, lambda c: F.struct((c["t"]["log_p"] - F.log(c["t"]["n"] / mean)).alias("p"), c["kind"].alias("kind"), c["s"].alias("s"))))
    docs = docs.withColumn(tested, F.struct(family.alias("family"), ranked.alias("ranked")))
    ranked, family = F.col(tested)["ranked"], F.col(tested)["family"]
    good = F.filter(F.transform(ranked, lambda c, i: F.when(c["p"] <= F.log((i + 1) * F.lit(fdr) / family), i + 1).otherwise(0)), lambda i: i > 0)
    docs = docs.withColumn(tested, F.slice(ranked, F.lit(1), F.coalesce(F.array_max(good), F.lit(0))))
    judged = F.transform(F.concat(F.col(rules), F.col(cand)), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["found"].alias("found"), F.exists(F.col(tested), lambda k: (k["s"] == c["s"]) & (k["kind"] == c["kind"])).alias("random")))
    found = F.filter(judged, lambda c: c["random"] | (c["kind"] != "random"))
    place = lambda c: F.array_position(F.array(*[F.lit(k) for k in KINDS]), c["kind"])
    ordered = F.array_sort(found, lambda x, y: F.when(x["s"] != y["s"], F.signum((x["s"] - y["s"]).cast("double")).cast("int")).otherwise((place(x) - place(y)).cast("int")))
    return docs.withColumn(out, ordered).drop(rules, cand, tested)
