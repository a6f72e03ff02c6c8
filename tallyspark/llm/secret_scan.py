"""Secret scans with Spark expressions only: fixed patterns, and a battery of randomness tests.

Base kinds are found by their patterns, leftmost and without overlaps within a kind. Other long tokens are candidates for
the battery. From its characters a token's encoding is inferred (digits, hex, base 26, 32, 36, 62 or 64), and three tests ask
whether its symbols could be random: chi-squared uniformity over the alphabet, the number of runs of low and high symbols,
and serial correlation. A token that fails one at level ``alpha`` (shared among the three) is text.

A token that passes could still be an ordinary one, so the evidence is weighed: the likelihood of its symbols if they are uniform
over the inferred alphabet, against that of an ordinary token, whose letters follow each other as in all different ordinary
words of the corpus and which changes between lower case, upper case, digits and signs at most at every seventh character. Under the
ordinary model the ratio reaches ``r`` with a chance of at most ``1 / r``, whatever the length. Within each length class the
Benjamini-Hochberg rule over all candidates of the corpus keeps the false discovery rate at ``fdr``; chances are sorted into
narrow bins, each bin counting as its largest chance.

Results: one row for each input row. A null text is empty and has no spans. Repeated rows give repeated results; other
columns are ignored unless asked for. Positions count code points; ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import stage

# The patterns of the base kinds, in the order of kinds, and their least sizes.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE16 = "0123456789abcdef"
# Encodings by their alphabets, the narrowest first; a token has the first that holds all its symbols.
ENCODINGS = (
    ("digits", "^[0-9]+$", BASE62[:10]), ("hex", "^[0-9a-f]+$", BASE16), ("lower", "^[a-z]+$", BASE62[36:]), ("upper", "^[A-Z]+$", BASE62[10:36]),
    ("base32", "^[A-Z2-7]+$", BASE32), ("lower36", "^[a-z0-9]+$", BASE62[:10] + BASE62[36:]), ("upper36", "^[A-Z0-9]+$", BASE62[:36]),
    ("base62", "^[A-Za-z0-9]+$", BASE62), ("base64", "", BASE64),
)
ORDINARY = r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,19}(?![A-Za-z0-9+/_=-])"
LETTERS = BASE62[36:] + BASE62[:10]  # places 1 to 26; all digits count as place 27, signs as 0
PLACES = 28
SIGNS = "+/_-"
SMOOTHING = 20.0  # further pairs by each first letter, dealt like all letters

ALPHA = 0.001
FDR = 0.001
CHANGE_RATE = 0.15
BINS_PER_UNIT = 20
MAX_BIN = 4_000  # chances below e**-200 count as that
BLOCK = 256
MASK = "[SECRET]"


def spans_of(text: Column, pattern: str) -> Column:
    """Start and end of all matches, from the lengths of the matches and of what lies between them.

    Running sums are taken in blocks, so that the work stays close to linear in the number of matches.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len")))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def blocks(all_steps: Column) -> Column:
        starts = F.sequence(F.lit(0), (F.size(all_steps) - 1).cast("int"), F.lit(BLOCK))
        sizes = F.transform(
            starts,
            lambda s: F.aggregate(F.slice(all_steps, s + 1, BLOCK), F.lit(0), lambda a, x: a + x["gap"] + x["len"]),
        )
        first = F.aggregate(
            sizes, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
        )

        def block(s: Column, k: Column) -> Column:
            zero = F.struct(F.get(first, k).alias("at"), none.alias("out"))

            def step(a: Column, x: Column) -> Column:
                start = a["at"] + x["gap"]
                end = start + x["len"]
                return F.struct(
                    end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out")
                )

            return F.aggregate(F.slice(all_steps, s + 1, BLOCK), zero, step, lambda a: a["out"])

        return F.flatten(F.transform(starts, block))

    # Bound once by a one-element array, so that the pattern is matched once for each text.
    found = F.flatten(F.transform(F.array(steps), blocks))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """Two-sided chance of a standard normal value beyond z; a rational approximation, good to 2e-7."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def letter_pairs(docs: DataFrame, text_column: str = "text") -> list[float]:
    """Log chances of each place (0 signs, 1 to 26 letters, 27 digits) after each place, by rows, from all ordinary words of the corpus.

    Each different word counts once, so that a line repeated without end decides nothing; 27 x 26 counts reach the driver.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_column), F.lit(ORDINARY), F.lit(0))).alias("word"))
    words = words.select(F.lower("word").alias("word")).distinct()
    places = F.transform(F.split("word", ""), lambda c: F.instr(F.lit(LETTERS), c))
    pairs = words.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), places).alias("a"), places.alias("b"))).alias("p"))
    counts = pairs.filter("p.b is not null").groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("rows")).collect()
    seen = {(r.a, r.b): r.rows for r in counts}
    after = [sum(seen.get((a, b), 0) for b in range(1, 27)) for a in range(PLACES)]
    each = [sum(seen.get((a, b), 0) for a in range(PLACES)) + 1.0 for b in range(1, 27)]
    table = []
    for a in range(PLACES):
        given = [(seen.get((a, b), 0) + SMOOTHING * each[b - 1] / sum(each)) / (after[a] + SMOOTHING) for b in range(1, 27)]
        table += [-math.log(len(SIGNS)), *[math.log(p) for p in given], -math.log(10)]
    return table


def randomness(token: Column, table: list[float]) -> Column:
    """Struct of the battery's results for a token: encoding, n, p_random, p_word; ``table`` are the letter pairs of ordinary words."""
    chances = F.array(*[F.lit(p) for p in table])

    def bound(value: Column, use) -> Column:
        """``use`` of a value that is evaluated once, however often and in whatever loop it is used."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def prepared(body: Column) -> Column:
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[a-z]", "x"), "[A-Z]", "y"), "[0-9]", "z")
        return F.struct(
            F.lower(body).alias("folded"),
            F.when(body.rlike("^[0-9A-F]+$"), F.lower(body)).otherwise(F.translate(body, "-_", "+/")).alias("lowered"),
            F.translate(classes, "+/_-", "wwww").alias("classes"),
        )

    def encoded(t: Column) -> Column:
        place = F.lit(len(ENCODINGS) - 1)
        for k, (_, pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
            place = F.when(t["lowered"].rlike(pattern), k).otherwise(place)
        repeats = F.length(t["classes"]) - F.length(F.regexp_replace(t["classes"], r"(.)(?=\1)", ""))  # of a class
        return F.struct(place.alias("place"), t["folded"].alias("folded"), t["lowered"].alias("lowered"), repeats.alias("repeats"))

    def symbols(t: Column) -> Column:
        alphabet = F.element_at(F.array(*[F.lit(alphabet) for _, _, alphabet in ENCODINGS]), t["place"] + 1)
        return F.struct(
            F.element_at(F.array(*[F.lit(name) for name, _, _ in ENCODINGS]), t["place"] + 1).alias("encoding"),
            F.length(t["lowered"]).alias("n"), F.length(alphabet).cast("double").alias("k"),
            F.transform(F.split(t["lowered"], ""), lambda c: F.instr(alphabet, c) - 1).alias("x"),
            F.transform(F.split(t["folded"], ""), lambda c: F.least(F.instr(F.lit(LETTERS), c), F.lit(PLACES - 1))).alias("y"),
            (F.length(t["lowered"]) - 1).cast("double").alias("places"), (F.length(t["lowered"]) - 1 - t["repeats"]).cast("double").alias("changes"),
        )

    def tests(g: Column) -> Column:
        x, k, n = g["x"], g["k"], g["n"].cast("double")
        squares = F.aggregate(
            F.array_distinct(x), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0))
        )
        chi = k / n * squares - n
        z_chi = F.greatest((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), F.lit(0.0))
        pairs = F.sequence(F.lit(1), g["n"] - 1)
        runs = 1.0 + F.aggregate(
            pairs, F.lit(0.0),
            lambda a, i: a + F.when((F.get(x, i - 1) * 2 >= k) != (F.get(x, i) * 2 >= k), 1.0).otherwise(0.0),
        )
        z_runs = (runs - (n + 1) / 2) / F.sqrt((n - 1) / 4)
        middle = (k - 1) / 2
        product = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + (F.get(x, i - 1) - middle) * (F.get(x, i) - middle))
        z_serial = product / ((k * k - 1) / 12) / F.sqrt(n - 1)
        p_random = F.least(F.lit(1.0), 3 * F.least(_normal_tail(z_chi), _normal_tail(z_runs), _normal_tail(z_serial)))
        start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
        letters = F.aggregate(
            g["y"], start,
            lambda a, v: F.struct(v.alias("last"), (a["sum"] + F.get(chances, a["last"] * PLACES + v)).alias("sum")), lambda a: a["sum"],
        )
        # The rate of class changes, up to its limit, that suits the token best; a change goes to one of three other classes.
        rate = F.least(g["changes"] / F.greatest(g["places"], F.lit(1.0)), F.lit(CHANGE_RATE))
        classes = g["changes"] * F.ln(F.greatest(rate, F.lit(1e-12)) / 3) + (g["places"] - g["changes"]) * F.ln(1 - rate)
        p_word = F.exp(F.least(letters + classes + n * F.ln(k), F.lit(0.0)))
        return F.struct(g["encoding"].alias("encoding"), g["n"].alias("n"), p_random.alias("p_random"), p_word.alias("p_word"))

    given = bound(bound(bound(F.regexp_replace(token, "=+$", ""), prepared), encoded), symbols)
    return bound(given, tests)


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.ln(F.greatest(p, F.lit(1e-300))) * BINS_PER_UNIT), F.lit(MAX_BIN)).cast("int")


def _length_class(n: Column) -> Column:
    return F.least(F.floor(F.log2(n.cast("double"))), F.lit(12)).cast("int")


def cut_bins(candidates: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """The lowest bin of chances that counts as found, for each length class; at most thirteen classes."""
    bins = candidates.groupBy(_length_class(F.col("n")).alias("size"), _bin(F.col("p_word")).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    rarer = Window.partitionBy("size").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("size")
    largest = F.exp(-F.col("bin") / BINS_PER_UNIT)
    passed = bins.select("size", "bin", F.sum("rows").over(rarer).alias("found"), F.sum("rows").over(whole).alias("all")).filter(
        largest <= fdr * F.col("found") / F.col("all")
    )
    return {r["size"]: r["bin"] for r in passed.groupBy("size").agg(F.min("bin").alias("bin")).collect()}


def scan(
    docs: DataFrame, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), alpha: float = ALPHA, fdr: float = FDR
) -> DataFrame:
    """The columns ``keep`` packed in a struct ``row``, and ``spans``: all secrets (kind, start, end, place of kind), sorted."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), text.alias("text"))
    values = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))
    assigned = F.filter(spans_of(F.col("text"), ASSIGN), lambda s, i: F.length(F.get(values, i)) >= ASSIGN_VALUE)

    def kind(spans: Column, place: int) -> Column:
        return F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"))
        )

    tokens, table = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), letter_pairs(rows)
    found = rows.select(
        "row",
        F.concat(
            kind(F.when(F.col("text").rlike(ASSIGN), assigned).otherwise(F.array().cast("array<struct<start:int,end:int>>")), 0),
            kind(spans_of(F.col("text"), ACCESS), 1), kind(spans_of(F.col("text"), HEX), 2),
        ).alias("base"),
        F.when(
            F.col("text").rlike(CANDIDATE),
            F.zip_with(spans_of(F.col("text"), CANDIDATE), tokens, lambda s, t: F.struct(s.alias("span"), t.alias("token"))),
        ).otherwise(F.array().cast("array<struct<span:struct<start:int,end:int>,token:string>>")).alias("tokens"),
    )
    free = F.filter(
        "tokens",
        lambda t: ~F.exists("base", lambda b: (b["start"] < t["span"]["end"]) & (t["span"]["start"] < b["end"])),
    )
    tested = stage(
        found.select(
            "row", "base",
            F.transform(free, lambda t: F.struct(t["span"].alias("span"), randomness(t["token"], table).alias("r"))).alias("candidates"),
        ),
        "secrets",
    )
    each = tested.select(F.explode("candidates.r").alias("r")).select("r.*")
    cuts = cut_bins(each, fdr)

    def is_random(c: Column) -> Column:
        cut = F.lit(None).cast("int")
        for size, lowest in cuts.items():
            cut = F.when(_length_class(c["r"]["n"]) == size, lowest).otherwise(cut)
        return F.coalesce((_bin(c["r"]["p_word"]) >= cut) & (c["r"]["p_random"] >= alpha), F.lit(False))

    more = F.transform(F.filter("candidates", is_random), lambda c: c["span"])
    return tested.select(
        "row",
        F.transform(
            F.array_sort(F.concat("base", kind(more, 3))),
            lambda s: F.struct(
                F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["place"] + 1).alias("kind"),
                s["start"].alias("start"), s["end"].alias("end"), s["place"].alias("place"),
            ),
        ).alias("spans"),
    )


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column, by: str = MASK) -> Column:
    """The text with every secret replaced; spans that overlap are replaced as one."""

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(by))).otherwise(a["out"]).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)
