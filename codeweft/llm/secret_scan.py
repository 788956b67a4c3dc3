"""Secret scan with a battery of randomness tests (native).

Base patterns find assignments, access keys and long hex strings. Beside them,
runs of 20 and more key characters are tested: the encoding is inferred from
the characters, then chi-squared uniformity over its alphabet, the number of
runs above and below its middle, and serial correlation say whether the string
looks drawn at random. Whether it could be ordinary text is judged by the
likelihood ratio against a fixed model of letters; its inverse bounds the
p-value and grows with length. Both kinds of p-values go through
Benjamini-Hochberg over all candidates of the corpus, by band of length: those
of the likelihood find what isn't ordinary text, with a share of false
discoveries of ``FDR``; those of the battery find what isn't random, with a
share of ``ALPHA`` of random strings among the strings that are refused.

Defined results: null counts as empty; positions are code points, ends
exclusive; a tested string that overlaps a base span is not reported again;
repeated rows each get their own row; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm._store import materialise, once

#: The base patterns (group 1: what is measured) and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
#: What the battery looks at.
CANDIDATE = r"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,})"
KINDS = ("assign", "access", "hex", "random")

FDR = 0.01
#: Share of false ones among the strings that the battery refuses.
ALPHA = 0.001
#: Letter frequencies of the model of ordinary text, a to z.
LETTERS = (0.080, 0.015, 0.030, 0.040, 0.125, 0.023, 0.020, 0.050, 0.072, 0.002, 0.007, 0.042, 0.025, 0.072, 0.074, 0.020, 0.001, 0.062, 0.065, 0.090, 0.030, 0.010, 0.020, 0.002, 0.019, 0.004)
#: Probability that an ordinary text's next character is of the same class
#: (lower case, upper case, digit, other), and of each other class.
STAY, SWITCH = 0.94, 0.02
_BIN, _MOST = 0.05, 1200

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as start, kind, end;
    those whose group 1 is shorter than ``least`` are dropped afterwards.
    ``\\G`` ties every search to the end of the last match, so a text is
    walked once."""
    rule = rf"\G(?s:(.*?))({pattern})"
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(rule), F.lit(g)).alias(n) for g, n in ((1, "gap"), (2, "hit"), (3, "value"))])
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        own = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step)["out"]).otherwise(F.array().cast(_SPAN))


def _strings(text: Column, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("string")))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(strings: DataFrame) -> DataFrame:
    """``strings`` with ``p_random``, the combined p-value of the tests under
    the hypothesis of random characters, and ``evidence``, the log-likelihood
    ratio of random characters against ordinary text."""
    s = F.rtrim(F.col("string"), F.lit("="))
    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sets = [("^[0-9]+$", digits), ("^[a-z]+$", lower), ("^[A-Z]+$", upper), ("^[A-Za-z]+$", upper + lower), ("^[0-9a-f]+$", digits + "abcdef"), ("^[0-9A-F]+$", digits + "ABCDEF"), ("^[A-Z2-7]+$", upper + "234567"), ("^[0-9a-z]+$", digits + lower), ("^[0-9A-Z]+$", digits + upper), ("^[0-9A-Za-z]+$", digits + upper + lower)]
    alphabet = F.lit(digits + upper + lower + "+/_-=")
    size = F.lit(64)
    for rule, chars in reversed(sets):
        alphabet = F.when(F.col("s").rlike(rule), F.lit(chars)).otherwise(alphabet)
        size = F.when(F.col("s").rlike(rule), F.lit(len(chars))).otherwise(size)
    base = strings.withColumn("s", s).where("length(s) >= 16")
    base = once(base, alphabet=alphabet, a=size.cast("double"), chars=F.filter(F.split("s", ""), lambda c: c != ""))
    squares = F.expr("aggregate(array_distinct(chars), 0D, (acc, c) -> acc + pow(length(s) - length(replace(s, c, '')), 2))")
    base = once(base, n=F.size("chars").cast("double"), x=F.expr("transform(chars, c -> cast(instr(alphabet, c) - 1 AS double))"), squares=squares)
    base = once(base, high=F.expr("transform(x, v -> v >= a / 2)"), mean=F.expr("aggregate(x, 0D, (acc, v) -> acc + v) / n"))
    base = once(
        base,
        n1=F.expr("cast(size(filter(high, h -> h)) AS double)"),
        runs=F.expr("1D + size(filter(transform(high, (h, i) -> h <> get(high, i - 1)), d -> d))"),
        var=F.expr("aggregate(x, 0D, (acc, v) -> acc + (v - mean) * (v - mean))"),
        cov=F.expr("aggregate(transform(x, (v, i) -> coalesce((v - mean) * (get(x, i - 1) - mean), 0D)), 0D, (acc, v) -> acc + v)"),
        chi=F.expr("a / n * squares - n"),
    )
    n, n1, n2 = F.col("n"), F.col("n1"), F.col("n") - F.col("n1")
    expected = 2 * n1 * n2 / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    z_chi = (F.col("chi") - (F.col("a") - 1)) / F.sqrt(2 * (F.col("a") - 1) * (n - 1) / n)
    z_runs = F.when((n1 == 0) | (n2 == 0), F.lit(6.0)).otherwise((F.col("runs") - expected) / spread)
    z_serial = F.when(F.col("var") <= 0, F.lit(6.0)).otherwise((F.col("cov") / F.col("var") + 1 / n) * F.sqrt(n))
    q = F.pow(F.greatest(z_chi, F.lit(0.0)), 2) + z_runs * z_runs + z_serial * z_serial
    cube = (F.pow(q / 3, 1 / 3) - (1 - 2 / 27)) / F.sqrt(F.lit(2 / 27))
    log_letter = F.array(*[F.lit(math.log(v)) for v in LETTERS])
    model = F.transform(
        "chars",
        lambda c: F.when(F.lower(c).between("a", "z"), F.get(log_letter, F.ascii(F.lower(c)) - 97)).when(c.between("0", "9"), F.lit(-2.302585)).otherwise(F.lit(-1.386294)),
    )
    kind = F.transform("chars", lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3))
    base = once(base, p_random=_tail(F.least(cube, F.lit(12.0))), model=model, kind=kind)
    switches = F.expr("size(filter(transform(kind, (k, i) -> k <> get(kind, i - 1)), d -> d))")
    plain = F.expr("aggregate(model, 0D, (acc, v) -> acc + v)") + switches * math.log(SWITCH) + (n - 1 - switches) * math.log(STAY)
    return once(base, evidence=-n * F.log("a") - plain).select(*strings.columns, "p_random", "evidence", "n")


def _limits(rows: DataFrame, slot: str, level: float) -> DataFrame:
    """``band, <slot>_limit``: the least slot of -log p, in steps of ``_BIN``,
    that Benjamini-Hochberg accepts in each band; none where it accepts no
    string. It works on a histogram of all strings, of some thousand rows
    whatever the corpus."""
    counts = rows.groupBy("band", slot).agg(F.count("*").alias("k"))
    whole = Window.partitionBy("band")
    above = whole.orderBy(F.col(slot).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = counts.select("band", slot, F.sum("k").over(above).alias("k"), F.sum("k").over(whole).alias("m"))
    accepted = marked.where(F.exp(-F.col(slot) * _BIN) <= level * F.col("k") / F.col("m"))
    return accepted.groupBy("band").agg(F.min(slot).alias(f"{slot}_limit"))


def discoveries(tested: DataFrame, fdr: float = FDR, alpha: float = ALPHA) -> DataFrame:
    """The strings that aren't ordinary text and that the battery doesn't
    refuse, by the thresholds of their band of lengths."""
    steps = lambda x: F.greatest(F.lit(0), F.least(F.lit(_MOST), F.floor(x / _BIN))).cast("int")
    band = F.least(F.floor(F.log2("n")), F.lit(10)).cast("int")
    rows = tested.withColumns({"band": band, "plain": steps(F.col("evidence")), "odd": steps(-F.log(F.greatest("p_random", F.lit(1e-30))))})
    held = rows.join(F.broadcast(_limits(rows, "plain", fdr)), "band").join(F.broadcast(_limits(rows, "odd", alpha)), "band", "left")
    refused = F.coalesce(F.col("odd") >= F.col("odd_limit"), F.lit(False))
    return held.where((F.col("plain") >= F.col("plain_limit")) & ~refused).drop("band", "plain", "odd", "plain_limit", "odd_limit", "n")


def render(found: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, fdr: float = FDR, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, base, added``: spans (start, kind, end) of the base patterns
    and of the battery, for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    found = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.concat(spans(F.col("text"), ASSIGN, 0, 6), spans(F.col("text"), ACCESS, 1), spans(F.col("text"), HEX, 2)).alias("base"),
        _strings(F.col("text"), spans(F.col("text"), CANDIDATE, 3)).alias("tried"),
    )
    found = materialise(found, "spans")
    tried = found.select("row", "base", F.explode("tried").alias("t")).where(F.expr("NOT exists(base, b -> b.start < t.end AND t.start < b.end)")).select("row", "t.*")
    added = discoveries(battery(tried), fdr, alpha).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end"))).alias("added"))
    return found.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))
