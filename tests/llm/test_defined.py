"""What operators do with repeated and missing ids, very long texts, clashing
columns and empty tables, and parts of them worked out again in plain Python."""

import hashlib
import math
import random
import re
import struct
import time

import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline
from codeweft.llm import _bpe, bpe, decontaminate, exact_dedup, jaccard_join, license_scan, line_dedup, quality, secret_scan, substring_dedup, token_counts
from tests.llm.test_operators import VOCABULARY, alnum, passage, spaced

LONG = passage(77, 20_000)
ROWS = [(1, "alpha beta"), (1, "gamma delta"), (1, "alpha beta"), (None, "alpha beta"), (None, None), (2, LONG), (3, LONG + " more"), (4, ""), (None, LONG), (5, "tiny"), (5, None)]
SCHEMA = "doc_id long, text string, score string, sig string, id string, license string, row string, n string, cls string, component string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, *["x"] * 8) for d, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, " ".join(LONG.split()[9_000:9_020])), (8, None), (9, "alpha beta")], "item_id long, text string")


def counted(rows):
    return sorted(rows, key=repr)


def test_ids_in_decontaminate(spark, docs, bench):
    got = counted((r.doc_id, r.n_words, tuple(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect())
    want = counted((d, len(alnum(t)), tuple(["7"] * (len(alnum(t)) > 100) + ["9"] * (t == "alpha beta"))) for d, t in ROWS)
    assert got == want
    index = decontaminate.build_index(docs)  # made anew in each scan
    again = decontaminate.phrase_match(index, bench, block_bytes=30)
    assert counted((r.doc_id, r.n_words, tuple(r["items"])) for r in again.collect()) == want


def test_ids_in_bpe(docs):
    library = Tokenizer.from_file(VOCABULARY)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    coded = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert counted((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in coded.collect()) == counted((d, len(i), struct.pack(f"<{len(i)}I", *i), t or "") for (d, t), i in zip(ROWS, ids))
    assert counted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, VOCABULARY).collect()) == counted((d, len(i)) for (d, _), i in zip(ROWS, ids))


def test_ids_in_exact_dedup(docs):
    groups = {}
    for d, t in ROWS:
        groups.setdefault(t or "", []).append(d)
    most = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    want = counted((d, most[t or ""], len(groups[t or ""]), d == most[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ROWS)
    assert counted(map(tuple, exact_dedup.exact_dedup(docs).collect())) == want


def test_ids_in_jaccard(docs):
    got = counted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 3, (90, 100)).collect())
    size = lambda t: len({tuple(spaced(t)[i : i + 3]) for i in range(max(1, len(spaced(t)) - 2))}) if spaced(t) else 0
    of = {"alpha beta": 1, "gamma delta": 1, LONG: 2, LONG + " more": 2, "tiny": 5}
    assert got == counted((d, size(t), of.get(t, d)) for d, t in ROWS)


def test_ids_in_substring_dedup(docs):
    got = counted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == counted((d, len(spaced(t)), 20_000 if d == 3 else 0) for d, t in ROWS)


def test_ids_in_scans(docs):
    assert secret_scan.secret_scan(docs).count() == len(ROWS)
    assert license_scan.license_scan(docs).count() == 0
    lines = {r.doc_id: list(r.kept) for r in line_dedup.line_dedup(docs).collect()}
    assert lines == {1: [0], 2: [0], 5: [0]}  # one number for the lines of one id; the longer text is nearly the other


def test_score_again(spark, docs):
    """The score from the stored dictionaries and weights, step by step."""
    rnd = random.Random(3)
    rows = [(i, passage(i, 80) if i % 3 else " ".join(rnd.choice("!$%&#") * 3 + w for w in passage(i, 60).split())) for i in range(300)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(some, spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int"))

    def again(text):
        data = (text or "").encode()
        sizes = []
        for raw in (model.good, model.bad):
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(packer.compress(data[k : k + 512])) for k in range(0, len(data), 512)))
        a, b = sizes
        d = (b - a) / max(a + b, 1)
        r = math.log(max(a + b, 1) / (2 * len(data))) if data else 0.0
        x = [d, r, r * r, d * abs(d), min(math.log(len(data) + 1), 8) * d, math.log(len(data) + 1)]
        z = model.weight[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weight[1:], x, model.mean, model.scale))
        return 1 / (1 + math.exp(-max(-35, min(35, z))))

    scored = quality.score(docs, model)
    assert sorted(scored.columns) == sorted(docs.columns)
    for r in [*scored.select("text", "score").collect(), *quality.score(some, model).select("text", "score").collect()[:40]]:
        assert r.score == pytest.approx(again(r.text), abs=1e-4)


def test_battery_again(spark):
    """Chi-squared, runs, serial correlation and the letter model in plain
    Python."""
    rnd = random.Random(9)
    strings = ["".join(rnd.choice(a) for _ in range(n)) for a in ("0123456789", "abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for n in (20, 41)]
    strings += ["internationalization", "a" * 30, "aabbccddeeffgghhiijj", "src/components/navigation/header", "0123456789012345678901234=="]
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    sets = [digits, lower, upper, upper + lower, digits + "abcdef", digits + "ABCDEF", upper + "234567", digits + lower, digits + upper, digits + upper + lower]
    tail = lambda z: 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))

    def again(string):
        s = string.rstrip("=")
        alphabet = next((c for c in sets if set(s) <= set(c)), None)
        a, alphabet = (64, digits + upper + lower + "+/_-=") if alphabet is None else (len(alphabet), alphabet)
        n, x = len(s), [alphabet.index(c) for c in s]
        chi = sum((s.count(c) - n / a) ** 2 / (n / a) for c in set(s)) + (a - len(set(s))) * n / a
        high = [v >= a / 2 for v in x]
        n1 = sum(high)
        runs, mean = 1 + sum(p != q for p, q in zip(high, high[1:])), sum(x) / n
        var = sum((v - mean) ** 2 for v in x)
        cov = sum((v - mean) * (w - mean) for v, w in zip(x, x[1:]))
        z_chi = (chi - (a - 1)) / math.sqrt(2 * (a - 1) * (n - 1) / n)
        expected = 2 * n1 * (n - n1) / n + 1
        z_runs = 6.0 if n1 in (0, n) else (runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
        z_serial = 6.0 if var <= 0 else (cov / var + 1 / n) * math.sqrt(n)
        q = max(z_chi, 0) ** 2 + z_runs**2 + z_serial**2
        p = tail(min(((q / 3) ** (1 / 3) - (1 - 2 / 27)) / math.sqrt(2 / 27), 12))
        kinds = [0 if c in lower else 1 if c in upper else 2 if c in digits else 3 for c in s]
        switches = sum(p != q for p, q in zip(kinds, kinds[1:]))
        letters = sum(math.log(secret_scan.LETTERS[ord(c.lower()) - 97]) if c.isalpha() else math.log(0.1) if c.isdigit() else math.log(0.25) for c in s)
        plain = letters + switches * math.log(secret_scan.SWITCH) + (n - 1 - switches) * math.log(secret_scan.STAY)
        return p, -n * math.log(a) - plain

    rows = spark.createDataFrame([(s,) for s in strings], "string string")
    for r in secret_scan.battery(rows).collect():
        p, evidence = again(r.string)
        assert (r.p_random, r.evidence) == (pytest.approx(p, rel=1e-3, abs=1e-9), pytest.approx(evidence, abs=1e-3)), r.string


def test_false_discoveries(spark):
    """Benjamini-Hochberg by band of length, on p-values given straight."""
    rnd = random.Random(4)
    rows = [(float(rnd.choice((20, 40))), rnd.expovariate(1) + (rnd.random() < 0.1) * 12, rnd.random() ** 6) for _ in range(3000)]
    got = secret_scan.discoveries(spark.createDataFrame(rows, "n double, evidence double, p_random double")).count()

    def accepted(ps, level):
        slots = [min(1200, max(0, math.floor(-math.log(max(p, 1e-30)) / 0.05))) for p in ps]
        limit = min((s for s in set(slots) if math.exp(-s * 0.05) <= level * sum(t >= s for t in slots) / len(slots)), default=None)
        return [limit is not None and s >= limit for s in slots]

    want = 0
    for n in (20.0, 40.0):
        band = [r for r in rows if r[0] == n]
        plain, odd = accepted([math.exp(-r[1]) for r in band], secret_scan.FDR), accepted([r[2] for r in band], secret_scan.ALPHA)
        want += sum(a and not b for a, b in zip(plain, odd))
    assert got == want > 100


def test_prefixes_are_linear():
    model = _bpe.load(VOCABULARY)
    took = []
    for n in (4_000, 32_000):
        text = ("a  bc   d " * n)[:n]
        begin = time.perf_counter()
        counts = model.text_counts(text)
        took.append(time.perf_counter() - begin)
        assert counts[-1] == len(Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids)
    assert took[1] < 30 * took[0] + 1
    library = Tokenizer.from_file(VOCABULARY)
    for text in ("a  <|endoftext|>b!!<|endoftext|><|endoftext|>  x", "<|endoftext|>", "é　 \n\n  <|endof", "it's  'll<|endoftext|>'ve "):
        assert model.text_counts(text).tolist() == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)], text


def test_licence_of_another_holder(spark):
    words = license_scan._BSD + license_scan._BSD_3.replace("the copyright holder", "Example Research Institute of Somewhere")
    docs = spark.createDataFrame([(1, "# " + "\n# ".join(re.findall(r".{1,60}(?: |$)", words)))], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.dice >= 0.8) for r in license_scan.license_scan(docs).collect()] == [(1, "BSD-3-Clause", True)]


def test_stages(spark, docs, bench, tmp_path):
    """Each stage on missing and repeated ids, and on no rows at all: rows of
    one id stand or fall together, rows without one stay."""
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    ids = {name: counted({(r.doc_id, len(r.text or "")) for r in df.collect()}) for name, df in kept.items() if name != "bpe"}
    long = len(LONG)
    assert ids["exact_dedup"] == counted({(None, 0), (None, 10), (None, long), (1, 10), (1, 11), (2, long), (3, long + 5), (5, 0), (5, 4)})
    assert ids["near_dedup"] == counted({(None, 0), (None, 10), (None, long), (1, 10), (1, 11), (2, long), (4, 0), (5, 0), (5, 4)})
    assert ids["decontaminate"] == counted({(None, 0), (None, 10), (None, long), (4, 0), (5, 0), (5, 4)})
    assert kept["bpe"].count() == len(ROWS)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
