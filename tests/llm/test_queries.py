"""The registered queries that SQL can't express, against brute force."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from codeweft.llm.line_dedup import line_dedup
from codeweft.llm.queries import QUERIES, VOCABULARY
from tests.llm.test_operators import BASE, TEXTS, passage

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
LINES = [*TEXTS, "\n".join(passage(k, 12) for k in range(6)), "\n".join(passage(k, 12).replace("r", "q", 1) + "\n" for k in range(6)), passage(3, 12).upper() + "\n \n" + BASE.replace("the", "thee", 1)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def run(spark, sf, name):
    return {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}


def test_tokens(spark, sf):
    library = Tokenizer.from_file(VOCABULARY)
    coded, counted = run(spark, sf, "op2_bpe"), run(spark, sf, "op7_token_counts")
    for d, text in enumerate(LINES):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (coded[d].n_tokens, coded[d].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert coded[d].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
        assert (counted[d].n_bytes, counted[d].n_tokens, counted[d].over_limit) == (len((text or "").encode()), len(ids), len(ids) > 1024)


def test_quality(spark, sf):
    got = run(spark, sf, "op3_quality")
    for d in range(len(LINES)):
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= got[d].score <= 1 and got[d].predicted == int(got[d].score >= 0.7)


def test_secrets(spark, sf):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    got = run(spark, sf, "op4_secret_scan")
    for d, text in enumerate(LINES):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m))
        listed = [f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans]
        assert got[d].base_sha256 == sha(",".join(listed))
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert [s for s in got[d].spans.split(",") if s and not s.startswith("random")] == listed


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark, sf):
    clean = [[re.sub(r"\s+", " ", line.lower()).strip(" ") for line in (text or "").split("\n")] for text in LINES]
    first = {}
    for d, lines in enumerate(clean):
        for k, line in enumerate(lines):
            if line:
                first.setdefault(line, (d, k))
    every = list(first)
    root = {x: x for x in every}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(every, 2):
        if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * edits(a, b) <= max(len(a), len(b)):
            x, y = sorted((find(a), find(b)), key=first.get)
            root[y] = x
    keep = {first[find(x)] for x in every}
    got = run(spark, sf, "op8_line_dedup")
    for d, lines in enumerate(clean):
        mine = sorted(k for e, k in keep if e == d)
        want = (len(lines) if LINES[d] is not None else 0, sum(bool(x) for x in lines) - len(mine), sha(",".join(map(str, mine))))
        assert (got[d].n_lines, got[d].n_removed, got[d].kept_sha256) == want


def test_line_recall(spark):
    """Of pairs that edit similarity alone links, at least 0.9 are found."""
    rnd = random.Random(11)
    rows, pairs = [], []
    for k in range(400):
        words = passage(1000 + k, rnd.randint(3, 60)).split()
        changed = list(words)
        for _ in range(rnd.randint(1, max(1, len(words) // 12))):
            at = rnd.randrange(len(changed))
            how = rnd.randrange(4)
            changed[at : at + 1] = [[], [changed[at], "more"], [rnd.choice(changed)], [changed[at][:-1] + "x"]][how]
        a, b = " ".join(words), " ".join(changed)
        rows += [(2 * k, a), (2 * k + 1, b)]
        if a != b and 5 * edits(a, b) <= max(len(a), len(b)):
            pairs.append(2 * k + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in line_dedup(docs).collect()}
    assert len(pairs) > 250 and sum(d not in kept for d in pairs) >= 0.9 * len(pairs)
    assert all(2 * k in kept for k in range(400))
