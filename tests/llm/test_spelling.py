"""Spelling variants against comparing all words with all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from codeweft.llm.spelling import near_in_block, near_words, spelling_variants

SHAPE = "doc_id long, text string, word string, n int, form string"
r = random.Random(11)


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def brute(rows):
    n = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def edited(word, letters):
    k = r.randrange(len(word) + 1)
    return r.choice((word[:k] + r.choice(letters) + word[k:], word[:k] + word[k + 1 :], word[:k] + r.choice(letters) + word[k + 1 :]))


def documents():
    letters = "abcdefgÉéßÿ"
    stems = ["".join(r.choices(letters, k=r.choice((6, 7, 8, 9, 14)))) for _ in range(25)] + ["aaaaaaaaaa", "aaaaaaaaab", "abababab"]
    words = []
    for stem in stems:
        one = edited(stem, letters)
        words += [stem] * 400 + [one] * 30 + [edited(one, letters) for _ in range(4)] * 2 + [edited(stem, letters) for _ in range(12)] * 2
    r.shuffle(words)
    words = [w.upper() if k % 7 == 0 and w.isascii() else w for k, w in enumerate(words)]
    rows = [(k, r.choice((" ", "×", "1", ", ")).join(words[k * 40 : k * 40 + 40])) for k in range(len(words) // 40 + 1)]
    return [*rows, (None, rows[0][1]), (3, rows[3][1]), (500, None), (501, ""), (502, "x" * 5000 + " " + "x" * 5000), (503, "x" * 4999 + "y " + "x" * 4999 + "y")]


@pytest.mark.parametrize("block", [512, 3])
def test_against_all_pairs(spark, block):
    rows = documents()
    table = spark.createDataFrame([(*row, "w", 1, "f") for row in rows], SHAPE).repartition(3)
    got = sorted((tuple(x) for x in spelling_variants(table, block=block).collect()), key=lambda x: x[0])
    want = brute(rows)
    assert got == want
    assert any(x[1] for x in want) and any(x[1] and x[2] != x[1] for x in want) and any(x[4] > 3 for x in want)


def test_each_pair_once(spark):
    """Every word of four letters of two kinds, in blocks that are all split."""
    words = [f"{k:08b}".replace("0", "a").replace("1", "b")[: 7 + k % 2] for k in range(256)]
    words = sorted(set(words))
    got = near_words(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint"), block=2).collect()
    pairs = [(x.word, x.other) for x in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(u, v) for u in words for v in words if one_edit(u, v)}


def test_block_by_pairs():
    words = sorted({"".join(r.choices("ab", k=k)) for k in (7, 8) for _ in range(60)})
    same = [w for w in words if len(w) == 7]
    assert {(same[i], same[j]) for i, j in near_in_block(same, 0, 7, 0, 0, 2**31 - 1)} == {(u, v) for u in same for v in same if u < v and one_edit(u, v)}
    found = near_in_block(words, 1, 7, 0, 0, 2**31 - 1)
    assert {(words[i], words[j]) for i, j in found} == {(u, v) for u in words for v in words if len(u) == 7 and len(v) == 8 and one_edit(u, v)}


def test_empty(spark):
    assert spelling_variants(spark.createDataFrame([], SHAPE)).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, None, "", 0, "")], SHAPE)).collect() == []
