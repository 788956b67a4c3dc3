"""Spelling variants: words one edit apart, grouped under their frequent form.

Words are counted natively. Two words one edit apart keep one half intact:
either they share a prefix of half the shorter word's length or a suffix of
it. Each word therefore stands in a forward dictionary, under its first half,
and in a reversed one, under its last half, once for words of its own length (a
replaced code point) and once as the shorter and the longer of two lengths (an
inserted one). The dictionaries are dealt out by block and sorted; a task scans
one range after the other and compares the words of a block alone.

A block of more than ``BLOCK`` words is subdivided: the stretch that isn't
shared yet is halved again, so the block falls into words that also share the
first half of that stretch and words that also share its last half. This ends
where one code point is open, with at most as many words as there are letters,
so no block is ever large and no pair is lost. A pair that shares both halves
is taken from the first alone (``cap``), so each pair is found exactly once.

Defined results: a null text has no words; a null ``doc_id`` is written as
nothing before the colon. Rows that repeat count again. Words are compared by
code points, whatever their length. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm._store import discard, materialise
from codeweft.runtime import ship

#: Letters of a run, least code points and occurrences of a word.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One of so many occurrences, by a checksum, loses a code point.
THINNED = 31
#: A form is at least so many times as frequent as its variant.
TIMES = 10
#: Most words of a block that can still be subdivided.
BLOCK = 512

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What names a block: ``kind`` (0: a code point is replaced, 1: inserted),
#: code points of the shorter word, of the shared prefix and suffix, the prefix
#: length that a pair must not share, and the shared parts themselves.
_KEY = ("kind", "short", "a", "b", "cap", "head", "tail")
_BLOCKED = "word string, n bigint, kind int, short int, a int, b int, cap int"


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """``word, n`` of every word of at least ``least`` code points that occurs
    ``LEAST_COUNT`` times."""
    # Shorter runs can't become a word, and a run is matched from its start.
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    each = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("owner"), F.explode(runs).alias("run"))
    plain = F.octet_length("run") == F.length("run")  # then lower() touches A-Z alone
    each = each.select("owner", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    each = each.select("run", F.crc32(F.concat("owner", "run").cast("binary")).alias("h"))
    each = each.select("run", F.when(F.col("h") % THINNED == 0, (F.col("h") % F.length("run")).cast("int")).alias("at"))
    words = each.select(F.when(F.col("at").isNull(), F.col("run")).otherwise(F.concat(F.expr("left(run, at)"), F.expr("substring(run, at + 2)"))).alias("word"))
    # Lengths are looked at after the count: a filter of words would be pushed
    # down to each occurrence, and work out the word there a second time.
    return words.groupBy("word").agg(F.count("*").alias("n"), F.max(F.length("word")).alias("length")).where((F.col("n") >= LEAST_COUNT) & (F.col("length") >= least)).select("word", "n")


def _first_blocks(words: DataFrame) -> DataFrame:
    """Each word in both dictionaries, for each of its parts in a pair."""
    size = F.length("word")
    part = lambda kind, short, half, forward: F.struct(
        F.lit(kind).alias("kind"), short.alias("short"), (half if forward else F.lit(0)).alias("a"), (F.lit(0) if forward else half).alias("b"), (F.lit(2**31 - 1) if forward else half).alias("cap")
    )
    parts = []
    for forward in (True, False):
        parts.append(part(0, size, F.floor(size / 2).cast("int"), forward))
        parts += [part(1, short, F.floor((short + 1) / 2).cast("int"), forward) for short in (size, size - 1)]
    return words.select("word", "n", F.explode(F.array(*parts)).alias("p")).select("word", "n", "p.*")


def _keyed(blocked: DataFrame) -> DataFrame:
    return blocked.withColumns({"head": F.expr("left(word, a)"), "tail": F.expr("right(word, b)")})


def _open():
    """Code points of the shorter word that a block doesn't share."""
    return F.col("short") - F.col("a") - F.col("b")


def _subdivided(blocked: DataFrame) -> DataFrame:
    """The two blocks that each row of a large block goes on to."""
    half = F.floor((_open() + F.col("kind")) / 2).cast("int")
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("cap").alias("cap"))
    last = F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b"), F.least(F.col("cap"), F.col("a") + half).alias("cap"))
    return blocked.select("word", "n", "kind", "short", F.explode(F.array(first, last)).alias("p")).select("word", "n", "kind", "short", "p.*")


def _matrix(words: list[str], a: int, b: int) -> np.ndarray:
    """Code points between the shared parts, a row for each word."""
    data = "".join(w[a : len(w) - b] for w in words).encode("utf-32-le")
    return np.frombuffer(data, np.uint32).reshape(len(words), -1)


def near_in_block(words: list[str], kind: int, short: int, a: int, b: int, cap: int) -> list[tuple[int, int]]:
    """Places of the pairs of a block's distinct words that are one edit apart
    and don't share their first ``cap`` code points. The shared parts are
    compared again, so words that aren't of one block do no harm."""
    whole = lambda u, v: u[:a] == v[:a] and u[len(u) - b :] == v[len(v) - b :]
    if kind == 0:
        left = right = range(len(words))
        x = y = _matrix(words, a, b)
    else:
        left, right = ([k for k, w in enumerate(words) if len(w) == size] for size in (short, short + 1))
        if not left or not right:
            return []
        x, y = _matrix([words[k] for k in left], a, b), _matrix([words[k] for k in right], a, b)
    pairs = []
    # In slices, so that memory doesn't follow the length of the words.
    step = max(1, (1 << 20) // max(1, y.size))
    for begin in range(0, len(left), step):
        rows = x[begin : begin + step]
        if kind == 0:
            found = (rows[:, None, :] != y[None, :, :]).sum(axis=2) == 1
        else:
            width = x.shape[1]
            ahead = np.logical_and.accumulate(rows[:, None, :] == y[None, :, :width], axis=2).sum(axis=2)
            behind = np.logical_and.accumulate(rows[:, None, ::-1] == y[None, :, :0:-1], axis=2).sum(axis=2)
            found = ahead + behind >= width
        for i, j in zip(*(k.tolist() for k in np.nonzero(found))):
            i, j = left[begin + i], right[j]
            if (kind or i < j) and whole(words[i], words[j]) and (cap > short or words[i][:cap] != words[j][:cap]):
                pairs.append((i, j))
    return pairs


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words from rows that are sorted by block. A block may go over the
    end of a batch: its rows wait for the next one."""
    waiting: list[pa.RecordBatch] = []
    for batch in chain(batches, (None,)):
        waiting += [batch] if batch is not None and batch.num_rows else []
        if not waiting:
            continue
        rows = pa.Table.from_batches(waiting).combine_chunks()
        block = rows.column("block").to_numpy()
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        ends = np.append(starts[1:], len(block))
        if batch is not None:  # the last block may go on
            waiting = rows.slice(starts[-1]).to_batches()
            starts, ends = starts[:-1], ends[:-1]
        words = rows.column("word").to_pylist()
        named = [rows.column(c).to_numpy() for c in ("kind", "short", "a", "b", "cap")]
        several = ends - starts > 1
        one, other = [], []
        for begin, end in zip(starts[several].tolist(), ends[several].tolist()):
            kind, short, a, b, cap = (int(c[begin]) for c in named)
            for i, j in near_in_block(words[begin:end], kind, short, a, b, cap):
                one += (begin + i, begin + j)
                other += (begin + j, begin + i)
        if one:
            one, other = pa.array(one, pa.int64()), pa.array(other, pa.int64())
            found = pa.table({"word": rows.column("word").take(one), "other": rows.column("word").take(other), "other_n": rows.column("n").take(other)})
            yield from found.combine_chunks().to_batches()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, other, other_n``: every ordered pair of different words of
    ``words(word, n)`` (distinct words) that are one edit apart, once."""
    ship(words.sparkSession)
    # The last blocks have a word for each letter at most and stay as they are.
    splits = (F.count("*") > block) & (F.first("short") - F.first("a") - F.first("b") > F.when(F.first("kind") == 0, 1).otherwise(0))
    ready, pending = [], _keyed(_first_blocks(words))
    while True:
        large = materialise(pending.groupBy(*_KEY).agg(splits.alias("__large")).where("__large").drop("__large"), "large_blocks")
        if large.isEmpty():
            discard(large)
            ready.append(pending)
            break
        ready.append(pending.join(large, [*_KEY], "left_anti"))
        pending = _keyed(materialise(_subdivided(pending.join(large, [*_KEY], "left_semi")), "subdivided"))
    blocks = ready[0]
    for more in ready[1:]:
        blocks = blocks.unionByName(more)
    dealt = blocks.select("word", "n", *_KEY).repartition(*_KEY).sortWithinPartitions(*_KEY, "word")
    # Rows of one block stand together; a checksum tells where the next begins.
    numbered = dealt.select("word", "n", "kind", "short", "a", "b", "cap", F.xxhash64(*_KEY).alias("block"))
    return numbered.mapInArrow(_scan, "word string, other string, other_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms of ``forms(word, form)`` lead in the
    end. Each round doubles the steps taken; counts grow tenfold at least with
    each step, so there are few rounds and no cycles."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        if now.join(ahead, F.col("root") == F.col("__at"), "left_semi").isEmpty():
            return now
        further = now.join(ahead, F.col("root") == F.col("__at"), "left").select("word", F.coalesce("__next", "root").alias("root"))
        before, now = now, materialise(further, "roots")
        discard(before)


def spelling_variants(docs: DataFrame, least: int = LEAST_LENGTH, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs(doc_id,
    text)``."""
    words = materialise(word_counts(docs, least), "words")
    # Ties go to the smallest word, in code-point order.
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    found = -F.col("best.n") >= times * F.col("n")
    whole = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(found, F.col("best.word")).alias("form"), F.when(found, -F.col("best.n")).alias("form_n"))
    whole = materialise(whole, "variants")
    roots = _roots(whole.where("form IS NOT NULL"))
    out = whole.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
