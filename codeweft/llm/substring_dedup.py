"""Substring deduplication with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Its fingerprint is the smallest hash
of the ``GRAM``-word sequences in it (winnowing), so equal windows have equal
fingerprints and a document has far fewer fingerprints than windows. The index
keeps them in immutable runs, sorted by hash and bucketed: a new batch is
merge-joined with the runs where they lie, becomes a run itself, and runs of
one level are compacted into one of the next. A manifest beside the runs names
them; an index is opened again by its path, in another session too.

A fingerprint that two documents have makes their windows suspects. These are
verified by 128 bits over the words themselves, from two word hashes that are
independent of the fingerprint: one is removed where the same words also start
in a document with a smaller ``doc_id``.

Defined results: null and empty texts have no words and the digest of an empty
text; texts with fewer words than a window lose nothing; windows are judged on
the input, so what another document loses changes nothing; rows that repeat a
``doc_id`` are not held against each other; rows without ``doc_id`` lose
nothing and take nothing from others. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import _bitmap
from codeweft.llm._store import discard, materialise, passing_shuffles, remove, scratch, write
from codeweft.llm._words import SPACED, Words, buffers, grams, mix, release, slices, split
from codeweft.runtime import ship

WINDOW = 13
#: Words of the sequences that fingerprints are chosen from.
GRAM = 6
#: Runs of one level that are compacted into one of the next.
FANOUT = 2
#: Batches that ``substring_dedup`` feeds to a new index.
BATCHES = 4


def fingerprints(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of every window, in order."""
    g = grams(words.hashes(), gram)
    span = window - gram + 1
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    low = g[:n].copy()
    for j in range(1, span):
        np.minimum(low, g[j : j + n], out=low)
    size = np.diff(words.docs)
    left = np.repeat(words.docs[1:], size)[:n] - np.arange(n)  # words up to the document's end
    whole = np.flatnonzero(left >= window)
    return whole, low[whole]


def _rows(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


class FingerprintIndex:
    """Runs of ``hash, first``: the smallest document with a fingerprint, and
    lists of the fingerprints that several documents have."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.spark, self.path = spark, (path or scratch(spark, "index")).rstrip("/")
        self.window, self.gram, self.fanout = window, gram, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = 0
        self.levels: list[list[str]] = []
        self.shared_lists: list[str] = []
        self.tables: dict[str, str] = {}
        self._open()

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _open(self) -> None:
        """Take up the state of the newest manifest, if there is one."""
        fs, folder = self._fs(f"{self.path}/manifests")
        found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        if found:
            self.version = max(int(name.removesuffix(".json")) for name in found if name.endswith(".json"))
            stored = self.spark.read.text(f"{self.path}/manifests/{self.version}.json", wholetext=True).first()
            for key, value in json.loads(stored.value).items():
                setattr(self, key, value)

    def _commit(self, levels: list[list[str]], shared_lists: list[str]) -> None:
        """A new manifest makes a change visible; files that no manifest names
        any more go after it."""
        state = {"window": self.window, "gram": self.gram, "fanout": self.fanout, "buckets": self.buckets, "levels": levels, "shared_lists": shared_lists}
        fs, part = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, target = self._fs(f"{self.path}/manifests/{self.version + 1}.json")
        if not fs.rename(part, target):
            raise RuntimeError(f"another writer has changed the index {self.path}")
        gone = {run for level in self.levels for run in level} - {run for level in levels for run in level}
        self.version, self.levels, self.shared_lists = self.version + 1, levels, shared_lists
        for run in gone:
            self._forget(run)
            remove(self.spark, f"{self.path}/{run}")

    def _table(self, run: str) -> DataFrame:
        """A stored run, with its buckets and order made known to this session."""
        if run not in self.tables:
            name = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (hash BIGINT, first BIGINT, several BOOLEAN) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}' OPTIONS (compression 'zstd')")
            self.tables[run] = name
        return self.spark.table(self.tables[run])

    def _forget(self, run: str) -> None:
        if name := self.tables.pop(run, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _write(self, rows: DataFrame) -> str:
        """Write rows that lie in the index's partitioning as a run."""
        run = f"runs/{uuid.uuid4().hex}"
        self._table(run)
        with passing_shuffles(self.spark):
            rows.write.insertInto(self.tables[run])
        self.spark.catalog.refreshTable(self.tables[run])
        return run

    def add(self, docs: DataFrame) -> None:
        """Index a batch, and list the fingerprints of it that another
        document, of the batch or before it, has as well."""
        window, gram = self.window, self.gram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                words = split(*buffers(batch.column("text")), SPACED)
                at, hashes = fingerprints(words, window, gram)
                doc = np.asarray(batch.column("doc_id"))[np.searchsorted(words.docs, at, side="right") - 1]
                fresh = np.ones(len(at), dtype=bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
                hashes, doc = hashes[fresh], doc[fresh]
                # one row for each fingerprint of the slice goes on
                order = np.argsort(hashes)
                hashes, doc = hashes[order], doc[order]
                head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.empty(0, dtype=np.int64)
                low, high = (f.reduceat(doc, head) if len(head) else doc for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[head].view(np.int64)), pa.array(low), pa.array(high)], names=["hash", "low", "high"])

        each = _rows(docs).where("doc_id IS NOT NULL").mapInArrow(run, "hash bigint, low bigint, high bigint")
        batch = each.repartition(self.buckets, "hash").groupBy("hash").agg(F.min("low").alias("first"), F.max("high").alias("last"))
        new = self._write(batch.select("hash", "first", (F.col("first") < F.col("last")).alias("several")))
        # Fingerprints of several documents: of the batch itself, or of an older run too.
        several = self._table(new).where("several").select("hash")
        for old in [r for level in self.levels for r in level]:
            seen = self._table(new).hint("merge").join(self._table(old).select("hash"), "hash", "left_semi").select("hash")
            several = several.unionByName(seen)
        held = f"shared/{uuid.uuid4().hex}"
        write(several, f"{self.path}/{held}")
        self._commit([[*(self.levels[0] if self.levels else []), new], *self.levels[1:]], [*self.shared_lists, held])
        self._compact(0)

    def shared(self) -> DataFrame:
        """``hash`` of all fingerprints that several documents have; it may
        come more than once."""
        if not self.shared_lists:
            return self.spark.createDataFrame([], "hash bigint")
        return self.spark.read.schema("hash bigint").parquet(*[f"{self.path}/{held}" for held in self.shared_lists])

    def close(self, delete: bool = False) -> None:
        """Let the session forget the runs; ``delete`` the files as well."""
        for run in list(self.tables):
            self._forget(run)
        if delete:
            remove(self.spark, self.path)

    def _compact(self, level: int) -> None:
        """Merge the runs of a full level into one of the next; the smallest
        document of each fingerprint stays."""
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged = None
            for run in self.levels[level]:
                part = self._table(run)
                merged = part if merged is None else merged.join(part.select("hash", F.col("first").alias("other")).hint("merge"), "hash", "full").select("hash", F.least("first", "other").alias("first"), F.lit(False).alias("several"))
            above = self.levels[level + 1] if level + 1 < len(self.levels) else []
            self._commit([*self.levels[:level], [], [*above, self._write(merged)], *self.levels[level + 2 :]], self.shared_lists)
            level += 1


def _joined(words: Words) -> tuple[bytes, list[int]]:
    """All words joined by one blank, and where each begins."""
    n = len(words)
    joined = np.full(len(words.data) + n, 0x20, dtype=np.uint8)
    joined[np.arange(len(words.data)) + np.repeat(np.arange(n), np.diff(words.offs))] = words.data
    return joined.tobytes(), (words.offs + np.arange(n + 1)).tolist()


def _texts(words: Words, whole: bytes, place: list[int]) -> list[bytes]:
    border = words.docs.tolist()
    return [whole[place[a] : max(place[a], place[b] - 1)] for a, b in zip(border, border[1:])]


def _digests(words: Words, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits over the ``size`` words from each of ``begin``: two sums of
    word hashes times powers, taken from running totals and scaled back to
    the first power, so the same words agree wherever they stand."""
    out = []
    for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        h = mix(words.hashes(salt) ^ np.uint64(salt))
        up, down = (np.full(len(h) + 1, base, dtype=np.uint64) for base in (salt, pow(salt, -1, 1 << 64)))
        up[0] = down[0] = 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(up)[:-1])])
        value = (total[begin + size] - total[begin]) * np.multiply.accumulate(down)[begin]
        out.append(mix(value ^ size.astype(np.uint64)))
    return np.stack(out, axis=1)


def _suspects(docs: DataFrame, bitmap: _bitmap.Bitmap, window: int, gram: int) -> DataFrame:
    """A row for each document: number of words, ``sha`` (the digest of its
    words joined by one blank) and its suspect windows. These come in groups,
    neighbours with one fingerprint: ``begins`` is the first word of each,
    ``sizes`` its number of windows, ``digests`` 16 bytes over all words of the group, and ``windows`` 16 bytes
    for each of its windows. ``bitmap`` is the filter of shared fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split(*buffers(batch.column("text")), SPACED)
            at, hashes = fingerprints(words, window, gram)
            doc = np.searchsorted(words.docs, at, side="right") - 1
            some = _bitmap.test(bitmap, hashes) & np.asarray(batch.column("doc_id").is_valid())[doc]
            at, hashes, doc = at[some], hashes[some], doc[some]
            head = np.ones(len(at), dtype=bool)
            head[1:] = (at[1:] != at[:-1] + 1) | (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(head)
            size = np.diff(np.append(first, len(at)))
            whole, place = _joined(words)
            borders = pa.array(np.searchsorted(doc[first], np.arange(len(words.docs))), pa.int32())
            windows = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((16 * np.append(first, len(at))).astype(np.int32)), pa.py_buffer(_digests(words, at, np.full(len(at), window)))])
            groups = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((16 * np.arange(len(first) + 1)).astype(np.int32)), pa.py_buffer(_digests(words, at[first], size - 1 + window))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(words.docs)),
                    pa.array([hashlib.sha256(t).digest() for t in _texts(words, whole, place)], pa.binary()),
                    pa.ListArray.from_arrays(borders, pa.array((at[first] - words.docs[doc[first]]).astype(np.int32))),
                    pa.ListArray.from_arrays(borders, pa.array(size.astype(np.int32))),
                    pa.ListArray.from_arrays(borders, groups),
                    pa.ListArray.from_arrays(borders, windows),
                ],
                names=["doc_id", "n_words", "sha", "begins", "sizes", "digests", "windows"],
            )

    return _rows(docs).mapInArrow(run, "doc_id bigint, n_words bigint, sha binary, begins array<int>, sizes array<int>, digests array<binary>, windows array<binary>")


def _pairs_of_words(column: pa.Array) -> np.ndarray:
    """Two 64-bit words for every 16 bytes of a binary array."""
    return buffers(column)[0].view(np.uint64).reshape(-1, 2)


def _owner(digests: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash of a group and a document that has it."""
    return mix(digests[:, 0] ^ mix(doc.astype(np.int64).view(np.uint64)))


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_owner(_pairs_of_words(batch.column("digest")), np.asarray(batch.column("first"))).view(np.int64))], names=["h"])


def _windows(own: _bitmap.Bitmap, parts: _bitmap.Bitmap | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of groups in the first document that has each (and, rarely,
    of others); of those in the filter ``parts``, all that tells them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, blobs = (batch.column(c).flatten() for c in ("digests", "windows"))
            if not len(digests):
                continue
            doc = np.repeat(np.asarray(batch.column("doc_id").fill_null(0)), np.asarray(batch.column("digests").value_lengths().fill_null(0)))
            group = _pairs_of_words(digests)
            data, ends = buffers(blobs)
            window, ends = data.view(np.uint64).reshape(-1, 2), ends // 16
            of = np.repeat(np.arange(len(group)), np.diff(ends))
            some = _bitmap.test(own, _owner(group, doc))[of]
            if parts is None:
                yield pa.RecordBatch.from_arrays([pa.array(window[some, 0].view(np.int64)), pa.array(doc[of[some]])], names=["part", "first"])
                continue
            at = np.flatnonzero(some & _bitmap.test(parts, window[:, 0]))
            held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(np.ascontiguousarray(window[at]))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([held, digests.take(pa.array(of[at])), pa.array(doc[of[at]]), pa.array((at - ends[of[at]]).astype(np.int32))], names=["window", "digest", "first", "k"])
        release()

    return run


def index_in_batches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> FingerprintIndex:
    """A new index of all documents, fed in batches of equal ranges of ids."""
    index = FingerprintIndex(docs.sparkSession, None, window, gram)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (int(low), int(high)) if low is not None else (0, 0)
    for k in range(batches):
        a, b = (low + (high + 1 - low) * i // batches for i in (k, k + 1))
        index.add(docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b)))
    return index


def removals(docs: DataFrame, index: FingerprintIndex) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_words, sha`` of each document, and ``doc_id, text, ranges``
    of those that lose something: first words and numbers of the neighbouring
    windows to remove; ``text`` tells rows of one id apart."""
    bitmap = _bitmap.build(index.shared(), "hash")
    found = materialise(_suspects(docs, bitmap, index.window, index.gram), "suspects")
    groups = found.where("size(begins) > 0").select("doc_id", F.xxhash64("sha").alias("text"), F.explode(F.arrays_zip("begins", "sizes", "digests")).alias("g"))
    groups = groups.select("doc_id", "text", F.col("g.begins").alias("begin"), F.col("g.sizes").alias("size"), F.col("g.digests").alias("digest"))
    # Equal groups are judged once. All but the first document lose all of
    # one; the first loses the windows that other groups had before.
    distinct = materialise(groups.groupBy("digest").agg(F.min("doc_id").alias("first")), "groups")
    own = _bitmap.build(distinct.mapInArrow(_owners, "h bigint"), "h")
    # 64 bits of a window tell which may be in groups of several first
    # documents; the whole digest of those decides.
    seen = found.select("doc_id", "digests", "windows").mapInArrow(_windows(own), "part bigint, first bigint")
    several = materialise(seen.groupBy("part").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("part"), "several")
    chosen = found.select("doc_id", "digests", "windows").mapInArrow(_windows(own, _bitmap.build(several, "part")), "window binary, digest binary, first bigint, k int")
    chosen = materialise(chosen, "chosen")
    lowest = materialise(chosen.groupBy("window").agg(F.min("first").alias("lowest"), F.max("first").alias("highest")).where("lowest < highest").select("window", "lowest"), "lowest")
    earlier = materialise(chosen.join(lowest, "window").where("lowest < first").groupBy("digest", "first").agg(F.collect_set("k").alias("ks")), "earlier")
    judged = materialise(distinct.join(earlier, ["digest", "first"], "left"), "judged")
    discard(several, chosen, lowest, earlier, distinct)
    hits = groups.select("doc_id", "text", "begin", "size", "digest").join(judged, "digest").where("first < doc_id OR ks IS NOT NULL")
    ranges = F.expr("CASE WHEN first < doc_id THEN array(struct(begin AS begin, size AS size)) ELSE transform(ks, k -> struct(begin + k AS begin, 1 AS size)) END")
    gone = hits.select("doc_id", "text", ranges.alias("r")).groupBy("doc_id", "text").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    gone = materialise(gone, "gone")
    listed = materialise(found.select("doc_id", "n_words", "sha"), "listed")
    discard(judged, found)
    return listed, gone


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, kept_sha256``: ``kept`` is what is
    left of a document that loses something, words joined by one blank. With
    ``index``, which has to know all of ``docs``, nothing is indexed anew."""
    own = index or index_in_batches(docs, window, gram, batches)
    window = own.window
    listed, gone = removals(docs, own)
    if index is None:
        own.close(delete=True)
    # Only texts that lose something move to their removals.
    bitmap = _bitmap.build(gone.select(F.xxhash64("doc_id").alias("h")), "h")

    def losing(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts):
            batch = batch.filter(pa.array(_bitmap.test(bitmap, np.asarray(batch.column("h")).view(np.uint64))))
            if not batch.num_rows:
                continue
            words = split(*buffers(batch.column("text")), SPACED)
            texts = _texts(words, *_joined(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "sha", "joined"])

    def trim(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(parts, "joined"):
            words = split(*buffers(batch.column("joined")), SPACED)
            ranges = batch.column("ranges")
            listed = ranges.flatten()
            begin, size = (np.asarray(listed.field(f)).astype(np.int64) for f in ("begin", "size"))
            begin = begin + np.repeat(words.docs[:-1], np.asarray(ranges.value_lengths()))
            step = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, begin + size - 1 + window, -1)
            stays = np.cumsum(step)[:-1] == 0
            lens = np.diff(words.offs)
            left = np.concatenate([[0], np.cumsum(stays)])[words.docs]
            kept = Words(words.data[np.repeat(stays, lens)], np.concatenate([[0], np.cumsum(lens[stays])]), left)
            texts = _texts(kept, *_joined(kept))
            removed = np.diff(words.docs) - np.diff(left)
            shas = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), pa.array(removed), pa.array([t.decode(errors="replace") for t in texts]), pa.array(shas)], names=["doc_id", "sha", "n_removed", "kept", "kept_sha256"])

    moved = _rows(docs).withColumn("h", F.xxhash64("doc_id")).mapInArrow(losing, "doc_id bigint, sha binary, joined binary")
    pairs = moved.withColumn("text", F.xxhash64("sha")).join(gone, ["doc_id", "text"]).select("doc_id", "sha", "joined", "ranges")
    trimmed = pairs.mapInArrow(trim, "doc_id bigint, sha binary, n_removed bigint, kept string, kept_sha256 string")
    out = listed.join(trimmed.dropDuplicates(["doc_id", "sha"]), ["doc_id", "sha"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), "kept", F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"))
