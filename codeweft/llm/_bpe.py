r"""Byte-level BPE on flat numpy arrays.

``Bpe`` reads a ``tokenizers`` JSON file (byte-level, no normaliser). A text is
split at special tokens and by byte-level pre-tokenisation (the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``); what follows works
on each distinct piece once.

Two independent algorithms are built on its tables: ``merge`` runs batched
merge rounds and gives ids, ``prefix_counts`` runs dynamic programming over
prefixes and gives counts.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: Characters outside these blocks may be letters or numbers in one version of
#: Unicode and not in another; texts with any go to the library's own splitter.
SURE = regex.compile("[\u0000-\u0557\u0590-\u088e\u0900-\u0c5b\u0d00-\u208e\u20a0-\ua7cd\uabc0-\ud7ff\ue000-\uffff\U0001f000-\U0001faff]")
#: Pieces whose number of tokens a worker remembers.
MEMO = 400_000
LETTER, NUMBER, SPACE, OTHER, UNSURE = range(5)

_NONE = np.int64(1 << 40)


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is
    visible in Latin-1, else the next one free from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        chars = _byte_chars()
        back = {c: b for b, c in chars.items()}
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte_id = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int64)
        spelled = [b""] * self.size
        for token, i in vocab.items():
            spelled[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.spelled = spelled
        self.spell_len = np.array([len(x) for x in spelled], dtype=np.int64)
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len
        self.spell = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        order = np.argsort((left << 20) | right)
        self.pair_key, self.pair_rank, self.pair_made = ((left << 20) | right)[order], rank[order], made[order]
        #: by token: the rank of the merge that makes it (-1: a byte) and its halves
        self.rank_of = np.full(self.size, -1, dtype=np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.rank_of[made], self.left[made], self.right[made] = rank, left, right
        self.kinds = _kinds()
        self.memo: dict[bytes, int] = {}

    @cached_property
    def trie(self) -> tuple[np.ndarray, ...]:
        """Edges node << 8 | byte -> node, sorted; the token that ends at a node."""
        node: dict[tuple[int, int], int] = {}
        token = [-1]
        for i, word in enumerate(self.spelled):
            if i in self.special.values():
                continue
            at = 0
            for b in word:
                if (at, b) not in node:
                    node[at, b] = len(token)
                    token.append(-1)
                at = node[at, b]
            if word:
                token[at] = i
        keys = np.array([(a << 8) | b for a, b in node], dtype=np.int64)
        to = np.array(list(node.values()), dtype=np.int64)
        order = np.argsort(keys)
        keys, to, token = keys[order], to[order], np.array(token, dtype=np.int64)
        first = np.full(256, -1, dtype=np.int64)
        first[keys[keys < 256]] = to[keys < 256]
        # the nodes of all strings of two bytes, -1 where there is none
        second = np.full(1 << 16, -1, dtype=np.int64)
        for b in np.flatnonzero(first >= 0).tolist():
            low, high = np.searchsorted(keys, (first[b] << 8, (first[b] + 1) << 8))
            second[(b << 8) | (keys[low:high] & 255)] = to[low:high]
        return keys, to, token, first, second

    # -- splitting

    def cuts(self, text: str) -> np.ndarray:
        """Byte offsets at which the pieces of one text start, by the library's
        splitter; each special token is one piece."""
        parts, out = [(text, False)], []
        for token in self.special:
            parts = [y for x, done in parts for y in ([(x, done)] if done else _around(x, token))]
        at = 0
        for part, special in parts:
            if special:
                out.append(at)
            elif part:
                chars = np.array([len(c.encode()) for c in part], dtype=np.int64)
                first = np.cumsum(chars) - chars
                out += (at + first[[a for _, (a, _) in self.splitter.pre_tokenize_str(part)]]).tolist()
            at += len(part.encode())
        return np.array(out, dtype=np.int64)

    def split(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Byte offsets at which pieces start, for all texts
        ``data[offs[d]:offs[d+1]]``; the pattern's alternatives worked out on
        runs of one class of characters."""
        if not len(data):
            return np.empty(0, dtype=np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        cp = data[lead].astype(np.int32)
        wide = np.flatnonzero(cp >= 0xC0)
        if len(wide):
            at, b = lead[wide], cp[wide]
            size = 2 + (b >= 0xE0) + (b >= 0xF0)
            value = b & (0xFF >> (size + 1))
            for k in (1, 2, 3):
                more = size > k
                value[more] = (value[more] << 6) | (data[at[more] + k] & 0x3F)
            cp[wide] = value
        kind = self.kinds[np.minimum(cp, len(self.kinds) - 1)]
        n = len(cp)
        fresh = np.zeros(n + 1, dtype=bool)  # a text starts here
        fresh[np.searchsorted(lead, offs)] = True
        change = fresh[:n].copy()
        change[1:] |= kind[1:] != kind[:-1]
        begin = np.flatnonzero(change)
        stop = np.append(begin[1:], n)
        run_kind, size = kind[begin], stop - begin
        ends_text = fresh[stop]
        starts = np.zeros(n, dtype=bool)
        space = run_kind == SPACE
        starts[begin] = True
        # the last of some spaces before something else stands apart ...
        last = stop[space & ~ends_text & (size > 1)] - 1
        starts[last] = True
        # ... and a blank there belongs to what follows
        joins = space & ~ends_text & (cp[stop - 1] == 0x20)
        starts[stop[joins]] = False
        # 's 't 're 've 'm 'll 'd
        quote = np.flatnonzero((run_kind[:-1] == OTHER) & (size[:-1] == 1) & (cp[begin[:-1]] == 0x27) & (run_kind[1:] == LETTER) & ~ends_text[:-1])
        quote = quote[starts[begin[quote]]]
        one, two = cp[begin[quote + 1]], np.where(size[quote + 1] > 1, cp[np.minimum(begin[quote + 1] + 1, n - 1)], 0)
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        for which, taken in ((short, 1), (long, 2)):
            run = quote[which]
            starts[begin[run + 1]] = False
            rest = run[size[run + 1] > taken]
            starts[begin[rest + 1] + taken] = True
        found = lead[starts]
        odd = np.searchsorted(offs, lead[kind == UNSURE], side="right") - 1
        whole = data.tobytes()
        for token in self.special:
            name, at = token.encode(), whole.find(token.encode())
            while at >= 0:
                odd = np.append(odd, np.searchsorted(offs, at, side="right") - 1)
                at = whole.find(name, at + 1)
        for d in np.unique(odd).tolist():
            a, b = int(offs[d]), int(offs[d + 1])
            low, high = np.searchsorted(found, (a, b))
            found = np.concatenate([found[:low], a + self.cuts(whole[a:b].decode()), found[high:]])
        return found

    def code(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct pieces, each piece's number, borders of the texts."""
        starts = self.split(data, offs)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = whole.dictionary_encode()
        return coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64), np.searchsorted(starts, offs)

    def _named(self, pieces: list[bytes]) -> np.ndarray:
        """Ids of special pieces, -1 for others: the pattern cuts the name of
        a special token up, so only a special piece has it whole."""
        by = {t.encode(): i for t, i in self.special.items()}
        return np.array([by.get(p, -1) for p in pieces], dtype=np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_NONE: no merge) and its place in the tables,
        by binary search over the sorted pair keys."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NONE), at

    # -- merge rounds

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        counts = np.zeros(len(pieces), dtype=np.int64)
        named = self._named(pieces)
        data = np.frombuffer(b"".join(b"" if n >= 0 else p for p, n in zip(pieces, named)), dtype=np.uint8)
        lens = np.array([0 if n >= 0 else len(p) for p, n in zip(pieces, named)], dtype=np.int64)
        symbol = self.byte_id[data]
        word = np.repeat(np.arange(len(pieces)), lens)
        done_word, done_symbol = [np.flatnonzero(named >= 0)], [named[named >= 0]]
        rank = np.full(len(symbol), _NONE)
        place = np.zeros(len(symbol), dtype=np.int64)
        stale = np.ones(len(symbol), dtype=bool)
        while len(symbol):
            # pairs (i, i + 1) whose symbols are new since the last round
            fresh = np.flatnonzero(stale[:-1] & (word[:-1] == word[1:]))
            rank[fresh], place[fresh] = self.look_up(symbol[fresh], symbol[fresh + 1])
            rank[-1] = _NONE
            rank[:-1][word[:-1] != word[1:]] = _NONE
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(begin, len(word)))
            low = np.minimum.reduceat(rank, begin)
            ended = np.repeat(low == _NONE, size)
            if ended.any():
                done_word.append(word[ended])
                done_symbol.append(symbol[ended])
                live = ~ended
                symbol, word, rank, place = symbol[live], word[live], rank[live], place[live]
                low, size = low[low != _NONE], size[low != _NONE]
                if not len(symbol):
                    break
            chosen = rank == np.repeat(low, size)
            # of overlapping occurrences (a run of one symbol) every other one counts
            where = np.flatnonzero(chosen)
            head = np.append(True, np.diff(where) != 1)
            since = np.arange(len(where)) - np.flatnonzero(head)[np.cumsum(head) - 1]
            where = where[since % 2 == 0]
            symbol[where] = self.pair_made[place[where]]
            stale = np.zeros(len(symbol), dtype=bool)
            stale[where] = True
            stale[np.maximum(where - 1, 0)] = True
            keep = np.ones(len(symbol), dtype=bool)
            keep[where + 1] = False
            symbol, word, rank, place, stale = symbol[keep], word[keep], rank[keep], place[keep], stale[keep]
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        counts += np.bincount(word, minlength=len(pieces))
        return symbol[order], counts

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the borders of the texts."""
        pieces, codes, ends = self.code(data, offs)
        ids, counts = self.merge(pieces)
        n = counts[codes]
        borders = np.concatenate([[0], np.cumsum(n)])
        first = (np.cumsum(counts) - counts)[codes]
        at = np.arange(borders[-1]) + np.repeat(first - borders[:-1], n)
        return ids[at], borders[ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text spell; bytes that aren't UTF-8
        become U+FFFD, as in the library."""
        n = self.spell_len[ids]
        borders = np.concatenate([[0], np.cumsum(n)])
        data = self.spell[np.arange(borders[-1]) + np.repeat(self.spell_at[ids] - borders[:-1], n)].tobytes()
        cut = borders[ends].tolist()
        return [_valid(data[a:b]) for a, b in zip(cut, cut[1:])]

    # -- prefixes

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether encoding the two tokens' joined bytes gives the same two
        tokens. Merges are undone from the latest on: as long as no pair that
        meets at the border merges earlier than the merges that close its two
        sides, the border stands."""
        good = np.ones(len(left), dtype=bool)
        live = np.arange(len(left))
        a, b = left.copy(), right.copy()
        # the earliest merge that removed the border-side symbol of each side
        until = np.full(len(left), _NONE)
        while len(live):
            rank, _ = self.look_up(a, b)
            bad = rank < until
            good[live[bad]] = False
            ra, rb = self.rank_of[a], self.rank_of[b]
            undo_left = ra > rb
            over = bad | (np.maximum(ra, rb) < 0)
            # A merge left of the border comes first at equal rank, so one that
            # meets the border at the rank of a merge on its right still wins.
            until = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            stay = ~over
            live, a, b, until = live[stay], a[stay], b[stay], until[stay]
        return good

    def prefix_counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece of n bytes n + 1 numbers: tokens of its prefix of
        0, 1 ... n bytes; and the borders of the pieces. Exactly one token can
        end an encoding of a prefix, and the rest is the encoding of a shorter
        prefix, so count[i] = count[i - len(last)] + 1."""
        named = self._named(pieces)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        lens = np.array([len(p) for p in pieces], dtype=np.int64)
        begin = np.cumsum(lens) - lens
        borders = np.concatenate([[0], np.cumsum(lens + 1)])
        count = np.zeros(borders[-1], dtype=np.int32)
        last = np.full(borders[-1], -1, dtype=np.int64)
        # every occurrence of a token inside a piece, as cell it starts from, cell it ends at
        at = np.flatnonzero(np.repeat(named < 0, lens))
        stop = np.repeat(begin + lens, lens)[at]
        cell = at + np.repeat(np.arange(len(pieces)), lens)[at]
        edge_key, edge_to, node_token, root, pairs = self.trie
        node, here, size = np.zeros(len(at), dtype=np.int64), at, 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(here):
            if size < 2:
                to = root[data[here]] if size == 0 else pairs[(data[here - 1].astype(np.int64) << 8) | data[here]]
                ok = to >= 0
                node = to[ok]
            else:
                key = (node << 8) | data[here]
                k = np.minimum(np.searchsorted(edge_key, key), len(edge_key) - 1)
                ok = edge_key[k] == key
                node = edge_to[k[ok]]
            here, stop, cell = here[ok] + 1, stop[ok], cell[ok]
            size += 1
            token = node_token[node]
            is_token = token >= 0
            found.append((cell[is_token], cell[is_token] + size, token[is_token]))
            more = here < stop
            node, here, stop, cell = node[more], here[more], stop[more], cell[more]
        if found:
            start, end, token = (np.concatenate(x) for x in zip(*found))
            # wave by wave: all prefixes of one length, of all pieces
            depth = end - np.repeat(borders[:-1], lens + 1)[end]
            order = np.argsort((depth << 32) | end)
            start, end, token, depth = start[order], end[order], token[order], depth[order]
            waves = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
            for a, b in zip(waves, waves[1:]):
                s, e, t = start[a:b], end[a:b], token[a:b]
                first = np.append(True, e[1:] != e[:-1])
                group = np.cumsum(first) - 1
                sizes = np.bincount(group)
                left = last[s]
                valid = (left < 0) | (sizes[group] == 1)
                ask = np.flatnonzero(~valid)
                valid[ask] = self.compatible(left[ask], t[ask])
                count[e[valid]] = count[s[valid]] + 1
                last[e[valid]] = t[valid]
        whole = np.flatnonzero(named >= 0)
        count[borders[whole + 1] - 1] = 1
        return count, borders

    def totals(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each whole piece, from the last cell of its prefixes. What
        recent slices asked for is remembered, up to ``MEMO`` pieces."""
        known = self.memo
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > MEMO:
            known.clear()
            new = pieces
        if new:
            count, borders = self.prefix_counts(new)
            known.update(zip(new, count[borders[1:] - 1].tolist()))
        return np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def text_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:k]`` for k = 0 ... len(text)."""
        chars = np.cumsum([0] + [len(c.encode()) for c in text])
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        starts = self.split(data, np.array([0, len(data)]))
        whole = data.tobytes()
        bounds = [*starts.tolist(), len(data)]
        pieces = [whole[a:b] for a, b in zip(bounds, bounds[1:])]
        count, borders = self.prefix_counts(pieces)
        at = np.zeros(len(data) + 1, dtype=np.int64)
        before, named = 0, self._named(pieces)
        for k, (a, piece) in enumerate(zip(bounds, pieces)):
            own = count[borders[k] : borders[k + 1]].astype(np.int64)
            at[a + 1 : a + len(piece) + 1] = before + own[1:]
            if len(piece) == 3 and piece in (b"'re", b"'ve", b"'ll"):
                at[a + 2] = before + 2  # without its last letter it is no contraction
            before += int(own[-1])
        out = at[chars]
        # Where the text up to k is split in another way than the whole text:
        # after all of several blanks, which then are one piece,
        runs = [(m.start(), m.end()) for m in regex.finditer(r"\s{2,}(?=\S)", text)]
        if runs:
            tails = self.totals([text[a:k].encode() for a, k in runs])
            for (a, k), n in zip(runs, tails.tolist()):
                out[k] = out[a] + n
        # and inside a special token, which then is ordinary text that may go
        # on from the piece before it.
        for i in np.flatnonzero(named >= 0).tolist():
            begin = bounds[i - 1] if i and named[i - 1] < 0 else bounds[i]
            first = int(np.searchsorted(chars, bounds[i])) + 1
            for k in range(first, int(np.searchsorted(chars, bounds[i + 1]))):
                part = whole[begin : chars[k]]
                found, codes, _ = self.code(np.frombuffer(part, dtype=np.uint8), np.array([0, len(part)]))
                out[k] = at[begin] + self.totals(found)[codes].sum()
        return out


def _kinds() -> np.ndarray:
    """The class of each character up to U+1FFFF; the last stands for all others."""
    out = np.full(0x20000, UNSURE, dtype=np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))
    at = np.array([*range(0xD800), *range(0xE000, 0x20000)])
    for kind, rule in ((OTHER, r"[^\s\p{L}\p{N}]"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[at[[m.start() for m in regex.finditer(rule, chars)]]] = kind
    sure = np.zeros(len(out), dtype=bool)
    sure[at[[m.start() for m in SURE.finditer(chars)]]] = True
    out[~sure] = UNSURE
    return out


def _around(text: str, token: str) -> list[tuple[str, bool]]:
    out: list[tuple[str, bool]] = []
    for k, part in enumerate(text.split(token)):
        out += [(token, True)] * bool(k) + [(part, False)]
    return out


def _valid(data: bytes) -> bytes:
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return data.decode(errors="replace").encode()


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)
