"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes exactly when every token encodes to itself and every
adjacent pair encodes to that pair. So a nondeterministic transducer reads bytes along a trie of the
vocabulary and may end a token where the pair with the token before it is admissible. Its determinisation
holds a set of (last token, trie node, tokens not yet written); the common prefix of those tokens is
written at once. A hypothesis dies when its trie path ends, so the lookahead is at most the longest token.
States and transitions are made when text first needs them and kept. All of it is held in arrays: the pretokens of
many texts advance together, a byte a step, and the transitions that a step lacks are made together.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shalecrest.llm.words import mix, raw, slices

#: White space as Unicode has it; Python's own class also holds four control characters.
SPACE = r"[\t-\r \x85\xa0  -     　]"
NONSPACE = SPACE.replace("[", "[^", 1)
#: The split before the merges that the vocabulary was made with.
PRETOKEN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!\p{{L}}|\p{{N}}){NONSPACE})+|{SPACE}+(?!{NONSPACE})|{SPACE}+"


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


#: Bytes that a vocabulary's file may have; it is sent to every executor.
LARGEST = 64 << 20


def vocabulary(path: str | None = None) -> bytes:
    """The file of a vocabulary, read on the driver: executors need no path."""
    path = path or default_vocabulary()
    if os.path.getsize(path) > LARGEST:
        raise ValueError(f"{path} has more than {LARGEST} bytes")
    with open(path, "rb") as f:
        return f.read()


def default_vocabulary() -> str:
    """The path of the vocabulary that queries use unless they are given one; SHALECREST_BPE overrides it."""
    return os.environ.get("SHALECREST_BPE", "/opt/tokenizers/byte_bpe_50k.tiktoken")


class Table:
    """Distinct 64-bit keys, none negative, numbered in the order in which they came: an open table, for many keys at once."""

    def __init__(self, bits: int = 12):
        self.n = 0
        self.keys = np.zeros(1 << bits, np.int64)  # by number
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.last = (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int64)
        self.number = np.zeros(1 << bits, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where it isn't there."""
        place = self._place(keys)
        there = self.slots[place]
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            place[open_] = (place[open_] + 1) & self.last
            there = self.slots[place[open_]]
            open_ = open_[(there != keys[open_]) & (there != -1)]
        return np.where(self.slots[place] == keys, self.number[place], -1)

    def insert(self, keys: np.ndarray) -> None:
        """Distinct keys that aren't there."""
        n = self.n + len(keys)
        if n > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros(max(n, 2 * len(self.keys)) - len(self.keys), np.int64)])
        self.keys[self.n : n] = keys
        if 2 * n > self.last:
            self._make((4 * n).bit_length())
            self._fill(self.keys[:n], 0)
        else:
            self._fill(keys, self.n)
        self.n = n

    def _fill(self, keys: np.ndarray, first: int) -> None:
        place, left = self._place(keys), np.arange(len(keys))
        while len(left):
            open_ = left[self.slots[place[left]] == -1]
            self.slots[place[open_]] = keys[open_]  # of several for one place the last stays
            left = left[self.slots[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & self.last
        self.number[place] = np.arange(first, first + len(keys))

    def add(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, of new ones too."""
        got = self.find(keys)
        new = got < 0
        if new.any():
            fresh = np.unique(keys[new])
            first = self.n
            self.insert(fresh)
            got[new] = first + np.searchsorted(fresh, keys[new])
        return got


class Rows:
    """Columns of numbers that grow at the end."""

    def __init__(self, *kinds):
        self.n, self.columns = 0, [np.zeros(1 << 12, k) for k in kinds]

    def append(self, *values: np.ndarray) -> None:
        n = self.n + len(values[0])
        if n > len(self.columns[0]):
            self.columns = [np.concatenate([c, np.zeros(max(n, 2 * len(c)) - len(c), c.dtype)]) for c in self.columns]
        for c, v in zip(self.columns, values, strict=True):
            c[self.n : n] = v
        self.n = n


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n of them, for each."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


_T = 20  # bits of a token in a key
_NONE = (1 << _T) - 1


class Transducer:
    """The transducer of one vocabulary. ``states`` bounds what is kept; beyond it the cache starts anew."""

    def __init__(self, ranks: dict[bytes, int], states: int = 300_000):
        self.ranks, self.most = ranks, states
        self.size = max(ranks.values(), default=-1) + 1
        if any(bytes([x]) not in ranks for x in range(256)) or self.size >= _NONE:
            raise ValueError("not a byte-level vocabulary of under a million tokens")
        self.bytes_of = {t: b for b, t in ranks.items()}
        self._halve()
        trie: dict[int, int] = {}
        ends = [-1]
        for b, t in ranks.items():
            if len(b) > 1 and self.left[t] < 0:
                continue  # never the result of the merges
            node = 0
            for x in b:
                key = node << 8 | x
                node = trie.get(key, 0)
                if not node:
                    node = trie[key] = len(ends)
                    ends.append(-1)
            ends[node] = t
        self.edges, self.trie = trie, Table()
        edges = np.fromiter(trie, np.int64, len(trie))
        self.trie.insert(edges)  # the edge of number k leads to the node k + 1
        self.ends = np.array(ends)
        self.inner = np.bincount(edges >> 8, minlength=len(ends)) > 0
        self.reset()
        self.long: dict[tuple, tuple] = {}
        self.long_pairs: dict[tuple, bool] = {}

    def _halve(self) -> None:
        """For each token the two tokens that its last merge joins, shorter tokens first; -1 for single bytes and tokens that merges never give."""
        rank = self.ranks.get
        joins = [(n, s << _T | t, r) for b, r in self.ranks.items() for n in [len(b)] if n > 1 for k in range(1, n) if (s := rank(b[:k])) is not None and (t := rank(b[k:])) is not None]
        size, key, whole = np.array(sorted(joins), np.int64).reshape(-1, 3).T.copy()
        self.joins, self.joined = Table(), whole
        self.joins.insert(key)
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        single = np.zeros(self.size, bool)
        single[[self.ranks[bytes([x])] for x in range(256)]] = True
        bound = np.flatnonzero(np.diff(size, prepend=-1))
        for a, b in zip(bound, [*bound[1:], len(size)], strict=True):
            s, t, r = key[a:b] >> _T, key[a:b] & _NONE, whole[a:b]
            made = (single[s] | (self.left[s] >= 0)) & (single[t] | (self.left[t] >= 0))
            s, t, r = s[made], t[made], r[made]
            ok = self._apart(s, t, r)  # with the merges before r they stay two
            self.left[r[ok]], self.right[r[ok]] = s[ok], t[ok]

    def _apart(self, s: np.ndarray, t: np.ndarray, below: np.ndarray | int = 1 << 60) -> np.ndarray:
        """Whether no merge of rank under ``below`` across the boundary comes before those that make s and t.

        Undoes the later of the merges that made the two tokens at the boundary, and asks each time whether
        joining what then meets there would have come first: before the merge that ended s or t at the
        boundary; on the right an equal rank is too late.
        """
        n = len(s)
        ok = np.ones(n, bool)
        at, s, t = np.arange(n), s.copy(), t.copy()
        before_s = before_t = np.broadcast_to(below, n).astype(np.int64)
        while len(at):
            j = self.joins.find(s << _T | t)
            r = np.where(j >= 0, self.joined[j], 1 << 60)
            joined = (r < before_s) & (r <= before_t)
            ok[at[joined]] = False
            one_s, one_t = self.left[s] < 0, self.left[t] < 0
            on = ~joined & ~(one_s & one_t)
            at, s, t, before_s, before_t, one_s, one_t = (x[on] for x in (at, s, t, before_s, before_t, one_s, one_t))
            left = ~one_s & (one_t | (s > t))
            before_s, before_t = np.where(left, np.minimum(before_s, s), before_s), np.where(left, before_t, np.minimum(before_t, t))
            s, t = np.where(left, self.right[s], s), np.where(left, t, self.left[t])
        return ok

    def reset(self) -> None:
        self.pairs, self.pair_ok = Table(), Rows(bool)
        #: Tokens not yet written, as chains: key of number k is (parent chain, token) of chain k + 1; chain 0 is empty.
        self.chains, self.chain = Table(), Rows(np.int32, np.int32, np.int32)  # parent, token, length
        self.chain.append(*[np.zeros(1, np.int32)] * 3)
        self.named, self.name_of = Table(), Rows(np.int32)  # states by the hash of their members
        self.members = Rows(np.int32, np.int32, np.int32)  # last token, trie node, chain
        self.states = Rows(np.int64, np.int32, np.int32)  # first member, members, chain written at the end
        self.steps, self.step = Table(16), Rows(np.int32, np.int32)  # state x 256 + byte: next state, chain written
        self._store(np.zeros(1, np.int64), np.ones(1, np.int64), np.array([_NONE]), np.zeros(1, np.int64), np.zeros(1, np.int64))

    def admissible(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the bytes of s and t together encode to s, t; a token without one before it is."""
        key = s.astype(np.int64) << _T | t
        got = self.pairs.find(key)
        new = (got < 0) & (s != _NONE)
        if new.any():
            fresh = np.unique(key[new])
            self.pairs.insert(fresh)
            self.pair_ok.append(self._apart(fresh >> _T, fresh & _NONE))
            got = self.pairs.find(key)
        return (s == _NONE) | self.pair_ok.columns[0][got]

    def _chained(self, parent: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The chains that end with a token more."""
        had = self.chains.n
        got = self.chains.add(parent.astype(np.int64) << _T | token)
        if self.chains.n > had:
            fresh = self.chains.keys[had : self.chains.n]
            self.chain.append(fresh >> _T, fresh & _NONE, self.chain.columns[2][fresh >> _T] + 1)
        return got + 1

    def _store(self, first: np.ndarray, n: np.ndarray, last: np.ndarray, node: np.ndarray, chain: np.ndarray) -> np.ndarray:
        """New states of the members from ``first`` on, n for each."""
        at = _spread(first, n)
        begin = self.members.n + np.cumsum(n) - n
        self.members.append(last[at], node[at], chain[at])
        whole = np.flatnonzero(node[at] == 0)  # one member of a state has just ended a token
        end = np.zeros(len(n), np.int64)
        end[np.repeat(np.arange(len(n)), n)[whole]] = chain[at][whole]
        had = self.states.n
        self.states.append(begin, n, end)
        return np.arange(had, self.states.n)

    def _named(self, first: np.ndarray, n: np.ndarray, last: np.ndarray, node: np.ndarray, chain: np.ndarray) -> np.ndarray:
        """States with these members. They are found by a hash and compared in full; of two with one hash the second has no name."""
        place = np.arange(len(last)) - np.repeat(first, n)
        h = mix(mix(mix(last.astype(np.uint64) ^ np.uint64(0x51ED270B)) + node.astype(np.uint64)) + chain.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(40)))
        key = (np.add.reduceat(h, first) >> np.uint64(1)).view(np.int64)
        uniq, rep, inv = np.unique(key, return_index=True, return_inverse=True)
        got = self.named.find(uniq)
        new = got < 0
        if new.any():
            had = self.named.n
            self.named.insert(uniq[new])
            self.name_of.append(self._store(first[rep[new]], n[rep[new]], last, node, chain))
            got[new] = np.arange(had, self.named.n)
        out = self.name_of.columns[0][got][inv].astype(np.int64)
        begin, size, _ = self.states.columns
        same = size[out] == n
        at, of = _spread(first[same], n[same]), _spread(begin[out[same]], n[same])
        differ = (self.members.columns[0][of] != last[at]) | (self.members.columns[1][of] != node[at]) | (self.members.columns[2][of] != chain[at])
        same[np.repeat(np.flatnonzero(same), n[same])[differ]] = False
        odd = np.flatnonzero(~same)
        if len(odd):
            out[odd] = self._store(first[odd], n[odd], last, node, chain)
        return out

    def _follow(self, keys: np.ndarray) -> None:
        """Make the transitions of states and bytes: the next states, and the tokens written."""
        begin, size, _ = self.states.columns
        state = keys >> 8
        n = size[state].astype(np.int64)
        at, of = _spread(begin[state], n), np.repeat(np.arange(len(keys)), n)
        last, node, chain = (c[at].astype(np.int64) for c in self.members.columns)
        child = self.trie.find(node << 8 | (keys & 255)[of]) + 1
        alive = child > 0
        of, last, child, chain = of[alive], last[alive], child[alive].astype(np.int64), chain[alive]
        token = self.ends[child]
        done = np.flatnonzero(token >= 0)
        done = done[self.admissible(last[done], token[done])]
        on = self.inner[child]
        # paths that go on, the longest first, then the one that begins here
        who = np.concatenate([of[on], of[done]])
        order = np.argsort(who, kind="stable")
        who = who[order]
        last = np.concatenate([last[on], token[done]])[order]
        node = np.concatenate([child[on], np.zeros(len(done), np.int64)])[order]
        chain = np.concatenate([chain[on], self._chained(chain[done], token[done])])[order].astype(np.int64)
        first = np.flatnonzero(np.diff(who, prepend=-1))
        n = np.diff(np.append(first, len(who)))
        parent, token_of, length = self.chain.columns
        # what all chains of a state begin with
        c = chain.copy()
        least = np.minimum.reduceat(length[c], first)[who]
        while (deep := length[c] > least).any():
            c[deep] = parent[c[deep]]
        while (apart := np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)).any():
            part = apart[who]
            c[part] = parent[c[part]]
        written = c[first]
        cut = np.flatnonzero(length[c] > 0)
        if len(cut):  # the rest of these
            rest = (length[chain[cut]] - length[c[cut]]).astype(np.int64)
            tokens, x = np.zeros((len(cut), int(rest.max(initial=0))), np.int64), chain[cut]
            for k in range(tokens.shape[1]):
                m = np.flatnonzero(rest > k)
                tokens[m, rest[m] - 1 - k] = token_of[x[m]]
                x[m] = parent[x[m]]
            new = np.zeros(len(cut), np.int64)
            for k in range(tokens.shape[1]):
                m = np.flatnonzero(rest > k)
                new[m] = self._chained(new[m], tokens[m, k])
            chain[cut] = new
        after = self._named(first, n, last, node, chain)
        self.steps.insert(keys)
        self.step.append(after, written)

    def words(self, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, ends): the tokens of each pretoken, at ``start`` in the bytes, one after the other."""
        if self.states.n > self.most or self.pairs.n > 4 * self.most:
            self.reset()
        n = len(size)
        order = np.argsort(-size, kind="stable")
        at, left = start[order], size[order]
        state = np.zeros(n, np.int64)
        who, what = [], []
        for j in range(int(left[0]) if n else 0):
            active = int(np.searchsorted(-left, -j, "left"))
            key = (state[:active] << 8) | b[at[:active] + j]
            got = self.steps.find(key)
            if (got < 0).any():
                self._follow(np.unique(key[got < 0]))
                got = self.steps.find(key)
            state[:active] = self.step.columns[0][got]
            wrote = self.step.columns[1][got]
            some = np.flatnonzero(wrote)
            who.append(order[some])
            what.append(wrote[some])
        who.append(order)
        what.append(self.states.columns[2][state])
        who_, what_ = np.concatenate(who), np.concatenate(what)
        by_word = np.argsort(who_, kind="stable")
        who_, what_ = who_[by_word], what_[by_word]
        parent, token_of, length = self.chain.columns
        many = length[what_].astype(np.int64)
        ends = np.cumsum(many)
        out = np.cumsum(np.bincount(who_, many, n)).astype(np.int64)
        tokens = np.zeros(int(many.sum()), np.uint32)
        k = 1
        while len(what_):
            on = many >= k
            what_, ends, many = what_[on], ends[on], many[on]
            tokens[ends - k] = token_of[what_]
            what_, k = parent[what_], k + 1
        return tokens, out

    def word(self, b: bytes) -> list[int]:
        """As ``words``, for one pretoken; a very long one isn't worth arrays."""
        out: list[int] = []
        members: tuple = ((-1, 0, ()),)
        for x in b:
            step = self.long.get((members, x))
            if step is None:
                if len(self.long) > self.most // 8:
                    self.long.clear()
                    self.long_pairs.clear()
                step = self.long[members, x] = self._follow_one(members, x)
            members, written = step
            out += written
        return out + list(next(chain for _, node, chain in members if node == 0))

    def _follow_one(self, members: tuple, x: int) -> tuple[tuple, tuple]:
        reached, ended = [], []
        for last, node, chain in members:
            child = self.edges.get(node << 8 | x)
            if child is None:
                continue
            if self.inner[child]:
                reached.append((last, child, chain))
            t = int(self.ends[child])
            if t >= 0:
                ok = last < 0 or self.long_pairs.get((last, t))
                if ok is None:
                    ok = self.long_pairs[last, t] = bool(self._apart(np.array([last]), np.array([t]))[0])
                if ok:
                    ended.append((t, 0, (*chain, t)))
        reached += ended
        lo, hi = min(h[2] for h in reached), max(h[2] for h in reached)  # what these share, all share
        n = 0
        while n < min(len(lo), len(hi)) and lo[n] == hi[n]:
            n += 1
        return tuple((last, node, chain[n:]) for last, node, chain in reached), lo[:n]


#: Kinds of characters.
_OTHER, _LETTER, _NUMBER, _WHITE = range(4)


def _kinds() -> np.ndarray:
    """The kind of every character."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, what in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, SPACE + "+")):
        for m in regex.finditer(what, every):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            out[a : b + 1] = kind
    return out


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Encoder:
    """Whole texts to ids. ``kept`` bounds a cache of the transducer's output for pretokens of up to 15 bytes."""

    #: Pretokens beyond so many bytes are encoded one by one.
    LONG = 256

    def __init__(self, data: bytes, kept: int = 500_000):
        self.fst = Transducer(ranks_of(data))
        self.kinds = _kinds()
        self.kept = kept
        self.renew()

    def renew(self) -> None:
        self.cache, self.rows = Table(16), Rows(np.uint64, np.uint64, np.int64, np.int32)  # the bytes with their number, place in the pool, tokens
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def pretokens(self, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The places at which pretokens begin in the bytes of texts that begin at ``starts``; the split of PRETOKEN."""
        ascii_ = not (b & 0x80).any()
        if ascii_:
            cp, first = b, starts[:-1]
        else:
            lead = (b & 0xC0) != 0x80
            cp = np.frombuffer(b.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            first = np.concatenate([[0], np.cumsum(lead)])[starts[:-1]]
        n = len(cp)
        kind = self.kinds[cp]
        begins = np.zeros(n + 4, bool)  # of texts
        begins[first] = True
        begins[n:] = True
        cut = begins.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        # of a run of white space the last goes alone, or with what follows if it is a space; at a text's end it is one
        white = kind == _WHITE
        over = np.flatnonzero(white & cut[1 : n + 1]) + 1  # where runs have ended
        over = over[~begins[over]]
        cut[over - 1] = True
        cut[over[cp[over - 1] == 32]] = False
        # contractions
        q = np.flatnonzero(cut[:n] & (cp == 39))
        q = q[~begins[q + 1]]
        x = cp[q + 1]
        short = np.isin(x, np.frombuffer(b"sdmt", np.uint8))
        y = cp[np.minimum(q + 2, n - 1)]
        pair = ~short & ~begins[q + 2] & (((x == 108) & (y == 108)) | ((x == 118) & (y == 101)) | ((x == 114) & (y == 101)))
        cut[q[short | pair] + 1] = False
        cut[q[short] + 2] = True
        cut[q[pair] + 3] = True
        at = np.flatnonzero(cut[:n])
        return at if ascii_ else np.flatnonzero(lead)[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, one after the other; a null has none."""
        b, starts = raw(texts)
        if not len(b):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        at = self.pretokens(b, starts)
        size = np.diff(np.append(at, len(b)))
        padded = np.concatenate([b, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        small = size <= 15
        w0 = eight[at] & _MASK[np.minimum(size, 8)]
        w1 = (eight[at + 8] & _MASK[np.clip(size - 8, 0, 7)]) | (size.astype(np.uint64) << np.uint64(56))
        key = (mix(w0 + mix(w1)) >> np.uint64(1)).view(np.int64)
        if self.cache.n > self.kept:
            self.renew()
        got = self.cache.find(key)
        new = np.flatnonzero((got < 0) & small)
        if len(new):
            uniq, rep = np.unique(key[new], return_index=True)
            rep = new[rep]
            ids, ends = self.fst.words(b, at[rep], size[rep])
            begin = np.concatenate([[0], ends[:-1]])
            self._pool(ids)
            self.cache.insert(uniq)
            self.rows.append(w0[rep], w1[rep], self.used + begin, ends - begin)
            self.used += len(ids)
            got[new] = self.cache.find(key[new])
        c0, c1, place, many = self.rows.columns
        # keys are hashes: a pretoken is only what the cache has if its bytes are the same
        other = np.flatnonzero(~small | (c0[got] != w0) | (c1[got] != w1))
        where, n = place[got], many[got].astype(np.int64)
        if len(other):
            medium = other[size[other] <= self.LONG]
            ids, ends = self.fst.words(b, at[medium], size[medium])
            n[medium] = np.diff(ends, prepend=0)
            where[medium] = self.used + ends - n[medium]
            parts = [ids]
            done = self.used + len(ids)
            for i in other[size[other] > self.LONG].tolist():
                one = np.array(self.fst.word(b[at[i] : at[i] + size[i]].tobytes()), np.uint32)
                where[i], n[i] = done, len(one)
                done += len(one)
                parts.append(one)
            self._pool(np.concatenate(parts))  # the next call writes over these
        total = np.concatenate([[0], np.cumsum(n)])
        return self.pool[_spread(where, n)], total[np.searchsorted(at, starts[1:])]

    def _pool(self, ids: np.ndarray) -> None:
        """Put ids behind those in use."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids


_encoders: dict[bytes, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """One encoder of a vocabulary for each Python worker, kept between tasks."""
    key = hashlib.sha256(data).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


#: What a first byte asks for: bytes still due, least and greatest next byte. Other bytes from 0x80 on never begin a character.
_LEAD = {x: (1, 0x80, 0xBF) for x in range(0xC2, 0xE0)} | {x: (2, 0x80, 0xBF) for x in range(0xE1, 0xF0)} | {x: (3, 0x80, 0xBF) for x in range(0xF1, 0xF4)} | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}


class Utf8:
    """An incremental UTF-8 state machine: bytes in pieces of any size to text as soon as it is complete.

    The state is (bytes still due, least and greatest next byte, the character's bits so far). An ill-formed sequence gives
    U+FFFD for each maximal part of it, as the Unicode Standard recommends, also when it spans pieces. Of a
    piece, what lies between the end of a character begun before and the last first byte is decoded at once.
    """

    def __init__(self) -> None:
        self.due = self.least = self.most = self.bits = 0

    def _step(self, x: int) -> str:
        out = ""
        if self.due:
            if self.least <= x <= self.most:
                self.due, self.least, self.most, self.bits = self.due - 1, 0x80, 0xBF, self.bits << 6 | x & 0x3F
                return "" if self.due else chr(self.bits)
            self.due, out = 0, "\ufffd"
        if x < 0x80:
            return out + chr(x)
        if x not in _LEAD:
            return out + "\ufffd"
        self.due, self.least, self.most = _LEAD[x]
        self.bits = x & (0x3F >> self.due)
        return out

    def feed(self, b: bytes) -> str:
        at, out = 0, []
        while at < len(b) and self.due:
            out.append(self._step(b[at]))
            at += 1
        # the last first byte, if it is near enough to the end to be incomplete
        end = next((k for k in range(len(b) - 1, max(at, len(b) - 3) - 1, -1) if b[k] & 0xC0 != 0x80), len(b))
        out.append(b[at:end].decode("utf-8", "replace"))
        out += map(self._step, b[max(at, end) :])
        return "".join(out)

    def end(self) -> str:
        due, self.due = self.due, 0
        return "\ufffd" if due else ""


def decode(pieces: Iterable[Iterable[int]], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Text of token ids that arrive in pieces; a character may span tokens and pieces."""
    machine = Utf8()
    for ids in pieces:
        yield machine.feed(b"".join(map(bytes_of.__getitem__, ids)))
    yield machine.end()


class Decoder:
    """Ids of many texts to bytes at once, and each text's bytes through the machine in pieces."""

    def __init__(self, bytes_of: dict[int, bytes]):
        n = max(bytes_of, default=-1) + 1
        self.size = np.zeros(n, np.int64)
        for t, b in bytes_of.items():
            self.size[t] = len(b)
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(bytes_of[t] for t in sorted(bytes_of)), np.uint8)

    def texts(self, ids: np.ndarray, ends: np.ndarray, step: int) -> Iterator[str]:
        n = self.size[ids]
        b = self.bytes[_spread(self.first[ids], n)].tobytes()
        to = np.concatenate([[0], np.cumsum(n)])
        begin = 0
        for end in ends.tolist():
            machine = Utf8()
            cuts = to[np.append(np.arange(begin, end, step), end)].tolist()
            yield "".join([machine.feed(b[p:q]) for p, q in zip(cuts, cuts[1:])]) + machine.end()
            begin = end


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", step: int = 4096) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip): every text encoded, decoded in pieces of ``step`` ids and compared.

    One pass without a shuffle. A null text has null ids, null round_trip and 0 tokens; an empty text has
    no ids and true. A null id stays null. Repeated rows give repeated results; ties don't arise. Columns
    other than the two named are neither read nor returned, so their names can't clash. An empty table
    gives an empty result. Texts are encoded whole, whatever their length.
    """
    data = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(data.value)
        back = Decoder(enc.fst.bytes_of)
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20, 4096):
                ids, ends = enc.encode(batch.column(1))
                texts = batch.column(1).to_pylist()
                same = [None if s is None else s == t for s, t in zip(texts, back.texts(ids, ends, step), strict=True)]
                none = np.array([s is None for s in texts] + [False])
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=none), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends, prepend=0).astype(np.int32)), out, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return src.mapInArrow(run, "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from shalecrest.llm.common import table

    return encode_documents(table(spark, sf_dir, "documents"))
